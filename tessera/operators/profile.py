"""Profiles of sources and ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.wordlists import MISSING


def missing(records: DataFrame, by: str | None = None) -> DataFrame:
    """Rows, and count and percentage of missing values, of each column."""
    names = [c for c in records.columns if c != by]
    gone = lambda c: F.count_if(F.col(c).isNull() | F.col(c).cast("string").isin(*MISSING))
    one = records.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("rows"), *[gone(c).alias(c) for c in names])
    long = one.select(*([by] if by else []), "rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in names])).alias("x"))
    return long.select(*([by] if by else []), "rows", "x.column", "x.missing", (100.0 * F.col("x.missing") / F.col("rows")).alias("pct"))


def match_histogram(spine: DataFrame, truth: DataFrame) -> DataFrame:
    """How many entities have how many matches, and their share."""
    n = truth.select("s1_id", "target_id").distinct().groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = spine.select("s1_id").distinct().join(n, "s1_id", "left").groupBy(F.coalesce("n", F.lit(0)).alias("matches")).agg(F.count(F.lit(1)).alias("entities"))
    whole = sizes.agg(F.sum("entities").alias("t"))
    return sizes.join(F.broadcast(whole)).select("matches", "entities", (100.0 * F.col("entities") / F.col("t")).alias("pct"))


def match_kinds(spine: DataFrame, truth: DataFrame) -> DataFrame:
    h = match_histogram(spine, truth)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("entities"))), F.lit(0))
    by_source = truth.select("s1_id", "target_id").distinct().agg(F.count_if(F.col("target_id").startswith("S2-")).alias("s2_matches"), F.count_if(F.col("target_id").startswith("S3-")).alias("s3_matches"))
    kinds = h.agg(total(F.col("matches") == 0).alias("singletons"), total(F.col("matches") == 1).alias("single"), total(F.col("matches") > 1).alias("multi"))
    return kinds.join(F.broadcast(by_source))


def histogram(records: DataFrame, column: str) -> DataFrame:
    return records.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
