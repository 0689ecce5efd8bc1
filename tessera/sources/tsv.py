"""Readers and writers of the tab-separated record and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import files

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
_OPTIONS = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "multiLine": True}


def read_source(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Records; where no field holds a line break, ``multiline=False`` lets many tasks share a file."""
    return spark.read.options(**_OPTIONS | {"multiLine": multiline}).schema(SCHEMA).csv(path)


def head(records: DataFrame, n: int, order: str = "seq") -> DataFrame:
    return records.orderBy(order).limit(n)


def with_order(records: DataFrame, tables: int = 0) -> DataFrame:
    """seq: the place among all targets, file by file; ``tables`` counts the ones before. The order is that of one file's lines; write it out before relying on it for records that are not read from one file."""
    return records.withColumn("seq", F.monotonically_increasing_id() + F.lit(tables) * F.lit(1 << 56))


def targets(*sources: DataFrame) -> DataFrame:
    """All target tables in order, S2 before S3."""
    out = with_order(sources[0], 0)
    for k, df in enumerate(sources[1:], 1):
        out = out.unionByName(with_order(df, k))
    return out


def id_list(c):
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(spine: s1_id, pairs: s1_id, target_id)."""
    rows = spark.read.options(**_OPTIONS).schema(TRUTH).csv(path).select(F.col("source1_entity_id").alias("s1_id"), id_list(F.col("matched_entity_ids")).alias("ids"))
    return rows.select("s1_id"), rows.select("s1_id", F.explode("ids").alias("target_id"))


def read_pairs(spark: SparkSession, path: str, column: str = "candidate_entity_ids") -> DataFrame:
    """A result file as pairs with their place in the list (rank)."""
    rows = spark.read.options(**_OPTIONS).csv(path).select(F.col("source1_entity_id").alias("s1_id"), F.posexplode(id_list(F.col(column))).alias("rank", "target_id"))
    return rows.select("s1_id", "target_id", (F.col("rank") + 1).alias("rank"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """First field of each line but the header's and blank ones, without quoting."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.get(F.split("value", "\t"), F.lit(0)).alias("entity_id")).where(F.col("entity_id") != "entity_id")


def write_lists(lists: DataFrame, path: str) -> None:
    """One file, a row per entity, in order where seq tells it; empty lists are empty fields."""
    files.write_single(lists.orderBy("seq").drop("seq") if "seq" in lists.columns else lists, path)


def replace(spark: SparkSession, lists: DataFrame, path: str) -> None:
    """Write beside the path, then swap; a reader never sees half a result."""
    write_lists(lists, f"{path}.next")
    files.swap(spark, f"{path}.next", path)
