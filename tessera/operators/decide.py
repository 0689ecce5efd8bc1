"""From scored pairs (s1_id, target_id, prob) to matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def above_threshold(s2: float = 0.78, s3: float | None = None) -> Column:
    return F.col("prob") >= F.when(F.col("target_id").startswith("S2-"), F.lit(s2)).otherwise(F.lit(s2 if s3 is None else s3))


def matches(scored: DataFrame, s2: float = 0.78, s3: float | None = None) -> DataFrame:
    return scored.where(above_threshold(s2, s3))


def top_per_source(scored: DataFrame, n: int = 4) -> DataFrame:
    """The n most probable targets of each source table per entity."""
    order = W.partitionBy("s1_id", F.substring("target_id", 1, 3)).orderBy(F.desc("prob"), "target_id")
    return scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def near_best(scored: DataFrame, floor: float = 0.88, margin: float = 0.08) -> DataFrame:
    """Targets at or above floor and within margin of the entity's best, over all its candidates."""
    best = F.max("prob").over(W.partitionBy("s1_id"))
    return scored.withColumn("_best", best).where((F.col("prob") >= floor) & (F.col("_best") - F.col("prob") <= margin)).drop("_best")


def compact(scored: DataFrame, budget: int = 6, s2: float = 0.78, s3: float | None = None) -> DataFrame:
    """All matches, and the best others up to the budget."""
    own = W.partitionBy("s1_id")
    df = scored.withColumn("matched", above_threshold(s2, s3))
    df = df.withColumn("_m", F.count_if("matched").over(own)).withColumn("_n", F.row_number().over(own.orderBy(F.desc("matched"), F.desc("prob"), "target_id")))
    return df.where(F.col("matched") | (F.col("_n") <= F.greatest(F.col("_m"), F.lit(budget)))).drop("_m", "_n")


def id_lists(spine: DataFrame, pairs: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """One row per entity of spine(entity_id): its sorted, comma-joined targets, '' without any."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias(name))
    joined = spine.select(F.col("entity_id").alias("s1_id"), *(["seq"] if "seq" in spine.columns else [])).join(lists, "s1_id", "left")
    return joined.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name), *(["seq"] if "seq" in spine.columns else []))
