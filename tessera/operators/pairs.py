"""Labels, negatives, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """label 1 where the pair is in truth(s1_id, target_id)."""
    known = truth.select("s1_id", "target_id").distinct().withColumn("label", F.lit(1))
    return pairs.join(known, ["s1_id", "target_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def training_pairs(pairs: DataFrame, truth: DataFrame, reachable: DataFrame, negatives: int = 4, seed: int | None = None) -> DataFrame:
    """All true pairs with a known target, found or not, and at most ``negatives`` others per source: by rank, or with a seed by a hash."""
    true = truth.select("s1_id", "target_id").distinct().join(reachable.select(F.col("entity_id").alias("target_id")).distinct(), "target_id", "left_semi").join(pairs.select("s1_id").distinct(), "s1_id", "left_semi")
    by = F.col("rank") if seed is None else hash_order(F.concat_ws(":", "s1_id", "target_id"), seed)
    false = labelled(pairs, truth).where("label = 0").withColumn("n", F.row_number().over(W.partitionBy("s1_id").orderBy(by, "target_id"))).where(F.col("n") <= negatives)
    return true.select("s1_id", "target_id", F.lit(1).alias("label")).union(false.select("s1_id", "target_id", F.lit(0).alias("label")))


def hash_order(key: Column, seed: int) -> Column:
    """A seeded shuffle that any SQL engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(seed), key).cast("binary"))


def first_candidates(pairs: DataFrame, n: int = 12) -> DataFrame:
    """Each source's first n candidates by rank."""
    return pairs.withColumn("_n", F.row_number().over(W.partitionBy("s1_id").orderBy("rank", "target_id"))).where(F.col("_n") <= n).drop("_n")


def sample(df: DataFrame, n: int, key: str = "entity_id", seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if fewer), the first by a seeded hash."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def reduced_pool(targets: DataFrame, wanted: DataFrame, distractors: int, seed: int = 42) -> DataFrame:
    """The wanted targets (entity_id) and a number of others."""
    kept = wanted.select("entity_id").union(sample(targets.select("entity_id"), distractors, seed=seed)).distinct()
    return targets.join(kept, "entity_id", "left_semi")


def systematic_pool(targets: DataFrame, wanted: DataFrame, step: int = 15) -> DataFrame:
    """Every step-th target in order, and the wanted ones."""
    mark = wanted.select("entity_id").distinct().withColumn("_wanted", F.lit(True))
    return targets.join(mark, "entity_id", "left").where((F.col("seq") % step == 0) | F.col("_wanted")).drop("_wanted")


def entity_split(sources: DataFrame, share: float = 0.2, most: int = 20_000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, validation) sources; validation is min(most, max(1, share)) of them."""
    size = min(most, max(1, int(sources.count() * share)))
    held = sample(sources.select("entity_id").distinct(), size, seed=seed)
    return sources.join(held, "entity_id", "left_anti"), sources.join(held, "entity_id", "left_semi")


def hard_negatives(scored: DataFrame, floor: float = 0.70) -> DataFrame:
    return scored.where((F.col("label") == 0) & (F.col("prob") >= floor))


def first_of_each(df: DataFrame, key: str = "entity_id", order: str = "seq") -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
