"""Quality measures: per-entity and macro F0.5, blocking recall, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

THRESHOLDS = tuple(round(0.50 + 0.02 * k, 2) for k in range(24))
#: Thresholds at which a trained model is checked (fixed values).
CHECKED_THRESHOLDS = (0.65, 0.70, 0.75, 0.78, 0.80, 0.85)
FINE_THRESHOLDS = tuple(round(0.50 + 0.01 * k, 2) for k in range(48))


def _measures(gt: Column, pred: Column, tp: Column) -> dict[str, Column]:
    p, r = tp / pred, tp / gt
    f = F.when(p + r > 0, 1.25 * p * r / (0.25 * p + r)).otherwise(0.0)
    pick = lambda both, wrong, missed, rest: F.when((gt == 0) & (pred == 0), both).when(gt == 0, wrong).when(pred == 0, missed).when(tp == 0, 0.0).otherwise(rest)
    return {"precision": pick(1.0, 0.0, 1.0, p), "recall": pick(1.0, 1.0, 0.0, r), "f05": pick(1.0, 0.0, 0.0, f)}


def per_entity(spine: DataFrame, truth: DataFrame, predicted: DataFrame, extra: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts and measures of each entity of spine(s1_id, *extra) from pairs truth and predicted(s1_id, target_id, *extra)."""
    g = truth.select("s1_id", "target_id").distinct().withColumn("g", F.lit(1))
    p = predicted.select(*extra, "s1_id", "target_id").distinct().withColumn("p", F.lit(1))
    hits = p.join(g, ["s1_id", "target_id"], "left").groupBy(*extra, "s1_id").agg(F.sum("p").alias("n_pred"), F.coalesce(F.sum("g"), F.lit(0)).alias("n_true"))
    known = g.groupBy("s1_id").agg(F.sum("g").alias("n_gt"))
    df = spine.select(*extra, "s1_id").distinct().join(known, "s1_id", "left").join(hits, [*extra, "s1_id"], "left")
    df = df.select(*extra, "s1_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_gt", "n_pred", "n_true")])
    return df.withColumns(_measures(F.col("n_gt"), F.col("n_pred"), F.col("n_true")))


def macro(entities: DataFrame, extra: list[str] = []) -> DataFrame:  # noqa: B006
    single = F.col("n_gt") == 0
    right = F.count_if(single & (F.col("n_pred") == 0))
    return entities.groupBy(*extra).agg(
        F.avg("f05").alias("macro_f05"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.coalesce(right / F.nullif(F.count_if(single), F.lit(0)), F.lit(1.0)).alias("singleton_accuracy"),
        F.count(F.lit(1)).alias("num_entities"), F.sum("n_gt").alias("num_gt_matches"), F.sum("n_pred").alias("num_pred_matches"),
        F.count_if(single).alias("num_singletons"), right.alias("singleton_correct"),
    )


def macro_f05(spine: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return macro(per_entity(spine, truth, predicted))


def blocking_recall(truth: DataFrame, found: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Found share of the true pairs, 1 without any; with a pool (entity_id), of those whose target lies in it."""
    g = truth.select("s1_id", "target_id").distinct()
    if pool is not None:
        g = g.join(pool.select(F.col("entity_id").alias("target_id")).distinct(), "target_id", "left_semi")
    hit = found.select("s1_id", "target_id").distinct().withColumn("hit", F.lit(1))
    return g.join(hit, ["s1_id", "target_id"], "left").agg(F.count(F.lit(1)).alias("num_true"), F.count("hit").alias("num_found"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"))


def threshold_grid(spine: DataFrame, truth: DataFrame, scored: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Macro measures at every threshold; each pair is kept at those that its probability reaches."""
    grid = F.array(*[F.lit(t) for t in thresholds])
    every = spine.select("s1_id", F.explode(grid).alias("threshold"))
    kept = scored.select("s1_id", "target_id", F.explode(F.filter(grid, lambda t: t <= F.col("prob"))).alias("threshold"))
    return macro(per_entity(every, truth, kept, ["threshold"]), ["threshold"])


def best_threshold(grid: DataFrame) -> DataFrame:
    return grid.orderBy(F.desc("macro_f05"), "threshold").limit(1)


def average_candidates(spine: DataFrame, found: DataFrame) -> DataFrame:
    """num_entities, num_pairs and avg_candidates, the mean number of candidates of an entity of spine(s1_id)."""
    sizes = found.select("s1_id", "target_id").distinct().groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    own = spine.select("s1_id").distinct().join(sizes, "s1_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return own.agg(F.count(F.lit(1)).alias("num_entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("num_pairs"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_candidates"))


def run_totals(spine: DataFrame, scored: DataFrame, matched: DataFrame, compact: DataFrame | None = None) -> DataFrame:
    """Totals of a run over the entities of spine(s1_id): how many have a match and how many none, pairs scored, matches, candidates kept, and averages per entity."""
    count = lambda df, name: df.groupBy("s1_id").agg(F.count(F.lit(1)).alias(name))
    df = spine.select("s1_id").distinct().join(count(scored, "scored"), "s1_id", "left").join(count(matched, "matched"), "s1_id", "left")
    df = df.join(count(scored if compact is None else compact, "kept"), "s1_id", "left").na.fill(0)
    n = F.count(F.lit(1))
    per = lambda total: F.coalesce(total / F.nullif(n, F.lit(0)), F.lit(0.0))
    return df.agg(
        n.alias("num_entities"), F.count_if(F.col("matched") > 0).alias("num_matched"), F.count_if(F.col("matched") == 0).alias("num_singletons"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"num_{c}_pairs") for c in ("scored", "matched", "kept")],
        per(F.count_if(F.col("matched") == 0)).alias("singleton_share"), *[per(F.coalesce(F.sum(c), F.lit(0))).alias(f"avg_{c}") for c in ("scored", "matched", "kept")],
    )


def errors(truth: DataFrame, predicted: DataFrame, rows: int = 5) -> DataFrame:
    """False positives and negatives by kind: kind, s1_id, target_id. Entities are taken in order, whole, until there are ``rows`` rows, so the last one may bring more."""
    a, b = truth.select("s1_id", "target_id").distinct(), predicted.select("s1_id", "target_id").distinct()
    wrong = {"false positive": b.join(a, ["s1_id", "target_id"], "left_anti"), "false negative": a.join(b, ["s1_id", "target_id"], "left_anti")}
    out = None
    for kind, pairs in wrong.items():
        # Each entity has a row at least, so no more entities than rows are needed.
        first = pairs.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")).orderBy("s1_id").limit(rows)
        before = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("s1_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        opened = first.withColumn("before", before).where(F.col("before") < rows).select("s1_id")
        own = pairs.join(F.broadcast(opened), "s1_id").select(F.lit(kind).alias("kind"), "s1_id", "target_id")
        out = own if out is None else out.union(own)
    return out
