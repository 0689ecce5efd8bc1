"""Whole pipelines: inference, experiments, rescoring and refinement, profiling."""

from __future__ import annotations

import logging
import time

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions.normalize import normalized
from tessera.operators import decide, evaluate, models, pairs, profile
from tessera.operators.blocking import candidates, tfidf_top
from tessera.operators.features import pair_features, with_records
from tessera.operators.filters import compatible, country_agrees
from tessera.sources import files, report, tsv

log = logging.getLogger(__name__)


def block(sources: DataFrame, targets: DataFrame, cap: int = 8, use_tfidf: bool = True, k: int = 5) -> DataFrame:
    return candidates(sources, targets, cap, tfidf_top(sources, targets, k) if use_tfidf else None)


def train_model(sources: DataFrame, targets: DataFrame, truth: DataFrame, kind: str = "xgboost", cap: int = 8, negatives: int = 4, use_tfidf: bool = True, **options) -> PipelineModel:
    """Normalized records in, model out."""
    found = block(sources, targets, cap, use_tfidf)
    return models.train(pair_features(with_records(pairs.training_pairs(found, truth, targets, negatives), sources, targets)), kind, **options)


def infer(model: PipelineModel, sources: DataFrame, targets: DataFrame, cap: int = 8, s2: float = 0.78, s3: float | None = None, use_tfidf: bool = True) -> tuple[DataFrame, DataFrame]:
    """(candidates, matches), both pairs."""
    found = block(sources, targets, cap, use_tfidf)
    scored = models.score(model, pair_features(with_records(found, sources, targets)))
    return found, decide.matches(scored, s2, s3)


def run_inference(spark: SparkSession, train: tuple[str, str, str, str], test: tuple[str, str, str], out: str, kind: str = "xgboost", cap: int = 8, s2: float = 0.78, s3: float | None = None, sample: int = 100_000, distractors: int = 100_000, use_tfidf: bool = True, **options) -> None:
    """Train on files (S1, S2, S3, truth), infer on files (S1, S2, S3), and write candidate_pairs and matching_results."""
    s1 = pairs.sample(tsv.read_source(spark, train[0]), sample)
    _, truth = tsv.read_truth(spark, train[3])
    wanted = truth.join(s1.selectExpr("entity_id s1_id"), "s1_id", "left_semi").selectExpr("target_id entity_id")
    pool = pairs.reduced_pool(tsv.targets(*[tsv.read_source(spark, p) for p in train[1:3]]), wanted, 2 * distractors)
    model = train_model(normalized(s1, True), normalized(pool, True), truth, kind, cap, use_tfidf=use_tfidf, **options)
    sources = normalized(tsv.with_order(tsv.read_source(spark, test[0])), True)
    targets = normalized(tsv.targets(*[tsv.read_source(spark, p) for p in test[1:]]), True)
    found, matched = infer(model, sources, targets, cap, s2, s3, use_tfidf)
    tsv.write_lists(decide.id_lists(sources, found, "candidate_entity_ids"), f"{out}/candidate_pairs.tsv")
    began = time.time()
    lists, seen = watched(decide.id_lists(sources, matched))
    tsv.write_lists(lists, f"{out}/matching_results.tsv")
    log.info("%s", progress_line(seen, time.time() - began))


def rescore(model: PipelineModel, found: DataFrame, sources: DataFrame, targets: DataFrame, threshold: float = 0.78, per_source: int = 4) -> tuple[DataFrame, DataFrame]:
    """(matches, compact candidates) of a given candidate table."""
    met = with_records(found, sources, targets).where(country_agrees(F.col("a_country"), F.col("b_country")))
    scored = models.score(model, pair_features(met))
    return decide.top_per_source(decide.matches(scored, threshold), per_source), decide.compact(scored, s2=threshold)


def refine(model: PipelineModel, matched: DataFrame, sources: DataFrame, targets: DataFrame, floor: float = 0.88, margin: float = 0.08, per_source: int = 4) -> DataFrame:
    """Precision refinement: near the entity's best, compatible, few per source table."""
    met = with_records(matched.select("s1_id", "target_id"), sources, targets)
    scored = models.score(model, pair_features(met))
    near = decide.near_best(scored, floor, margin)
    kept = compatible(with_records(near, sources, targets)).select("s1_id", "target_id", "prob")
    return decide.top_per_source(kept, per_source)


def experiment(sources: DataFrame, targets: DataFrame, truth: DataFrame, kinds=models.MODELS, cap: int = 50, options: dict | None = None, use_tfidf: bool = True, out: str | None = None) -> tuple[list[dict], DataFrame]:
    """(results of each model, blocking recall) on an entity-level split; with ``out``, results.csv and error_analysis.md go there."""
    training, held = pairs.entity_split(sources)
    found = {k: block(df, targets, cap, use_tfidf) for k, df in (("training", training), ("held", held))}
    rows = {k: pair_features(with_records(pairs.training_pairs(found[k], truth, targets, n, seed=42), df, targets)) for k, df, n in (("training", training, 5), ("held", held, 10))}
    spine = held.selectExpr("entity_id s1_id")
    own = truth.join(spine, "s1_id", "left_semi")
    results, last = models.compare(rows["training"], rows["held"], spine, own, kinds, options)
    recall = evaluate.blocking_recall(own, found["held"])
    if out:
        spark = sources.sparkSession
        report.write_results(spark, results, recall.first().recall, f"{out}/results.csv")
        predicted = decide.matches(models.score(last, rows["held"]), results[-1]["threshold"])
        files.write_text(spark, f"{out}/error_analysis.md", report.error_analysis(results[-1], report.described(evaluate.errors(own, predicted), held, targets)))
    return results, recall


def validate_accuracy(model: PipelineModel, sources: DataFrame, targets: DataFrame, truth: DataFrame, entities: int = 15_000, distractors: int = 50_000, cap: int = 35, per_entity: int = 12, seed: int = 999, use_tfidf: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(measures at the checked thresholds, blocking recall, average candidates) of a model on sampled entities, against their targets and a number of others of each table; the first ``per_entity`` candidates by rank are scored."""
    held = pairs.sample(sources, entities, seed=seed)
    spine = held.selectExpr("entity_id s1_id")
    own = truth.join(spine, "s1_id", "left_semi")
    wanted = own.selectExpr("target_id entity_id")
    pool = None
    for table in ("S2-", "S3-"):
        part = targets.where(F.col("entity_id").startswith(table))
        kept = pairs.reduced_pool(part, wanted, distractors, seed)
        pool = kept if pool is None else pool.unionByName(kept)
    found = block(held, pool, cap, use_tfidf)
    scored = models.score(model, pair_features(with_records(pairs.first_candidates(found, per_entity), held, pool)))
    return evaluate.threshold_grid(spine, own, scored, evaluate.CHECKED_THRESHOLDS), evaluate.blocking_recall(own, found), evaluate.average_candidates(spine, found)


def watched(lists: DataFrame, name: str = "matched_entity_ids") -> tuple[DataFrame, Observation]:
    """lists, and an observation that has, once they are written, how many entities they hold, how many have a match and how many none."""
    seen = Observation("progress")
    some = F.count_if(F.col(name) != "")
    return lists.observe(seen, F.count(F.lit(1)).alias("entities"), some.alias("matched"), F.count_if(F.col(name) == "").alias("singletons")), seen


def progress_line(seen: Observation, seconds: float) -> str:
    """Rate, matched and singleton shares of a written result."""
    own = seen.get
    n = max(own["entities"], 1)
    return f"{own['entities']:,} entities, {own['entities'] / max(seconds, 1e-9):.0f} a second; matched {own['matched']:,} ({100 * own['matched'] / n:.1f} %), singletons {own['singletons']:,} ({100 * own['singletons'] / n:.1f} %)"


def audit(records: DataFrame, spine: DataFrame, truth: DataFrame) -> dict[str, DataFrame]:
    return {"missing": profile.missing(records), "matches": profile.match_histogram(spine, truth), "kinds": profile.match_kinds(spine, truth), "countries": profile.histogram(records, "country")}


def diagnose(sources: DataFrame, targets: DataFrame, truth: DataFrame, cap: int = 150, misses: int = 10) -> tuple[DataFrame, DataFrame]:
    """(recall on targets in the pool, first misses)."""
    found = block(sources, targets, cap)
    missed = truth.join(found.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_anti").orderBy("s1_id", "target_id").limit(misses)
    return evaluate.blocking_recall(truth, found, targets), missed
