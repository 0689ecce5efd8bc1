"""Pair classifiers: training, scoring, persistence, hard negatives, selection.

Boosted trees of other libraries become Spark's gradient-boosted trees of the
same number, depth and rate: a similar family, not equal scores. Extra trees
have no counterpart and become a random forest.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.wordlists import FEATURES
from tessera.operators.evaluate import FINE_THRESHOLDS, THRESHOLDS, best_threshold, threshold_grid
from tessera.operators.pairs import hard_negatives

MODELS = ("logistic_regression", "random_forest", "extra_trees", "xgboost", "lightgbm", "catboost")


def classifier(kind: str, rows: int = 10_000, seed: int = 42, **options):
    common = {"featuresCol": "features", "labelCol": "label"}
    if kind == "logistic_regression":
        return LogisticRegression(**({"maxIter": 1000, "regParam": 1.0 / max(rows, 1)} | options), **common)
    if kind in ("random_forest", "extra_trees"):
        return RandomForestClassifier(**({"numTrees": 100, "maxDepth": 15, "seed": seed} | options), **common)
    if kind in ("xgboost", "lightgbm", "catboost"):
        depth = 7 if kind == "catboost" else 8
        return GBTClassifier(**({"maxIter": 250, "maxDepth": depth, "stepSize": 0.08, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": seed} | options), **common)
    raise ValueError(f"unknown model: {kind}; one of {', '.join(MODELS)}")


def train(labelled: DataFrame, kind: str = "xgboost", **options) -> PipelineModel:
    """A fitted pipeline. Rows of one class alone give a model that is sure of that class; its only probability counts as the score, as for a classifier with one output."""
    classes = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(classes) < 2:
        return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), SQLTransformer(statement="SELECT *, array(0.0D, 1.0D) AS probability FROM __THIS__")]).fit(labelled)
    own = classifier(kind, sum(classes.values()), **options)
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), own]).fit(labelled)
    if getattr(model.stages[-1], "hasSummary", False):
        # The summary holds the session, with which a fresh model can't be sent to executors.
        model.stages[-1]._java_obj.setSummary(labelled.sparkSession._jvm.scala.Option.empty())
    return model


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    kept = [c for c in features.columns if c not in FEATURES]
    return model.transform(features).select(*kept, _second(model).alias("prob"))


def _second(model: PipelineModel):
    if isinstance(model.stages[-1], SQLTransformer):
        return F.get("probability", F.lit(1))
    return vector_to_array("probability")[1]


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def compare(training: DataFrame, validation: DataFrame, spine: DataFrame, truth: DataFrame, kinds: tuple[str, ...] = MODELS, options: dict | None = None) -> tuple[list[dict], PipelineModel]:
    """(results, last model): train each model, take its best threshold on the validation entities, and retrain the best one on its hard negatives as well."""
    results, models = [], {}
    training, validation = training.persist(), validation.persist()
    count = validation.count()
    for kind in kinds:
        models[kind] = train(training, kind, **(options or {}).get(kind, {}))
        best = best_threshold(threshold_grid(spine, truth, score(models[kind], validation), THRESHOLDS)).first()
        results.append({"experiment_id": kind, "model": kind, "candidate_count": count, **best.asDict()})
    top = max(results, key=lambda r: r["macro_f05"])
    hard = hard_negatives(score_and_keep(models[top["model"]], training)).drop("prob")
    again = train(training.unionByName(hard), top["model"], **(options or {}).get(top["model"], {}))
    best = best_threshold(threshold_grid(spine, truth, score(again, validation), FINE_THRESHOLDS)).first()
    results.append({"experiment_id": f"{top['model']}_hard_negatives", "model": top["model"], "candidate_count": count, **best.asDict()})
    return results, again


def score_and_keep(model: PipelineModel, features: DataFrame) -> DataFrame:
    """As score, with the features kept."""
    return model.transform(features).select(*features.columns, _second(model).alias("prob"))


def demo_probability():
    """A fixed stand-in for a classifier, for queries with an exact expectation; not a trained score."""
    return F.round(0.55 * F.col("name_token_jaccard") + 0.3 * F.col("addr_token_jaccard") + 0.15 * F.col("country_exact"), 6)
