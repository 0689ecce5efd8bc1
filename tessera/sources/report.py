"""Reports of experiments: the table of results and the error analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.features import last_of_each
from tessera.sources import files

#: Columns of the table of results, and the names under which experiments give them (fixed values).
COLUMNS = (
    ("experiment_id", "experiment_id"), ("model", "model"), ("threshold", "threshold"), ("precision", "macro_precision"), ("recall", "macro_recall"), ("f0.5", "macro_f05"),
    ("blocking_recall", "blocking_recall"), ("candidate_count", "candidate_count"), ("singleton_accuracy", "singleton_accuracy"),
)


def write_results(spark: SparkSession, results: list[dict], blocking_recall: float, path: str) -> None:
    """One CSV row per experiment."""
    rows = [tuple(str(({"blocking_recall": blocking_recall} | r)[theirs]) for _, theirs in COLUMNS) for r in results]
    files.write_single(spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c, _ in COLUMNS)).coalesce(1), path, ",")


def described(errors: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """errors(kind, s1_id, target_id) with names, addresses and the source's country."""
    side = lambda df, key, p: last_of_each(df).select(F.col("entity_id").alias(key), F.col("original_name").alias(f"{p}_name"), F.col("original_address").alias(f"{p}_address"), *([F.col("country").alias("country")] if p == "s1" else []))
    return errors.join(side(sources, "s1_id", "s1"), "s1_id", "left").join(side(targets, "target_id", "target"), "target_id", "left")


def error_analysis(best: dict, found: DataFrame) -> str:
    """Markdown of the best experiment's measures and of the few described errors."""
    rows = found.orderBy("kind", "s1_id", "target_id").collect()
    text = ["# Error analysis", "", "## Summary", ""]
    text += [f"- **{name}**: {best[key]:.6f}" if key != "model" else f"- **{name}**: {best[key]}" for name, key in (("Best model", "model"), ("Threshold", "threshold"), ("Macro F0.5", "macro_f05"), ("Precision", "macro_precision"), ("Recall", "macro_recall"), ("Singleton accuracy", "singleton_accuracy"))]
    for kind, title, other in (("false positive", "False positives (false merges)", "Predicted"), ("false negative", "False negatives (missed matches)", "Missed")):
        text += ["", f"## {title}"]
        for k, r in enumerate((r for r in rows if r.kind == kind), 1):
            text += ["", f"### {kind.capitalize()} {k}"]
            text += [f"- **Source ({r.s1_id})**: name `{r.s1_name or ''}`, address `{r.s1_address or ''}`", f"- **{other} target ({r.target_id})**: name `{r.target_name or ''}`, address `{r.target_address or ''}`", f"- **Country**: `{r.country or ''}`"]
    return "\n".join(text) + "\n"
