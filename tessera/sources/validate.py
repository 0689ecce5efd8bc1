"""Checks of result files: one row per finding, and a verdict."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADERS = {"matching": "source1_entity_id\tmatched_entity_ids", "candidates": "source1_entity_id\tcandidate_entity_ids"}
EXAMPLES = 5


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def exit_code(self) -> int:
        return int(bool(self.errors))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1) and value, in file order."""
    numbered = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1] + 1, x[0].value))
    return spark.createDataFrame(numbered, "line long, value string")


def _examples(df: DataFrame, column: str) -> tuple[int, list[str]]:
    found = df.select(column).distinct()
    return found.count(), sorted(r[0] for r in found.orderBy(column).limit(EXAMPLES).collect())


def parsed(spark: SparkSession, path: str, kind: str, report: Report) -> DataFrame | None:
    """s1_id, ids of the last row of each source; findings go to the report, None after a fatal one."""
    try:
        if not spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty():
            report.errors.append(f"{kind}: not UTF-8")
            return None
        lines = _lines(spark, path)
        first = lines.where("line = 1").first()
    except Exception as e:  # noqa: BLE001 - any unreadable file is a finding
        report.errors.append(f"{kind}: can't be read: {type(e).__name__}")
        return None
    if first is None or not first.value.strip():
        report.errors.append(f"{kind}: empty file")
        return None
    if "\t" not in first.value and "," in first.value:
        report.errors.append(f"{kind}: header is comma-separated")
        return None
    if first.value.strip().lower() != HEADERS[kind]:
        report.errors.append(f"{kind}: header is {first.value!r}")
        return None
    rows = lines.where((F.col("line") > 1) & (F.trim("value") != ""))
    for r in rows.where(~F.contains("value", F.lit("\t"))).orderBy("line").limit(EXAMPLES).collect():
        report.errors.append(f"{kind}: line {r.line} has no tab")
    parts = F.split("value", "\t", 2)
    rows = rows.where(F.contains("value", F.lit("\t"))).select("line", F.get(parts, F.lit(0)).alias("s1_id"), F.filter(F.split(F.get(parts, F.lit(1)), ","), lambda x: x != "").alias("ids"))
    n, some = _examples(rows.groupBy("s1_id").count().where("count > 1"), "s1_id")
    if n:
        report.errors.append(f"{kind}: {n} repeated sources, such as {some}")
    n, some = _examples(rows.where(F.size("ids") != F.size(F.array_distinct("ids"))), "s1_id")
    if n:
        report.errors.append(f"{kind}: {n} sources repeat an id, such as {some}")
    each = rows.select("s1_id", F.explode("ids").alias("id"))
    for what, cond in (("S1 ids as targets", F.col("id").startswith("S1-")), ("ids without S2- or S3-", ~F.col("id").rlike("^S[123]-"))):
        n, some = _examples(each.where(cond), "id")
        if n:
            report.errors.append(f"{kind}: {n} {what}, such as {some}")
    return rows.groupBy("s1_id").agg(F.max_by("ids", "line").alias("ids"))


def validate(spark: SparkSession, matching: str, candidates: str | None, required: DataFrame, known: DataFrame | None = None) -> Report:
    """Check a match file, and a candidate file if there is one, against the required sources and known targets (entity_id)."""
    report = Report()
    found = {}
    for kind, path in (("matching", matching), ("candidates", candidates)):
        if path is None:
            report.warnings.append(f"{kind}: no file")
            continue
        rows = parsed(spark, path, kind, report)
        if rows is None:
            continue
        found[kind] = rows
        own = rows.select(F.col("s1_id").alias("entity_id"))
        for what, a, b in (("missing", required.select("entity_id"), own), ("not asked for", own, required.select("entity_id"))):
            n, some = _examples(a.join(b, "entity_id", "left_anti"), "entity_id")
            if n:
                report.errors.append(f"{kind}: {n} sources {what}, such as {some}")
        if known is not None:
            ids = rows.select(F.explode("ids").alias("entity_id")).where(F.col("entity_id").rlike("^S[23]-"))
            n, some = _examples(ids.join(known.select("entity_id"), "entity_id", "left_anti"), "entity_id")
            if n:
                report.errors.append(f"{kind}: {n} unknown ids, such as {some}")
    if known is None:
        report.warnings.append("ids were not checked")
    if len(found) == 2:
        pairs = {k: df.select("s1_id", F.explode("ids").alias("id")) for k, df in found.items()}
        n, some = _examples(pairs["matching"].join(pairs["candidates"], ["s1_id", "id"], "left_anti"), "s1_id")
        if n:
            report.warnings.append(f"{n} sources have matches that aren't candidates, such as {some}")
    return report
