"""Mixing sources to target weights by weighted fair queueing.

Every document of a source stands in a queue shuffled by a hash of its id. Its
virtual finish time is the number of words of its source up to and including
it, divided by the source's target. All queues, each repeated ``cap`` times,
are merged by finish time and cut where the total budget is spent, so each
source reaches its target at the same virtual time, 1.

Prefix sums are two-level: sums of hash ranges within a source, then a running
sum within one range, so that a source holding a third of all rows is spread
over thousands of tasks. The merged order is cut by a histogram of finish
times first; only the bucket that holds the cut is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import WORD, cut, fields

#: Finish-time buckets per unit of virtual time; the cut is near 1, and all later than LAST share a bucket.
BUCKETS, LAST = 4096, 4


def _plan(docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple[int, ...], share: float, cap: int) -> tuple[DataFrame, tuple[float, int]]:
    """All documents with their place in the queue (key, size, doc_id), their source's ord and target, and a finish time for each repetition; and the last (finish time, ord) that the budget pays."""
    named = fields(docs, doc_id=doc_id, text=text, source=source)
    rows = cut(named.select("doc_id", F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("nosrc"), *_place(F.col("doc_id"), F.col("text"))))
    rows = rows.withColumn("range", F.substring("key", 1, 3))
    ranges = rows.groupBy("nosrc", "src", "range").agg(F.sum("size").alias("words"))
    sources = ranges.groupBy("nosrc", "src").agg(F.sum("words").alias("source_size"))
    # Sources are few; the windows over them read one row each.
    everything = W.partitionBy(F.lit(0))
    sources = sources.withColumn("ord", F.row_number().over(everything.orderBy("nosrc", "src")))
    weight = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), ((F.col("ord") - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("most", F.col("source_size").cast("double") * cap).withColumn("fill", F.col("most") / F.col("weight"))
    before = everything.orderBy("fill", "ord").rowsBetween(W.unboundedPreceding, -1)
    sources = sources.withColumn(
        "level",
        (F.sum("source_size").over(everything).cast("double") * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    level = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everything)
    sources = sources.withColumn("target", F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most")))).select("nosrc", "src", "ord", "source_size", "target")

    offsets = ranges.withColumn("offset", F.sum("words").over(W.partitionBy("nosrc", "src").orderBy("range")) - F.col("words"))
    offsets = offsets.select("nosrc", "src", "range", "offset").join(sources, ["nosrc", "src"])
    within = W.partitionBy("nosrc", "src", "range").orderBy("key", "size", "doc_id")
    queued = rows.withColumn("run", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0))).join(offsets, ["nosrc", "src", "range"])
    finish = [F.when((F.col("size") > 0) & (F.col("target") > 0), (F.col("offset") + F.col("run") + F.col("source_size") * e).cast("double") / F.col("target")) for e in range(cap)]
    queued = cut(queued.select("doc_id", F.when(~F.col("nosrc"), F.col("src")).alias("source"), "key", "size", "source_size", "target", "ord", *[f.alias(f"finish{e}") for e, f in enumerate(finish)]))

    copies = queued.select(F.explode(F.array(*[F.col(f"finish{e}") for e in range(cap)])).alias("finish"), "ord", "size").where("finish IS NOT NULL")
    copies = copies.withColumn("bucket", F.least(F.floor(F.col("finish") * BUCKETS), F.lit(LAST * BUCKETS)).cast("int"))
    budget = F.floor(F.col("budget")).cast("long")
    total = queued.groupBy("ord").agg(F.first("target").alias("t")).agg(F.sum("t").alias("budget"))
    spent = copies.groupBy("bucket").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(everything.orderBy("bucket")))
    top = total.select(budget.alias("budget")).first()
    limit = int(top.budget or 0) if top else 0
    cutting = spent.where(F.col("upto") > limit).orderBy("bucket").select("bucket", (F.col("upto") - F.col("words")).alias("before")).first()
    if cutting is None:
        return queued, (float("inf"), 0)
    edge = copies.where(F.col("bucket") == cutting.bucket).withColumn("upto", F.sum("size").over(W.partitionBy("bucket").orderBy("finish", "ord")) + F.lit(cutting.before))
    last = edge.where(F.col("upto") <= limit).orderBy(F.desc("finish"), F.desc("ord")).select("finish", "ord").first()
    return queued, (float(last.finish), int(last.ord)) if last else (cutting.bucket / BUCKETS, 0)


def _place(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """size and key, by which a source's queue is ordered."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return size.alias("size"), F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")).alias("key")


def _paid(finish: str, until: tuple[float, int]) -> Column:
    f = F.col(finish)
    return (f < F.lit(until[0])) | ((f == F.lit(until[0])) & (F.col("ord") <= until[1]))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, epochs.

    Sources, by code point and null last, take ``weights`` in turn and share
    ``share`` times all words; a target stops at ``cap`` times its source's
    size, and the excess goes to the others by weight. ``taken`` is the number
    of words the mix takes of a document, ``epochs`` how often it takes it.

    Null texts and ids, empty texts: size 0, taken 0. A null source is a source
    of its own. Repeated rows queue separately. An empty table gives no rows.
    Other columns are ignored.
    """
    queued, until = _plan(docs, doc_id, text, source, weights, share, cap)
    epochs = sum((F.when(_paid(f"finish{e}", until), 1).otherwise(0) for e in range(cap)), F.lit(0))
    return queued.withColumn("epochs", epochs).select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size")).cast("long").alias("taken"), "epochs")


def repeat_by_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it; documents without words, which no budget buys or excludes, stay once.

    The mix takes a source's queue up to some place, once for each repetition,
    so these few places decide on every row where it is read, and no text is
    moved. Rows of one place (equal ids and sizes) are taken together. Nulls
    and empty tables as in mix_sources.
    """
    queued, until = _plan(docs, doc_id, text, source, weights, share, cap)
    place = F.struct("key", "size", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    last = cut(queued.groupBy("source").agg(*[F.max(F.when(_paid(f"finish{e}", until), place)).alias(f"last{e}") for e in range(cap)]).withColumnRenamed("source", "_tessera_source"))
    size, key = _place(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    own = F.struct(key, size, F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"))
    rows = docs.withColumn("_tessera_place", own).join(last, F.col(f"`{source}`").eqNullSafe(F.col("_tessera_source")))
    times = sum((F.when(F.col("_tessera_place") <= F.col(f"last{e}"), 1).otherwise(0) for e in range(cap)), F.lit(0))
    times = F.when(F.col("_tessera_place.size") == 0, 1).otherwise(times)
    rows = rows.withColumn("_tessera_times", times).where("_tessera_times > 0")
    return rows.withColumn("_tessera_copy", F.explode(F.sequence(F.lit(1), F.col("_tessera_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_weighted_fair_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM d GROUP BY source
), w AS (
  SELECT *, CASE (ord - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM s
), f AS (SELECT *, most / weight AS fill FROM w
), l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM f WINDOW b AS (ORDER BY fill, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, ord, least(most, coalesce(max(CASE WHEN level <= fill THEN level END) OVER () * weight, most)) AS target FROM l
), q AS (
  SELECT d.doc_id, d.size, d.key, t.*, sum(d.size) OVER (PARTITION BY t.ord ORDER BY d.key, d.size, d.doc_id ROWS UNBOUNDED PRECEDING) AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT q.*, e, (run + source_size * e)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) v(e) WHERE size > 0 AND target > 0
), m AS (SELECT *, sum(size) OVER (ORDER BY finish, ord ROWS UNBOUNDED PRECEDING) AS upto FROM c
), k AS (SELECT doc_id, key, ord, sum(size)::BIGINT AS taken FROM m WHERE upto <= (SELECT floor(sum(target)) FROM t) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.ord = k.ord
"""
