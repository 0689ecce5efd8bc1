"""Exact top-k search by a Voronoi kNN join.

Vectors become integers; the score is the inner product. Pivots, a bounded
sample, cut the space into cells. Each cell has a summary: its radius and the
distances of the k nearest to its pivot. From the summaries alone each query
cell gets a score that its k best must reach, and an upper bound for every
data cell; only data cells that can reach it get its queries. Data cells are
cut into blocks of bounded size, query cells too, and dealt by cell and block,
so one cell that holds a third of all rows is many tasks; each pair of blocks
is solved by one matrix product, in double precision where that is exact and
in 64-bit integers elsewhere, and the per-block winners are merged.

Where the bounds prune nothing, as for vectors without clusters, the work is
that of every query against all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import cut, fields

#: Rows per data block and per query block, and the most pivots.
DATA_BLOCK, QUERY_BLOCK, PIVOTS = 2048, 256, 256
VECTORS_A_PIVOT = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _assign(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds cell (nearest pivot), dist and norm."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots.astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        square = (p * p).sum(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1)).astype(float)
            own = (x * x).sum(1)
            cell = (square[None, :] - 2 * (x @ p.T)).argmin(1)
            dist = np.sqrt(np.maximum(((x - p[cell]) ** 2).sum(1), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(dist), pa.array(np.sqrt(own))], ["vec_id", "v", "cell", "dist", "norm"])

    return vectors.mapInArrow(run, "vec_id long, v array<long>, cell int, dist double, norm double")


def _blocks(rows: DataFrame, size: int, salts: DataFrame, name: str) -> DataFrame:
    """Rows of one cell in blocks of about ``size``: cell, block, ids and vectors as arrays."""
    dealt = rows.join(F.broadcast(salts), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.greatest(F.lit(1), F.ceil(F.col(name) / size))))
    return dealt.groupBy("cell", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows")).select("cell", "block", F.col("rows.vec_id").alias("ids"), F.flatten("rows.v").alias("flat"))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, as int64."""
    largest = float(np.abs(q).astype(float).sum(1).max()) * float(np.abs(x).astype(float).max())
    if largest < 2.0**52:
        return np.rint(q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q @ x.T


def _needed(stats: dict[int, tuple], groups: dict[int, tuple], pivots: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(query cell, data cell) pairs that can hold one of the k best of a query."""
    p = pivots.astype(float)
    norms = np.sqrt((p * p).sum(1))
    cells = np.array(sorted(stats), int)
    radius = np.array([stats[c][0] for c in cells])
    near = [(c, d) for c in cells for d in stats[c][1]]
    near_cell, near_dist = np.array([c for c, _ in near], int), np.array([d for _, d in near])
    pairs = []
    for g, reach in groups.items():
        # q = p[g] + e with |e| <= reach; x = p[c] + f with |f| = dist.
        dots = p @ p[g]
        low = dots[near_cell] - norms[g] * near_dist - reach * (norms[near_cell] + near_dist)
        # One more than k: those counted have different ids, so the query itself is one of them at most.
        floor = np.partition(low, -(k + 1))[-(k + 1)] if len(low) > k else -np.inf
        high = dots[cells] + norms[g] * radius + reach * (norms[cells] + radius)
        pairs += [(int(g), int(c)) for c in cells[high >= floor - 1e-6 * (1 + abs(floor))]]
    return pairs


def top_k(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """The k best by inner product for each query: query_id, rank, vec_id, score.

    Components are floor(scale * x). Queries are rows whose id is divisible by
    ``every``; candidates all rows with another id (repeated rows of a query's
    own id are its own). Ties go to the smaller id, then any. Rows with a null
    id, a null or empty vector, null or non-finite components, or another
    length than most take no part. An empty table gives no rows. Other columns
    are ignored. Repeated query rows are one query, of one of their vectors.
    Scores must fit 64-bit integers.
    """
    spark = vectors.sparkSession
    v = F.transform("e", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    odd = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = fields(vectors, vec_id=vec_id, e=embedding).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).where((F.size("e") > 0) & ~odd).select("vec_id", v.alias("v"))
    result = "query_id long, rank int, vec_id long, score long"
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("v") == lengths.d)
    want = int(min(PIVOTS, max(4, lengths["count"] // VECTORS_A_PIVOT)))
    pivots = np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(want).collect()], float)
    placed = cut(_assign(rows, pivots))
    is_query = F.col("vec_id") % every == 0
    queries = placed.where(is_query).dropDuplicates(["vec_id"])
    summary = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"))
    once = placed.groupBy("vec_id").agg(F.min(F.struct("dist", "cell")).alias("x")).select("x.dist", "x.cell")
    nearest = once.select("cell", "dist", F.row_number().over(W.partitionBy("cell").orderBy("dist")).alias("r")).where(F.col("r") <= k + 1).groupBy("cell").agg(F.collect_list("dist").alias("near"))
    asked = queries.groupBy("cell").agg(F.count(F.lit(1)).alias("nq"), F.max("dist").alias("reach"))
    # At most PIVOTS rows each.
    stats = {r.cell: (r.radius, r.near or [], r.n) for r in summary.join(nearest, "cell", "left").collect()}
    groups = {r.cell: (r.reach, r.nq) for r in asked.collect()}
    pairs = _needed({c: s[:2] for c, s in stats.items()}, {g: r for g, (r, _) in groups.items()}, pivots, k)
    if not pairs:
        return spark.createDataFrame([], result)
    sizes = spark.createDataFrame([(c, s[2]) for c, s in stats.items()], "cell int, n long")
    query_sizes = spark.createDataFrame([(g, n) for g, (_, n) in groups.items()], "cell int, nq long")
    data = _blocks(placed.select("vec_id", "v", "cell"), DATA_BLOCK, sizes, "n")
    asking = _blocks(queries.select("vec_id", "v", "cell"), QUERY_BLOCK, query_sizes, "nq")
    need = spark.createDataFrame(pairs, "cell int, target int")
    asking = asking.join(F.broadcast(need), "cell").select(F.col("target").alias("cell"), F.col("ids").alias("qids"), F.col("flat").alias("qflat"))
    last = F.greatest(F.lit(1), F.ceil(F.col("n") / DATA_BLOCK)) - 1
    asking = asking.join(F.broadcast(sizes), "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).drop("n")
    met = data.join(asking, ["cell", "block"]).select("ids", "flat", "qids", "qflat")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for row in range(batch.num_rows):
                ids, flat, qids, qflat = (c[row].values.to_numpy() for c in batch.columns)
                scores = _scores(qflat.reshape(len(qids), -1), flat.reshape(len(ids), -1))
                for i in range(len(qids)):
                    others = np.flatnonzero(ids != qids[i])
                    s = scores[i][others]
                    keep = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                    keep = keep[np.lexsort((ids[others[keep]], -s[keep]))][:k]
                    for column, value in zip(out, (np.full(len(keep), qids[i]), ids[others[keep]], s[keep]), strict=True):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])

    best = met.mapInArrow(solve, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_voronoi_knn(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v::DOUBLE[], x.v::DOUBLE[])::BIGINT AS score
  FROM e q JOIN e x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
