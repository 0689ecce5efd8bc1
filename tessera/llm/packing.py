"""Best-fit packing by non-negative least squares over length patterns.

Documents become pieces of at most ``capacity`` tokens. The histogram of piece
lengths (at most ``capacity`` numbers, whatever the corpus) goes to the
driver, which enumerates the patterns of a few lengths that fill a sequence,
fits their repeat counts to the histogram by non-negative least squares,
rounds them, and packs what is left best-fit decreasing. The resulting plan,
in runs of equal sequences, is bounded by the number of lengths as well. On
the executors a piece's rank among those of its length then gives its place.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import begin, cut, fields, small_batches

CAPACITY, SEPARATOR = 2048, 0
#: Shares of one length, for ranks: a length that a third of all pieces have is ranked in so many parts.
SALTS = 512
#: Words kept in each of a worker's two caches of encodings.
CACHE = 600_000
#: Characters of the longest word kept, which bounds the caches in bytes too.
CACHED_LENGTH = 64
MARKS = ".,;:!?$%"
_encoders: dict[str, WordEncoder] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes texts by a tokenizer that drops white space and never joins across it, a word at a time, with a cache."""

    def __init__(self, path: str):
        # A task has one core: threads of the tokenizer's own would only contend for it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Once the cache is full it becomes the older one, which is only asked for words that the new one lacks.
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        #: Whether a character's normal form ends in a letter.
        self.letters: dict[str, bool] = {}

    def _is_letter(self, c: str) -> bool:
        normal = self.tokenizer.normalizer.normalize_str(c) if self.tokenizer.normalizer else c
        self.letters[c] = c.isalpha() and normal[-1:].isalpha()
        return self.letters[c]

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        words = text.replace("\n", " ").split(" ")
        ids = [*map(self.cache.get, words)]
        try:
            return b"".join(ids)
        except TypeError:
            pass
        missing = [k for k, known in enumerate(ids) if known is None]
        fresh = dict.fromkeys(words[k] for k in missing)
        # A letter and a mark after it are never one token's, so a word's end marks are encoded apart.
        split: dict[str, tuple[str, str]] = {}
        letters = self.letters
        for w in fresh:
            if (known := self.older.get(w)) is not None:
                fresh[w] = known
            else:
                core = w.rstrip(MARKS)
                if not core or (letters[core[-1]] if core[-1] in letters else self._is_letter(core[-1])):
                    split[w] = (core, w[len(core) :])
                else:
                    split[w] = (w, "")
        own = {x: self.cache.get(x) or self.older.get(x) for pair in split.values() for x in pair}
        new = [x for x, known in own.items() if x and known is None]
        own.update(zip(new, [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)], strict=True))
        own[""] = b""
        fresh.update((w, own[core] + own[tail]) for w, (core, tail) in split.items())
        for k in missing:
            ids[k] = fresh[words[k]]
        if len(self.cache) + 2 * len(fresh) > CACHE:
            self.cache, self.older = {"": b""}, self.cache
        if max(map(len, fresh)) > CACHED_LENGTH:
            own, fresh = ({w: x for w, x in known.items() if len(w) <= CACHED_LENGTH} for known in (own, fresh))
        self.cache.update(own)
        self.cache.update(fresh)
        return b"".join(ids)


def cut_into_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (bytes)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing", _encoders.clear)
        encoder = WordEncoder.of(path)
        end = np.array([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    for column, value in zip(out, (doc_id, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)][: 6 if keep_ids else 5]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.mapInArrow(pieces, schema)


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All sorted triples of lengths (0: none) of one to three documents that fill a sequence; at most capacity ** 2 / 12 or so."""
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    have[0] = True
    lengths = np.flatnonzero(have)
    found = []
    for a in lengths[lengths <= capacity // 3]:
        b = lengths[(lengths >= a) & (lengths <= (capacity - a) // 2)]
        b = b[have[capacity - a - b]]
        found.append(np.stack([np.full(len(b), a), b, capacity - a - b], 1))
    return np.concatenate(found)


def fit_counts(histogram: np.ndarray, triples: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram| by multiplicative updates; A has one column per pattern."""
    if not len(triples):
        return np.zeros(0)
    n = len(histogram)
    used = (triples > 0).sum(1)
    h = histogram.astype(float).copy()
    h[0] = 0
    want = h[triples].sum(1)
    x = want / np.maximum(used, 1) / np.maximum(np.bincount(triples.ravel(), minlength=n)[triples].min(1), 1)
    for _ in range(rounds):
        made = np.zeros(n)
        for k in range(triples.shape[1]):
            made += np.bincount(triples[:, k], weights=x, minlength=n)
        made[0] = 0
        x *= want / np.maximum(made[triples].sum(1), 1e-9)
    return x


def plan_sequences(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) for all pieces of the histogram (index: length)."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    triples = patterns(np.flatnonzero(left[1:]) + 1, capacity)
    fitted = fit_counts(left, triples)
    for k in np.argsort(-fitted, kind="stable"):
        repeats = int(fitted[k] + 0.5)
        if repeats < 1:
            break
        lengths = [int(v) for v in triples[k] if v]
        need = {v: lengths.count(v) for v in lengths}
        repeats = min(repeats, *(int(left[v]) // c for v, c in need.items()))
        if repeats > 0:
            for v, c in need.items():
                left[v] -= repeats * c
            plan.append((tuple(sorted(lengths, reverse=True)), repeats))
    # What is left: best fit, longest first; open[r] holds (lengths, repeats) with r tokens free.
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        n = int(left[length])
        room = length
        while n and room <= capacity:
            if not open_[room]:
                room += 1
                continue
            lengths, repeats = open_[room].pop()
            put = min(n, repeats)
            if repeats > put:
                open_[room].append((lengths, repeats - put))
            open_[room - length].append((lengths + (length,), put))
            n -= put
        if n:
            per = capacity // length
            if n >= per:
                open_[capacity - per * length].append(((length,) * per, n // per))
            if n % per:
                open_[capacity - (n % per) * length].append(((length,) * (n % per), 1))
    return plan + [x for rows in open_ for x in rows]


def _slots(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Runs of ranks, in order of length and first rank: where each starts, its first sequence and its offset there."""
    at, first = np.zeros(capacity + 1, np.int64), 0
    rows = []
    for lengths, repeats in plan:
        offset = 0
        for v in lengths:
            rows.append((v, at[v], first, offset))
            at[v] += repeats
            offset += v
        first += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, bytes, if asked for).

    Each document is its token ids and a separator, id 0. Only documents longer
    than ``capacity`` are cut. Null and empty texts are one separator. Null and
    repeated ids and repeated rows are packed like any other. An empty table
    gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    pieces = cut(cut_into_pieces(fields(docs, doc_id=doc_id, text=text), tokenizer or tokenizer_path(), capacity, keep_ids))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    shares = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    offsets = shares.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in shares.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row.length] = row.n
    slots = _slots(plan_sequences(histogram, capacity), capacity)
    bounds = docs.sparkSession.sparkContext.broadcast(slots | {"from": np.searchsorted(slots["length"], np.arange(capacity + 2))})
    within = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("row", F.row_number().over(within)).join(offsets, ["length", "salt"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    ranked = ranked.select(*names, (F.col("before") + F.col("row") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = bounds.value
        # One key for both: lengths are at most capacity, ranks far below 2 ** 48.
        keys = (plan["length"].astype(np.int64) << 48) + plan["rank"]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(names.index("length")).to_numpy(), batch.column(len(names)).to_numpy())
            k = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            sequence = plan["sequence"][k] + rank - plan["rank"][k]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(plan["offset"][k])], [*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * keep_ids + "sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def op1_pattern_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


__all__ = ["WordEncoder", "fit_counts", "op1_pattern_packing", "pack_documents", "patterns", "plan_sequences"]
