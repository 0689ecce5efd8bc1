"""Removal of repeated substrings by longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes that covers it starts earlier in
the corpus as well, that is, if the longest previous factor of a position at
most ``length`` - 1 bytes before it is that long. Each window of that many
bytes belongs to the smallest hashed k-gram in it, so equal windows share a
key wherever they stand; the consecutive windows of one key are a run. Three
steps, each linear in the text:

1. Runs are read with a hash of their bytes. Runs that are equal as a whole
   are one factor: all but the earliest go at once, first within a task and
   then between tasks, so copies, however many, end here.
2. Of the runs that are left, those whose key has several different runs may
   share single windows. Only their bytes travel, dealt by key. There the
   windows are put in suffix order, with the lengths that neighbours have in
   common; the previous and the next smaller place in that order are the only
   ones whose common length can be a position's longest previous factor. Keys
   whose runs are many or long go on as 128-bit digests of single windows,
   dealt by the digest, so that no task depends on the size of one group.
3. Removed intervals are merged per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, fields, shuffle_parts, small_batches

LENGTH, GRAM = 100, 16
#: Bytes of one key's different runs that are looked at together; beyond, they go on as digests of single windows.
TOGETHER = 4_000_000
DIGEST = 16
#: Windows in one suffix order, as bytes (of one key twice as many, and beyond as digests); and bytes of text for each part that runs are dealt to.
COMPARED, PART = 200_000, 8_000_000
#: Runs gathered by a task before they are handed on.
GATHERED = 400_000
_B = 0x9E3779B97F4A7C15
_INVERSE = pow(_B, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_TABLE = np.random.default_rng(20240601).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_B, _INVERSE)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def runs_of(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...] | None:
    """Runs of windows of one key: (key, hash of the run's bytes, first window, windows, whether the gram stands there twice)."""
    n = len(data)
    if n < length:
        return None
    power, inverse = _grown(n + 1)
    a = np.frombuffer(data, np.uint8)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[a] * power[:n], out=sums[1:])
    grams = low = _mixed((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    width, step = length - gram + 1, 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    end = np.append(first[1:], len(low))
    whole = _mixed((sums[end + length - 1] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))
    # Where the first window has the gram, and where the last one has it: two places if the run may repeat itself.
    span = length - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    key = low[first]
    left = first + (view[first] == key[:, None]).argmax(1)
    right = end - 1 + span - 1 - (view[end - 1][:, ::-1] == key[:, None]).argmax(1)
    return key, whole, first, end - first, left != right


def _ids(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id (null as smallest), tie (tells apart different texts of one id) and data."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return fields(docs, id=doc_id, text=text).select(F.coalesce("id", F.lit(-(1 << 63)).cast("long")).alias("id"), F.xxhash64(data).alias("tie"), data.alias("data"))


def _spans_batch(ids, ties, starts, ends) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (ids, ties, starts, ends)], ["id", "tie", "from", "to"])


def _scan(rows: DataFrame, parts: int, length: int) -> DataFrame:
    """Spans removed within a task (id, tie, from, to; in any part), and per part of the keys a packed table of the first runs met."""
    kind = np.dtype([("key", "<u8"), ("whole", "<u8"), ("id", "<i8"), ("tie", "<i8"), ("at", "<i4"), ("n", "<i4"), ("twice", "<i1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            table = np.concatenate(held)
            held.clear()
            order = np.lexsort((table["at"], table["tie"], table["id"], table["whole"]))
            table = table[order]
            again = np.concatenate(([False], table["whole"][1:] == table["whole"][:-1]))
            # The same row twice is one document: its second reading is not a later copy.
            again[1:] &= ~((table["id"][1:] == table["id"][:-1]) & (table["tie"][1:] == table["tie"][:-1]) & (table["at"][1:] == table["at"][:-1]))
            gone = table[again]
            if len(gone):
                gone = gone[np.lexsort((gone["at"], gone["tie"], gone["id"]))]
                last = gone["at"] + gone["n"]
                new = np.concatenate(([True], (gone["id"][1:] != gone["id"][:-1]) | (gone["tie"][1:] != gone["tie"][:-1]) | (gone["at"][1:] > last[:-1])))
                k = np.flatnonzero(new)
                spans = [gone["id"][k], gone["tie"][k], gone["at"][k], np.maximum.reduceat(last, k) + length - 1]
                yield out(None, None, spans)
            left = table[~again]
            part = (left["key"] % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((left["at"], left["tie"], left["id"], part))
            left, part = left[order], part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            edges = np.concatenate(([0], cuts, [len(left)]))
            blobs = [b"".join(np.ascontiguousarray(left[name][i:j]).tobytes() for name in kind.names) for i, j in zip(edges[:-1], edges[1:], strict=True) if j > i]
            yield out([int(part[i]) for i in edges[:-1]] if len(left) else [], blobs, None)

        def out(part, blobs, spans) -> pa.RecordBatch:
            n = len(part) if spans is None else len(spans[0])
            columns = [pa.nulls(n, pa.int64())] * 4 if spans is None else [pa.array(np.asarray(x, np.int64)) for x in spans]
            more = [pa.array(np.asarray(spans[0]) % parts), pa.nulls(n, pa.binary())] if spans is not None else [pa.array(part, pa.int64()), pa.array(blobs, pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, *more], ["id", "tie", "from", "to", "part", "runs"])

        for batch in batches:
            for own, tie, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = runs_of(data.as_py(), length)
                if found is None:
                    continue
                table = np.empty(len(found[0]), kind)
                table["key"], table["whole"], table["at"], table["n"] = found[:4]
                table["twice"] = found[4]
                table["id"], table["tie"] = own, tie
                held.append(table)
                count += len(table)
                if count > GATHERED:
                    yield from flush()
                    count = 0
        yield from flush()

    return rows.mapInArrow(run, "id long, tie long, from long, to long, part long, runs binary")


def _settle(scanned: DataFrame, length: int) -> DataFrame:
    """The spans so far; by part of the keys those of runs met earlier in another task, and (with their key and the bytes of all its runs) the runs that need their bytes compared."""
    names = ("key", "whole", "id", "tie", "at", "n", "twice")
    kinds = ("<u8", "<u8", "<i8", "<i8", "<i4", "<i4", "<i1")

    def run(table: pa.Table) -> pa.Table:
        spans = [np.asarray(table.column(c).drop_null(), np.int64) for c in ("id", "tie", "from", "to")]
        columns: list[list[np.ndarray]] = [[np.zeros(0, kind)] for kind in kinds]
        for blob in table.column("runs").drop_null():
            raw = blob.as_py()
            n, at = len(raw) // 41, 0
            for k, kind in enumerate(kinds):
                columns[k].append(np.frombuffer(raw, kind, n, at))
                at += n * np.dtype(kind).itemsize
        key, whole, own, tie, at, n, twice = (np.concatenate(c) for c in columns)
        order = np.lexsort((at, tie, own, whole, key))
        key, whole, own, tie, at, n, twice = (x[order] for x in (key, whole, own, tie, at, n, twice))
        same_key = np.concatenate(([False], key[1:] == key[:-1]))[: len(key)]
        again = same_key & np.concatenate(([False], whole[1:] == whole[:-1]))[: len(key)]
        itself = again & np.concatenate(([False], (own[1:] == own[:-1]) & (tie[1:] == tie[:-1]) & (at[1:] == at[:-1])))[: len(key)]
        gone = again & ~itself
        new = ~again
        group = np.cumsum(~same_key) - 1
        different = np.bincount(group, weights=new, minlength=group[-1] + 1 if len(group) else 0).astype(np.int64)
        look = new & ((different[group] > 1) | (twice > 0)) if len(group) else new
        k = np.flatnonzero(gone | look)
        asks = look[k]
        start = at[k].astype(np.int64)
        both = [np.concatenate(x) for x in zip(spans, (own[k], tie[k], start, start + n[k] + length - 1), strict=True)]
        silent = np.concatenate((np.ones(len(spans[0]), bool), ~asks))
        pad = np.zeros(len(spans[0]), np.int64)
        size = np.bincount(group, weights=look * (n + length - 1.0), minlength=group[-1] + 1 if len(group) else 0).astype(np.int64)
        many = size[group[k]] if len(k) else np.zeros(0, np.int64)
        return pa.table(
            {
                **dict(zip(("id", "tie", "from", "to"), both, strict=True)),
                "key": pa.array(np.concatenate((pad, key[k].astype(np.int64))), mask=silent),
                "many": pa.array(np.concatenate((pad, many)), mask=silent),
            }
        )

    return scanned.groupBy("part").applyInArrow(run, "id long, tie long, from long, to long, key long, many long")


def _contexts(rows: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The bytes of the runs to be compared: key, id, tie, from, data; of keys with very many, the digest of each window."""
    wanted = asked.groupBy("id", "tie").agg(F.collect_list(F.struct("from", "to", "key", "many")).alias("runs"))
    met = rows.dropDuplicates(["id", "tie"]).join(wanted, ["id", "tie"]).select("id", "tie", "data", F.col("runs.from"), F.col("runs.to"), F.col("runs.key"), F.col("runs.many"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row in range(batch.num_rows):
                own, tie, data = (batch.column(k)[row].as_py() for k in range(3))
                for a, b, key, many in zip(*(batch.column(k)[row].as_py() for k in range(3, 7)), strict=True):
                    if many <= TOGETHER:
                        pieces = [(key, a, data[a:b])]
                    else:
                        digests = [hashlib.blake2b(data[s : s + length], digest_size=DIGEST).digest() for s in range(a, b - length + 1)]
                        pieces = [(int.from_bytes(d[:8], "little", signed=True), a + k, d) for k, d in enumerate(digests)]
                    for k, s, piece in pieces:
                        for column, value in zip(out, (k, own, tie, s, piece), strict=True):
                            column.append(value)
                if sum(map(len, out[4])) > 8_000_000 or len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["key", "id", "tie", "from", "data"])
                    out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["key", "id", "tie", "from", "data"])

    return met.mapInArrow(run, "key long, id long, tie long, from long, data binary")


def longest_previous_factors(windows: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each row of ``windows`` (bytes), how many of its first bytes also start at a smaller place.

    Rows are put in suffix order. Of the rows at smaller places, the nearest
    one on either side has most in common: the least common length between
    neighbours up to there.
    """
    n, length = windows.shape
    suffix = np.argsort(np.ascontiguousarray(windows).view(f"S{length}").ravel(), kind="stable")
    ordered, at = windows[suffix], place[suffix]
    apart = ordered[1:] != ordered[:-1]
    common = np.where(apart.any(1), apart.argmax(1), length)
    best = np.zeros(n, np.int64)
    for sign in (-1, 1):
        # Where the search of each row stands, and the least common length on the way; -1: past the end.
        near = np.arange(n) + sign
        near[(near < 0) | (near >= n)] = -1
        least = np.concatenate(([0], common)) if sign < 0 else np.append(common, 0)
        going = np.flatnonzero(near >= 0)
        while len(going):
            # A row passed by lies at a larger place, so what it has passed lies at larger ones too.
            going = going[at[near[going]] >= at[going]]
            least[going] = np.minimum(least[going], least[near[going]])
            near[going] = near[near[going]]
            least[going[near[going] < 0]] = 0
            going = going[(near[going] >= 0) & (least[going] > best[going])]
        best = np.maximum(best, least)
    out = np.empty(n, np.int64)
    out[suffix] = best
    return out


def later_windows(texts: list[bytes], ids: np.ndarray, ties: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows) of the windows whose longest previous factor, by (id, tie, place), reaches length."""
    sizes = np.array([len(t) for t in texts], np.int64)
    windows = sizes - length + 1
    text = np.repeat(np.arange(len(texts)), windows)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    # Runs of one document have no window in common, so windows follow their runs; a row read twice has one place.
    order = np.lexsort((starts, ties, ids))
    new = np.concatenate(([True], (ids[order][1:] != ids[order][:-1]) | (ties[order][1:] != ties[order][:-1]) | (starts[order][1:] != starts[order][:-1])))
    rank = np.empty(len(texts), np.int64)
    rank[order] = np.cumsum(new)
    if len(text) > 2 * COMPARED and length > DIGEST:
        # So many windows are compared by their digests, which take less room.
        digests = b"".join(hashlib.blake2b(t[s : s + length], digest_size=DIGEST).digest() for t in texts for s in range(len(t) - length + 1))
        strings = np.frombuffer(digests, np.uint8).reshape(-1, DIGEST)
    else:
        strings = np.lib.stride_tricks.sliding_window_view(flat, length)[np.repeat(np.cumsum(sizes) - sizes, windows) + inner]
    factors = longest_previous_factors(strings, (rank[text] << 32) + inner)
    gone = np.flatnonzero(factors >= strings.shape[1])
    t, w = text[gone], inner[gone]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (w[1:] != w[:-1] + 1))) if len(t) else np.zeros(0, bool)
    k = np.flatnonzero(new)
    return t[k], w[k], np.diff(np.append(k, len(t)))


def _compare(contexts: DataFrame, parts: int, length: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        ids, ties, starts, key = (table.column(c).to_numpy() for c in ("id", "tie", "from", "key"))
        data = table.column("data").to_pylist()
        sizes = np.array([len(x) for x in data], np.int64)
        found: list[list[np.ndarray]] = [[], [], [], []]
        # A digest stands for one window; runs are longer.
        for own_length, rows in ((DIGEST, np.flatnonzero(sizes == DIGEST)), (length, np.flatnonzero(sizes != DIGEST))):
            rows = rows[np.argsort(key[rows], kind="stable")]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(key[rows])) + 1, [len(rows)]))
            windows = np.concatenate(([0], np.cumsum(sizes[rows] - own_length + 1)))
            # Keys are compared together, so many at a time that the windows fit; a window's bytes settle what is equal.
            first = 0
            for e in range(1, len(edges)):
                if windows[edges[e]] - windows[edges[first]] >= COMPARED or e == len(edges) - 1:
                    some = rows[edges[first] : edges[e]]
                    first = e
                    if not len(some):
                        continue
                    text, window, n = later_windows([data[r] for r in some], ids[some], ties[some], starts[some], own_length)
                    own = some[text]
                    for column, value in zip(found, (ids[own], ties[own], starts[own] + window, starts[own] + window + n + length - 1), strict=True):
                        column.append(value)
        return pa.table({name: np.concatenate(c) if c else np.zeros(0, np.int64) for name, c in zip(("id", "tie", "from", "to"), found, strict=True)})

    dealt = contexts.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(run, "id long, tie long, from long, to long")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, removed (merged [from, to) byte intervals), kept (the bytes that stay).

    Earlier means a smaller id, or the same document and an earlier start.
    Null ids come first. A null text is empty. Texts of fewer than ``length``
    bytes keep all. Different texts of one id are different documents, ordered
    by a hash; rows that repeat id and text are one document, and get the same
    result each. A text is held whole, with some 60 bytes of work space for each
    of its bytes. An empty table gives no rows. Other columns are ignored. Runs
    count as equal as a whole when their key and a second 64-bit hash are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = _ids(docs, doc_id, text)
    read = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = max(4 * shuffle_parts(spark), -(-read // PART))
    settled = cut(_settle(_scan(rows, parts, length), length))
    asked = settled.where("key IS NOT NULL")
    contexts = cut(_contexts(rows, asked, length))
    compared = _compare(contexts, parts, length)
    names = ["id", "tie", "from", "to"]
    spans = settled.where("key IS NULL").select(*names).union(compared.select(*names))
    spans = spans.groupBy("id", "tie").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    met = rows.join(spans, ["id", "tie"], "left").select("id", "data", F.col("spans.from").alias("from"), F.col("spans.to").alias("to"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row in range(batch.num_rows):
                data = batch.column(1)[row].as_py()
                merged: list[list[int]] = []
                starts, ends = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
                for a, b in sorted(zip(starts or [], ends or [], strict=True)):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                for column, value in zip(out, (batch.column(0)[row].as_py(), len(data), merged, b"".join(kept)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([[{"from": a, "to": b} for a, b in m] for m in out[2]], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(out[3], pa.binary())],
                ["id", "n_bytes", "removed", "kept"],
            )

    done = met.mapInArrow(finish, "id long, n_bytes long, removed array<struct<from: long, to: long>>, kept binary")
    return done.select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id"), "n_bytes", "removed", "kept")


def op3_longest_previous_factor(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x["to"] - x["from"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
