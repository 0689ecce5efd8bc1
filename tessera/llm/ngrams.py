"""N-gram Jaccard join by vertical partitioning.

Documents become sets of word n-grams, and equal sets one set. All n-grams
have one global order: by hash, but the common ones last, the most common at
the very end. Two similar sets share one of their first few n-grams in that
order (their prefixes). The order is cut into fragments; a candidate pair's
overlap is counted in each fragment separately and summed per pair, and the
sum decides exactly.

Candidates grow in proportion to the input, also where thousands of texts
differ a little from one another:

* Sets that share a prefix n-gram with at most TOGETHER others are compared
  with these, as far as sizes and places in the prefixes allow a link.
* A more common prefix n-gram is cut by size classes first (a set meets its
  own class and the next). Where a class still holds many sets, all are
  compared with one centre C, the member that meets most. With dA and dB the
  numbers of n-grams in which A and B differ from C, A and B differ in
  dA + dB - 2 |common differences| n-grams. Either dA + dB is within what a
  link allows, and then both link with C; or A and B share differences from
  C, and then one of the first few, rarest of them: the prefix of the smaller
  difference holds half of what a link allows, that of the larger one all of
  it. Differences shared by two components yield the remaining candidates.

No link between components is lost, so the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import UPPER, begin, cut, drop, fields, small_batches
from tessera.llm.components import connected_components

#: Most common n-grams, which come last in the order (a bound on what is broadcast; any choice gives right results), and n-grams counted at a time.
COMMON, COUNTED, LEAST_COUNT = 400_000, 4_000_000, 3
#: Sets of one prefix n-gram that are compared with each other; more go through a centre.
TOGETHER = 16
#: Partners of one set that meet in a task.
PARTNERS = 256
#: Words and sets that a worker remembers.
CACHE = 300_000
#: Fragments of the order: the hashes' first bits, and one for the common n-grams.
FRAGMENTS = 5
#: Bits, as a power of two, of the bitmap of ids whose texts are read again: 8 MB.
MARKS = 26
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_words: dict[bytes, int] = {}


def ngram_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 62-bit hashes of the word n-grams of a text; with fewer words, of all of them; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    if len(_words) > CACHE:
        _words.clear()
    try:
        ids = np.array([_words[w] for w in words], np.uint64)
    except KeyError:
        for w in words:
            if w not in _words:
                _words[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.array([_words[w] for w in words], np.uint64)
    k = min(n, len(ids))
    h = np.full(len(ids) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - k + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return np.unique((h >> np.uint64(2)).astype(np.int64))


def _set_id(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _ordered(grams: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Positions in the global order, sorted: the hash itself, or past all hashes for a common n-gram (common is sorted)."""
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        hot = common[at] == grams
        grams = np.where(hot, (1 << 62) + rank[at], grams)
        grams.sort()
    return grams


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents (id, size, set) and rows of n-grams that are common in a part of the table (gram, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngrams", _words.clear)
        kept: list[np.ndarray] = []

        def counted() -> Iterator[pa.RecordBatch]:
            if kept:
                grams, counts = np.unique(np.concatenate(kept), return_counts=True)
                grams, counts = grams[counts >= LEAST_COUNT], counts[counts >= LEAST_COUNT]
                if len(grams) > COMMON:
                    top = np.argpartition(-counts, COMMON)[:COMMON]
                    grams, counts = grams[top], counts[top]
                none = pa.nulls(len(grams), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array(grams), pa.array(counts)], names)
                kept.clear()

        held = 0
        for batch in batches:
            sizes, sets = [], []
            for text in batch.column(1):
                grams = ngram_hashes(text.as_py(), n)
                sizes.append(len(grams))
                sets.append(_set_id(grams) if len(grams) else None)
                kept.append(grams)
                held += len(grams)
                if held > COUNTED:
                    yield from counted()
                    held = 0
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.int64()), none, none], names)
        yield from counted()

    names = ["id", "size", "set", "gram", "count"]
    return docs.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _prefixes(docs: DataFrame, n: int, common, least: int, of: int) -> DataFrame:
    """set, size, prefix: one row for each set that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngrams", _words.clear)
        grams_, rank = common.value
        seen: set[int] = set()
        for batch in batches:
            out: list[list] = [[], [], []]
            for text in batch.column(1):
                grams = ngram_hashes(text.as_py(), n)
                if not len(grams) or (own := _set_id(grams)) in seen:
                    continue
                if len(seen) < CACHE:
                    seen.add(own)
                size = len(grams)
                for column, value in zip(out, (own, size, _ordered(grams, grams_, rank)[: size - -(-least * size // of) + 1]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["set", "size", "prefix"])

    return docs.mapInArrow(run, "set long, size long, prefix array<long>")


def _marked(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, of 2 ** MARKS bits whatever their number."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << MARKS)) + 1
    rows = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(1 << (MARKS - 3), np.uint8)
    # At most 2 ** MARKS / 32,768 rows of 4 KB.
    for r in rows.toLocalIterator():
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _segments(texts: DataFrame, wanted: DataFrame, sets: DataFrame, n: int, common) -> DataFrame:
    """set, size, fragment, grams: the part of each wanted set, empty or not, that lies in each fragment of the order.

    Texts stay where they are read: those whose id is marked make their
    segments, and only segments travel. A text may have many copies, of which
    each task hands on one. A mark may be another id's; its set is not asked
    for later.
    """
    marks = texts.sparkSession.sparkContext.broadcast(_marked(wanted.join(sets, "set").select(F.col("first").alias("id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("ngrams", _words.clear)
        grams_, rank = common.value
        edges = np.arange(1, FRAGMENTS) << 60
        seen: set[int] = set()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            place = batch.column(1).to_numpy()
            for k in np.flatnonzero(marks.value[place >> 3] >> (place & 7) & 1):
                grams = ngram_hashes(batch.column(0)[k].as_py(), n)
                if not len(grams) or (own := _set_id(grams)) in seen:
                    continue
                if len(seen) < CACHE:
                    seen.add(own)
                order = _ordered(grams, grams_, rank)
                for f, part in enumerate(np.split(order, np.searchsorted(order, edges))):
                    for column, value in zip(out, (own, len(order), f, part), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int64()))], ["set", "size", "fragment", "grams"])

    rows = texts.select("text", F.pmod(F.xxhash64("id"), F.lit(1 << MARKS)).alias("place"))
    made = rows.mapInArrow(run, "set long, size long, fragment int, grams array<long>")
    return made.groupBy("set", "fragment").agg(F.first("size").alias("size"), F.first("grams").alias("grams"))


def _similar_sizes(least: int, of: int) -> Column:
    return (of * F.col("na") >= least * F.col("nb")) & (of * F.col("nb") >= least * F.col("na"))


def _most_common(size_a: str, size_b: str) -> Column:
    """The most elements that two ordered sets with a common one at places pa and pb can share."""
    return F.least("pa", "pb") + 1 + F.least(F.col(size_a) - F.col("pa"), F.col(size_b) - F.col("pb")) - 1


def _possible(least: int, of: int) -> Column:
    """Whether sets of na and nb n-grams that share one at places pa and pb of the order can be similar."""
    return _similar_sizes(least, of) & (_most_common("na", "nb") * (of + least) >= least * (F.col("na") + F.col("nb")))


def _enough(least: int, of: int) -> Column:
    """Whether sets of na and nb n-grams can be similar if their prefixes share ``votes``: past the prefix that ends first, no more can be common than its set has left."""
    left = F.greatest(F.ceil(F.col("na") * least / of), F.ceil(F.col("nb") * least / of)) - 1
    return (F.col("votes") + left) * (of + least) >= least * (F.col("na") + F.col("nb"))


def _possible_by_difference(least: int, of: int) -> Column:
    """The same, by their differences of da and db n-grams from a centre, which share one at places pa and pb."""
    # As many as they must share in all must be left from here on: the first that they share stands no later.
    shared = F.least(_most_common("da", "db"), F.col("da") - F.col("pa"), F.col("db") - F.col("pb"))
    return _similar_sizes(least, of) & ((of + least) * (F.col("da") + F.col("db") - 2 * shared) <= (of - least) * (F.col("na") + F.col("nb")))


def _met(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """For each pair (a, b, star), both segments of each fragment: a, b, star, na, nb, fragment, ga, gb. The segments of a b with many partners are repeated, so that its pairs spread over tasks."""
    mine = segments.select(F.col("set").alias("a"), F.col("size").alias("na"), "fragment", F.col("grams").alias("ga"))
    theirs = segments.select(F.col("set").alias("b"), F.col("size").alias("nb"), "fragment", F.col("grams").alias("gb"))
    shares = pairs.groupBy("b").agg((F.floor(F.count(F.lit(1)) / PARTNERS) + 1).alias("shares"))
    salted = pairs.select("a", "b", "star").join(shares, "b").select("a", "b", "star", F.pmod(F.xxhash64("a"), "shares").cast("int").alias("salt"))
    theirs = theirs.join(shares, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shares").cast("int") - 1))).drop("shares")
    return salted.join(mine, "a").join(theirs, ["b", "fragment", "salt"])


def _compared(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """For each pair (a, b, star): na, nb, common, the overlap summed over the fragments, and of stars tokens, the differences: an n-gram that only a has, or the complement of one that only b has."""
    none = F.array().cast("array<long>")
    tokens = F.when(F.col("star"), F.concat(F.array_except("ga", "gb"), F.transform(F.array_except("gb", "ga"), F.bitwise_not))).otherwise(none)
    parts = _met(pairs, segments).select("a", "b", "star", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("common"), tokens.alias("tokens"))
    found = parts.groupBy("a", "b", "star", "na", "nb").agg(F.sum("common").alias("common"), F.flatten(F.collect_list("tokens")).alias("tokens"))
    return found.withColumn("d", F.size("tokens").cast("long"))


def _similar(compared: DataFrame, least: int, of: int) -> DataFrame:
    return compared.where(of * F.col("common") >= least * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b").distinct()


def _classes(entries: DataFrame, least: int, of: int) -> DataFrame:
    """Entries by n-gram and size class: each in its own class, at home, and as a visitor in the next one. Similar sets are at most one class apart."""
    own = F.floor(F.log(F.col("size").cast("double")) / F.lit(np.log(of / least) * 1.000001)).cast("int")
    return entries.withColumn("home", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("class", F.when(F.col("home"), own).otherwise(own + 1)).drop("c")


def _candidates(entries: DataFrame, least: int, of: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to compare, and stars (a, b) of sets and the centres they go through, from entries (gram, set, size, pos, c)."""
    few, many = entries.where(F.col("c") <= TOGETHER), entries.where(F.col("c") > TOGETHER)
    side = lambda rows, x, *keys: rows.select(*keys, F.col("set").alias(x), F.col("size").alias(f"n{x}"), F.col("pos").alias(f"p{x}"))
    pairs = side(few, "a", "gram").join(side(few, "b", "gram"), "gram").where((F.col("a") < F.col("b")) & _possible(least, of)).select("a", "b", "na", "nb")

    # Sets that meet many are few, for most prefixes hold rare n-grams alone.
    classed = cut(_classes(many, least, of))
    votes = classed.groupBy("set").agg(F.count(F.lit(1)).alias("votes"))
    homes = classed.join(votes, "set").groupBy("gram", "class").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.max(F.struct("votes", "set")).alias("best"))
    classed = cut(classed.join(homes.where("homes > 0").select("gram", "class", "homes", F.col("best.set").alias("centre")), ["gram", "class"]))
    near = classed.where(F.col("homes") <= TOGETHER)
    met = side(near.where("home"), "a", "gram", "class").join(side(near, "b", "gram", "class", "home"), ["gram", "class"])
    met = met.where((F.col("a") != F.col("b")) & (~F.col("home") | (F.col("a") < F.col("b"))) & _possible(least, of))
    first = F.col("a") < F.col("b")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(first, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("nb"))
    # A pair without a centre has met at each n-gram that both prefixes hold.
    pairs = pairs.union(met).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("votes")).where(_enough(least, of)).select("a", "b")
    stars = classed.where((F.col("homes") > TOGETHER) & (F.col("set") != F.col("centre"))).select(F.col("set").alias("a"), F.col("centre").alias("b")).distinct()
    return pairs, stars


def _across(differences: DataFrame, labels: DataFrame, least: int, of: int) -> DataFrame:
    """Pairs (a, b) of different components that share one of their rarest differences from a centre and can be similar."""
    tokens = differences.select(F.col("a").alias("set"), F.col("b").alias("centre"), F.col("na").alias("size"), "d", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("centre", "token").agg(F.count(F.lit(1)).alias("f"))
    tokens = tokens.join(counts, ["centre", "token"])
    # One set's differences from one centre: as many as its texts have n-grams.
    order = W.partitionBy("centre", "set").orderBy("f", "token")
    placed = tokens.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    # A link allows (of - least) / least * size differences at most, whatever its other set.
    placed = placed.where((F.col("f") > 1) & (least * F.col("pos") <= (of - least) * F.col("size"))).withColumn("index", 2 * least * F.col("pos") <= (of - least) * F.col("size"))
    placed = placed.join(labels.withColumnRenamed("node", "set"), "set", "left").select("centre", "token", "set", "size", "d", "pos", "index", F.coalesce("label", "set").alias("label"))
    placed = cut(placed)
    mixed = placed.groupBy("centre", "token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("index").alias("i")).where("x <> y AND i").select("centre", "token")
    placed = cut(placed.join(mixed, ["centre", "token"]))
    side = lambda rows, x: rows.select("centre", "token", F.col("set").alias(x), F.col("size").alias(f"n{x}"), F.col("d").alias(f"d{x}"), F.col("pos").alias(f"p{x}"), F.col("label").alias(f"l{x}"))
    met = side(placed.where("index"), "a").join(side(placed, "b"), ["centre", "token"])
    smaller = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    met = met.where((F.col("la") != F.col("lb")) & smaller & _possible_by_difference(least, of))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, least: int = 80, of: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, linked.

    Two documents link when of * |A and B| >= least * |A or B| for their sets
    of word n-grams (A-Z lower-cased; a text of fewer words is one n-gram).
    ``component_id`` is the smallest id that links lead to, ``linked`` whether
    any other document is in the component.

    Null, empty and wordless texts have no n-grams and link with nothing. A
    null id counts as smaller than all others and stays null. Repeated rows
    link with each other. A text is held whole, so a very long one takes memory
    in proportion to its words. An empty table gives no rows. Other columns are
    ignored. N-grams count as equal when their 62-bit hashes are, and sets when
    the 64-bit hashes of their n-grams are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    null_id = F.lit(-(1 << 63)).cast("long")
    texts = fields(docs, id=doc_id, text=text).select(F.coalesce("id", null_id).alias("id"), "text")
    scanned = cut(_scan(texts, n))
    counts = scanned.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "gram").limit(COMMON)
    hot = counts.toArrow()
    hot = np.stack([hot.column(c).to_numpy() for c in ("gram", "count")], 1).astype(np.int64) if hot.num_rows else np.zeros((0, 2), np.int64)
    by_hash = np.argsort(hot[:, 0])
    common = spark.sparkContext.broadcast((hot[by_hash, 0], (len(hot) - 1 - by_hash).astype(np.int64)))
    documents = scanned.where("gram IS NULL").select("id", "size", "set")
    sets = documents.where("size > 0").groupBy("set").agg(F.min("id").alias("first"), F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"))

    prefixes = cut(_prefixes(texts, n, common, least, of))
    entries = prefixes.select("set", "size", F.posexplode("prefix").alias("pos", "gram"))
    # Two tasks may meet one set, so some that are counted twice here are one set below.
    shared = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    entries = entries.join(shared, "gram").groupBy("gram", "set").agg(F.max("size").alias("size"), F.max("pos").cast("long").alias("pos"), F.max("c").alias("c"))
    entries = cut(entries)
    drop(prefixes)
    pairs, stars = _candidates(entries, least, of)
    pairs = cut(pairs.withColumn("star", F.lit(False)).union(stars.withColumn("star", F.lit(True))))
    drop(entries)
    segments = cut(_segments(texts, pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), sets, n, common))
    compared = cut(_compared(pairs, segments))
    found = cut(_similar(compared, least, of))
    across = cut(_across(compared.where("star"), connected_components(found), least, of).withColumn("star", F.lit(False)))
    links = cut(found.union(_similar(_compared(across, segments), least, of)))
    drop(segments, compared, across, pairs, found)
    labels = connected_components(links)

    smallest = labels.join(sets.withColumnRenamed("set", "node"), "node").groupBy("label").agg(F.min("first").alias("component"))
    members = labels.join(smallest, "label").select(F.col("node").alias("set"), "component")
    known = sets.join(members, "set", "left").select("set", F.coalesce("component", "first").alias("component"), (F.col("component").isNotNull() | (F.col("copies") > 1)).alias("linked"))
    out = documents.join(known, "set", "left").select("id", "size", F.coalesce("component", "id").alias("component"), F.coalesce("linked", F.lit(False)).alias("linked"))
    real = lambda c: F.when(F.col(c) != null_id, F.col(c))
    return out.select(real("id").alias("doc_id"), F.col("size").alias("n_shingles"), real("component").alias("component_id"), "linked")


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, least=85, of=100).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM g
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p
), r AS (SELECT doc_id AS x, doc_id AS y FROM g UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM g JOIN c ON x = doc_id
"""
