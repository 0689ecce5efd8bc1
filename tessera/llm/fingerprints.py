"""Document fingerprints by consistent weighted sampling.

A document is the multiset of its words, a word's weight its count. For each
of SAMPLES samples a word draws, from hashes of itself alone, r and c from
Gamma(2, 1) and b from U(0, 1). With t = floor(ln w / r + b), the word whose
ln c - r (t - b + 1) is smallest is the sample, together with its t. Two
documents agree on a sample with the probability of their generalised Jaccard
similarity, sum of smaller weights by sum of larger ones.

All is built-in functions. Documents are dealt once, by ranges of their id;
words are counted and minima taken where the document lies, with no further
shuffle, and neighbours in the order of ids are found by a window within a
range (the first document of each range is handed to the range before it).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import SPACE, cut, fields

SAMPLES = 32
#: Documents in a range of ids, on average; and the most ranges.
RANGE_ROWS, RANGES = 500, 65_536
#: Quantiles of the ids by which ranges are cut; between two of them, ranges are equally wide.
QUANTILES = 256
NULL_ID = -(1 << 63)
#: Bits of a hash that choose among equally likely values of r, of ln c and of b; together 32.
R_BITS, C_BITS, B_BITS = 9, 10, 13


def gamma_quantiles(bits: int) -> np.ndarray:
    """The middles of 2 ** bits equally likely parts of Gamma(2, 1), by bisection of its distribution function."""
    want = (np.arange(1 << bits) + 0.5) / (1 << bits)
    low, high = np.zeros(1 << bits), np.full(1 << bits, 60.0)
    for _ in range(80):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < want
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


def _table(values: np.ndarray) -> Column:
    """A constant array, folded by the optimizer."""
    return F.split(F.lit(",".join(f"{v:.4f}" for v in values)), ",").cast("array<double>")


def word_hashes(text: Column) -> Column:
    """Sorted hashes of a text's words, repeats included."""
    return F.sort_array(F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)))


def run_ends(hashes: Column) -> Column:
    """Positions (from 0) where a run of equal hashes ends, after a first -1."""
    ends = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.get(hashes, i).eqNullSafe(F.get(hashes, i + 1)) == F.lit(False))
    return F.when(F.size(hashes) > 0, F.concat(F.array(F.lit(-1)), ends))


def _bits(h: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << width) - 1))


def sample_key(word: Column, draws: Column, ln_weight: Column, k: int) -> Column:
    """A long that orders the words of a document by their k-th sample's value, and names word and t in its lower half.

    r, c and b come from separate bits of one half of ``draws``, a hash of the
    word that serves two samples: r and ln c through tables of quantiles
    (logarithms cost most of the time otherwise), but the lowest part of c,
    which decides the minima of long texts, exactly and by a hash of its own.
    """
    at = 32 * (k % 2)
    r = F.get(_table(gamma_quantiles(R_BITS)), _bits(draws, at, R_BITS).cast("int"))
    c = _bits(draws, at + R_BITS, C_BITS)
    fine = (_bits(F.xxhash64(word, F.lit(SAMPLES + k)), 0, 40) + F.lit(0.5)) * F.lit(2.0**-40 / (1 << C_BITS))
    # Gamma(2, 1) has the distribution function x ** 2 / 2 near 0.
    ln_c = F.when(c == 0, F.log(fine * 2) * 0.5).otherwise(F.get(_table(np.log(gamma_quantiles(C_BITS))), c.cast("int")))
    b = (_bits(draws, at + R_BITS + C_BITS, B_BITS) + F.lit(0.5)) * F.lit(2.0**-B_BITS)
    t = F.when(ln_weight == 0, F.lit(0).cast("long")).otherwise(F.floor(ln_weight / r + b))
    value = ln_c - r * (t - b + 1)
    # Values lie within +-100 or so; the upper 32 bits hold them in steps of 2 ** -23.
    high = F.shiftleft((value * F.lit(2.0**23)).cast("long"), 32)
    return high.bitwiseOR(word.bitwiseXOR(t * F.lit(0x9E3779B1)).bitwiseAND(F.lit((1 << 32) - 1)))


def likeness(one: str, two: str) -> Column:
    """Share of samples on which two fingerprints agree."""
    a, b = F.split(F.col(one), "-"), F.split(F.col(two), "-")
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return same.cast("double") / F.lit(float(SAMPLES))


def fingerprint_rows(rows: DataFrame, keys: list[str], text: str, carried: list[str] = [], samples: int = SAMPLES) -> DataFrame:  # noqa: B006
    """keys, carried and fingerprint; rows must be dealt by some of keys, keys must be unique and carried be numbers."""
    hashed = rows.select(*keys, *carried, word_hashes(F.col(text)).alias("hashes"))
    ended = hashed.select(*keys, *carried, "hashes", run_ends(F.col("hashes")).alias("ends"))
    weighed = ended.select(*keys, *carried, F.explode_outer(F.transform(F.slice("ends", 2, F.greatest(F.size("ends") - 1, F.lit(0))), lambda e, k: F.struct(F.get("hashes", e).alias("h"), (e - F.get("ends", k)).alias("n")))).alias("x"))
    terms = weighed.select(*keys, *carried, F.col("x.h").alias("h"), F.log(F.col("x.n").cast("double")).alias("w"), *[F.xxhash64("x.h", F.lit(k)).alias(f"d{k}") for k in range((samples + 1) // 2)])
    lows = terms.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carried], *[F.min(sample_key(F.col("h"), F.col(f"d{k // 2}"), F.col("w"), k)).alias(f"s{k}") for k in range(samples)])
    parts = [F.lower(F.lpad(F.hex(F.coalesce(F.col(f"s{k}").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0))), 8, "0")) for k in range(samples)]
    return lows.select(*keys, *carried, F.concat_ws("-", *parts).alias("fingerprint"))


def _sha_numbers(text: Column) -> list[Column]:
    """SHA-256 as four numbers, which hash aggregation can carry."""
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("long").alias(f"sha{k}") for k in range(4)]


def id_ranges(rows: DataFrame) -> Column:
    """The number of a row's range, from 0 for the largest ids: some RANGE_ROWS rows each, wherever ids lie dense or far apart. Null ids are split by a hash of their text, in its order."""
    known = F.when(F.col("id") != NULL_ID, F.col("id"))
    size = rows.agg(F.count(known).alias("n"), F.count(F.lit(1)).alias("all"), F.min(known).alias("low"), F.max(known).alias("high")).first()
    ranges = min(RANGES, max(1, size.n // RANGE_ROWS))
    coarse = min(QUANTILES, ranges)
    fine = ranges // coarse
    # QUANTILES numbers at most.
    found = rows.agg(F.percentile_approx(known, [k / coarse for k in range(1, coarse)], 10_000).alias("q")).first().q if coarse > 1 else []
    bounds = sorted({x for x in found or [] if size.low < x <= size.high}, reverse=True)
    tops, bottoms = [(size.high or 0) + 1, *bounds], [*bounds, size.low or 0]
    large = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in bounds]), lambda x: x > F.col("id"))) if bounds else F.lit(0)
    pick = lambda values: F.get(F.array(*[F.lit(float(x)) for x in values]), large)
    within = F.floor((pick(tops) - 1 - F.col("id").cast("double")) / (pick(tops) - pick(bottoms)) * fine)
    numbered = (large * fine + F.least(F.greatest(within, F.lit(0)), F.lit(fine - 1))).cast("int")
    nulls = min(RANGES, max(1, (size["all"] - size.n) // RANGE_ROWS))
    hashed = F.floor((F.xxhash64("text").cast("double") + F.lit(2.0**63)) * F.lit(nulls * 2.0**-64))
    return F.when(F.col("id") != NULL_ID, numbered).otherwise((len(tops) * fine + F.least(hashed, F.lit(nulls - 1))).cast("int"))


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, with its fingerprint and its edited text's: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n / 2) code points replaced by the first
    as many (or all) of the next document's, by descending id; after the last
    comes the first. Null ids come last. Documents of one id are ordered by a
    hash of their text. Null texts are empty; texts without words have a
    fingerprint of zeros, and agree with each other fully. A table of one row
    is its own next. An empty table gives no rows. Other columns are ignored.
    """
    rows = fields(docs, doc_id=doc_id, text=text).select(F.coalesce("doc_id", F.lit(NULL_ID).cast("long")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("range", id_ranges(rows))
    order = [F.desc("id"), F.xxhash64("text"), F.col("text")]
    # The first document of each range: as many rows as there are ranges, at most RANGES.
    largest = rows.groupBy("range").agg(F.max("id").alias("id"))
    heads = rows.join(F.broadcast(largest), ["range", "id"]).withColumn("row", F.row_number().over(W.partitionBy("range").orderBy(*order))).where("row = 1")
    heads = cut(fingerprint_rows(heads.select("range", "text"), ["range"], "text").join(heads.select("range", "text"), "range"))
    after = W.partitionBy(F.lit(0)).orderBy("range")
    numbers = heads.select("range").withColumn("following", F.coalesce(F.lead("range").over(after), F.min("range").over(W.partitionBy(F.lit(0)))))
    following = numbers.join(heads.select(F.col("range").alias("following"), F.col("text").alias("head"), F.col("fingerprint").alias("head_print")), "following").drop("following")

    by_place = W.partitionBy("range").orderBy(*order)
    placed = rows.select("range", "id", "text", F.row_number().over(by_place).alias("row"), F.lead("text").over(by_place).alias("next"))
    full = placed.join(following.select("range", "head"), "range").withColumn("next", F.coalesce("next", "head"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    full = full.withColumn("n_chars", F.char_length("text")).withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars") - half), F.substr("next", F.lit(1), half)))
    versions = full.select("range", "row", "id", "n_chars", *_sha_numbers(F.col("edited")), F.posexplode(F.array("text", "edited")).alias("version", "body"))
    prints = fingerprint_rows(versions, ["range", "row", "version"], "body", ["id", "n_chars", "sha0", "sha1", "sha2", "sha3"])
    nearby = W.partitionBy("range").orderBy("row", "version")
    prints = prints.withColumn("edited_fingerprint", F.lead("fingerprint", 1).over(nearby)).withColumn("next_print", F.lead("fingerprint", 2).over(nearby)).where("version = 0")
    prints = prints.join(following.select("range", "head_print"), "range").withColumn("next_print", F.coalesce("next_print", "head_print"))
    return prints.select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.concat(*[F.lower(F.lpad(F.hex(f"sha{k}"), 16, "0")) for k in range(4)]).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_print").alias("near_next"),
    )


def op8_consistent_sampling(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
