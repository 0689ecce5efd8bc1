"""Candidate generation: prioritized blocking passes and a deterministic cap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import normalize as N
from tessera.operators.cuts import computed

#: Postings with more entries than this, repeats included, are not probed.
GUARDS = {"single_token": 500, "addr_code": 300, "postal": 300, "addr_pair": 300, "addr_digits": 300}
#: Order in which a record's keys are probed.
RANKS = ("name_basic", "name_no_suf", "name_alnum", "name_no_suf_sorted", "name_compact", "domain_stem", "stem_compact", "token_pair", "sort_pair", "addr_code", "num_token", "num_addr_token", "num_addr_pair", "postal_house", "postal_token", "postal", "addr_pair", "addr_digits", "tfidf")


def _views(records: DataFrame) -> DataFrame:
    """Key ingredients of normalized records."""
    return records.withColumns(
        {
            "compact": N.alnum(F.col("name_no_suf")),
            "stem": N.domain_stem(F.col("original_name")),
            "toks": N.name_tokens(F.col("name_no_suf")),
            "atoks": N.address_tokens(F.col("addr_basic")),
            "codes": N.address_codes(F.col("addr_basic")),
            "combos": N.sorted_combinations(F.col("name_no_suf")),
            "anums": N.digit_runs(F.col("addr_basic"), "_"),
        }
    ).withColumn("hnum", F.when(F.col("house_num") != "", F.col("house_num")).otherwise(F.col("anums")))


def _entry(rank: str, index: str, key: Column, ordinal: Column | int = 0, sub: int = 0) -> Column:
    return F.struct(F.lit(RANKS.index(rank) + 1).alias("rank"), F.lit(ordinal).cast("int").alias("ordinal"), F.lit(sub).alias("sub"), F.lit(index).alias("index"), key.alias("key"))


def keys(records: DataFrame, probe: bool) -> DataFrame:
    """entity_id, seq, and the rank, ordinal, sub, index and key of each key; probes also look a domain stem up among compact names, builds store it there."""
    c = F.col
    one = lambda rank, index, key, when: F.when(when, F.array(_entry(rank, index, key)))
    many = lambda rank, index, array, prefix=None: F.transform(array, lambda t, i: _entry(rank, index, F.concat_ws("_", prefix, t) if prefix is not None else t, i))
    two = F.size("atoks") >= 2
    has_hnum, has_postal = c("hnum") != "", c("postal_code") != ""
    passes = [one(x, x, c(x), c(x) != "") for x in RANKS[:4]]
    passes += [
        one("name_compact", "name_compact", c("compact"), F.length("compact") >= 4),
        one("domain_stem", "domain_stem", c("stem"), c("stem") != ""),
        one("stem_compact", "name_compact", c("stem"), c("stem") != ""),
        many("token_pair", "token_pair", N.adjacent_pairs(c("toks"))),
        F.when(F.size("toks") == 1, many("token_pair", "single_token", c("toks"))),
        many("sort_pair", "sort_pair", c("combos")),
        many("addr_code", "addr_code", c("codes")),
        F.when(F.size("toks") > 0, F.transform("codes", lambda t, i: _entry("addr_code", "code_token", F.concat_ws("_", t, F.get("toks", F.lit(0))), i, 1))),
        F.when(has_hnum, many("num_token", "num_token", F.slice("toks", 1, 4), c("hnum"))),
        one("num_addr_token", "num_addr_token", F.concat_ws("_", "hnum", F.get("atoks", F.lit(0))), has_hnum & (F.size("atoks") >= 1)),
        one("num_addr_pair", "num_addr_pair", F.concat_ws("_", "hnum", F.get("atoks", F.lit(0)), F.get("atoks", F.lit(1))), has_hnum & two),
        one("postal_house", "postal_house", F.concat_ws("_", "postal_code", "hnum"), has_postal & has_hnum),
        F.when(has_postal, many("postal_token", "postal_token", F.slice("toks", 1, 3), c("postal_code"))),
        one("postal", "postal", c("postal_code"), F.length("postal_code") >= 3),
        F.when(two, many("addr_pair", "addr_pair", N.adjacent_pairs(c("atoks")))),
        one("addr_digits", "addr_digits", c("anums"), F.length("anums") >= 3),
    ]
    empty = F.array().cast("array<struct<rank:int,ordinal:int,sub:int,index:string,key:string>>")
    every = F.concat(*[F.coalesce(p, empty) for p in passes])
    out = _views(records).select("entity_id", *(["seq"] if not probe else []), F.explode(every).alias("k"))
    return out.select("entity_id", *(["seq"] if not probe else []), "k.*")


def postings(targets: DataFrame, cap: int) -> DataFrame:
    """index, key, target_id, target_seq: guarded, and cut to the first ``cap`` targets of a key, which no result can tell from the whole."""
    built = keys(targets, probe=False).select("index", "key", F.col("entity_id").alias("target_id"), F.col("seq").alias("target_seq"))
    limit = F.coalesce(*[F.when(F.col("index") == i, n) for i, n in GUARDS.items()])
    crowded = built.where(F.col("index").isin(*GUARDS)).groupBy("index", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("index", "key")
    kept = built.join(crowded, ["index", "key"], "left_anti").groupBy("index", "key", "target_id").agg(F.min("target_seq").alias("target_seq"))
    order = W.partitionBy("index", "key").orderBy("target_seq")
    return kept.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).drop("n")


def candidates(sources: DataFrame, targets: DataFrame, cap: int = 8, tfidf: DataFrame | None = None) -> DataFrame:
    """s1_id, target_id, rank: each source's first ``cap`` targets in the order of passes, keys and targets.

    ``sources`` and ``targets`` are normalized records; targets carry ``seq``,
    their order. ``tfidf`` (s1_id, target_id, place, target_seq) is the last pass.
    """
    probes = keys(sources, probe=True).withColumnRenamed("entity_id", "s1_id")
    met = probes.join(postings(targets, cap), ["index", "key"]).select("s1_id", "target_id", "rank", "ordinal", "sub", "target_seq")
    if tfidf is not None:
        met = met.unionByName(tfidf.select("s1_id", "target_id", F.lit(len(RANKS)).alias("rank"), F.col("place").cast("int").alias("ordinal"), F.lit(0).alias("sub"), "target_seq"))
    found = met.groupBy("s1_id", "target_id").agg(F.min(F.struct("rank", "ordinal", "sub", "target_seq")).alias("first"))
    return found.withColumn("rank", F.row_number().over(W.partitionBy("s1_id").orderBy("first"))).where(F.col("rank") <= cap).select("s1_id", "target_id", "rank")


def char_grams(c: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Character n-grams of each word padded with a space on both sides; a padded word no longer than n is emitted once, and ends its sizes."""

    def cut_at(p: Column, n: int):
        return lambda i: F.substr(p, i, F.lit(n))

    def of_word(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        out, open_ = F.array().cast("array<string>"), F.lit(True)
        for n in sizes:
            slid = F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), cut_at(p, n))
            out = F.concat(out, F.when(open_, slid).otherwise(F.array().cast("array<string>")))
            open_ = open_ & (F.length(p) > n)
        return out

    return F.flatten(F.transform(N.tokens(c), of_word))


def tfidf_weights(records: DataFrame, vocabulary: DataFrame | None, text: str = "name_no_suf", least: int = 5, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """L2-normalized (entity_id, seq, gram, weight, df), and the vocabulary (gram, df, idf), fitted here if none is given."""
    counted = records.select("entity_id", *(["seq"] if "seq" in records.columns else []), F.explode(char_grams(F.col(text))).alias("gram"))
    counted = counted.groupBy(*counted.columns).agg(F.count(F.lit(1)).alias("tf"))
    if vocabulary is None:
        n = records.count()
        stats = counted.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= least)
        vocabulary = stats.orderBy(F.desc("total"), "gram").limit(most).select("gram", "df", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf"))
    raw = counted.join(vocabulary, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    norms = raw.groupBy("entity_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "entity_id").withColumn("weight", F.col("w") / F.col("norm")).drop("w", "norm", "tf", "idf"), vocabulary


#: Different vectors of targets and of sources that meet in one task.
TARGETS, SOURCES = 30_000, 4_000


def _vectors(weights: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """key, v1, v2, g, w: a record's grams by number, rarest first, and their weights; v1 and v2 are 128 bits of hashes of them, the same for all records of equal grams."""
    row = weights.join(vocabulary.select("gram", "number"), "gram").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("number", "weight"))).alias("v"))
    row = row.select(key, F.col("v.number").alias("g"), F.col("v.weight").alias("w"))
    # Norms are summed in any order, which shows in the last places.
    alike = F.transform("w", lambda x: F.round(x, 12))
    return computed(row.withColumns({"v1": F.xxhash64("g", alike), "v2": F.xxhash64(F.lit(1), alike, "g")}))


def _parts(rows: int, size: int, least: int) -> int:
    return max(-(-rows // size), min(least, -(-rows // 500)), 1)


def _lists(c: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the lists, from 0 on, and what they hold."""
    sizes = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in c.chunks])
    return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([x.flatten().to_numpy() for x in c.chunks])


def best_of_block(k: int, floor: float):
    """A function of a table of source vectors and one of target vectors: the k highest inner products of each source at or above floor, and all that may tie with the last."""

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        found: list[np.ndarray] = [np.zeros(0, np.int64)]
        source, cosine = [np.zeros(0, np.int64)], [np.zeros(0)]
        if ours.num_rows and theirs.num_rows:
            (ends, grams), (_, weights) = _lists(theirs["g"]), _lists(theirs["w"])
            order = np.argsort(grams, kind="stable")
            at, weights = np.repeat(np.arange(theirs.num_rows), np.diff(ends))[order], weights[order]
            (ends, mine), (_, own) = _lists(ours["g"]), _lists(ours["w"])
            first = np.searchsorted(grams[order], np.arange(mine.max() + 2)).tolist()
            ends, mine, own = ends.tolist(), mine.tolist(), own.tolist()
            for n in range(ours.num_rows):
                score = np.zeros(theirs.num_rows)
                for j in range(ends[n], ends[n + 1]):
                    a, b = first[mine[j]], first[mine[j] + 1]
                    if b > a:
                        score[at[a:b]] += own[j] * weights[a:b]
                near = np.flatnonzero(score >= floor - 1e-8)
                if len(near) > k:
                    reached = score[near]
                    near = near[reached >= np.partition(reached, -k)[-k] - 2e-9]
                found.append(near)
                source.append(np.full(len(near), n))
                cosine.append(score[near])
        n, m = np.concatenate(source), np.concatenate(found)
        columns = [ours[c].take(pa.array(n)) for c in ("v1", "v2")] + [theirs[c].take(pa.array(m)) for c in ("v1", "v2")]
        return pa.Table.from_arrays([*columns, pa.chunked_array([np.concatenate(cosine)])], ["s1", "s2", "t1", "t2", "cosine"])

    return run


def tfidf_top(sources: DataFrame, targets: DataFrame, k: int = 5, floor: float = 0.15, **fit) -> DataFrame:
    """s1_id, target_id, target_seq, cosine, place: the k most similar targets at or above floor; ties by target order.

    Exact. Records of equal grams share one vector, and of a vector's targets
    the first k by their order are enough. Blocks of source and target vectors
    meet in tasks, where a source adds the postings of its grams. All blocks
    meet: work and shuffle grow with the product of the numbers of vectors.
    """
    text = fit.get("text", "name_no_suf")
    sources, targets = computed(sources.select("entity_id", text)), computed(targets.select("entity_id", "seq", text))
    theirs, vocabulary = tfidf_weights(targets, None, **fit)
    # As many rows as the vocabulary may have.
    vocabulary = computed(vocabulary.withColumn("number", F.row_number().over(W.orderBy("df", "gram"))))
    theirs = _vectors(theirs.withColumnRenamed("seq", "target_seq"), vocabulary, "target_seq")
    mine = _vectors(tfidf_weights(sources, vocabulary.drop("number"), **fit)[0].withColumnRenamed("entity_id", "s1_id"), vocabulary, "s1_id")
    ours, others = (computed(df.groupBy("v1", "v2").agg(F.first(F.struct("g", "w")).alias("v")).select("v1", "v2", "v.g", "v.w")) for df in (mine, theirs))
    of_targets = _parts(others.count(), TARGETS, 1)
    of_sources = _parts(ours.count(), SOURCES, 12)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod("v1", F.lit(n)).cast("int")
    ours = ours.select("v1", "v2", "g", "w", own(of_sources).alias("sb"), every(of_targets).alias("tb"))
    others = others.select("v1", "v2", "g", "w", own(of_targets).alias("tb"), every(of_sources).alias("sb"))
    met = ours.groupBy("sb", "tb").cogroup(others.groupBy("sb", "tb")).applyInArrow(best_of_block(k, floor), "s1 long, s2 long, t1 long, t2 long, cosine double")
    first = theirs.select("v1", "v2", "target_seq").withColumn("n", F.row_number().over(W.partitionBy("v1", "v2").orderBy("target_seq"))).where(F.col("n") <= k)
    scored = met.join(first.select(F.col("v1").alias("t1"), F.col("v2").alias("t2"), "target_seq"), ["t1", "t2"]).withColumn("cosine", F.round("cosine", 9)).where(F.col("cosine") >= floor)
    place = W.partitionBy("s1", "s2").orderBy(F.desc("cosine"), "target_seq")
    top = scored.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).select(F.col("s1").alias("v1"), F.col("s2").alias("v2"), "target_seq", "cosine", "place")
    top = mine.select("s1_id", "v1", "v2").join(top, ["v1", "v2"])
    return top.join(targets.select(F.col("seq").alias("target_seq"), F.col("entity_id").alias("target_id")), "target_seq").select("s1_id", "target_id", "target_seq", "cosine", "place")
