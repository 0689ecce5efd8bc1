"""Pairs with both records, and their 39 similarity features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.normalize import tokens
from tessera.functions.similarity import address_similarities, name_similarities
from tessera.functions.wordlists import FEATURES


def last_of_each(records: DataFrame) -> DataFrame:
    """One record per id, the last in order where there are several."""
    rest = [c for c in records.columns if c not in ("entity_id", "seq")]
    if "seq" not in records.columns:
        # Without an order the greatest record stands for the last one, so that reruns agree.
        return records.groupBy("entity_id").agg(F.max(F.struct(*rest)).alias("r")).select("entity_id", "r.*")
    return records.groupBy("entity_id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("entity_id", "r.*")


def with_records(pairs: DataFrame, sources: DataFrame, targets: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """pairs(s1_id, target_id, ...) with the records as a_ and b_ columns; pairs of unknown ids are left out or, if kept, have null records, and features of 0."""
    side = lambda df, p, key: last_of_each(df).select(*[F.col(c).alias(key if c == "entity_id" else p + c) for c in df.columns if c != "seq"])
    how = "left" if keep_unknown else "inner"
    return pairs.join(side(sources, "a_", "s1_id"), "s1_id", how).join(side(targets, "b_", "target_id"), "target_id", how)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _jaccard(a: Column, b: Column) -> tuple[Column, Column]:
    common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return common.cast("double"), F.when(union > 0, common / union).otherwise(0.0)


def _lengths(a: Column, b: Column) -> tuple[Column, Column]:
    x, y = F.length(a), F.length(b)
    longer = F.greatest(x, y)
    return F.abs(x - y).cast("double"), F.when(longer > 0, F.least(x, y) / longer).otherwise(0.0)


def catalyst_features() -> dict[str, Column]:
    """The features that need no string distance."""
    c = F.col
    both = lambda x: (c("a_" + x) == c("b_" + x)) & (c("a_" + x) != "")
    ta, tb, ua, ub = (tokens(c(x)) for x in ("a_name_no_suf", "b_name_no_suf", "a_addr_basic", "b_addr_basic"))
    chars = lambda x: F.array_distinct(F.filter(F.split(c(x), ""), lambda d: d != ""))
    missing = c("b_addr_basic") == ""
    known = lambda x: F.when(missing, 0.0).otherwise(x)
    name_common, name_jaccard = _jaccard(ta, tb)
    addr_common, addr_jaccard = _jaccard(ua, ub)
    digit_common, digit_jaccard = _jaccard(chars("a_addr_digits"), chars("b_addr_digits"))
    name_diff, name_ratio = _lengths(c("a_name_no_suf"), c("b_name_no_suf"))
    addr_diff, addr_ratio = _lengths(c("a_addr_basic"), c("b_addr_basic"))
    first = lambda t: F.get(t, F.lit(0))
    last = lambda t: F.get(t, F.size(t) - 1)
    return {
        "name_basic_exact": _flag(both("name_basic")),
        "name_nosuf_exact": _flag(both("name_no_suf")),
        "name_sorted_exact": _flag(both("name_no_suf_sorted")),
        "name_first_token_exact": _flag(first(ta) == first(tb)),
        "name_last_token_exact": _flag(last(ta) == last(tb)),
        "name_token_jaccard": name_jaccard,
        "name_common_tokens": name_common,
        "name_len_diff": name_diff,
        "name_len_ratio": name_ratio,
        "name_abbr_match": _flag(both("name_abbr") & (F.length("a_name_abbr") >= 2)),
        "addr_basic_exact": known(_flag(both("addr_basic"))),
        "addr_token_jaccard": known(addr_jaccard),
        "addr_common_tokens": known(addr_common),
        "addr_digits_common": known(digit_common),
        "addr_digits_jaccard": known(digit_jaccard),
        "postal_code_exact": known(_flag(both("postal_code"))),
        "house_num_exact": known(_flag(both("house_num"))),
        "addr_len_diff": known(addr_diff),
        "addr_len_ratio": known(addr_ratio),
        "addr_missing": _flag(missing),
        "country_exact": _flag(both("country")),
        "is_s2": _flag(c("target_id").startswith("S2-")),
        "is_s3": _flag(c("target_id").startswith("S3-")),
    }


def pair_features(met: DataFrame) -> DataFrame:
    """The 39 features, in their order, after the columns of met that aren't a record's."""
    c = F.col
    kept = [x for x in met.columns if not x.startswith(("a_", "b_"))]
    df = met.withColumn("_n", name_similarities(c("a_name_no_suf"), c("b_name_no_suf"))).withColumn("_a", address_similarities(c("a_addr_basic"), c("b_addr_basic")))
    near = {"name_fuzz_ratio": "_n.ratio", "name_partial_ratio": "_n.partial", "name_token_sort_ratio": "_n.sort", "name_token_set_ratio": "_n.set", "name_wratio": "_n.weighted", "name_jaro_winkler": "_n.jw"}
    near |= {"addr_fuzz_ratio": "_a.ratio", "addr_token_sort_ratio": "_a.sort", "addr_token_set_ratio": "_a.set", "addr_jaro_winkler": "_a.jw"}
    df = df.withColumns({k: c(v) for k, v in near.items()} | catalyst_features())
    df = df.withColumns(
        {
            "name_sim_x_addr_sim": c("name_token_sort_ratio") * c("addr_token_sort_ratio"),
            "name_sim_x_country": c("name_token_sort_ratio") * c("country_exact"),
            "addr_sim_x_country": c("addr_token_sort_ratio") * c("country_exact"),
            "name_exact_and_addr_high": _flag((c("name_nosuf_exact") == 1) & (c("addr_token_sort_ratio") >= 0.8)),
            "name_high_and_postal_match": _flag((c("name_token_sort_ratio") >= 0.8) & (c("postal_code_exact") == 1)),
            "name_nosuf_exact_and_addr_sim": c("name_nosuf_exact") * c("addr_token_sort_ratio"),
        }
    )
    known = c("a_name_no_suf").isNotNull() & c("b_name_no_suf").isNotNull()
    return df.select(*kept, *[F.when(known, c(f)).otherwise(0.0).alias(f) for f in FEATURES])
