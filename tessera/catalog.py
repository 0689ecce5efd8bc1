"""Queries of the entity-resolution engine on the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.similarity import address_similarities, name_similarities
from tessera.functions.normalize import domain_stem, extended_views
from tessera.functions.wordlists import ADDRESS_ABBREVIATIONS, ADDRESS_STOPWORDS, FEATURES, LEGAL_SUFFIXES, MISSING, MODIFIERS, NAME_STOPWORDS, STREET_STOPWORDS
from tessera.operators import blocking, decide, evaluate, filters, pairs, profile
from tessera.operators.features import catalyst_features, pair_features, with_records
from tessera.operators.models import demo_probability
from tessera.plans import adapters

CAP = 8


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sources, targets = adapters.sides(spark, sf_dir)
    return sources, targets, blocking.candidates(sources, targets, CAP)


def _met(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, targets, found = _pairs(spark, sf_dir)
    return with_records(found, sources, targets)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = catalyst_features()
    df = _met(spark, sf_dir).select("s1_id", "target_id", "rank", *[own[k].alias(k) for k in ("name_token_jaccard", "addr_token_jaccard", "country_exact")])
    return df.select("s1_id", "target_id", "rank", demo_probability().alias("prob"))


def _spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.records(spark, sf_dir).where("source = 1").select("entity_id", F.col("entity_id").alias("s1_id"), "seq")


def norm_names(spark, sf_dir):
    both = adapters.sides(spark, sf_dir)
    return both[0].unionByName(both[1]).select("entity_id", "name_basic", "name_alnum", "name_no_suf", "name_sorted", "name_no_suf_sorted", "name_abbr")


def norm_addresses(spark, sf_dir):
    both = adapters.sides(spark, sf_dir)
    return both[0].unionByName(both[1]).select("entity_id", "addr_basic", "addr_alnum", "addr_sorted", "addr_digits", "postal_code", "house_num", "country")


def norm_extended(spark, sf_dir):
    return extended_views(adapters.records(spark, sf_dir))


def url_domain_stem(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", domain_stem(F.coalesce("url", F.lit(""))).alias("stem"))


def blocking_keys(spark, sf_dir):
    return blocking.keys(adapters.sides(spark, sf_dir)[0], probe=True).withColumnRenamed("index", "index_name")


def postings_guarded(spark, sf_dir):
    built = blocking.postings(adapters.sides(spark, sf_dir)[1], CAP)
    return built.groupBy(F.col("index").alias("index_name"), "key").agg(F.count(F.lit(1)).alias("n"), F.min("target_seq").alias("first_seq"))


def block_priority_cap(spark, sf_dir):
    return _pairs(spark, sf_dir)[2]


def candidate_lists(spark, sf_dir):
    sources, _, found = _pairs(spark, sf_dir)
    return decide.id_lists(sources.drop("seq"), found, "candidate_entity_ids")


def tfidf_topk(spark, sf_dir):
    sources, targets = adapters.sides(spark, sf_dir)
    return blocking.tfidf_top(sources, targets, 5).select("s1_id", "target_id", F.round("cosine", 6).alias("cosine"))


def block_with_tfidf(spark, sf_dir):
    sources, targets = adapters.sides(spark, sf_dir)
    return blocking.candidates(sources, targets, CAP, blocking.tfidf_top(sources, targets, 5))


def features_catalyst(spark, sf_dir):
    return _met(spark, sf_dir).select("s1_id", "target_id", *[F.round(v, 9).alias(k) for k, v in catalyst_features().items()])


def features_all(spark, sf_dir):
    return pair_features(_met(spark, sf_dir))


def string_ratios(spark, sf_dir):
    """Plain, sorted-token and token-set ratios of names and addresses."""
    c = F.col
    df = _met(spark, sf_dir).withColumn("n", name_similarities("a_name_no_suf", "b_name_no_suf")).withColumn("a", address_similarities(c("a_addr_basic"), c("b_addr_basic")))
    return df.select("s1_id", "target_id", *[F.round(f"{x}.{k}", 9).alias(f"{y}_{k}") for x, y in (("n", "name"), ("a", "addr")) for k in ("ratio", "sort", "set")])


def unknown_ids(spark, sf_dir):
    """Features of pairs with a record that is not known: all 0."""
    sources, targets, found = _pairs(spark, sf_dir)
    met = with_records(found, sources, targets.where(F.col("seq") % 3 != 0), keep_unknown=True).where("b_name_basic IS NULL")
    return pair_features(met).select("s1_id", "target_id", (sum(F.abs(f) for f in FEATURES)).alias("total"))


def street_filter(spark, sf_dir):
    return _met(spark, sf_dir).select("s1_id", "target_id", filters.streets_agree(F.col("a_original_address"), F.col("b_original_address")).alias("streets_ok"))


def average_candidates(spark, sf_dir):
    return evaluate.average_candidates(_spine(spark, sf_dir), _pairs(spark, sf_dir)[2])


def run_totals(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    out = evaluate.run_totals(_spine(spark, sf_dir), scored, decide.matches(scored, 0.6), decide.compact(scored, 3, 0.6))
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def checked_thresholds(spark, sf_dir):
    """The first candidates of each entity at the fixed thresholds."""
    out = evaluate.threshold_grid(_spine(spark, sf_dir), adapters.truth(spark, sf_dir), pairs.first_candidates(_scored(spark, sf_dir), 5), evaluate.CHECKED_THRESHOLDS)
    return out.select("threshold", *[F.round(c, 9).alias(c) for c in ("macro_f05", "macro_precision", "macro_recall", "singleton_accuracy")], "num_pred_matches")


def reachable_recall(spark, sf_dir):
    """Recall of the true pairs whose target is in a pool of every other target."""
    _, targets, found = _pairs(spark, sf_dir)
    return evaluate.blocking_recall(adapters.truth(spark, sf_dir), found, targets.where("seq % 2 = 0"))


def seeded_negatives(spark, sf_dir):
    _, targets, found = _pairs(spark, sf_dir)
    return pairs.training_pairs(found, adapters.truth(spark, sf_dir), targets, 2, seed=42)


def sampled_pool(spark, sf_dir):
    targets = adapters.records(spark, sf_dir).where("source > 1")
    return pairs.reduced_pool(targets, adapters.truth(spark, sf_dir).selectExpr("target_id entity_id"), 50).select("entity_id")


def jaro_winkler_names(spark, sf_dir):
    return _met(spark, sf_dir).select("s1_id", "target_id", F.round(name_similarities("a_name_no_suf", "b_name_no_suf")["jw"], 6).alias("jw"))


def pair_filters(spark, sf_dir):
    c = F.col
    return _met(spark, sf_dir).select(
        "s1_id", "target_id", filters.country_agrees(c("a_country"), c("b_country")).alias("country_ok"), filters.modifiers_agree(c("a_original_name"), c("b_original_name")).alias("modifiers_ok"),
        filters.numbers_agree(filters.primary_number(c("a_original_address")), filters.primary_number(c("b_original_address"))).alias("numbers_ok"),
    )


def pair_compatible(spark, sf_dir):
    return filters.compatible(_met(spark, sf_dir)).select("s1_id", "target_id")


def pair_valid(spark, sf_dir):
    return filters.valid_pair(_met(spark, sf_dir)).select("s1_id", "target_id")


def threshold_decision(spark, sf_dir):
    return decide.matches(_scored(spark, sf_dir), 0.6, 0.65).select("s1_id", "target_id", "prob")


def top_per_source(spark, sf_dir):
    return decide.top_per_source(_scored(spark, sf_dir), 2).select("s1_id", "target_id", "prob")


def margin_to_best(spark, sf_dir):
    return decide.near_best(_scored(spark, sf_dir), 0.5, 0.08).select("s1_id", "target_id", "prob")


def compact_budget(spark, sf_dir):
    return decide.compact(_scored(spark, sf_dir), 3, 0.6).select("s1_id", "target_id", "matched")


def match_lists(spark, sf_dir):
    return decide.id_lists(_spine(spark, sf_dir).select("entity_id"), decide.matches(_scored(spark, sf_dir), 0.6))


def label_pairs(spark, sf_dir):
    return pairs.labelled(_pairs(spark, sf_dir)[2], adapters.truth(spark, sf_dir)).select("s1_id", "target_id", "label")


def training_pairs(spark, sf_dir):
    _, targets, found = _pairs(spark, sf_dir)
    return pairs.training_pairs(found, adapters.truth(spark, sf_dir), targets, 4)


def hard_negatives(spark, sf_dir):
    return pairs.hard_negatives(pairs.labelled(_scored(spark, sf_dir), adapters.truth(spark, sf_dir)), 0.5).select("s1_id", "target_id", "prob")


def systematic_pool(spark, sf_dir):
    targets = adapters.records(spark, sf_dir).where("source > 1")
    wanted = adapters.truth(spark, sf_dir).selectExpr("target_id entity_id")
    return pairs.systematic_pool(targets, wanted, 15).select("entity_id")


def entity_split(spark, sf_dir):
    training, held = pairs.entity_split(_spine(spark, sf_dir))
    return training.select("entity_id", F.lit("training").alias("part")).union(held.select("entity_id", F.lit("validation").alias("part")))


def macro_f05(spark, sf_dir):
    out = evaluate.macro_f05(_spine(spark, sf_dir), adapters.truth(spark, sf_dir), decide.matches(_scored(spark, sf_dir), 0.6))
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def blocking_recall(spark, sf_dir):
    return evaluate.blocking_recall(adapters.truth(spark, sf_dir), _pairs(spark, sf_dir)[2])


def threshold_grid(spark, sf_dir):
    out = evaluate.threshold_grid(_spine(spark, sf_dir), adapters.truth(spark, sf_dir), _scored(spark, sf_dir))
    return out.select("threshold", F.round("macro_f05", 9).alias("macro_f05"), F.round("macro_precision", 9).alias("macro_precision"), F.round("macro_recall", 9).alias("macro_recall"), "num_pred_matches")


def error_pairs(spark, sf_dir):
    return evaluate.errors(adapters.truth(spark, sf_dir), decide.matches(_scored(spark, sf_dir), 0.6))


def match_histogram(spark, sf_dir):
    return profile.match_histogram(_spine(spark, sf_dir), adapters.truth(spark, sf_dir))


def match_kinds(spark, sf_dir):
    return profile.match_kinds(_spine(spark, sf_dir), adapters.truth(spark, sf_dir))


def country_histogram(spark, sf_dir):
    return profile.histogram(adapters.records(spark, sf_dir).select("source", "country"), "country")


def missing_profile(spark, sf_dir):
    return profile.missing(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


def semi_target_filter(spark, sf_dir):
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    return orders.join(customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


def anti_split(spark, sf_dir):
    """Customers without an order whose key is divisible by four."""
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    orders = orders.where("o_orderkey % 4 = 0")
    return customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


ALL = (
    norm_names, norm_addresses, norm_extended, url_domain_stem, blocking_keys, postings_guarded, block_priority_cap, candidate_lists, tfidf_topk, block_with_tfidf, features_catalyst, features_all,
    jaro_winkler_names, pair_filters, pair_compatible, pair_valid, threshold_decision, top_per_source, margin_to_best, compact_budget, match_lists, label_pairs, training_pairs, hard_negatives,
    systematic_pool, entity_split, macro_f05, blocking_recall, threshold_grid, error_pairs, match_histogram, match_kinds, country_histogram, missing_profile, semi_target_filter, anti_split,
    string_ratios, unknown_ids, street_filter, average_candidates, run_totals, checked_thresholds, reachable_recall, seeded_negatives, sampled_pool,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_SUFFIX = "|".join(sorted(LEGAL_SUFFIXES, key=lambda s: (-len(s), s)))
_REC = rf"""
WITH RECURSIVE w0 AS (SELECT doc_id, lang, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents
), rec AS (
  SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, array_to_string(w[1:6], ' ') AS original_name,
         (doc_id % 40 + 10) || ' ' || array_to_string(w[7:12], ' ') || ' ' || (doc_id % 7 + 560000) AS original_address,
         trim(lower(coalesce(lang, ''))) AS country, doc_id % 3 + 1 AS source, doc_id, doc_id + CASE WHEN doc_id % 3 = 2 THEN 1099511627776 ELSE 0 END AS seq FROM w0
), n1 AS (
  SELECT *, trim(regexp_replace(regexp_replace(replace(lower(original_name), '&', ' and '), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name_basic,
         regexp_replace(lower(original_name), '[^a-z0-9]', '', 'g') AS name_alnum,
         trim(regexp_replace(regexp_replace(lower(original_address), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS addr_basic,
         regexp_replace(lower(original_address), '[^a-z0-9]', '', 'g') AS addr_alnum,
         array_to_string(regexp_extract_all(original_address, '[0-9]+'), '') AS addr_digits,
         regexp_extract(original_address, '\b[0-9]{{5,6}}\b') AS postal_code, regexp_extract(lower(original_address), '\b[0-9]+[a-z]?\b') AS house_num FROM rec
), n2 AS (
  SELECT *, CASE WHEN trim(regexp_replace(regexp_replace(name_basic, '\b({_SUFFIX})\b', '', 'g'), '\s+', ' ', 'g')) = '' THEN name_basic
            ELSE trim(regexp_replace(regexp_replace(name_basic, '\b({_SUFFIX})\b', '', 'g'), '\s+', ' ', 'g')) END AS name_no_suf FROM n1
), n3 AS (
  SELECT *, list_filter(string_split(name_no_suf, ' '), lambda x: x <> '') AS nt, list_filter(string_split(addr_basic, ' '), lambda x: x <> '') AS adt,
         list_filter(string_split(name_basic, ' '), lambda x: x <> '') AS bt FROM n2
), norm AS (
  SELECT *, array_to_string(list_sort(bt), ' ') AS name_sorted, array_to_string(list_sort(nt), ' ') AS name_no_suf_sorted, array_to_string(list_sort(adt), ' ') AS addr_sorted,
         array_to_string(list_transform(nt, lambda t: t[1]), '') AS name_abbr FROM n3
)"""
_KEYS = rf""", v AS (
  SELECT *, regexp_replace(name_no_suf, '[^a-z0-9]', '', 'g') AS compact, regexp_extract(lower(original_name), '\b([a-z0-9]+)\.(com|org|net|in|co|gov|edu)\b', 1) AS stem,
         list_filter(nt, lambda t: t NOT IN {_in(NAME_STOPWORDS)} AND length(t) >= 2) AS toks,
         list_filter(adt, lambda t: length(t) >= 3 AND t NOT IN {_in(ADDRESS_STOPWORDS)} AND NOT regexp_full_match(t, '[0-9]+')) AS atoks,
         list_filter(adt, lambda t: length(t) BETWEEN 2 AND 10 AND regexp_matches(t, '[0-9]') AND t NOT IN {_in(ADDRESS_STOPWORDS)}) AS codes,
         list_sort(list_distinct(list_filter(nt, lambda t: length(t) >= 2)))[1:10] AS ct, array_to_string(regexp_extract_all(addr_basic, '[0-9]+'), '_') AS anums FROM norm
), v2 AS (SELECT *, CASE WHEN house_num <> '' THEN house_num ELSE anums END AS hnum FROM v
), ks AS (
  SELECT entity_id, seq, source, 1 AS rank, 0 AS ordinal, 0 AS sub, 'name_basic' AS index_name, name_basic AS key FROM v2 WHERE name_basic <> ''
  UNION ALL SELECT entity_id, seq, source, 2, 0, 0, 'name_no_suf', name_no_suf FROM v2 WHERE name_no_suf <> ''
  UNION ALL SELECT entity_id, seq, source, 3, 0, 0, 'name_alnum', name_alnum FROM v2 WHERE name_alnum <> ''
  UNION ALL SELECT entity_id, seq, source, 4, 0, 0, 'name_no_suf_sorted', name_no_suf_sorted FROM v2 WHERE name_no_suf_sorted <> ''
  UNION ALL SELECT entity_id, seq, source, 5, 0, 0, 'name_compact', compact FROM v2 WHERE length(compact) >= 4
  UNION ALL SELECT entity_id, seq, source, 6, 0, 0, 'domain_stem', stem FROM v2 WHERE stem <> ''
  UNION ALL SELECT entity_id, seq, source, 7, 0, 0, 'name_compact', stem FROM v2 WHERE stem <> ''
  UNION ALL SELECT entity_id, seq, source, 8, i - 1, 0, 'token_pair', toks[i] || '_' || toks[i + 1] FROM (SELECT *, unnest(range(1, len(toks))) AS i FROM v2)
  UNION ALL SELECT entity_id, seq, source, 8, 0, 0, 'single_token', toks[1] FROM v2 WHERE len(toks) = 1
  UNION ALL SELECT entity_id, seq, source, 9, row_number() OVER (PARTITION BY entity_id ORDER BY i, j) - 1, 0, 'sort_pair', ct[i] || '_' || ct[j] FROM (SELECT *, unnest(range(i + 1, len(ct) + 1)) AS j FROM (SELECT *, unnest(range(1, len(ct))) AS i FROM v2))
  UNION ALL SELECT entity_id, seq, source, 10, i - 1, 0, 'addr_code', codes[i] FROM (SELECT *, unnest(range(1, len(codes) + 1)) AS i FROM v2)
  UNION ALL SELECT entity_id, seq, source, 10, i - 1, 1, 'code_token', codes[i] || '_' || toks[1] FROM (SELECT *, unnest(range(1, len(codes) + 1)) AS i FROM v2) WHERE len(toks) > 0
  UNION ALL SELECT entity_id, seq, source, 11, i - 1, 0, 'num_token', hnum || '_' || toks[i] FROM (SELECT *, unnest(range(1, least(len(toks), 4) + 1)) AS i FROM v2) WHERE hnum <> ''
  UNION ALL SELECT entity_id, seq, source, 12, 0, 0, 'num_addr_token', hnum || '_' || atoks[1] FROM v2 WHERE hnum <> '' AND len(atoks) >= 1
  UNION ALL SELECT entity_id, seq, source, 13, 0, 0, 'num_addr_pair', hnum || '_' || atoks[1] || '_' || atoks[2] FROM v2 WHERE hnum <> '' AND len(atoks) >= 2
  UNION ALL SELECT entity_id, seq, source, 14, 0, 0, 'postal_house', postal_code || '_' || hnum FROM v2 WHERE hnum <> '' AND postal_code <> ''
  UNION ALL SELECT entity_id, seq, source, 15, i - 1, 0, 'postal_token', postal_code || '_' || toks[i] FROM (SELECT *, unnest(range(1, least(len(toks), 3) + 1)) AS i FROM v2) WHERE postal_code <> ''
  UNION ALL SELECT entity_id, seq, source, 16, 0, 0, 'postal', postal_code FROM v2 WHERE length(postal_code) >= 3
  UNION ALL SELECT entity_id, seq, source, 17, i - 1, 0, 'addr_pair', atoks[i] || '_' || atoks[i + 1] FROM (SELECT *, unnest(range(1, len(atoks))) AS i FROM v2)
  UNION ALL SELECT entity_id, seq, source, 18, 0, 0, 'addr_digits', anums FROM v2 WHERE length(anums) >= 3
), sized AS (SELECT *, count(*) OVER (PARTITION BY index_name, key) AS n FROM ks WHERE source > 1
), post AS (SELECT * FROM sized WHERE n <= CASE index_name WHEN 'single_token' THEN 500 WHEN 'addr_code' THEN 300 WHEN 'postal' THEN 300 WHEN 'addr_pair' THEN 300 WHEN 'addr_digits' THEN 300 ELSE 1000000000 END)"""
_CAND = """, met AS (
  SELECT k.entity_id AS s1_id, p.entity_id AS target_id, min((k.rank, k.ordinal, k.sub, p.seq)) AS f FROM ks k JOIN post p ON k.index_name = p.index_name AND k.key = p.key WHERE k.source = 1 GROUP BY 1, 2
), cand AS (SELECT * FROM (SELECT s1_id, target_id, (row_number() OVER (PARTITION BY s1_id ORDER BY f))::INTEGER AS rank FROM met) WHERE rank <= 8
), pr AS (SELECT c.s1_id, c.target_id, c.rank, a, b FROM cand c JOIN norm a ON a.entity_id = c.s1_id JOIN norm b ON b.entity_id = c.target_id
), truth AS (SELECT 'S1-' || a.doc_id AS s1_id, 'S' || (b.doc_id % 3 + 1) || '-' || b.doc_id AS target_id FROM documents a JOIN documents b ON a.text = b.text WHERE a.doc_id % 3 = 0 AND b.doc_id % 3 <> 0
), spine AS (SELECT entity_id AS s1_id FROM rec WHERE source = 1
)"""
_JAC = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) ELSE 0 END"
_JN, _JA = _JAC.format("a.nt", "b.nt"), _JAC.format("a.adt", "b.adt")
_SCORED = f""", scored AS (SELECT s1_id, target_id, rank, round(0.55::DOUBLE * ({_JN}) + 0.3::DOUBLE * ({_JA}) + 0.15::DOUBLE * (CASE WHEN a.country = b.country AND a.country <> '' THEN 1 ELSE 0 END), 6) AS prob FROM pr)"""
_ENT = """, ent AS (
  SELECT t.threshold, s.s1_id, coalesce(g.n, 0) AS gt, coalesce(p.n, 0) AS pred, coalesce(p.tp, 0) AS tp FROM (SELECT DISTINCT s1_id FROM spine) s CROSS JOIN ths t
  LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY 1) g USING (s1_id)
  LEFT JOIN (SELECT threshold, s1_id, count(*) AS n, count(h.target_id) AS tp FROM (SELECT s1_id, target_id, threshold FROM scored, ths WHERE prob >= threshold) x LEFT JOIN truth h USING (s1_id, target_id) GROUP BY 1, 2) p ON p.s1_id = s.s1_id AND p.threshold = t.threshold
), ms AS (
  SELECT *, CASE WHEN gt = 0 AND pred = 0 THEN 1.0 WHEN gt = 0 THEN 0.0 WHEN pred = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE tp / pred END::DOUBLE AS p,
         CASE WHEN gt = 0 THEN 1.0 WHEN pred = 0 THEN 0.0 WHEN tp = 0 THEN 0.0 ELSE tp / gt END::DOUBLE AS r,
         CASE WHEN gt = 0 AND pred = 0 THEN 1.0 WHEN gt = 0 OR pred = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * (tp / pred) * (tp / gt) / (0.25 * (tp / pred) + tp / gt) END::DOUBLE AS f FROM ent)"""
_ROUNDED = "round(avg(f), 9) AS macro_f05, round(avg(p), 9) AS macro_precision, round(avg(r), 9) AS macro_recall"


def _exact(x: str) -> str:
    return f"CASE WHEN a.{x} = b.{x} AND a.{x} <> '' THEN 1.0 ELSE 0.0 END::DOUBLE"


def _features_sql() -> str:
    known = lambda e: f"CASE WHEN b.addr_basic = '' THEN 0.0 ELSE {e} END::DOUBLE"
    lens = lambda x: (f"abs(length(a.{x}) - length(b.{x}))::DOUBLE", f"CASE WHEN greatest(length(a.{x}), length(b.{x})) > 0 THEN least(length(a.{x}), length(b.{x})) / greatest(length(a.{x}), length(b.{x})) ELSE 0 END")
    chars = ("list_distinct(string_split(a.addr_digits, ''))", "list_distinct(string_split(b.addr_digits, ''))")
    columns = {
        "name_basic_exact": _exact("name_basic"), "name_nosuf_exact": _exact("name_no_suf"), "name_sorted_exact": _exact("name_no_suf_sorted"),
        "name_first_token_exact": "coalesce(a.nt[1] = b.nt[1], false)::INT::DOUBLE", "name_last_token_exact": "coalesce(a.nt[-1] = b.nt[-1], false)::INT::DOUBLE",
        "name_token_jaccard": f"round(({_JN})::DOUBLE, 9)", "name_common_tokens": "len(list_intersect(a.nt, b.nt))::DOUBLE", "name_len_diff": lens("name_no_suf")[0], "name_len_ratio": f"round(({lens('name_no_suf')[1]})::DOUBLE, 9)",
        "name_abbr_match": "CASE WHEN a.name_abbr = b.name_abbr AND length(a.name_abbr) >= 2 THEN 1.0 ELSE 0.0 END::DOUBLE",
        "addr_basic_exact": known(_exact("addr_basic")), "addr_token_jaccard": f"round(({known(_JA)}), 9)", "addr_common_tokens": known("len(list_intersect(a.adt, b.adt))"),
        "addr_digits_common": known(f"len(list_intersect({chars[0]}, {chars[1]}))"), "addr_digits_jaccard": f"round({known(_JAC.format(*chars))}, 9)",
        "postal_code_exact": known(_exact("postal_code")), "house_num_exact": known(_exact("house_num")), "addr_len_diff": known(lens("addr_basic")[0]), "addr_len_ratio": f"round({known(lens('addr_basic')[1])}, 9)",
        "addr_missing": "(b.addr_basic = '')::INT::DOUBLE", "country_exact": _exact("country"), "is_s2": "starts_with(target_id, 'S2-')::INT::DOUBLE", "is_s3": "starts_with(target_id, 'S3-')::INT::DOUBLE",
    }
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


def _extended_sql() -> str:
    address = "addr_basic"
    for word, short in ADDRESS_ABBREVIATIONS:
        address = f"regexp_replace({address}, '\\b{word}\\b', '{short}', 'g')"
    return rf""", ex AS (SELECT *, trim(regexp_replace({address}, '\s+', ' ', 'g')) AS short_address, regexp_extract(original_address, '\b[0-9]{{6}}\b') AS six, regexp_extract(original_address, '\b[0-9]{{5}}\b') AS five FROM norm)
SELECT entity_id, name_basic, name_no_suf, name_alnum, name_sorted, name_no_suf_sorted, name_abbr, short_address AS addr_basic, CASE WHEN six <> '' THEN six ELSE five END AS postal_code, addr_digits, house_num FROM ex"""


_EXTENDED = _extended_sql()


def _string_pairs() -> str:
    """sp: the candidate pairs with sorted tokens and token sets of names (n) and addresses (d); lcs: longest common subsequences, bit-parallel, of all string pairs that the ratios compare."""
    parts = []
    for p, view, tokens in (("n", "name_no_suf", "nt"), ("d", "addr_basic", "adt")):
        x, y = f"list_distinct(a.{tokens})", f"list_distinct(b.{tokens})"
        joined = lambda e: f"array_to_string(list_sort({e}), ' ')"
        both, mine, theirs = joined(f"list_intersect({x}, {y})"), joined(f"list_filter({x}, lambda t: NOT list_contains({y}, t))"), joined(f"list_filter({y}, lambda t: NOT list_contains({x}, t))")
        parts.append(f"a.{view} AS {p}_a, b.{view} AS {p}_b, {joined('a.' + tokens)} AS {p}_sa, {joined('b.' + tokens)} AS {p}_sb, {both} AS {p}_c, {mine} AS {p}_x, {theirs} AS {p}_y, trim({both} || ' ' || {mine}) AS {p}_ta, trim({both} || ' ' || {theirs}) AS {p}_tb")
    compared = " UNION ".join(f"SELECT {p}_{x} AS a, {p}_{y} AS b FROM sp" for p in "nd" for x, y in (("a", "b"), ("sa", "sb"), ("ta", "tb"), ("c", "ta"), ("c", "tb")))
    full = "((1::HUGEINT << length(a)::INTEGER) - 1)"
    return f""", sp AS (SELECT *, {", ".join(parts)} FROM pr
), lc AS (
  SELECT DISTINCT a, b, 0 AS i, {full} AS s FROM ({compared}) WHERE a <> '' AND b <> ''
  UNION ALL
  SELECT a, b, i + 1, ((s + (s & m)) | (s - (s & m))) & {full}
  FROM (SELECT *, list_sum(list_transform(range(length(a)), lambda k: CASE WHEN substring(a, k + 1, 1) = substring(b, i + 1, 1) THEN 1::HUGEINT << k::INTEGER ELSE 0::HUGEINT END))::HUGEINT AS m FROM lc WHERE i < length(b))
), lcs AS (SELECT a, b, 2.0::DOUBLE * (length(a) - bit_count(s)) / (length(a) + length(b)) AS r FROM lc WHERE i = length(b))"""


def _ratio(kind: str, p: str) -> str:
    look = lambda x, y: f"coalesce((SELECT max(r) FROM lcs WHERE lcs.a = {p}_{x} AND lcs.b = {p}_{y}), 0.0)"
    own = {
        "ratio": look("a", "b"),
        "sort": look("sa", "sb"),
        "set": f"CASE WHEN {p}_c <> '' AND ({p}_x = '' OR {p}_y = '') THEN 1.0 ELSE greatest({look('ta', 'tb')}, {look('c', 'ta')}, {look('c', 'tb')}) END",
    }[kind]
    return f"(CASE WHEN {p}_a = '' OR {p}_b = '' THEN 0.0 WHEN {p}_a = {p}_b THEN 1.0 ELSE {own} END)"


def oracle_sql() -> dict[str, str]:
    cand = _REC + _KEYS + _CAND
    scored = cand + _SCORED
    digits = "regexp_replace({0}.house_num, '[^0-9]', '', 'g')"
    numbers = f"(a.house_num = '' OR b.house_num = '' OR a.house_num = b.house_num OR ({digits.format('a')} <> '' AND {digits.format('a')} = {digits.format('b')}) OR (abs(length(a.house_num) - length(b.house_num)) = 1 AND (starts_with(a.house_num, b.house_num) OR starts_with(b.house_num, a.house_num))))"
    street = "list_filter(regexp_extract_all(lower({0}.original_address), '[a-z]{{4,}}'), lambda t: t NOT IN " + _in(STREET_STOPWORDS) + ")"
    streets = f"(len({street.format('a')}) = 0 OR len({street.format('b')}) = 0 OR list_has_any({street.format('a')}, {street.format('b')}))"
    mods = "list_sort(list_distinct(list_filter(regexp_extract_all(lower({0}.original_name), '[a-z]+'), lambda t: t IN " + _in(MODIFIERS) + ")))"
    gram = """, wd AS (SELECT entity_id, seq, source, ' ' || unnest(nt) || ' ' AS p FROM norm
), gs AS (SELECT entity_id, seq, source, unnest(list_transform(range(1, greatest(length(p) - 2, 1) + 1), lambda i: substring(p, i, 3))) AS g FROM wd
  UNION ALL SELECT entity_id, seq, source, unnest(list_transform(range(1, greatest(length(p) - 3, 1) + 1), lambda i: substring(p, i, 4))) FROM wd WHERE length(p) > 3
), tf AS (SELECT entity_id, seq, source, g, count(*) AS tf FROM gs GROUP BY ALL
), voc AS (SELECT g, ln((1.0::DOUBLE + (SELECT count(*) FROM norm WHERE source > 1)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tf WHERE source > 1 GROUP BY g HAVING count(*) >= 5 ORDER BY sum(tf) DESC, g LIMIT 100000
), raw AS (SELECT entity_id, seq, source, g, tf * idf AS w FROM tf JOIN voc USING (g)
), nw AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS u FROM raw
), cs AS (SELECT a.entity_id AS s1_id, b.entity_id AS target_id, b.seq, round(sum(a.u * b.u), 9) AS cosine FROM nw a JOIN nw b USING (g) WHERE a.source = 1 AND b.source > 1 GROUP BY ALL HAVING round(sum(a.u * b.u), 9) >= 0.15)"""
    return {
        "norm_names": _REC + " SELECT entity_id, name_basic, name_alnum, name_no_suf, name_sorted, name_no_suf_sorted, name_abbr FROM norm",
        "norm_addresses": _REC + " SELECT entity_id, addr_basic, addr_alnum, addr_sorted, addr_digits, postal_code, house_num, country FROM norm",
        "url_domain_stem": r"SELECT page_id, regexp_extract(lower(coalesce(url, '')), '\b([a-z0-9]+)\.(com|org|net|in|co|gov|edu)\b', 1) AS stem FROM pages",
        "blocking_keys": _REC + _KEYS + " SELECT entity_id, rank::INTEGER AS rank, ordinal::INTEGER AS ordinal, sub::INTEGER AS sub, index_name, key FROM ks WHERE source = 1",
        "postings_guarded": _REC + _KEYS + " SELECT index_name, key, least(count(DISTINCT entity_id), 8) AS n, min(seq) AS first_seq FROM post GROUP BY index_name, key",
        "block_priority_cap": cand + " SELECT * FROM cand",
        "candidate_lists": cand + " SELECT s.s1_id AS source1_entity_id, coalesce(string_agg(c.target_id, ',' ORDER BY c.target_id), '') AS candidate_entity_ids FROM spine s LEFT JOIN cand c ON c.s1_id = s.s1_id GROUP BY s.s1_id",
        "tfidf_topk": _REC + gram + " SELECT s1_id, target_id, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY cosine DESC, seq) AS k FROM cs) WHERE k <= 5",
        "features_catalyst": cand + f" SELECT s1_id, target_id, {_features_sql()} FROM pr",
        "jaro_winkler_names": cand + " SELECT s1_id, target_id, CASE WHEN a.name_no_suf = '' OR b.name_no_suf = '' THEN 0.0 ELSE round(jaro_winkler_similarity(a.name_no_suf, b.name_no_suf), 6) END::DOUBLE AS jw FROM pr",
        "pair_filters": cand + f" SELECT s1_id, target_id, (a.country = '' OR b.country = '' OR a.country = b.country) AS country_ok, ({mods.format('a')} = {mods.format('b')}) AS modifiers_ok, (x = '' OR y = '' OR x = y OR (dx <> '' AND dx = dy) OR (abs(length(x) - length(y)) = 1 AND (starts_with(x, y) OR starts_with(y, x)))) AS numbers_ok FROM (SELECT *, a.house_num AS x, b.house_num AS y, regexp_replace(a.house_num, '[^0-9]', '', 'g') AS dx, regexp_replace(b.house_num, '[^0-9]', '', 'g') AS dy FROM pr)",
        "threshold_decision": scored + " SELECT s1_id, target_id, prob FROM scored WHERE prob >= CASE WHEN starts_with(target_id, 'S2-') THEN 0.6 ELSE 0.65 END",
        "top_per_source": scored + " SELECT s1_id, target_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, target_id[1:3] ORDER BY prob DESC, target_id) AS k FROM scored) WHERE k <= 2",
        "margin_to_best": scored + " SELECT s1_id, target_id, prob FROM (SELECT *, max(prob) OVER (PARTITION BY s1_id) AS m FROM scored) WHERE prob >= 0.5 AND m - prob <= 0.08::DOUBLE",
        "compact_budget": scored + " SELECT s1_id, target_id, matched FROM (SELECT *, count(*) FILTER (WHERE matched) OVER (PARTITION BY s1_id) AS m, row_number() OVER (PARTITION BY s1_id ORDER BY matched DESC, prob DESC, target_id) AS k FROM (SELECT *, prob >= 0.6 AS matched FROM scored)) WHERE matched OR k <= greatest(m, 3)",
        "match_lists": scored + " SELECT s.s1_id AS source1_entity_id, coalesce(string_agg(c.target_id, ',' ORDER BY c.target_id), '') AS matched_entity_ids FROM spine s LEFT JOIN (SELECT * FROM scored WHERE prob >= 0.6) c ON c.s1_id = s.s1_id GROUP BY s.s1_id",
        "label_pairs": cand + " SELECT c.s1_id, c.target_id, (t.s1_id IS NOT NULL)::INTEGER AS label FROM cand c LEFT JOIN truth t USING (s1_id, target_id)",
        "training_pairs": cand + " SELECT s1_id, target_id, 1 AS label FROM truth WHERE s1_id IN (SELECT s1_id FROM cand) UNION ALL SELECT s1_id, target_id, 0 FROM (SELECT c.*, row_number() OVER (PARTITION BY c.s1_id ORDER BY rank, c.target_id) AS k FROM cand c ANTI JOIN truth t USING (s1_id, target_id)) WHERE k <= 4",
        "hard_negatives": scored + " SELECT s1_id, target_id, prob FROM scored ANTI JOIN truth USING (s1_id, target_id) WHERE prob >= 0.5",
        "systematic_pool": cand + " SELECT entity_id FROM rec WHERE source > 1 AND (seq % 15 = 0 OR entity_id IN (SELECT target_id FROM truth))",
        "macro_f05": scored + ", ths AS (SELECT 0.6::DOUBLE AS threshold)" + _ENT + f" SELECT {_ROUNDED}, round(coalesce(count(*) FILTER (WHERE gt = 0 AND pred = 0) / nullif(count(*) FILTER (WHERE gt = 0), 0), 1.0), 9)::DOUBLE AS singleton_accuracy, count(*) AS num_entities, sum(gt)::BIGINT AS num_gt_matches, sum(pred)::BIGINT AS num_pred_matches, count(*) FILTER (WHERE gt = 0) AS num_singletons, count(*) FILTER (WHERE gt = 0 AND pred = 0) AS singleton_correct FROM ms",
        "blocking_recall": cand + " SELECT count(*) AS num_true, count(c.rank) AS num_found, coalesce(count(c.rank) / nullif(count(*), 0), 1.0)::DOUBLE AS recall FROM truth LEFT JOIN cand c USING (s1_id, target_id)",
        "threshold_grid": scored + ", ths AS (SELECT round(0.5 + 0.02 * k, 2)::DOUBLE AS threshold FROM range(24) t(k))" + _ENT + f" SELECT threshold, {_ROUNDED}, sum(pred)::BIGINT AS num_pred_matches FROM ms GROUP BY threshold",
        "error_pairs": scored + ", er AS (SELECT 'false positive' AS kind, s1_id, target_id FROM (SELECT * FROM scored WHERE prob >= 0.6) ANTI JOIN truth USING (s1_id, target_id) UNION ALL SELECT 'false negative', s1_id, target_id FROM truth ANTI JOIN (SELECT * FROM scored WHERE prob >= 0.6) USING (s1_id, target_id)) SELECT kind, s1_id, target_id FROM er JOIN (SELECT kind, s1_id, coalesce(sum(n) OVER (PARTITION BY kind ORDER BY s1_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT kind, s1_id, count(*) AS n FROM er GROUP BY 1, 2)) USING (kind, s1_id) WHERE before < 5",
        "match_histogram": cand + ", h AS (SELECT s.s1_id, count(t.target_id) AS matches FROM spine s LEFT JOIN truth t USING (s1_id) GROUP BY 1) SELECT matches, count(*) AS entities, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct FROM h GROUP BY matches",
        "match_kinds": cand + ", h AS (SELECT s.s1_id, count(t.target_id) AS n FROM spine s LEFT JOIN truth t USING (s1_id) GROUP BY 1) SELECT count(*) FILTER (WHERE n = 0) AS singletons, count(*) FILTER (WHERE n = 1) AS single, count(*) FILTER (WHERE n > 1) AS multi, (SELECT count(*) FROM truth WHERE starts_with(target_id, 'S2-')) AS s2_matches, (SELECT count(*) FROM truth WHERE starts_with(target_id, 'S3-')) AS s3_matches FROM h",
        "country_histogram": "SELECT lang AS country, count(*) AS n FROM documents GROUP BY lang",
        "missing_profile": "SELECT count(*) AS rows, c AS \"column\", count(*) FILTER (WHERE v IS NULL OR v IN " + _in(MISSING) + ") AS missing, 100.0::DOUBLE * count(*) FILTER (WHERE v IS NULL OR v IN " + _in(MISSING) + ") / count(*) AS pct FROM (SELECT 'lang' AS c, lang AS v FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'text', text FROM documents) GROUP BY c",
        "semi_target_filter": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
        "anti_split": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 0)",
        "norm_extended": _REC + _EXTENDED,
        "string_ratios": cand + _string_pairs() + " SELECT s1_id, target_id, " + ", ".join(f"round({_ratio(k, p)}, 9)::DOUBLE AS {y}_{k}" for p, y in (("n", "name"), ("d", "addr")) for k in ("ratio", "sort", "set")) + " FROM sp",
        "pair_compatible": cand + _string_pairs() + f" SELECT s1_id, target_id FROM sp WHERE (a.country = '' OR b.country = '' OR a.country = b.country) AND {mods.format('a')} = {mods.format('b')} AND {numbers} AND NOT (a.addr_basic <> '' AND b.addr_basic <> '' AND {_ratio('sort', 'd')} < 0.25 AND {_ratio('set', 'd')} < 0.35)",
        "pair_valid": cand + f" SELECT s1_id, target_id FROM pr WHERE {mods.format('a')} = {mods.format('b')} AND {numbers} AND {streets}",
        "street_filter": cand + f" SELECT s1_id, target_id, {streets} AS streets_ok FROM pr",
        "unknown_ids": cand + " SELECT s1_id, target_id, 0.0::DOUBLE AS total FROM pr WHERE b.seq % 3 = 0",
        "block_with_tfidf": cand + gram + """, late AS (SELECT s1_id, entity_id AS target_id, (19, k::INTEGER, 0, seq) AS f FROM (SELECT s1_id, target_id AS entity_id, seq, row_number() OVER (PARTITION BY s1_id ORDER BY cosine DESC, seq) AS k FROM cs) WHERE k <= 5
), joint AS (SELECT s1_id, target_id, min(f) AS f FROM (SELECT s1_id, target_id, f FROM met UNION ALL SELECT s1_id, target_id, f FROM late) GROUP BY 1, 2)
SELECT s1_id, target_id, rank FROM (SELECT s1_id, target_id, (row_number() OVER (PARTITION BY s1_id ORDER BY f))::INTEGER AS rank FROM joint) WHERE rank <= 8""",
        "entity_split": _REC + " SELECT entity_id, CASE WHEN k <= least(20000, greatest(1, floor(n * 0.2::DOUBLE))) THEN 'validation' ELSE 'training' END AS part FROM (SELECT entity_id, row_number() OVER (ORDER BY md5('42:' || entity_id), entity_id) AS k, count(*) OVER () AS n FROM rec WHERE source = 1)",
        "average_candidates": cand + " SELECT count(*) AS num_entities, sum(n)::BIGINT AS num_pairs, avg(n) AS avg_candidates FROM (SELECT s.s1_id, count(c.target_id) AS n FROM spine s LEFT JOIN cand c ON c.s1_id = s.s1_id GROUP BY 1)",
        "run_totals": scored + """, e AS (SELECT s.s1_id, count(c.target_id) AS n, count(c.target_id) FILTER (WHERE prob >= 0.6) AS m FROM spine s LEFT JOIN scored c ON c.s1_id = s.s1_id GROUP BY 1)
SELECT count(*) AS num_entities, count(*) FILTER (WHERE m > 0) AS num_matched, count(*) FILTER (WHERE m = 0) AS num_singletons, sum(n)::BIGINT AS num_scored_pairs, sum(m)::BIGINT AS num_matched_pairs, sum(least(n, greatest(m, 3)))::BIGINT AS num_kept_pairs,
       round(count(*) FILTER (WHERE m = 0) / count(*), 9)::DOUBLE AS singleton_share, round(avg(n), 9)::DOUBLE AS avg_scored, round(avg(m), 9)::DOUBLE AS avg_matched, round(avg(least(n, greatest(m, 3))), 9)::DOUBLE AS avg_kept FROM e""",
        "checked_thresholds": cand + _SCORED.replace(" AS prob FROM pr)", " AS prob FROM pr WHERE rank <= 5)") + ", ths AS (SELECT unnest([0.65, 0.7, 0.75, 0.78, 0.8, 0.85])::DOUBLE AS threshold)" + _ENT + f" SELECT threshold, {_ROUNDED}, round(coalesce(count(*) FILTER (WHERE gt = 0 AND pred = 0) / nullif(count(*) FILTER (WHERE gt = 0), 0), 1.0), 9)::DOUBLE AS singleton_accuracy, sum(pred)::BIGINT AS num_pred_matches FROM ms GROUP BY threshold",
        "reachable_recall": cand + " SELECT count(*) AS num_true, count(c.rank) AS num_found, coalesce(count(c.rank) / nullif(count(*), 0), 1.0)::DOUBLE AS recall FROM (SELECT t.* FROM truth t JOIN rec r ON r.entity_id = t.target_id WHERE r.seq % 2 = 0) t LEFT JOIN cand c USING (s1_id, target_id)",
        "seeded_negatives": cand + " SELECT s1_id, target_id, 1 AS label FROM truth WHERE s1_id IN (SELECT s1_id FROM cand) UNION ALL SELECT s1_id, target_id, 0 FROM (SELECT c.*, row_number() OVER (PARTITION BY c.s1_id ORDER BY md5('42:' || c.s1_id || ':' || c.target_id), c.target_id) AS k FROM cand c ANTI JOIN truth t USING (s1_id, target_id)) WHERE k <= 2",
        "sampled_pool": cand + " SELECT entity_id FROM (SELECT entity_id, row_number() OVER (ORDER BY md5('42:' || entity_id), entity_id) AS k FROM rec WHERE source > 1) WHERE k <= 50 OR entity_id IN (SELECT target_id FROM truth)",
    }
