import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions import similarity as S
from tessera.functions.wordlists import FEATURES
from tessera.operators import blocking, decide, evaluate, filters, pairs
from tessera.operators.features import pair_features, with_records
from tessera.sources import tsv, validate

COLUMNS = "entity_id string, business_name string, business_address string, country string, seq long"


def frame(spark, rows):
    return N.normalized(spark.createDataFrame(rows, COLUMNS), True)


def test_normalization(spark):
    rows = [("a", "A&B Traders", "मकान १२३ 560001", "IN\n", 1), ("b", "Tech Orchid Pvt Ltd", "B12 Lane", None, 2), ("c", "Group Holdings", None, "FR", 3), ("d", "NA", "12a Road", "", 4), ("e", "Café Nord", "", "x", 5)]
    r = {x.entity_id: x for x in frame(spark, rows).collect()}
    assert (r["a"].name_basic, r["a"].name_alnum) == ("a and b traders", "abtraders")
    assert (r["a"].addr_digits, r["a"].postal_code, r["a"].house_num, r["a"].country) == ("१२३560001", "560001", "१२३", "in")
    assert r["b"].name_no_suf == "orchid" and r["b"].house_num == ""
    assert r["c"].name_no_suf == "group holdings" and r["c"].original_address == ""
    assert r["d"].name_basic == "" and r["d"].house_num == "12a" and r["e"].name_basic == "caf nord"


def test_numbers_in_mixed_scripts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("12345a é१क_- ") for _ in range(14)) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.postal_code(F.col("t")).alias("p"), N.house_number(F.col("t")).alias("h")).collect()
    for r in got:
        p, h = re.search(r"\b\d{5,6}\b", r.t), re.search(r"\b\d+[a-z]?\b", r.t.lower())
        assert (r.p, r.h) == (p.group() if p else "", h.group() if h else "")


def test_similarities():
    def slow(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in "ab")
        assert S.lcs(a, b) == slow(a, b)
    assert round(S.jaro_winkler("martha", "marhta"), 4) == 0.9611 and S.jaro_winkler("abcd", "axyz") == 0.5
    assert S.token_set_ratio("a b", "a b c") == 1.0 and S.token_sort_ratio("b a", "a b") == 1.0 and S.partial_ratio("abc", "xxabcx") == 1.0


def test_cap_equals_sequential_probing(spark):
    rng = random.Random(5)
    words = "red blue green iron stone river north mill trade".split()
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
    address = lambda: f"{rng.randint(1, 4)} {rng.choice(words)} {rng.choice(words)} {rng.choice(['560001', ''])}"
    s = frame(spark, [(f"S1-{k}", name(), address(), "x", k) for k in range(15)]).drop("seq")
    t = frame(spark, [(f"S2-{k}", name(), address(), "x", k) for k in range(60)])
    built, probes = {}, {}
    for r in blocking.keys(t, False).orderBy("seq").collect():
        built.setdefault((r["index"], r["key"]), []).append((r.seq, r.entity_id))
    for r in blocking.keys(s, True).collect():
        probes.setdefault(r.entity_id, []).append((r["rank"], r["ordinal"], r["sub"], r["index"], r["key"]))
    for cap in (2, 8):
        got = {}
        for r in blocking.candidates(s, t, cap).orderBy("rank").collect():
            got.setdefault(r.s1_id, []).append(r.target_id)
        for own, found in probes.items():
            seen = []
            for *_, index, key in sorted(found):
                posting = built.get((index, key), [])
                if len(posting) <= blocking.GUARDS.get(index, 10**9):
                    seen += [i for _, i in sorted(posting)]
            assert got.get(own, []) == list(dict.fromkeys(seen))[:cap]


def test_guards(spark):
    for n, some in ((300, True), (301, False)):
        t = frame(spark, [(f"S2-{k}", f"n{k}", "77 q", "x", k) for k in range(n)])
        found = blocking.postings(t, 5).where("index = 'addr_code' AND key = '77'")
        assert (found.count() > 0) == some


def test_tfidf_without_frequent_grams(spark):
    a = frame(spark, [("S2-1", "abc", "", "", 1)])
    assert blocking.tfidf_top(a.drop("seq"), a).count() == 0


def test_features(spark):
    s = frame(spark, [("S1-1", "Acme Stone Ltd", "12 Mill Road 560001", "in", 1)])
    t = frame(spark, [("S2-1", "Acme Stone", "12 Mill Road 560001", "in", 1), ("S3-2", "Other", None, "fr", 2)])
    rows = {r.target_id: r for r in pair_features(with_records(spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-2"), ("S1-1", "S2-9")], "s1_id string, target_id string"), s, t)).collect()}
    assert len(rows) == 2 and len(FEATURES) == 39
    one, two = rows["S2-1"], rows["S3-2"]
    assert one.name_nosuf_exact == one.name_fuzz_ratio == one.addr_jaro_winkler == one.is_s2 == one.name_exact_and_addr_high == 1
    assert two.addr_missing == 1 and two.addr_len_diff == two.addr_fuzz_ratio == 0 and two.is_s3 == 1


def test_filters(spark):
    rows = spark.createDataFrame([("12", "123"), ("12", "13"), ("", "5"), ("12a", "12"), ("12", "1234")], "a string, b string")
    assert [r[0] for r in rows.select(filters.numbers_agree(F.col("a"), F.col("b"))).collect()] == [True, False, True, True, False]
    rows = spark.createDataFrame([("West Motors", "Motors"), ("Motors x", "motors y")], "a string, b string")
    assert [r[0] for r in rows.select(filters.modifiers_agree(F.col("a"), F.col("b"))).collect()] == [False, True]


def test_f05(spark):
    make = lambda rows: spark.createDataFrame(rows, "s1_id string, target_id string")
    spine = spark.createDataFrame([("w",), ("ok",), ("merged",), ("missed",), ("apart",)], "s1_id string")
    truth = make([("w", "a"), ("w", "c"), ("missed", "x"), ("apart", "x")])
    predicted = make([("w", "a"), ("w", "b"), ("w", "c"), ("merged", "q"), ("apart", "y")])
    got = {r.s1_id: (round(r.precision, 3), r.recall, round(r.f05, 3)) for r in evaluate.per_entity(spine, truth, predicted).collect()}
    assert got == {"w": (0.667, 1, 0.714), "ok": (1, 1, 1), "merged": (0, 1, 0), "missed": (1, 0, 0), "apart": (0, 0, 0)}


def test_decisions(spark):
    scored = spark.createDataFrame([("s", "S2-1", 0.95), ("s", "S2-2", 0.9), ("s", "S3-1", 0.8), ("s", "S3-2", 0.5)], "s1_id string, target_id string, prob double")
    ids = lambda df: {r.target_id for r in df.collect()}
    assert ids(decide.near_best(scored)) == {"S2-1", "S2-2"}
    assert ids(decide.top_per_source(scored, 1)) == {"S2-1", "S3-1"}
    assert ids(decide.compact(scored, 3, 0.9)) == {"S2-1", "S2-2", "S3-1"}


def test_split_and_negatives(spark):
    s = spark.createDataFrame([(f"S1-{k}", k) for k in range(50)], "entity_id string, seq long")
    a, b = pairs.entity_split(s)
    assert (a.count(), b.count()) == (40, 10) and a.join(b, "entity_id").count() == 0
    found = spark.createDataFrame([("S1-1", f"S2-{k}", k) for k in range(9)], "s1_id string, target_id string, rank int")
    truth = spark.createDataFrame([("S1-1", "S2-3"), ("S1-1", "S2-77"), ("S1-1", "S2-88")], "s1_id string, target_id string")
    pool = spark.createDataFrame([(f"S2-{k}",) for k in (*range(9), 77)], "entity_id string")
    assert sorted((r.target_id, r.label) for r in pairs.training_pairs(found, truth, pool).collect()) == [("S2-0", 0), ("S2-1", 0), ("S2-2", 0), ("S2-3", 1), ("S2-4", 0), ("S2-77", 1)]


@pytest.mark.parametrize(("text", "errors", "warnings"), [
    ("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n", 0, 2),
    ("source1_entity_id,matched_entity_ids\n", 1, 2),
    ("wrong\theader\n", 1, 2),
    ("source1_entity_id\tmatched_entity_ids\nS1-1 S2-1\nS1-2\t\n", 2, 2),
    ("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\nS1-2\t\nS1-2\t\n", 2, 2),
    ("source1_entity_id\tmatched_entity_ids\nS1-1\tS1-2,9\nS1-3\t\n", 4, 2),
])
def test_validation(spark, tmp_path, text, errors, warnings):
    (tmp_path / "m.tsv").write_text(text)
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    report = validate.validate(spark, str(tmp_path / "m.tsv"), None, required)
    assert (len(report.errors), len(report.warnings), report.exit_code) == (errors, warnings, int(errors > 0))


def test_files(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA\t"1 ""Main"" St"\tUS\n')
    assert tsv.read_source(spark, str(tmp_path / "s.tsv")).first().business_address == '1 "Main" St'
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-2", 1), ("S1-2", "", 2)], "source1_entity_id string, matched_entity_ids string, seq long")
    tsv.replace(spark, lists, str(tmp_path / "out"))
    tsv.replace(spark, lists, str(tmp_path / "out"))
    body = (tmp_path / "out").read_text()
    assert body.count("S1-2\t\n") == 1 and "S1-1\tS2-1,S2-2\n" in body
    spine, truth = tsv.read_truth(spark, str(tmp_path / "out"))
    assert (spine.count(), truth.count()) == (2, 2)


def test_entry_needs_no_training_package(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
