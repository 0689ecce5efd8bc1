"""Whole plans: classifiers, inference from files to files, experiments, streaming, the command line."""

import csv
import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.__main__ import main
from tessera.functions import normalize as N
from tessera.functions import similarity as S
from tessera.functions.wordlists import FEATURES
from tessera.operators import evaluate, models, pairs
from tessera.operators.features import pair_features, with_records
from tessera.plans import resolve
from tessera.sources import files, tsv, validate
from tessera.streaming.score import score_stream

WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty knoll lagoon meadow nectar orchard prairie quarry ridge summit timber".split()
SMALL = {"logistic_regression": {"maxIter": 20}, "random_forest": {"numTrees": 5, "maxDepth": 4}, "extra_trees": {"numTrees": 5, "maxDepth": 4}} | {k: {"maxIter": 3, "maxDepth": 3} for k in ("xgboost", "lightgbm", "catboost")}


def world(n, seed):
    """Records of three sources, and the truth: each source entity has a few matches with small changes, some have none."""
    rng = random.Random(seed)
    out, truth = {1: [], 2: [], 3: []}, {}
    for k in range(n):
        name, street = " ".join(rng.sample(WORDS, 3)), f"{rng.randint(10, 99)} {rng.choice(WORDS)} road {rng.randint(560000, 560400)}"
        out[1].append((f"S1-{seed}{k}", f"{name.title()} Ltd", street, "IN"))
        truth[f"S1-{seed}{k}"] = []
        for t in (2, 3):
            if rng.random() < 0.7:
                own = name if rng.random() < 0.6 else name.replace("a", "e", 1)
                out[t].append((f"S{t}-{seed}{k}", own, street if rng.random() < 0.8 else "", "IN"))
                truth[f"S1-{seed}{k}"].append(f"S{t}-{seed}{k}")
            out[t].append((f"S{t}-{seed}{k}x", " ".join(rng.sample(WORDS, 2)), f"{rng.randint(10, 99)} x street", "IN"))
    return out, truth


def write(folder, tables, truth, prefix):
    folder.mkdir()
    for k, rows in tables.items():
        (folder / f"{prefix}_source{k}.tsv").write_text("".join("\t".join(r) + "\n" for r in [("entity_id", "business_name", "business_address", "country"), *rows]))
    (folder / f"{prefix}_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"{s}\t{','.join(t)}\n" for s, t in truth.items()))
    return folder


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    return {p: (write(root / p, *world(60, s), p), world(60, s)[1]) for p, s in (("train", 1), ("test", 2))}


@pytest.fixture(scope="module")
def sides(spark, data):
    folder, truth = data["train"]
    sources = N.normalized(tsv.with_order(tsv.read_source(spark, str(folder / "train_source1.tsv"))), True)
    targets = N.normalized(tsv.targets(*[tsv.read_source(spark, str(folder / f"train_source{k}.tsv")) for k in (2, 3)]), True)
    return sources.persist(), targets.persist(), tsv.read_truth(spark, str(folder / "train_ground_truth.tsv"))[1].persist()


@pytest.fixture(scope="module")
def rows(sides):
    sources, targets, truth = sides
    found = resolve.block(sources, targets, 8, use_tfidf=False)
    return pair_features(with_records(pairs.training_pairs(found, truth, targets), sources, targets)).persist()


@pytest.mark.parametrize("kind", models.MODELS)
def test_classifiers(spark, rows, tmp_path, kind):
    model = models.train(rows, kind, **SMALL[kind])
    scored = models.score(model, rows).persist()
    assert set(scored.columns) == {"s1_id", "target_id", "label", "prob"}
    means = {r.label: r.m for r in scored.groupBy("label").agg(F.avg("prob").alias("m")).collect()}
    assert means[1] > 0.7 > 0.3 > means[0]
    models.save(model, str(tmp_path / "m"))
    again = models.score(models.load(str(tmp_path / "m")), rows)
    assert again.join(scored.withColumnRenamed("prob", "p"), ["s1_id", "target_id", "label"]).where("abs(prob - p) > 1e-12").count() == 0


def test_unknown_kind():
    with pytest.raises(ValueError, match="unknown model"):
        models.classifier("oracle")


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_alone(rows, tmp_path, label):
    model = models.train(rows.where(F.col("label") == label), "xgboost")
    models.save(model, str(tmp_path / "m"))
    assert {r.prob for r in models.score(models.load(str(tmp_path / "m")), rows).collect()} == {1.0}


def test_unknown_records_have_no_features(spark, sides):
    sources, targets, _ = sides
    found = spark.createDataFrame([("S1-10", "S2-nowhere"), ("S1-nowhere", "S2-10")], "s1_id string, target_id string")
    assert with_records(found, sources, targets).count() == 0
    got = pair_features(with_records(found, sources, targets, keep_unknown=True)).collect()
    assert len(got) == 2 and all(r[f] == 0 for r in got for f in FEATURES)


def test_last_record_wins_without_an_order(spark, sides):
    sources, targets, _ = sides
    double = targets.drop("seq").unionByName(targets.drop("seq").withColumn("name_basic", F.lit("zzz")))
    found = spark.createDataFrame([("S1-10", "S2-10x")], "s1_id string, target_id string")
    assert {with_records(found, sources, x).first().b_name_basic for x in (double, double.repartition(7))} == {"zzz"}


def test_inference_from_files_to_files(spark, data, tmp_path, capsys):
    (train, _), (test, truth) = data["train"], data["test"]
    given = (*[str(train / f"train_source{k}.tsv") for k in (1, 2, 3)], str(train / "train_ground_truth.tsv"))
    resolve.run_inference(spark, given, tuple(str(test / f"test_source{k}.tsv") for k in (1, 2, 3)), str(tmp_path), "random_forest", use_tfidf=False, s2=0.6, **SMALL["random_forest"])
    lines = (tmp_path / "matching_results.tsv").read_text().splitlines()
    assert [x.split("\t")[0] for x in lines] == ["source1_entity_id", *truth]
    right = sum(x.split("\t")[1] == ",".join(sorted(truth[x.split("\t")[0]])) for x in lines[1:])
    assert right > 40
    arguments = ["validate", "--matching", str(tmp_path / "matching_results.tsv"), "--candidates", str(tmp_path / "candidate_pairs.tsv"), "--test-dir", str(tmp_path / "nowhere"), str(test)]
    assert main(arguments, spark) == 0 and capsys.readouterr().out == ""
    (tmp_path / "bad.tsv").write_text("\n".join([*lines[:-1], lines[-1].split("\t")[0] + "\tS2-unknown"]) + "\n")
    assert main(["validate", "--matching", str(tmp_path / "bad.tsv"), "--test-dir", str(test)], spark) == 1
    assert "S2-unknown" in capsys.readouterr().out


def test_subset_rule(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-2\nS1-2\t\n")
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\nS1-2\tS3-1\n")
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    report = validate.validate(spark, str(tmp_path / "m.tsv"), str(tmp_path / "c.tsv"), required, spark.createDataFrame([("S2-1",), ("S2-2",), ("S3-1",)], "entity_id string"))
    assert report.errors == [] and len(report.warnings) == 1 and "S1-1" in report.warnings[0]


def test_other_encodings_are_an_error(spark, tmp_path):
    (tmp_path / "m.tsv").write_bytes("source1_entity_id\tmatched_entity_ids\nS1-é\t\n".encode("latin-1"))
    report = validate.validate(spark, str(tmp_path / "m.tsv"), None, spark.createDataFrame([("S1-1",)], "entity_id string"))
    assert report.errors == ["matching: not UTF-8"]


def test_command_line_inference(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "classifier", lambda kind, n, **o: models.LogisticRegression(maxIter=10, featuresCol="features", labelCol="label"))
    (train, _), (test, truth) = data["train"], data["test"]
    assert main(["infer", "--train-dir", str(train), "--test-dir", str(test), "--output-dir", str(tmp_path), "--model-type", "logistic_regression"], spark) == 0
    assert len((tmp_path / "candidate_pairs.tsv").read_text().splitlines()) == 1 + len(truth)


def test_rescore_and_refine(spark, sides, rows):
    sources, targets, truth = sides
    model = models.train(rows, "random_forest", **SMALL["random_forest"])
    found = resolve.block(sources, targets, 8, use_tfidf=False)
    matched, compact = resolve.rescore(model, found, sources, targets, 0.6, per_source=1)
    assert compact.count() >= matched.count() > 50
    assert matched.groupBy("s1_id", F.substring("target_id", 1, 3)).count().where("count > 1").count() == 0
    refined = resolve.refine(model, matched, sources, targets, floor=0.6)
    assert 0 < refined.count() <= matched.count() and refined.join(matched, ["s1_id", "target_id"], "left_anti").count() == 0
    right = refined.join(truth, ["s1_id", "target_id"], "left_semi").count()
    assert right > 0.8 * refined.count()


def test_experiment(spark, sides, tmp_path):
    sources, targets, truth = sides
    results, recall = resolve.experiment(sources, targets, truth, ("logistic_regression", "random_forest"), 8, SMALL, use_tfidf=False, out=str(tmp_path))
    assert [r["experiment_id"] for r in results][:2] == ["logistic_regression", "random_forest"] and results[2]["experiment_id"].endswith("_hard_negatives")
    assert recall.first().recall > 0.8 and max(r["macro_f05"] for r in results) > 0.8
    with open(tmp_path / "results.csv") as f:
        table = list(csv.DictReader(f))
    assert list(table[0]) == ["experiment_id", "model", "threshold", "precision", "recall", "f0.5", "blocking_recall", "candidate_count", "singleton_accuracy"]
    assert len(table) == 3 and float(table[0]["f0.5"]) == results[0]["macro_f05"]
    text = (tmp_path / "error_analysis.md").read_text()
    assert text.startswith("# Error analysis") and "## False positives" in text and "## False negatives" in text


def test_validate_accuracy(sides, rows):
    sources, targets, truth = sides
    model = models.train(rows, "random_forest", **SMALL["random_forest"])
    grid, recall, average = resolve.validate_accuracy(model, sources, targets, truth, entities=20, distractors=30, use_tfidf=False)
    got = {r.threshold: r for r in grid.collect()}
    assert sorted(got) == [0.65, 0.70, 0.75, 0.78, 0.80, 0.85] and all(r.num_entities == 20 for r in got.values())
    assert recall.first().recall > 0.8 and average.first().num_entities == 20


def test_audit_and_diagnosis(sides):
    sources, targets, truth = sides
    found = resolve.audit(sources, sources.selectExpr("entity_id s1_id"), truth)
    assert found["matches"].agg(F.sum("entities")).first()[0] == 60 and found["countries"].first().country == "in"
    recall, missed = resolve.diagnose(sources, targets, truth, 8)
    assert recall.first().num_true == truth.count() and missed.count() == min(10, truth.count() - recall.first().num_found)


def test_stream(spark, data, sides, rows, tmp_path):
    sources, targets, truth = sides
    model = models.train(rows, "random_forest", **SMALL["random_forest"])
    folder, got = data["train"][0], []
    (tmp_path / "in").mkdir()
    tsv.read_source(spark, str(folder / "train_source1.tsv")).write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(tsv.SCHEMA).parquet(str(tmp_path / "in" / "*"))
    raw = tsv.targets(*[tsv.read_source(spark, str(folder / f"train_source{k}.tsv")) for k in (2, 3)])
    score_stream(stream, raw, model, lambda df, n: got.extend(df.collect()), str(tmp_path / "check")).awaitTermination(120)
    _, matched = resolve.infer(model, N.normalized(tsv.read_source(spark, str(folder / "train_source1.tsv"))), N.normalized(raw), use_tfidf=False)
    assert {(r.s1_id, r.target_id) for r in got} == {(r.s1_id, r.target_id) for r in matched.collect()} and len(got) > 50


def test_progress(spark, tmp_path):
    lists = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", ""), ("S1-3", "S3-1,S3-2")], "source1_entity_id string, matched_entity_ids string")
    seen_lists, seen = resolve.watched(lists)
    tsv.write_lists(seen_lists, str(tmp_path / "m.tsv"))
    assert resolve.progress_line(seen, 1.5) == "3 entities, 2 a second; matched 2 (66.7 %), singletons 1 (33.3 %)"


def test_result_files(spark, data, tmp_path):
    folder, truth = data["test"]
    assert files.first_existing(spark, str(tmp_path / "no"), str(folder)) == str(folder)
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, str(tmp_path / "no"))
    assert {r.entity_id for r in tsv.read_ids(spark, str(folder / "test_source1.tsv")).collect()} == set(truth)
    source = tsv.read_source(spark, str(folder / "test_source1.tsv"))
    assert sorted(source.collect()) == sorted(tsv.read_source(spark, str(folder / "test_source1.tsv"), multiline=False).collect())
    assert [r.entity_id for r in tsv.head(tsv.with_order(source), 3).collect()] == list(truth)[:3]
    lists = spark.createDataFrame([(f"S1-{k}", f"S2-{k}" * (k % 2), k) for k in range(500)], "source1_entity_id string, candidate_entity_ids string, seq long").repartition(9)
    tsv.write_lists(lists, str(tmp_path / "c.tsv"))
    assert (tmp_path / "c.tsv").read_text() == "source1_entity_id\tcandidate_entity_ids\n" + "".join(f"S1-{k}\t{f'S2-{k}' * (k % 2)}\n" for k in range(500))
    assert tsv.read_pairs(spark, str(tmp_path / "c.tsv")).count() == 250


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_partial_ratio_against_all_windows():
    rng = random.Random(4)

    def brute(a, b):
        both = [(a, b)] if len(a) < len(b) else [(b, a)] if len(b) < len(a) else [(a, b), (b, a)]
        windows = lambda x, y: (y[max(0, s) : s + len(x)] for s in range(1 - len(x), len(y)))
        return max(2 * slow_lcs(x, w) / (len(x) + len(w)) for x, y in both for w in windows(x, y))

    assert round(S.partial_ratio("cacdab", "bbacaa"), 3) == round(S.partial_ratio("bbacaa", "cacdab"), 3) == 0.667
    for _ in range(600):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in "ab")
        assert abs(S.partial_ratio(a, b) - brute(a, b)) < 1e-12 and S.partial_ratio(a, b) == S.partial_ratio(b, a)
        assert abs(S.ratio(a, b) - 2 * slow_lcs(a, b) / (len(a) + len(b))) < 1e-12


def test_weighted_ratio_by_its_parts():
    rng = random.Random(8)
    words = ["ab", "abc", "bca", "x", "cab abc", "zz"]
    for _ in range(300):
        a, b = (" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in "ab")
        size = max(len(a), len(b)) / min(len(a), len(b))
        got = S.weighted_ratio(a, b)
        assert got == S.weighted_ratio(b, a) and got >= S.ratio(a, b)
        if size < 1.5:
            assert got == max(S.ratio(a, b), 0.95 * S.token_sort_ratio(a, b), 0.95 * S.token_set_ratio(a, b))
        else:
            scale = 0.9 if size <= 8 else 0.6
            assert got == max(S.ratio(a, b), scale * S.partial_ratio(a, b), 0.95 * scale * S.partial_token_ratio(a, b))


def test_errors_open_entities_until_there_are_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "s1_id string, target_id string")
    wrong = [(f"e{k}", f"t{k}{j}") for k, n in enumerate((2, 2, 4, 1, 1)) for j in range(n)]
    got = evaluate.errors(make([("e0", "missed")]), make(wrong)).collect()
    # Two and two rows are fewer than five, so a third entity opens, whole.
    assert sorted(r.s1_id for r in got if r.kind == "false positive") == ["e0"] * 2 + ["e1"] * 2 + ["e2"] * 4
    assert [(r.s1_id, r.target_id) for r in got if r.kind == "false negative"] == [("e0", "missed")]


def test_cosine_against_brute_force(spark):
    from tessera.operators import blocking

    rng = random.Random(11)
    name = lambda: " ".join(rng.choice(WORDS)[: rng.randint(3, 8)] for _ in range(rng.randint(1, 4)))
    make = lambda p, n: N.normalized(spark.createDataFrame([(f"{p}-{k}", name(), "", "", k) for k in range(n)], "entity_id string, business_name string, business_address string, country string, seq long"), True)
    s, t = make("S1", 40), make("S2", 150)
    theirs, vocabulary = blocking.tfidf_weights(t, None)
    mine, _ = blocking.tfidf_weights(s.drop("seq"), vocabulary)
    vectors = lambda df: {k: {r.gram: r.weight for r in g} for k, g in itertools.groupby(sorted(df.collect(), key=lambda r: r.entity_id), key=lambda r: r.entity_id)}
    a, b = vectors(mine), vectors(theirs)
    seq = {r.entity_id: r.seq for r in t.collect()}
    want = set()
    for i, x in a.items():
        scored = sorted((-round(sum(w * y.get(g, 0.0) for g, w in x.items()), 9), seq[j], j) for j, y in b.items())
        want |= {(i, j, n + 1) for n, (c, _, j) in enumerate(scored[:5]) if -c >= 0.15}
    assert {(r.s1_id, r.target_id, r.place) for r in blocking.tfidf_top(s, t).collect()} == want and len(want) > 100


def test_cosine_of_many_copies_in_small_blocks(spark, monkeypatch):
    from tessera.operators import blocking

    rng = random.Random(12)
    names = ["north mill stone", "stone mill north", "acme"] + [" ".join(rng.choice(WORDS)[: rng.randint(3, 8)] for _ in range(rng.randint(1, 4))) for _ in range(60)]
    make = lambda p, rows: N.normalized(spark.createDataFrame([(f"{p}-{k}", x, "", "", k) for k, x in enumerate(rows)], "entity_id string, business_name string, business_address string, country string, seq long"), True)
    s, t = make("S1", names[:40] + names[:2] * 300), make("S2", names[20:] + names[:2] * 300)
    theirs, vocabulary = blocking.tfidf_weights(t, None)
    vocabulary = vocabulary.withColumn("number", F.row_number().over(W.orderBy("df", "gram")))
    # Copies, and names of the same words, are one vector.
    assert blocking._vectors(theirs, vocabulary, "seq").select("v1", "v2").distinct().count() <= 44
    mine, _ = blocking.tfidf_weights(s.drop("seq"), vocabulary.drop("number"))
    vectors = lambda df: {k: {r.gram: r.weight for r in g} for k, g in itertools.groupby(sorted(df.collect(), key=lambda r: r.entity_id), key=lambda r: r.entity_id)}
    a, b = vectors(mine), vectors(theirs)
    seq = {r.entity_id: r.seq for r in t.collect()}
    want = set()
    for i in [x for x in a if int(x[3:]) < 60]:
        scored = sorted((-round(sum(w * y.get(g, 0.0) for g, w in a[i].items()), 9), seq[j], j) for j, y in b.items())
        want |= {(i, j, n + 1) for n, (c, _, j) in enumerate(scored[:5]) if -c >= 0.15}
    monkeypatch.setattr(blocking, "TARGETS", 7)
    monkeypatch.setattr(blocking, "SOURCES", 15)
    got = {(r.s1_id, r.target_id, r.place) for r in blocking.tfidf_top(s, t).collect()}
    assert {x for x in got if int(x[0][3:]) < 60} == want and len({i for i, _, _ in got}) > 600
