import numpy as np

import corpus_pipeline
from tessera.llm import ngrams, packing, toxicity
from tessera.llm.mixing import mix_sources
from tests.llm.test_llm import BASE, table


def test_stages(spark, tmp_path):
    good = [f"clean words number {k} " + " ".join(f"t{k}x{j}" for j in range(30)) for k in range(80)]
    bad = [f"you grumbaz person {k} " + " ".join(f"u{k}x{j}" for j in range(30)) for k in range(40)]
    rows = [(k, t, "ab"[k % 2]) for k, t in enumerate(good + bad)] + [(200, BASE, "a"), (201, BASE + " end", "a"), (202, None, None), (203, "mail a.b@c.de", "b"), (203, "mail a.b@c.de", "b")]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 0 if k < 80 else 1, 1) for k in range(120)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = docs.collect()
    ids = {k: [r.doc_id for r in v] for k, v in after.items()}
    assert set(range(80)) <= set(ids["toxicity"]) and len(set(range(80, 120)) & set(ids["toxicity"])) < 4
    assert 200 in ids["near copies"] and 201 not in ids["near copies"] and ids["near copies"].count(202) == 1
    assert all("@" not in (r.text or "") for r in after["personal data"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def stored(spark, rows, path, parts):
    table(spark, rows).repartition(parts).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def test_stages_agree_however_documents_are_stored(spark, tmp_path):
    """Nulls, repeated rows, repeated ids, long texts: each stage gives the same rows from other files."""
    long = " ".join(f"long{k % 5000}" for k in range(60_000))
    rows = [(k, f"clean words number {k} " + " ".join(f"t{k}x{j}" for j in range(20)), "ab"[k % 2]) for k in range(60)]
    rows += [(1, "another text of a known id " + BASE, "a"), (None, BASE, None), (None, BASE, None), (None, None, "b"), (7, "", "a"), (7, "", "a"), (100, long, "b"), (101, long + " end", "b"), (9, "call +1 (255) 555-8013", "a")]
    one, two = (stored(spark, rows[::d], tmp_path / f"d{d}", p) for d, p in ((1, 1), (-1, 5)))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        got = [sorted(map(str, stage(spark, docs, str(tmp_path)).collect())) for docs in (one, two)]
        assert got[0] == got[1]
    near = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, one, "").collect()}
    assert (100, long) in near and 101 not in {i for i, _ in near} and (None, BASE) in near
    assert len([r for r in corpus_pipeline.drop_near_copies(spark, one, "").collect() if r.text == BASE]) == 1


def test_mix_takes_what_the_queue_takes(spark, tmp_path):
    rows = [(k, " ".join(f"w{j}" for j in range(1 + k * 7 % 40)), "abcd"[k % 4] if k % 9 else None) for k in range(300)] + [(400, "", "a"), (401, None, None)]
    docs = stored(spark, rows, tmp_path / "d", 3)
    got = {}
    for r in corpus_pipeline.mix(spark, docs, "").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    want = {}
    keyed = corpus_pipeline._keyed(docs, "doc_id", "text", "source")
    ids = {r["_tessera_key"]: r.doc_id for r in keyed.collect()}
    for r in mix_sources(keyed, doc_id="_tessera_key").collect():
        want[ids[r.doc_id]] = r.epochs if r.size else 1
    assert got == {k: v for k, v in want.items() if v} and 0 in want.values() and 2 in want.values()


def test_empty_tables(spark, tmp_path):
    docs = stored(spark, [], tmp_path / "d", 1)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_a_worker_remembers_one_operators_words(spark, monkeypatch):
    docs = table(spark, [(1, "plain words here", "a")]).select("doc_id", "text")
    batches = docs.toArrow().to_batches()
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: lambda: [*run(iter(batches))])
    pieces = packing.cut_into_pieces(docs, packing.tokenizer_path())
    pieces()
    encoder = packing._encoders[packing.tokenizer_path()]
    pieces()
    assert packing._encoders[packing.tokenizer_path()] is encoder
    toxicity.keep_clean(docs, toxicity.fit([], []))()
    assert not packing._encoders
    ngrams._prefixes(docs, 2, spark.sparkContext.broadcast((np.zeros(0, np.int64), np.zeros(0, np.int64))), 8, 10)()
    assert ngrams._words
    pieces()
    assert not ngrams._words and packing._encoders
