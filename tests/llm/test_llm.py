import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

from tessera.llm import fingerprints, knn, licenses, mixing, ngrams, packing, pii, substrings, toxicity, urls
from tessera.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, tie int, size string, set string, key string, row int"
BASE = " ".join(f"word{k} of" for k in range(40))
TEXTS = ["", None, " \n", "one", "a b", BASE, BASE, BASE + " end", BASE.replace("word7", "other"), "ab" * 400, ("same line here and more of it to fill\n" * 9), "x" * 3000,
         "mail me a.b@c.de or 1.2.3.4 now", "Under the MIT License, twice: under the mit license", "é" * 150 + " Ünïcode " + BASE[:90], "you idiot"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "c", 1, "z", "s", "k", 2) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, [None, "a", "b", "c"][k % 4]) for k, t in enumerate(TEXTS)]
    return table(spark, [*rows, rows[5], (None, "null id text " + BASE, "a"), (None, None, None)])


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_empty_tables(spark):
    none = table(spark, [])
    field, model = pii.fit([]), toxicity.fit([], [])
    for found in (packing.pack_documents(none), ngrams.ngram_join(none), substrings.remove_repeats(none), mixing.mix_sources(none), licenses.scan_licenses(none), fingerprints.fingerprint_documents(none), pii.find_personal_data(none, field), toxicity.score_toxicity(none, model)):
        assert found.count() == 0
    assert knn.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_packing(docs):
    got = packing.pack_documents(docs).toPandas().sort_values(["sequence_id", "offset"])
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = collections.Counter()
    for i, t in rows_of(docs):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want[(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes()))] += 1
    assert collections.Counter((None if math.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    at = {}
    for r in got.itertuples():
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    h = np.bincount(rng.integers(1, 2049, 20_000), minlength=2049)
    plan = packing.plan_sequences(h)
    back = np.zeros(2049, int)
    for lengths, n in plan:
        assert sum(lengths) <= 2048
        for v in lengths:
            back[v] += n
    assert (back == h).all() and sum(n for _, n in plan) <= 1.01 * (h * np.arange(2049)).sum() / 2048 + 2


def brute_sets(text, n):
    words = (text or "").encode().translate(ngrams._LOWER).split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def test_ngram_join(spark, docs):
    own = rows_of(docs)
    rng = np.random.default_rng(2)
    for k in range(100, 220):
        words = [f"w{k // 12}_{j}" for j in range(60)]
        for _ in range(rng.integers(0, 5)):
            words[rng.integers(0, 60)] = f"new{rng.integers(0, 1000)}"
        own.append((k, " ".join(words)))
    got = ngrams.ngram_join(table(spark, [(i, t, "s") for i, t in own]), n=4, least=85, of=100).collect()
    parent = list(range(len(own)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    sets = [brute_sets(t, 4) for _, t in own]
    for a in range(len(own)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    key = lambda i: -(1 << 63) if i is None else i
    low = {}
    for k, (i, _) in enumerate(own):
        low[find(k)] = min(low.get(find(k), 1 << 62), key(i))
    want = collections.Counter((key(i), len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(own))
    assert collections.Counter((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == want


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 30), (30, 31), (5, 5)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 30: 7, 31: 7}


def test_substrings(docs):
    got = substrings.remove_repeats(docs).collect()
    own = {}
    for i, t in rows_of(docs):
        own[(-(1 << 63) if i is None else i, t or "")] = (t or "").encode()
    null = [k for k in own if k[0] == -(1 << 63)]
    order = sorted(own, key=lambda k: (k[0], len(k[1]) == 0 or null == [k]))
    seen, want = set(), {}
    for k in order:
        b = own[k]
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        want[k] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    kept = collections.Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got)
    assert kept == collections.Counter((i, len((t or "").encode()), want[(-(1 << 63) if i is None else i, t or "")]) for i, t in rows_of(docs))


def test_knn(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(k), [float(x) for x in rng.normal(size=6)]) for k in range(400)] + [(500 + k, [1.0] * 6) for k in range(60)]
    odd = [(600, None), (700, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (800, [float("nan")] * 6), (None, [1.0] * 6), (900, [])]
    got = knn.top_k(spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")).collect()
    ints = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors}
    want = []
    for q in (i for i in ints if i % 100 == 0):
        best = sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_mixing(docs):
    got = mixing.mix_sources(docs).collect()
    size = collections.Counter()
    for r in got:
        size[r.source] += r.size
    assert len(got) == docs.count() and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    targets = {r.source: r.target for r in got}
    assert abs(sum(targets.values()) - 1.5 * sum(size.values())) < 1e-6 and all(t <= 2 * size[s] + 1e-9 for s, t in targets.items())
    assert sorted((r.doc_id or -1, r.taken) for r in mixing.mix_sources(docs.repartition(3)).collect()) == sorted((r.doc_id or -1, r.taken) for r in got)


def test_toxicity():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("aeiklmnorstu"), rng.integers(3, 9))) for _ in range(500)]
    insults = ["grumbaz", "zworfik", "plonquex"]
    texts, labels = [], []
    for k in range(600):
        own = list(rng.choice(words, 30))
        if k % 4 == 0:
            own[5] = insults[k % 3]
        texts.append(" ".join(own) + ".")
        labels.append(int(k % 4 == 0))
    model = toxicity.fit(texts[:400], labels[:400])
    scores = model.probability(toxicity.Scorer(model).best(texts[400:]))
    assert ((scores >= 0.3) == np.array(labels[400:])).mean() > 0.97
    spelled = model.probability(toxicity.Scorer(model).best(["g.r.u.m.b.a.z", "g r u m b a z now", "grumbbaz", "", "ok"]))
    assert (spelled[:3] > 0.3).all() and (spelled[3:] < 0.3).all()


def test_personal_data(docs):
    text = "a.b@c.de x@y @z.w 1.2.3.4 1.2.3.400 and 4111 1111-1111 1111 +1 (255) 555-8013 q password=abc123def4567 later abc123def4567 end"
    found, spans = pii.all_spans(pii.fit([text] * 5), text)
    assert {k: len(v) for k, v in found.items()} == {"email": 1, "ip": 1, "card": 1, "phone": 1}
    secrets = [text[s:e] for k, s, e in spans if k == "secret"]
    assert secrets == ["abc123def4567"] * 2
    assert pii.find_personal_data(docs, pii.fit([]), redact=True).count() == docs.count()
    assert "[SECRET]" in pii.redacted(text, spans) and "a.b@c.de" not in pii.redacted(text, spans)


def test_fingerprints(docs):
    got = fingerprints.fingerprint_documents(docs).collect()
    assert len(got) == docs.count()
    by_text = {}
    for i, t in rows_of(docs):
        if i is not None:
            by_text.setdefault(t or "", set()).update(r.fingerprint for r in got if r.doc_id == i)
    assert all(len(v) == 1 for v in by_text.values())
    texts = dict(rows_of(docs))
    r = next(r for r in got if r.doc_id == 15)
    a, b = texts[15], texts[14]
    assert r.edited_sha256 == hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()


def test_fingerprint_rate(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        rows.append((k, " ".join(rng.choice([f"w{j}" for j in range(40)], 80)), "s"))
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(table(spark, rows)).collect()}
    real, near = [], []
    for k in range(1, 300):
        x, y = collections.Counter(rows[k][1].split()), collections.Counter(rows[k - 1][1].split())
        real.append(sum((x & y).values()) / sum((x | y).values()))
        near.append(got[k].near_next)
    # All pairs share forty words and so their draws: the mean varies like that of a few hundred samples.
    assert abs(np.mean(real) - np.mean(near)) < 0.06


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    r = got[13]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (9, 2, 0, 5, "mit", "mit")
    assert got[0].n_words == got[1].n_words == 0 and got[0].first_word is None and got[0].score == 0


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?q#f"), (2, "https://a.net/de/"), (3, "x://example.com/de/"), (4, "no"), (5, None), (6, "http://q.org/fr/"), (7, "http://net"), (8, "http://w.net#x")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), html=None).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][:3] == got[5][:3] == ("", "", None) and got[6][2:] == ("org/fr/", "allow")
    assert got[7][2] is None and got[8][:3] == ("w.net", "", None)


def test_host_reputation(spark):
    """Hosts of one suffix differ by their pages; a host with few pages follows its domain; ports, addresses and two-label suffixes."""
    junk, proper = "*** %%% " * 10, "a proper page " * 50
    rows = [(k, f"http://bad.co.uk/{k}", junk) for k in range(40)] + [(100 + k, f"http://good.co.uk:80/{k}", proper) for k in range(40)]
    rows += [(200, "http://new.bad.co.uk/x", None), (201, "http://new.good.co.uk/x", ""), (202, "http://10.0.0.1/", proper), (203, "http://10.0.0.1/", proper)]
    pages = spark.createDataFrame([(*r, "h", "r", 1, "s") for r in rows], "page_id long, url string, html string, host string, rule string, junk int, suffix string")
    got = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert len(got) == len(rows) and all(r.rule is None for r in got.values())
    assert {r.verdict for k, r in got.items() if k < 40 or k == 200} == {"block"} and {r.verdict for k, r in got.items() if k >= 100 and k != 200} == {"allow"}
    assert got[200].bad_mean > 0.8 > 0.2 > got[201].bad_mean
