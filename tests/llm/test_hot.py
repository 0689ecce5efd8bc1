"""Hot groups, repeated keys and outlying ids, against brute force."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import fingerprints, knn, ngrams, pii
from tests.llm.test_llm import brute_sets, table


def components(texts, n, least, of):
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    sets = [brute_sets(t, n) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and of * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


@pytest.mark.parametrize("edits", [(0, 9), (5, 9)])
def test_different_near_copies_of_one_text(spark, edits):
    """500 different copies, of which some link, some do not, and many share n-grams without a link; sizes vary, so size classes meet."""
    rng = np.random.default_rng(edits[0])
    base = [f"w{j}" for j in range(110)]
    texts = []
    for _ in range(500):
        words = list(base[: rng.integers(85, 111)])
        for _ in range(rng.integers(*edits)):
            words[rng.integers(0, len(words))] = f"new{rng.integers(0, 40)}"
        texts.append(" ".join(words))
    got = ngrams.ngram_join(table(spark, [(k, t, "s") for k, t in enumerate(texts)]), n=4, least=85, of=100).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(components(texts, 4, 85, 100)))


def test_other_texts_of_one_id(spark):
    base = " ".join(f"w{j}" for j in range(60))
    rows = [(1, base), (1, "quite another text of the same id"), (2, base + " more"), (None, base), (None, "x y z"), (None, "x y z")]
    got = ngrams.ngram_join(table(spark, [(i, t, "s") for i, t in rows]), n=4, least=85, of=100).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.linked) for r in got) == collections.Counter(
        [(1, 57, None, True), (1, 4, 1, False), (2, 58, None, True), (None, 57, None, True), (None, 1, None, True), (None, 1, None, True)]
    )


def neighbours(vectors, every, k):
    ints = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in vectors]
    want = []
    for q in sorted({i for i, _ in ints if i % every == 0}):
        own = next(v for i, v in ints if i == q)
        best = sorted((-int(own @ x), i) for i, x in ints if i != q)[:k]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return want


def test_repeated_queries_and_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(knn, "DATA_BLOCK", 16)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(3)
    vectors = [(100, [5.0, 0.0, 1.0])] * 15 + [(k, [4.9 + 0.01 * k, 0.0, 1.0]) for k in range(1, 6)]
    vectors += [(200 + k, [float(x) for x in rng.normal(size=3)]) for k in range(55)] + [(300 + k, [9.0, 9.0, 9.0]) for k in range(200)]
    schema = "vec_id long, embedding array<float>, cell int, block int, dist string, n int, ids int, v string"
    got = knn.top_k(spark.createDataFrame([(i, v, 1, 1, "x", 1, 1, "x") for i, v in vectors], schema)).collect()
    assert sorted(tuple(r) for r in got) == sorted(neighbours(vectors, 100, 10))


def test_scores_past_double_precision(spark):
    vectors = [(k, [float(2**21 + 3 * k), float(2**21 - k)]) for k in range(30)] + [(100, [float(2**21), 1.0])]
    got = knn.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got) == sorted(neighbours(vectors, 100, 10))
    assert max(r.score for r in got) > 2**53


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def test_base_patterns_against_re():
    rng = np.random.default_rng(7)
    pieces = ["a", "b.c", "@", "x@y.z", ".", "..", "1", "25", "256", "0001", "4111 1111 1111 1111", "4111-1111-1111-1112", "+", "+1 (255) 555", "-", " ", "  ", "(", ")", "%", "é", "٣", "\n", "+49 30.1234567", "1.2.3.4", "999.1.1.1", "_", "a@b", "@c.d"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces, rng.integers(1, 14)))
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        want = {
            "email": [m.span() for m in EMAIL.finditer(text)],
            "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))],
            "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
            "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
        }
        assert pii.base_spans(text) == want, text


SECRET = "I bought an iphone12 and python3 with h264codec in report2024 b204x. password=Hunter22x later Hunter22x end, hunter22-x."


def test_field_links_mentions():
    filler = [f"page {k} of 20{k % 30:02d}. mail me a{k}@b.cd or 1.2.3.{k} now. token = \"{hashlib.sha1(str(k).encode()).hexdigest()}\"" for k in range(60)]
    for texts in ([], filler[:3], filler):
        field = pii.fit(texts)
        spans = pii.all_spans(field, SECRET)[1]
        assert [(k, SECRET[s:e]) for k, s, e in spans] == [("secret", "Hunter22x"), ("secret", "Hunter22x"), ("secret", "hunter22-x")]
        # Without messages only the named mention is found.
        assert len(pii.all_spans(field, SECRET, rounds=0)[1]) == 1
    assert pii.all_spans(field, "password: correcthorse ok")[1] == [("secret", 10, 22)]
    # Its other mentions tell that the word is no secret, though one of them is named.
    assert pii.all_spans(field, "token: usually we usually go usually there")[1] == []


def test_message_passing_on_a_tree_is_exact():
    rng = np.random.default_rng(1)
    n = len(pii.LABELS)
    field = pii.Field(rng.normal(size=(n, len(pii.FEATURES))), rng.normal(size=(3, n, n)))
    field.pairs = (field.pairs + field.pairs.transpose(0, 2, 1)) / 2
    x, links = rng.normal(size=(4, len(pii.FEATURES))) / 4, np.array([(0, 1, 0), (1, 2, 1), (1, 3, 2)])
    p, q = pii.pass_messages(field, x, links, rounds=60)
    unary = x @ field.unary.T
    joint = unary[0][:, None, None, None] + unary[1][:, None, None] + unary[2][:, None] + unary[3]
    joint = joint + field.pairs[0][:, :, None, None] + field.pairs[1][None, :, :, None] + field.pairs[2][None, :, None, :]
    joint = np.exp(joint) / np.exp(joint).sum()
    assert np.allclose(p[0], joint.sum((1, 2, 3))) and np.allclose(p[1], joint.sum((0, 2, 3))) and np.allclose(q[2], joint.sum((0, 2)))


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def words_hash(value, seed):
    return xxhash.xxh64_intdigest(value, seed)


def brute_print(text):
    """The samples of a text by the definition, with its draws taken from the same hashes."""
    counts = collections.Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text) if w)
    r_table, c_table = fingerprints.gamma_quantiles(fingerprints.R_BITS), np.log(fingerprints.gamma_quantiles(fingerprints.C_BITS))
    out = []
    for k in range(fingerprints.SAMPLES):
        best = None
        for word, n in counts.items():
            h = words_hash(word.encode(), 42)
            seeded = lambda s: words_hash(s.to_bytes(4, "little"), words_hash(h.to_bytes(8, "little"), 42))  # noqa: B023, E731
            draws = seeded(k // 2) >> (32 * (k % 2)) & 0xFFFFFFFF
            r, c = round(r_table[draws & 511], 4), draws >> 9 & 1023
            ln_c = round(c_table[c], 4) if c else 0.5 * math.log(2 * ((seeded(fingerprints.SAMPLES + k) & (1 << 40) - 1) + 0.5) * 2.0**-50)
            b = ((draws >> 19) + 0.5) * 2.0**-13
            t = 0 if n == 1 else math.floor(math.log(n) / r + b)
            value = ln_c - r * (t - b + 1)
            key = (int(value * 2.0**23), (signed(h) ^ (t * 0x9E3779B1)) & 0xFFFFFFFF)
            best = key if best is None else min(best, key)
        out.append(f"{best[1] if best else 0:08x}")
    return "-".join(out)


def test_samples_against_numpy(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice([f"w{j}" for j in range(12)], rng.integers(0, 60))) for _ in range(25)] + ["", "one", "a a a a"]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(table(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    for k, text in enumerate(texts):
        after = texts[k - 1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [brute_print(x).split("-") for x in (text, edited, after)]
        assert got[k].fingerprint.split("-") == prints[0] and got[k].edited_fingerprint.split("-") == prints[1]
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((got[k].near_edited, prints[1]), (got[k].near_next, prints[2])):
            assert near == sum(x == y for x, y in zip(prints[0], other, strict=True)) / fingerprints.SAMPLES


@pytest.mark.parametrize("odd", [[], [None], [None] * 40, [1 << 62], [-(1 << 63) + 1, 5, 5, 5]])
def test_ranges_of_outlying_ids(spark, odd, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 10)
    monkeypatch.setattr(fingerprints, "QUANTILES", 8)
    ids = [*range(1000, 1400), *odd]
    rows = [(i, f"text {k} {k % 7}", "s") for k, i in enumerate(ids)]
    df = table(spark, rows).selectExpr("coalesce(doc_id, -9223372036854775808) AS id", "text")
    sizes = collections.Counter(r.range for r in df.select(fingerprints.id_ranges(df).alias("range")).collect())
    assert max(sizes.values()) <= 60 and len(sizes) >= 20
    got = fingerprints.fingerprint_documents(table(spark, rows)).collect()
    assert len(got) == len(rows)
    known = sorted({i for i in ids if i is not None and ids.count(i) == 1}, reverse=True)
    own, texts = {r.doc_id: r for r in got}, {i: t for i, t, _ in rows}
    for a, b in zip(known, known[1:], strict=False):
        if not any(b < i < a for i in ids if i is not None):
            half = len(texts[a]) // 2
            assert own[a].edited_sha256 == hashlib.sha256((texts[a][: len(texts[a]) - half] + texts[b][:half]).encode()).hexdigest()


def test_one_row_is_its_own_next(spark):
    r = fingerprints.fingerprint_documents(table(spark, [(1, "a b c d", "s")])).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a b a b"[:4] + b"a b"[:3]).hexdigest()
