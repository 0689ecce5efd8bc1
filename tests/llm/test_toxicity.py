"""The string kernel against its definition, and scoring of odd tables."""

import itertools
import zlib

import numpy as np

from tessera.llm import toxicity
from tests.llm.test_llm import table


def kernel(a, b):
    """Gapped subsequences of three characters of words marked at both ends, within a span, by the definition."""

    def weights(word):
        marked, out = "\x02" + word + "\x03", {}
        for i, j, k in itertools.combinations(range(len(marked)), 3):
            if k - i < toxicity.SPAN:
                key = marked[i] + marked[j] + marked[k]
                out.setdefault(key, []).append(toxicity.DECAY ** (k - i - 2))
        return out

    x, y = weights(a), weights(b)
    norm = lambda w: sum(v * v for values in w.values() for v in values) ** 0.5
    return sum(sum(x[key]) * sum(y[key]) for key in x.keys() & y.keys()) / norm(x) / norm(y)


def test_kernel_against_its_definition():
    words = ["grumbaz", "grum.baz", "grxumbaz", "gumbaz", "flower", "a", "table", "stable"]
    dense = toxicity.dense(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            # Features are hashed: a few may fall together.
            assert abs(dense[i] @ dense[j] - kernel(a, b)) < 0.08, (a, b)
    near = dense @ dense[0]
    assert min(near[1:4]) > 0.5 > 0.3 > max(near[4:])


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeiklmnorstu"), rng.integers(3, 9))) for _ in range(400)]
    out = []
    for k in range(n):
        own = list(rng.choice(words, 25))
        if k % 3 == 0:
            own[7] = ["grumbaz", "zworfik", "plonquex"][k % 9 // 3]
        out.append((k, " ".join(own), int(k % 3 == 0)))
    return out


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = corpus(400, 1)
    docs = table(spark, [(i, t, "s") for i, t, _ in rows] + [(None, "grumbaz", "s")])
    schema = "doc_id long, toxic int, text string, id int"
    labels = spark.createDataFrame([(i, y, "x", 1) for i, _, y in rows] + [(None, 1, "x", 1), (7, None, "x", 1)], schema)
    turned = spark.createDataFrame([(i, 1 - y if held(i) else y, "x", 1) for i, _, y in rows], schema)
    one, two = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert (one.weights == two.weights).all() and one.slope == two.slope
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, one).collect()}
    right = [got[i].predicted == y for i, _, y in rows if held(i)]
    assert np.mean(right) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_odd_rows(spark):
    model = toxicity.fit(*zip(*[(t, y) for _, t, y in corpus(200, 2)], strict=True))
    long = "fine words here " * 20_000
    rows = [(1, None), (1, None), (2, ""), (3, "grumbaz"), (3, "grumbaz"), (None, "zworfik"), (None, None), (4, long), (5, long + "grumbaz"), (6, "퟿ \u0000 …")]
    docs = table(spark, [(i, t, "s") for i, t in rows])
    got = sorted(((r.doc_id or 0, r.predicted) for r in toxicity.score_toxicity(docs, model).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (2, 0), (3, 1), (3, 1), (0, 1), (0, 0), (4, 0), (5, 1), (6, 0)], key=str)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 4, 6]


def test_one_class_alone():
    model = toxicity.fit(["a b", "c"], [1, 1])
    assert (model.probability(toxicity.Scorer(model).best(["a b", "c", ""])) < 0.3).all()


def test_many_new_words_are_scored_in_little_memory():
    import tracemalloc

    words = [f"w{k}" + "xyz" * 7 for k in range(20_000)]
    model = toxicity.Model(np.random.default_rng(1).normal(size=toxicity.WIDTH), -1.0, 1.0, 0.0)
    tracemalloc.start()
    scores = model.of_words(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25_000_000
    assert np.allclose(scores[::999], [model.of_words([w])[0] for w in words[::999]], atol=1e-12)
