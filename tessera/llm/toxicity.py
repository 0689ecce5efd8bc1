"""Toxicity by a subsequence string-kernel support vector machine.

The kernel compares words by their gapped subsequences of three characters,
each weighted by DECAY per skipped character, so that insults with inserted
or missing characters stay close to the plain ones. Landmark words give a
Nyström map; a squared-hinge SVM is trained on labelled sentences. Labels hold
for whole documents, so training alternates, as for bags: a toxic document's
witness is the word in its most toxic sentence, a clean one's are its most
suspicious words. A document scores by its most toxic sentence, through a
sigmoid fitted on the training documents.

The model is a vector of fixed size, whatever the corpus. It is fitted on a
bounded sample of labelled rows (``sample`` documents of each class).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import begin, fields, small_batches

DECAY, SPAN, WIDTH = 0.85, 5, 1 << 15
#: Characters of a word looked at together; longer words are scored in overlapping parts.
PART = 24
SAMPLE, LANDMARKS, THRESHOLD = 3000, 96, 0.3
CACHE = 600_000
#: Words scored together: their arrays take some 8 MB.
WORDS = 1_000
_GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_SENTENCE = re.compile(r"[.!?\n]+")
_SPELLED = re.compile(r"(?<!\S)(?:\S[ \t]){2,}\S(?!\S)")
_EDGES = " \t\r\n\v\f.,;:!?\"'()[]{}<>|*#%&$-_/\\"


def occurrences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subsequences of each word, marked at both ends, and their weights (0 where there is none)."""
    marked = ["\x02" + w + "\x03" for w in words]
    length = max(max(map(len, marked)), SPAN)
    codes = np.zeros((len(words), length), np.int64)
    flat = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) for w in marked])
    codes[np.arange(length)[None, :] < sizes[:, None]] = flat
    features, weights = [], []
    for i, j in _GAPS:
        a, b, c = codes[:, : length - j], codes[:, i : length - j + i], codes[:, j:]
        features.append(((a * 1_000_003 + b) * 8_191 + c) * 2_654_435_761 % 4_294_967_291 % WIDTH)
        weights.append(np.where(c > 0, DECAY ** (j - 2), 0.0))
    w = np.concatenate(weights, 1)
    norm = np.sqrt((w * w).sum(1))
    return np.concatenate(features, 1), w / np.maximum(norm, 1e-9)[:, None]


def dense(words: list[str]) -> np.ndarray:
    features, weights = occurrences(words)
    out = np.zeros((len(words), WIDTH))
    np.add.at(out, (np.arange(len(words))[:, None], features), weights)
    return out


def parts(word: str) -> list[str]:
    return [word] if len(word) <= PART else [word[k : k + PART] for k in range(0, len(word) - PART // 2, PART // 2)]


@dataclass
class Model:
    """f(word) = features . weights + bias; P(toxic) = sigmoid(slope * max f + shift)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def of_words(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for k in range(0, len(words), WORDS):
            features, weights = occurrences(words[k : k + WORDS])
            out[k : k + WORDS] = (self.weights[features] * weights).sum(1) + self.bias
        return out

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(best, -2, 2) + self.shift, -40, 40)))


class Scorer:
    """Scores texts, remembering words."""

    def __init__(self, model: Model):
        self.model, self.cache, self.plain = model, {"": -2.0}, {"": -2.0}

    def learn(self, tokens: list[str]) -> None:
        if len(self.cache) > CACHE:
            self.cache, self.plain = {"": -2.0}, {"": -2.0}
        stripped = {t: t.strip(_EDGES) for t in tokens}
        new = {w: parts(w) + parts(bare) * (bare != w) for w in set(stripped.values()) if w not in self.plain for bare in ["".join(filter(str.isalnum, w))]}
        flat = [p for ps in new.values() for p in ps]
        if flat:
            scores, at = self.model.of_words(flat), 0
            for w, ps in new.items():
                self.plain[w] = float(scores[at : at + len(ps)].max())
                at += len(ps)
        for t, w in stripped.items():
            self.cache[t] = self.plain[w]

    def best(self, texts: list[str]) -> np.ndarray:
        """Of each text, the score of its most toxic sentence, which is that of its most toxic word; -2 without words."""
        tokens = [set(t.lower().split()) for t in texts]
        for own, t in zip(tokens, texts, strict=True):
            own.update("".join(m.group().split()).lower() for m in _SPELLED.finditer(t))
        cache = self.cache
        missing = {w for own in tokens for w in own if w not in cache}
        if missing:
            self.learn([*missing] if len(cache) <= CACHE else [*{w for own in tokens for w in own}])
        cache = self.cache
        return np.array([max(map(cache.__getitem__, own), default=-2.0) for own in tokens])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Squared hinge by accelerated gradient descent."""
    x = np.c_[x, np.ones(len(x))]
    weight = weight / weight.sum()
    step = 1 / (2 * np.linalg.norm((x * weight[:, None]).T @ x, 2) + penalty)
    u, v, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    for _ in range(rounds):
        slack = np.maximum(1 - y * (x @ v), 0)
        new = v - step * (penalty * v - 2 * x.T @ (weight * y * slack))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, v, t = new, new + (t - 1) / s * (new - u), s
    return u[:-1], float(u[-1])


def fit(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS) -> Model:
    """Train on labelled texts; without examples of both classes, a model that finds nothing."""
    y = np.array([1 if t else -1 for t in toxic])
    if not len(y) or (y > 0).all() or (y < 0).all():
        return Model(np.zeros(WIDTH), -2.0, 1.0, -2.0)
    bags = []
    for text in texts:
        words = {w.strip(_EDGES) for s in _SENTENCE.split(text.lower()) for w in s.split()}
        words.update("".join(m.group().split()).lower() for m in _SPELLED.finditer(text))
        bags.append(sorted({p for w in words if w for p in parts(w)}))
    in_toxic, in_clean = Counter(), Counter()
    for bag, label in zip(bags, y, strict=True):
        (in_toxic if label > 0 else in_clean).update(bag)
    n_toxic, n_clean = int((y > 0).sum()), int((y < 0).sum())
    vocabulary = sorted({*in_toxic, *in_clean})
    number = {w: k for k, w in enumerate(vocabulary)}
    members = [np.array([number[w] for w in bag], np.int64) for bag in bags]
    a = np.array([in_toxic[w] for w in vocabulary], float)
    b = np.array([in_clean[w] for w in vocabulary], float)
    # How far a word leans to toxic documents, in nats over all its documents.
    p, q = (a + 0.05) / (n_toxic + 1), (b + 0.5) / (n_clean + 1)
    lean = a * np.log(p / q) - np.maximum(b, 0)
    ranked = np.argsort(-lean, kind="stable")
    chosen: list[str] = []
    vectors = np.zeros((0, WIDTH))
    for k in ranked[: 40 * landmarks]:
        if lean[k] <= 3 or len(chosen) >= landmarks * 2 // 3:
            break
        own = dense([vocabulary[k]])
        if not len(vectors) or (vectors @ own[0]).max() < 0.9:
            chosen.append(vocabulary[k])
            vectors = np.r_[vectors, own]
    common = [vocabulary[k] for k in np.argsort(-b, kind="stable") if a[k] < 2 * b[k] * n_toxic / n_clean + 3]
    stride = max(1, len(common[:4000]) // max(1, landmarks - len(chosen)))
    chosen += common[:4000:stride][: landmarks - len(chosen)]
    marks = dense(chosen)
    values, basis = np.linalg.eigh(marks @ marks.T)
    root = basis @ np.diag(1 / np.sqrt(np.maximum(values, 1e-4))) @ basis.T
    project = marks.T @ root

    def embed(words: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), project.shape[1]))
        # A block of project[features] is some 20 MB.
        for k in range(0, len(words), 100):
            features, weights = occurrences([vocabulary[w] for w in words[k : k + 100]])
            out[k : k + 100] = np.einsum("ijk,ij->ik", project[features], weights, optimize=True)
        return out

    score = lean.copy()
    model = None
    for turn in range(4):
        witness, fresh = [], []
        for own, label in zip(members, y, strict=True):
            if not len(own):
                continue
            if label > 0:
                w = own[np.argmax(score[own])]
                if turn or lean[w] > 3:
                    witness.append(w)
            else:
                fresh.extend(own[np.argsort(-score[own])[:3]])
        if not witness:
            return Model(np.zeros(WIDTH), -2.0, 1.0, -2.0)
        plain = np.argsort(-b, kind="stable")[:3000]
        good, bad = Counter(witness), Counter([*fresh, *plain[a[plain] <= 2 * b[plain] * n_toxic / n_clean + 3]])
        words = np.array([*good, *bad])
        signs = np.r_[np.ones(len(good)), -np.ones(len(bad))]
        weight = np.r_[np.array([*good.values()], float) ** 0.5, np.array([*bad.values()], float) ** 0.5]
        weight[signs > 0] /= weight[signs > 0].sum()
        weight[signs < 0] /= weight[signs < 0].sum()
        u, bias = _svm(embed(words), signs, weight)
        model = Model(project @ u, bias, 1.0, 0.0)
        score = model.of_words(vocabulary)
    best = np.clip([score[own].max() if len(own) else -2.0 for own in members], -2, 2)
    slope, shift = 4.0, 0.0
    target = np.where(y > 0, (n_toxic + 1) / (n_toxic + 2), 1 / (n_clean + 2))
    # Between the sample's even classes and the tables' mostly clean ones.
    balance = np.where(y > 0, 0.25 / n_toxic, 0.75 / n_clean)
    for _ in range(2000):
        error = (1 / (1 + np.exp(-np.clip(slope * best + shift, -40, 40))) - target) * balance
        slope, shift = max(0.1, slope - 4 * float((error * best).sum())), shift - 4 * float(error.sum())
    return Model(model.weights, model.bias, slope, shift)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents of each class, in the order of a hash of their id, of labels whose crc32(doc_id as text) mod 4 is not 2."""
    known = fields(labels, id=doc_id, toxic=toxic).where(F.col("toxic").isNotNull() & F.col("id").isNotNull() & (F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    drawn = [known.where(c).orderBy(F.xxhash64("id"), "id").limit(sample) for c in (F.col("toxic") > 0, F.col("toxic") <= 0)]
    chosen = drawn[0].union(drawn[1])
    # At most 2 * sample rows.
    rows = fields(docs, id=doc_id, text=text).join(F.broadcast(chosen), "id").select("id", "text", "toxic")
    taken = sorted(((r.id, r.text or "", int(r.toxic > 0)) for r in rows.toLocalIterator()), key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    return fit([t for _, t, _ in taken], [y for _, _, y in taken])


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if score >= threshold).

    Null and empty texts score lowest. Null ids and repeated rows are scored
    like any other. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        scorer = Scorer(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                score = shared.value.probability(scorer.best([t or "" for t in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return fields(docs, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold; rows are judged where they are read, with no shuffle. Nulls and empty tables as in score_toxicity."""
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        scorer = Scorer(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                score = shared.value.probability(scorer.best([t or "" for t in part.column(at).to_pylist()]))
                yield part.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_string_kernel_svm(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"), "score", "predicted")
