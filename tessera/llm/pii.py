"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail and IP addresses, card and phone numbers. The field's
nodes are the tokens of a document that may be personal: those with a digit or
an @, those that a word such as "password" names, and all, of whatever shape,
that repeat a named one. Each has unary potentials, a product of label weights
and features (shape, context, lying in a pattern match). Neighbouring nodes
share a chain potential; equal tokens, however far apart, and similar ones
(equal but for case and punctuation) share skip potentials. Loopy message
passing makes the labels of a document's mentions agree: a secret that is
named once is found wherever it stands, and an ordinary word that follows
"token:" once but stands elsewhere too is left alone.

All weights are trained together, to the greatest posterior probability: the
likelihood's gradient is counts less expected counts by message passing over a
bounded sample of documents, where tokens outside matches and names count as
negatives; a Gaussian prior around the weights below keeps what a corpus says
nothing about where it is.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import begin, fields, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS, "secret")
SAMPLE, ROUNDS, SURE = 2000, 8, 0.8
#: Nodes that a field is fitted on at most.
NODES = 20_000
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_CUE = re.compile(r"(?i)\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential)\w*$")
_CUED = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential)\w*[\"']?\s*[=:]")
_INNER = re.compile(r"[^\s=:\"'`<>()\[\]{},;]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, at = [], 0
    p = text.find("@")
    while p >= 0:
        start = p
        while start > at and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, p + 1) if start < p else None
        if m:
            found.append((start, m.end()))
            at = m.end()
        p = text.find("@", max(p + 1, at))
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """(start, end) of each kind's pattern matches, in code points."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    found["email"] = emails(text)
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in m.group().split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdecimal, m.group())) <= 15:
                found["phone"].append(m.span())
    return found


@dataclass
class Node:
    """A token: place in the text, key and skeleton for skip links, place among all tokens, and what is seen of it."""

    start: int
    end: int
    key: str
    skeleton: str
    place: int
    named: bool
    quoted: bool


def nodes(text: str) -> list[Node]:
    """Tokens that may be personal, in order; empty for most texts."""
    if not (_DIGIT.search(text) or "@" in text or _CUED.search(text)):
        return []
    out: list[Node] = []
    rest: list[Node] = []
    before = ["", ""]
    for place, m in enumerate(_TOKEN.finditer(text)):
        token = m.group()
        marked = "=" in before[1] or ":" in before[1]
        shaped = _DIGIT.search(token) or "@" in token
        if shaped or marked or "=" in token or ":" in token:
            pieces = list(_INNER.finditer(token))
            for k, piece in enumerate(pieces):
                s = piece.group().strip(".!?")
                if len(s) < 4:
                    continue
                lead = pieces[k - 1].group() if k else (before[1] if before[1].strip("=:\"'") else before[0])
                named = bool((k > 0 or marked) and _CUE.search(lead.strip("=:\"'")))
                at = m.start() + piece.start() + piece.group().find(s)
                node = Node(at, at + len(s), s.lower(), "".join(filter(str.isalnum, s.lower())), place, named, at > 0 and text[at - 1] in "\"'`")
                (out if named or _DIGIT.search(s) or "@" in s else rest).append(node)
        before = [before[1], token]
    names = {x.skeleton for x in out if x.named and not (_DIGIT.search(x.key) or "@" in x.key)}
    if names:
        # Words of any shape that repeat a named one.
        known = {x.start for x in out}
        for place, m in enumerate(_TOKEN.finditer(text)):
            for piece in _INNER.finditer(m.group()):
                s = piece.group().strip(".!?")
                skeleton = "".join(filter(str.isalnum, s.lower()))
                at = m.start() + piece.start() + piece.group().find(s)
                if skeleton in names and at not in known:
                    out.append(Node(at, at + len(s), s.lower(), skeleton, place, False, at > 0 and text[at - 1] in "\"'`"))
        out.sort(key=lambda x: x.start)
    return out


#: Names of the features; ``in_...``: the token overlaps a pattern match.
FEATURES = ("bias", "named", "letters", "digits", "mixed", "hex", "long", "short", "at", "dots", "plus", "quoted", *(f"in_{k}" for k in KINDS))
#: Means of the Gaussian prior of the unary weights, by label; others have mean 0. Standard deviation: 1.
PRIOR = {
    "other": {"bias": 2.0},
    **{k: {"bias": -4.0, f"in_{k}": 11.0} for k in KINDS},
    "secret": {"named": 18.0, "letters": -4.5, "digits": -3.0, "mixed": 0.5, "hex": 1.0, "long": 0.5, "short": -1.0, "at": -4.0, "dots": -3.0, "plus": -3.0, **{f"in_{k}": -4.0 for k in KINDS}},
}
#: Prior means of the pair potentials, by kind of edge: what labels that agree gain and others lose.
AGREE = {"chain": 0.0, "same": 6.0, "similar": 5.0}


def features(x: Node, inside: int) -> list[float]:
    key = x.key
    digits, letters = sum(map(str.isdecimal, key)), sum(map(str.isalpha, key))
    hexed = digits > 0 and letters > 0 and len(key) >= 16 and all(c in "0123456789abcdef" for c in key)
    seen = (1, x.named, not digits, digits == len(x.skeleton) and digits > 0, digits > 0 and letters > 0, hexed, len(key) >= 16, len(key) < 8, "@" in key, key.count(".") == 3, key.startswith("+"), x.quoted)
    return [*map(float, seen), *(float(inside == k + 1) for k in range(len(KINDS)))]


@dataclass
class Field:
    """Unary weights (label, feature) and pair potentials (kind of edge, label, label)."""

    unary: np.ndarray
    pairs: np.ndarray


def prior() -> Field:
    unary = np.array([[PRIOR[label].get(f, 0.0) for f in FEATURES] for label in LABELS])
    agree = 2 * np.eye(len(LABELS)) - 1
    return Field(unary, np.stack([agree * v for v in AGREE.values()]))


def _inside(found: dict[str, list[tuple[int, int]]], own: list[Node]) -> list[int]:
    """The label of the pattern match that a node overlaps, or 0."""
    spans = sorted((s, e, 1 + k) for k, kind in enumerate(KINDS) for s, e in found[kind])
    starts = [s for s, _, _ in spans]
    out = [0] * len(own)
    for i, x in enumerate(own):
        until = bisect_right(starts, x.end - 1)
        for j in range(max(0, until - 4), until):
            if spans[j][1] > x.start:
                out[i] = spans[j][2]
    return out


def edges(own: list[Node]) -> list[tuple[int, int, int]]:
    """(node, later node, kind): neighbours at most three tokens apart, and each mention's next equal or similar one."""
    out, last = [], {}
    for i, x in enumerate(own):
        if i and x.place - own[i - 1].place <= 3:
            out.append((i - 1, i, 0))
        if (j := last.get(x.skeleton)) is not None:
            out.append((j, i, 1 if own[j].key == x.key else 2))
        last[x.skeleton] = i
    return out


def pass_messages(field: Field, x: np.ndarray, links: np.ndarray, rounds: int = ROUNDS, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of nodes and, if asked for, of pairs of labels on edges (node, node, kind), by loopy message passing."""
    unary = x @ field.unary.T
    n = len(LABELS)
    belief, a, b, kind = unary, *links.reshape(-1, 3).T
    m = len(a)
    source, target, back = np.r_[a, b], np.r_[b, a], np.r_[np.arange(m, 2 * m), np.arange(m)]
    kinds = np.r_[kind, kind]
    messages = np.zeros((2 * m, n))
    for _ in range(rounds if m else 0):
        rest = belief[source] - messages[back]
        new = np.empty_like(messages)
        for label in range(n):
            z = rest + field.pairs[:, :, label][kinds]
            top = z.max(1)
            new[:, label] = top + np.log(np.exp(z - top[:, None]).sum(1))
        messages = 0.3 * messages + 0.7 * (new - new.max(1, keepdims=True))
        belief = unary.copy()
        np.add.at(belief, target, messages)
    p = np.exp(belief - belief.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    if not pairs or not m:
        return p, np.zeros((0, n, n))
    z = (belief[a] - messages[m:])[:, :, None] + (belief[b] - messages[:m])[:, None, :] + field.pairs[kind]
    q = np.exp(z - z.max((1, 2), keepdims=True))
    return p, q / q.sum((1, 2), keepdims=True)


#: Ordinary tokens of letters and digits, which every fit counts as negatives: a corpus may hold no such token but in secrets.
ORDINARY = """
windows10 covid19 utf8 sha256sum x86 ipv4addr base64 html5video css3 area51 route66 level42 vitaminb12 3dprinter 4x4drive 2ndhand 1990s
100mbps fy2023 boeing747 airbus380 win32api rs232port i18n k8scluster log4j h2database rtx3080 a4paper 10kg 12hours oct2021 room101b
gate14c mp3player nov30th 5pm version2 chapter12 figure3b appendix2c gpt2 llama70b room12 step2 team7 phase3 unit42 block5c page12of90
"""


def fit(texts: list[str], turns: int = 80) -> Field:
    """The field of the greatest posterior probability, by gradient steps of a size of their own for each weight. Texts that would bring more than NODES nodes are left out."""
    texts = [*texts, *ORDINARY.split()]
    field, mean = prior(), prior()
    n = len(LABELS)
    xs, ys, links = [], [], []
    for text in texts:
        own = nodes(text)
        if len(xs) + len(own) > NODES:
            continue
        inside = _inside(base_spans(text), own)
        # What is named as a secret once is one wherever it stands in the document.
        named = {x.skeleton for x in own if x.named}
        links += [(i + len(xs), j + len(xs), k) for i, j, k in edges(own)]
        ys += [k or (n - 1 if x.skeleton in named else 0) for x, k in zip(own, inside, strict=True)]
        xs += [features(x, k) for x, k in zip(own, inside, strict=True)]
    if not xs:
        return field
    x, y, e = np.array(xs), np.eye(n)[ys], np.array(links, np.int64).reshape(-1, 3)
    pairs = np.zeros((len(e), n, n))
    pairs[np.arange(len(e)), np.array(ys)[e[:, 0]], np.array(ys)[e[:, 1]]] = 1
    square = [np.full(field.unary.shape, 1e-8), np.full(field.pairs.shape, 1e-8)]
    for turn in range(turns):
        p, q = pass_messages(field, x, e)
        unary = (y - p).T @ x - (field.unary - mean.unary)
        both = np.stack([(pairs - q)[e[:, 2] == k].sum(0) for k in range(len(AGREE))])
        both = both + both.transpose(0, 2, 1) - (field.pairs - mean.pairs)
        steps = []
        for k, g in enumerate((unary, both)):
            square[k] = 0.9 * square[k] + 0.1 * g * g
            steps.append(0.15 / (1 + turn / 20) * g / np.sqrt(square[k]))
        field = Field(field.unary + steps[0], field.pairs + steps[1])
    return field


def all_spans(field: Field, text: str, rounds: int = ROUNDS) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Pattern matches, and all spans: those and the field's own, by kind as in LABELS, then start."""
    found = base_spans(text)
    spans = [(kind, s, e) for kind in KINDS for s, e in found[kind]]
    own = nodes(text)
    inside = _inside(found, own)
    if not all(inside):
        p, _ = pass_messages(field, np.array([features(x, k) for x, k in zip(own, inside, strict=True)]), np.array(edges(own), np.int64).reshape(-1, 3), rounds, pairs=False)
        for i in np.flatnonzero((p[:, 1:].max(1) >= SURE) & (np.array(inside) == 0)):
            spans.append((LABELS[p[i].argmax()], own[i].start, own[i].end))
    return found, sorted(spans, key=lambda x: (LABELS.index(x[0]), x[1], x[2]))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Field:
    """Fit on at most ``sample`` documents, the first by a hash of their id."""
    rows = fields(docs, id=doc_id, text=text).where(F.col("id").isNotNull())
    chosen = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    taken = sorted((r.id, r.text or "") for r in rows.join(F.broadcast(chosen), "id").select("id", "text").toLocalIterator())
    return fit([t for _, t in taken])


def find_personal_data(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text", redact: bool = False) -> DataFrame:
    """One row per document: doc_id, base and spans (arrays of kind, start, end) and, if asked for, the redacted text.

    Offsets are code points, ends exclusive. Redaction puts the kind in
    brackets in place of each span; of overlapping spans the union goes under
    the first one's kind. Null texts are empty and stay null when redacted.
    Null ids and repeated rows are treated like any other. A text is looked at
    whole, with some 500 bytes of work space for each possible token. An empty
    table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("pii")
        for batch in batches:
            base, spans, texts = [], [], []
            for value in batch.column(1):
                own = value.as_py()
                found, every = all_spans(shared.value, own or "")
                base.append([{"kind": k, "start": s, "end": e} for k in KINDS for s, e in found[k]])
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in every])
                if redact:
                    texts.append(redacted(own, every) if own else own)
            columns = [batch.column(0), pa.array(base, span), pa.array(spans, span)] + [pa.array(texts, pa.string())] * redact
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "base", "spans", "text"][: len(columns)])

    one = "array<struct<kind: string, start: long, end: long>>"
    return fields(docs, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id long, base {one}, spans {one}" + ", text string" * redact)


def redact(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs, all columns, with the kind in brackets in place of each span, as find_personal_data does it; rows are changed where they are read, with no shuffle."""
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("pii")
        for batch in batches:
            texts = [t and redacted(t, all_spans(shared.value, t)[1]) for t in (value.as_py() for value in batch.column(at))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op7_skip_chain_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_personal_data(docs, train(docs))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
