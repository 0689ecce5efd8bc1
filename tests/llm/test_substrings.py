"""Repeated substrings against brute force, past each threshold."""

import collections

import numpy as np
import pytest

from tessera.llm import packing, substrings
from tests.llm.test_llm import table


def test_longest_previous_factors():
    rng = np.random.default_rng(0)
    for size, letters in ((1, 2), (40, 1), (60, 2), (80, 3)):
        data = rng.integers(0, letters, size + 7).astype(np.uint8)
        windows = np.lib.stride_tricks.sliding_window_view(data, 8)
        place = rng.permutation(len(windows)) // 2  # some places twice
        got = substrings.longest_previous_factors(windows, place)
        for i in range(len(windows)):
            common = [8 if (windows[i] == windows[j]).all() else int((windows[i] != windows[j]).argmax()) for j in range(len(windows)) if place[j] < place[i]]
            assert got[i] == max(common, default=0)


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("small", [{}, {"TOGETHER": 300}, {"TOGETHER": 0, "PART": 500}, {"COMPARED": 50, "GATHERED": 20, "PART": 500}])
def test_past_thresholds(spark, monkeypatch, small):
    """One passage in a third of the documents, with different surroundings and small changes; periodic and long texts."""
    for name, value in small.items():
        monkeypatch.setattr(substrings, name, value)
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdé "), 9))
    passage = " ".join(word() for _ in range(40))
    rows = []
    for k in range(90):
        text = " ".join(word() for _ in range(rng.integers(0, 30)))
        if k % 3 == 0:
            at = rng.integers(0, len(passage))
            text += passage[:at] + "#" * (k % 2) + passage[at:] + word()
        if k % 10 == 1:
            text += "xy" * rng.integers(40, 400)
        rows.append((k, text))
    rows.append((95, rows[3][1] * 30))
    got = {r.doc_id: bytes(r.kept) for r in substrings.remove_repeats(table(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == brute(rows, 100)


def test_encoder_agrees_with_the_tokenizer():
    from tokenizers import Tokenizer

    encoder, tokenizer = packing.WordEncoder.of(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    rng = np.random.default_rng(6)
    pieces = [*"abc İIıéñßﬁǅ.,;:!?$%\"'-()\n\t  漢字ก12", "́", "̇", "İ.", "İ,,", "the", "x" * 70]
    for _ in range(10_000):
        text = "".join(rng.choice(pieces, rng.integers(1, 14)))
        assert list(np.frombuffer(encoder.encode(text), "<u4")) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_all_patterns():
    present = np.array([1, 2, 3, 5, 6, 8, 10])
    got = {tuple(map(int, t)) for t in packing.patterns(present, 10)}
    want = {(a, b, c) for a in (0, *present) for b in (0, *present) for c in (0, *present) if a <= b <= c and a + b + c == 10}
    assert got == want
    assert collections.Counter(len({x for x in t if x}) for t in got)[3] == 2
