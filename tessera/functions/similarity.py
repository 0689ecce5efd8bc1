"""String similarities that Spark lacks, between 0 and 1, in one Arrow-batched UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def _best_window(a: str, b: str) -> float:
    """Best ratio of a over windows of b as long as a, also those that overhang b's ends."""
    n, best = len(a), 0.0
    spare: dict[str, int] = {}
    for c in a:
        spare[c] = spare.get(c, 0) + 1
    # shared: characters that a and the window have in common in any order, a bound of the longest common subsequence.
    shared = 0
    for end in range(1, len(b) + n):
        if end <= len(b):
            c = b[end - 1]
            spare[c] = spare.get(c, 0) - 1
            shared += spare[c] >= 0
        if end > n:
            c = b[end - n - 1]
            spare[c] += 1
            shared -= spare[c] > 0
        window = b[max(0, end - n) : end]
        if 2 * shared / (n + len(window)) > best:
            best = max(best, ratio(a, window))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string over windows of the longer one; of strings equally long, either way round."""
    if not a or not b:
        return float(a == b)
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 1.0
    return max(_best_window(a, b), _best_window(b, a) if len(a) == len(b) else 0.0)


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _token_sets(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, x, y = _token_sets(a, b)
    if both and (not x or not y):
        return 1.0
    one, two = f"{both} {x}".strip(), f"{both} {y}".strip()
    return max(ratio(one, two), ratio(both, one) if both else 0.0, ratio(both, two) if both else 0.0)


def partial_token_ratio(a: str, b: str) -> float:
    both, x, y = _token_sets(a, b)
    return 1.0 if both else max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(x, y))


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    sizes = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if sizes < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if sizes <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(matched, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    shared = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + 0.1 * shared * (1 - jaro)


NAME = {"ratio": ratio, "partial": partial_ratio, "sort": token_sort_ratio, "set": token_set_ratio, "weighted": weighted_ratio, "jw": jaro_winkler}
ADDRESS = {"ratio": ratio, "sort": token_sort_ratio, "set": token_set_ratio, "jw": jaro_winkler}


def _scored(kinds: dict):
    @F.pandas_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in kinds]))
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        # Equal strings score 1 and empty ones 0, without a comparison; pairs of a batch that repeat are compared once.
        pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
        known = {(x, y): [0.0] * len(kinds) if not x or not y else [1.0] * len(kinds) if x == y else [f(x, y) for f in kinds.values()] for x, y in set(pairs)}
        return pd.DataFrame([known[p] for p in pairs], columns=list(kinds))

    return run


name_similarities, address_similarities = _scored(NAME), _scored(ADDRESS)
