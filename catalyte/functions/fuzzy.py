"""Fuzzy name scores: normalized Indel similarity, its partial and weighted forms.

Spark's ``levenshtein`` counts substitutions and is no substitute. Names repeat a lot in a
catalogue, so score distinct names and join back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Query


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit a character of ``a``."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """200 * LCS / (length of both)."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with any window of the longer, cut windows at the ends included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 100.0
    n, m = len(short), len(long)
    windows = {long[max(0, k) : min(m, k + n)] for k in range(1 - n, m)}
    return max(ratio(short, w) for w in windows)


def _token_parts(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_ratio(a: str, b: str) -> float:
    """The better of the sorted-token and the token-set ratio."""
    by_order = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    both, x, y = _token_parts(a, b)
    if both and (not x or not y):
        return 100.0
    with_x, with_y = f"{both} {x}".strip(), f"{both} {y}".strip()
    by_set = max(ratio(with_x, with_y), *((ratio(both, with_x), ratio(both, with_y)) if both else (0.0, 0.0)))
    return max(by_order, by_set)


def partial_token_ratio(a: str, b: str) -> float:
    both, x, y = _token_parts(a, b)
    if both:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(x, y))


def weighted_ratio(a: str, b: str) -> float:
    """The best of the above, partial forms weighted down; 0 if either is empty."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    whole = ratio(a, b)
    if lengths < 1.5:
        return max(whole, 0.95 * token_ratio(a, b))
    scale = 0.9 if lengths <= 8 else 0.6
    return max(whole, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def name_scores(name: Column, query: Query) -> Column:
    """struct(base, weighted): the identity score in [0, 1] and the weighted ratio in [0, 100] of normalized names."""
    wanted, tokens = query.normalized, list(query.identity)

    @F.pandas_udf("base double, weighted double")
    def score(names: pd.Series) -> pd.DataFrame:
        memo: dict[str, tuple[float, float]] = {}
        out = []
        for text in names:
            text = text or ""
            if text not in memo:
                w = weighted_ratio(wanted, text)
                base = w / 100
                if not text:
                    base = 0.0
                elif tokens:
                    words = text.split()
                    best = max((100.0 if t in words else 0.0) if len(t) < 4 else partial_ratio(t, text) for t in tokens)
                    base = 0.7 * w / 100 + 0.3 * best / 100
                memo[text] = base, w
            out.append(memo[text])
        return pd.DataFrame(out, columns=["base", "weighted"])

    return score(name)
