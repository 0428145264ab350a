"""Every name's fuzzy score against a dynamic program written from the definitions alone."""

import random
from functools import cache
from itertools import product

import pytest

from catalyte import queries
from catalyte.functions import fuzzy, text

SMALL = "/root/testdata/sf0.001"


@cache
def indel(a, b):
    """Insertions and deletions from a to b, by the classic table."""
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(above[j - 1] if x == y else 1 + min(above[j], row[-1]))
        above = row
    return above[-1]


def similarity(a, b):
    return 100.0 * (1 - indel(a, b) / (len(a) + len(b))) if a or b else 100.0


def partial(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0 if long else 100.0
    cuts = {long[i:j] for i, j in product(range(len(long) + 1), repeat=2) if j > i and (j - i == len(short) or j - i < len(short) and (i == 0 or j == len(long)))}
    return max(similarity(short, c) for c in cuts)


def weighted(a, b):
    if not a or not b:
        return 0.0
    x, y = sorted(a.split()), sorted(b.split())
    shared, only_x, only_y = (sorted(s) for s in (set(x) & set(y), set(x) - set(y), set(y) - set(x)))
    forms = [" ".join(shared), " ".join(shared + only_x), " ".join(shared + only_y)]
    in_set = 100.0 if shared and not (only_x and only_y) else max(similarity(forms[1], forms[2]), *(similarity(forms[0], f) if shared else 0.0 for f in forms[1:]))
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(similarity(a, b), 0.95 * max(similarity(" ".join(x), " ".join(y)), in_set))
    parts = 100.0 if shared else max(partial(" ".join(x), " ".join(y)), partial(" ".join(only_x), " ".join(only_y)))
    down = 0.9 if longer <= 8 else 0.6
    return max(similarity(a, b), down * partial(a, b), down * 0.95 * parts)


def test_every_name(spark):
    rows = queries.QUERIES["fuzzy_name_score"](spark, SMALL).collect()
    wanted = text.parse_query("red hott brass")
    names = {r[0] for r in spark.read.parquet(f"{SMALL}/part.parquet").select(text.normalize_name("p_name")).distinct().collect()}
    assert {r.name for r in rows} == names and len(rows) == len(names)
    for r in rows:
        w = weighted(wanted.normalized, r.name) if r.name else 0.0
        hits = [partial(t, r.name) if len(t) >= 4 else 100.0 * (t in r.name.split()) for t in wanted.identity] if r.name else []
        base = 0.0 if not r.name else 0.7 * w / 100 + 0.3 * max(hits) / 100 if hits else w / 100
        assert r.weighted == pytest.approx(w, abs=2e-6) and r.base == pytest.approx(base, abs=2e-6), r


def test_random_strings():
    rng = random.Random(5)
    for _ in range(1500):
        a, b = ("".join(rng.choices("ab c", k=rng.randrange(14))).strip() for _ in range(2))
        assert fuzzy.ratio(a, b) == pytest.approx(similarity(a, b)) and fuzzy.partial_ratio(a, b) == pytest.approx(partial(a, b)), (a, b)
        assert fuzzy.weighted_ratio(a, b) == pytest.approx(weighted(a, b)), (a, b)
