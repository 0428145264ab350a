"""Source divergence against a dense brute force over terms and pairs, and awkward tables."""

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from catalyte.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(divergence.UPPER, divergence.LOWER)


def brute(rows, least=3, scale=10**9, top=200):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        groups[lang].add(source)
        counts[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in df[lang].items() if n >= least)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + scale * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_against_brute_force(spark):
    rng, words = np.random.default_rng(5), [f"{a}{b}" for a in ("Wort", "été", "the", "x", "漢") for b in ("a", "B", "É", "zz", "")]
    rows = []
    for k in range(160):
        skew = rng.dirichlet(np.full(len(words), 0.3))
        text = " ".join(rng.choice(words, int(rng.integers(0, 60)), p=skew))
        rows.append((text.replace(" ", ["-", " ", "\n", "3"][k % 4]), ["de", "fr"][k % 2], f"s{rng.integers(0, 7)}"))
    got = rows_of(divergence.divergence(frame(spark, rows)))
    assert got == brute(rows) and {r[2] for r in got} == {"pair", "term"}
    few = rows_of(divergence.divergence(frame(spark, rows), top=2, least_docs=1, scale=1000))
    assert few == brute(rows, least=1, scale=1000, top=2)


def test_awkward_tables(spark):
    rows = [("one two", "en", "a"), ("One two three", "en", "b"), ("ONE", "en", "b"), (None, "en", "wordless"), ("", None, None), ("12 ?!", "xx", "c"), ("lonely", "xx", None)]
    rows += [("one", "en", "a")] * 40 + [("one " * 30_000 + "two", "en", "hot")] * 3
    df = frame(spark, rows)
    extra = df.withColumns({c: F.lit("x") for c in ("term", "n", "df", "v", "rank", "item", "value", "part", "counts")})
    want = brute(rows)
    assert rows_of(divergence.divergence(df)) == want and rows_of(divergence.divergence(extra)) == want
    assert {(r[1], r[3]) for r in want if r[0] == "xx" and r[2] == "pair"} == {("", "c"), ("c", "")} and all(r[4] == 0 for r in want if r[0] == "xx")
    assert divergence.divergence(df.limit(0)).count() == 0


def test_counts_beyond_64_bits_are_exact(spark):
    n = spark.range(1).select(F.lit(40_000_000_000).alias("n"), F.lit(90_000_000_001).alias("total"), F.lit(7).cast("long").alias("v"))
    assert n.select(divergence.share(F.col("n"), F.col("total"), F.col("v"), 10**9)).first()[0] == 1 + 10**9 * 40_000_000_001 // 90_000_000_008
