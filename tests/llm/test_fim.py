"""Fill-in-middle: zero-width splitting against a plain scan, cuts and restoring against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalyte.llm import fim

PLAIN = {
    "letters": re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S),
    "lines": re.compile(r"[^\n]+|\n"),
    "characters": re.compile(r".", re.S),
}


def made_up(count, seed=3):
    parts = ["the", "A", "z", "Don't", " ", "  ", "\n", "\r\n", "\t", "12", "é", "é", "漢字", "😀", "👩‍👩‍👧", "\x00", "<P>", "<", "<S", ">", "P>", " ", "ß", "-"]
    rng = np.random.default_rng(seed)
    return ["", "a", "😀", "\n", "abc", "é1", *("".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 15))) for _ in range(count))]


@pytest.mark.parametrize("grammar", sorted(PLAIN))
def test_units_equal_a_scan_and_lose_nothing(spark, grammar):
    texts = made_up(600)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    for r in df.select("k", fim.units(F.col("text"), grammar).alias("u")).collect():
        assert r.u == PLAIN[grammar].findall(texts[r.k]), repr(texts[r.k])


def test_word_grammar(spark):
    df = spark.createDataFrame([("Où est-il? 12\n\n😀😀 naïve",)], "text string")
    assert df.select(fim.units(F.col("text"), "words")).first()[0] == ["Où", " ", "est", "-", "il", "?", " ", "12", "\n\n", "😀", "😀", " ", "naïve"]


def brute(key, text):
    u = PLAIN["letters"].findall(text)
    h = [int(hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(u), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out


def test_transform_and_restore(spark):
    long = "word, 😀 " * 60_000
    rows = [(k, t) for k, t in enumerate(made_up(500))] + [(None, "a null id"), (7, None), (8, long), (9, "same twice"), (9, "same twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "output": F.lit(1), "__fim_n": F.lit(2), "other": F.lit("kept")})
    got = fim.transform(df).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert "__fim_n" not in got[0] and all(r.other == "kept" for r in got)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == sorted(((k, t, *brute(k, t or "")) for k, t in rows), key=repr)
    assert all(r.back == (r.text or "") for r in got) and {r.form for r in got} == {"plain", "spm", "psm"}
    assert fim.transform(df.limit(0)).count() == 0


def test_sentinels_must_not_overlap(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for bad in (("<P>", "<S>", ""), ("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            fim.transform(df, sentinels=bad)
    out = fim.transform(df, sentinels=("<|pre|>", "<|suf|>", "<|mid|>"), keep=0, spm=0).first()
    assert out.form == "psm" and out.output.startswith("<|pre|>")
