"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import json
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catalyte.llm import chat, decontaminate, packing, quality, sharding, similar_texts, simhash, suffix, token_orc, topk, warc
from catalyte.llm._shared import Scratch, scratch
from catalyte.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "some words that go on and on, " * 40_000


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "an id that is null", "en", "a", 3)]
    rows += [(4, "same text twice", "en", "b", 5), (4, "same text twice", "en", "b", 5), (5, LONG, "en", "b", len(LONG)), (6, "ünï 漢字 😀 \x1c odd", "xx", "b", 9)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_sharding(spark, docs, none):
    got = sharding.shard(docs.withColumns({"shard": F.lit("x"), "slot": F.lit("y")}), 3).collect()
    assert len(got) == 8
    sizes = sorted(sum(r.shard == s for r in got) for s in range(3))
    assert sizes == [2, 3, 3]
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(none, 3).count() == 0


def test_sharding_hot_key_and_movement(spark):
    df = spark.range(30_000).select(F.when(F.col("id") < 10_000, 7).otherwise(F.col("id")).alias("doc_id"), "id")
    counts = [r["count"] for r in sharding.shard(df, 40, order=("id",)).groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1
    loose = spark.range(20_000).withColumnRenamed("id", "doc_id")
    a = {r.doc_id: r.shard for r in sharding.shard(loose, 20, slack=0.25).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard(loose, 21, slack=0.25).collect()}
    moved = sum(a[k] != b[k] for k in a) / len(a)
    assert max(np.bincount(list(a.values()))) <= 20_000 / 20 * 1.25 + 1 and moved < 0.25


def test_tokens_equal_the_library(docs):
    texts = [r.text or "" for r in docs.collect() if len(r.text or "") < 1000]
    texts += ["a  b", " lead", "trail ", "x\n y", "don't I'LL 12345 3.5€", "tab\t\n\n  end \n", "ﬁ é É", "<|endoftext|>", "hi <|endoftext|> there", "a<|startoftext|>b", "<|ENDOFTEXT|>"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encode, library = Encoder(public_tokenizers.path(name), memo=3), Tokenizer.from_file(public_tokenizers.path(name))
        for text in texts:
            assert list(np.frombuffer(encode(text), "<u4")) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_equal_the_library_on_made_up_texts(name):
    encode, library = Encoder(public_tokenizers.path(name), memo=50), Tokenizer.from_file(public_tokenizers.path(name))
    assert encode.kind != "whole"
    parts = ["the", "Don't", "it's", " ", "  ", "\n", "\t", "12", "3.5", "é", "É", "e\u0301", "\u00a0", "\u2028", "漢字", "😀", "ß", "İ", "ǆ", "'", "LL", "...", "€", "<|", "endoftext", "|>", "<|endoftext|>", "a" * 40]
    rng = np.random.default_rng(9)
    for _ in range(3000):
        text = "".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 12)))
        assert list(np.frombuffer(encode(text), "<u4")) == library.encode(text, add_special_tokens=False).ids, text


def test_tokens_fall_back_to_the_library(tmp_path):
    setup = json.loads(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).to_str())
    setup["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(setup))
    encode = Encoder(str(tmp_path / "other.json"))
    assert encode.kind == "whole" and list(np.frombuffer(encode("a b"), "<u4")) == Tokenizer.from_file(str(tmp_path / "other.json")).encode("a b", add_special_tokens=False).ids


def test_token_files(spark, docs, none):
    path = scratch(spark, "test-orc")
    token_orc.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 0)
    got = sorted(token_orc.token_index(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 4, 5, 6]
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert next(r for r in got if r.doc_id == 3).ids_crc32 == zlib.crc32(b"\0\0\0\0")
    assert token_orc.read_tokens(spark, path, ids=[5]).count() == 1
    empty = scratch(spark, "test-orc")
    token_orc.write_tokens(none, empty, public_tokenizers.path("byte_bpe_50k.json"), 0)
    assert token_orc.token_index(spark, empty).count() == 0


def test_packing(spark, docs, none):
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1).collect()
    by_window = {}
    for r in rows:
        assert len(r.ids) == r.length <= 2048
        by_window.setdefault(r.sequence_id, []).append(r)
    for pieces in by_window.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
    five = sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.start)
    assert sum(r.length for r in five) == five[0].doc_tokens and five[-1].ids[-1] == 1
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 4)
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json"), 1).count() == 0


def test_tier_packer_fills_every_window_but_the_last():
    packer, rng, total, windows = packing.TierPacker(pool_tokens=5000), np.random.default_rng(0), 0, []
    for doc in range(500):
        n = int(rng.integers(1, 6000))
        total += n
        windows += packer.add(doc, n)
    windows += packer.finish()
    sizes = [sum(n for _, _, n in w) for _, _, w in windows]
    assert sum(sizes) == total
    assert sum(s not in packing.TIERS for s in sizes) <= 1


def test_simhash(spark, docs, none):
    got = {}
    for r in simhash.near_classes(docs).collect():
        got.setdefault(r.doc_id, []).append((r.fp, r.component_id))
    assert got[2] == got[3] == [(0, 2)] and len(got[4]) == 2 and set(c for _, c in got[4]) == {4}
    assert got[None] == [(got[None][0][0], None)]
    assert simhash.near_classes(none).count() == 0


def test_covering_masks_cover():
    rng = np.random.default_rng(1)
    masks = np.array(simhash.covering_masks(3), np.int64).view(np.uint64)
    assert len(masks) == 15
    for _ in range(2000):
        difference = np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
        assert ((masks & difference) == 0).any()


def test_finer_masks_lose_no_pair():
    rng, masks = np.random.default_rng(3), simhash.covering_masks(3)
    finer = np.array(simhash.finer_masks(masks, 3), np.int64).view(np.uint64).reshape(len(masks), 4)
    for _ in range(2000):
        difference = np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
        for t, m in enumerate(np.array(masks, np.int64).view(np.uint64)):
            assert m & difference or ((finer[t] & difference) == 0).any()


def test_simhash_blocks_find_what_one_block_finds(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**63))
    fps = {base} | {base ^ int(sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 5), replace=False))) for _ in range(300)}
    df = spark.createDataFrame([(f, k) for k, f in enumerate(sorted(fps))], "fp long, rep long")

    def classes(block):
        links = simhash.near_links(df, 3, Scratch(spark, "test"), block=block)
        from catalyte.llm.components import components

        return {(r.node, r.component) for r in components(links).collect()}

    assert classes(1024) == classes(16)


def test_suffix(spark, docs, none):
    passage = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(260))
    rows = [(10, passage), (11, "x" * 50 + passage[:230] + "é" * 40), (12, "clean " * 10), (13, None), (14, "q" * 450)]
    extra = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("uid", F.lit(1))
    got = {r.doc_id: r for r in suffix.cut_repeats(extra).collect()}
    assert bytes(got[10].kept) == passage[230:].encode() and bytes(got[11].kept) == ("x" * 50 + "é" * 40).encode()
    assert (got[12].n_spans, got[13].n_bytes, len(got[14].kept), got[14].n_spans) == (0, 0, 0, 1)
    again = suffix.cut_repeats(extra, crowd=0, carry=("uid",)).collect()
    assert {r.doc_id: bytes(r.kept) for r in again} == {k: bytes(r.kept) for k, r in got.items()} and {r.uid for r in again} == {1}
    with pytest.raises(ValueError):
        suffix.cut_repeats(extra, carry=("kept",))
    assert len(suffix.cut_repeats(docs).collect()) == 8 and suffix.cut_repeats(none).count() == 0


def brute_cut(texts, span):
    seen, out = {}, {}
    for t in texts.values():
        for i in range(len(t) - span + 1):
            seen[t[i : i + span]] = seen.get(t[i : i + span], 0) + 1
    for k, t in texts.items():
        gone = set()
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone |= set(range(i, i + span))
        out[k] = "".join(c for i, c in enumerate(t) if i not in gone).encode()
    return out


@pytest.mark.parametrize("crowd,parts", [(2000, 10), (0, 10), (0, 3), (5, 101)])
def test_suffix_with_crowded_anchors(spark, crowd, parts):
    """Many variants of one template: anchors with many contexts, repeats that end at every distance from them."""
    rng = np.random.default_rng(11)
    template = rng.integers(97, 123, 900, np.uint8)
    texts = {}
    for k in range(40):
        t = template.copy()
        t[rng.integers(0, 900, rng.integers(0, 9))] = 65
        texts[k] = t.tobytes().decode()[int(rng.integers(0, 300)) : int(rng.integers(500, 900))]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix.cut_repeats(df, crowd=crowd, parts=parts).collect()}
    assert got == brute_cut(texts, 200)


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = rng.integers(1, rng.integers(2, 6), rng.integers(0, 60)).tolist()
        assert suffix.suffix_array(text) == sorted(range(len(text)), key=lambda k: text[k:])


def test_anchors_do_not_depend_on_parts(monkeypatch):
    text = np.random.default_rng(4).integers(97, 123, 5000, np.uint8).tobytes()
    whole = suffix.anchors(text)[0].tolist()
    monkeypatch.setattr(suffix, "PART", 300)
    assert suffix.anchors(text)[0].tolist() == whole


def brute_topk(rows, k):
    whole = sorted((i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows)
    out = {}
    for q, a in whole:
        if q % 100 == 0:
            out.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)
    return {q: [(i, -s) for s, i in sorted(found)[:k]] for q, found in out.items()}


def ranked(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [0.5, -0.25]), (100, [1.0, 0.0]), (5, [0.5]), (6, [0.5, 0.0]), (7, [30.0, 0.0]), (7, [30.0, 0.0]), (8, []), (7, [-2.0, 1.0]), (100, [0.0, 2.0])]
    bad = [(1, None), (2, [nan, 0.0]), (3, [None, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumns({"rank": F.lit("x"), "id": F.lit("x"), "group": F.lit(1)})
    assert ranked(topk.top_k(df, F.col("id") % 100 == 0, k=3)) == brute_topk(good, 3)
    assert topk.top_k(df.limit(0), F.col("id") % 100 == 0).count() == 0
    assert topk.top_k(df, F.col("id") < 0).count() == 0


def test_topk_counts_repeated_rows_as_its_sql(spark):
    """Repeated rows and ids, as candidates and as queries, a hot one among them."""
    rows = [(0, [1.0, 0.0]), (5, [0.5, 0.0]), (5, [0.5, 0.0]), (6, [0.5, 0.0]), (7, [0.25, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (100, [1.0, 1.0]), (9, [0.1, 0.9]), (9, [0.9, 0.1])]
    rows += [(8, [0.3, 0.3])] * 400
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    few = topk.top_k(df.filter("vec_id < 8"), F.col("id") % 100 == 0, k=3)
    assert [i for i, _ in ranked(few)[0]] == [5, 5, 6]
    for k in (3, 10, 50):
        assert ranked(topk.top_k(df, F.col("id") % 100 == 0, k=k, block=8, segment=64, group=2, sample=12, pivots=2)) == brute_topk(rows, k)
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [i for i, _ in rows], "embedding": [v for _, v in rows]}))
    got = topk.top_k(df, F.col("id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(tuple(r) for r in got) == sorted(con.sql(topk.ORACLE_SQL["op1_topk"]).fetchall())


def test_topk_of_large_components_is_exact(spark):
    rows = [(0, [1.0, 2.0]), (1, [200000.0, 1.0]), (2, [300000.0, 0.0]), (3, [200000.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ranked(topk.top_k(df, F.col("id") % 100 == 0)) == {0: [(2, 314572800000), (3, 209719394304), (1, 209717297152)]}
    rows = [(0, [5e9, -5e9, 1.0]), (1, [2000.0, 2000.0, 3.0]), (2, [2001.0, 2000.0, 2.0]), (3, [2001.0, 2000.0, 1.0]), (4, [0.0, 1.0, 1.0]), (100, [-5.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ranked(topk.top_k(df, F.col("id") % 100 == 0)) == brute_topk(rows, 10)
    for beyond in ([(0, [3e12]), (1, [3e12])], [(0, [1e300]), (1, [1.0])]):
        with pytest.raises(Exception, match="beyond 64 bits"):
            topk.top_k(spark.createDataFrame(beyond, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0).collect()


def test_topk_in_waves_groups_and_parts(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), (rng.normal(size=8) / 3).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("id") % 100 == 0, block=8, segment=64, group=4, sample=12, pivots=4)
    assert ranked(got) == brute_topk(rows, 10)


def test_topk_pruning_is_exact():
    rng = np.random.default_rng(5)
    x = rng.integers(-500, 500, (640, 16))
    ids, q, qid = np.arange(640), x[:5], np.arange(5)
    forward = x.reshape(10, 64, 16)
    score, best, done = topk.search_blocks(qid, q, ids.reshape(10, 64), forward, forward.max(1), forward.min(1), 10, np.full(5, topk.NONE + 1))
    for k in range(5):
        want = sorted(((-int(x[k] @ x[j]), j) for j in range(640) if j != k))[:10]
        assert list(zip((-score[k]).tolist(), best[k].tolist())) == want
    assert done <= 50


def test_warc(spark):
    rows = [(1, "http://a/x y", "<p>" + "z" * 200), (2, None, "<p>" + "z" * 200), (3, "http://b\r\nx", None), (None, "http://c", "<p>" + "z" * 200), (4, "http://d", "short"), (5, "http://e", "short"), (6, "http://f", "WARC/1.1\r\n\x1f " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = scratch(spark, "test-warc")
    files = warc.write_warc(pages, path, roll_bytes=500)
    for split in (1 << 20, 97):
        got = {r.page_id: r for r in warc.read_warc(spark, path, files, split_bytes=split).collect()}
        assert len(got) == 7 and got[1].record_type == "response" and (got[2].record_type, got[2].refers_to) == ("revisit", 1)
        assert got[4].record_type == got[5].record_type == "response" and got[3].payload_bytes == 0
        assert bytes(got[6].payload) == rows[6][2].encode() and got[6].payload_digest == hashlib.sha256(rows[6][2].encode()).hexdigest()
    none = warc.write_warc(pages.limit(0), scratch(spark, "test-warc"))
    assert none.count() == 0 and warc.read_warc(spark, path, none).count() == 0


def test_warc_with_many_repeats_joins(spark, monkeypatch):
    pages = spark.createDataFrame([(k, None, "z" * (100 + k // 2)) for k in range(20)], "page_id long, url string, html string")
    sent = warc.plan_revisits(pages, 100).collect()
    monkeypatch.setattr(warc, "MOST_SENT", 0)
    assert sorted(warc.plan_revisits(pages, 100).collect(), key=lambda r: r.page_id) == sorted(sent, key=lambda r: r.page_id)
    assert [r.refers_to for r in sorted(sent, key=lambda r: r.page_id)][:4] == [None, 0, None, 2]


def test_quality(spark, docs, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs.withColumns({"score": F.lit("x"), "predicted": F.lit("y")}), empty).collect()
    assert len(got) == 8 and all(r.score == 1.0 and r.predicted == 1 for r in got)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)] + [(None, 1, 0), (1, None, 0), (2, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame([(k, "a plain line of words" if k % 2 else "### $$$ ### !!!") for k in range(100)], "doc_id long, text string")
    scored = {r.doc_id: r for r in quality.classify(texts, labels).collect()}
    assert all((r.predicted == 1) == bool(k % 2) for k, r in scored.items()) and all(0 <= r.score <= 1 for r in scored.values())
    assert quality.classify(none, labels).count() == 0


def test_decontaminate(spark, docs, none):
    words = [f"w{k}" for k in range(30)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "Two, words"), (4, ""), (5, " ".join(words))], "item_id long, text string")
    texts = [(1, "x " * 3000 + " ".join(words).upper()), (2, " ".join(words[:26])), (3, " ".join(words[:20])), (4, "so two words! here"), (5, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item", F.lit("clash"))
    got = {(r.doc_id, r.item): (r.n_found, r.n_shingles) for r in decontaminate.contained(df, items).collect()}
    assert got == {(1, 1): (26, 26), (1, 5): (26, 26), (2, 1): (22, 26), (2, 5): (22, 26), (4, 3): (1, 1)}
    for part in (10, 30, 60):  # items in slices, and in passes of their own
        assert {(r.doc_id, r.item): (r.n_found, r.n_shingles) for r in decontaminate.contained(df, items, part=part).collect()} == got
    twice = decontaminate.contained(df.union(df), items, part=10).collect()
    assert len(twice) == 2 * len(got) and {(r.doc_id, r.item): (r.n_found, r.n_shingles) for r in twice} == got
    assert decontaminate.contained(none, items).count() == 0 and decontaminate.contained(df, items.limit(0)).count() == 0


def test_decontaminate_finds_every_item_down_to_the_threshold(spark):
    """Items of every size partition, scattered over long documents with as many shingles gone as may be, and one more."""
    rng, docs, items = np.random.default_rng(12), [], []
    for k in range(60):
        n = int(rng.integers(1, 150))
        words = [f"i{k}x{j}" for j in range(n + 4)]
        may = decontaminate.slack(n, 0.8)
        items.append((k, " ".join(words)))
        for more in (0, 1):
            parts = [" ".join(words[j : j + 5]) for j in rng.permutation(n)[may + more :]]
            docs.append((2 * k + more, " ".join(x for p in parts for x in (p, *(f"f{rng.integers(0, 500)}" for _ in range(20)))) or "none"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).withColumnRenamed("item", "item_id").collect()}
    assert got == {(2 * k, k) for k in range(60)}


def test_chat(spark):
    a = [("user", "hi"), ("assistant", "yo"), ("user", "more")]
    rows = [(1, k, *t) for k, t in enumerate(a[:2])] + [(2, k, *t) for k, t in enumerate(a)] + [(3, k, *t) for k, t in enumerate(a)] + [(4, 0, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chat", F.lit("clash"))
    got = {r.conv_id: (r.n_turns, r.copies, r.chat) for r in chat.format_chats(df).collect()}
    assert set(got) == {2, 4, None} and got[2][:2] == (3, 2)
    assert got[2][2] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>\n<|user|>\nmore\n<|end|>" and got[4][2] == "<||>\n\n<|end|>"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_orders_tied_turns_by_text(spark):
    rows = [(1, 0, "user", t) for t in ("beta", "zeta", "mid", "alpha")] + [(2, 0, "user", "zeta"), (3, 0, "user", "alpha"), (4, 0, "user", "mid"), (4, 0, "user", "alpha"), (4, 0, "user", "beta")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit("clash"), "hash": F.lit("clash")})
    got = {r.conv_id: r.chat for r in chat.format_chats(df).collect()}
    assert set(got) == {1, 2} and [line for line in got[1].split("\n") if "|" not in line] == ["alpha", "beta", "mid", "zeta"]


def test_similar_texts(spark):
    words = [f"w{k}" for k in range(100)]
    other = list(words)
    other[50] = "changed"
    far = list(words)
    for k in (10, 30, 50, 70, 90):
        far[k] = "x"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(far)), (4, ""), (5, None), (6, " ".join(words).upper()), (7, "short text"), (8, "short text"), (9, "another one")]
    df = spark.createDataFrame(rows, "uid long, text string")
    got = {frozenset((r.u, r.v)) for r in similar_texts.links(df).collect()}
    assert got == {frozenset(p) for p in ((1, 2), (1, 6), (4, 5), (7, 8))}
    many = spark.createDataFrame([(k, " ".join(words[:-1] + [f"end{k}"])) for k in range(60)], "uid long, text string")
    from catalyte.llm.components import components

    for block in (1024, 8):
        assert {r.component for r in components(similar_texts.links(many, block=block)).collect()} == {0}
    assert similar_texts.links(df.limit(0)).count() == 0


def test_similar_texts_tests_what_a_failed_tie_leaves(spark):
    """Eight looser variants of one template, each with a true copy; all have the same words and thus the same fingerprint."""

    def swapped(words, places):
        words = list(words)
        for k in places:
            words[k], words[k + 1] = words[k + 1], words[k]
        return words

    template, rows = [f"w{k}" for k in range(240)], []
    for k in range(8):
        variant = swapped(template, range(3 + 3 * k, 240, 27))
        rows += [(k, " ".join(variant)), (100 + k, " ".join(swapped(variant, [238])))]
    sets = {k: set(similar_texts.shingle_set(t, 5).tolist()) for k, t in rows}
    true = {frozenset((u, v)) for u in sets for v in sets if u < v and len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v])}
    assert true == {frozenset((k, 100 + k)) for k in range(8)}
    df = spark.createDataFrame(rows, "uid long, text string")
    for block in (1024, 3):
        assert {frozenset((r.u, r.v)) for r in similar_texts.links(df, block=block).collect()} == true


def test_similar_texts_leaves_a_tied_family_alone(spark):
    """In a second round a family meets the rows beside it only: every pair of them, no pair of its own."""
    cells = [(7, 12, k, 100, bytes(64)) for k in range(12)]  # cell, m, rep, n, bits: all alike
    cells += [(8, 4, k, 100, bytes(64)) for k in range(4)]
    df = spark.createDataFrame(cells, "cell long, m long, rep long, n int, bits binary")
    named = spark.createDataFrame([(k, 0) for k in range(9)], "node long, component long")
    for block in (1024, 4, 2):
        got = {(r.v, r.u) for r in similar_texts.other_pairs(df, named, 0.8, Scratch(spark, "test"), block).collect()}
        assert got == {(u, v) for v in range(9, 12) for u in range(v)}


@pytest.mark.parametrize("kind", ["appended", "truncated", "scattered"])
def test_similar_texts_recall_at_the_threshold(spark, kind):
    """Pairs of distinct words with a similarity just over 0.8: nearly all are linked, whichever way they differ."""
    rng, rows, pairs = np.random.default_rng(7), [], 300
    for k in range(pairs):
        n = int(rng.integers(60, 600))
        words = [f"v{k}x{j}" for j in range(n)]
        if kind == "scattered":
            other = list(words)
            for j in range(max(1, int(0.2 / 1.8 * (n - 4) / 5))):
                other[3 + j * (n // max(1, int(0.2 / 1.8 * (n - 4) / 5)))] = f"e{k}x{j}"
        else:
            other = words + [f"t{k}x{j}" for j in range((n - 4) // 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        if kind == "truncated":
            rows[-2:] = [(2 * k, rows[-1][1]), (2 * k + 1, rows[-2][1])]
    sets = {k: set(similar_texts.shingle_set(t, 5).tolist()) for k, t in rows}
    assert all(len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1]) for k in range(pairs))
    got = {(min(r.u, r.v), max(r.u, r.v)) for r in similar_texts.links(spark.createDataFrame(rows, "uid long, text string")).collect()}
    assert got <= {(2 * k, 2 * k + 1) for k in range(pairs)} and len(got) >= 0.99 * pairs
