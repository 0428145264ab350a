"""Every corpus query over its whole sf0.001 table against SQL or a brute-force version, and the pipeline stage by stage."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from catalyte.llm import quality, registry, sharding
from catalyte.llm._shared import materialize

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    return registry.queries()[name](spark, SMALL).collect()


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages", "conversations", "documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    rel = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in got.columns]
    assert sorted(repr([plain(x) for x in r]) for r in got.collect()) == sorted(repr([plain(r[k]) for k in at]) for r in rel.fetchall())


# --- brute force -----------------------------------------------------------------------


def encoded(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return {k: np.array([*t.encode(x, add_special_tokens=False).ids, end], "<u4") for k, x in texts.items()}


def cut(texts, span=200):
    raw = {k: x.encode() for k, x in texts.items()}
    seen = Counter(b[i : i + span] for b in raw.values() for i in range(len(b) - span + 1))
    out = {}
    for k, b in raw.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[k] = len(b), int(gone.sum()), runs, gone
    return out


def simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(texts):
    ids = sorted(texts)
    fps = np.array([simhash(texts[k]) for k in ids], np.uint64)
    label = {k: k for k in ids}
    changed = True
    while changed:
        changed = False
        for i, k in enumerate(ids):
            near = [ids[j] for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3)]
            least = min(label[n] for n in near)
            for n in near:
                if label[n] > least:
                    label[n], changed = least, True
    return dict(zip(ids, fps.tolist())), label


def near_copies(texts):
    """Components of fingerprints within 3 bits or 5-word shingle sets at least 0.8 similar."""
    _, label = classes(texts)
    sets = {}
    for k, t in texts.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids, changed = sorted(texts), True
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in [*pairs, *label.items()]:
            least = min(label[a], label[b])
            if label[a] != least or label[b] != least:
                label[a] = label[b] = least
                changed = True
    return label


def shingles(text):
    w = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def contains(texts, items):
    sets = {k: shingles(x) for k, x in texts.items()}
    return {(d, i): (len(s & q), len(q)) for i, x in items.items() if (q := shingles(x)) for d, s in sets.items() if len(s & q) >= 0.8 * len(q) - 1e-9}


def check_pieces(rows, ids, key="doc_id"):
    per, windows = {}, {}
    for r in rows:
        per.setdefault(r[key], []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert set(per) == set(ids)
    for k, pieces in per.items():
        pieces.sort(key=lambda r: r.start)
        assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
        assert sum(p.length for p in pieces) == len(ids[k]) == pieces[0].doc_tokens
    for pieces in windows.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
    return [sum(p.length for p in w) for w in windows.values()]


def test_op2(spark, texts):
    want = cut(texts)
    for r in run(spark, "op2_suffix"):
        n, gone, runs, mask = want.pop(r.doc_id)
        kept = np.frombuffer(texts[r.doc_id].encode(), np.uint8)[~mask].tobytes()
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, runs, hashlib.sha256(kept).hexdigest())
    assert not want


def test_op3(spark, texts):
    ids, start = encoded("byte_bpe_50k.json", texts, 0), 0
    for r in sorted(run(spark, "op3_token_orc"), key=lambda r: r.doc_id):
        own = ids.pop(r.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert not ids


def test_op4(spark, texts):
    ids = encoded("word_bpe_49k.json", texts, 1)
    rows = run(spark, "op4_packing")
    lengths = check_pieces(rows, ids)
    assert max(lengths) <= 2048 and sum(n & (n - 1) != 0 for n in lengths) <= 1
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)


def test_op7_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = registry.queries()["op7_quality"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95


def test_op7_recomputed(spark, texts):
    """Word vectors, pooling and scores again, word by word in plain numpy; only the descent itself is shared."""
    index = quality.index_vectors(quality.WORDS, quality.WORD_DIM, 4, 7)
    marks = quality.index_vectors(quality.MARKS, quality.MARK_DIM, 4, 11)

    def split(word):
        core = word.strip(quality.SIGNS)
        case = "-" if not core else "D" if core[0].isdigit() else "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l"
        tail = re.sub(r"(.)\1+", r"\1+", word[len(word.rstrip(quality.SIGNS)) :])
        return zlib.crc32(core.lower().encode()) % quality.WORDS, 1 + zlib.crc32(f"{case}{tail}".encode()) % (quality.MARKS - 1)

    parts = {k: [split(w) for w in t.split()] for k, t in texts.items()}
    near = np.zeros((quality.WORDS, quality.WORD_DIM))
    for words in parts.values():
        for (a, _), (b, _) in zip(words, words[1:]):
            near[a] += index[b]
            near[b] += index[a]
    assert (quality.neighbour_sums(spark.read.parquet(f"{SMALL}/documents.parquet")).reshape(near.shape) == near).all()
    length = np.sqrt((near**2).sum(1, keepdims=True))
    vectors = (index / 2 + near / np.maximum(length, 1)).astype(np.float32)

    def features(words):
        if not words:
            return np.zeros(quality.WORD_DIM + quality.MARK_DIM)
        mean = sum(vectors[w].astype(float) for w, _ in words) / (len(words) + quality.SHRINK)
        mark = sum(marks[m].astype(float) for _, m in words) / len(words)
        same = sum(a[0] == b[0] for a, b in zip(words, words[1:])) / len(words)
        return np.concatenate([mean, mark + same * marks[quality.SAME]])

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    net = quality.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), labels, learn=~quality.held_out())
    assert np.abs(net.vectors - vectors).max() < 1e-5 and net.constant is None
    for r in run(spark, "op7_quality"):
        hidden = np.tanh((features(parts[r.doc_id]) - net.mean) / net.spread @ net.w1 + net.b1)
        want = 1 / (1 + math.exp(-float(hidden @ net.w2 + net.b2) / net.temperature))
        assert abs(r.score - want) < 1e-4 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_op8(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    assert {(r.doc_id, r.item_id): (r.n_found, r.n_shingles) for r in run(spark, "op8_decontaminate")} == contains(texts, items)


def test_op9(spark, texts):
    rows = run(spark, "op9_sharding")
    per = Counter(r.shard for r in rows)
    assert {r.doc_id for r in rows} == set(texts) and set(per) == set(range(40)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows" for r in rows)


def test_op9_walks_the_ring(spark, texts):
    """Every key walks by itself: its own point's shard first, and clockwise on while shards are full."""
    bits, vnodes, shards = sharding.CELL_BITS, 64, 40
    points = sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") >> (64 - bits), s) for s in range(shards) for v in range(vnodes))
    owner = [next((s for p, s in points if p >= c), points[0][1]) for c in range(1 << bits)]
    cell = {r.doc_id: r.c for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit("ring"), "doc_id"), 64 - bits).alias("c")).collect()}
    room = [len(texts) // shards + (s < len(texts) % shards) for s in range(shards)]
    load, late = Counter(), []
    for c in sorted(cell.values()):
        if room[owner[c]]:
            room[owner[c]] -= 1
            load[c, owner[c]] += 1
        else:
            late.append(c)
    waiting = late  # keys that did not fit walk together, in the order in which the walk meets them
    for step in range(2 << bits):
        at = step % (1 << bits)
        ready = [c for c in waiting if c <= at or step >> bits]
        for c in ready:
            if room[owner[at]]:
                room[owner[at]] -= 1
                load[c, owner[at]] += 1
                waiting.remove(c)
    assert not waiting and Counter((cell[r.doc_id], r.shard) for r in run(spark, "op9_sharding")) == load


def test_op10(spark, texts):
    fps, label = classes(texts)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in run(spark, "op10_simhash")} == {k: (fps[k], label[k]) for k in texts}


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    def step(name, before):
        out = materialize(stages[name](spark, before, SMALL), "test-stage")
        rows = out.collect()
        if name != "packing":
            assert out.columns == columns
        return out, rows

    docs, rows = step("quality classifier", docs)
    kept = {r.doc_id: r.text for r in rows}
    assert all(texts[k] == t for k, t in kept.items()) and 0 < len(kept) < len(texts)
    docs, rows = step("SimHash near-dedup", docs)
    label = near_copies(kept)
    kept = {k: t for k, t in kept.items() if label[k] == k}
    assert {r.doc_id: r.text for r in rows} == kept
    docs, rows = step("suffix-array dedup", docs)
    for k, (_, _, _, gone) in cut(kept).items():
        raw = np.frombuffer(kept[k].encode(), np.uint8)
        edges = np.flatnonzero(np.diff(gone.astype(int))) + 1
        parts = np.split(raw, edges)
        if len(raw):
            kept[k] = "".join(p.tobytes().decode("utf-8", "ignore") for p in parts[int(gone[0]) :: 2])
    assert {r.doc_id: r.text for r in rows} == kept and all(r.n_chars == len(r.text) for r in rows)
    docs, rows = step("benchmark decontamination", docs)
    gone = {d for d, _ in contains(kept, items)}
    kept = {k: t for k, t in kept.items() if k not in gone}
    assert {r.doc_id: r.text for r in rows} == kept
    ids = encoded("word_bpe_49k.json", kept, 1)
    _, rows = step("packing", docs)
    check_pieces(rows, ids)
    assert all(r.ids == ids[r.doc_id][r.start : r.start + r.length].tolist() for r in rows)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one two three", "en", "a", 13), (1, "one two three", "en", "a", 13), (None, None, None, None, None), (2, "", "en", "a", 0), (3, "x" * 500, "en", "a", 500)]
    for name, table, kind in (("documents", rows, schema), ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [(1, None)], "item_id long, text string")):
        spark.createDataFrame(table, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} >= {1, 3} and len(got) == 3  # equal rows are one document, and of the two texts without words one stays
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/e/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/e/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0


def test_pipeline_carries_columns_of_any_name(spark):
    """Extra columns named like the operators' own keep their values, types and places through the filtering stages."""
    clash = ["uid", "score", "held_out", "predicted", "kept", "n_bytes", "n_spans", "kept_text", "component_id", "fingerprint", "item", "containment", "__key", "__own_0", "spans", "text_hash", "id", "words"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    marked = docs.select(*(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in clash), *docs.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = {r.doc_id: r.text for r in stage(spark, docs, SMALL).collect()}
        out = stage(spark, marked, SMALL)
        assert out.dtypes == marked.dtypes, name
        rows = out.collect()
        assert {r.doc_id: r.text for r in rows} == plain and len(rows) == len(plain) > 0, name
        assert all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in clash), name
    assert corpus_pipeline.packed(spark, marked.limit(3), SMALL).count() >= 3
