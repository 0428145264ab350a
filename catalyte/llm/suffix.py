"""Suffix-array dedup: remove every byte that a repeated string of at least ``span`` bytes covers.

1. Each text selects anchors: the 100-byte strings with the smallest hash in any window of
   ``span`` bytes. What a window selects depends on its bytes only, so two equal windows hold
   equal anchors at the same place, and every window holds one. Only anchors that occur twice
   can be in a repeat.
2. Such an anchor's context is all that a window around it can reach. Contexts are counted
   by content before they are dealt anywhere: a passage in a third of all texts is one row.
3. An anchor with one context is decided by its count. The others are dealt by anchor, and
   in a task the contexts of many anchors make one text of fixed-width symbols: the right
   sides, and the left sides read backwards. A suffix array of each (linear grouping by
   Lyndon prefixes) puts sides with long common beginnings next to each other. A window
   that starts ``a`` bytes left of the anchor is a repeat if another context agrees with it
   on ``a`` bytes to the left and ``span - a`` to the right, which the order and the common
   prefix lengths of neighbours tell exactly.
4. What is found for a context is joined to the places where it occurs (see ``_crowded_pieces``
   for anchors with very many contexts), and the spans are joined to the texts and cut out.

No text or group is gathered on the driver; the rows of a task are distinct contexts, not
occurrences.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Scratch, bounded_batches, table, text_or_empty
from .tokens import pieces_of

ANCHOR = 100
SYMBOL = 25
#: Long texts are hashed in parts of so many windows.
PART = 1 << 20


# --- the suffix array ------------------------------------------------------------------


def suffix_array(text: list[int]) -> list[int]:
    """Sort the suffixes of ``text`` (symbols from 1) in linear time, without recursion.

    Suffixes are grouped by their longest Lyndon prefix. From the highest group down, each
    suffix finds the nearest one before it in a smaller group; those found are set apart from
    their group, right behind it, by how often they were found. The groups are then in the
    order of the Lyndon prefixes, and one sweep over the output, following the same pointers,
    puts the suffixes of each group in order. (Baier, 2016.)
    """
    n = len(text) + 1
    symbols = [*text, 0]  # an end that is smaller than all
    line = sorted(range(n), key=symbols.__getitem__)  # suffixes, group by group
    place, group, end = [0] * n, [0] * n, [0] * (n + 1)
    first = 0
    for k, i in enumerate(line):
        if k and symbols[i] != symbols[line[k - 1]]:
            end[first] = k
            first = k
        place[i], group[i] = k, first
    end[first] = n
    before = [-1] * n  # the nearest earlier suffix of a smaller group

    def set_apart(found: list[int], start: int) -> None:
        stop = end[start]
        fresh = at = stop - len(found)
        if fresh == start:
            return
        at = stop
        for j in found:
            at -= 1
            other, hole = line[at], place[j]
            line[hole], place[other] = other, hole
            line[at], place[j] = j, at
        for j in found:
            group[j] = fresh
        end[fresh], end[start] = stop, fresh

    stop = n
    while stop > 1:
        start = group[line[stop - 1]]
        if stop - start == 1:
            i = line[start]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                g = group[j]
                last = end[g] - 1
                if last > g:
                    other, hole = line[last], place[j]
                    line[hole], place[other] = other, hole
                    line[last], place[j] = j, last
                    group[j] = last
                    end[last], end[g] = last + 1, last
        else:
            times: dict[int, int] = {}
            for i in sorted(line[start:stop]):
                j = i - 1
                while j >= 0 and group[j] >= start:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            by_times: dict[int, list[int]] = {}
            for j, k in times.items():
                by_times.setdefault(k, []).append(j)
            for k in sorted(by_times, reverse=True):
                by_group: dict[int, list[int]] = {}
                for j in by_times[k]:
                    by_group.setdefault(group[j], []).append(j)
                for g, found in by_group.items():
                    set_apart(found, g)
        stop = start

    out, free, put = [-1] * n, list(range(n)), bytearray(n)
    out[0], put[n - 1] = n - 1, 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not put[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            put[j] = 1
            j = before[j]
    return out[1:]


def ordered(sides: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each byte string (cut or padded to ``width``) and the common prefix length of
    neighbours in that order, by the suffix array of their symbols."""
    each = -(-width // SYMBOL)
    flat = np.frombuffer(b"".join(s[:width].ljust(each * SYMBOL, b"\0") for s in sides), np.uint8)
    _, symbols = np.unique(flat.view(f"S{SYMBOL}"), return_inverse=True)
    found = np.array(suffix_array((symbols + 1).tolist()))
    order = found[found % each == 0] // each  # only suffixes at the start of a side
    rows = flat.reshape(len(sides), -1)[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width) if len(sides) > 1 else np.zeros(0, np.int64)
    rank = np.empty(len(sides), np.int64)
    rank[order] = np.arange(len(sides))
    return rank, np.minimum(common, width)


def repeats(contexts: list[tuple[bytes, int]], times: np.ndarray, span: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """For contexts (bytes, how many of them are left of the anchor) that occur ``times``: the most
    and the fewest bytes left of the anchor at which a repeated window starts; -1 if none does."""
    reach = span - ANCHOR
    right_of, left_of = {}, {}
    r = np.array([right_of.setdefault(c[k:], len(right_of)) for c, k in contexts])
    l = np.array([left_of.setdefault(c[:k][::-1], len(left_of)) for c, k in contexts])
    r_len, l_len = np.array([len(c) - k for c, k in contexts]), np.array([k for _, k in contexts])
    r_rank, r_common = ordered(list(right_of), span)
    l_rank, l_common = ordered(list(left_of), reach)
    r, l = r_rank[r], l_rank[l]
    most, fewest = np.full(len(contexts), -1), np.full(len(contexts), -1)
    for a in range(reach + 1):
        able = np.flatnonzero((r_len >= span - a) & (l_len >= a))
        right = np.concatenate([[0], np.cumsum(r_common < span - a)])[r[able]]
        left = np.concatenate([[0], np.cumsum(l_common < a)])[l[able]]
        _, same = np.unique(right * (len(l_rank) + 1) + left, return_inverse=True)
        hit = able[np.bincount(same, times[able])[same] >= 2] if len(able) else able
        most[hit] = a
        fewest[hit[fewest[hit] < 0]] = a
    return most, fewest


# --- anchors ---------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def anchors(text: bytes, span: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text."""
    places, hashes = [], []
    whole = np.frombuffer(text, np.uint8)
    wide = span - ANCHOR + 1
    for at in range(0, len(whole) - span + 1, PART):
        x = whole[at : at + PART + span - 1]
        n = len(x)
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[x] * up[:n], out=sums[1:])
        h = (sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        low = np.uint64((1 << 21) - 1)
        tagged = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        # sliding minimum: of each block's end and the next block's beginning
        padded = np.full(-(-len(h) // wide) * wide, np.iinfo(np.uint64).max)
        padded[: len(h)] = tagged
        blocks = padded.reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[: len(h) - wide + 1], ahead[wide - 1 : len(h)]) & low
        found = np.unique(least[np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))].astype(np.int64))
        places.append(found + at)
        hashes.append(h[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def _anchor_rows(span: int):
    def run(batches):
        for batch in pieces_of(batches):
            keys, at, h = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                places, hashes = anchors(text.encode(), span)
                keys.append(np.full(len(places), key, np.int64))
                at.append(places)
                h.append(hashes.view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (keys, at, h)], names=["uid", "at", "h"])

    return run


# --- contexts --------------------------------------------------------------------------

#: ``cid``: 128-bit hash of the context and the anchor's place in it; ``g``: what deals contexts to tasks, the anchor's hash.
CONTEXTS = pa.schema([("cid", pa.binary()), ("g", pa.int64()), ("left", pa.int32()), ("context", pa.binary()), ("times", pa.int64()), ("found", pa.list_(pa.int64()))])
CONTEXTS_SQL = "cid binary, g long, left int, context binary, times long, found array<long>"


def _context_rows(span: int):
    """Contexts of the anchors at the given places; equal ones of a task's batch are one row with all their (uid, place)."""

    def run(batches):
        def flush(some: dict):
            cols = zip(*((xxhash.xxh3_128_digest(c, k), g, k, c, len(found) // 2, found) for (c, k), (g, found) in some.items()))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, CONTEXTS)], schema=CONTEXTS)

        some: dict = {}
        for batch in pieces_of(batches):
            for uid, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                for p in places:
                    start = max(0, p + ANCHOR - span)
                    key = raw[start : p + span], p - start
                    row = some.get(key)
                    if row is None:
                        g = xxhash.xxh64_intdigest(raw[p : p + ANCHOR])
                        row = some[key] = g - (1 << 64) if g >> 63 else g, []
                    row[1].extend((uid, p))
                if len(some) >= 40_000:
                    yield flush(some)
                    some = {}
        if some:
            yield flush(some)

    return run


def _verdict_rows(span: int, chunk: int = 24_000):
    """(cid, most, fewest) of the contexts that hold repeats, from complete groups ``g`` of distinct contexts."""

    def run(batches):
        def emit(rows):
            cid, _, left, context, times = zip(*rows)
            most, fewest = repeats(list(zip(context, left)), np.array(times), span)
            hit = np.flatnonzero(most >= 0)
            return pa.RecordBatch.from_arrays([pa.array([cid[k] for k in hit], pa.binary()), pa.array(most[hit], pa.int32()), pa.array(fewest[hit], pa.int32())], names=["cid", "most", "fewest"])

        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(rows) >= chunk and row[1] != rows[-1][1]:
                    yield emit(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield emit(rows)

    return run


def _crowded_pieces(contexts: DataFrame, span: int, parts: int) -> DataFrame:
    """(cid, piece, g, left, context, times) for anchors with very many contexts.

    The possible window starts are cut into ``parts`` ranges. All windows of a range share the
    bytes next to the anchor, so contexts that have a window in common agree on those and are
    dealt by them; and they need no more of a context than the range can reach, so that most
    are equal then. ``piece`` is a 128-bit hash of what is left.
    """
    wide = -(-(span - ANCHOR + 1) // parts)
    right = F.length("context") - F.col("left")
    ranges = F.array(*(F.struct(F.lit(lo).alias("lo"), F.lit(min(lo + wide - 1, span - ANCHOR)).alias("hi")) for lo in range(0, span - ANCHOR + 1, wide)))
    cut = contexts.withColumn("r", F.explode(ranges)).filter((F.greatest(F.col("r.lo"), F.lit(span) - right) <= F.least(F.col("r.hi"), F.col("left"))))
    keep = F.least(F.col("left"), F.col("r.hi"))
    piece = F.substring("context", F.col("left") - keep + 1, keep + F.least(right, F.lit(span) - F.col("r.lo")))
    shared = F.substring("context", F.col("left") - F.col("r.lo") + 1, F.col("r.lo") + span - F.col("r.hi"))
    return cut.select(
        "cid",
        F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), "r.lo", keep, piece)), 16, "0") for seed in "ab"))).alias("piece"),
        F.xxhash64("r.lo", shared).alias("g"),
        keep.alias("left"),
        piece.alias("context"),
        "times",
    )


# --- the operator ----------------------------------------------------------------------


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merge overlapping and touching spans."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def _verdicts(contexts: DataFrame, tables: Scratch, span: int, crowd: int, parts: int) -> DataFrame:
    """(cid, most, fewest) of the contexts that hold repeats: windows start ``fewest`` to ``most`` bytes left of the anchor."""
    distinct = tables.write(contexts.groupBy("cid", "g", "left", "context").agg(F.sum("times").alias("times")), "distinct")
    kinds = tables.write(distinct.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")), "kinds")
    # written, so that both sides of the join are dealt anew and adaptive execution can split a crowded anchor
    several = distinct.join(kinds.filter("kinds > 1"), "g")
    right = F.length("context") - F.col("left")
    alone = distinct.join(kinds.filter("kinds = 1"), "g").filter((F.col("times") > 1) & (F.length("context") >= span))
    found = alone.select("cid", F.col("left").alias("most"), F.greatest(F.lit(0), F.lit(span) - right).alias("fewest"))
    sort, schema = _verdict_rows(span), "cid binary, most int, fewest int"
    calm = several.filter(F.col("kinds") <= crowd).select("cid", "g", "left", "context", "times")
    found = found.union(calm.repartition("g").sortWithinPartitions("g").mapInArrow(sort, schema))
    if kinds.filter(F.col("kinds") > crowd).limit(1).count():
        pieces = tables.write(_crowded_pieces(several.filter(F.col("kinds") > crowd), span, parts), "pieces")
        merged = pieces.groupBy("piece", "g", "left", "context").agg(F.sum("times").alias("times")).withColumnRenamed("piece", "cid")
        verdicts = merged.repartition("g").sortWithinPartitions("g").mapInArrow(sort, schema)
        whole = pieces.select("cid", "piece").join(verdicts.withColumnRenamed("cid", "piece"), "piece")
        found = found.union(whole.groupBy("cid").agg(F.max("most").alias("most"), F.min("fewest").alias("fewest")))
    return tables.write(found, "verdicts")


def repeated_spans(docs: DataFrame, tables: Scratch, *, span: int = 200, crowd: int = 500, parts: int = 10) -> DataFrame:
    """(uid, spans): where the rows of ``docs`` (uid, text) have bytes in repeated strings of ``span`` bytes."""
    long_enough = docs.filter(F.octet_length("text") >= span)
    found = tables.write(long_enough.mapInArrow(_anchor_rows(span), "uid long, at long, h long"), "anchors")
    # written, so that both sides of the join are dealt anew and adaptive execution can split a hot anchor
    twice = tables.write(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "twice")
    places = tables.write(found.join(twice, "h").groupBy("uid").agg(F.collect_set("at").alias("places")), "places")
    tables.drop("anchors", "twice")
    contexts = tables.write(long_enough.join(places, "uid").select("uid", "text", "places").mapInArrow(_context_rows(span), CONTEXTS_SQL), "contexts")
    tables.drop("places")
    verdicts = _verdicts(contexts.drop("found"), tables, span, crowd, parts)
    tables.drop(*(name for name in list(tables.paths) if name not in ("contexts", "verdicts")))
    hits = contexts.select("cid", "found").join(verdicts, "cid")
    each = F.transform(F.sequence(F.lit(0), F.size("found") - 1, F.lit(2)), lambda k: F.struct(F.get("found", k).alias("uid"), F.get("found", k + 1).alias("p")))
    placed = hits.select(F.explode(each).alias("x"), "most", "fewest")
    spans = placed.select("x.uid", (F.col("x.p") - F.col("most")).alias("start"), (F.col("x.p") - F.col("fewest") + span).alias("end"))
    return spans.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def with_uid(docs: DataFrame, key: str) -> DataFrame:
    """Add ``uid``: the key where keys are unique, else a hash of key and text (equal rows share it)."""
    return docs.withColumn("uid", F.xxhash64(F.col(key), F.col("text")) if has_clash(docs, key) else F.col(key).cast("long"))


def has_clash(docs: DataFrame, key: str) -> bool:
    """Is a key null or used twice?"""
    found = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())
    return found.limit(1).count() > 0


def cut_repeats(docs: DataFrame, *, key: str = "doc_id", span: int = 200, crowd: int = 500, parts: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, kept, kept_text, n_bytes, n_spans): every text without its repeated bytes.

    ``kept`` is binary; ``kept_text`` is the same without the halves of characters at cuts.
    All copies of a repeated string go, the first included. Null texts are empty; texts shorter
    than ``span`` stay as they are; equal rows are repeats of each other; no rows give no rows.
    A text is one row and so are its spans, about as many as its bytes if it repeats itself at
    every byte. ``carry``: columns of ``docs`` to keep, whatever their names, but for those of
    the result. Anchors with more than ``crowd`` contexts are decided in ``parts`` ranges.
    """
    if clash := {"kept", "kept_text", "n_bytes", "n_spans", key} & set(carry):
        raise ValueError(f"columns of the result cannot be carried: {sorted(clash)}")
    tables = Scratch(docs.sparkSession, "suffix")
    kept = {name: f"__carried_{k}" for k, name in enumerate(carry)}
    slim = with_uid(docs.select(F.col(key).alias("__key"), *(F.col(n).alias(c) for n, c in kept.items()), text_or_empty().alias("text")), "__key")
    spans = tables.write(repeated_spans(slim.select("uid", "text"), tables, span=span, crowd=crowd, parts=parts), "spans")
    tables.drop("contexts", "verdicts")
    names, held = [key, *carry], ["__key", *kept.values()]

    def run(batches):
        for batch in pieces_of(batches):
            rows = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw = text.encode()
                gaps = union_of([(s["start"], s["end"]) for s in found or ()])
                bounds = [0, *(x for gap in gaps for x in gap), len(raw)]
                parts = [raw[a:b] for a, b in list(pairwise(bounds))[::2]]
                rows.append((b"".join(parts), "".join(p.decode("utf-8", "ignore") for p in parts), len(raw), len(gaps)))
            cols = list(zip(*rows)) or [[]] * 4
            made = [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in held), *made], names=[*names, "kept", "kept_text", "n_bytes", "n_spans"])

    schema = T.StructType([*(docs.schema[n] for n in names), *(T.StructField(n, t) for n, t in (("kept", T.BinaryType()), ("kept_text", T.StringType()), ("n_bytes", T.LongType()), ("n_spans", T.LongType())))])
    return slim.join(spans, "uid", "left").select(*held, "text", "spans").mapInArrow(run, schema)


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 200 bytes that occur elsewhere."""
    bounded_batches(spark)
    found = cut_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_suffix": op2_suffix}
ORACLE_SQL: dict[str, str] = {}
