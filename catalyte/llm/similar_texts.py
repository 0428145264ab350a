"""Near-dedup by word-shingle similarity beside SimHash: MinHash tables propose, exact sets decide.

At three of 64 bits SimHash finds copies with few edits only. Here 32 tables are keyed by 5
MinHash values of a text's 5-word shingles each. Two texts meet in a table with probability
J^5 for the Jaccard similarity J of their shingle sets, wherever they differ: scattered edits,
added and removed passages are alike. At J = 0.8 a pair meets in no table with probability
(1 - 0.8^5)^32 = 3e-6, and above 0.8 with less.

Pairs that meet are only left out if they provably are not similar enough: by the sizes of
their sets, or by the parity bitmaps of their sets, which differ in no more bits than the sets
in elements. All others count if the exact Jaccard similarity reaches the threshold. Large
families cost few tests: first each block of a bucket proposes a shortest spanning forest;
then every pair of a bucket that the forests' verified ties leave in different components is
proposed and tested as well. Buckets whose rows are one component by then are not read again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, text_or_empty
from .components import components
from .decontaminate import shingle_hashes
from .simhash import LOWER
from .tokens import pieces_of

TABLES, ROWS = 32, 5
#: Bits of a parity bitmap.
BITS = 512
#: Odd factors: each orders the shingle hashes anew.
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, TABLES * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Stands for a distance that is too large.
FAR = 255


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(LOWER).split()


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles (a shorter text is one shingle)."""
    words = words_of(text)
    return np.unique(shingle_hashes(words, min(width, len(words)) or 1))


def minhash_cells(shingles: np.ndarray) -> np.ndarray:
    """The cell of a nonempty shingle set in each table, as signed longs."""
    least = np.full(TABLES * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024, None] * FACTORS).min(0), out=least)
    out = np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in least.reshape(TABLES, ROWS).T:
        out = (out ^ column) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def parity_bitmap(shingles: np.ndarray) -> bytes:
    """Bit k is set if an odd number of shingles falls on k."""
    place = (shingles * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS.bit_length() + 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=BITS) & 1).astype(bool), bitorder="little").tobytes()


def sketches(docs: DataFrame, key: str, width: int) -> DataFrame:
    """(key, n, s, bits, cells): size, hash and parity bitmap of the shingle set, and its cells (none if it is empty)."""
    schema = pa.schema([(key, pa.int64()), ("n", pa.int32()), ("s", pa.int64()), ("bits", pa.binary()), ("cells", pa.list_(pa.int64()))])

    def run(batches):
        for batch in pieces_of(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, width)
                s = int(np.bitwise_xor.reduce(found * np.uint64(0xA0761D6478BD642F), initial=np.uint64(0)).view(np.int64))
                rows.append((len(found), s, parity_bitmap(found), minhash_cells(found) if len(found) else []))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:]))], schema=schema)

    return docs.select(key, text_or_empty().alias("text")).mapInArrow(run, f"{key} long, n int, s long, bits binary, cells array<long>")


def distances(n: np.ndarray, bits: np.ndarray, threshold: float) -> np.ndarray:
    """Least share of elements, in 253rds, in which sets of sizes ``n`` differ by their bitmaps; ``FAR`` if that or their sizes rule ``threshold`` out.

    With similarity J sets of x and y elements differ in (x + y) (1 - J) / (1 + J), and the smaller has J times the larger's at least.
    """
    apart = np.zeros((len(n), len(n)), np.int64)
    for word in bits.T:
        apart += np.bitwise_count(word[:, None] ^ word)
    both = n[:, None] + n
    may = (apart <= both * ((1 - threshold) / (1 + threshold)) + 1e-6) & (np.minimum(n[:, None], n) >= threshold * np.maximum(n[:, None], n) - 1e-6)
    return np.where(may, apart * 253 // np.maximum(both, 1), FAR).astype(np.uint8)


def nearest_forest(far: np.ndarray) -> list[tuple[int, int]]:
    """Ties (places in ``far``) of a shortest spanning forest, by Prim's rule."""
    open_, out = np.ones(len(far), bool), []
    best, via = np.full(len(far), FAR, np.uint8), np.zeros(len(far), np.int64)
    for _ in range(len(far)):
        k = int(best.argmin())
        if best[k] == FAR:
            k = int(open_.argmax())
        else:
            out.append((k, int(via[k])))
        open_[k], best[k] = False, FAR
        closer = (far[k] < best) & open_
        best[closer], via[closer] = far[k][closer], k
    return out


def cells_of(distinct: DataFrame, tables: Scratch) -> DataFrame:
    """(cell, m, rep, n, bits): rows of ``distinct`` in every table where others meet them, ``m`` in all."""
    rows = distinct.select("rep", F.explode("cells").alias("cell"))
    # written, so that both sides of the join are dealt anew and adaptive execution can split a hot bucket
    shared = tables.write(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared")
    return rows.join(shared, "cell").join(distinct.select("rep", "n", "bits"), "rep")


def in_blocks(placed: DataFrame, *more: str) -> DataFrame:
    """``placed`` (cell, blocks, ``more``, n, bits, rep, c) as lists of about one block of rows; a cell deals its rows by a hash of its own."""
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("rep", "cell"), F.col("blocks")).cast("int"))
    return dealt.groupBy("cell", *more, "block").agg(F.collect_list(F.struct("n", "bits", "rep", "c")).alias("some"))


def first_ties(cells: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """(u, v): the ties of a forest in each block of each bucket.

    Blocks of one bucket do not meet here: a large family shares several buckets, whose blocks
    differ, and is tied together by them.
    """
    lists = in_blocks(cells.withColumn("blocks", F.ceil(F.col("m") / block).cast("int")).withColumn("c", F.col("rep")))
    return _pairs_in(lists.select("some", F.lit(0).alias("split")), threshold, tying=True)


def other_pairs(cells: DataFrame, named: DataFrame, threshold: float, tables: Scratch, block: int = 1024) -> DataFrame:
    """(u, v): all pairs of a bucket that verified ties, as components in ``named`` (node, component), leave apart.

    With them no pair is left untested that could still connect anything. Buckets of a single
    component are done. In the others rows of the most frequent component do not meet each
    other, so a family that is tied together meets the few rows beside it, not itself.
    """
    component = F.coalesce("component", "rep")
    names = named.select(F.col("node").alias("rep"), "component")
    counts = cells.select("cell", "rep").join(names, "rep", "left").groupBy("cell", component.alias("c")).agg(F.count(F.lit(1)).alias("k"))
    tops = counts.groupBy("cell").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("all")).filter(F.col("all") > F.col("top.k"))
    mixed = tables.write(tops.select("cell", F.col("top.k").alias("k"), F.col("top.c").alias("top")), "mixed")
    rows = cells.join(mixed, "cell").join(names, "rep", "left").withColumn("c", component)
    rows = rows.withColumn("family", (F.col("m") > block) & (F.col("c") == F.col("top")))
    met = F.when(F.col("m") <= block, F.lit(1)).when(F.col("family"), F.ceil(F.col("k") / block)).otherwise(F.ceil((F.col("m") - F.col("k")) / block))
    # written: read three times, and freshly dealt by the join, which adaptive execution can split
    lists = tables.write(in_blocks(rows.withColumn("blocks", met.cast("int")), "family"), "lists")
    rest = lists.filter("not family").select("cell", F.col("block").alias("i"), F.col("some").alias("x"))
    second = lists.select("cell", "family", "block", F.col("some").alias("y"))
    both = rest.join(second, "cell").filter("family or i < block").select(F.concat("x", "y").alias("some"), F.size("x").alias("split"))
    return _pairs_in(rest.select(F.col("x").alias("some"), F.lit(0).alias("split")).union(both), threshold, tying=False)


def _pairs_in(lists: DataFrame, threshold: float, *, tying: bool) -> DataFrame:
    """(u, v) in each list of ``lists`` (some, split): a forest's ties, or all pairs of different components, from ``split`` on only across it."""

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            ends, splits = lists.offsets.to_pylist(), batch.column(1).to_pylist()
            n, ids, own = (lists.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2, 3))
            bits = np.frombuffer(b"".join(lists.values.field(1).to_pylist()), np.uint64).reshape(-1, BITS // 64)
            for s, e, split in zip(ends, ends[1:], splits):
                if not tying and (own[s:e] == own[s]).all():
                    continue
                far = distances(n[s:e], bits[s:e], threshold)
                if tying:
                    at = np.array(nearest_forest(far), np.int64).reshape(-1, 2).T
                else:
                    apart = (far < FAR) & (own[s:e][:, None] != own[s:e])
                    if split:
                        apart[split:] = apart[:, :split] = False
                    at = np.nonzero(np.triu(apart, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:e][k]) for k in at], names=["u", "v"])

    return lists.mapInArrow(run, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def links(docs: DataFrame, *, key: str = "uid", width: int = 5, threshold: float = 0.8, block: int = 1024) -> DataFrame:
    """(u, v): links of documents (key: a unique long, never null) whose shingle sets are equal or at least ``threshold`` similar.

    Texts with equal sets are linked to the one with the smallest key, and only that one is
    compared further. Null texts are empty, and empty texts equal each other; a text shorter
    than ``width`` words is one shingle; texts of any length are read whole; other columns are
    ignored, whatever their names; no rows give no rows.
    """
    tables = Scratch(docs.sparkSession, "similar")
    named = tables.write(sketches(docs, key, width), "sketches")
    distinct = tables.write(named.groupBy("n", "s", "bits").agg(F.min(key).alias("rep"), F.any_value("cells").alias("cells")), "distinct")
    same = named.join(distinct.drop("cells"), ["n", "s", "bits"]).filter(F.col(key) != F.col("rep")).select(F.col(key).alias("u"), F.col("rep").alias("v"))
    same = tables.write(same, "same")
    tables.drop("sketches")
    cells = tables.write(cells_of(distinct, tables), "cells")
    tables.drop("shared", "distinct")
    first = tables.write(first_ties(cells, threshold, block), "first")
    near = verified(docs, first, key, width, threshold, tables, "near")
    # what the forest's ties left apart is tested pair by pair
    rest = tables.write(other_pairs(cells, components(near), threshold, tables, block).join(first, ["u", "v"], "left_anti"), "rest")
    tables.drop("cells", "first", "mixed", "lists")
    more = verified(docs, rest, key, width, threshold, tables, "more")
    tables.drop("rest")
    out = tables.write(near.union(more).union(same), "links")
    tables.drop("near", "more", "same")
    return out


def verified(docs: DataFrame, ties: DataFrame, key: str, width: int, threshold: float, tables: Scratch, name: str) -> DataFrame:
    """The ``ties`` (u, v) whose exact shingle sets are at least ``threshold`` similar."""

    def sets(batches):
        for batch in pieces_of(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["node", "shingles"])

    nodes = ties.select(F.col("u").alias("node")).union(ties.select("v")).distinct()
    held = docs.select(F.col(key).alias("node"), text_or_empty().alias("text")).join(nodes, "node", "left_semi").mapInArrow(sets, "node long, shingles binary")
    held = tables.write(held, f"{name}-sets")

    def alike(batches):
        for batch in pieces_of(batches):
            ok = []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    sized = ties.join(held.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u").join(held.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v")
    out = tables.write(sized.select("u", "v", "x", "y").mapInArrow(alike, "u long, v long"), name)
    tables.drop(f"{name}-sets")
    return out
