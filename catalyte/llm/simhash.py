"""SimHash near-dedup with covering locality-sensitive hashing.

A text's fingerprint has a bit set if most of its shingles' hashes have it. Fingerprints
link at up to ``radius`` differing bits. Covering LSH (Pagh, 2016) finds all such pairs: give
each bit a nonzero vector of radius + 1 bits; for each of the 2^(radius+1) - 1 nonzero vectors
v, a table keys the fingerprint by those bits whose vector has an odd product with v. The
vectors of at most ``radius`` differing bits never span the whole space, so some v is
orthogonal to all of them, and in its table the two keys are equal.

Equal fingerprints are one row from the start. Buckets are cut into blocks of bounded size
and every pair of blocks is compared as one matrix in a task that emits only a spanning
forest of its links, so a large group makes neither a large task nor all its pairs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, bounded_batches, table, text_or_empty
from .components import components
from .tokens import pieces_of

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPLIT = re.compile(rb"[\x20\x09-\x0d]+")


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """64 bits as an unsigned integer; 0 for a text without words."""
    words = [w for w in SPLIT.split(text.encode().translate(LOWER)) if w]
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", width: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp): the fingerprint of every whole text, as a signed long; null texts are empty."""

    def run(batches):
        for batch in pieces_of(batches):
            found = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text_or_empty().alias("text")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """Signed masks such that any two words within ``radius`` agree under one of them."""
    space = 1 << (radius + 1)
    vector = [1 + i % (space - 1) for i in range(bits)]
    masks = [sum(1 << i for i in range(bits) if (v & vector[i]).bit_count() % 2) for v in range(1, space)]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in masks]


def forest(fps: np.ndarray, ids: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among some fingerprints, as pairs of ids."""
    if len(fps) == 2:
        return [(int(ids[0]), int(ids[1]))] if (int(fps[0]) ^ int(fps[1])).bit_count() <= radius else []
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    open_, out = np.ones(len(fps), bool), []
    for root in range(len(fps)):
        if not open_[root]:
            continue
        open_[root] = False
        edge = [root]
        while len(edge):
            edge = np.flatnonzero(near[edge].any(0) & open_)
            open_[edge] = False
            out += [(int(ids[root]), int(ids[k])) for k in edge]
    return out


def finer_masks(masks: list[int], radius: int, bits: int = 64) -> list[int]:
    """For each mask radius + 1 larger ones: the bits it leaves out are dealt to as many groups, and two
    words that agree under the mask and differ in ``radius`` bits at most agree on one group as well."""
    out = []
    for m in masks:
        free = [i for i in range(bits) if not m >> i & 1]
        for g in range(radius + 1):
            finer = (m % (1 << bits)) | sum(1 << i for i in free[g :: radius + 1])
            out.append(finer - (1 << bits) if finer >> (bits - 1) else finer)
    return out


def near_links(distinct: DataFrame, radius: int, tables: Scratch, block: int = 1024) -> DataFrame:
    """Links (u, v) that connect exactly what pairs within ``radius`` connect; ``distinct``: fp, rep.

    A bucket of more than ``block`` words is cut into smaller ones by finer masks, which lose no
    pair either, before what is still large is compared block by block.
    """
    masks = covering_masks(radius)
    rows = distinct.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("x")).select("x.t", "x.key", "fp", "rep")

    def shared_buckets(rows: DataFrame, name: str) -> DataFrame:
        # written, so that both sides of the join are dealt anew and adaptive execution can split a hot bucket
        shared = tables.write(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), name)
        return rows.join(shared, ["t", "key"])

    placed = shared_buckets(rows, "buckets")
    if tables.read("buckets").filter(F.col("n") > block).limit(1).count():
        finer = F.array(*[F.struct(F.lit(len(masks) + k).alias("t"), F.lit(m).alias("mask")) for k, m in enumerate(finer_masks(masks, radius))])
        some = F.slice(finer, F.col("t") * (radius + 1) + 1, radius + 1)
        cut = placed.filter(F.col("n") > block).select("fp", "rep", F.explode(some).alias("x")).select("x.t", F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"), "fp", "rep")
        placed = placed.filter(F.col("n") <= block).unionByName(shared_buckets(cut, "finer"))
    placed = placed.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    blocks = placed.groupBy("t", "key", "blocks", "block").agg(F.collect_list(F.struct("fp", "rep")).alias("some"))  # about ``block`` rows at most
    a = blocks.filter("blocks > 1").select("t", "key", F.col("block").alias("i"), F.col("some").alias("a"))
    b = blocks.filter("blocks > 1").select("t", "key", F.col("block").alias("j"), F.col("some").alias("b"))
    pairs = blocks.filter("blocks = 1").select("some").union(a.join(b, ["t", "key"]).filter("i < j").select(F.concat("a", "b").alias("some")))

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            ends, inner = lists.offsets.to_numpy(), lists.values
            fps, ids = inner.field(0).to_numpy(zero_copy_only=False).view(np.uint64), inner.field(1).to_numpy(zero_copy_only=False)
            found = [x for s, e in zip(ends[:-1], ends[1:]) for x in forest(fps[s:e], ids[s:e], radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long").distinct()


def near_classes(docs: DataFrame, *, key: str = "doc_id", width: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp, component_id) of every document: what is reachable over links, named by its smallest key.

    Null texts are empty and like all texts without words link with each other; texts of any
    length are read whole. Rows with equal keys are documents of their own; a null key names
    no component unless nothing else is in it (then its component is null). Other columns are
    ignored, whatever their names. No rows give no rows.
    """
    tables = Scratch(docs.sparkSession, "simhash")
    slim = tables.write(fingerprints(docs.select(F.col(key).alias("__key"), "text"), key="__key", width=width, seed=seed), "fingerprints")
    distinct = tables.write(slim.groupBy("fp").agg(F.min(F.col("__key").cast("long")).alias("rep")), "distinct")
    # of what no key names there are at most one row a fingerprint; it stands for itself by its fingerprint
    linked = components(near_links(distinct.select("fp", F.col("fp").alias("rep")), radius, tables))
    tables.drop(*{"buckets", "finer"} & set(tables.paths))
    group = distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("group"))
    names = group.groupBy("group").agg(F.min("rep").alias("component_id"))
    named = tables.write(group.join(names, "group").select(F.col("fp").alias("__fp"), "component_id"), "named")
    # a fingerprint that very many documents share is a hot key of this join only; adaptive execution splits it
    return slim.join(named, F.col("fp") == F.col("__fp"), "left").select(F.col("__key").alias(key), "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' 3-word fingerprints and the components of their links within 3 bits."""
    bounded_batches(spark)
    found = near_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLE_SQL: dict[str, str] = {}
