"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a document if at least ``threshold`` of its distinct word shingles
occur there. Documents are so much longer than items that sketches of one length for both
would find nothing: what a sketch must hold depends on the item's size. So items are
partitioned by size, and each partition has a sketch length and a hash limit of its own:

- an item of n shingles may lack ``slack`` = n - ceil(threshold * n) of them; its bottom-k MinHash
  sketch holds its 2 * slack + 2 smallest hashes (all, if it has fewer);
- the partition's limit is the largest hash in its items' sketches, and a document's sketch
  for the partition is its hashes up to that limit;
- the share of the item's sketch found in the document's estimates the containment. A
  document that contains the item lacks ``slack`` hashes at most, so it has all but ``slack``
  of the sketch: whatever has fewer is no candidate, and no document that contains the item
  is lost. Candidates are decided by an exact count of shingle strings.

Documents are read once, where they lie. The items travel to every task in passes of at most
2 * ``part`` shingles: items are cut into passes by running sums of their shingles, and an
item of more than ``part`` shingles into slices that are counted apart and added up. A larger
benchmark takes more passes over the documents, not more memory.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, bounded_batches, kept, table, text_or_empty
from .tokens import pieces_of

#: Everything in ASCII that is neither letter nor digit separates words.
APART = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: str) -> list[bytes]:
    """Lower-case words; punctuation and white space separate them."""
    return text.lower().encode().translate(APART).split()


#: Words a Python worker remembers.
MEMO = 100_000


class _Hash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < MEMO:
            self[word] = h
        return h


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash at each position where ``width`` words follow."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(kept("hashes", _Hash).__getitem__, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ (h[k : k + n] * ODD[k % len(ODD)] + np.uint64(k))) * ODD[(k + 1) % len(ODD)]
        out ^= out >> np.uint64(29)
    return out


def size_class(n: int) -> int:
    """The size partition of an item of n shingles: powers of two."""
    return n.bit_length()


def slack(n: int, threshold: float) -> int:
    """How many of its n shingles a contained item may lack."""
    return n - math.ceil(threshold * n - 1e-9)


def sketches(items: DataFrame, *, width: int, threshold: float, key: str, part: int) -> DataFrame:
    """Rows of items with words: (item, number, size partition, width, n, least, slices, slice, sketch, shingles).

    ``least``: how many of the sketch a candidate has. An item has one slice, or, above ``part``
    shingles, several without sketches, for which every document with a shingle counts.
    """

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        for batch in pieces_of(batches):
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                own = min(width, len(words))  # a shorter item is one shingle of all its words
                strings = sorted({b" ".join(words[k : k + own]) for k in range(len(words) - own + 1)})
                n, made, slices = len(strings), made + 1, -(-len(strings) // part)
                for k in range(slices):
                    some = strings[k * part : (k + 1) * part]
                    hashes = np.unique(np.concatenate([shingle_hashes(s.split(b" "), own) for s in some]))
                    sketch = hashes if slices > 1 else hashes[: 2 * slack(n, threshold) + 2]
                    least = 1 if slices > 1 else max(1, len(sketch) - slack(n, threshold))
                    rows.append((item, (task << 32) + made, size_class(n), own, n, least, slices, k, sketch.view(np.int64), some))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 10, [batch.schema.field(0).type, *(pa.field(*f).type for f in SKETCH)])], names=["item", *(f[0] for f in SKETCH)])

    kind = items.schema[key].dataType.simpleString()
    return items.select(key, text_or_empty().alias("text")).mapInArrow(run, f"item {kind}, number long, size int, width int, n int, least int, slices int, slice int, sketch array<long>, shingles array<binary>")


SKETCH = [("number", pa.int64()), ("size", pa.int32()), ("width", pa.int32()), ("n", pa.int32()), ("least", pa.int32()), ("slices", pa.int32()), ("slice", pa.int32()), ("sketch", pa.list_(pa.int64())), ("shingles", pa.list_(pa.binary()))]


def in_passes(index: DataFrame, part: int) -> DataFrame:
    """Add ``lane`` and ``turn``; the rows of one (lane, turn) hold less than 2 * ``part`` shingles."""
    weight = F.size("shingles").cast("long")
    lanes = -(-(index.agg(F.sum(weight)).first()[0] or 0) // (16 * part)) or 1
    slim = index.select("number", "slice", weight.alias("w"), F.pmod(F.xxhash64("number", "slice"), F.lit(lanes)).alias("lane"))
    before = F.sum("w").over(Window.partitionBy("lane").orderBy("number", "slice").rowsBetween(Window.unboundedPreceding, -1))
    placed = slim.select("number", "slice", "lane", F.floor(F.coalesce(before, F.lit(0)) / part).alias("turn"))
    return index.join(placed, ["number", "slice"])


def contained(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", item_key: str = "item_id", width: int = 5, threshold: float = 0.8, part: int = 1 << 20) -> DataFrame:
    """(key, item, n_shingles, n_found, containment) for every document that contains an item.

    Null and empty texts hold no words and match nothing. Equal items are items of their own;
    rows with equal keys are documents of their own; null keys stay null. Texts of any length
    are read whole. Other columns are ignored, whatever their names. No documents or no items
    give no rows.
    """
    spark = docs.sparkSession
    tables = Scratch(spark, "decontaminate")
    index = tables.write(in_passes(tables.write(sketches(items, width=width, threshold=threshold, key=item_key, part=part), "sketches"), part), "index")
    doc_kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    kinds = {"__key": doc_kind, "text_hash": "long", "item": item_kind, "number": "long", "slices": "int", "slice": "int", "n_shingles": "int", "n_found": "int"}
    schema = ", ".join(f"{n} {kind}" for n, kind in kinds.items())
    slim = docs.select(F.col(key).alias("__key"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    # rows from the driver's Python, even none, would start a second set of Python workers on the executors
    found = spark.range(0).select(*(F.lit(None).cast(kind).alias(n) for n, kind in kinds.items()))
    tables.drop("sketches")
    passes = index.select("lane", "turn").distinct().collect()  # one row a pass
    sliced = index.filter("slices > 1").limit(1).count() > 0
    for k, (lane, turn) in enumerate(sorted(tuple(p) for p in passes)):
        some = index.filter((F.col("lane") == lane) & (F.col("turn") == turn)).drop("lane", "turn").toArrow()  # less than 2 * ``part`` shingles
        shared = spark.sparkContext.broadcast(some)
        del some
        found = found.union(tables.write(slim.mapInArrow(_probe(shared, schema), schema), f"found-{k}"))
        shared.destroy()  # its pass is written: one pass's shingles are held at a time, here and by the executors
    tables.drop("index")
    if sliced:
        found = found.filter("slices = 1").select("__key", "item", "n_shingles", "n_found").union(_added_up(found.filter("slices > 1")))
    out = found.select(F.col("__key").alias(key), "item", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))
    return out.filter(F.col("containment") >= threshold - 1e-9)


def _added_up(slices: DataFrame) -> DataFrame:
    """Sum what the slices of an item found in a document; equal documents were counted in each of them."""
    each = slices.groupBy("__key", "text_hash", "item", "number", "n_shingles", "slice").agg(F.max("n_found").alias("n_found"), F.count(F.lit(1)).alias("copies"))
    whole = each.groupBy("__key", "text_hash", "item", "number", "n_shingles").agg(F.sum("n_found").cast("int").alias("n_found"), F.max("copies").alias("copies"))
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__key", "item", "n_shingles", "n_found")


class _Partition:
    """The items of one size partition and shingle width: their sketches, by hash, and the limit of those."""

    def __init__(self, rows: list[int], sketch: list[np.ndarray]):
        hashes = np.concatenate([sketch[k] for k in rows])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], np.repeat(rows, [len(sketch[k]) for k in rows])[order]
        self.limit = self.hashes[-1]

    def hits(self, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and how many of their sketch are in a document's sketch of distinct hashes."""
        lo, hi = np.searchsorted(self.hashes, sketch), np.searchsorted(self.hashes, sketch, "right")
        return np.unique(np.concatenate([self.owner[:0], *(self.owner[a:b] for a, b in zip(lo, hi) if b > a)]), return_counts=True)


#: A filter before the look-up: one bit a hash of the sketches, by its upper bits.
FILTER_BITS = 22


def _probe(shared, schema: str):
    """Sketch every document for each partition, then count the candidates' shingles exactly."""

    def run(batches):
        items = shared.value
        width, n, least, slices, number = (items.column(c).to_pylist() for c in ("width", "n", "least", "slices", "slice"))
        sketch = [np.array(x, np.int64).view(np.uint64) for x in items.column("sketch").to_pylist()]
        strings = items.column("shingles").combine_chunks()
        strings = strings.chunk(0) if isinstance(strings, pa.ChunkedArray) else strings
        own, numbers = items.column("item").combine_chunks(), items.column("number").combine_chunks()
        kinds: dict[int, dict[int, list[int]]] = {}
        for k, size in enumerate(items.column("size").to_pylist()):
            kinds.setdefault(width[k], {}).setdefault(size, []).append(k)
        partitions = {w: [_Partition(rows, sketch) for _, rows in sorted(sizes.items())] for w, sizes in kinds.items()}
        near, down = {}, np.uint64(64 - FILTER_BITS)
        for w, some in partitions.items():
            near[w] = np.zeros(1 << FILTER_BITS, bool)
            for p in some:
                near[w][p.hashes >> down] = True

        for batch in pieces_of(batches):
            out = []
            for row, text in enumerate(batch.column(2).to_pylist()):
                words = words_of(text)
                for w, some in partitions.items():
                    got = shingle_hashes(words, w)
                    got = np.unique(got[near[w][got >> down]])
                    present = None
                    for p in some if len(got) else ():
                        for k, hits in zip(*p.hits(got[: np.searchsorted(got, p.limit, "right")])):
                            if hits < least[k]:
                                continue
                            if present is None:
                                present = {b" ".join(words[j : j + w]) for j in range(len(words) - w + 1)}
                            out.append((row, int(k), sum(s in present for s in strings[int(k)].as_py())))
            rows, which = pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), _taken(own, which), _taken(numbers, which), pa.array([slices[x[1]] for x in out], pa.int32()), pa.array([number[x[1]] for x in out], pa.int32()), pa.array([n[x[1]] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())],
                names=[f.split()[0] for f in schema.split(", ")],
            )

    return run


def _taken(column, rows: pa.Array) -> pa.Array:
    found = column.take(rows)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) of which the document holds four fifths of the 5-word shingles."""
    bounded_batches(spark)
    found = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("item").alias("item_id"), "n_shingles", "n_found", "containment")


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLE_SQL = {
    "op8_decontaminate": """
        WITH d AS (
            SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
        ), b AS (
            SELECT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark
        ), i AS (
            SELECT item_id, w, least(5, len(w)) AS width FROM b WHERE len(w) > 0
        ), ig AS (
            SELECT DISTINCT item_id, width, array_to_string(w[k:k + width - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS k FROM i)
        ), dg AS (
            SELECT DISTINCT doc_id, width, array_to_string(w[k:k + width - 1], ' ') AS g
            FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM d, (SELECT DISTINCT width FROM i) WHERE len(w) >= width)
        ), n AS (
            SELECT item_id, count(*) AS n FROM ig GROUP BY 1
        )
        SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_found, count(*) / n AS containment
        FROM ig JOIN dg USING (width, g) JOIN n USING (item_id)
        GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n - 1e-9
    """
}
