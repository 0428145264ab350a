"""Token ids in ORC files.

One row a document: its id and its token ids. The files lie in ascending document order
(range partitioning, sorted inside), so row-group and stripe statistics on ``doc_id`` are
narrow and a Bloom filter on it answers point look-ups; ORC's integer run-length encoding
packs the ids, and stripes are the unit in which readers split a file.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyarrow import fs, orc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialize, scratch, table, text_or_empty
from .tokens import encoder, id_lists, pieces_of


def tokenize(docs: DataFrame, vocabulary: str, end_id: int | None, *, key: str = "doc_id") -> DataFrame:
    """(key, tokens) of every whole text; null texts are empty, so they hold the end id alone."""

    def run(batches):
        encode = encoder(vocabulary)
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        for batch in pieces_of(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), id_lists([encode(t) + end for t in texts])], names=[key, "tokens"])

    return docs.select(key, text_or_empty().alias("text")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, tokens array<int>")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None, *, key: str = "doc_id", stripe_bytes: int = 64 << 20, compression: str = "lz4") -> None:
    """Encode ``docs`` and write them in ascending order of ``key``.

    The shuffle carries the texts (smaller than their ids) and Spark's own commit protocol
    makes rewritten tasks harmless. Null keys come first; equal keys are all kept; null and empty
    texts are the end id alone; texts of any length are encoded whole; other columns are ignored,
    whatever their names; no rows make an empty table.
    """
    ordered = docs.select(key, text_or_empty().alias("text")).repartitionByRange(F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first())
    (
        tokenize(ordered, vocabulary, end_id, key=key)
        .write.option("orc.bloom.filter.columns", key)
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "10000")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", compression)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, *, key: str = "doc_id", lo: int | None = None, hi: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """Read (key, tokens); a range or a list of ids is pushed to the stripe and row-group
    statistics and, for ids, to the Bloom filters."""
    df = spark.read.orc(path)
    if lo is not None:
        df = df.filter(F.col(key) >= lo)
    if hi is not None:
        df = df.filter(F.col(key) <= hi)
    return df if ids is None else df.filter(F.col(key).isin(ids))


def token_index(spark: SparkSession, path: str, *, key: str = "doc_id") -> DataFrame:
    """What the files hold: per document its place in the whole id stream, count and crc32.

    Stripes are read in parallel, each by a task of its own. Files, their stripes and the rows
    in them are in key order, so a document's start is the ids of all earlier stripes plus a
    running sum inside its stripe: no sort, and only one sum a file comes to the driver. No files
    or no rows give no rows; null and equal keys keep their rows.
    """
    files = sorted(spark.read.orc(path).inputFiles(), key=lambda f: f.rsplit("/", 1)[-1])
    kind = spark.read.orc(path).schema[key].dataType.simpleString()

    def stripes(batches):
        for batch in batches:
            rows = []
            for number, name in zip(*(c.to_pylist() for c in batch.columns)):
                store, at = fs.FileSystem.from_uri(name)
                with store.open_input_file(at) as file:
                    rows += [(number, name, k) for k in range(orc.ORCFile(file).nstripes)]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32()))], names=["number", "file", "stripe"])

    def digest(batches):
        for batch in batches:
            for number, name, k in zip(*(c.to_pylist() for c in batch.columns)):
                store, at = fs.FileSystem.from_uri(name)
                with store.open_input_file(at) as file:
                    part = orc.ORCFile(file).read_stripe(k, columns=[key, "tokens"])
                lists = part.column(part.schema.get_field_index("tokens"))
                ends = lists.offsets.to_pylist()
                raw = memoryview(lists.values.cast(pa.int32()).to_numpy(zero_copy_only=False)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
                count, n = [b - a for a, b in zip(ends, ends[1:])], len(ends) - 1
                cols = [part.column(part.schema.get_field_index(key)), pa.array([number] * n, pa.int64()), pa.array([k] * n, pa.int32()), pa.array([a - ends[0] for a in ends[:-1]], pa.int64()), pa.array(count, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "number", "stripe", "own", "n_tokens", "ids_crc32"])

    # the numbers of tasks are given, or adaptive execution would read the few small rows, and so all stripes, in one
    listed = spark.createDataFrame(list(enumerate(files)), "number long, file string").repartition(max(1, min(len(files), 1000)))
    found = listed.mapInArrow(stripes, "number long, file string, stripe int").repartition(max(1, min(2 * len(files), 10_000)), "number", "stripe").mapInArrow(digest, f"{key} {kind}, number long, stripe int, own long, n_tokens long, ids_crc32 long")
    found = materialize(found, "token-index")
    sums = found.groupBy("number", "stripe").agg(F.sum("n_tokens").alias("n"))
    per_file, first, at = sums.groupBy("number").agg(F.sum("n").alias("n")).collect(), [], 0  # one row a file
    for r in sorted(per_file):
        first.append((r["number"], at))
        at += r["n"]
    files_at = spark.createDataFrame(first, "number long, file_at long")
    inside = F.sum("n").over(Window.partitionBy("number").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.withColumn("inside", F.coalesce(inside, F.lit(0))).join(files_at, "number").select("number", "stripe", (F.col("file_at") + F.col("inside")).alias("before"))
    return found.join(starts, ["number", "stripe"]).select(key, (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' byte-level ids with end id 0, written to ORC and read back."""
    bounded_batches(spark)
    import public_tokenizers

    path = scratch(spark, "tokens-orc")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 0)
    return token_index(spark, path)


QUERIES = {"op3_token_orc": op3_token_orc}
ORACLE_SQL: dict[str, str] = {}
