"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows differ by orders of magnitude in size, so Arrow batches are bounded by bytes, well below Spark's default.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bound the session's Arrow batches; queries and pipeline stages call it for the functions that they hand to the caller unrun."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


#: What this process remembers, and for whom.
_KEPT: dict = {}


def kept(name, make):
    """What a Python worker remembers under ``name`` from task to task, at first ``make()``.

    It remembers one such thing at a time. A worker serves all stages of a session: else each
    operator's memo would stay until the session ends, and their sum would count.
    """
    if name not in _KEPT:
        _KEPT.clear()
        gc.collect()  # an encoder refers to itself
        _KEPT[name] = make()
    return _KEPT[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    """The whole text; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: ``spark.checkpoint.dir``.

    A session with a local master (tests, one machine) gets a temporary folder where the
    setting is missing; on a cluster that is an error, as executors would not share it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="catalyte-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Jobs in here delete their shuffle files as soon as they end: their result is written, so nothing reads those again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    return written(df, scratch(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet under ``path`` and read it back."""
    schema = df.schema
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later step reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Named scratch tables of one operator, each deleted when its last reader is done."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = scratch(self.spark, f"{self.name}-{name}")
        return written(df, self.paths[name])

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            discard(self.spark, self.paths.pop(name))
