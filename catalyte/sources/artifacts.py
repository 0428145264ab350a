"""JSON run artifacts, ledgers, logs, content-addressed caches and binary images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_runs(spark: SparkSession, glob: str, schema) -> DataFrame:
    """One JSON document a run folder; malformed ones are skipped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(glob).withColumn("path", F.col("_metadata.file_path"))


def read_ledger(spark: SparkSession, path: str, track: str) -> DataFrame:
    """JSON lines of one track that name a run; bad lines are skipped."""
    df = spark.read.schema("run_id string, track string, event string, at timestamp").option("mode", "DROPMALFORMED").json(path)
    return df.filter((F.col("track") == track) & F.col("run_id").isNotNull())


def append(df: DataFrame, path: str) -> None:
    """Append-only logs."""
    df.write.mode("append").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def last_searches(log: DataFrame, n: int = 1000) -> DataFrame:
    return log.orderBy(F.col("ts").desc()).limit(n)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with the hash of their content, the key of every cache."""
    return spark.read.format("binaryFile").load(path).withColumn("content_md5", F.md5("content"))


def uncached(images: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """The work list: contents without a cached analysis of this version."""
    return images.join(cache.filter(F.col("version") == version).select("content_md5"), "content_md5", "left_anti")


def snapshot(df: DataFrame, path: str, key: list[str]) -> DataFrame:
    """A backup and its check: as many rows as ``df``, no key twice. A failed check is an error; the folder stays for inspection."""
    df.write.mode("errorifexists").parquet(path)
    kept = df.sparkSession.read.parquet(path)
    rows, twice = kept.count(), kept.groupBy(*key).count().filter("count > 1").limit(1).count()
    if rows != df.count() or twice:
        raise ValueError(f"the backup under {path} " + ("holds a key twice" if twice else "lacks rows"))
    return kept


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
