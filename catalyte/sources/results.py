"""A store of results by the content they belong to: what is there is never computed again.

The key is a hash of the content (or any other column that fixes the result, as an address does
for a download); the settings that a result depends on (version, mode, size limit) name the folder, so a
lookup reads the results of its own settings only. Tasks write the results; a part counts
when a version of the log (``Commits``) names it, so a killed run leaves nothing half there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commits import Commits


class ResultStore:
    """``key``: the column (a string) that fixes a result. ``value``: the result's columns as DDL. ``settings``: what else fixes it.

    Every part also keeps ``error``: a result with an error is reported but does not count as there, so
    the next run tries it again.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, value: str, settings: dict[str, object]):
        self.spark, self.key = spark, key
        self.values = T.StructType.fromDDL(value)
        name = ",".join(f"{quote(str(k), safe='')}={quote(str(v), safe='')}" for k, v in sorted(settings.items())) or "all"
        self.root = f"{root.rstrip('/')}/{name}"
        self.commits = Commits(spark, f"{self.root}/versions")

    def parts(self) -> list[str]:
        version = self.commits.latest()
        return self.commits.read(version)["parts"] if version else []

    def entries(self) -> DataFrame:
        """(key, value, error), one row a key: a result before an error, of several the one of the part whose name is highest."""
        stored = T.StructType([T.StructField(self.key, T.StringType()), *self.values.fields, T.StructField("error", T.StringType())])
        parts = self.parts()
        if not parts:
            return self.spark.createDataFrame([], stored)
        rows = self.spark.read.schema(stored).parquet(*[f"{self.root}/parts/{p}/results" for p in parts])
        if len(parts) > 1:  # two writers may have computed the same key, and what failed in one part may be there in a later one
            best = F.struct(F.col("error").isNull(), F.col("_metadata.file_path"))
            rows = rows.groupBy(self.key).agg(F.max_by(F.struct(*self.values.names, "error"), best).alias("__r")).select(self.key, "__r.*")
        return rows

    def read(self) -> DataFrame:
        """(key, value) of all results."""
        return self.entries().filter("error IS NULL").drop("error")

    def fill(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> dict:
        """Compute and store what ``rows`` ask for and the store lacks.

        ``compute`` gets one whole row of each missing key (of rows with one key any, as the key
        fixes the result) and gives (key, value) and, if it likes, ``error``; of several rows of
        a key one stays, a key without a row is an error. With nothing missing it is not called. Rows
        without a key are not asked for. Returns ``hits`` and ``misses`` (rows of ``rows`` whose key was and was
        not there), ``computed`` and ``failed`` (keys), counted as the tables are written, and ``part``.
        """
        part = uuid.uuid4().hex
        place = f"{self.root}/parts/{part}"
        asked, done = Observation(), Observation()
        there = self.read().select(self.key, F.lit(True).alias("was_stored"))
        keys = rows.select(F.col(self.key).cast("string").alias(self.key)).filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.count(F.lit(1)).alias("__n"))
        work = keys.join(there, self.key, "left").withColumn("was_stored", F.coalesce("was_stored", F.lit(False)))
        hit, miss = (F.coalesce(F.sum(F.when(c, F.col("__n"))), F.lit(0)) for c in (F.col("was_stored"), ~F.col("was_stored")))
        work.observe(asked, hit.alias("hits"), miss.alias("misses")).write.parquet(f"{place}/work")
        counts = dict(asked.get) | {"computed": 0, "failed": 0, "part": part}
        if counts["misses"]:
            missing = self.work(part).filter("NOT was_stored").select(self.key)
            one = rows.withColumn(self.key, F.col(self.key).cast("string")).join(missing, self.key, "left_semi").dropDuplicates([self.key])
            found = compute(one)
            problem = F.col("error") if "error" in found.columns else F.lit(None)
            found = found.select(self.key, F.lit(True).alias("__here"), *(F.col(f.name).cast(f.dataType) for f in self.values), problem.cast("string").alias("error")).dropDuplicates([self.key])
            found = missing.join(found, self.key, "left").withColumn("error", F.when(F.col("__here").isNull(), "no result").otherwise(F.col("error"))).drop("__here")
            found.observe(done, F.count_if(F.col("error").isNull()).alias("computed"), F.count("error").alias("failed")).write.parquet(f"{place}/results")
            counts |= done.get
            self.commits.change(lambda s: {"parts": [*s["parts"], part]}, {"parts": []})
        return counts

    def work(self, part: str) -> DataFrame:
        """(key, was_stored) that a ``fill`` looked up."""
        return self.spark.read.parquet(f"{self.root}/parts/{part}/work").drop("__n")

    def joined(self, rows: DataFrame, part: str) -> DataFrame:
        """``rows`` with the value, ``error`` and ``was_stored`` of their keys, as a ``fill`` left them; rows without a key have nulls there."""
        clash = {*self.values.names, "error", "was_stored"} & set(rows.columns)
        if clash:
            raise ValueError(f"rows have columns of the results: {sorted(clash)}")
        got = self.work(part).join(self.entries(), self.key, "left")
        return rows.withColumn(self.key, F.col(self.key).cast("string")).join(got, self.key, "left")

    def through(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict]:
        """``joined`` after ``fill``, and the latter's counts."""
        counts = self.fill(rows, compute)
        return self.joined(rows, counts["part"]), counts

    def compact(self) -> int:
        """One part instead of many, without what failed; returns how many there were. To be run while nobody fills or reads."""
        parts = self.parts()
        part = uuid.uuid4().hex
        if len(parts) > 1:
            self.read().withColumn("error", F.lit(None).cast("string")).write.parquet(f"{self.root}/parts/{part}/results")
            self.commits.change(lambda s: {"parts": [part] + [p for p in s["parts"] if p not in parts]}, {"parts": []})
        named, folder = set(self.parts()), self.commits.path(f"{self.root}/parts")
        for f in self.commits.store.listStatus(folder) if self.commits.store.exists(folder) else []:
            if f.getPath().getName() not in named:
                self.commits.store.delete(f.getPath(), True)
        return len(parts)
