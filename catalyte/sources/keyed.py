"""A table with a key, kept in hash buckets: an upsert writes the buckets that it touches anew and no others.

Every version is a list of bucket folders (``Commits``). An upsert reads the touched buckets,
merges, writes them to a folder of its own and then makes the next version, which names the
new folders for these buckets and the old ones for the rest. Until then readers see the old
version whole; what a killed write leaves behind is named by no version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commits import Commits, Conflict

BUCKET = "__bucket"


class KeyedTable:
    """``key``: its columns. ``order``: columns that say which of two rows of a key is newer; what is upserted wins ties."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], order: list[str], *, buckets: int = 256):
        self.spark, self.root, self.key, self.order, self.buckets = spark, root.rstrip("/"), key, order, buckets
        self.commits = Commits(spark, f"{self.root}/versions")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in self.key)), F.lit(self.buckets)).cast("int")

    def state(self, version: int | None = None) -> dict | None:
        version = self.commits.latest() if version is None else version
        return self.commits.read(version) | {"version": version} if version else None

    def _rows(self, state: dict, only: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"])
        places = [f"{self.root}/{place}" for b, place in state["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest if none is named."""
        state = self.state(version)
        if state is None:
            raise FileNotFoundError(f"no version in {self.root}")
        return self._rows(state)

    def upsert(self, changes: DataFrame, *, keep: tuple[str, ...] = (), attempts: int = 3) -> int:
        """Put one row a key: the newest of those there and those of ``changes``; returns the version.

        ``keep``: columns that stay as they were when the key was first seen. Several changes
        of a key are one (the newest; ``keep`` from the oldest), null keys are keys. Without
        changes nothing is written. A writer that came second starts again from the other's version.
        """
        for left in range(attempts - 1, -1, -1):
            state = self.state()
            try:
                return self._upsert(changes, keep, state)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def _upsert(self, changes: DataFrame, keep: tuple[str, ...], state: dict | None) -> int:
        if state and state["n"] != self.buckets:
            raise ValueError(f"the table has {state['n']} buckets")
        schema = T.StructType.fromJson(state["schema"]) if state else changes.schema
        new = self._one_each(changes.select(*(F.col(f.name).cast(f.dataType) for f in schema)), keep, None)
        folder = f"data/{uuid.uuid4().hex}"
        staged = f"{self.root}/{folder}/changes"
        new.withColumn(BUCKET, self.bucket()).write.parquet(staged)  # read twice below, and as it was in a repeated task
        new = self.spark.read.parquet(staged)
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # as many as there are buckets at most
        if touched:
            merged = new.drop(BUCKET)
            if state:
                old = self._rows(state, touched)
                merged = self._one_each(old.withColumn("__new", F.lit(0)).unionByName(merged.withColumn("__new", F.lit(1))), keep, "__new")
            out = merged.select(*schema.names).withColumn(BUCKET, self.bucket())
            out.repartition(min(len(touched), 4096), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}/rows")
        self.commits.store.delete(self.commits.path(staged), True)
        if not touched:
            return state["version"] if state else 0
        places = {str(b): f"{folder}/rows/{BUCKET}={b}" for b in touched}
        content = {"n": self.buckets, "schema": json.loads(schema.json()), "buckets": (state or {}).get("buckets", {}) | places}
        return self.commits.put((state["version"] if state else 0) + 1, content)

    def _one_each(self, rows: DataFrame, keep: tuple[str, ...], newness: str | None) -> DataFrame:
        by = F.struct(*self.order, *([newness] if newness else []))
        carry = [c for c in rows.columns if c not in (*self.key, *keep, newness)]
        parts = [F.max_by(F.struct(*carry), by).alias("__last")] if carry else []
        parts += [F.min_by(F.struct(*keep), by).alias("__first")] if keep else []
        found = rows.groupBy(*self.key).agg(*(parts or [F.count(F.lit(1))]))
        return found.select(*self.key, *(["__last.*"] if carry else []), *(["__first.*"] if keep else []))

    def vacuum(self, versions: int = 2) -> int:
        """Delete the folders that none of the last ``versions`` names and no write can still be making; returns how many.

        To be run while nobody writes.
        """
        last = self.commits.latest()
        named = {"/".join(p.split("/")[:2]) for v in range(max(1, last - versions + 1), last + 1) for p in self.commits.read(v)["buckets"].values()}
        data, gone = self.commits.path(f"{self.root}/data"), 0
        for f in self.commits.store.listStatus(data) if self.commits.store.exists(data) else []:
            if f"data/{f.getPath().getName()}" not in named:
                self.commits.store.delete(f.getPath(), True)
                gone += 1
        return gone
