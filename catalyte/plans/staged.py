"""A run in stages that can be taken up again: each stage leaves tables, and a ledger of what became of every key.

A stage reads its work list, leaves out the keys that its ledger settles, works on the rest in
slices, and writes for each slice what came out and one ledger row a key. A slice counts when the stage's log
(``Commits``) names it; what a killed run leaves behind is named by no version and is done again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.commits import Commits

SLICE = "__slice"
START = {"parts": [], "schema": None, "complete": False, "counts": {}}


class StagedRun:
    """The run ``run_id`` below ``root``; ``key`` names the column whose values are worked on.

    A key is ``ok`` if it has rows without an error, ``failed`` if one of its rows has an
    ``error_class``, ``skipped`` if it has no row. The latter two are tried again when the stage runs again, up to
    ``most_attempts`` in all. Null keys have no entry.
    """

    def __init__(self, spark: SparkSession, root: str, run_id: str, key: str):
        self.spark, self.run_id, self.key = spark, run_id, key
        self.folder = f"{root.rstrip('/')}/{run_id}"

    def _log(self, stage: str) -> Commits:
        return Commits(self.spark, f"{self.folder}/{stage}/log")

    def state(self, stage: str) -> dict:
        """What the stage's log says: its parts, ``counts`` over all attempts, and whether it is ``complete``."""
        log = self._log(stage)
        version = log.latest()
        return log.read(version) if version else dict(START)

    def stage(self, name: str, work: DataFrame, how: Callable[[DataFrame], DataFrame], *, slices: int = 1, most_attempts: int | None = None, counters: dict[str, Column] | None = None) -> dict:
        """Do what is left of ``work`` and return the stage's state.

        ``how`` maps a table of keys to rows with the key, and, if it likes, ``error_class`` and
        ``error_message``. ``counters`` are aggregates of these rows; they and the ledger's counts are
        observed while the tables are written and added up over slices and attempts. A stage whose
        log says that it is complete (every key ok, or out of attempts) returns at once, without a job: a run's work does not
        change. ``slices``: how much a killed run loses at most; each reads the stage's input anew.
        """
        log, state, counters = self._log(name), self.state(name), counters or {}
        if state["complete"]:
            return state
        todo, base = f"{self.folder}/{name}/todo/{uuid.uuid4().hex}", f"{self.folder}/{name}/parts"
        left = work.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        if state["parts"]:
            settled = F.col("status") == "ok"
            if most_attempts is not None:
                settled |= F.col("attempts") >= most_attempts
            left = left.join(self.ledger(name).filter(settled).select(self.key), self.key, "left_anti")
        asked = Observation()
        left.withColumn(SLICE, F.pmod(F.xxhash64(self.key), F.lit(slices)).cast("int")).observe(asked, F.count(F.lit(1)).alias("n")).write.partitionBy(SLICE).parquet(todo)
        n_left, open_keys = asked.get["n"], 0
        if n_left:
            listed = self.spark.read.parquet(todo)
            for k in range(slices):
                keys = listed.filter(F.col(SLICE) == k).select(self.key)
                part = uuid.uuid4().hex
                found = how(keys)
                seen, done = Observation(), Observation()
                (found.observe(seen, *[c.alias(n) for n, c in counters.items()]) if counters else found).write.parquet(f"{base}/{part}/rows")
                ledger = self._entries(keys, self.spark.read.schema(found.schema).parquet(f"{base}/{part}/rows"))
                ledger.observe(done, *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "failed", "skipped")]).write.parquet(f"{base}/{part}/ledger")
                counts = {"ok": 0, "failed": 0, "skipped": 0} | done.get | ({n: v or 0 for n, v in seen.get.items()} if counters else {})
                open_keys += counts["failed"] + counts["skipped"]
                kind = {"schema": found.schema.jsonValue(), "key": work.schema[self.key].jsonValue()}
                state = log.change(lambda s, part=part, counts=counts, kind=kind: s | kind | {"parts": [*s["parts"], part], "counts": {n: s["counts"].get(n, 0) + v for n, v in counts.items()}}, dict(START))
        if n_left and open_keys and most_attempts is not None:
            open_keys = self.ledger(name).filter((F.col("status") != "ok") & (F.col("attempts") < most_attempts)).limit(1).count()
        if not open_keys:
            state = log.change(lambda s: s | {"complete": True}, dict(START))
        log.store.delete(log.path(todo), True)
        return state

    def _entries(self, keys: DataFrame, rows: DataFrame) -> DataFrame:
        def first(c: str) -> Column:
            return F.min_by(F.col(c).cast("string"), F.struct("error_class", c)).alias(c) if c in rows.columns and "error_class" in rows.columns else F.lit(None).cast("string").alias(c)

        per = rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("n_rows"), first("error_class"), first("error_message"))
        status = F.when(F.col("n_rows").isNull(), "skipped").when(F.col("error_class").isNotNull(), "failed").otherwise("ok")
        cut = [F.substring("error_class", 1, 200).alias("error_class"), F.substring("error_message", 1, 2000).alias("error_message")]
        return keys.join(per, self.key, "left").select(self.key, status.alias("status"), *cut, F.current_timestamp().alias("at"))

    def _read(self, stage: str, what: str, schema: T.StructType) -> DataFrame:
        """The tables of all parts, with the place of a row's part in the log."""
        parts = self.state(stage)["parts"]
        if not parts:
            return self.spark.createDataFrame([], schema).withColumn("__part", F.lit(0))
        part = F.regexp_extract(F.col("_metadata.file_path"), "/parts/([0-9a-f]{32})/", 1)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{stage}/parts/{p}/{what}" for p in parts]).withColumn("__part", F.array_position(F.array(*map(F.lit, parts)), part))

    def _attempts(self, stage: str) -> DataFrame:
        state = self.state(stage)
        key = T.StructField.fromJson(state["key"]) if state["schema"] else T.StructField(self.key, T.StringType())
        fields = [T.StructField(n, T.StringType()) for n in ("status", "error_class", "error_message")]
        return self._read(stage, "ledger", T.StructType([key, *fields, T.StructField("at", T.TimestampType())]))

    def ledger(self, stage: str) -> DataFrame:
        """(key, stage, status, attempts, error_class, error_message, at), one row a key: as the last attempt left it, an ``ok`` stays."""
        last = F.max_by(F.struct("status", "error_class", "error_message", "at"), F.struct(F.col("status") == "ok", "__part"))
        return self._attempts(stage).groupBy(self.key).agg(F.count(F.lit(1)).alias("attempts"), last.alias("__l")).select(self.key, F.lit(stage).alias("stage"), "__l.status", "attempts", "__l.error_class", "__l.error_message", "__l.at")

    def results(self, stage: str) -> DataFrame:
        """The rows of the keys that are ok, each from the attempt that made it so."""
        state = self.state(stage)
        if state["schema"] is None:
            raise LookupError(f"the stage {stage} has no results")
        ok = self._attempts(stage).filter("status = 'ok'").groupBy(self.key).agg(F.max("__part").alias("__part"))
        return self._read(stage, "rows", T.StructType.fromJson(state["schema"])).join(ok, [self.key, "__part"], "left_semi").drop("__part")

    def failures(self, stage: str) -> DataFrame:
        """(run_id, stage, key, error_class, error_message, attempts) of the keys whose last attempt failed."""
        bad = self.ledger(stage).filter("status = 'failed'")
        return bad.select(F.lit(self.run_id).alias("run_id"), "stage", self.key, "error_class", "error_message", "attempts")

    def clear(self, stage: str) -> None:
        """Forget a stage: its next run starts anew."""
        log = self._log(stage)
        log.store.delete(log.path(f"{self.folder}/{stage}"), True)

    def sweep(self, stage: str) -> int:
        """Delete what killed runs left behind; returns how many folders. To be run while the stage is not."""
        log, named, gone = self._log(stage), set(self.state(stage)["parts"]), 0
        for sub in ("parts", "todo"):
            folder = log.path(f"{self.folder}/{stage}/{sub}")
            for f in log.store.listStatus(folder) if log.store.exists(folder) else []:
                if sub == "todo" or f.getPath().getName() not in named:
                    log.store.delete(f.getPath(), True)
                    gone += 1
        return gone
