"""A work queue as a stream of events with a state machine a task.

The queue is an append-only log of (key, kind, ts): a task is known from its first event, a
``claim`` makes it PROCESSING until its lease ends, ``failed`` sends it back to PENDING until
it has failed ``retries`` times, ``done`` ends it. The state of a task is one row in Spark's
state store, a lease is a timer there, and a log of any length is read once. Facts are
folded so that their order does not matter (the latest claim, the latest outcome, a count of
failures), so a batch of a hot key streams through without being sorted or held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import vocab
from .events import run_available

KINDS = ("queued", "claim", "failed", "done")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FACTS = T.StructType(
    [
        T.StructField("done", T.BooleanType()), T.StructField("n_failed", T.LongType()), T.StructField("outcome_at", T.LongType()),
        T.StructField("claimed_at", T.LongType()), T.StructField("lapsed", T.BooleanType()), T.StructField("ends", T.LongType()), T.StructField("version", T.LongType()),
    ]
)


class Task(StatefulProcessor):
    """One task's facts; times are microseconds, timers milliseconds. ``event_time``: leases run by the watermark, else by the clock."""

    def __init__(self, key: str, lease_ms: int, event_time: bool, keep_ms: int | None):
        self.key, self.lease_ms, self.event_time, self.keep_ms = key, lease_ms, event_time, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.facts = handle, handle.getValueState("facts", FACTS, self.keep_ms)

    def _put(self, key, facts) -> Iterator[Row]:
        self.facts.update(facts)
        yield Row(**{self.key: key[0]}, **dict(zip(FACTS.names, facts)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        done, n_failed, outcome_at, claimed_at, lapsed, ends, version = self.facts.get() or (False, 0, None, None, False, None, 0)
        for row in rows:
            if row["kind"] == "claim":
                if claimed_at is None or row["at"] > claimed_at:
                    claimed_at, lapsed = row["at"], False
            elif row["kind"] in ("failed", "done"):
                done, n_failed = done or row["kind"] == "done", n_failed + (row["kind"] == "failed")
                outcome_at = max(outcome_at or row["at"], row["at"])
        open_claim = not done and not lapsed and claimed_at is not None and (outcome_at is None or claimed_at > outcome_at)
        due = None
        if open_claim:
            due = (claimed_at // 1000 if self.event_time else timerValues.getCurrentProcessingTimeInMs()) + self.lease_ms if ends is None or self.event_time else ends
        if due != ends:
            if ends is not None:
                self.handle.deleteTimer(ends)
            if due is not None:
                self.handle.registerTimer(due)
        yield from self._put(key, (done, n_failed, outcome_at, claimed_at, lapsed, due, version + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        found = self.facts.get()
        if found and found[5] == expiredTimerInfo.getExpiryTimeInMs():
            done, n_failed, outcome_at, claimed_at, _, _, version = found
            yield from self._put(key, (done, n_failed, outcome_at, claimed_at, True, None, version + 1))

    def close(self) -> None:
        pass


def task_changes(events: DataFrame, key: str, *, lease_minutes: int = vocab.LEASE_MINUTES, late: str = "10 minutes", event_time: bool = True, keep_days: int | None = None) -> DataFrame:
    """Each task's facts whenever they change: ``key``, the columns of ``FACTS``; ``version`` counts a task's changes.

    ``events``: a stream of key, kind (of ``KINDS``; others only make a task known) and ts;
    null keys are a task of their own, rows with a null time are dropped. By the watermark leases
    end ``lease_minutes`` after the claim, and events later than ``late`` are dropped as
    Spark does; by the clock they end that long after the claim was read, and with
    ``keep_days`` a task that has not changed for so long is forgotten.
    """
    if event_time and keep_days:
        raise ValueError("the store forgets by the clock only: keep_days needs event_time=False")
    kind = events.schema[key].dataType
    slim = events.filter("ts is not null").select(key, "kind", "ts", F.unix_micros("ts").alias("at"))
    slim = slim.withWatermark("ts", late) if event_time else slim
    keep = keep_days * 86_400_000 if keep_days else None
    task = Task(key, lease_minutes * 60_000, event_time, keep)
    schema = T.StructType([T.StructField(key, kind), *FACTS.fields])
    return slim.groupBy(key).transformWithState(task, schema, "Update", "EventTime" if event_time else "ProcessingTime")


def states(changes: DataFrame, key: str, *, retries: int = vocab.RETRIES) -> DataFrame:
    """(key, status, n_failed, last_at, claimed_at) as of the newest change of each task."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("done", "n_failed", "outcome_at", "claimed_at", "lapsed"), "version").alias("f")).select(key, "f.*")
    claimed = F.col("claimed_at").isNotNull() & ~F.col("lapsed") & (F.col("outcome_at").isNull() | (F.col("claimed_at") > F.col("outcome_at")))
    status = F.when(F.col("done"), "DONE").when(F.col("n_failed") >= retries, "FAILED").when(claimed, "PROCESSING").otherwise("PENDING")
    return last.select(key, status.alias("status"), "n_failed", F.timestamp_micros("outcome_at").alias("last_at"), F.timestamp_micros("claimed_at").alias("claimed_at"))


def follow(events: DataFrame, key: str, folder: str, **how) -> DataFrame:
    """Read what the log has by now and return every task's state.

    Changes and the stream's checkpoint are kept in ``folder``: a later call goes on from there, and a
    batch that is run again after a failure replaces its own changes. By the clock, leases
    are looked at when there are new events.
    """
    spark, retries = events.sparkSession, how.pop("retries", vocab.RETRIES)
    # by the clock there is always a next batch without data, so such a run would never be through
    wanted = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.streaming.noDataMicroBatches.enabled": str(how.get("event_time", True)).lower()}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    changes = task_changes(events, key, **how)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")

    try:
        run_available(changes, sink, f"{folder}/checkpoint", "update")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return states(spark.read.schema(changes.schema).parquet(f"{folder}/changes"), key, retries=retries)


def log_schema(key: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(key, kind), T.StructField("kind", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("round", T.StringType())])


def put(rows: DataFrame, log: str, key: str, kind, *, round_id: str | None = None) -> None:
    """Append events of one ``kind`` (a name or a column) to the log."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    rows.select(key, kind.alias("kind"), F.current_timestamp().alias("ts"), F.lit(round_id).cast("string").alias("round")).write.mode("append").parquet(log)


def work_off(spark: SparkSession, log: str, key: str, kind: T.DataType, folder: str, work: Callable[[DataFrame], DataFrame], *, most: int | None = None, rounds: int | None = None, **how) -> DataFrame:
    """Claim what is pending, work on it, log what became of it, until nothing is pending; returns the states.

    ``work`` takes the claimed keys and returns (key, ok), one row each. ``most`` tasks are
    claimed at a time. Claims are in the log before work starts: should it die, their leases
    end and the tasks are pending again. What ``work`` says nothing about stays claimed.
    """
    schema, done = log_schema(key, kind), 0
    while True:
        now = follow(spark.readStream.schema(schema).parquet(log), key, folder, **how)
        pending = now.filter("status = 'PENDING'").select(key)
        pending = pending.orderBy(key).limit(most) if most else pending
        if rounds is not None and done >= rounds or pending.isEmpty():
            return now
        round_id = f"{folder}#{done}#{spark.range(1).select(F.expr('uuid()')).first()[0]}"
        put(pending, log, key, "claim", round_id=round_id)
        claimed = spark.read.schema(schema).parquet(log).filter(F.col("round") == round_id).select(key)
        put(work(claimed), log, key, F.when(F.col("ok"), "done").otherwise("failed"))
        done += 1
