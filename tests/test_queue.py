"""The queue's state machine: replays with restarts against a fold of the whole log, leases, retries, the work loop."""

import os
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalyte.operators import ops
from catalyte.sources.scratch import scratch
from catalyte.streaming import queue

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = T.StructType([T.StructField("task", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("ts", T.TimestampType())])


def at(seconds):
    return START + timedelta(seconds=seconds)


def add(spark, rows, folder):
    """One more file in the log, newer than those before."""
    os.makedirs(folder, exist_ok=True)
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.02)


def follow(spark, log, folder, **how):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(log)
    return {r.task: r for r in queue.follow(stream, "task", folder, **how).collect()}


def fold(rows, lease=300, late=600):
    """Each task's state from all its events; a lease has ended if the last watermark is past it."""
    seen = max(t for _, _, t in rows) - timedelta(seconds=late)
    out = {}
    for task in {k for k, _, _ in rows}:
        own = [(kind, t) for k, kind, t in rows if k == task]
        ends = [t for kind, t in own if kind in ("failed", "done")]
        claims = [t for kind, t in own if kind == "claim"]
        failed = sum(kind == "failed" for kind, _ in own)
        status = "PENDING"
        if any(kind == "done" for kind, _ in own):
            status = "DONE"
        elif failed >= 3:
            status = "FAILED"
        elif claims and (not ends or max(claims) > max(ends)) and max(claims) + timedelta(seconds=lease) > seen:
            status = "PROCESSING"
        out[task] = (status, failed, max(ends, default=None))
    return out


def told(got):
    return {k: (r.status, r.n_failed, r.last_at.astimezone(timezone.utc) if r.last_at else None) for k, r in got.items()}


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "log"), str(tmp_path / "state")


def test_replay_in_batches_with_restarts(spark, place):
    """Seven files in three runs, each going on from the last one's checkpoint."""
    rng, log, rows, parts = random.Random(4), place[0], [], []
    for k in range(7):
        part = [(rng.randrange(40), rng.choice(["queued", "claim", "claim", "failed", "done" if rng.random() < 0.3 else "other"]), at(900 * k + rng.randrange(900))) for _ in range(60)]
        part += [(99, "failed" if k % 3 else "queued", at(900 * k + j)) for j in range(50)]  # a hot task
        parts.append(part)
    for upto in (range(3), range(3, 4), range(4, 7)):
        for k in upto:
            add(spark, parts[k], log)
            rows += parts[k]
        got = told(follow(spark, *place))
        assert got == fold(rows), list(upto)
    assert {s for s, _, _ in got.values()} == {"DONE", "FAILED", "PROCESSING", "PENDING"}
    assert told(follow(spark, *place)) == got  # nothing new: nothing changes


def test_lease_ends_and_claims_renew(spark, place):
    add(spark, [(1, "claim", at(0)), (2, "claim", at(0)), (3, "claim", at(0)), (4, "queued", at(0))], place[0])
    assert {k: r.status for k, r in follow(spark, *place).items()} == {1: "PROCESSING", 2: "PROCESSING", 3: "PROCESSING", 4: "PENDING"}
    add(spark, [(2, "claim", at(200)), (3, "failed", at(250)), (5, "queued", at(901))], place[0])  # the watermark passes 300
    got = follow(spark, *place)
    assert {k: (r.status, r.n_failed) for k, r in got.items()} == {1: ("PENDING", 0), 2: ("PROCESSING", 0), 3: ("PENDING", 1), 4: ("PENDING", 0), 5: ("PENDING", 0)}
    add(spark, [(1, "claim", at(905)), (1, "done", at(1000)), (5, "queued", at(1200))], place[0])
    assert {k: r.status for k, r in follow(spark, *place).items()} == {1: "DONE", 2: "PENDING", 3: "PENDING", 4: "PENDING", 5: "PENDING"}


def test_by_the_clock(spark, place):
    """Leases by the clock need no watermark, and old times are not dropped."""
    how = {"event_time": False, "keep_days": 30}
    add(spark, [(1, "claim", at(1000)), (2, "done", at(5))], place[0])
    assert {k: r.status for k, r in follow(spark, *place, **how).items()} == {1: "PROCESSING", 2: "DONE"}
    add(spark, [(1, "failed", at(2000)), (2, "failed", at(1))], place[0])
    assert {k: (r.status, r.n_failed) for k, r in follow(spark, *place, **how).items()} == {1: ("PENDING", 1), 2: ("DONE", 1)}
    with pytest.raises(ValueError):
        queue.task_changes(spark.readStream.schema(EVENTS).parquet(place[0]), "task", keep_days=1)


def test_work_off(spark, tmp_path):
    """Task k fails k times before it works: those of three failures and more end FAILED, and nothing is worked on again."""
    log, folder = scratch(spark, "queue-log"), str(tmp_path / "state")
    queue.put(spark.range(6).withColumnRenamed("id", "task"), log, "task", "queued")
    tries = []

    def work(claimed):
        keys = sorted(r.task for r in claimed.collect())
        tries.append(keys)
        return spark.createDataFrame([(k, sum(k in t for t in tries) > k) for k in keys], "task long, ok boolean")

    got = queue.work_off(spark, log, "task", T.LongType(), folder, work, most=4)
    assert {r.task: (r.status, r.n_failed) for r in got.collect()} == {0: ("DONE", 0), 1: ("DONE", 1), 2: ("DONE", 2), 3: ("FAILED", 3), 4: ("FAILED", 3), 5: ("FAILED", 3)}
    assert sum(map(len, tries)) == 1 + 2 + 3 + 3 * 3 and max(map(len, tries)) <= 4

    def dies(claimed):
        raise RuntimeError("lost")

    queue.put(spark.range(10, 11).withColumnRenamed("id", "task"), log, "task", "queued")
    with pytest.raises(RuntimeError, match="lost"):
        queue.work_off(spark, log, "task", T.LongType(), folder, dies)
    left = queue.work_off(spark, log, "task", T.LongType(), folder, work)
    assert {r.task: r.status for r in left.collect()}[10] == "PROCESSING"  # until its lease ends


def test_same_states_as_the_batch_form(spark, place):
    rng, rows = random.Random(8), []
    for k in range(4):
        part = [(rng.randrange(15), rng.choice(["failed", "failed", "done"]), at(500 * k + rng.randrange(500))) for _ in range(25)]
        add(spark, part, place[0])
        rows += part
    batch = ops.queue_state(spark.createDataFrame(rows, EVENTS), "task", F.col("kind") == "done", "ts").collect()
    assert {k: (r.status, r.n_failed, r.last_at) for k, r in follow(spark, *place).items()} == {r.task: (r.status, r.n_failed, r.last_at) for r in batch}
