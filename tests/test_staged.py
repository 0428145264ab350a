"""Results by content and runs in stages: nothing is computed twice, a killed run goes on where it was."""

import os

import pytest
from pyspark.sql import functions as F

from catalyte.functions import encoders
from catalyte.plans.staged import StagedRun
from catalyte.sources.results import ResultStore


def images(spark, contents):
    rows = [(k, c) for k, c in enumerate(contents)]
    return spark.createDataFrame(rows, "image long, content binary").withColumn("content_md5", F.md5("content"))


def counted(calls):
    """A test encoder that leaves a line for each content it gets, and for each load."""

    def load():
        with open(f"{calls}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")
        return 1.0

    def encode(model, contents):
        with open(f"{calls}/contents", "a") as f:
            f.write("".join(f"{len(c)}\n" for c in contents))
        if any(c == b"bad" for c in contents):
            raise ValueError("cannot decode")
        return [[model, float(len(c))] for c in contents]

    return lambda rows: encoders.encoded(rows, "content_md5", "content", f"test-{calls}", load, encode, "vec array<float>", batch=3)


def lines(path):
    return open(path).read().split() if os.path.exists(path) else []


def test_second_run_calls_no_encoder(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store = ResultStore(spark, str(tmp_path / "s"), "content_md5", "vec array<float>", {"version": "v1", "mode": "fast", "max_pixels": 100})
    rows = images(spark, [b"a", b"bb", b"a", b"", None, b"ccc"] + [b"x" * n for n in range(4, 20)])
    got, counts = store.through(rows, counted(calls))
    found = {r.image: r for r in got.collect()}
    assert (counts["hits"], counts["misses"], counts["computed"], counts["failed"]) == (0, 21, 20, 0)
    assert found[1].vec == [1.0, 2.0] and found[0].vec == found[2].vec == [1.0, 1.0] and found[3].vec == [1.0, 0.0] and found[4].vec is None and not found[1].was_stored
    assert len(lines(calls / "contents")) == 20
    assert len(lines(calls / "loads")) == len(set(lines(calls / "loads")))  # once a worker, however many batches
    got, counts = store.through(rows, counted(calls))
    assert (counts["hits"], counts["misses"], counts["computed"]) == (21, 0, 0) and len(lines(calls / "contents")) == 20
    assert {r.image: r.vec for r in got.collect()} == {k: r.vec for k, r in found.items()}
    _, counts = store.through(images(spark, [b"a", b"new"]), counted(calls))
    assert (counts["hits"], counts["misses"]) == (1, 1) and lines(calls / "contents")[20:] == ["3"]
    other = ResultStore(spark, str(tmp_path / "s"), "content_md5", "vec array<float>", {"version": "v1", "mode": "fast", "max_pixels": 200})
    assert other.parts() == [] and other.fill(images(spark, [b"a"]), counted(calls))["misses"] == 1  # another limit is another result
    assert store.compact() == 2 and len(store.parts()) == 1 and store.read().count() == 21
    with pytest.raises(ValueError, match="vec"):
        store.through(rows.withColumn("vec", F.lit(1)), counted(calls))


def test_errors_are_rows_and_tried_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store = ResultStore(spark, str(tmp_path / "s"), "content_md5", "vec array<float>", {"version": 1})
    rows = images(spark, [b"bad", b"ok", b"fine"]).coalesce(1)
    got, counts = store.through(rows, counted(calls))
    assert counts["computed"] == 2 and counts["failed"] == 1
    assert {r.image: r.error for r in got.collect()} == {0: "ValueError: cannot decode", 1: None, 2: None}
    got, counts = store.through(rows, lambda r: r.select("content_md5", F.array(F.lit(7.0)).alias("vec")))
    assert (counts["hits"], counts["misses"], counts["computed"]) == (2, 1, 1) and {r.image: r.vec[0] for r in got.collect()} == {0: 7.0, 1: 1.0, 2: 1.0}
    assert store.entries().filter("error is not null").count() == 0
    silent, counts = store.through(images(spark, [b"none"]), lambda r: r.select("content_md5", F.array(F.lit(7.0)).alias("vec")).limit(0))
    assert counts["failed"] == 1 and silent.first().error == "no result"
    empty, counts = store.through(rows.limit(0), counted(calls))
    assert empty.count() == 0 and counts["misses"] == 0


def test_killed_write_leaves_nothing(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "s"), "content_md5", "vec array<float>", {})
    rows = images(spark, [b"a", b"b"])
    broken = F.udf(lambda c: 1 / 0, "array<float>")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        store.fill(rows, lambda r: r.select("content_md5", broken("content").alias("vec")))
    assert store.parts() == [] and store.read().count() == 0
    assert store.fill(rows, lambda r: r.select("content_md5", F.array(F.lit(1.0)).alias("vec")))["computed"] == 2


def test_rerun_redoes_the_last_stage_only(spark, tmp_path):
    work = spark.range(40).select(F.col("id").alias("item")).union(spark.createDataFrame([(None,), (3,)], "item long"))
    ran = []

    def stage(name, fails=False):
        def how(keys):
            ran.append(name)
            if fails:
                raise RuntimeError("killed")
            return keys.select("item", F.lit(name).alias("by"), (F.col("item") % 2).alias("hit"))

        return how

    def run(last_fails):
        r = StagedRun(spark, str(tmp_path), "run1", "item")
        r.stage("one", work, stage("one"), slices=3, counters={"hits": F.sum("hit")})
        r.stage("two", r.results("one"), stage("two"))
        return r, r.stage("three", work, stage("three", last_fails))

    with pytest.raises(RuntimeError):
        run(True)
    assert ran == ["one"] * 3 + ["two", "three"]
    r, state = run(False)
    assert ran[5:] == ["three"] and state["complete"] and state["counts"] == {"ok": 40, "failed": 0, "skipped": 0}
    assert r.state("one")["counts"] == {"ok": 40, "failed": 0, "skipped": 0, "hits": 20}
    assert sorted(x.item for x in r.results("three").collect()) == list(range(40))
    assert r.sweep("three") == 1 and r.sweep("one") == 0
    assert StagedRun(spark, str(tmp_path), "run2", "item").state("one")["parts"] == []
    r._log("two").change(lambda s: s | {"complete": False}, {})  # as if killed between the last slice and the mark
    assert r.stage("two", work, stage("two"))["complete"] and ran[6:] == [] and r.state("two")["counts"]["ok"] == 40
    r.clear("three")
    assert not r.state("three")["complete"]


def test_killed_slice_keeps_the_slices_before(spark, tmp_path):
    work, seen = spark.range(30).select(F.col("id").alias("item")), []

    def how(stop):
        def run(keys):
            if len(seen) == stop:
                raise RuntimeError("killed")
            seen.append(sorted(r.item for r in keys.collect()))
            return keys

        return run

    r = StagedRun(spark, str(tmp_path), "r", "item")
    with pytest.raises(RuntimeError):
        r.stage("cv", work, how(2), slices=4)
    assert len(r.state("cv")["parts"]) == 2 and not r.state("cv")["complete"]
    r.stage("cv", work, how(None), slices=4)
    done = [k for part in seen for k in part]
    assert sorted(done) == list(range(30)) and r.state("cv")["complete"]  # none twice


def test_failed_and_skipped_keys_are_tried_again(spark, tmp_path):
    work = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "item string")
    r = StagedRun(spark, str(tmp_path), "r", "item")
    asked = []

    def how(good):
        def run(keys):
            asked.append(sorted(x.item for x in keys.collect()))
            err = F.when(~F.col("item").isin(good), "E" * 300)
            return keys.filter("item <> 'd'").select("item", F.lit(len(asked)).alias("n"), err.alias("error_class"), F.when(err.isNotNull(), F.lit("m" * 3000)).alias("error_message"))

        return run

    state = r.stage("s", work, how(["a"]))
    assert not state["complete"] and state["counts"] == {"ok": 1, "failed": 2, "skipped": 1}
    state = r.stage("s", work, how(["a", "b"]), most_attempts=2)
    assert asked == [["a", "b", "c", "d"], ["b", "c", "d"]] and state["complete"]  # c and d are out of attempts
    assert r.stage("s", work, how([]), most_attempts=2)["complete"] and len(asked) == 2
    got = {x.item: (x.status, x.attempts) for x in r.ledger("s").collect()}
    assert got == {"a": ("ok", 1), "b": ("ok", 2), "c": ("failed", 2), "d": ("skipped", 2)}
    assert sorted((x.item, x.n) for x in r.results("s").collect()) == [("a", 1), ("b", 2)]
    (bad,) = r.failures("s").collect()
    assert (bad.run_id, bad.item, len(bad.error_class), len(bad.error_message), bad.attempts) == ("r", "c", 200, 2000, 2)
    assert StagedRun(spark, str(tmp_path), "e", "item").stage("s", work.limit(0), how([]))["complete"]
