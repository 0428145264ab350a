"""Bucketed upserts and the dataset registry as storage: what is written, what a failure leaves, and races."""

import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from catalyte.sources import keyed
from catalyte.sources.commits import Commits, Conflict
from catalyte.sources.keyed import KeyedTable
from catalyte.sources.registry import Registry

ROWS = "k long, v string, made long, at long"


def rows(spark, found):
    return spark.createDataFrame(found, ROWS)


def files(table):
    return {b: sorted(os.listdir(f"{table.root.removeprefix('file://')}/{p}")) for b, p in table.state()["buckets"].items()}


def content(df):
    return sorted(tuple(r) for r in df.select("k", "v", "made", "at").collect())


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["at"], buckets=16)
    assert table.state() is None and table.upsert(rows(spark, [])) == 0
    table.upsert(rows(spark, [(k, "a", 1, 1) for k in range(200)]))
    before, names = table.state()["buckets"], files(table)
    assert table.upsert(rows(spark, [(5, "b", 2, 2), (5, "c", 3, 3), (900, "n", 3, 3), (7, "old", 0, 0)]), keep=("made",)) == 2
    want = {k: (k, "a", 1, 1) for k in range(200)} | {5: (5, "c", 1, 3), 900: (900, "n", 3, 3), 7: (7, "a", 0, 1)}
    assert content(table.read()) == sorted(want.values()) and content(table.read(1)) == [(k, "a", 1, 1) for k in range(200)]
    after = table.state()["buckets"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 3 and all(files(table)[b] == names[b] for b in set(names) - changed)
    assert table.upsert(rows(spark, [])) == 2
    table.upsert(rows(spark, [(5, "tie", 9, 3), (None, "null key", 1, 1), (None, "null key", 1, 2)]))
    assert {(5, "tie", 9, 3), (None, "null key", 1, 2)} <= {tuple(r) for r in table.read().collect()} and table.read().count() == 202
    with pytest.raises(ValueError, match="16 buckets"):
        KeyedTable(spark, str(tmp_path / "t"), ["k"], ["at"], buckets=8).upsert(rows(spark, [(1, "x", 1, 9)]))
    assert table.vacuum(1) > 0 and table.read().count() == 202


def test_a_killed_write_leaves_the_old_version(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], ["at"], buckets=4)
    table.upsert(rows(spark, [(k, "a", 1, 1) for k in range(50)]))
    want = content(table.read())
    broken = rows(spark, [(k, "b", 1, 2) for k in range(50)]).withColumn("v", F.when(F.col("k") == 49, F.raise_error(F.lit("task lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="task lost"):
        table.upsert(broken)
    assert content(table.read()) == want and table.state()["version"] == 1
    assert table.upsert(rows(spark, [(k, "b", 1, 2) for k in range(50)])) == 2 and table.read().filter("v = 'b'").count() == 50


def test_the_second_writer_starts_again(spark, tmp_path, monkeypatch):
    """Another upsert comes between reading and committing: both changes are in the end."""
    table, other = (KeyedTable(spark, str(tmp_path / "t"), ["k"], ["at"], buckets=4) for _ in range(2))
    table.upsert(rows(spark, [(1, "a", 1, 1), (2, "a", 1, 1)]))
    put, raced = Commits.put, []

    def late(self, version, content):
        if self is table.commits and not raced:
            raced.append(other.upsert(rows(spark, [(2, "other", 1, 5)])))
        return put(self, version, content)

    monkeypatch.setattr(keyed.Commits, "put", late)
    assert table.upsert(rows(spark, [(1, "mine", 1, 4)])) == 3 and raced == [2]
    assert content(table.read()) == [(1, "mine", 1, 4), (2, "other", 1, 5)]


def test_one_of_many_writers_makes_a_version(spark, tmp_path):
    made, refused = [], []

    def write(k):
        try:
            made.append((Commits(spark, str(tmp_path / "log")).put(1, {"by": k}), k))
        except Conflict:
            refused.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = Commits(spark, str(tmp_path / "log"))
    assert len(made) == 1 and len(refused) == 7 and log.latest() == 1 and log.read(1) == {"by": made[0][1]}
    assert [f for f in os.listdir(tmp_path / "log") if not f.startswith(".")] == ["000000000001.json"]


def images(spark, dataset_id, found):
    return spark.createDataFrame([(dataset_id, b, s) for b, s in found], "dataset_id string, batch_id string, company_stone_id string")


def test_activation(spark, tmp_path):
    reg = Registry(spark, str(tmp_path / "r"))
    with pytest.raises(LookupError):
        reg.images()
    reg.register(images(spark, "a", [("b1", "s1"), ("b2", "s1")]), "a")
    reg.register(images(spark, "b", [("b1", "s1"), ("b3", "s2")]), "b")
    reg.register(images(spark, "bad", [("b1", "s1"), ("b1", "s2")]), "bad")
    reg.register(images(spark, "no", [("b1", "s1")]), "no", blocked=True)
    reg.activate("a")
    for refused in ("bad", "no", "unknown"):
        with pytest.raises(ValueError):
            reg.activate(refused)
    assert {r.batch_id for r in reg.images().collect()} == {"b1", "b2"}
    reg.activate("b")
    assert {(r.dataset_id, r.is_active, r.validation_status) for r in reg.datasets().collect()} == {("a", False, "archived"), ("b", True, "validated"), ("bad", False, "pending"), ("no", False, "pending")}
    for act in (lambda: reg.delete("b"), lambda: reg.register(images(spark, "b", []), "b")):
        with pytest.raises(ValueError):
            act()
    reg.delete("a")
    assert not glob.glob(f"{tmp_path}/r/images/dataset_id=a") and reg.datasets().count() == 3


def test_racing_activations(spark, tmp_path):
    """Two start from the same registry: one is refused, and every version there has one active dataset."""
    reg = Registry(spark, str(tmp_path / "r"))
    for name in "abc":
        reg.register(images(spark, name, [("b1", name)]), name)
    reg.activate("c")
    seen, done, refused = reg.commits.latest(), [], []

    def activate(name):
        try:
            done.append((Registry(spark, str(tmp_path / "r")).activate(name, expected=seen), name))
        except Conflict:
            refused.append(name)

    threads = [threading.Thread(target=activate, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == len(refused) == 1 and done[0][0] == seen + 1
    active = [r.dataset_id for r in reg.datasets().filter("is_active").collect()]
    assert active == [done[0][1]] and all(reg.commits.read(v)["active"] in (None, "c", active[0]) for v in range(1, seen + 2))
    reg.activate(refused[0])
    assert [r.dataset_id for r in reg.datasets().filter("is_active").collect()] == refused
