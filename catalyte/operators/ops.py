"""Operational analytics: queue states, run history, upserts, coverage, stale runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.jsontags import safe_segment
from ..functions.text import failure_reason, pair_key


def last_writer(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest version of each key: an upsert as a reduction over old and new rows."""
    carry = [c for c in rows.columns if c not in key]
    newest = F.max_by(F.struct(*carry), F.struct(*order))
    return rows.groupBy(*key).agg(newest.alias("__r")).select(*key, "__r.*")


def merge_votes(votes: DataFrame, a: str, b: str, vote: str, ts: str, seq: str) -> DataFrame:
    """One row an undirected pair: latest vote, first and last time; self-votes and other values are rejected."""
    ok = votes.filter((F.col(a) != F.col(b)) & F.col(vote).isin(1, -1)).withColumn("pair_key", pair_key(F.col(a).cast("string"), F.col(b).cast("string")))
    return ok.groupBy("pair_key").agg(F.max_by(vote, F.struct(ts, seq)).alias("vote"), F.min(ts).alias("voted_at"), F.max(ts).alias("updated_at"))


def insert_absent(ledger: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not in the ledger yet, one a key."""
    return rows.dropDuplicates(key).join(ledger.select(*key), key, "left_anti")


def queue_state(attempts: DataFrame, key: str, ok: Column, ts: str, *, retries: int = vocab.RETRIES) -> DataFrame:
    """(key, status, n_failed, last_at) from an append-only attempt log: DONE once it worked, FAILED after ``retries``."""
    per = attempts.groupBy(key).agg(F.max(ok.cast("int")).alias("done"), F.count_if(~ok).alias("n_failed"), F.max(ts).alias("last_at"))
    return per.select(key, F.when(F.col("done") == 1, "DONE").when(F.col("n_failed") >= retries, "FAILED").otherwise("PENDING").alias("status"), "n_failed", "last_at")


def reset(states: DataFrame, status: str, failed: str, *, only_failed: bool = False) -> DataFrame:
    """Back to PENDING with no failures counted: everything that is not done, or what failed only."""
    again = F.col(status) == "FAILED" if only_failed else F.col(status) != "DONE"
    return states.withColumns({status: F.when(again, "PENDING").otherwise(F.col(status)), failed: F.when(again, 0).otherwise(F.col(failed)).cast("long")})


def create_job(jobs: DataFrame, states: DataFrame, kind: str, job_id: int, status: str = "status") -> DataFrame:
    """The job table with a new running job of a kind; those of its kind that were queued or running are canceled.

    ``jobs``: job_id, kind, status, total, done. The new one counts the queue as it stands.
    """
    stopped = jobs.withColumn("status", F.when((F.col("kind") == kind) & F.col("status").isin("QUEUED", "RUNNING"), "CANCELED").otherwise(F.col("status")))
    counted = states.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(status) == "DONE").alias("done"))
    made = counted.select(F.lit(job_id).cast("long").alias("job_id"), F.lit(kind).alias("kind"), F.lit("RUNNING").alias("status"), "total", "done")
    return stopped.select("job_id", "kind", "status", "total", "done").union(made)


def finish_job(jobs: DataFrame, job_id: int, status: str = "DONE") -> DataFrame:
    return jobs.withColumn("status", F.when(F.col("job_id") == job_id, status).otherwise(F.col("status")))


def failure_reasons(df: DataFrame, error: str) -> DataFrame:
    return df.filter(F.col(error).isNotNull()).groupBy(failure_reason(F.col(error)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def job_progress(states: DataFrame, job: str, status: str) -> DataFrame:
    n = states.groupBy(job).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(status) == "DONE").alias("done"), F.count_if(F.col(status) == "FAILED").alias("failed"))
    return n.withColumn("pct", F.round(100.0 * F.col("done") / F.col("total"), 2))


def expired_leases(df: DataFrame, status: str, claimed_at: str, now: Column, minutes: int = vocab.LEASE_MINUTES) -> DataFrame:
    """Claims that ran out go back to the queue."""
    old = (F.col(status) == "PROCESSING") & (F.col(claimed_at) < now - F.make_dt_interval(mins=F.lit(minutes)))
    return df.withColumn(status, F.when(old, "PENDING").otherwise(F.col(status)))


def stale_runs(df: DataFrame, times: list[str], now: Column, seconds: int = vocab.STALE_SECONDS) -> DataFrame:
    """Runs whose last sign of life is older than ``seconds``."""
    last = F.greatest(F.lit(0), *[F.coalesce(F.unix_timestamp(c), F.lit(0)) for c in times])
    return df.withColumn("interrupted", F.unix_timestamp(now) - last > seconds)


def previous_run(runs: DataFrame, track: str, ts: str, run: str) -> DataFrame:
    """Each run with the one applied before it on its track."""
    return runs.withColumn("previous", F.lag(run).over(Window.partitionBy(track).orderBy(ts, run)))


def preview_state(runs: DataFrame, track: str, kind: str, ts: str, run: str) -> DataFrame:
    """Per track the latest preview and whether a later run was applied."""
    def newest(what: str) -> Column:
        return F.max(F.when(F.col(kind) == what, F.struct(ts, run)))

    per = runs.groupBy(track).agg(newest("preview").alias("p"), newest("applied").alias("a"))
    return per.filter("p is not null").select(track, F.col(f"p.{run}").alias("preview"), F.coalesce(F.col(f"a.{ts}") > F.col(f"p.{ts}"), F.lit(False)).alias("stale"))


def run_status(df: DataFrame) -> DataFrame:
    """A run's status from its metadata: aborted, rejected by the gate, rolled back, preview or applied."""
    status = F.when(F.col("aborted"), "aborted").when(~F.coalesce("gate_passed", F.lit(True)), "rejected").when(F.col("rolled_back"), "rolled_back").when(F.lower("mode").isin("preview", "dry_run") | F.col("run_id").rlike("(?i)preview|dry"), "preview").otherwise("applied")
    return df.withColumn("status", status)


def apply_rollbacks(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Runs that the rollback ledger names become rolled back."""
    gone = ledger.select("run_id").distinct().withColumn("__r", F.lit(1))
    return runs.join(gone, "run_id", "left").withColumn("status", F.when(F.col("__r") == 1, "rolled_back").otherwise(F.col("status"))).drop("__r")


def irreversible_reason(status: Column, snapshot: Column) -> Column:
    """Why a run cannot be rolled back; null if it can."""
    return F.when(status == "rolled_back", "already rolled back").when(status.isin("preview", "aborted", "rejected"), F.concat(F.lit("nothing was applied: "), status)).when(snapshot.isNull(), "no snapshot was kept")


#: Tracks that can be rolled back.
TRACKS = ["color", "pattern"]


def check_rollbacks(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Each request (track, run_id) with a code and a reason: 400 malformed, 404 no such run, 409 not applied or
    not reversible, 500 a restore that failed, else 200 with the run before, which is restored.

    ``runs``: track, run_id, ts, status, snapshot (null if none was kept), restored (false if reading it failed).
    """
    applied = previous_run(runs.filter("status = 'applied'"), "track", "ts", "run_id").select(F.col("track").alias("__pt"), F.col("run_id").alias("__pr"), F.col("previous").alias("restored_to"))
    known = runs.select(F.col("track").alias("__t"), F.col("run_id").alias("__r"), "status", "snapshot", "restored")
    found = requests.select("track", "run_id").join(known, (F.col("track") == F.col("__t")) & (F.col("run_id") == F.col("__r")), "left")
    found = found.join(applied, (F.col("track") == F.col("__pt")) & (F.col("run_id") == F.col("__pr")), "left")
    why = irreversible_reason(F.col("status"), F.col("snapshot"))
    code = (
        F.when(~F.coalesce(F.col("track").isin(TRACKS), F.lit(False)) | ~safe_segment(F.col("run_id")), 400).when(F.col("__r").isNull(), 404)
        .when(why.isNotNull(), 409).when(~F.coalesce("restored", F.lit(True)), 500).otherwise(200)
    )
    return found.select("track", "run_id", code.alias("code"), F.when(code == 409, why).alias("reason"), F.when(code == 200, F.col("restored_to")).alias("restored_to"))


def corrections_on(log: DataFrame, session: str, ts: str, day) -> DataFrame:
    """Corrections per session on one day."""
    return log.filter(F.to_date(ts) == F.to_date(F.lit(day))).groupBy(session).agg(F.count(F.lit(1)).alias("n"))


def assets(df: DataFrame, group: str, asset: str) -> DataFrame:
    """The sorted distinct assets of each group, as one text."""
    return df.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(F.col(asset).cast("string"))), ",").alias("assets"))


def dataset_listing(datasets: DataFrame, summary: str, schema: str) -> DataFrame:
    """Dataset rows with their JSON summary unpacked; a malformed summary gives nulls."""
    return datasets.withColumn("__s", F.from_json(summary, schema)).select(*datasets.columns, "__s.*")
