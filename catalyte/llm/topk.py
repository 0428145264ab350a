"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are put in an order that keeps like ones together (nearest of a few sampled pivots,
distance, id) and cut into blocks of consecutive ones. A block has a forward index (its
vectors) and the largest and smallest value of each term (dimension). For a query the sum
over terms of weight times the fitting extreme bounds every score in the block. Blocks are
scored in falling order of that bound until it is below the k-th best score so far; equal
bounds are still scored, as ties go to the smaller id. Nothing is approximate.

Queries are ordered alike and cut into groups. Only extremes meet every group at first:
a forward index travels to a group only if its block's bound reaches the k-th score that
some query of the group is sure of. Those scores come from a bounded sample, then from
waves of blocks, each ``GROWTH`` times as large as all before it, so that the candidates
that tasks hand on stay about ``k * GROWTH`` a query and wave whatever the table's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, bounded_batches, table

NONE, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
GROWTH = 32


def quantized(vectors: DataFrame, key: str, column: str, scale: int) -> DataFrame:
    """(id, vec): floor(scale * x) of each component, which must be a long; rows that take no part are left out."""
    x = F.col(column)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    too_large = F.raise_error(F.lit("a component times the scale is beyond 64 bits")).cast("long")
    whole = F.transform(x, lambda c: F.when(F.abs(c.cast("double") * scale) < float(1 << 63), F.floor(c.cast("double") * scale)).otherwise(too_large))
    usable = x.isNotNull() & F.col(key).isNotNull() & ~F.coalesce(bad, F.lit(False))
    return vectors.filter(usable).select(F.col(key).cast("long").alias("id"), whole.alias("vec"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list<long> column as rows of ``dim``; shorter vectors end in zeros."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    if (np.diff(ends) == dim).all():
        return flat[ends[0] : ends[-1]].reshape(-1, dim)
    out = np.zeros((len(column), dim), np.int64)
    for k, (s, e) in enumerate(zip(ends[:-1], ends[1:])):
        out[k, : e - s] = flat[s:e]
    return out


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b of integers: in doubles or longs where no sum can be too large for them, else
    in Python's integers. Scores beyond a long become ``MOST`` or ``NONE + 1``."""
    most = _largest(a) * _largest(b) * a.shape[-1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64)
    whole = a.astype(object) @ b.astype(object)
    return np.minimum(np.maximum(whole, int(NONE) + 1), int(MOST)).astype(np.int64)


def bounds(q: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """For each query and block at least the largest score in the block."""
    return product(np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], 1), np.concatenate([hi, lo], 1).T)


def search_blocks(qid, q, ids, forward, hi, lo, k: int, floor):
    """Top k of each query among some blocks.

    qid, q: ids and rows of the queries; ids (blocks, size; -1 pads), forward (blocks, size, dim),
    hi and lo (blocks, dim); floor: a lower bound of each query's k-th score. Returns scores and
    ids, (queries, k), with ``NONE`` where there is none, and the number of blocks scored.
    """
    bound = bounds(q, hi, lo)
    order = np.argsort(-bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, 1)
    score, best = np.full((len(q), k), NONE), np.full((len(q), k), MOST)
    kth, live, done = floor.copy(), np.arange(len(q)), 0
    for turn in range(bound.shape[1]):
        live = live[bound[live, turn] >= kth[live]]
        if not len(live):
            break
        done += len(live)
        at = order[live, turn]
        got = product(forward[at], q[live][:, :, None])[:, :, 0]
        own = ids[at]
        got[(own == qid[live][:, None]) | (own < 0)] = NONE
        better = (got >= np.maximum(kth[live], NONE + 1)[:, None]).any(1)
        rows = live[better]
        if not len(rows):
            continue
        s, i = np.concatenate([score[rows], got[better]], 1), np.concatenate([best[rows], own[better]], 1)
        top = np.lexsort((i, -np.maximum(s, NONE + 1)), axis=-1)[:, :k]
        score[rows], best[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        kth[rows] = np.maximum(kth[rows], score[rows, -1])
    return score, best, done


def top_k(
    vectors: DataFrame,
    is_query,
    *,
    k: int = 10,
    key: str = "vec_id",
    column: str = "embedding",
    scale: int = 1024,
    block: int = 64,
    segment: int = 131_072,
    group: int = 32_768,
    sample: int = 2048,
    pivots: int = 64,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all rows but the query's own, for the rows where
    ``is_query`` (a condition on ``id``) holds.

    Null vectors, vectors with null or non-finite components and null ids take no part.
    Missing trailing components count as zero. Every row is a candidate: repeats of a row and
    several vectors of one id stand in a ranking as often as they occur. Query rows of one id
    share one ranking, in which each of them scores every candidate; none of them is compared with another. Ties go
    to the smaller id. Components and scores are exact; it is an error if one that counts is
    beyond 64 bits. Other columns are ignored, whatever their names; no rows give no rows.
    ``sample`` rows (the first by hash of the id) are all that comes to the driver.
    """
    spark = vectors.sparkSession
    tables = Scratch(spark, "topk")
    rows = tables.write(quantized(vectors, key, column, scale), "vectors")
    n, dim, least, most = rows.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.min(F.array_min("vec")), F.max(F.array_max("vec"))).first()
    dim = max(dim or 0, 1)
    kind = "<i4" if max(most or 0, -(least or 0)) < 1 << 31 else "<i8"
    seeds = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(sample).collect()
    seed_ids = np.array([r["id"] for r in seeds], np.int64)
    seed = np.zeros((len(seeds), dim), np.int64)
    for s, r in enumerate(seeds):
        seed[s, : len(r["vec"])] = r["vec"]

    def assign(batches):
        centre = seed[:pivots].astype(np.float64)
        for batch in batches:
            x = _matrix(batch.column(1), dim).astype(np.float64)
            far = (centre * centre).sum(1)[None, :] - 2 * (x @ centre.T)
            near = far.argmin(1)
            away = far[np.arange(len(x)), near] + (x * x).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(away)], names=["id", "vec", "near", "away"])

    def cut(batches):
        part, made = TaskContext.get().partitionId(), 0

        def emit(ids, x):
            nonlocal made
            made += 1
            return [(part << 32) + made, x.astype(kind).tobytes(), ids.astype("<i8").tobytes(), x.max(0).astype(kind).tobytes(), x.min(0).astype(kind).tobytes()]

        ids, x = np.zeros(0, np.int64), np.zeros((0, dim), np.int64)
        for batch in batches:
            ids, x = np.concatenate([ids, batch.column(0).to_numpy()]), np.concatenate([x, _matrix(batch.column(1), dim)])
            full = len(ids) // block * block
            made_now = [emit(ids[s : s + block], x[s : s + block]) for s in range(0, full, block)]
            ids, x = ids[full:], x[full:]
            if made_now:
                yield _blocks_batch(made_now)
        if len(ids):
            yield _blocks_batch([emit(ids, x)])

    def grouped(batches):
        """Number the groups and give each query its k-th best score in the sample."""
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            floor = np.full(len(ids), NONE + 1)
            if len(seed_ids) > k:
                for s in range(0, len(ids), 256):
                    sure = product(x[s : s + 256], seed.T)
                    sure[ids[s : s + 256, None] == seed_ids[None, :]] = NONE + 1
                    floor[s : s + 256] = np.partition(sure, -k, axis=1)[:, -k]
            number = (part << 32) + (seen + np.arange(len(ids))) // group
            seen += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(number), pa.array(floor)], names=["id", "vec", "group", "floor"])

    def ordered(some: DataFrame) -> DataFrame:
        placed = some.mapInArrow(assign, "id long, vec array<long>, near int, away double")
        return placed.repartitionByRange("near", "away", "id").sortWithinPartitions("near", "away", "id").select("id", "vec")

    blocks = tables.write(ordered(rows).mapInArrow(cut, "block long, forward binary, ids binary, hi binary, lo binary"), "blocks")
    asked = tables.write(ordered(rows.filter(is_query)).mapInArrow(grouped, "id long, vec array<long>, group long, floor long"), "asked-0")
    tables.drop("vectors")
    groups = [r["group"] for r in asked.select("group").distinct().collect()]  # one row for ``group`` queries

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        """The blocks of a segment that some query of a group must see."""
        seen = np.zeros(left.num_rows, bool)
        if left.num_rows and right.num_rows:
            hi, lo = (np.frombuffer(b"".join(left.column(c).to_pylist()), kind).reshape(-1, dim) for c in ("hi", "lo"))
            right = right.combine_chunks()
            q, floor = _matrix(right.column("vec").chunk(0), dim), right.column("floor").to_numpy()
            for s in range(0, len(q), 256):
                seen |= (bounds(q[s : s + 256], hi, lo) >= floor[s : s + 256, None]).any(0)
        return left.select(["block", "group"]).filter(pa.array(seen))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        if left.num_rows and right.num_rows:
            right = right.combine_chunks()
            qid, floor = right.column("id").to_numpy(), right.column("floor").to_numpy()
            q = _matrix(right.column("vec").chunk(0), dim)
            count = left.num_rows
            ids, forward = np.full((count, block), -1, np.int64), np.zeros((count, block, dim), kind)
            for b, (f, i) in enumerate(zip(left.column("forward").to_pylist(), left.column("ids").to_pylist())):
                own = np.frombuffer(i, "<i8")
                ids[b, : len(own)], forward[b, : len(own)] = own, np.frombuffer(f, kind).reshape(-1, dim)
            hi, lo = (np.frombuffer(b"".join(left.column(c).to_pylist()), kind).reshape(count, dim) for c in ("hi", "lo"))
            for s in range(0, len(q), 256):
                mine, own, sure = q[s : s + 256], qid[s : s + 256], floor[s : s + 256]
                score, best, _ = search_blocks(own, mine, ids, forward, hi, lo, k, sure)
                row, col = np.nonzero((score > NONE) & (score >= sure[:, None]))
                out.append(np.stack([own[row], best[row, col], score[row, col]]))
        cols = np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), cols)})

    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    waves = 1
    while n > sample * GROWTH**waves:
        waves += 1
    best, place = None, F.pmod(F.xxhash64("block"), F.lit(GROWTH ** (waves - 1)))
    for wave in range(waves):
        lo, hi = (0 if not wave else GROWTH ** (wave - 1)), GROWTH**wave  # shares of GROWTH ** (waves - 1)
        now = blocks.filter((place >= lo) & (place < hi))
        vectors_now = n * (hi - lo) // GROWTH ** (waves - 1) + 1
        parts = max(-(-vectors_now // segment), min(2 * spark.sparkContext.defaultParallelism, -(-vectors_now // 8192)))
        held = F.array(*(F.lit(g) for g in groups)).cast("array<long>")
        part = F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part")
        tiles = now.select("block", "hi", "lo", part, F.explode(held).alias("group"))
        everywhere = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        sent = tables.write(tiles.groupBy("group", "part").cogroup(everywhere.groupBy("group", "part")).applyInArrow(route, "block long, group long"), f"sent-{wave}")
        tiles = sent.join(blocks, "block").withColumn("part", part)
        found = tiles.groupBy("group", "part").cogroup(everywhere.groupBy("group", "part")).applyInArrow(search, "query_id long, vec_id long, score long")
        found = found if best is None else found.union(best)
        best = tables.write(found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).drop("rank"), f"best-{wave}")
        if wave + 1 < waves:
            sure = best.groupBy(F.col("query_id").alias("__id")).agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("m")).filter(F.col("m") == k)
            raised = asked.join(sure, F.col("id") == F.col("__id"), "left")
            asked = tables.write(raised.select("id", "vec", "group", F.greatest("floor", "kth").alias("floor")), f"asked-{wave + 1}")
    tables.drop(*(name for name in list(tables.paths) if name != f"best-{waves - 1}"))
    beyond = F.raise_error(F.lit("a score is beyond 64 bits")).cast("long")
    scored = best.withColumn("score", F.when((F.col("score") == int(MOST)) | (F.col("score") <= int(NONE) + 1), beyond).otherwise(F.col("score")))
    return scored.withColumn("rank", F.row_number().over(rank)).select("query_id", "rank", "vec_id", "score")


def _blocks_batch(rows: list[list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["block", "forward", "ids", "hi", "lo"])


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all vectors for every vector whose id is divisible by 100."""
    bounded_batches(spark)
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


QUERIES = {"op1_topk": op1_topk}
ORACLE_SQL = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """
}
