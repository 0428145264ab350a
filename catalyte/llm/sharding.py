"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points on a ring; a key starts at the first point clockwise
from its hash. A shard takes keys up to its capacity, and what does not fit continues
clockwise to the next shard with room. The set of free places that are left does not
depend on which key came first, so the walk can be done on *counts*: Spark counts the
keys of each ring cell, a loop over those (bounded by ``cells``, whatever the input)
lets the counts flow clockwise, and a broadcast join of the bounded outcome tells each
row its shard. No row but the cell counts reaches the driver.

With ``slack=0`` the capacities are the floor or the ceiling of the mean, so the counts
of any two shards differ by one at most (the law ``rows``). With ``slack>0`` shards may
be fuller than the mean by that share and fewer keys move when a shard is added.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, table, text_or_empty

CELL_BITS = 13


def ring(shards: int, vnodes: int, cell_bits: int = CELL_BITS) -> list[int]:
    """The shard that owns each ring cell: that of the first virtual node clockwise."""
    points = sorted(
        (int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") >> (64 - cell_bits), s, v)
        for s in range(shards)
        for v in range(vnodes)
    )
    at = [p[0] for p in points]
    return [points[bisect_left(at, c) % len(points)][1] for c in range(1 << cell_bits)]


def flow(counts: dict[int, int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Let the counts of the cells fill the shards clockwise.

    Returns parcels (cell, first rank, end rank, shard, first slot): the rows of ``cell``
    whose rank is in the half-open range go to ``shard``, from ``first slot`` on.
    """
    room = list(capacity)
    parcels: list[tuple[int, int, int, int, int]] = []
    cells = len(owners)
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in range(cells)]
    for cell, n in counts.items():
        if n:
            waiting[cell].append((cell, 0, n))

    def place(cell: int, queue: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        shard = owners[cell]
        rest = []
        for origin, lo, hi in queue:
            take = min(room[shard], hi - lo)
            if take:
                parcels.append((origin, lo, lo + take, shard, capacity[shard] - room[shard]))
                room[shard] -= take
            if lo + take < hi:
                rest.append((origin, lo + take, hi))
        return rest

    # First everything tries its own shard, then the overflow walks clockwise.
    for cell in range(cells):
        waiting[cell] = place(cell, waiting[cell])
    moving: list[tuple[int, int, int]] = []
    for step in range(2 * cells):
        cell = step % cells
        if moving:
            moving = place(cell, moving)
        if step < cells:
            moving += waiting[cell]
        elif not moving:
            break
    if moving:
        raise ValueError("the capacities do not hold all rows")
    return parcels


#: Each ring cell's rows are ranked in so many parts, so that a hot key's rows are not one task's.
PARTS = 64


def shard(df: DataFrame, shards: int, *, key: str = "doc_id", vnodes: int = 64, slack: float = 0.0, cell_bits: int = CELL_BITS, order: tuple[str, ...] = ()) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 within the shard) to every row of ``df``.

    Rows are placed by the hash of ``key``; a hot key's rows share a cell and are split over
    shards by the bound like any others. A cell is ranked in parts, dealt by the key and the
    columns ``order``, which also fix the order of rows with equal keys: only rows that are
    equal in all of these meet in one task. Null keys hash like a value of their own, repeated
    rows each get a slot, an empty table gives an empty result, texts may have any length.
    Existing columns ``shard`` and ``slot`` are replaced, as is any whose name starts with
    ``__ring_``.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot", *(c for c in df.columns if c.startswith("__ring_")))
    # null has a hash of its own as xxhash64 skips it and returns its seed
    keyed = df.withColumn("__ring_hash", F.xxhash64(F.lit("ring"), F.col(key)))
    keyed = keyed.withColumn("__ring_cell", F.shiftrightunsigned("__ring_hash", 64 - cell_bits).cast("int"))
    keyed = keyed.withColumn("__ring_part", F.pmod(F.xxhash64(F.lit("part"), F.col(key), *order), F.lit(PARTS)).cast("int"))
    # cells * PARTS rows at most, whatever the input; joined where the window has dealt the rows already
    sizes = materialize(keyed.groupBy("__ring_cell", "__ring_part").agg(F.count(F.lit(1)).alias("n")), "ring-parts")
    counts = {r["__ring_cell"]: r["n"] for r in sizes.groupBy("__ring_cell").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values())
    base, more = divmod(total, shards)
    capacity = [base + (s < more) for s in range(shards)] if not slack else [int(total / shards * (1 + slack)) + 1] * shards
    parcels = flow(counts, ring(shards, vnodes, cell_bits), capacity)
    # at most (cells + shards * vnodes * 2) rows, whatever the input
    plan = spark.createDataFrame(parcels, "__ring_at int, __ring_lo long, __ring_hi long, shard int, __ring_first long")
    before = F.sum("n").over(Window.partitionBy("__ring_cell").orderBy("__ring_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("__ring_cell").alias("__ring_c"), F.col("__ring_part").alias("__ring_p"), F.coalesce(before, F.lit(0)).alias("__ring_before"))
    in_part = Window.partitionBy("__ring_cell", "__ring_part").orderBy("__ring_hash", key, *order)
    ranked = keyed.withColumn("__ring_place", F.row_number().over(in_part).cast("long") - 1).join(
        starts, (F.col("__ring_cell") == F.col("__ring_c")) & (F.col("__ring_part") == F.col("__ring_p"))
    )
    ranked = ranked.withColumn("__ring_rank", F.col("__ring_before") + F.col("__ring_place"))
    out = ranked.join(
        F.broadcast(plan),
        (F.col("__ring_cell") == F.col("__ring_at")) & (F.col("__ring_rank") >= F.col("__ring_lo")) & (F.col("__ring_rank") < F.col("__ring_hi")),
    )
    return out.select(*df.columns, "shard", (F.col("__ring_first") + F.col("__ring_rank") - F.col("__ring_lo")).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards whose row counts are at most one apart (law ``rows``)."""
    text = text_or_empty()
    sized = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard(sized, 40, order=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op9_sharding": op9_sharding}
ORACLE_SQL: dict[str, str] = {}
