"""Connected components of a link table, by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

#: Nodes with more than 2 / HUBS of all link ends are hubs; there are at most HUBS of them, whatever the input.
HUBS = 2000


def _least(links: DataFrame, ends: int, tables: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(u, m) with the smallest neighbour of every node, apart for hubs: those fit into a broadcast."""
    least = tables.write(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), name)
    crowded = F.col("n") > max(1, -(-2 * ends // HUBS))
    return least.filter(~crowded).drop("n"), least.filter(crowded).select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))


def _with_least(rows: DataFrame, calm: DataFrame, hubs: DataFrame) -> DataFrame:
    """Add ``m`` to ``rows`` (u, v): hubs by broadcast, all others by a join in which none has more than 2 / HUBS of the rows."""
    tagged = rows.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    return tagged.filter("hub is not null").select("u", "v", F.col("hub_m").alias("m")).union(tagged.filter("hub is null").select("u", "v").join(calm, "u").select("u", "v", "m"))


def _large_star(links: DataFrame, ends: int, tables: Scratch) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest of its neighbourhood."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _with_least(both.filter("v > u"), *_least(both, ends, tables, "large"))
    return found.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(links: DataFrame, ends: int, tables: Scratch) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    down = tables.write(down, "down")
    calm, hubs = _least(down, ends, tables, "small")
    moved = _with_least(down, calm, hubs).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(calm.select("u", F.col("m").alias("v"))).union(hubs.select("hub", "hub_m"))


def components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (u, v: longs); a component is named by its smallest node.

    The number of rounds grows with the logarithm of the links. Each round is written to the
    shared folder and the one before it deleted; minima are aggregated before they are
    shuffled, hubs are resolved apart (see ``_with_least``), and nothing but a count and a
    checksum comes to the driver. Links of a node to itself say nothing; nulls count as none.
    """
    tables = Scratch(links.sparkSession, "components")

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = tables.write(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "round-0")
    before = state(now)
    for k in range(1, most_rounds + 1):
        if not before[0]:
            break
        now = tables.write(_small_star(_large_star(now, before[0], tables), before[0], tables).distinct(), f"round-{k}")
        tables.drop(f"round-{k - 1}", "large", "down", "small")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    # every larger node now points at its component's smallest, which has no row of its own
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
