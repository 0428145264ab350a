"""Similar items: veto, tiers, re-rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colors
from ..functions.scores import similarity

#: Tag -> how its tier compares anchor and candidate.
TIERS = ["pattern", "tone", "network", "stone_lightness", "vein_colour", "drama"]


def _anchor(anchor: dict, name: str, kind: str = "string") -> Column:
    return F.lit(anchor.get(name)).cast(kind)


def resolve(candidates: DataFrame, anchor: dict, *, key: str = "item", vector: str = "vec", suppressed: DataFrame | None = None, k: int = 10) -> DataFrame:
    """The ``k`` items most like an anchor: vetoed and suppressed ones go, seven tiers decide before similarity.

    ``anchor``: its item, retrieval_family, main_color, lightness_mean, tags and vec. An anchor
    without a vector has no similar items; one without a family skips the colour tier.
    """
    c = F.col
    if anchor.get("vec") is None:
        return candidates.limit(0).select(key).withColumns({"similarity": F.lit(0.0), "rank": F.lit(0)})
    df = candidates.filter(c(key) != anchor["item"])
    if suppressed is not None:
        df = df.join(suppressed.select(key), key, "left_anti")
    df = df.withColumn("similarity", F.round(similarity(c(vector), F.lit([float(x) for x in anchor["vec"]])), 6)).filter("similarity > 0")
    bucket, family = colors.veto_bucket(_anchor(anchor, "main_color")), _anchor(anchor, "retrieval_family")
    df = df.filter(~colors.bucket_veto(bucket, colors.veto_bucket(c("main_color"))) & ~colors.family_veto(family, c("retrieval_family")))
    tiers = {f"{t}_tier": colors.same_tier(_anchor(anchor, t), c(t)) for t in TIERS if t in df.columns}
    if anchor.get("retrieval_family") is not None:
        tiers = {"colour_tier": colors.family_tier(family, c("retrieval_family"), _anchor(anchor, "lightness_mean", "double"), c("lightness_mean"))} | tiers
    df = df.withColumns(tiers)
    return df.orderBy(*[c(t).asc() for t in tiers], c("similarity").desc(), c(key)).limit(k).select(key, "similarity", *tiers)


def vetoes(items: DataFrame, *, key: str = "item") -> DataFrame:
    """(a_colour, b_colour, vetoed) of all pairs of distinct colours: bounded by the colour vocabulary."""
    distinct = items.select(F.lower("main_color").alias("c")).filter("c is not null").distinct()
    a, b = distinct.withColumnRenamed("c", "a_colour"), distinct.withColumnRenamed("c", "b_colour")
    return a.join(b, F.col("a_colour") < F.col("b_colour")).withColumn("vetoed", colors.bucket_veto(colors.veto_bucket(F.col("a_colour")), colors.veto_bucket(F.col("b_colour"))))


def neighbours(votes: DataFrame, item) -> DataFrame:
    """Items voted unrelated to ``item``, whichever side it stood on."""
    bad = votes.filter("vote = -1")
    return bad.filter(F.col("a") == item).select(F.col("b").alias("item")).union(bad.filter(F.col("b") == item).select(F.col("a").alias("item"))).distinct()


def edges(votes: DataFrame) -> DataFrame:
    """Both directions of an undirected edge list."""
    return votes.select("a", "b").union(votes.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def chips(anchor: dict) -> Column:
    """Why a candidate is shown: the traits it shares with the anchor."""
    shared = [F.when(F.col(t) == _anchor(anchor, t), F.lit(f"same {t.replace('_', ' ')}")) for t in ("main_color", *TIERS[:2], "stone_lightness")]
    return F.array_compact(F.array(*shared))


def projection(df: DataFrame, anchor: dict, *, key: str = "item") -> DataFrame:
    """What a similar result shows: taxonomy, refinements, chips."""
    return df.select(key, F.struct("family", "colour", "pattern").alias("taxonomy"), F.struct("tone", "stone_lightness", F.round("busyness", 4).alias("busyness")).alias("refinement"), chips(anchor).alias("chips"))
