"""Quality-weighted votes over an entity's images, and the fingerprint made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab


def vote(df: DataFrame, entity: str, label: str, confidence: str, weight: str, seq: str) -> DataFrame:
    """(entity, label, confidence): the label with the largest sum of confidence times weight; first seen wins ties.

    The confidence is the winner's share, at most .99. Sums are rounded so that the order of
    adding does not decide.
    """
    per = df.filter(F.col(label).isNotNull()).groupBy(entity, label).agg(F.round(F.sum(F.col(confidence) * F.col(weight)), 6).alias("s"), F.min(seq).alias("seen"))
    best = per.groupBy(entity).agg(F.max_by(label, F.struct("s", -F.col("seen"))).alias("label"), F.max("s").alias("top"), F.sum("s").alias("total"))
    return best.select(entity, "label", F.round(F.least(F.col("top") / (F.col("total") + vocab.VOTE["eps"]), F.lit(vocab.VOTE["cap"])), 6).alias("confidence"))


def vote_many(df: DataFrame, entity: str, labels: str, confidence: str, weight: str) -> DataFrame:
    """(entity, labels, confidence): up to five labels within .3 of the best score."""
    rows = df.select(entity, F.explode(labels).alias("label"), (F.col(confidence) * F.col(weight)).alias("x")).filter("label is not null")
    per = rows.groupBy(entity, "label").agg(F.round(F.sum("x"), 6).alias("s"))
    own = Window.partitionBy(entity)
    ranked = per.withColumns({"top": F.max("s").over(own), "total": F.sum("s").over(own), "k": F.row_number().over(own.orderBy(F.col("s").desc(), "label"))})
    kept = ranked.filter((F.col("s") >= vocab.VOTE["keep"] * F.col("top")) & (F.col("k") <= vocab.VOTE["most"]))
    out = kept.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("k", "label"))).alias("r"), F.sum("s").alias("won"), F.max("total").alias("total"))
    share = F.col("won") / (F.size("r") * (F.col("total") + vocab.VOTE["eps"]))
    return out.select(entity, F.array_join(F.transform("r", lambda x: x["label"]), "|").alias("labels"), F.round(F.least(share, F.lit(vocab.VOTE["cap"])), 6).alias("confidence"))


def fingerprint(design: DataFrame, base: DataFrame, tone: DataFrame, veins: DataFrame, spots: DataFrame, colours: DataFrame, entity: str) -> DataFrame:
    """One row an entity: vein and spot fields only for such designs, the colour list only for exotic ones."""
    out = design.select(entity, F.col("label").alias("design"), F.col("confidence").alias("design_conf"))
    for df, name in ((base, "base_color"), (tone, "tonality")):
        out = out.join(df.select(entity, F.col("label").alias(name), F.col("confidence").alias(name + "_conf")), entity, "left")
    for df, name, gate in ((veins, "vein", "veiny"), (spots, "spot", "spotty")):
        own = df.select(entity, F.col("label").alias("__l"))
        out = out.join(own, entity, "left").withColumn(name, F.when(F.col("design") == gate, F.col("__l"))).drop("__l")
    own = colours.select(entity, F.col("labels").alias("__l"))
    return out.join(own, entity, "left").withColumn("colors", F.when(F.col("design") == "exotic", F.col("__l"))).drop("__l")


def representative(df: DataFrame, entity: str, image: str, weight: str, exposure: str, tonality: str, coverage: str, seq: str) -> DataFrame:
    """(entity, rep, variation, clarity): the best image, the first of another tone, the clearest other one."""
    score = F.round(0.7 * F.col(weight) + 0.3 * F.col(exposure), 6)
    best = df.groupBy(entity).agg(F.max_by(F.struct(image, tonality), F.struct(score, -F.col(seq))).alias("b")).select(entity, F.col(f"b.{image}").alias("rep"), F.col(f"b.{tonality}").alias("__t"))
    rest = df.join(best, entity)
    other = F.when(F.col(tonality) != F.col("__t"), F.struct(F.col(seq).alias("s"), F.col(image).alias("i")))
    clear = F.when(F.col(image) != F.col("rep"), F.struct(F.round(coverage, 6).alias("c"), (-F.col(seq)).alias("s"), F.col(image).alias("i")))
    out = rest.groupBy(entity).agg(F.max("rep").alias("rep"), F.min(other).alias("v"), F.max(clear).alias("c"))
    return out.select(entity, "rep", F.col("v.i").alias("variation"), F.col("c.i").alias("clarity"))


def moments(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """Mean and population deviation per column; 0 where there is nothing or one value."""
    cols = [e for c in columns for e in (F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"{c}_mean"), F.round(F.coalesce(F.stddev_pop(c), F.lit(0.0)), 6).alias(f"{c}_std"))]
    return df.groupBy(entity).agg(*cols)


def weighted_mean(df: DataFrame, entity: str, value: str, weight: str) -> DataFrame:
    """Weighted mean over positive weights, one decimal."""
    w = F.when(F.col(weight) > 0, F.col(weight))
    return df.groupBy(entity).agg(F.round(F.round(F.sum(w * F.col(value)) / F.sum(w), 6), 1).alias("mean"))


def cluster_shares(df: DataFrame, entity: str, cluster: str, weight: str, cell: str) -> DataFrame:
    """Share of weight and number of distinct cells of each cluster."""
    per = df.groupBy(entity, cluster).agg(F.sum(weight).alias("w"), F.countDistinct(cell).alias("n_cells"))
    return per.select(entity, cluster, F.round(F.col("w") / F.sum("w").over(Window.partitionBy(entity)), 6).alias("share"), "n_cells")


def top_margin(df: DataFrame, entity: str, label: str, score: str) -> DataFrame:
    """Winner, runner-up and the margin between them."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(label).alias("l"))))
    out = df.groupBy(entity).agg(pairs.alias("p"))
    first, second = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return out.select(entity, first["l"].alias("winner"), second["l"].alias("runner_up"), F.round(-first["s"] + F.coalesce(second["s"], F.lit(0.0)), 6).alias("margin"))
