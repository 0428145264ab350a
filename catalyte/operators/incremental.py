"""Hash-based change detection between two versions, and the work that follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = {"NEW": ["cv", "embeddings", "aggregation"], "CHANGED_IMAGE": ["cv", "embeddings", "aggregation"], "CHANGED_METADATA": ["aggregation"], "UNCHANGED": []}


def signatures(df: DataFrame, entity: str, image: list[str], metadata: list[str], seq: list[str]) -> DataFrame:
    """(entity, image_hash, metadata_hash, n_images): the set of images and the metadata of the first row.

    The set's hash is the first 16 digits of the md5 of its sorted members as compact JSON,
    so it compares with stored ones (of ASCII values); an item's images meet in one row for it.
    Both hashes come from one aggregate.
    """
    members = F.array(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in image])
    first = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in metadata])
    per = df.groupBy(entity).agg(F.array_sort(F.collect_list(members)).alias("__s"), F.min_by(first, F.struct(*seq)).alias("__m"), F.count(F.lit(1)).alias("n_images"))

    def short(c):
        return F.substring(F.md5(c.cast("binary")), 1, 16)

    return per.select(entity, short(F.to_json("__s")).alias("image_hash"), short(F.col("__m")).alias("metadata_hash"), "n_images")


def classify(incoming: DataFrame, baseline: DataFrame, entity: str) -> DataFrame:
    """(entity, change_class) of each incoming signature against the baseline's."""
    old = baseline.select(entity, F.col("image_hash").alias("__i"), F.col("metadata_hash").alias("__m"))
    change = F.when(F.col("__i").isNull(), "NEW").when(F.col("image_hash") != F.col("__i"), "CHANGED_IMAGE").when(F.col("metadata_hash") != F.col("__m"), "CHANGED_METADATA").otherwise("UNCHANGED")
    return incoming.join(old, entity, "left").select(entity, "n_images", change.alias("change_class"))


def summary(classes: DataFrame) -> DataFrame:
    return classes.groupBy("change_class").agg(F.count(F.lit(1)).alias("n_entities"), F.sum("n_images").alias("n_images"))


def work(classes: DataFrame, stage: str, *, full: bool = False) -> DataFrame:
    """Entities that need a stage; ``full`` treats everything known as changed."""
    change = F.when(F.lit(full) & F.col("change_class").isin("UNCHANGED", "CHANGED_METADATA"), "CHANGED_IMAGE").otherwise(F.col("change_class"))
    return classes.filter(change.isin([c for c, stages in STAGES.items() if stage in stages]))


def not_done(work_list: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return work_list.join(ledger.select(*keys).distinct(), keys, "left_anti")


def drop_stale(vectors: DataFrame, classes: DataFrame, entity: str) -> DataFrame:
    """Cached vectors without those of entities whose images changed."""
    return vectors.join(classes.filter(F.col("change_class").isin("NEW", "CHANGED_IMAGE")).select(entity), entity, "left_anti")
