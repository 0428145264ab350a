"""Layered tags: union, resolution by field-specific precedence, pivot, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab

#: A later layer wins; pattern families let people beat the aggregate.
ORDER = {"ai": 1, "manual": 2, "aggregated": 3, "override": 4}
PATTERN_ORDER = {"ai": 1, "aggregated": 2, "manual": 3, "override": 4}


def union_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """Layers (entity_id, field, value, confidence) as one table with their name."""
    return reduce(DataFrame.unionByName, [df.select("entity_id", "field", "value", "confidence", F.lit(name).alias("layer")) for name, df in layers.items()])


def _priority(field: Column, layer: Column) -> Column:
    def of(order: dict[str, int]) -> Column:
        out = F.when(F.lit(False), 0)
        for name, rank in order.items():
            out = out.when(layer == name, rank)
        return out

    return F.when(field == "pattern_family", of(PATTERN_ORDER)).otherwise(of(ORDER))


def resolve(tags: DataFrame) -> DataFrame:
    """(entity_id, field, value, confidence, source): the non-blank value of the highest layer.

    One aggregation with a map-side part: no sort and no window. Equal layers resolve to the
    larger (value, confidence).
    """
    usable = tags.filter(F.nullif(F.trim("value"), F.lit("")).isNotNull())
    best = F.max_by(F.struct("value", "confidence", "layer"), F.struct(_priority(F.col("field"), F.col("layer")), "value", F.coalesce("confidence", F.lit(0.0))))
    return usable.groupBy("entity_id", "field").agg(best.alias("b")).select("entity_id", "field", F.col("b.value").alias("value"), F.col("b.confidence").alias("confidence"), F.col("b.layer").alias("source"))


def pivot(resolved: DataFrame, fields: list[str]) -> DataFrame:
    """One row an entity with ``field`` and ``field_confidence`` columns: an aggregation, no join per tag."""
    wanted = resolved.filter(F.col("field").isin(fields))
    cols = [F.max(F.when(F.col("field") == f, F.col(c))).alias(f + suffix) for f in fields for c, suffix in (("value", ""), ("confidence", "_confidence"))]
    return wanted.groupBy("entity_id").agg(*cols)


def display_tags(resolved: DataFrame) -> DataFrame:
    """One map an entity: field -> struct(value, confidence, source); debug fields are left out."""
    entry = F.struct("field", F.struct("value", "confidence", "source"))
    tags = F.map_from_entries(F.array_sort(F.collect_list(entry)))
    return resolved.filter(~F.col("field").like(r"%\_debug")).groupBy("entity_id").agg(tags.alias("tags"))


def missing_tag(entities: DataFrame, tags: DataFrame, field: str) -> DataFrame:
    return entities.join(tags.filter(F.col("field") == field), "entity_id", "left_anti")


def has_a_not_b(tags: DataFrame, a: str, b: str) -> DataFrame:
    hits = tags.filter(F.col("field").isin(a, b)).groupBy("entity_id").agg(F.max(F.col("field") == a).alias("a"), F.max(F.col("field") == b).alias("b"))
    return hits.filter("a and not b").select("entity_id")


def census(tags: DataFrame) -> DataFrame:
    """Rows and entities per tag."""
    return tags.groupBy("field").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_id").alias("n_entities"))


def census_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tags whose census changed."""
    a, b = before.select("field", F.col("n_rows").alias("before_rows")), after.select("field", F.col("n_rows").alias("after_rows"))
    return a.join(b, "field", "full_outer").filter(~F.col("before_rows").eqNullSafe(F.col("after_rows")))


def coverage(cohort: DataFrame, tags: DataFrame, field: str, gate: float = 0.95) -> DataFrame:
    """How much of a cohort has a tag, and whether that passes the gate."""
    have = tags.filter((F.col("field") == field) & (F.trim("value") != "")).select("entity_id", F.lit(1).alias("has")).distinct()
    n = cohort.join(have, "entity_id", "left").agg(F.count(F.lit(1)).alias("n_cohort"), F.count("has").alias("n_with"))
    share = F.col("n_with") / F.nullif(F.col("n_cohort"), F.lit(0))
    return n.select("n_cohort", "n_with", F.round(share, 6).alias("share"), F.coalesce(share >= gate, F.lit(False)).alias("passed"))


def out_of_vocabulary(tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tags whose field has a vocabulary (field, value) that lacks their value."""
    known = vocabulary.select("field").distinct()
    return tags.join(known, "field", "left_semi").join(vocabulary, ["field", "value"], "left_anti")


def suppress(items: DataFrame, cohort: DataFrame, *, threshold: float = 0.40, fields: tuple[str, ...] = ("main_color", "bg_color", "base_color")) -> DataFrame:
    """Blank low-confidence colour tags of the entities in a cohort; an empty cohort changes nothing."""
    flagged = items.join(cohort.select("entity_id", F.lit(True).alias("__in")).distinct(), "entity_id", "left")
    low = [(f, F.when(F.col("__in") & (F.col(f + "_confidence") < threshold), None).otherwise(F.col(f))) for f in fields if f in items.columns]
    return flagged.withColumns(dict(low)).drop("__in")


def tag_rows(fingerprints: DataFrame, fields: list[str]) -> DataFrame:
    """Unpivot a fingerprint to tag rows; design becomes a pattern family."""
    pairs = ", ".join(f"'{f}', cast({f} as string), cast({f}_conf as double)" for f in fields)
    rows = fingerprints.select("entity_id", F.expr(f"stack({len(fields)}, {pairs}) as (field, value, confidence)"))
    mapped = F.when(F.col("field") == "design", F.when(F.col("value") == "plain", "uniform").when(F.col("value") == "veiny", "veined").when(F.col("value") == "spotty", "breccia").otherwise(F.col("value"))).otherwise(F.col("value"))
    return rows.withColumns({"value": mapped, "field": F.when(F.col("field") == "design", "pattern_family").otherwise(F.col("field"))}).filter("value is not null")


def vocabulary(spark) -> DataFrame:
    """The tag schema's closed vocabularies."""
    rows = [("layer", x) for x in vocab.LAYERS] + [("tone", x) for x in vocab.TONE_SYNONYMS] + [("base_color", x) for x in vocab.COLOUR_WORDS]
    return spark.createDataFrame(rows, "field string, value string")
