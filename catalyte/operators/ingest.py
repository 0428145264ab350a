"""Ingest: contract checks, first-wins dedupe, reports, continuity between versions."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab


def blank(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(col.cast("string")), F.lit("")) == ""


def header_errors(header: list[str], mandatory: list[str] | None = None) -> list[str]:
    """Missing, repeated and suspicious columns of a CSV header."""
    mandatory = mandatory or vocab.MANDATORY
    low = [h.strip().lower() for h in header]
    errors = [f"missing: {m}" for m in mandatory if m not in low]
    errors += [f"repeated: {h}" for h, n in Counter(low).items() if n > 1]
    errors += [f"suspicious: {h}" for h in low if "." in h and h.rsplit(".", 1)[0] in low and h.rsplit(".", 1)[1].isdigit()]
    return errors


def row_contract(df: DataFrame, mandatory: list[str]) -> DataFrame:
    """(field, n_errors): blank mandatory cells per field, in one pass."""
    counts = df.agg(*[F.count(F.when(blank(f), 1)).alias(f) for f in mandatory])
    pairs = ", ".join(f"'{f}', `{f}`" for f in mandatory)
    return counts.select(F.expr(f"stack({len(mandatory)}, {pairs}) as (field, n_errors)"))


def row_errors(df: DataFrame, mandatory: list[str], seq: str, most: int = 10) -> DataFrame:
    """The first offending rows; row_index counts the header and starts at 1."""
    bad = F.array_compact(F.array(*[F.when(blank(f), F.lit(f)) for f in mandatory]))
    return df.withColumn("fields", bad).filter(F.size("fields") > 0).orderBy(seq).limit(most).select((F.col(seq) + 2).alias("row_index"), "fields")


def bad_urls(df: DataFrame, url: str, pattern: str = "^https?://") -> DataFrame:
    """Rows whose URL does not match ``pattern``: start with http:// or https:// (a warning)."""
    return df.filter(~F.coalesce(F.col(url).rlike(pattern), F.lit(False)))


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in ``order`` (a total order).

    ``min_by`` would aggregate on the map side, but the row number keeps whole rows of any
    type; Spark prunes it per partition before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def latest(df: DataFrame, key: str, seq: str, carry: list[str]) -> DataFrame:
    """The newest row of each entity, by aggregation with a map-side part."""
    return df.groupBy(key).agg(F.max_by(F.struct(seq, *carry), F.struct(seq, *carry)).alias("__r")).select(key, "__r.*")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """(n_keys, n_extra): keys that repeat and the rows beyond the first of each."""
    twice = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_extra"))


def identity_collisions(df: DataFrame, entity: str, name: str) -> DataFrame:
    """Entities with more than one name; the first three names."""
    distinct = df.select(entity, F.lower(F.trim(name)).alias("__n")).filter("__n <> ''").distinct()
    many = distinct.groupBy(entity).agg(F.count(F.lit(1)).alias("n_names")).filter("n_names > 1")
    few = distinct.withColumn("__k", F.row_number().over(Window.partitionBy(entity).orderBy("__n"))).filter("__k <= 3")
    named = few.groupBy(entity).agg(F.array_join(F.array_sort(F.collect_list("__n")), "|").alias("first_names"))
    return many.join(named, entity)


def collisions(df: DataFrame, group: str, member: str) -> DataFrame:
    """Groups with more than one member: the guard before a version is activated."""
    return df.groupBy(group).agg(F.countDistinct(member).alias("n_members")).filter("n_members > 1")


def distinct_counts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exact distinct non-blank values per column, as one row per column.

    One column at a time, so that each is a plain two-step aggregation instead of an
    expansion of every row.
    """
    parts = [df.select(F.col(c).cast("string").alias("v")).filter(F.trim("v") != "").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, c in columns.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def vendor_report(df: DataFrame, vendor: str, batch: str, entity: str, name: str) -> DataFrame:
    """Batches with a single entity and a single name, and vendor names that look like item names."""
    per_batch = df.groupBy(batch).agg(F.countDistinct(entity).alias("e"), F.countDistinct(name).alias("n"))
    shares = per_batch.agg(F.count(F.lit(1)).alias("n_batches"), F.round(100 * F.avg((F.col("e") == 1).cast("double")), 4).alias("pct_single_entity"), F.round(100 * F.avg((F.col("n") == 1).cast("double")), 4).alias("pct_single_name"))
    same = df.agg(F.count(F.when(F.lower(vendor) == F.lower(name), 1)).alias("n_polluted"), F.countDistinct(vendor).alias("n_vendors"))
    return shares.crossJoin(F.broadcast(same))  # one row each


def top_groups(df: DataFrame, column: str, most: int) -> DataFrame:
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.col("n").desc(), column).limit(most)


def continuity(before: DataFrame, after: DataFrame, columns: dict[str, tuple[str, bool]]) -> DataFrame:
    """Per kind of id: rows in both, gone and new, with percentages and warnings.

    ``columns``: kind -> (column, warn at the first gone). One full outer join a kind.
    """
    out = None
    for kind, (column, strict) in columns.items():
        a = before.select(F.col(column).cast("string").alias("id")).filter("trim(id) <> ''").distinct().withColumn("a", F.lit(1))
        b = after.select(F.col(column).cast("string").alias("id")).filter("trim(id) <> ''").distinct().withColumn("b", F.lit(1))
        n = a.join(b, "id", "full_outer").agg(F.count("a").alias("n_before"), F.count("b").alias("n_after"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n_both"))
        old, new = F.nullif(F.col("n_before"), F.lit(0)), F.nullif(F.col("n_after"), F.lit(0))
        n = n.select(
            F.lit(kind).alias("kind"), "n_before", "n_after", "n_both",
            (F.col("n_before") - F.col("n_both")).alias("n_gone"), (F.col("n_after") - F.col("n_both")).alias("n_new"),
            F.round(100 * (F.col("n_before") - F.col("n_both")) / old, 4).alias("pct_gone"), F.round(100 * (F.col("n_after") - F.col("n_both")) / new, 4).alias("pct_new"),
        )
        gone = F.col("n_gone") >= 1 if strict else F.col("pct_gone") >= 10
        n = n.withColumn("warned", F.coalesce(gone | (F.col("pct_new") >= 30), F.lit(False)))
        out = n if out is None else out.union(n)
    return out


def sample_per_batch(df: DataFrame, entity: str, batch: str, seq: list[str], most: int) -> DataFrame:
    """The first image of each batch, at most ``most`` an entity."""
    one = df.withColumn("__r", F.row_number().over(Window.partitionBy(entity, batch).orderBy(*seq))).filter("__r = 1")
    few = one.withColumn("__k", F.row_number().over(Window.partitionBy(entity).orderBy(batch, *seq)))
    return few.filter(F.col("__k") <= most).drop("__r", "__k")


def floor_and_cap(df: DataFrame, entity: str, block: str, seq: list[str], *, floor: int = 5, cap: int = 200, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """Keep ``floor`` rows a block, then fill up to ``cap`` an entity in the order of a seeded md5 of ``by`` (``seq`` if not given)."""
    ranked = df.withColumn("__b", F.row_number().over(Window.partitionBy(entity, block).orderBy(*seq)))
    chance = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in by or seq], F.lit(str(seed))).cast("binary"))
    turn = [(F.col("__b") > floor).cast("int"), chance, *seq]
    placed = ranked.withColumn("__e", F.row_number().over(Window.partitionBy(entity).orderBy(*turn)))
    return placed.filter((F.col("__b") <= floor) | (F.col("__e") <= cap)).drop("__b", "__e")


def analyse(df: DataFrame, known: DataFrame, entity: str, vendor: str, block: str, *, many_blocks: int = 10, many_images: int = 200) -> DataFrame:
    """Before an import: entities, suppliers, volumes, and how many entities are known already."""
    per = df.groupBy(entity).agg(F.countDistinct(block).alias("blocks"), F.count(F.lit(1)).alias("images"))
    have = per.join(known.select(F.col(entity)).distinct().withColumn("__k", F.lit(1)), entity, "left")
    out = have.agg(F.count(F.lit(1)).alias("n_entities"), F.count(F.when(F.col("blocks") > many_blocks, 1)).alias("n_multi_block"), F.count(F.when(F.col("images") > many_images, 1)).alias("n_large"), F.count("__k").alias("n_known"))
    return out.crossJoin(F.broadcast(df.agg(F.countDistinct(vendor).alias("n_vendors"))))  # one row each
