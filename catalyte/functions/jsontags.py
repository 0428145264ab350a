"""JSON held in text columns: tolerant reading and merging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scalar(c: Column) -> Column:
    """A tag value that may be a JSON string, number or array of strings, as plain text; other text stays."""
    first = F.get(F.from_json(c, "array<string>"), F.lit(0))
    quoted = F.regexp_extract(c, r'^"(.*)"$', 1)
    return F.when(F.trim(c).startswith("["), first).when(quoted != "", quoted).otherwise(F.nullif(F.trim(c), F.lit("")))


def accents(c: Column) -> Column:
    """array of struct(color, strength), names lowered; malformed text is null."""
    parsed = F.from_json(c, "array<struct<color:string,strength:double>>")
    return F.transform(parsed, lambda x: F.struct(F.lower(x["color"]).alias("color"), x["strength"].alias("strength")))


def merged(old: Column, new: Column) -> Column:
    """Two JSON objects of text values as one; the new one's keys win."""
    a, b = (F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")) for c in (old, new))
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.to_json(F.map_concat(kept, b))


def safe_segment(c: Column) -> Column:
    """May a text be one segment of a path?"""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._-]+$") & ~c.isin(".", ".."), F.lit(False))
