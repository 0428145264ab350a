"""Colour families, vetoes, tiers and bands as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """A small fixed table as a map literal."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*pairs.items())]), F.coalesce(key, F.lit("")))


def _inverse(table: dict[str, list[str]]) -> dict[str, str]:
    return {value: key for key, values in table.items() for value in values}


def any_pair(table: dict[str, list[str]], a: Column, b: Column) -> Column:
    """Is (a, b), in either order, in a table of undirected pairs?"""
    hits = [((a == k) & b.isin(v)) | ((b == k) & a.isin(v)) for k, v in table.items()]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return F.coalesce(out, F.lit(False))


def normalize_chromatic(c: Column) -> Column:
    return F.coalesce(lookup(vocab.CHROMATIC_NAMES, c), c)


def effective_base_colour(background: Column, base: Column, main: Column) -> Column:
    """A chromatic background wins, then the base colour, then the main colour."""
    b = F.lower(F.trim(background))
    return normalize_chromatic(F.coalesce(F.when(b.isin(vocab.CHROMATIC_BACKGROUNDS), b), F.nullif(F.lower(F.trim(base)), F.lit("")), F.nullif(F.lower(F.trim(main)), F.lit(""))))


def colour_family(main: Column, hue: Column, lightness: Column) -> Column:
    """The retrieval family of a main colour: dark colours split by hue, cool chromatic ones by lightness."""
    c, h = F.lower(F.trim(main)), F.lower(F.trim(hue))
    base = lookup(_inverse(vocab.FAMILY_COLOURS), c)
    return (
        F.when(c.isin(vocab.DARK_MAIN_COLOURS), F.when(h.isin(vocab.DARK_WARM_HUES), "DARK_WARM_CHROMATIC").when(h.isin(vocab.DARK_COOL_HUES), "DARK_COOL_CHROMATIC").otherwise("TRUE_DARK"))
        .when(base == "COOL_CHROMATIC", F.when(F.lower(lightness) == "light", "LIGHT_COOL").otherwise("DARK_COOL"))
        .otherwise(base)
    )


def veto_bucket(c: Column) -> Column:
    return lookup(_inverse(vocab.VETO_BUCKETS), F.lower(F.trim(c)))


def bucket_veto(a: Column, b: Column) -> Column:
    pairs: dict[str, list[str]] = {}
    for x, y in vocab.VETO_PAIRS:
        pairs.setdefault(x, []).append(y)
    return any_pair(pairs, a, b)


def family_veto(a: Column, b: Column) -> Column:
    return any_pair(vocab.VETO_FAMILIES, a, b)


def family_tier(a: Column, b: Column, a_lightness: Column, b_lightness: Column) -> Column:
    """1 same family, 2 next to it, 3 other; gated pairs that are too far apart in lightness are 3."""
    gated: dict[str, list[str]] = {}
    for x, y in vocab.GATED_FAMILIES:
        gated.setdefault(x, []).append(y)
    far = F.coalesce(F.abs(a_lightness - b_lightness) > vocab.LIGHTNESS_GATE, F.lit(False))
    return F.when(a == b, 1).when(any_pair(gated, a, b) & far, 3).when(any_pair(vocab.ADJACENT_FAMILIES, a, b), 2).otherwise(3)


def same_tier(a: Column, b: Column) -> Column:
    """1 equal, 2 one unknown, 3 different."""
    return F.when(a == b, 1).when(a.isNull() | b.isNull(), 2).otherwise(3)


def main_colour_tier(colour: Column, wanted: list[str]) -> Column:
    """1 wanted, 2 next to a wanted colour, 3 other; no wish is 1."""
    if not wanted:
        return F.lit(1)
    near = sorted({n for w in wanted for n in vocab.TIER_ADJACENT.get(w, [])})
    return F.when(colour.isin(wanted), 1).when(colour.isin(near), 2).otherwise(3)


def pattern_tier(pattern: Column, wanted: list[str]) -> Column:
    if not wanted:
        return F.lit(1)
    return F.when(pattern.isin(wanted), 1).when(pattern.isNull(), 2).otherwise(3)


def lightness_band(mean: Column, base: Column) -> Column:
    """light from 65 on; dark below 35, or below 50 for dark bases; else mid."""
    dark = F.when(F.lower(base).isin(vocab.DARK_BASES), vocab.BANDS["dark_base"]).otherwise(vocab.BANDS["dark"])
    return F.when(mean.isNull(), None).when(mean >= vocab.BANDS["light"], "light").when(mean < dark, "dark").otherwise("mid")


def vein_colour(vein: Column, total: Column, hues: dict[str, Column], neutral: Column, neutral_mean: Column) -> Column:
    """The colour of veins from pixel counts per hue: none, a dominant hue, mixed, or a neutral shade."""
    chromatic = sum(hues.values(), F.lit(0))
    counts = F.array(*[F.struct(n.cast("long").alias("n"), F.lit(name).alias("hue")) for name, n in hues.items()])
    ranked = F.array_sort(counts, lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["hue"] < b["hue"], -1).otherwise(1))
    first, second = ranked[0], ranked[1]
    share = chromatic / F.nullif(chromatic + neutral, F.lit(0))
    return (
        F.when((vein < 200) | (vein / F.nullif(total, F.lit(0)) < 0.005), "none")
        .when(share < 0.15, F.when(neutral_mean >= 70, "white").when(neutral_mean < 30, "black").otherwise("grey"))
        .when(first["n"] >= 0.55 * chromatic, first["hue"])
        .when(second["n"] >= 0.30 * chromatic, "multi")
        .otherwise(first["hue"])
    )


def nearest_centre(lightness: Column, a: Column, b: Column, centres: list[tuple[str, float, float, float]]) -> Column:
    """struct(d, name): the nearest named centre in LAB and its distance, lightness at half weight.

    One lambda runs over the centres: written out for each of them, the generated method would be too large
    (over 8,000 bytes) for the JVM to compile, and be interpreted for every row.
    """
    known = F.array(*[F.struct(F.lit(n).alias("name"), *(F.lit(float(v)).alias(c) for c, v in zip("lab", at))) for n, *at in centres])

    def square(x: Column) -> Column:
        return x * x

    def away(c: Column) -> Column:
        d = F.sqrt(0.5 * square(lightness - c["l"]) + square(a - c["a"]) + square(b - c["b"]))
        return F.struct(d.alias("d"), c["name"].alias("name"))

    return F.array_min(F.transform(known, away))


def nearest_colour(lightness: Column, a: Column, b: Column, centres: list[tuple[str, float, float, float]]) -> Column:
    """struct(name, confidence) of the nearest named centre."""
    found = nearest_centre(lightness, a, b, centres)
    return F.struct(found["name"].alias("name"), (1 - F.least(found["d"] / 50, F.lit(0.5))).alias("confidence"))
