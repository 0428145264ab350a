"""Score columns of ranked search and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def base_colour_match(colour: Column, wanted: list[str], confidence: Column) -> Column:
    """No wish .5, unknown .3, hit 1, next to it .6 (.75 if unsure), else .2 (.4 if unsure)."""
    if not wanted:
        return F.lit(0.5)
    near = sorted({n for w in wanted for n in vocab.SCORE_ADJACENT.get(w, [])})
    unsure = F.coalesce(confidence, F.lit(0.0)) < 0.4
    return F.when(colour.isNull(), 0.3).when(colour.isin(wanted), 1.0).when(colour.isin(near), F.when(unsure, 0.75).otherwise(0.6)).otherwise(F.when(unsure, 0.4).otherwise(0.2))


def green_rescue(match: Column, wanted: list[str], hue: Column, hue_confidence: Column) -> Column:
    if "green" not in wanted:
        return match
    return F.when((hue == "green") & (hue_confidence >= 0.65), 1.0).otherwise(match)


def veining_score(busyness: Column, lo: float | None, hi: float | None) -> Column:
    """1 inside the range, falling by 2 per unit outside it, at least .2; no range .5."""
    if lo is None and hi is None:
        return F.lit(0.5)
    low, high, b = F.lit(0.0 if lo is None else lo), F.lit(1.0 if hi is None else hi), F.coalesce(busyness, F.lit(0.5))
    return F.when(b.between(low, high), 1.0).otherwise(F.greatest(F.lit(0.2), 1 - 2 * F.greatest(low - b, b - high)))


def pattern_score(pattern: Column, wanted: list[str]) -> Column:
    if not wanted:
        return F.lit(0.5)
    return F.when(pattern.isin(wanted), 1.0).otherwise(0.3)


def accent_score(accents: Column, wanted: list[str]) -> Column:
    """.3 + .7 * share of the wanted accents that are there; no wish .5."""
    if not wanted:
        return F.lit(0.5)
    return 0.3 + 0.7 * F.size(F.array_intersect(F.coalesce(accents, F.array().cast("array<string>")), F.lit(wanted))) / len(wanted)


def cloudiness_term(cloudiness: Column, confidence: Column, preferred: float | None, weight: float = 0.20) -> Column:
    if preferred is None:
        return F.lit(0.0)
    return weight * (1 - F.abs(F.coalesce(cloudiness, F.lit(0.5)) - preferred)) * F.when(cloudiness.isNull(), 0.3).otherwise(F.coalesce(confidence, F.lit(0.3)))


def boost(value: Column, wanted: list[str], confidence: Column) -> Column:
    """.10 * confidence for a soft tone or hue wish that is met; unknown is neutral at .5."""
    if not wanted:
        return F.lit(0.0)
    return F.when(F.coalesce(value, F.lit("neutral")).isin(wanted), 0.10 * F.coalesce(confidence, F.lit(0.5))).otherwise(0.0)


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    return sum((w * parts[k] for k, w in weights.items()), F.lit(0.0))


def hue_rescue(family_share: Column, block_share: Column, keyword: Column, hue: Column, hue_confidence: Column, wanted: str, base: Column) -> Column:
    """May an item be shown for a hue it is not tagged with?"""
    shares = ((family_share >= 0.60) & (block_share >= 0.20)) | (keyword & (family_share >= 0.55) & (block_share >= 0.15))
    direct = (hue == wanted) & (hue_confidence >= 0.5)
    out = F.coalesce(shares, F.lit(False)) | F.coalesce(direct, F.lit(False))
    return out & base.isin("grey", "black", "brown") if wanted == "green" else out


def name_multiplier(family: Column, wanted_colour: str | None, weighted_ratio: Column) -> Column:
    """Colour factor of a name score: 1 if the family fits, less if unknown or other, floored for near-exact names."""
    families = vocab.COLOUR_FAMILIES.get(wanted_colour or "")
    if not families:
        return F.lit(1.0)
    factor = F.when(family.isNull(), vocab.NO_SIGNAL).when(family.isin(families), 1.0).otherwise(vocab.MISMATCH)
    return F.when(weighted_ratio >= vocab.NAME_BYPASS, F.greatest(factor, F.lit(vocab.NAME_FLOOR))).otherwise(factor)


def material_multiplier(material: Column, wanted: str | None) -> Column:
    if not wanted:
        return F.lit(1.0)
    return F.when(material.isNull(), 1.0).when(material == wanted, vocab.MATERIAL_MATCH).otherwise(vocab.MATERIAL_CONFLICT)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null vectors and zero norms give null."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Cosine mapped to [0, 1]; null where there is none (least and greatest would skip it)."""
    c = cosine(a, b)
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c + 1) / 2)))


def image_weight(sharpness: Column, exposure: Column, glare: Column, area: Column) -> Column:
    """Quality weight of one image."""
    return F.round(0.4 * sharpness + 0.3 * exposure + 0.2 * (1 - glare) + 0.1 * area, 6)
