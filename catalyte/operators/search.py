"""Ranked search: hard filters, scores, tiers, section and bucket modes, vendor cap, facets, page.

The candidates are one wide row an item: id, name, vendor, family, ingest_seq, thumbnail and
the pivoted tags. Everything up to the page is one lazy plan; every order ends in a key that
is total.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import colors, scores
from ..functions.fuzzy import name_scores
from ..functions.text import Query, normalize_name, parse_query


@dataclass
class Request:
    """A search request; fields that are accepted but never evaluated are left out."""

    query: str = ""
    base_colors: list[str] = field(default_factory=list)
    pattern_families: list[str] = field(default_factory=list)
    stone_types: list[str] = field(default_factory=list)
    tones: list[str] = field(default_factory=list)
    tone_strict: bool = False
    dominant_hues: list[str] = field(default_factory=list)
    accent_colors: list[str] = field(default_factory=list)
    veining: tuple[float | None, float | None] = (None, None)
    cloudiness: float | None = None
    cloudiness_range: tuple[float, float] | None = None
    min_confidence: float = 0.0
    colour_strict: bool = False
    sort: str = "best_match"
    limit: int = 60
    offset: int = 0
    rescue: bool = False

    @property
    def parsed(self) -> Query:
        return parse_query(self.query)

    @property
    def patterns(self) -> list[str]:
        return [vocab.PATTERN_ALIASES.get(p.lower(), p.lower()) for p in self.pattern_families]

    @property
    def chips(self) -> list[str]:
        out = []
        for c in (c.lower() for c in self.base_colors):
            out += vocab.YELLOW_CHIP if c == "yellow" else [c]
        return out

    @property
    def mode(self) -> str:
        """sections, browse, buckets or default: the first line of the mode table that holds."""
        one_hue = len(self.dominant_hues) == 1 and self.rescue
        if self.base_colors and self.patterns and not one_hue:
            return "sections"
        if self.base_colors and not self.query.strip() and (not self.patterns or one_hue):
            return "browse"
        return "buckets" if one_hue else "default"


# --- filters ---------------------------------------------------------------------------


def removed_by(request: Request) -> Column:
    """The first rule that removes a row; null if it stays."""
    c = F.col
    out = F.when(F.lit(False), "")

    def drop(out: Column, name: str, keep: Column) -> Column:
        return out.when(~F.coalesce(keep, F.lit(False)), name)

    if request.min_confidence > 0:
        sure = F.coalesce(F.nullif(c("base_color_confidence"), F.lit(0.0)), c("main_color_confidence"), F.lit(0.0))
        out = drop(out, "min_confidence", sure >= request.min_confidence)
    chips = request.chips
    if "multi" in chips:
        out = drop(out, "colour", c("colour") == "multi")
    elif chips == ["brown"]:
        out = drop(out, "colour", (c("colour") == "brown") | ((c("colour") == "beige") & c("dominant_hue").isin("brown", "orange")))
    elif chips and request.colour_strict:
        out = drop(out, "colour", c("colour").isin(chips))
    if request.stone_types:
        family = F.coalesce(F.lower(c("family")), F.lit(""))
        out = drop(out, "stone_type", (family == "") | family.isin([t.lower() for t in request.stone_types]))
    if request.patterns and request.mode != "sections":
        out = drop(out, "pattern", pattern_match(request.patterns))
    if request.cloudiness_range:
        out = drop(out, "cloudiness", F.coalesce(c("cloudiness").between(*request.cloudiness_range), F.lit(True)))
    if request.tones and request.tone_strict:
        out = drop(out, "tone", F.coalesce(F.nullif(F.lower(c("tone")), F.lit("")), F.lit("neutral")).isin(request.tones))
    if request.dominant_hues:
        hues = c("dominant_hue").isin(request.dominant_hues)
        out = drop(out, "hue", hues | F.coalesce(c("rescued"), F.lit(False)) if request.rescue else hues)
    return out


def pattern_match(patterns: list[str]) -> Column:
    """A wanted label, a missing one where that is asked for, or bold veins."""
    hit = F.coalesce(F.col("pattern").isin(patterns), F.lit(False))
    if "unlabeled" in patterns:
        hit = hit | F.col("pattern").isNull()
    if "bold_veined" in patterns:
        hit = hit | F.coalesce(F.col("bold_veined"), F.lit(False))
    return hit


# --- scores ----------------------------------------------------------------------------


def effective(candidates: DataFrame) -> DataFrame:
    """Add the effective colour, pattern and retrieval family."""
    pattern = F.nullif(F.lower(F.trim("pattern_family")), F.lit(""))
    alias = F.coalesce(colors.lookup(vocab.PATTERN_ALIASES, pattern), pattern)
    return candidates.withColumns(
        {
            "colour": colors.effective_base_colour(F.col("bg_color"), F.col("base_color"), F.col("main_color")),
            "pattern": alias,
            "retrieval_family": colors.colour_family(F.col("main_color"), F.col("dominant_hue"), F.col("stone_lightness")),
        }
    )


def with_text_score(df: DataFrame, query: Query) -> DataFrame:
    """The name score: .5 without a query, 1 if the id contains it, else fuzzy; colour and material factors apply.

    Distinct names are scored once and joined back, so the Python work follows the vocabulary
    of names and not the rows.
    """
    if not query.normalized:
        return df.withColumns({"text_score": F.lit(0.5), "weighted_ratio": F.lit(0.0)})
    named = df.withColumn("norm_name", normalize_name(F.col("name")))
    scored = named.select("norm_name").distinct().withColumn("f", name_scores(F.col("norm_name"), query)).select("norm_name", F.col("f.base").alias("base"), F.col("f.weighted").alias("weighted_ratio"))
    words = F.split("norm_name", " ")
    family = F.lower(F.trim("family"))
    material = F.when(family.isin(vocab.MATERIALS), family).otherwise(F.get(F.filter(words, lambda w: w.isin(vocab.MATERIALS)), F.lit(0)))
    base = F.when(F.contains(F.lower(F.col("item").cast("string")), F.lit(query.normalized)), 1.0).otherwise(F.col("base"))
    factor = scores.name_multiplier(F.col("retrieval_family"), query.colour, F.col("weighted_ratio")) * scores.material_multiplier(material, query.material)
    return named.join(scored, "norm_name").withColumn("text_score", base * factor).drop("base", "norm_name")


def score_parts(request: Request) -> dict[str, Column]:
    c = F.col
    match = scores.base_colour_match(c("colour"), request.chips, c("base_color_confidence"))
    return {
        "text": c("text_score"),
        "colour": scores.green_rescue(match, request.chips, c("dominant_hue"), c("dominant_hue_confidence")),
        "vein": scores.veining_score(c("busyness"), *request.veining),
        "pattern": scores.pattern_score(c("pattern"), request.patterns),
        "accent": scores.accent_score(c("accents"), request.accent_colors),
        "manual": F.when(c("has_override"), 1.0).otherwise(0.5),
    }


def final_score(request: Request, *, visual: Column | None = None) -> Column:
    """The score of the request's mode; with ``visual`` rows that have a similarity use the image formula."""
    parts = score_parts(request)
    sure = F.col("cloudiness_confidence")
    text = scores.weighted(parts, vocab.BROWSE_WEIGHTS if request.mode == "browse" else vocab.TEXT_WEIGHTS) + scores.cloudiness_term(F.col("cloudiness"), sure, request.cloudiness)
    if visual is not None:
        image = scores.weighted(parts | {"visual": visual}, vocab.IMAGE_WEIGHTS) + scores.cloudiness_term(F.col("cloudiness"), sure, request.cloudiness, 0.15)
        text = F.when(visual.isNotNull(), image).otherwise(text)
    soft = [] if request.tone_strict else request.tones
    out = text + scores.boost(F.col("tone"), soft, F.col("tone_confidence")) + scores.boost(F.col("dominant_hue"), request.dominant_hues, F.col("dominant_hue_confidence"))
    return F.round(out, 6)


def completeness() -> Column:
    """0 to 3: thumbnail, colour, pattern."""
    return F.col("thumbnail").isNotNull().cast("int") + F.col("colour").isNotNull().cast("int") + F.col("pattern").isNotNull().cast("int")


def section_tier(request: Request) -> Column:
    """1 both, 2 colour only, 3 pattern only, null neither."""
    hit = F.col("colour").isin(request.chips)
    if "brown" in request.chips:
        hit = hit | ((F.col("colour") == "beige") & F.col("dominant_hue").isin("brown", "orange"))
    hit, pattern = F.coalesce(hit, F.lit(False)), pattern_match(request.patterns)
    return F.when(hit & pattern, 1).when(hit, 2).when(pattern, 3)


def rank_bucket(request: Request) -> Column:
    """1 effective colour wanted, 2 green by its hue, 3 other."""
    green = (F.col("dominant_hue") == "green") & (F.col("dominant_hue_confidence") >= 0.65) if "green" in request.chips else F.lit(False)
    wanted = F.col("colour").isin(request.chips) if request.chips else F.col("dominant_hue").isin(request.dominant_hues)
    return F.when(wanted, 1).when(green, 2).otherwise(3)


def rank_order(request: Request) -> list[Column]:
    newest = F.col("ingest_seq").desc()
    if request.sort != "best_match":
        return [newest]
    first = {"sections": ["match_tier"], "browse": ["rank_bucket"], "buckets": ["rank_bucket"], "default": ["colour_tier", "pattern_tier"]}[request.mode]
    last = [F.col("completeness").desc()] if request.mode == "default" else []
    return [*[F.col(x).asc() for x in first], F.col("score").desc(), *last, newest]


def rank(candidates: DataFrame, request: Request, *, visual: Column | None = None) -> DataFrame:
    """Filtered and scored candidates with the columns of the request's order; sections drop what matches neither."""
    df = effective(candidates)
    df = df.filter(removed_by(request).isNull())
    df = with_text_score(df, request.parsed).withColumn("score", final_score(request, visual=visual))
    df = df.withColumns(
        {
            "completeness": completeness(),
            "colour_tier": colors.main_colour_tier(F.col("colour"), request.chips),
            "pattern_tier": colors.pattern_tier(F.col("pattern"), request.patterns),
            "rank_bucket": rank_bucket(request) if request.mode in ("browse", "buckets") else F.lit(None).cast("int"),
            "match_tier": section_tier(request) if request.mode == "sections" else F.lit(None).cast("int"),
        }
    )
    return df.filter("match_tier is not null") if request.mode == "sections" else df


def filter_counts(candidates: DataFrame, request: Request) -> DataFrame:
    """How many rows each rule removed; ``kept`` for the rest."""
    return effective(candidates).withColumn("removed_by", F.coalesce(removed_by(request), F.lit("kept"))).groupBy("removed_by").agg(F.count(F.lit(1)).alias("n"))


# --- diversity, page, facets -----------------------------------------------------------


def cap_facts(ranked: DataFrame, key: Column) -> DataFrame:
    """One row: ``vendors``, ``relaxed`` and how many rows of a vendor are ``allowed``. 3, relaxed to 5
    if fewer than 8 rows are within 3; all with fewer than 5 vendors. From per-vendor counts."""
    cap = vocab.VENDOR_CAP
    per = ranked.groupBy(key.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    facts = per.agg(F.count(F.when(F.col("v") != "", 1)).alias("vendors"), F.coalesce(F.sum(F.least("n", F.lit(cap["tight"]))), F.lit(0)).alias("within"))
    few, thin = F.col("vendors") < cap["min_vendors"], F.col("within") < cap["min_shown"]
    return facts.select("vendors", (~few & thin).alias("relaxed"), F.when(few, 2**31 - 1).when(thin, cap["relaxed"]).otherwise(cap["tight"]).alias("allowed"))


def vendor_cap(ranked: DataFrame, order: list[Column], most: int, vendor: str = "vendor") -> DataFrame:
    """Add ``over_cap``: rows beyond their vendor's cap go to the end, in their order.

    For the first ``most`` rows of the outcome no more than ``most`` rows of a vendor count, so
    the row number is limited before the shuffle and no vendor's rows are sorted whole.
    """
    key = F.coalesce(F.trim(vendor), F.lit(""))
    first = ranked.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= most)
    facts = cap_facts(ranked, key).select("allowed")
    return first.crossJoin(F.broadcast(facts)).withColumn("over_cap", (F.col("__n") > F.col("allowed")).cast("int")).drop("__n", "allowed")  # one row


def page(ranked: DataFrame, request: Request, *, vendor: str = "vendor") -> DataFrame:
    """One page with its positions: a bounded top-k of what the vendor cap leaves."""
    order, most = rank_order(request), request.offset + request.limit
    if request.sort == "best_match":
        ranked, order = vendor_cap(ranked, order, most, vendor), [F.col("over_cap").asc(), *order]
    top = ranked.orderBy(*order).limit(most)
    place = F.row_number().over(Window.orderBy(*order)) - 1  # over one page only
    return top.withColumn("position", place).filter(F.col("position") >= request.offset)


def needs_tags(request: Request) -> bool:
    """Does a filter or a score of the request read tags?"""
    wishes = (request.base_colors, request.pattern_families, request.dominant_hues, request.tones, request.accent_colors, request.cloudiness_range, request.colour_strict, request.tone_strict)
    lo, hi = request.veining
    return any(wishes) or request.cloudiness is not None or request.min_confidence > 0 or (lo or 0.0) > 0.0 or (1.0 if hi is None else hi) < 1.0


def meta(ranked: DataFrame, request: Request, *, vendor: str = "vendor") -> DataFrame:
    """One row beside a page: how many rows each section tier and rank bucket has, and what the vendor cap did.

    Counts of a mode that the request is not in are null.
    """
    sections, buckets = request.mode == "sections", request.mode in ("browse", "buckets")
    tiers = {"tier_1_both": 1, "tier_2_colour_only": 2, "tier_3_pattern_only": 3}
    ranks = {"direct": 1, "rescued": 2, "other": 3}

    def counted(on: bool, column: str, k: int) -> Column:
        return F.count_if(F.col(column) == k) if on else F.lit(None).cast("long")

    counts = ranked.agg(*(counted(sections, "match_tier", k).alias(n) for n, k in tiers.items()), *(counted(buckets, "rank_bucket", k).alias(n) for n, k in ranks.items()))
    capped = request.sort == "best_match"
    facts = cap_facts(ranked, F.coalesce(F.trim(vendor), F.lit(""))).select(
        (F.lit(capped) & (F.col("vendors") >= vocab.VENDOR_CAP["min_vendors"])).alias("vendor_cap_applied"), (F.lit(capped) & F.col("relaxed")).alias("vendor_cap_relaxed"), F.col("vendors").alias("distinct_vendor_count")
    )
    return counts.crossJoin(F.broadcast(facts)).withColumn("needs_tags", F.lit(needs_tags(request)))  # one row each


def facets(ranked: DataFrame) -> DataFrame:
    """(facet, value, n) of patterns and colours, the unlabeled ones under their own value: one pass."""
    rows = ranked.select(F.explode(F.array(F.struct(F.lit("pattern_family").alias("facet"), F.coalesce("pattern", F.lit("unlabeled")).alias("value")), F.struct(F.lit("base_color").alias("facet"), F.col("colour").alias("value")))).alias("f")).select("f.*")
    return rows.filter("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def rescue(candidates: DataFrame, hue: str) -> DataFrame:
    """Add ``rescued``: items that shares of their name family and block let in for a hue.

    Both statistics are aggregates of the candidates; they join back by key.
    """
    is_hue = F.avg((F.col("dominant_hue") == hue).cast("double"))
    family = candidates.groupBy("vendor", "name").agg(F.coalesce(is_hue, F.lit(0.0)).alias("family_share"))
    block = candidates.groupBy("block").agg(F.coalesce(is_hue, F.lit(0.0)).alias("block_share"))
    word = F.lit(False)
    for w in vocab.HUE_KEYWORDS.get(hue, []):
        word = word | F.contains(F.lower("name"), F.lit(w))
    joined = candidates.join(family, ["vendor", "name"], "left").join(block, "block", "left")
    ok = scores.hue_rescue(F.col("family_share"), F.col("block_share"), word, F.col("dominant_hue"), F.col("dominant_hue_confidence"), hue, F.col("base_color"))
    return joined.withColumn("rescued", ok).drop("family_share", "block_share")


def log_results(page_df: DataFrame, request_id: str, item: str = "item") -> DataFrame:
    """The log rows of a page."""
    return page_df.select(F.lit(request_id).alias("search_request_id"), F.col(item).alias("item"), "position", "score")
