"""Names, queries, URLs and error texts as column expressions."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def nullif_blank(c: Column) -> Column:
    """Null, blank and missing are one thing."""
    return F.nullif(F.trim(c), F.lit(""))


def normalize_stone_name(c: Column) -> Column:
    """Lower case, one spelling of grey, without finish words and thicknesses."""
    out = F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("gray"), F.lit("grey"))
    for word in vocab.FINISH_WORDS:
        out = F.regexp_replace(out, rf"\b{word}\b", "")
    out = F.regexp_replace(out, vocab.THICKNESS, "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _kept_words(text: Column, stop: list[str]) -> Column:
    words = F.filter(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "), lambda w: (w != "") & ~w.isin(stop) & ~w.rlike(r"^\d+$"))
    return F.array_join(words, " ")


def normalize_name(c: Column) -> Column:
    """An item's name without sizes, punctuation, stop-words and numbers."""
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), vocab.SIZE, " ")
    return _kept_words(F.regexp_replace(text, r"(?U)[^\w\s]", " "), vocab.NAME_STOP_WORDS)


def _accents() -> tuple[str, str]:
    """Latin letters whose decomposition is a base letter and combining marks."""
    pairs = [(chr(k), unicodedata.normalize("NFKD", chr(k))) for k in range(0xC0, 0x250)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def normalize_query(c: Column) -> Column:
    """A query without accents, punctuation, commercial stop-words and numbers."""
    plain = F.lower(F.translate(F.coalesce(c, F.lit("")), *_accents()))
    return _kept_words(F.regexp_replace(plain, r"(?U)[^\w\s]", " "), vocab.QUERY_STOP_WORDS)


# --- one query, on the driver ----------------------------------------------------------


@dataclass
class Query:
    """What a query text asks for."""

    normalized: str
    colours: list[str] = field(default_factory=list)
    materials: list[str] = field(default_factory=list)
    identity: list[str] = field(default_factory=list)
    colour: str | None = None
    material: str | None = None
    tone: str | None = None


def parse_query(text: str | None) -> Query:
    """Split one query into colour, material and identity tokens."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    words = "".join(c if c.isalnum() or c == "_" or c.isspace() else " " for c in plain).split()
    words = [w for w in words if w not in vocab.QUERY_STOP_WORDS and not w.isdigit()]
    colour_of = {w: c for c, ws in vocab.COLOUR_WORDS.items() for w in ws}
    query = Query(" ".join(words))
    for word in words:
        (query.colours if word in colour_of else query.materials if word in vocab.MATERIALS else query.identity).append(word)
    query.colour = colour_of[query.colours[0]] if query.colours else None
    query.material = query.materials[0] if query.materials else None
    query.tone = infer_tone(text)
    return query


def infer_tone(text: str | None) -> str | None:
    """The first tone one of whose synonyms occurs in the text."""
    low = (text or "").lower()
    return next((tone for tone, words in vocab.TONE_SYNONYMS.items() if any(w in low for w in words)), None)


# --- URLs, keys, errors ----------------------------------------------------------------


def cdn_url(c: Column) -> Column:
    """The address behind an image CDN's wrapper (/cdn-cgi/image/options/address), decoded; others unchanged."""
    inner = F.regexp_extract(c, r"/cdn-cgi/image/[^/]+/(.+)$", 1)
    inner = F.when(inner.rlike("^https?%3A"), F.url_decode(inner)).otherwise(inner)
    return F.when(inner.rlike("^https?://"), inner).otherwise(c)


def pair_key(a: Column, b: Column) -> Column:
    """One key for an undirected pair."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def failure_reason(c: Column) -> Column:
    """What stands before the first bar, else the first 50 characters."""
    return F.when(F.contains(c, F.lit("|")), F.substring_index(c, "|", 1)).otherwise(F.substring(c, 1, 50))


def classify_error(status: Column, error: Column, content_type: Column) -> Column:
    """A label for a failed fetch."""
    low = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(status == 404, "http_404")
        .when(status == 403, "http_403")
        .when(status == 429, "rate_limited")
        .when(status >= 500, "server_error")
        .when(low.contains("timeout"), "timeout")
        .when(low.contains("connect"), "connection_error")
        .when(content_type.isNotNull() & ~content_type.startswith("image/"), "not_an_image")
        .when(low != "", "other")
    )


def tag_text(c: Column, kind: str) -> Column:
    """A tag value as text: booleans as true/false, arrays and structs as JSON, null as blank."""
    text = F.to_json(c) if kind in ("array", "map", "struct") else c.cast("string")
    return F.coalesce(text, F.lit(""))
