"""D3 to D5: the calls a client makes, over tables of items, tags, vectors, votes and logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import similarity
from ..operators import ingest, search, similar, tags, vectors

#: Tags that search reads, and those of them that are numbers.
FIELDS = ["bg_color", "base_color", "main_color", "dominant_hue", "tone", "pattern_family", "stone_lightness", "lightness_mean", "busyness", "cloudiness", "bold_veined"]
NUMBERS = ["lightness_mean", "busyness", "cloudiness"]
#: Fields a public result may show.
PUBLIC = ["item", "name", "vendor", "family", "thumbnail", "score", "position", "colour", "pattern", "tone", "dominant_hue"]


@dataclass
class Catalogue:
    """``images``: the active version; ``tag_layers``: layer -> (entity_id, field, value, confidence)."""

    images: DataFrame
    tag_layers: dict[str, DataFrame]
    embeddings: DataFrame | None = None
    votes: DataFrame | None = None

    def tags(self) -> DataFrame:
        return tags.resolve(tags.union_layers(self.tag_layers))

    def candidates(self) -> DataFrame:
        """One wide row an item: its newest image row and its resolved tags. Free-text numbers that are none count as missing."""
        newest = ingest.latest(self.images, "company_stone_id", "ingest_seq", ["stone_name_raw", "vendor", "canonical_family", "block_no", "image_url"])
        items = newest.select(F.col("company_stone_id").alias("item"), F.col("stone_name_raw").alias("name"), "vendor", F.col("canonical_family").alias("family"), F.col("block_no").alias("block"), F.col("image_url").alias("thumbnail"), "ingest_seq")
        resolved = self.tags()
        wide = tags.pivot(resolved, FIELDS).withColumns({f: F.expr(f"try_cast({f} as double)") for f in NUMBERS}).withColumn("bold_veined", F.lower("bold_veined").isin("true", "1"))
        accents = resolved.filter("field = 'accent_colors'").select("entity_id", F.transform(F.from_json("value", "array<struct<color:string,strength:double>>"), lambda x: F.lower(x["color"])).alias("accents"))
        override = self.tag_layers.get("override")
        flags = override.select("entity_id").distinct().withColumn("__o", F.lit(True)) if override is not None else resolved.select("entity_id").limit(0).withColumn("__o", F.lit(True))
        out = items.join(wide, items["item"] == wide["entity_id"], "left").drop("entity_id")
        out = out.join(accents, out["item"] == accents["entity_id"], "left").drop("entity_id")
        out = out.join(flags, out["item"] == flags["entity_id"], "left").drop("entity_id")
        return out.withColumn("has_override", F.coalesce("__o", F.lit(False))).drop("__o")

    def search(self, request: search.Request, *, v3: bool = False) -> tuple[DataFrame, DataFrame]:
        """(page, facets) of a request."""
        ranked = self._ranked(request)
        page = search.page(ranked, request)
        if v3:
            page = page.withColumns({"v3_label": F.lit(None).cast("string"), "v3_confidence": F.lit(None).cast("double")})
        return page, search.facets(ranked)

    def search_meta(self, request: search.Request) -> DataFrame:
        """One row beside a request's page: tier and bucket counts and what the vendor cap did."""
        return search.meta(self._ranked(request), request)

    def _ranked(self, request: search.Request) -> DataFrame:
        items = self.candidates()
        if request.rescue and len(request.dominant_hues) == 1:
            items = search.rescue(items, request.dominant_hues[0])
        return search.rank(items, request)

    def search_by_vector(self, vector: list[float], request: search.Request) -> DataFrame:
        """Ranked by the image formula; items without a vector by the text formula."""
        own = self.embeddings.select(F.col("entity_id").alias("item"), F.round(similarity(F.col("vec"), F.lit([float(x) for x in vector])), 6).alias("visual"))
        ranked = search.rank(self.candidates().join(own, "item", "left"), request, visual=F.col("visual"))
        return ranked.orderBy(F.col("score").desc(), F.col("ingest_seq").desc()).limit(request.limit)

    def vector_of(self, item) -> list[float] | None:
        row = self.embeddings.filter(F.col("entity_id") == item).select("vec").first()
        return None if row is None or row[0] is None else list(row[0])

    def visual_similar(self, item, k: int = 10) -> DataFrame:
        vector = self.vector_of(item)
        if vector is None:
            raise KeyError(item)
        return vectors.nearest(self.embeddings, vector, "entity_id", "vec", min(k, 100), exclude=item)

    def resolve_similar(self, item) -> DataFrame:
        """The re-ranked similar items of one item, voted-out ones excluded."""
        wide = search.effective(self.candidates())
        row = wide.filter(F.col("item") == item).first()
        anchor = {"item": item, "vec": self.vector_of(item)} | ({k: row[k] for k in ("main_color", "retrieval_family", "lightness_mean", "pattern", "tone", "stone_lightness")} if row else {})
        gone = similar.neighbours(self.votes, item) if self.votes is not None else None
        vecs = self.embeddings.select(F.col("entity_id").alias("item"), "vec")
        return similar.resolve(wide.join(vecs, "item"), anchor, suppressed=gone)

    def similar_payload(self, wanted) -> dict:
        """anchor, sections and meta of one item, found by its id or by one of its batches; a stub for an unknown one.

        Sections a and b are empty for ever; c holds the re-ranked similar items with what is shown of them.
        """
        batches = self.images.select(F.col("company_stone_id").alias("item"), F.col("batch_id").alias("batch"))
        row = batches.filter((F.col("item") == wanted) | (F.col("batch") == wanted)).orderBy(F.col("item") == wanted, F.col("item")).select("item").first()
        if row is None:
            return {"anchor": {"item": wanted, "known": False}, "sections": {"section_a": [], "section_b": [], "section_c": []}, "meta": {"section_a_count": 0, "section_b_count": 0, "section_c_count": 0}}
        wide = search.effective(self.candidates())
        own = wide.filter(F.col("item") == row["item"]).first().asDict()
        found = self.resolve_similar(row["item"])
        shown = similar.projection(wide, own).join(found, "item")
        tiers = [c for c in found.columns if c.endswith("_tier")]
        some = [r.asDict(recursive=True) for r in shown.orderBy(*tiers, F.col("similarity").desc(), "item").collect()]  # a page
        meta = {"anchor_color": own["main_color"], "anchor_color_family": own["retrieval_family"], "anchor_dominant_hue": own["dominant_hue"], "anchor_relaxed": own["retrieval_family"] is None}
        return {"anchor": own | {"known": True}, "sections": {"section_a": [], "section_b": [], "section_c": some}, "meta": meta | {"section_a_count": 0, "section_b_count": 0, "section_c_count": len(some)}}

    def log_similar(self, wanted, payload: dict, path: str, action: str = "view") -> None:
        """Append one event of the similar page to its log."""
        spark = self.images.sparkSession
        row = [(str(wanted), action, payload["meta"]["section_c_count"])]
        spark.createDataFrame(row, "item string, action string, n_shown long").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)

    def public(self, page: DataFrame) -> DataFrame:
        """What a page may show to the outside."""
        return page.select(*[c for c in PUBLIC if c in page.columns])


def correction(entity_id, field: str, value: str, reviewer: str, spark) -> tuple[DataFrame, DataFrame]:
    """The override and aggregated rows of one correction, and its log row."""
    rows = spark.createDataFrame([(entity_id, field, value, 1.0)], "entity_id string, field string, value string, confidence double")
    log = spark.createDataFrame([(entity_id, field, value, reviewer)], "entity_id string, field string, value string, reviewer string").withColumn("at", F.current_timestamp())
    return rows, log


def rollback(spark, snapshots: dict[str, str], run_id: str) -> DataFrame:
    """Restore what stood before a run: the snapshot as data, never a command."""
    if run_id not in snapshots:
        raise KeyError(run_id)
    return spark.read.parquet(snapshots[run_id])
