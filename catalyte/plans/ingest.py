"""D1 and D2: import a CSV as a version, activate it, work out and run what it needs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..operators import incremental, ingest, tags, vectors, votes
from ..sources import csv_contract
from ..sources.results import ResultStore
from .staged import StagedRun


@dataclass
class ImportResult:
    """What an import did; ``errors`` of the first gate that failed, else the written version."""

    dataset_id: str
    blocked: bool = False
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    rows: int = 0


def new_dataset_id(now: datetime | None = None) -> str:
    return f"{now or datetime.now(timezone.utc):%Y%m%d_%H%M%S}_clean"


#: A version's row in the table of versions.
DATASETS = (
    "dataset_id string, created_at timestamp, source_filename string, rows_read long, is_active boolean, unique_images long, unique_batches long, unique_company_stones long, "
    "unique_families long, unique_blocks long, detected_headers string, validation_summary string, validation_status string, activation_blocked boolean"
)
COUNTED = {"unique_images": "image_asset_id", "unique_batches": "batch_id", "unique_company_stones": "company_stone_id", "unique_families": "canonical_family", "unique_blocks": "block_no"}


def import_csv(spark: SparkSession, path: str, root: str, *, baseline: DataFrame | None = None, dataset_id: str | None = None, block_at: float = 105.0, datasets: str | None = None) -> ImportResult:
    """Header, row and file gates in that order, each failing fast; then dedupe, continuity and the write.

    ``datasets``: where the version's row is appended; a blocked import leaves its row and no images.
    """
    result = ImportResult(dataset_id or new_dataset_id())
    names = csv_contract.header(spark, path)
    df = csv_contract.read_csv(spark, path, names)
    result.errors = ingest.header_errors(names)
    if not result.errors:
        result.errors = [f"{r.field}: {r.n_errors} blank" for r in ingest.row_contract(df, vocab.MANDATORY).collect() if r.n_errors]  # one row a field
        if not result.errors:
            many = ingest.identity_collisions(df, "company_stone_id", "name").orderBy("company_stone_id").limit(5).collect()
            result.errors = [f"{r.company_stone_id} has {r.n_names} names" for r in many]
    result.blocked = bool(result.errors)
    data = None
    if not result.blocked:
        bad = ingest.bad_urls(df, "url").count()
        result.warnings += [f"{bad} addresses are not http"] if bad else []
        data = csv_contract.to_dataset(csv_contract.in_file_order(df), result.dataset_id)
        if baseline is not None:
            kinds = {"item": ("company_stone_id", False), "batch": ("batch_id", False), "vendor": ("vendor", True)}
            for r in ingest.continuity(baseline, data, kinds).collect():  # one row a kind
                result.blocked |= (r.pct_gone or 0) >= block_at
                result.warnings += [f"{r.kind}: {r.n_gone} gone, {r.n_new} new"] if r.warned else []
    if not result.blocked:
        csv_contract.write_dataset(data, root)
        result.rows = csv_contract.read_dataset(spark, root, result.dataset_id).count()
    if datasets is not None:
        written = None if result.blocked else csv_contract.read_dataset(spark, root, result.dataset_id)
        dataset_row(spark, result, names, path, df.count(), written).write.mode("append").parquet(datasets)
    return result


def dataset_row(spark: SparkSession, result: ImportResult, names: list[str], path: str, rows_read: int, data: DataFrame | None) -> DataFrame:
    """The row of one import: counts of what was written, or none and the reasons if it was blocked."""
    counts = [0] * len(COUNTED) if data is None else list(data.agg(*(F.count_distinct(c).alias(n) for n, c in COUNTED.items())).first())
    summary = {"passed_all": not result.blocked, "row_count_total": rows_read, "row_count_valid": result.rows, "row_count_invalid": rows_read - result.rows, "blocked_reasons": result.errors}
    row = (result.dataset_id, datetime.now(timezone.utc), path.rsplit("/", 1)[-1], rows_read, False, *counts, json.dumps(names), json.dumps(summary), "blocked" if result.blocked else "validated", result.blocked)
    return spark.createDataFrame([row], DATASETS)


def signatures(images: DataFrame) -> DataFrame:
    return incremental.signatures(images.filter(F.coalesce(F.trim("company_stone_id"), F.lit("")) != ""), "company_stone_id", ["image_asset_id", "image_url"], ["stone_name_raw", "vendor", "batch_id"], ["ingest_seq"])


def plan_enrichment(candidate: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """(company_stone_id, n_images, change_class); without a baseline all is new."""
    new = signatures(candidate)
    old = signatures(baseline) if baseline is not None else new.limit(0)
    return incremental.classify(new, old, "company_stone_id")


def enrich(images: DataFrame, classes: DataFrame, analyse: Callable[[DataFrame], DataFrame], ledger: DataFrame, *, full: bool = False, dry_run: bool = False) -> DataFrame | None:
    """Tag rows of the items that need analysis and are not in the ledger.

    ``analyse`` maps images to per-image analyses (company_stone_id, image_asset_id, seq, design,
    design_conf, base_color, base_color_conf, tonality, tonality_conf, weight).
    """
    todo = incremental.not_done(incremental.work(classes, "cv", full=full).select("company_stone_id"), ledger, ["company_stone_id"])
    if dry_run:
        return None
    return print_tags(prints(analyse(images.join(todo, "company_stone_id", "left_semi"))))


FIELDS = ("design", "base_color", "tonality")
#: What the analysis of an image gives, and what its encoding gives.
ANALYSIS = ", ".join(f"{f} string, {f}_conf double" for f in FIELDS) + ", weight double"
VECTOR = "vec array<double>"


def prints(found: DataFrame) -> DataFrame:
    """(company_stone_id, design, design_conf, ...): the votes of an item's images."""
    parts = {f: votes.vote(found, "company_stone_id", f, f"{f}_conf", "weight", "seq").select(F.col("company_stone_id"), F.col("label").alias(f), F.col("confidence").alias(f"{f}_conf")) for f in FIELDS}
    return parts["design"].join(parts["base_color"], "company_stone_id", "left").join(parts["tonality"], "company_stone_id", "left")


def print_tags(found: DataFrame) -> DataFrame:
    return tags.tag_rows(found.withColumnRenamed("company_stone_id", "entity_id"), list(FIELDS))


def enrich_run(run: StagedRun, images: DataFrame, classes: DataFrame, analyse: Callable, encode: Callable, analyses: ResultStore, encodings: ResultStore, *, slices: int = 1, most_attempts: int | None = None, full: bool = False) -> dict[str, dict]:
    """The stages ``cv``, ``embeddings`` and ``metadata`` of a run that can be taken up again; their states.

    ``images``: (company_stone_id, image_asset_id, seq, content_md5, content), the hash as a stored
    column. ``analyse`` and ``encode`` map one row a content to (content_md5, ``ANALYSIS`` or
    ``VECTOR``, error) and are called for contents that the stores lack. An item fails if none of its images
    gives a result and is skipped if it has no images. ``hits`` and ``misses`` count its images by whether
    their content was in the store when its slice began. ``metadata`` votes anew over what is stored for items
    whose images are as they were. Read the outcome with ``run.results(stage)``.
    """
    slim = [c for c in images.columns if c != "content"]

    def per_image(keys: DataFrame, store: ResultStore, compute: Callable) -> DataFrame:
        own = images.join(keys, "company_stone_id", "left_semi")
        part = store.fill(own, compute)["part"]
        return store.joined(own.select(*slim), part).withColumn("good", F.col("content_md5").isNotNull() & F.col("error").isNull())

    def per_item(found: DataFrame, outcome: DataFrame) -> DataFrame:
        stored = F.coalesce("was_stored", F.lit(False))
        counts = found.groupBy("company_stone_id").agg(F.count(F.lit(1)).alias("n_images"), F.count_if(stored).alias("hits"), F.count_if(~stored).alias("misses"), F.count_if("good").alias("n_good"), F.min("error").alias("problem"))
        bad = F.col("n_good") == 0
        labels = [F.when(bad, F.coalesce(F.substring_index("problem", ":", 1), F.lit("NoContent"))).alias("error_class"), F.when(bad, F.col("problem")).alias("error_message")]
        return counts.join(outcome, "company_stone_id", "left").select("*", *labels).drop("problem", "n_good")

    def cv(keys: DataFrame) -> DataFrame:
        found = per_image(keys, analyses, analyse)
        return per_item(found, prints(found.filter("good")))

    def embeddings(keys: DataFrame) -> DataFrame:
        found = per_image(keys, encodings, encode)
        return per_item(found, vectors.mean_vectors(found.filter("good"), "company_stone_id", "vec"))

    metadata = classes.filter("change_class = 'CHANGED_METADATA'") if not full else classes.limit(0)
    work = {"cv": (incremental.work(classes, "cv", full=full), cv), "embeddings": (incremental.work(classes, "embeddings", full=full), embeddings), "metadata": (metadata, cv)}
    counters = {c: F.sum(c) for c in ("n_images", "hits", "misses")}
    return {name: run.stage(name, todo, how, slices=slices, most_attempts=most_attempts, counters=counters) for name, (todo, how) in work.items()}


def failed(results: DataFrame, run_id: str, stage: str) -> DataFrame:
    """Failures of a stage as ledger rows; class and message are cut to their columns' lengths."""
    rows = results.filter(F.col("error_class").isNotNull())
    return rows.select(F.lit(run_id).alias("run_id"), F.lit(stage).alias("stage"), "company_stone_id", F.substring("error_class", 1, 200).alias("error_class"), F.substring("error_message", 1, 2000).alias("error_message"))


def progress(log: DataFrame) -> DataFrame:
    """The latest progress row of each version from an append-only log."""
    return ingest.latest(log, "dataset_id", "seq", [c for c in log.columns if c not in ("dataset_id", "seq")])
