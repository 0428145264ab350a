"""CSV input under a header contract, and versioned datasets as partitioned Parquet."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ingest

#: Contract column -> dataset column.
MAPPING = {
    "object_key": "image_asset_id",
    "url": "image_url",
    "packing_list_id": "batch_id",
    "company_stone_id": "company_stone_id",
    "vendor name": "vendor",
    "name": "stone_name_raw",
    "block_no": "block_no",
    "block_id": "block_id",
}


def header(spark: SparkSession, path: str) -> list[str]:
    """The header as written: repeated names stay visible, a byte-order mark does not."""
    row = spark.read.option("multiLine", True).csv(path, header=False, inferSchema=False).limit(1).collect()
    return [] if not row else [(x or "").lstrip("﻿").strip() for x in row[0]]


def read_csv(spark: SparkSession, path: str, names: list[str] | None = None, *, multi_line: bool = True) -> DataFrame:
    """All columns as text, by position; ``names`` must be unique (vendor quirk: rename the first ``name``).

    Without ``multi_line`` no cell may hold a line end, and large files are read in splits.
    """
    names = names or header(spark, path)
    df = spark.read.option("multiLine", multi_line).option("header", True).csv(path, inferSchema=False, enforceSchema=True, schema=", ".join(f"`c{k}` string" for k in range(len(names))))
    return df.toDF(*names)


def quirk_names(names: list[str]) -> list[str]:
    """Of two ``name`` columns the first is the vendor's and the last the item's."""
    at = [k for k, n in enumerate(names) if n.lower() == "name"]
    return ["vendor name" if len(at) > 1 and k == at[0] else n for k, n in enumerate(names)]


def preview(df: DataFrame, rows: int = 20) -> tuple[DataFrame, int]:
    return df.limit(rows), df.count()


def in_file_order(df: DataFrame) -> DataFrame:
    """Rows as ``read_csv`` gives them, with ``ingest_seq``: their number from 0, by file path and place in the file.

    A task reads a split from its start on, so numbers within a split are exact; how many
    rows the splits before it hold is counted, which takes a second scan of no column and a row a split.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__id"))
    splits = placed.groupBy("__file", "__split").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__file", "__split").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("__file", "__split", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__start"))
    return placed.join(starts, ["__file", "__split"]).withColumn("ingest_seq", F.col("__start") + F.col("__id")).select(*df.columns, "ingest_seq")


def to_dataset(df: DataFrame, dataset_id: str) -> DataFrame:
    """Contract columns under their dataset names, first row of each image, with ``ingest_seq`` in file order.

    A column ``ingest_seq`` (``in_file_order``) is that order; without one it is that of the plan's partitions.
    """
    from ..functions.text import normalize_stone_name

    cols = [F.nullif(F.trim(F.col(f"`{a}`")), F.lit("")).alias(b) if a in df.columns else F.lit(None).cast("string").alias(b) for a, b in MAPPING.items()]
    rows = df.select(*cols, (F.col("ingest_seq") if "ingest_seq" in df.columns else F.monotonically_increasing_id()).alias("ingest_seq"))
    one = ingest.first_wins(rows, ["image_asset_id"], ["ingest_seq"])
    return one.withColumns({"canonical_family": normalize_stone_name(F.col("stone_name_raw")), "dataset_id": F.lit(dataset_id)})


def write_dataset(df: DataFrame, root: str) -> None:
    """One partition a version; writing a version again replaces it alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(root)


def read_dataset(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    return spark.read.parquet(root).filter(F.col("dataset_id") == dataset_id)


def active_dataset(datasets: DataFrame, *, newest: bool = False) -> str | None:
    """The active version's id; with ``newest`` the newest one where none is active."""
    df = datasets if newest else datasets.filter("is_active")
    row = df.orderBy(F.col("is_active").desc(), F.col("created_at").desc(), "dataset_id").select("dataset_id").first()
    return row[0] if row else None


def manifest(df: DataFrame) -> DataFrame:
    """The images of a version that enrichment reads, by item and address."""
    return df.select("image_asset_id", "company_stone_id", F.col("image_url").alias("url"), "batch_id").orderBy("company_stone_id", "url")


def image_scan(df: DataFrame) -> DataFrame:
    """What change detection and exports read of a version, in a fixed order."""
    return df.select("company_stone_id", "image_asset_id", "image_url", "stone_name_raw", "vendor", "batch_id").orderBy("company_stone_id", "image_asset_id", "image_url")


def row_iterator(df: DataFrame) -> Iterator[Row]:
    """All rows of a version by item, fetched a partition at a time."""
    return df.orderBy("company_stone_id").toLocalIterator()


def activate(datasets: DataFrame, images: DataFrame, dataset_id: str) -> DataFrame:
    """The dataset table with one version active: refused if it is blocked or a batch has two items."""
    row = datasets.filter(F.col("dataset_id") == dataset_id).first()
    if row is None or row["activation_blocked"]:
        raise ValueError(f"{dataset_id} cannot be activated")
    if ingest.collisions(images.filter(F.col("dataset_id") == dataset_id), "batch_id", "company_stone_id").limit(1).count():
        raise ValueError(f"{dataset_id} has batches with more than one item")
    own = F.col("dataset_id") == dataset_id
    status = F.when(own, "validated").when(F.col("is_active"), "archived").otherwise(F.col("validation_status"))
    return datasets.withColumns({"validation_status": status, "is_active": own})


def delete_dataset(datasets: DataFrame, dataset_id: str) -> DataFrame:
    if datasets.filter((F.col("dataset_id") == dataset_id) & F.col("is_active")).limit(1).count():
        raise ValueError("the active version cannot be deleted")
    return datasets.filter(F.col("dataset_id") != dataset_id)


def trimmed(df: DataFrame, *, floor: int = 5, cap: int = 200, seq: tuple[str, ...] = ("batch_id", "image_asset_id", "image_url")) -> DataFrame:
    """Rows of an oversized upload, thinned by block. ``seq`` orders rows by what they hold, so that
    a re-run over other partitions keeps the same ones."""
    return ingest.floor_and_cap(df, "company_stone_id", "block_no", list(seq), floor=floor, cap=cap)


def batches_of(df: DataFrame) -> DataFrame:
    """First row and batch list of each item."""
    return df.groupBy("company_stone_id").agg(F.min_by("stone_name_raw", "ingest_seq").alias("stone_name_raw"), F.array_sort(F.collect_set("batch_id")).alias("batches"))
