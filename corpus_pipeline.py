"""The corpus pipeline: five stages over ``documents``, each written as Parquet before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalyte.llm import decontaminate, packing, quality, similar_texts, simhash, suffix
from catalyte.llm._shared import bounded_batches, materialize, table
from catalyte.llm.components import components


def _private(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with every column but ``doc_id`` and ``text`` under a name of ours, which no operator uses, and those names."""
    names = {n: f"__own_{k}" for k, n in enumerate(docs.columns) if n not in ("doc_id", "text")}
    return docs.select(*(F.col(f"`{n}`").alias(names.get(n, n)) for n in docs.columns)), names


def _given_back(kept: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The rows of ``kept`` with the columns of ``docs``, in their order."""
    return kept.select(*(F.col(names.get(n, n)).alias(n) for n in docs.columns))


def _without(docs: DataFrame, gone: DataFrame, *, keep_uid: bool = False) -> DataFrame:
    """``docs`` (with ``uid``, never null) but for the ids in ``gone`` (uid)."""
    kept = docs.join(gone.select("uid").distinct(), "uid", "left_anti")
    return kept if keep_uid else kept.drop("uid")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are judged like any others, equal rows alike.

    Other columns pass unchanged, whatever their names, here as in all stages but the last.
    """
    bounded_batches(spark)
    own, names = _private(docs)
    found = quality.classify(own, table(spark, sf_dir, "labels"))
    return _given_back(found.filter("predicted = 1"), docs, names)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest id stays.

    Two texts are near copies if their SimHash fingerprints differ in three bits at most, or
    if their 5-word shingle sets have a Jaccard similarity of 0.8 or more. Null texts are empty,
    and texts without words are copies of each other; of rows equal in id and text one stays;
    texts of any length are compared whole; no rows give no rows.
    """
    bounded_batches(spark)
    own, names = _private(docs)
    named = suffix.with_uid(own, "doc_id")
    close = simhash.near_classes(named, key="uid").filter("uid <> component_id").select(F.col("uid").alias("u"), F.col("component_id").alias("v"))
    groups = components(close.union(similar_texts.links(named, key="uid")))
    kept = _without(named, groups.select(F.col("node").alias("uid")), keep_uid=True)
    if suffix.has_clash(docs, "doc_id"):  # equal rows share their uid
        kept = kept.dropDuplicates(["uid"])
    return _given_back(kept, docs, names)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that occur elsewhere are cut out of the texts, in all their places.

    Null texts become empty; a text may be empty afterwards; ``n_chars`` is counted anew where bytes went.
    """
    bounded_batches(spark)
    own, names = _private(docs)
    cut = suffix.cut_repeats(own, carry=tuple(names.values()))
    changed = F.col("n_spans") > 0
    out = cut.withColumn("text", F.col("kept_text"))
    if n_chars := names.get("n_chars"):
        out = out.withColumn(n_chars, F.when(changed, F.length("text")).otherwise(F.col(n_chars)).cast(docs.schema["n_chars"].dataType))
    return _given_back(out, docs, names)


def no_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null, empty and wordless texts contain none, nor do null and empty items match."""
    bounded_batches(spark)
    own, names = _private(docs)
    named = suffix.with_uid(own, "doc_id")
    found = decontaminate.contained(named, table(spark, sf_dir, "benchmark"), key="uid")
    return _given_back(_without(named, found), docs, names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in training sequences of up to 2048; null and empty texts are their end id alone, equal rows stand side by side."""
    bounded_batches(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1, memo=300_000)  # its executors' heaps have grown in earlier stages


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("suffix-array dedup", no_repeats),
    ("benchmark decontamination", no_test_items),
    ("packing", packed),
]

#: Hashing, training and tokenizing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return last(spark, docs, sf_dir)
