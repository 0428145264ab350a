"""Whole flows: import, enrichment planning, search and similar items over one small catalogue."""

import pytest
from pyspark.sql import functions as F

from catalyte.operators import search
from catalyte.plans import catalogue, ingest

HEAD = "company_stone_id,packing_list_id,object_key,url,name,vendor name,block_no\n"


def csv(path, rows):
    path.write_text(HEAD + "".join(",".join(map(str, r)) + "\n" for r in rows))
    return str(path)


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    rows = [(f"s{k}", f"b{k}", f"k{k}", f"http://h/{k}", f"Stone {n}", f"V{k % 6}", k % 3) for k, n in enumerate(["red onyx", "verde marble", "blue slate", "white wave", "red marble", "grey mist"])]
    first = ingest.import_csv(spark, csv(root / "a.csv", rows), str(root / "d"), dataset_id="one")
    return root, rows, first, spark.read.parquet(str(root / "d"))


def test_import_and_changes(spark, shop):
    root, rows, first, images = shop
    assert not first.blocked and first.rows == 6
    broken = ingest.import_csv(spark, csv(root / "b.csv", [("s1", "", "k", "u", "n", "v", 1)]), str(root / "x"))
    assert broken.blocked and "packing_list_id: 1 blank" in broken.errors
    rows2 = [rows[0], (*rows[1][:4], "New name", *rows[1][5:]), (rows[2][0], "b2", "other", *rows[2][3:]), ("s9", "b9", "k9", "http://h/9", "Nine", "V9", 1)]
    second = ingest.import_csv(spark, csv(root / "c.csv", rows2), str(root / "d2"), baseline=images, dataset_id="two")
    assert second.warnings and not second.blocked
    classes = {r.company_stone_id: r.change_class for r in ingest.plan_enrichment(spark.read.parquet(str(root / "d2")), images).collect()}
    assert classes == {"s0": "UNCHANGED", "s1": "CHANGED_METADATA", "s2": "CHANGED_IMAGE", "s9": "NEW"}
    assert {r.change_class for r in ingest.plan_enrichment(images, None).collect()} == {"NEW"}


def test_enrich(spark, shop):
    images = shop[3]
    ledger = spark.createDataFrame([("s0",)], "company_stone_id string")

    def analyse(df):
        return df.select("company_stone_id", "image_asset_id", F.col("ingest_seq").alias("seq"), F.lit("veiny").alias("design"), F.lit(0.8).alias("design_conf"), F.lit("red").alias("base_color"), F.lit(0.7).alias("base_color_conf"), F.lit("warm").alias("tonality"), F.lit(0.6).alias("tonality_conf"), F.lit(1.0).alias("weight"))

    classes = ingest.plan_enrichment(images, None)
    got = ingest.enrich(images, classes, analyse, ledger).collect()
    assert len(got) == 15 and {r.value for r in got if r.field == "pattern_family"} == {"veined"}
    assert ingest.enrich(images, classes, analyse, ledger, dry_run=True) is None
    log = spark.createDataFrame([("one", 1, "cv"), ("one", 2, "done")], "dataset_id string, seq long, stage string")
    assert ingest.progress(log).first().stage == "done"
    bad = spark.createDataFrame([("s1", "E" * 300, "m"), ("s2", None, None)], "company_stone_id string, error_class string, error_message string")
    assert len(ingest.failed(bad, "r", "cv").first().error_class) == 200


def test_enrichment_in_stages(spark, tmp_path):
    from catalyte.plans.staged import StagedRun
    from catalyte.sources.results import ResultStore

    rows = [("s0", "k0", 1, b"red"), ("s0", "k1", 2, b"blue"), ("s1", "k2", 1, b"red"), ("s2", "k3", 1, b"bad"), ("s2", "k4", 2, None), ("s4", "k5", 1, b"red"), ("s5", "k6", 1, b"far")]
    images = spark.createDataFrame(rows, "company_stone_id string, image_asset_id string, seq long, content binary").withColumn("content_md5", F.md5("content"))
    changes = [("s0", "NEW"), ("s1", "CHANGED_IMAGE"), ("s2", "NEW"), ("s3", "NEW"), ("s4", "CHANGED_METADATA"), ("s5", "UNCHANGED")]
    classes = spark.createDataFrame([(k, 1, c) for k, c in changes], "company_stone_id string, n_images long, change_class string")
    seen, killed = [], [True]

    def analyse(one):
        seen.append(sorted(bytes(r.content) for r in one.select("content").collect()))
        bad = F.when(F.col("content") == b"bad", F.lit("ValueError: no image"))
        return one.select("content_md5", F.lit("veiny").alias("design"), F.lit(0.8).alias("design_conf"), F.col("content").cast("string").alias("base_color"), F.lit(0.7).alias("base_color_conf"), F.lit("dark").alias("tonality"), F.lit(0.6).alias("tonality_conf"), F.lit(1.0).alias("weight"), bad.alias("error"))

    def encode(one):
        if killed.pop() if killed else False:
            raise RuntimeError("killed")
        return one.filter("content <> 'bad'").select("content_md5", F.array(F.lit(3.0), F.length("content").cast("double")).alias("vec"))

    def go():
        run = StagedRun(spark, str(tmp_path / "runs"), "r1", "company_stone_id")
        stores = [ResultStore(spark, str(tmp_path / n), "content_md5", v, {"version": 1, "max_pixels": 9}) for n, v in (("cv", ingest.ANALYSIS), ("emb", ingest.VECTOR))]
        return run, ingest.enrich_run(run, images, classes, analyse, encode, *stores, most_attempts=1)

    with pytest.raises(RuntimeError):
        go()
    assert seen == [[b"bad", b"blue", b"red"]]
    run, states = go()
    assert seen[1:] == []  # the first stage was over, the last one finds its contents stored
    assert states["cv"]["counts"] == {"ok": 2, "failed": 1, "skipped": 1, "n_images": 5, "hits": 0, "misses": 5} and all(s["complete"] for s in states.values())
    assert states["metadata"]["counts"] == {"ok": 1, "failed": 0, "skipped": 0, "n_images": 1, "hits": 1, "misses": 0}
    assert {r.company_stone_id: r.status for r in run.ledger("embeddings").collect()} == {"s0": "ok", "s1": "ok", "s2": "failed", "s3": "skipped"}
    (bad,) = run.failures("cv").collect()
    assert (bad.company_stone_id, bad.error_class, bad.error_message, bad.attempts) == ("s2", "ValueError", "ValueError: no image", 1)
    got = {r.company_stone_id: r for r in run.results("embeddings").collect()}
    assert got["s1"].vec == pytest.approx([0.7071068, 0.7071068]) and set(got) == {"s0", "s1"}
    tags = {(r.entity_id, r.field): r.value for r in ingest.print_tags(run.results("cv").unionByName(run.results("metadata"))).collect()}
    assert tags[("s0", "pattern_family")] == "veined" and tags[("s4", "base_color")] == "red" and len(tags) == 9


def test_catalogue(spark, shop):
    images = shop[3]
    ai = spark.createDataFrame([("s0", "base_color", "red", 0.9), ("s1", "base_color", "green", 0.8), ("s3", "base_color", "white", 0.9), ("s4", "main_color", "red", 0.5), ("s0", "busyness", "not a number", 0.5), ("s1", "accent_colors", '[{"color": "Gold", "strength": 0.5}]', 0.9)], "entity_id string, field string, value string, confidence double")
    vecs = spark.createDataFrame([(f"s{k}", [1.0, float(k)]) for k in range(5)], "entity_id string, vec array<double>")
    shop_ = catalogue.Catalogue(images, {"ai": ai, "override": ai.filter("entity_id = 's3'")}, vecs)
    page, facets = shop_.search(search.Request(base_colors=["red"]), v3=True)
    assert [r.item for r in page.orderBy("position").collect()][:2] == ["s4", "s0"]  # equal scores: the newest first
    assert {(r.facet, r.value): r.n for r in facets.collect()}[("base_color", "red")] == 2
    top, _ = shop_.search(search.Request(query="red marble"))
    assert top.orderBy("position").first()["item"] == "s4"
    assert "has_override" not in shop_.public(page).columns
    by_vector = shop_.search_by_vector([1.0, 4.0], search.Request())
    assert by_vector.count() == 6
    assert [r.entity_id for r in shop_.visual_similar("s0", 2).collect()] == ["s1", "s2"]
    with pytest.raises(KeyError):
        shop_.visual_similar("s5")
    assert shop_.resolve_similar("s0").count() <= 4 and shop_.resolve_similar("s5").count() == 0
    rows, log = catalogue.correction("s0", "base_color", "pink", "me", spark)
    assert rows.count() == log.count() == 1


def test_import_leaves_a_row_of_its_version(spark, tmp_path):
    good = [(f"s{k}", f"b{k}", f"k{k}", f"http://h/{k}", f"Stone {k}", "V", 1) for k in range(3)]
    ingest.import_csv(spark, csv(tmp_path / "good.csv", good), str(tmp_path / "d"), dataset_id="one", datasets=str(tmp_path / "sets"))
    ingest.import_csv(spark, csv(tmp_path / "bad.csv", [("s1", "", "k", "u", "n", "v", 1)]), str(tmp_path / "d"), dataset_id="two", datasets=str(tmp_path / "sets"))
    rows = {r.dataset_id: r for r in spark.read.parquet(str(tmp_path / "sets")).collect()}
    assert (rows["one"].validation_status, rows["one"].unique_images, rows["one"].unique_batches, rows["one"].activation_blocked) == ("validated", 3, 3, False)
    assert (rows["two"].validation_status, rows["two"].unique_images, rows["two"].activation_blocked, rows["two"].rows_read) == ("blocked", 0, True, 1)
    assert "packing_list_id: 1 blank" in rows["two"].validation_summary and rows["one"].source_filename == "good.csv"


def test_fitted_logistic_model_separates_labels(spark):
    from catalyte.operators import vectors

    rows = [(k, k % 3, [float(k % 3 == j) + 0.01 * (k % 7) for j in range(3)]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>")
    model = vectors.fit_logistic(df, "label", "vec")
    got = {r.id: r for r in vectors.logistic_classifier(df, model, "id", "label", "vec", n_training=60).collect()}
    assert all(r.predicted == k % 3 and 0.5 < r.confidence <= 0.85 for k, r in got.items())


def test_similar_payload(spark, shop, tmp_path):
    images = shop[3]
    part = spark.createDataFrame([(f"s{k}", "main_color", c, 1.0) for k, c in enumerate(("navy", "navy", "blue", "red", "navy", "navy"))], "entity_id string, field string, value string, confidence double")
    vecs = spark.createDataFrame([(f"s{k}", [1.0, k / 10]) for k in range(6)], "entity_id string, vec array<double>")
    shown = catalogue.Catalogue(images, {"ai": part}, embeddings=vecs)
    got = shown.similar_payload("b0")
    assert got["anchor"]["item"] == "s0" and got["anchor"]["known"] and got["meta"]["anchor_color"] == "navy"
    found = got["sections"]["section_c"]
    assert got["meta"]["section_c_count"] == len(found) == 4 and "s3" not in {r["item"] for r in found} and got["sections"]["section_a"] == []
    assert shown.similar_payload("nothing")["anchor"] == {"item": "nothing", "known": False}
    shown.log_similar("b0", got, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).first().n_shown == 4
    meta = shown.search_meta(search.Request()).first()
    assert meta.distinct_vendor_count == 6 and meta.vendor_cap_applied and not meta.needs_tags
