"""Every query of the library over the driver's tables, each with the SQL that gives the same rows.

The driver has no catalogue, so its tables stand in: a part is an item, a line item an image
of it, events are votes, logs and queue attempts, embeddings are image vectors. Expressions
that only rename or derive such columns are shared between both sides as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import colors, encoders, fuzzy, imaging, patches, text
from .operators import incremental, ingest, ops, search, similar, tags, vectors, votes
from .plans.staged import StagedRun
from .sources import csv_contract, keyed
from .sources.results import ResultStore
from .sources.scratch import scratch
from .streaming import events as stream
from .streaming import queue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def derived(table: str, columns: dict[str, str]) -> str:
    return f"(SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table})"


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


# --- stand-ins, valid in both dialects -------------------------------------------------

IMAGES = {
    "entity": "l_partkey",
    "image": "l_orderkey * 8 + l_linenumber",
    "batch": "l_orderkey",
    "vendor": "l_suppkey",
    "line": "l_linenumber",
    "label": "l_returnflag",
    "tone": "l_linestatus",
    "weight": "1 - l_discount",
    "confidence": "l_quantity / 50",
    "price": "l_extendedprice",
    "tax": "l_tax",
    "shipped": "l_shipdate",
}
ITEMS = {
    "item": "p_partkey",
    "name": "p_name",
    "vendor": "CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_brand END",
    "family": "lower(p_type)",
    "block": "p_size",
    "ingest_seq": "p_partkey",
    "thumbnail": "CASE WHEN p_size % 5 <> 0 THEN 'x' END",
    "bg_color": "CASE WHEN p_partkey % 13 = 0 THEN 'rose' END",
    "base_color": "CASE p_partkey % 7 WHEN 0 THEN 'white' WHEN 1 THEN 'beige' WHEN 2 THEN 'grey' WHEN 3 THEN 'black' WHEN 4 THEN 'brown' WHEN 5 THEN 'green' END",
    "base_color_confidence": "CAST(p_partkey % 10 AS DOUBLE) / 10",
    "main_color": "CASE p_partkey % 6 WHEN 0 THEN 'red' WHEN 1 THEN 'navy' WHEN 2 THEN 'charcoal' WHEN 3 THEN 'ivory' WHEN 4 THEN 'gold' END",
    "main_color_confidence": "CAST(p_partkey % 9 AS DOUBLE) / 10",
    "dominant_hue": "CASE p_size % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'brown' WHEN 2 THEN 'red' END",
    "dominant_hue_confidence": "CAST(p_size % 10 AS DOUBLE) / 10",
    "tone": "CASE p_size % 3 WHEN 0 THEN 'warm' WHEN 1 THEN 'cool' END",
    "tone_confidence": "CAST(p_size % 5 AS DOUBLE) / 5",
    "pattern_family": "CASE p_partkey % 8 WHEN 0 THEN 'web' WHEN 1 THEN 'linear' WHEN 2 THEN 'breccia' WHEN 3 THEN 'uniform' WHEN 4 THEN 'bold veined' END",
    "stone_lightness": "CASE WHEN p_size < 17 THEN 'dark' WHEN p_size < 34 THEN 'mid' ELSE 'light' END",
    "lightness_mean": "CAST(p_size * 2 AS DOUBLE)",
    "busyness": "CAST(p_size - 1 AS DOUBLE) / 49",
    "cloudiness": "CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS DOUBLE) / 50 END",
    "cloudiness_confidence": "CAST(p_partkey % 11 AS DOUBLE) / 10",
    "bold_veined": "p_partkey % 19 = 0",
    "has_override": "p_partkey % 10 = 0",
}
VOTES = {"seq": "event_id", "ts": "ts", "a": "user_id % 40", "b": "CAST(floor(value) AS BIGINT) % 40", "vote": "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END"}
RUNS = {
    "seq": "event_id",
    "run_id": "event_id",
    "track": "user_id % 7",
    "ts": "ts",
    "kind": "CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'signup' THEN 'preview' ELSE 'other' END",
}
ATTEMPTS = {"job": "user_id % 5", "key": "user_id", "task": "user_id % 40 * 100 + extract(hour FROM ts)", "ts": "ts", "seq": "event_id", "ok": "event_type = 'purchase'", "failed": "event_type <> 'purchase'", "error": "CASE WHEN event_type = 'error' THEN 'http|' || props WHEN event_type = 'view' THEN 'plain ' || props END"}
IMG, ITM, VOT, RUN, ATT = derived("lineitem", IMAGES), derived("part", ITEMS), derived("events", VOTES), derived("events", RUNS), derived("events", ATTEMPTS)
#: A total order of images: keys repeat, whole rows do not.
ORDER = ["image", "vendor", "entity", "price", "shipped"]
SPLIT = "TIMESTAMP '1997-01-01 00:00:00'"


def images(spark, d):
    return derive(read(spark, d, "lineitem"), IMAGES)


def items(spark, d):
    return derive(read(spark, d, "part"), ITEMS).withColumn("accents", F.array().cast("array<string>"))


def layers(spark, d) -> dict[str, DataFrame]:
    """Four tag layers of three fields."""
    part = read(spark, d, "part")
    return {name: part.selectExpr(f"stack(3, {', '.join(v)}) AS (field, value, confidence)", "p_partkey AS entity_id").select("entity_id", "field", "value", "confidence").filter(where) for name, where, v in LAYERS}


def _layer(name: str, where: str, salt: int):
    pairs = [f"'pattern_family', CASE (p_partkey + {salt}) % 4 WHEN 0 THEN 'linear' WHEN 1 THEN '' WHEN 2 THEN 'breccia' END, CAST((p_partkey + {salt}) % 10 AS DOUBLE) / 10"]
    pairs += [f"'{f}', CASE (p_partkey + {salt + k}) % 3 WHEN 0 THEN 'white' WHEN 1 THEN 'grey' END, CAST(p_partkey % {5 + k} AS DOUBLE) / 10" for k, f in enumerate(("base_color", "tone"))]
    return name, where, pairs


LAYERS = [_layer("ai", "true", 0), _layer("manual", "entity_id % 7 = 0", 1), _layer("aggregated", "entity_id % 3 <> 0", 2), _layer("override", "entity_id % 10 = 0", 3)]
TAGS = "(" + " UNION ALL ".join(f"SELECT * FROM (SELECT p_partkey AS entity_id, {f.split(', ', 1)[0]} AS field, {f.split(', ', 1)[1].rsplit(', CAST', 1)[0]} AS value, CAST{f.rsplit(', CAST', 1)[1]} AS confidence, '{n}' AS layer FROM part) WHERE {w}" for n, w, fs in LAYERS for f in fs) + ")"
RESOLVED = f"""(SELECT entity_id, field, value, confidence, layer AS source FROM {TAGS} WHERE nullif(trim(value), '') IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY entity_id, field ORDER BY CASE WHEN field = 'pattern_family'
        THEN CASE layer WHEN 'ai' THEN 1 WHEN 'aggregated' THEN 2 WHEN 'manual' THEN 3 ELSE 4 END
        ELSE CASE layer WHEN 'ai' THEN 1 WHEN 'manual' THEN 2 WHEN 'aggregated' THEN 3 ELSE 4 END END DESC) = 1)"""


def all_tags(spark, d):
    return tags.union_layers(layers(spark, d))


# --- ingest ----------------------------------------------------------------------------


@query(f"SELECT entity, count(*) AS n, max(image) AS image FROM {IMG} GROUP BY 1")
def entity_scan(spark, d):
    """A projected scan with its newest image."""
    return images(spark, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max("image").alias("image"))


_VERSIONS = {
    "dataset_id": "CAST(extract(year FROM o_orderdate) AS VARCHAR(4))",
    "image_asset_id": "o_orderkey",
    "company_stone_id": "o_custkey",
    "image_url": "o_orderpriority",
    "stone_name_raw": "o_orderstatus",
    "vendor": "o_orderstatus",
    "batch_id": "o_totalprice",
    "created_at": "o_orderdate",
}


@query(f"""WITH v AS {derived('orders', _VERSIONS)}, a AS (SELECT * FROM v WHERE dataset_id = (SELECT max(dataset_id) FROM v))
    SELECT company_stone_id, image_asset_id, image_url AS url, batch_id, vendor FROM a""")
def active_manifest(spark, d):
    """SRC4-6, SRC16: orders are written as versions by year; of the newest, as none is active, the manifest and the ordered scan are read."""
    root, v = scratch(spark, "versions"), derive(read(spark, d, "orders"), _VERSIONS)
    csv_contract.write_dataset(v, root)
    datasets = v.groupBy("dataset_id").agg(F.max("created_at").alias("created_at")).withColumn("is_active", F.lit(False))
    newest = csv_contract.active_dataset(datasets, newest=True)
    rows = csv_contract.read_dataset(spark, root, newest) if newest else v.limit(0)
    return csv_contract.manifest(rows).join(csv_contract.image_scan(rows).select("image_asset_id", "vendor"), "image_asset_id")


@query(f"SELECT entity, image, vendor, price FROM {IMG} QUALIFY row_number() OVER (PARTITION BY entity ORDER BY image DESC, vendor DESC, price DESC) = 1")
def latest_per_entity(spark, d):
    """WIN1."""
    return ingest.latest(images(spark, d), "entity", "image", ["vendor", "price"])


@query(f"SELECT image, entity, vendor, price FROM {IMG} QUALIFY row_number() OVER (PARTITION BY image ORDER BY {', '.join(ORDER)}) = 1")
def first_wins_dedupe(spark, d):
    """WIN2."""
    return ingest.first_wins(images(spark, d), ["image"], ORDER).select("image", "entity", "vendor", "price")


@query(f"SELECT count(*) AS n_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_extra FROM (SELECT image, count(*) AS n FROM {IMG} GROUP BY 1 HAVING count(*) > 1)")
def duplicate_keys(spark, d):
    """AGG5."""
    return ingest.duplicate_keys(images(spark, d), ["image"])


@query(
    """SELECT p_brand AS entity, count(*) AS n_names, array_to_string(list_sort(list(n))[1:3], '|') AS first_names
    FROM (SELECT DISTINCT p_brand, lower(trim(p_name)) AS n FROM part WHERE trim(p_name) <> '') GROUP BY 1 HAVING count(*) > 1"""
)
def identity_collision(spark, d):
    """AGG4."""
    return ingest.identity_collisions(read(spark, d, "part"), "p_brand", "p_name").withColumnRenamed("p_brand", "entity")


@query(f"SELECT batch, count(DISTINCT vendor) AS n_members FROM {IMG} GROUP BY 1 HAVING count(DISTINCT vendor) > 1")
def having_collision(spark, d):
    """AGG3."""
    return ingest.collisions(images(spark, d), "batch", "vendor")


@query(" UNION ALL ".join(f"SELECT '{c}' AS what, count(DISTINCT {c}) AS n FROM {IMG}" for c in ("entity", "image", "batch", "vendor")))
def distinct_counts(spark, d):
    """AGG2."""
    return ingest.distinct_counts(images(spark, d), {c: c for c in ("entity", "image", "batch", "vendor")})


@query(
    f"""WITH b AS (SELECT batch, count(DISTINCT entity) AS e, count(DISTINCT label) AS n FROM {IMG} GROUP BY 1)
    SELECT count(*) AS n_batches, round(100 * avg(CASE WHEN e = 1 THEN 1.0 ELSE 0.0 END), 4) AS pct_single_entity,
        round(100 * avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 4) AS pct_single_name,
        (SELECT count(*) FROM {IMG} WHERE lower(tone) = lower(label)) AS n_polluted, (SELECT count(DISTINCT tone) FROM {IMG}) AS n_vendors FROM b"""
)
def import_report(spark, d):
    """AGG7, X3."""
    return ingest.vendor_report(images(spark, d), "tone", "batch", "entity", "label")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top_vendors(spark, d):
    """SRT8: a top-k report."""
    return ingest.top_groups(read(spark, d, "part"), "p_brand", 10)


@query(
    f"""WITH i AS {IMG}, a AS (SELECT * FROM i WHERE shipped < {SPLIT}), b AS (SELECT * FROM i WHERE shipped >= {SPLIT}), k AS (
    """
    + " UNION ALL ".join(
        f"""SELECT '{k}' AS kind, (SELECT count(DISTINCT {c}) FROM a) AS n_before, (SELECT count(DISTINCT {c}) FROM b) AS n_after,
        (SELECT count(*) FROM (SELECT {c} FROM a INTERSECT SELECT {c} FROM b)) AS n_both, {strict} AS strict"""
        for k, c, strict in (("item", "entity", "false"), ("batch", "batch", "false"), ("vendor", "vendor", "true"))
    )
    + """) SELECT kind, n_before, n_after, n_both, n_before - n_both AS n_gone, n_after - n_both AS n_new,
        round(100 * (n_before - n_both) / nullif(n_before, 0), 4) AS pct_gone, round(100 * (n_after - n_both) / nullif(n_after, 0), 4) AS pct_new,
        coalesce((CASE WHEN strict THEN n_before - n_both >= 1 ELSE 100 * (n_before - n_both) / nullif(n_before, 0) >= 10 END) OR 100 * (n_after - n_both) / nullif(n_after, 0) >= 30, false) AS warned FROM k"""
)
def continuity_sets(spark, d):
    """SET1-2."""
    i = images(spark, d)
    return ingest.continuity(i.filter(f"shipped < {SPLIT}"), i.filter(f"shipped >= {SPLIT}"), {"item": ("entity", False), "batch": ("batch", False), "vendor": ("vendor", True)})


CONTRACT = {"name": "CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_name END", "vendor": "CASE WHEN p_size = 7 THEN NULL ELSE p_brand END", "family": "p_type"}


@query(" UNION ALL ".join(f"SELECT '{f}' AS field, count(CASE WHEN coalesce(trim({f}), '') = '' THEN 1 END) AS n_errors FROM {derived('part', CONTRACT)}" for f in CONTRACT))
def row_contract(spark, d):
    """FLT9."""
    return ingest.row_contract(derive(read(spark, d, "part"), CONTRACT), list(CONTRACT))


@query("SELECT page_id, url FROM pages WHERE NOT coalesce(regexp_matches(url, '^https?://[a-m]'), false)")
def url_sanity(spark, d):
    """FLT10, with a narrower pattern so that some rows fail."""
    return ingest.bad_urls(read(spark, d, "pages"), "url", "^https?://[a-m]").select("page_id", "url")


@query(
    f"""SELECT entity, batch, image FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY batch, {', '.join(ORDER)}) AS k FROM
    (SELECT * FROM {IMG} QUALIFY row_number() OVER (PARTITION BY entity, batch ORDER BY {', '.join(ORDER)}) = 1)) WHERE k <= 5"""
)
def sample_per_batch(spark, d):
    """WIN4."""
    return ingest.sample_per_batch(images(spark, d), "entity", "batch", ORDER, 5).select("entity", "batch", "image")


@query(
    f"""SELECT vendor, line, image, price FROM (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY CASE WHEN b > 5 THEN 1 ELSE 0 END, md5(concat_ws('|', image, vendor, entity, '42')), {', '.join(ORDER)}) AS e
    FROM (SELECT *, row_number() OVER (PARTITION BY vendor, line ORDER BY {', '.join(ORDER)}) AS b FROM {IMG})) WHERE b <= 5 OR e <= 60"""
)
def block_floor_cap(spark, d):
    """WIN5: the fill is by a seeded md5."""
    return ingest.floor_and_cap(images(spark, d), "vendor", "line", ORDER, floor=5, cap=60, by=["image", "vendor", "entity"]).select("vendor", "line", "image", "price")


@query(
    f"""WITH i AS {IMG}, p AS (SELECT vendor, count(DISTINCT batch) AS blocks, count(*) AS images FROM i WHERE shipped >= {SPLIT} GROUP BY 1)
    SELECT count(*) AS n_entities, count(CASE WHEN blocks > 10 THEN 1 END) AS n_multi_block, count(CASE WHEN images > 200 THEN 1 END) AS n_large,
        count(CASE WHEN vendor IN (SELECT vendor FROM i WHERE shipped < {SPLIT}) THEN 1 END) AS n_known,
        (SELECT count(DISTINCT label) FROM i WHERE shipped >= {SPLIT}) AS n_vendors FROM p"""
)
def pre_import_analysis(spark, d):
    """AGG23."""
    i = images(spark, d)
    return ingest.analyse(i.filter(f"shipped >= {SPLIT}"), i.filter(f"shipped < {SPLIT}"), "vendor", "label", "batch")


# --- incremental -----------------------------------------------------------------------

_SIG = """SELECT entity, substr(md5(CAST(to_json(list_sort(list([CAST(image AS VARCHAR), CAST(vendor AS VARCHAR)]))) AS VARCHAR)), 1, 16) AS image_hash,
    substr(md5(arg_min(label || '|' || tone, (image, vendor, price))), 1, 16) AS metadata_hash, count(*) AS n_images FROM {0} GROUP BY 1"""


def _signatures(df):
    return incremental.signatures(df, "entity", ["image", "vendor"], ["label", "tone"], ["image", "vendor", "price"])


def _versions(spark, d):
    """A baseline and a candidate: two thirds of the items lose their latest images or change order status."""
    i = images(spark, d)
    return i.filter("entity % 4 <> 0"), i.filter("NOT (entity % 3 = 0 AND shipped >= TIMESTAMP '1998-06-01 00:00:00')").withColumn("tone", F.when(F.col("entity") % 5 == 0, "X").otherwise(F.col("tone")))


_OLD = f"(SELECT * FROM {IMG} WHERE entity % 4 <> 0)"
_NEW = f"(SELECT * REPLACE (CASE WHEN entity % 5 = 0 THEN 'X' ELSE tone END AS tone) FROM {IMG} WHERE NOT (entity % 3 = 0 AND shipped >= TIMESTAMP '1998-06-01 00:00:00'))"
_CLASSES = f"""(WITH o AS ({_SIG.format(_OLD)}), n AS ({_SIG.format(_NEW)}) SELECT n.entity, n.n_images,
    CASE WHEN o.image_hash IS NULL THEN 'NEW' WHEN n.image_hash <> o.image_hash THEN 'CHANGED_IMAGE' WHEN n.metadata_hash <> o.metadata_hash THEN 'CHANGED_METADATA' ELSE 'UNCHANGED' END AS change_class
    FROM n LEFT JOIN o USING (entity))"""


def _classes(spark, d):
    old, new = _versions(spark, d)
    return incremental.classify(_signatures(new), _signatures(old), "entity")


@query(_SIG.format(IMG))
def image_set_hash(spark, d):
    """AGG20-21, X5."""
    return _signatures(images(spark, d))


@query(f"SELECT * FROM {_CLASSES}")
def change_classes(spark, d):
    """JN8."""
    return _classes(spark, d)


@query(f"SELECT change_class, count(*) AS n_entities, CAST(sum(n_images) AS BIGINT) AS n_images FROM {_CLASSES} GROUP BY 1")
def change_summary(spark, d):
    """AGG22."""
    return incremental.summary(_classes(spark, d))


@query(f"SELECT entity FROM {_CLASSES} WHERE change_class IN ('NEW', 'CHANGED_IMAGE') AND entity NOT IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def ledger_anti_join(spark, d):
    """JN9, X6."""
    todo = incremental.work(_classes(spark, d), "embeddings").select("entity")
    return incremental.not_done(todo, read(spark, d, "part").filter("p_size < 20").select(F.col("p_partkey").alias("entity")), ["entity"])


# --- tags ------------------------------------------------------------------------------


@query(f"SELECT * FROM {RESOLVED}")
def tag_resolution(spark, d):
    """SET5, AGG6, JN1."""
    return tags.resolve(all_tags(spark, d))


@query(f"""SELECT entity_id, max(CASE WHEN field = 'base_color' THEN value END) AS base_color, max(CASE WHEN field = 'base_color' THEN confidence END) AS base_color_confidence,
    max(CASE WHEN field = 'tone' THEN value END) AS tone, max(CASE WHEN field = 'tone' THEN confidence END) AS tone_confidence FROM {RESOLVED} WHERE field IN ('base_color', 'tone') GROUP BY 1""")
def tag_pivot(spark, d):
    """JN2-3."""
    return tags.pivot(tags.resolve(all_tags(spark, d)), ["base_color", "tone"])


@query(f"SELECT entity_id, count(*) AS n_tags FROM {RESOLVED} GROUP BY 1")
def display_tag_counts(spark, d):
    """FLT12, X12: the tag map."""
    return tags.display_tags(tags.resolve(all_tags(spark, d))).select("entity_id", F.size("tags").cast("long").alias("n_tags"))


@query(f"SELECT field, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities FROM {TAGS} GROUP BY 1")
def tag_census(spark, d):
    """AGG17."""
    return tags.census(all_tags(spark, d))


@query(f"""WITH a AS (SELECT field, count(*) AS n FROM {TAGS} WHERE layer <> 'override' AND field <> 'tone' GROUP BY 1), b AS (SELECT field, count(*) AS n FROM {TAGS} GROUP BY 1)
    SELECT coalesce(a.field, b.field) AS field, a.n AS before_rows, b.n AS after_rows FROM a FULL JOIN b ON a.field = b.field WHERE a.n IS DISTINCT FROM b.n""")
def snapshot_diff(spark, d):
    """AGG18."""
    t = all_tags(spark, d)
    return tags.census_diff(tags.census(t.filter("layer <> 'override' AND field <> 'tone'")), tags.census(t))


@query(f"""WITH w AS (SELECT DISTINCT entity_id FROM {RESOLVED} WHERE field = 'base_color')
    SELECT count(*) AS n_cohort, count(w.entity_id) AS n_with, round(count(w.entity_id) / count(*), 6) AS share, count(w.entity_id) / count(*) >= 0.95 AS passed FROM part LEFT JOIN w ON p_partkey = w.entity_id""")
def coverage_gate(spark, d):
    """AGG19."""
    return tags.coverage(read(spark, d, "part").select(F.col("p_partkey").alias("entity_id")), tags.resolve(all_tags(spark, d)), "base_color")


@query(f"SELECT p_partkey AS entity_id FROM part WHERE p_partkey NOT IN (SELECT entity_id FROM {RESOLVED} WHERE field = 'base_color')")
def missing_tag_anti(spark, d):
    """JN5."""
    return tags.missing_tag(read(spark, d, "part").select(F.col("p_partkey").alias("entity_id")), tags.resolve(all_tags(spark, d)), "base_color")


@query(f"SELECT DISTINCT entity_id FROM {RESOLVED} WHERE field = 'tone' AND entity_id NOT IN (SELECT entity_id FROM {RESOLVED} WHERE field = 'pattern_family')")
def has_a_not_b(spark, d):
    """JN6."""
    return tags.has_a_not_b(tags.resolve(all_tags(spark, d)), "tone", "pattern_family")


@query(f"SELECT entity_id, field, value FROM {RESOLVED} WHERE field IN ('base_color', 'tone') AND NOT (field = 'base_color' AND value IN ('white', 'grey'))")
def vocabulary_check(spark, d):
    """FLT13, X25."""
    return tags.out_of_vocabulary(tags.resolve(all_tags(spark, d)), tags.vocabulary(spark)).select("entity_id", "field", "value")


@query(f"""SELECT item, CASE WHEN item % 6 = 0 AND base_color_confidence < 0.4 THEN NULL ELSE base_color END AS base_color,
    CASE WHEN item % 6 = 0 AND main_color_confidence < 0.4 THEN NULL ELSE main_color END AS main_color FROM {ITM}""")
def suppression(spark, d):
    """FLT5."""
    i = items(spark, d).withColumnRenamed("item", "entity_id")
    out = tags.suppress(i, i.filter("entity_id % 6 = 0").select("entity_id"), fields=("base_color", "main_color"))
    return out.select(F.col("entity_id").alias("item"), "base_color", "main_color")


@query(f"SELECT DISTINCT entity FROM {IMG} WHERE entity IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def existence_semi(spark, d):
    """JN7, JN16, X2."""
    ids = read(spark, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("entity"))
    return images(spark, d).select("entity").distinct().join(ids, "entity", "left_semi")


# --- votes -----------------------------------------------------------------------------

_SCORES = f"(SELECT entity, label, round(sum(confidence * weight), 6) AS s, min(image) AS seen FROM {IMG} GROUP BY 1, 2)"


@query(f"""SELECT entity, arg_max(label, (s, -seen)) AS label, round(least(max(s) / (sum(s) + 1e-6), 0.99), 6) AS confidence FROM {_SCORES} GROUP BY 1""")
def weighted_vote_single(spark, d):
    """AGG8."""
    return votes.vote(images(spark, d), "entity", "label", "confidence", "weight", "image")


@query(f"""WITH r AS (SELECT entity, label, s, max(s) OVER (PARTITION BY entity) AS top, sum(s) OVER (PARTITION BY entity) AS total,
        row_number() OVER (PARTITION BY entity ORDER BY s DESC, label) AS k
        FROM (SELECT entity, l AS label, round(sum(confidence * weight), 6) AS s FROM (SELECT entity, confidence, weight, unnest([label, tone]) AS l FROM {IMG}) GROUP BY 1, 2))
    SELECT entity, string_agg(label, '|' ORDER BY k) AS labels, round(least(sum(s) / (count(*) * (max(total) + 1e-6)), 0.99), 6) AS confidence
    FROM r WHERE s >= 0.3 * top AND k <= 5 GROUP BY 1""")
def weighted_vote_multi(spark, d):
    """AGG9."""
    return votes.vote_many(images(spark, d).withColumn("labels", F.array("label", "tone")), "entity", "labels", "confidence", "weight")


@query(f"""WITH v AS (SELECT entity, arg_max(label, (s, -seen)) AS l, round(least(max(s) / (sum(s) + 1e-6), 0.99), 6) AS c FROM {_SCORES} GROUP BY 1),
    t AS (SELECT entity, arg_max(label, (s, -seen)) AS l, round(least(max(s) / (sum(s) + 1e-6), 0.99), 6) AS c FROM (SELECT entity, tone AS label, round(sum(confidence * weight), 6) AS s, min(image) AS seen FROM {IMG} GROUP BY 1, 2) GROUP BY 1)
    SELECT v.entity, CASE v.l WHEN 'A' THEN 'veiny' WHEN 'N' THEN 'spotty' ELSE 'exotic' END AS design, v.c AS design_conf, t.l AS base_color, t.c AS base_color_conf, t.l AS tonality, t.c AS tonality_conf,
        CASE WHEN v.l = 'A' THEN t.l END AS vein, CASE WHEN v.l = 'N' THEN t.l END AS spot, CASE WHEN v.l NOT IN ('A', 'N') THEN t.l END AS colors FROM v JOIN t USING (entity)""")
def fingerprint_rollup(spark, d):
    """AGG10."""
    i = images(spark, d)
    design = votes.vote(i, "entity", "label", "confidence", "weight", "image").withColumn("label", F.when(F.col("label") == "A", "veiny").when(F.col("label") == "N", "spotty").otherwise("exotic"))
    tone = votes.vote(i, "entity", "tone", "confidence", "weight", "image")
    return votes.fingerprint(design, tone, tone, tone, tone, tone.select("entity", F.col("label").alias("labels")), "entity")


@query(f"""WITH i AS (SELECT DISTINCT entity, image, tone, weight, confidence, tax FROM (SELECT * FROM {IMG} QUALIFY row_number() OVER (PARTITION BY image ORDER BY {', '.join(ORDER)}) = 1)),
    b AS (SELECT entity, arg_max((image, tone), (round(0.7 * weight + 0.3 * confidence, 6), -image)) AS b FROM i GROUP BY 1)
    SELECT i.entity, max(b.b[1]) AS rep, arg_min(CASE WHEN i.tone <> b.b[2] THEN image END, CASE WHEN i.tone <> b.b[2] THEN image END) AS variation,
        arg_max(CASE WHEN i.image <> b.b[1] THEN image END, CASE WHEN i.image <> b.b[1] THEN (round(tax, 6), -image) END) AS clarity FROM i JOIN b USING (entity) GROUP BY 1""")
def representative_image(spark, d):
    """AGG11."""
    one = ingest.first_wins(images(spark, d), ["image"], ORDER)
    return votes.representative(one, "entity", "image", "weight", "confidence", "tone", "tax", "image")


@query(f"""SELECT vendor, round(avg(price), 6) AS price_mean, round(stddev_pop(price), 6) AS price_std, round(avg(weight), 6) AS weight_mean, round(stddev_pop(weight), 6) AS weight_std FROM {IMG} GROUP BY 1""")
def debug_moments(spark, d):
    """AGG12."""
    return votes.moments(images(spark, d), "vendor", ["price", "weight"])


@query(f"SELECT entity, round(round(sum(CASE WHEN tax > 0 THEN tax * weight * 100 END) / sum(CASE WHEN tax > 0 THEN tax END), 6), 1) AS mean FROM {IMG} GROUP BY 1")
def weighted_mean_lightness(spark, d):
    """AGG30."""
    return votes.weighted_mean(images(spark, d).withColumn("l", F.col("weight") * 100), "entity", "l", "tax")


@query(f"""SELECT vendor, label, round(w / sum(w) OVER (PARTITION BY vendor), 6) AS share, n_cells FROM (SELECT vendor, label, sum(weight) AS w, count(DISTINCT line) AS n_cells FROM {IMG} GROUP BY 1, 2)""")
def cluster_shares(spark, d):
    """AGG31."""
    return votes.cluster_shares(images(spark, d), "vendor", "label", "weight", "line")


@query(f"""WITH r AS (SELECT entity, label, s, row_number() OVER (PARTITION BY entity ORDER BY s DESC, label) AS k FROM {_SCORES})
    SELECT entity, max(CASE WHEN k = 1 THEN label END) AS winner, max(CASE WHEN k = 2 THEN label END) AS runner_up, round(max(CASE WHEN k = 1 THEN s END) - coalesce(max(CASE WHEN k = 2 THEN s END), 0), 6) AS margin FROM r GROUP BY 1""")
def top2_margin(spark, d):
    """WIN9, ML5."""
    s = images(spark, d).groupBy("entity", "label").agg(F.round(F.sum(F.col("confidence") * F.col("weight")), 6).alias("s"))
    return votes.top_margin(s, "entity", "label", "s")


@query(f"""SELECT p_partkey AS entity, v.label, v.confidence, r.image FROM part LEFT JOIN (SELECT entity, arg_max(label, (s, -seen)) AS label, round(least(max(s) / (sum(s) + 1e-6), 0.99), 6) AS confidence FROM {_SCORES} GROUP BY 1) v ON v.entity = p_partkey
    LEFT JOIN (SELECT entity, max(image) AS image FROM {IMG} GROUP BY 1) r ON r.entity = p_partkey""")
def aggregate_left_join(spark, d):
    """JN4, JN14."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("entity"))
    i = images(spark, d)
    return p.join(votes.vote(i, "entity", "label", "confidence", "weight", "image"), "entity", "left").join(i.groupBy("entity").agg(F.max("image").alias("image")), "entity", "left")


# --- vectors ---------------------------------------------------------------------------

_CENTRE = """(SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH s AS (SELECT e.label, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 9) AS x FROM embeddings e JOIN {_CENTRE} USING (label))
    SELECT label, count(*) AS n_items, arg_max(vec_id, (x, -vec_id)) AS rep, round(median(x), 6) AS consistency, count(CASE WHEN x < 0.2 THEN 1 END) AS n_outliers FROM s GROUP BY 1""")
def embedding_centroid_stats(spark, d):
    """AGG13-14."""
    return vectors.centroid_stats(read(spark, d, "embeddings"), "label", "vec_id", "embedding", outlier=0.2)


@query("""WITH m AS (SELECT label, pos, sum((vec_id % 5 + 1) * CAST(embedding[pos] AS DOUBLE)) / sum(vec_id % 5 + 1) AS m FROM (SELECT label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY 1, 2)
    SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM m""")
def weighted_mean_vector(spark, d):
    """AGG15."""
    out = vectors.mean_vectors(read(spark, d, "embeddings").withColumn("w", F.col("vec_id") % 5 + 1), "label", "embedding", "w")
    return out.select("label", F.posexplode("vec").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def _anchor(spark, d, vec_id: int = 7):
    row = read(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


@query("""SELECT e.vec_id, round(greatest(0, least(1, (list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) + 1) / 2)), 6) AS similarity
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) a WHERE e.vec_id <> 7 ORDER BY similarity DESC, e.vec_id LIMIT 20""")
def visual_topk(spark, d):
    """SRT6, JN10, MTH6."""
    return vectors.nearest(read(spark, d, "embeddings"), _anchor(spark, d), "vec_id", "embedding", 20, exclude=7)


@query(f"""WITH p AS (SELECT label AS l, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM {_CENTRE}),
    s AS (SELECT vec_id, l, round(list_dot_product(CAST(embedding AS DOUBLE[]), c), 9) AS x FROM embeddings, p), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, l) AS k FROM s)
    SELECT vec_id, max(CASE WHEN k = 1 THEN l END) AS predicted, round(least(0.5 + max(CASE WHEN k = 1 THEN x END) - max(CASE WHEN k = 2 THEN x END), 0.95), 6) AS confidence FROM r GROUP BY 1""")
def prototype_classifier(spark, d):
    """ML14, WIN9."""
    e = read(spark, d, "embeddings")
    return vectors.prototype_classifier(e, vectors.mean_vectors(e, "label", "embedding"), "vec_id", "label", "embedding")


def _proto_sql(field: str, label: str) -> str:
    centre = _CENTRE.replace("SELECT label, embedding,", f"SELECT {label} AS label, embedding,")
    return f"""(WITH p AS (SELECT label AS l, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM {centre}),
    s AS (SELECT vec_id, l, round(list_dot_product(CAST(embedding AS DOUBLE[]), c), 9) AS x FROM embeddings, p), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, CAST(l AS VARCHAR)) AS k FROM s)
    SELECT vec_id, '{field}' AS field, CAST(max(CASE WHEN k = 1 THEN l END) AS VARCHAR) AS predicted, round(least(0.5 + max(CASE WHEN k = 1 THEN x END) - max(CASE WHEN k = 2 THEN x END), 0.85), 6) AS confidence FROM r GROUP BY 1)"""


_THREE = {"pattern_family": "label", "base_color": "label % 3", "tone": "label % 2"}


@query(" UNION ALL ".join(f"SELECT * FROM {_proto_sql(f, e)}" for f, e in _THREE.items()))
def predict_fields(spark, d):
    """ML15, ML14: three fields by their prototypes, on few training rows."""
    e = read(spark, d, "embeddings")
    protos = {f: vectors.mean_vectors(e.withColumn("label", F.expr(x)), "label", "embedding") for f, x in _THREE.items()}
    return vectors.predict_fields(e, protos, "vec_id", "embedding", n_training=50)


@query(f"""WITH m AS (SELECT label AS l, label * 0.1 AS b, list_transform(c, lambda x: 8 * x / sqrt(list_dot_product(c, c))) AS c FROM {_CENTRE}), z AS (SELECT vec_id, l, b + list_dot_product(CAST(embedding AS DOUBLE[]), c) AS z FROM embeddings, m),
    t AS (SELECT vec_id, arg_max(l, z) AS predicted, max(z) AS top, list(z) AS zs FROM z GROUP BY 1) SELECT vec_id, predicted, round(1 / list_sum(list_transform(zs, lambda x: exp(x - top))), 6) AS confidence FROM t""")
def logistic_classifier(spark, d):
    """ML14: the probability of a fitted model; here its coefficients are the prototypes, so that SQL knows them."""
    e = read(spark, d, "embeddings")
    model = vectors.mean_vectors(e, "label", "embedding").select("label", (F.col("label") * 0.1).alias("intercept"), F.transform("vec", lambda x: 8 * x).alias("coef"))
    return vectors.logistic_classifier(e, model, "vec_id", "label", "embedding")


@query("SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'cache' WHEN 1 THEN 'file' END AS source, CASE WHEN vec_id % 3 < 2 THEN round(CAST(embedding[2] AS DOUBLE), 6) END AS second FROM embeddings")
def vector_sources(spark, d):
    """SRC7-8: vectors from JSON text first, then from 32-bit floats; bad and cut-off ones are skipped."""
    e = read(spark, d, "embeddings")

    def raw(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            made = [np.array(v, "<f4").tobytes() + b"x" * (k % 3 == 2) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["vec_id", "raw"])

    cache = vectors.parse_vectors(e.select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.to_json("embedding")).otherwise("[1.0, oops").alias("raw")), "raw")
    file = vectors.parse_float32(e.select("vec_id", "embedding").mapInArrow(raw, "vec_id long, raw binary"), "raw")
    out = vectors.first_vector(e.select("vec_id"), {"cache": cache, "file": file}, "vec_id")
    return out.select("vec_id", "source", F.round(F.get("vec", F.lit(1)).cast("double"), 6).alias("second"))


@query("SELECT label, max(vec_id) AS vec_id FROM embeddings WHERE vec_id % 3 <> 0 GROUP BY 1")
def best_image_vector(spark, d):
    """X16: the highest finished image's vector, found again by its content."""
    e = read(spark, d, "embeddings").withColumn("status", F.when(F.col("vec_id") % 3 != 0, "DONE").otherwise("FAILED"))
    text_form = e.select("label", "vec_id", "status", F.to_json("embedding").alias("raw"))
    best = vectors.best_image_vector(vectors.parse_vectors(text_form, "raw").withColumn("v", F.struct("vec", "vec_id")), "label", "vec_id", "v", "status")
    return best.select("label", F.col("vec.vec_id").alias("vec_id"))


# --- names, colours --------------------------------------------------------------------


def _names(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", F.concat_ws(" ", "p_name", F.lit("Gray Polished"), F.concat(F.col("p_size").cast("string"), F.lit("cm")), "p_type").alias("name"))


_NAMES = "(SELECT p_partkey, p_name || ' Gray Polished ' || CAST(p_size AS VARCHAR) || 'cm ' || p_type AS name FROM part)"


@query(f"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(name)), 'gray', 'grey'), '\\bpolished\\b', '', 'g'), '\\b\\d+(\\.\\d+)?\\s*(cm|mm|in|inch|inches)?\\b', '', 'g'), '\\s+', ' ', 'g')) AS name FROM {_NAMES}")
def normalize_stone_name(spark, d):
    """STR1."""
    return _names(spark, d).withColumn("name", text.normalize_stone_name(F.col("name")))


@query(f"""SELECT p_partkey, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '\\b\\d+(?:\\.\\d+)?(?:cm|mm|x|\\s*x\\s*)\\b', ' ', 'g'), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '),
    lambda w: w <> '' AND w NOT IN ('stone', 'gem', 'natural', 'slab', 'tile', 'polished', 'honed', 'leathered', 'brushed', 'cm', 'mm', 'x', 'the', 'a', 'an') AND NOT regexp_full_match(w, '\\d+')), ' ') AS name FROM {_NAMES}""")
def normalize_name(spark, d):
    """STR3."""
    return _names(spark, d).withColumn("name", text.normalize_name(F.col("name")))


@query("""SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '),
    lambda w: w <> '' AND w NOT IN ('premium', 'extra', 'select', 'classic', 'super', 'first', 'choice', 'natural', 'stone', 'slab', 'tile', 'polished', 'honed', 'leathered', 'brushed', 'cm', 'mm', 'the', 'a', 'an', 'x') AND NOT regexp_full_match(w, '\\d+')), ' ') AS query FROM documents""")
def normalize_query(spark, d):
    """STR2."""
    return read(spark, d, "documents").select("doc_id", text.normalize_query(F.col("text")).alias("query"))


@query()
def fuzzy_name_score(spark, d):
    """STR4-8: the weighted ratio has no SQL; tests hold every name against a dynamic program."""
    wanted = text.parse_query("red hott brass")
    names = read(spark, d, "part").select(text.normalize_name(F.col("p_name")).alias("name")).distinct()
    return names.withColumn("f", fuzzy.name_scores(F.col("name"), wanted)).select("name", F.round("f.base", 6).alias("base"), F.round("f.weighted", 6).alias("weighted"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE url END AS url FROM pages")
def cdn_url_normalize(spark, d):
    """STR10: wrapped addresses come back as they were."""
    wrapped = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://img.example/cdn-cgi/image/width=400,quality=80/"), F.url_encode("url"))).otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", text.cdn_url(wrapped).alias("url"))


@query("SELECT event_id, least(CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR)) || '|' || greatest(CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR)) AS pair_key FROM events")
def pair_key(spark, d):
    """STR13."""
    return read(spark, d, "events").select("event_id", text.pair_key(F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("pair_key"))


@query(f"""SELECT item, CASE WHEN main_color = 'charcoal' THEN CASE dominant_hue WHEN 'red' THEN 'DARK_WARM_CHROMATIC' WHEN 'green' THEN 'DARK_COOL_CHROMATIC' ELSE 'TRUE_DARK' END
    WHEN main_color = 'navy' THEN CASE WHEN stone_lightness = 'light' THEN 'LIGHT_COOL' ELSE 'DARK_COOL' END WHEN main_color = 'red' THEN 'RED' WHEN main_color = 'ivory' THEN 'WHITE' WHEN main_color = 'gold' THEN 'GOLD' END AS family FROM {ITM}""")
def color_family(spark, d):
    """COL3."""
    return items(spark, d).select("item", colors.colour_family(F.col("main_color"), F.col("dominant_hue"), F.col("stone_lightness")).alias("family"))


@query(f"""SELECT item, CASE WHEN lightness_mean >= 65 THEN 'light' WHEN lightness_mean < CASE WHEN base_color IN ('black', 'charcoal', 'off-black', 'dark grey', 'dark brown', 'navy') THEN 50 ELSE 35 END THEN 'dark' ELSE 'mid' END AS band FROM {ITM}""")
def lightness_band(spark, d):
    """COL8, X10."""
    return items(spark, d).select("item", colors.lightness_band(F.col("lightness_mean"), F.col("base_color")).alias("band"))


@query("""WITH v AS (SELECT p_partkey, p_size * 40 AS vein, 100000 AS total, p_partkey % 50 AS gold, p_partkey % 31 AS green, p_partkey % 23 AS pink, p_size * 3 AS neutral, CAST(p_partkey % 100 AS DOUBLE) AS m FROM part),
    r AS (SELECT *, gold + green + pink AS c, greatest(gold, green, pink) AS top, gold + green + pink - greatest(gold, green, pink) - least(gold, green, pink) AS second,
        CASE WHEN gold >= green AND gold >= pink THEN 'gold' WHEN green >= pink THEN 'green' ELSE 'pink' END AS hue FROM v)
    SELECT p_partkey, CASE WHEN vein < 200 OR vein / total < 0.005 THEN 'none' WHEN c / nullif(c + neutral, 0) < 0.15 THEN CASE WHEN m >= 70 THEN 'white' WHEN m < 30 THEN 'black' ELSE 'grey' END
        WHEN top >= 0.55 * c THEN hue WHEN second >= 0.30 * c THEN 'multi' ELSE hue END AS colour FROM r""")
def vein_colour(spark, d):
    """COL9, ML12."""
    p = read(spark, d, "part")
    hues = {"gold": F.col("p_partkey") % 50, "green": F.col("p_partkey") % 31, "pink": F.col("p_partkey") % 23}
    return p.select("p_partkey", colors.vein_colour(F.col("p_size") * 40, F.lit(100000), hues, F.col("p_size") * 3, (F.col("p_partkey") % 100).cast("double")).alias("colour"))


_VETO_SQL = "((x = 'dark' AND y = 'light') OR (x = 'light' AND y = 'dark') OR (x = 'red' AND y IN ('light', 'green', 'blue')) OR (y = 'red' AND x IN ('light', 'green', 'blue')))"


@query(f"""WITH c AS (SELECT DISTINCT main_color AS c FROM {ITM} WHERE main_color IS NOT NULL), b AS (SELECT c, CASE WHEN c = 'charcoal' THEN 'dark' WHEN c = 'ivory' THEN 'light' WHEN c = 'red' THEN 'red' WHEN c = 'navy' THEN 'blue' END AS x FROM c)
    SELECT a_colour, b_colour, coalesce({_VETO_SQL}, false) AS vetoed FROM (SELECT p.c AS a_colour, q.c AS b_colour, p.x AS x, q.x AS y FROM b p JOIN b q ON p.c < q.c)""")
def veto_pairs(spark, d):
    """FLT6."""
    return similar.vetoes(items(spark, d))


# --- search ----------------------------------------------------------------------------

_EFFECTIVE = f"""(SELECT *, CASE coalesce(bg_color, base_color, main_color) WHEN 'rose' THEN 'pink' ELSE coalesce(bg_color, base_color, main_color) END AS colour,
    CASE pattern_family WHEN 'web' THEN 'webbed' WHEN 'bold veined' THEN 'bold_veined' ELSE pattern_family END AS pattern FROM {ITM})"""


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _search_sql(*, wanted=(), near=(), tier_near=(), patterns=(), where="true", browse=False, extra="0", vein="0.5", order, columns, limit=60) -> str:
    """The scored, filtered, capped and ranked page of a request without text."""
    unsure = "coalesce(base_color_confidence, 0) < 0.4"
    colour = f"CASE WHEN colour IS NULL THEN 0.3 WHEN colour IN {_in(wanted)} THEN 1.0 WHEN colour IN {_in(near)} THEN CASE WHEN {unsure} THEN 0.75 ELSE 0.6 END ELSE CASE WHEN {unsure} THEN 0.4 ELSE 0.2 END END" if wanted else "0.5"
    if "green" in wanted:
        colour = f"CASE WHEN dominant_hue = 'green' AND dominant_hue_confidence >= 0.65 THEN 1.0 ELSE {colour} END"
    pattern = f"CASE WHEN pattern IN {_in(patterns)} THEN 1.0 ELSE 0.3 END" if patterns else "0.5"
    manual = "CASE WHEN has_override THEN 1.0 ELSE 0.5 END"
    score = f"0.55 * ({colour}) + 0.15 * ({vein}) + 0.10 * ({pattern}) + 0.10 * 0.5 + 0.10 * ({manual})" if browse else f"0.35 * 0.5 + 0.20 * ({colour}) + 0.15 * ({vein}) + 0.10 * ({pattern}) + 0.10 * 0.5 + 0.10 * ({manual})"
    tier = f"CASE WHEN colour IN {_in(wanted)} THEN 1 WHEN colour IN {_in(tier_near)} THEN 2 ELSE 3 END" if wanted else "1"
    ptier = f"CASE WHEN pattern IN {_in(patterns)} THEN 1 WHEN pattern IS NULL THEN 2 ELSE 3 END" if patterns else "1"
    return f"""WITH e AS {_EFFECTIVE}, s AS (SELECT *, round(CAST({score} + {extra} AS DOUBLE), 6) AS score, {tier} AS colour_tier, {ptier} AS pattern_tier,
        (thumbnail IS NOT NULL)::INT + (colour IS NOT NULL)::INT + (pattern IS NOT NULL)::INT AS completeness {columns} FROM e WHERE {where}),
    v AS (SELECT count(CASE WHEN v <> '' THEN 1 END) AS vendors, coalesce(sum(least(n, 3)), 0) AS within FROM (SELECT trim(vendor) AS v, count(*) AS n FROM s GROUP BY 1)),
    c AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY trim(vendor) ORDER BY {order}) > CASE WHEN vendors < 5 THEN 2147483647 WHEN within < 8 THEN 5 ELSE 3 END THEN 1 ELSE 0 END AS over_cap FROM s, v)
    SELECT item, score, CAST(row_number() OVER (ORDER BY over_cap, {order}) - 1 AS INTEGER) AS position FROM c ORDER BY over_cap, {order} LIMIT {limit}"""


def _page(spark, d, request: search.Request) -> DataFrame:
    return search.page(search.rank(items(spark, d), request), request).select("item", "score", "position")


_DEFAULT = search.Request(base_colors=[], pattern_families=["linear", "web", "unlabeled"], tones=["warm"], veining=(0.2, 0.7), cloudiness=0.4)
_BUSY = "(CASE WHEN busyness BETWEEN 0.2 AND 0.7 THEN 1.0 ELSE greatest(0.2, 1 - 2 * greatest(0.2 - busyness, busyness - 0.7)) END)"
_EXTRA = "0.2 * (1 - abs(coalesce(cloudiness, 0.5) - 0.4)) * CASE WHEN cloudiness IS NULL THEN 0.3 ELSE cloudiness_confidence END + CASE WHEN coalesce(tone, 'neutral') = 'warm' THEN 0.1 * tone_confidence ELSE 0.0 END"
_PATTERNS = ["linear", "webbed", "unlabeled"]
_BY_TIER = "colour_tier, pattern_tier, score DESC, completeness DESC, ingest_seq DESC"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return search_default(spark, d)


@query(_search_sql(patterns=_PATTERNS, where=f"pattern IN {_in(_PATTERNS)} OR pattern IS NULL", extra=_EXTRA, vein=_BUSY, order=_BY_TIER, columns=""))
def search_default(spark, d):
    """MTH1, MTH4-5, FLT1, SRT1, WIN3, SRT7: a page."""
    return _page(spark, d, _DEFAULT)


_BROWSE = search.Request(base_colors=["green", "grey"], min_confidence=0.2)
_BUCKET = ", CASE WHEN colour IN ('green', 'grey') THEN 1 WHEN dominant_hue = 'green' AND dominant_hue_confidence >= 0.65 THEN 2 ELSE 3 END AS rank_bucket"


@query(_search_sql(wanted=["green", "grey"], near=["beige", "black", "white"], where="coalesce(nullif(base_color_confidence, 0), main_color_confidence, 0) >= 0.2", browse=True, order="rank_bucket, score DESC, ingest_seq DESC", columns=_BUCKET))
def search_color_browse(spark, d):
    """MTH2-3, SRT3, AGG25."""
    return _page(spark, d, _BROWSE)


_SECTIONS = search.Request(base_colors=["brown", "white"], pattern_families=["breccia", "bold veined"])
_HIT = "(coalesce(colour IN ('brown', 'white'), false) OR (coalesce(colour = 'beige', false) AND coalesce(dominant_hue IN ('brown', 'orange'), false)))"
_PAT = "(coalesce(pattern IN ('breccia', 'bold_veined'), false) OR bold_veined)"


@query(
    _search_sql(
        wanted=["brown", "white"], near=["beige", "grey"], patterns=["breccia", "bold_veined"], where=f"{_HIT} OR {_PAT}", order="match_tier, score DESC, ingest_seq DESC",
        columns=f", CASE WHEN {_HIT} AND {_PAT} THEN 1 WHEN {_HIT} THEN 2 ELSE 3 END AS match_tier",
    )
)
def search_sections(spark, d):
    """COL7, SRT2."""
    return _page(spark, d, _SECTIONS)


@query(f"SELECT item, CAST(row_number() OVER (ORDER BY ingest_seq DESC) - 1 AS INTEGER) AS position FROM {ITM} WHERE family IN ('', 'promo', 'small') ORDER BY 2 LIMIT 30 OFFSET 10")
def search_newest(spark, d):
    """SRT7, WIN10, FLT1e: any other sort is newest first."""
    return _page(spark, d, search.Request(stone_types=["promo", "small"], sort="newest", limit=30, offset=10)).drop("score")


@query()
def search_text(spark, d):
    """STR4-8 in the text score; the fuzzy part has no SQL."""
    return _page(spark, d, search.Request(query="red hot", tones=["warm"]))


@query(f"""WITH e AS {_EFFECTIVE} SELECT removed_by, count(*) AS n FROM (SELECT CASE WHEN NOT coalesce(nullif(base_color_confidence, 0), main_color_confidence, 0) >= 0.2 THEN 'min_confidence'
    WHEN NOT coalesce(colour = 'brown' OR (colour = 'beige' AND dominant_hue IN ('brown', 'orange')), false) THEN 'colour'
    WHEN NOT coalesce(cloudiness BETWEEN 0.1 AND 0.8, true) THEN 'cloudiness' WHEN NOT coalesce(tone, 'neutral') IN ('warm', 'neutral') THEN 'tone'
    WHEN NOT coalesce(dominant_hue IN ('red', 'brown'), false) THEN 'hue' ELSE 'kept' END AS removed_by FROM e) GROUP BY 1""")
def filter_debug_counts(spark, d):
    """FLT1a, FLT1c, FLT1f-i: what each rule removes."""
    request = search.Request(base_colors=["brown"], cloudiness_range=(0.1, 0.8), tones=["warm", "neutral"], tone_strict=True, dominant_hues=["red", "brown"], min_confidence=0.2)
    return search.filter_counts(items(spark, d), request)


_MULTI = "CASE WHEN item % 11 = 0 THEN 'multi' WHEN item % 4 = 0 THEN 'grey' END"


@query(f"""WITH e AS (SELECT item, {_MULTI} AS colour FROM {ITM})
    SELECT 'multi' AS chips, CASE WHEN coalesce(colour = 'multi', false) THEN 'kept' ELSE 'colour' END AS removed_by, count(*) AS n FROM e GROUP BY 2
    UNION ALL SELECT 'grey', 'kept', count(*) FROM e UNION ALL SELECT 'grey strict', CASE WHEN coalesce(colour = 'grey', false) THEN 'kept' ELSE 'colour' END, count(*) FROM e GROUP BY 2""")
def filter_chips(spark, d):
    """FLT1b, FLT1d: the multi chip excludes all else whatever other chips say, another chip admits every row, unless it is strict."""
    i = items(spark, d).withColumns({"bg_color": F.lit(None).cast("string"), "base_color": F.expr(_MULTI), "main_color": F.lit(None).cast("string")})
    wanted = {"multi": search.Request(base_colors=["grey", "multi"]), "grey": search.Request(base_colors=["grey"]), "grey strict": search.Request(base_colors=["grey"], colour_strict=True)}
    parts = [search.filter_counts(i, r).select(F.lit(n).alias("chips"), "removed_by", "n") for n, r in wanted.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH e AS {_EFFECTIVE} SELECT item, colour, pattern FROM e WHERE colour = 'brown' OR (colour = 'beige' AND dominant_hue IN ('brown', 'orange'))")
def hard_filters(spark, d):
    """FLT1c, COL1-2."""
    df = search.effective(items(spark, d))
    return df.filter(search.removed_by(search.Request(base_colors=["brown"])).isNull()).select("item", "colour", "pattern")


@query(f"""WITH e AS {_EFFECTIVE} SELECT 'pattern_family' AS facet, coalesce(pattern, 'unlabeled') AS value, count(*) AS n FROM e WHERE pattern IN {_in(_PATTERNS)} OR pattern IS NULL GROUP BY 2
    UNION ALL SELECT 'base_color', colour, count(*) FROM e WHERE (pattern IN {_in(_PATTERNS)} OR pattern IS NULL) AND colour IS NOT NULL GROUP BY 2""")
def facet_counts(spark, d):
    """AGG1."""
    return search.facets(search.rank(items(spark, d), _DEFAULT))


@query(f"""WITH f AS (SELECT vendor, name, coalesce(avg(CASE WHEN dominant_hue = 'red' THEN 1.0 WHEN dominant_hue IS NOT NULL THEN 0.0 END), 0) AS fs FROM {ITM} GROUP BY 1, 2),
    b AS (SELECT block, coalesce(avg(CASE WHEN dominant_hue = 'red' THEN 1.0 WHEN dominant_hue IS NOT NULL THEN 0.0 END), 0) AS bs FROM {ITM} GROUP BY 1)
    SELECT item, (fs >= 0.6 AND bs >= 0.2) OR (regexp_matches(lower(i.name), 'red|rosso|rojo|ruby|rubino') AND fs >= 0.55 AND bs >= 0.15) OR coalesce(dominant_hue = 'red' AND dominant_hue_confidence >= 0.5, false) AS rescued
    FROM {ITM} i JOIN f USING (vendor, name) JOIN b USING (block)""")
def hue_rescue(spark, d):
    """JN13, MTH7."""
    return search.rescue(items(spark, d), "red").select("item", "rescued")


_GOLDEN = ["yellow", "orange", "gold", "amber", "copper", "bronze", "ochre", "terra cotta"]
_SIMILAR = "round(greatest(0, least(1, (list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) + 1) / 2)), 6)"
_LOOKS = f"""(SELECT i.*, CASE WHEN v.embedding IS NOT NULL THEN {_SIMILAR} END AS visual FROM {_EFFECTIVE} i LEFT JOIN embeddings v ON v.vec_id = i.item, (SELECT embedding FROM embeddings WHERE vec_id = 7) a)"""
_GOLD_SCORE = f"CASE WHEN colour IS NULL THEN 0.3 WHEN colour IN {_in(_GOLDEN)} THEN 1.0 WHEN coalesce(base_color_confidence, 0) < 0.4 THEN 0.4 ELSE 0.2 END"


@query(f"""SELECT item, round(CAST(CASE WHEN visual IS NULL THEN 0.35 * 0.5 + 0.2 * ({_GOLD_SCORE}) + 0.15 * 0.5 + 0.1 * CASE WHEN pattern = 'bold_veined' THEN 1.0 ELSE 0.3 END + 0.1 * 0.5 + 0.1 * CASE WHEN has_override THEN 1.0 ELSE 0.5 END
        ELSE 0.55 * visual + 0.15 * 0.5 + 0.1 * ({_GOLD_SCORE}) + 0.1 * 0.5 + 0.05 * 0.5 + 0.05 * CASE WHEN has_override THEN 1.0 ELSE 0.5 END END AS DOUBLE), 6) AS score, CAST(NULL AS VARCHAR) AS v3_label, CAST(NULL AS DOUBLE) AS v3_confidence
    FROM {_LOOKS} WHERE coalesce(colour IN {_in(_GOLDEN)}, false) OR coalesce(pattern = 'bold_veined', false) OR bold_veined ORDER BY score DESC, ingest_seq DESC LIMIT 60""")
def search_vector(spark, d):
    """FLT2-4, SRT4, X20: an image search with a yellow chip (eight colours), bold veins (by label or flag) and an alias;
    items without a vector fall through to the text formula, the columns of a third classifier stay empty."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "embedding")
    from .functions.scores import similarity

    withv = items(spark, d).join(e, "item", "left").withColumn("visual", F.round(similarity(F.col("embedding"), F.lit(_anchor(spark, d))), 6))
    ranked = search.rank(withv, search.Request(base_colors=["yellow"], pattern_families=["bold veined"]), visual=F.col("visual"))
    page = ranked.orderBy(F.col("score").desc(), F.col("ingest_seq").desc()).limit(60)
    return page.select("item", "score", F.lit(None).cast("string").alias("v3_label"), F.lit(None).cast("double").alias("v3_confidence"))


_FAMILY = """CASE WHEN main_color = 'charcoal' THEN CASE dominant_hue WHEN 'red' THEN 'DARK_WARM_CHROMATIC' WHEN 'green' THEN 'DARK_COOL_CHROMATIC' ELSE 'TRUE_DARK' END
    WHEN main_color = 'navy' THEN CASE WHEN stone_lightness = 'light' THEN 'LIGHT_COOL' ELSE 'DARK_COOL' END WHEN main_color = 'red' THEN 'RED' WHEN main_color = 'ivory' THEN 'WHITE' WHEN main_color = 'gold' THEN 'GOLD' END"""


@query(f"""WITH s AS (SELECT *, {_FAMILY} AS fam FROM {_LOOKS} WHERE item <> 7 AND visual > 0 AND item NOT IN (SELECT b FROM {VOT} WHERE vote = -1 AND a = 7 UNION SELECT a FROM {VOT} WHERE vote = -1 AND b = 7)),
    t AS (SELECT item, visual AS similarity, CASE WHEN fam = 'DARK_COOL' THEN 1 WHEN fam = 'LIGHT_COOL' AND abs(40 - lightness_mean) > 20 THEN 3 WHEN fam IN ('LIGHT_COOL', 'DARK_COOL_CHROMATIC') THEN 2 ELSE 3 END AS colour_tier,
        CASE WHEN pattern = 'webbed' THEN 1 WHEN pattern IS NULL THEN 2 ELSE 3 END AS pattern_tier, CASE WHEN tone = 'cool' THEN 1 WHEN tone IS NULL THEN 2 ELSE 3 END AS tone_tier,
        CASE WHEN stone_lightness = 'mid' THEN 1 WHEN stone_lightness IS NULL THEN 2 ELSE 3 END AS stone_lightness_tier
        FROM s WHERE coalesce(main_color NOT IN ('red'), true) AND coalesce(fam NOT IN ('TRUE_DARK', 'DARK_WARM_CHROMATIC', 'RED', 'PINK', 'GOLD', 'WHITE', 'BEIGE'), true))
    SELECT * FROM t ORDER BY colour_tier, pattern_tier, tone_tier, stone_lightness_tier, similarity DESC, item LIMIT 10""")
def similar_rerank(spark, d):
    """FLT6-7, COL4-5, SRT5: veto before tiers, tiers before similarity."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec"))
    df = search.effective(items(spark, d)).join(e, "item")
    anchor = {"item": 7, "main_color": "navy", "retrieval_family": "DARK_COOL", "lightness_mean": 40.0, "pattern": "webbed", "tone": "cool", "stone_lightness": "mid", "vec": _anchor(spark, d)}
    return similar.resolve(df, anchor, suppressed=similar.neighbours(_votes(spark, d), 7))


_VENDORS = "(SELECT count(CASE WHEN v <> '' THEN 1 END) AS vendors, coalesce(sum(least(n, 3)), 0) AS within FROM (SELECT trim(vendor) AS v, count(*) AS n FROM {0} GROUP BY 1))"
_CAPPED = "vendors >= 5 AS vendor_cap_applied, vendors >= 5 AND within < 8 AS vendor_cap_relaxed, vendors AS distinct_vendor_count"


@query(f"""WITH e AS {_EFFECTIVE}, s AS (SELECT *, {_HIT} AS hit, {_PAT} AS pat FROM e WHERE {_HIT} OR {_PAT}), b AS (SELECT *, {_BUCKET.removeprefix(', ')} FROM e WHERE coalesce(nullif(base_color_confidence, 0), main_color_confidence, 0) >= 0.2)
    SELECT 'sections' AS mode, count(CASE WHEN hit AND pat THEN 1 END) AS tier_1_both, count(CASE WHEN hit AND NOT pat THEN 1 END) AS tier_2_colour_only, count(CASE WHEN NOT hit THEN 1 END) AS tier_3_pattern_only,
        NULL AS direct, NULL AS rescued, NULL AS other, (SELECT vendors >= 5 FROM {_VENDORS.format('s')}) AS vendor_cap_applied, (SELECT vendors >= 5 AND within < 8 FROM {_VENDORS.format('s')}) AS vendor_cap_relaxed,
        (SELECT vendors FROM {_VENDORS.format('s')}) AS distinct_vendor_count, true AS needs_tags FROM s
    UNION ALL SELECT 'browse', NULL, NULL, NULL, count(CASE WHEN rank_bucket = 1 THEN 1 END), count(CASE WHEN rank_bucket = 2 THEN 1 END), count(CASE WHEN rank_bucket = 3 THEN 1 END),
        (SELECT vendors >= 5 FROM {_VENDORS.format('b')}), (SELECT vendors >= 5 AND within < 8 FROM {_VENDORS.format('b')}), (SELECT vendors FROM {_VENDORS.format('b')}), true FROM b
    UNION ALL SELECT 'newest', NULL, NULL, NULL, NULL, NULL, NULL, false, false, (SELECT vendors FROM {_VENDORS.format('e')}), false""")
def search_meta(spark, d):
    """X21, AGG25, FLT15: what stands beside the pages of three requests."""
    wanted = {"sections": _SECTIONS, "browse": _BROWSE, "newest": search.Request(sort="newest")}
    parts = [search.meta(search.rank(items(spark, d), r), r).withColumn("mode", F.lit(n)) for n, r in wanted.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- operations ------------------------------------------------------------------------


def _votes(spark, d):
    return derive(read(spark, d, "events"), VOTES)


def _attempts(spark, d):
    return derive(read(spark, d, "events"), ATTEMPTS)


_PATCHES = {"entity": "l_partkey", "cell": "CAST((l_orderkey + l_linenumber) % 36 AS INT)", "weight": "CAST(l_quantity AS DOUBLE)", "l": "CAST(l_suppkey % 100 AS DOUBLE)", "label": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"} | {
    f"{c}{k}": f"CAST((l_partkey * {7 + n + 5 * k}) % {m} AS DOUBLE)" for k in (0, 1) for n, (c, m) in enumerate((("l", 101), ("a", 61), ("b", 53)))
}


@query(f"""WITH p AS {derived('lineitem', _PATCHES)}, e AS (SELECT entity, count(*) AS patch_count, count(DISTINCT cell) AS total_cells, sum(weight * l) / sum(weight) AS light,
        coalesce(sum(CASE WHEN label = 0 THEN weight END), 0) AS w0, coalesce(sum(CASE WHEN label = 1 THEN weight END), 0) AS w1, count(DISTINCT CASE WHEN label = 0 THEN cell END) AS c0, count(DISTINCT CASE WHEN label = 1 THEN cell END) AS c1,
        max(l0) AS l0, max(a0) AS a0, max(b0) AS b0, max(l1) AS l1, max(a1) AS a1, max(b1) AS b1 FROM p GROUP BY 1),
    x AS (SELECT *, w0 >= w1 AS f, least(w0, w1) / (w0 + w1) AS second, CASE WHEN w0 >= w1 THEN c1 ELSE c0 END AS spread FROM e),
    y AS (SELECT *, second >= 0.25 AND spread >= greatest(6, floor(total_cells * 0.25)) AS has FROM x)
    SELECT entity, CASE WHEN f THEN l0 ELSE l1 END AS main_l, CASE WHEN f THEN a0 ELSE a1 END AS main_a, CASE WHEN f THEN b0 ELSE b1 END AS main_b, round(greatest(w0, w1) / (w0 + w1), 3) AS main_share,
        CASE WHEN f THEN l1 ELSE l0 END AS second_l, CASE WHEN f THEN a1 ELSE a0 END AS second_a, CASE WHEN f THEN b1 ELSE b0 END AS second_b, round(second, 3) AS second_share,
        round(CASE WHEN has THEN sqrt((a0 - a1) * (a0 - a1) + (b0 - b1) * (b0 - b1)) ELSE 0 END, 2) AS delta_ab, spread AS second_cell_spread, total_cells, has AS has_second, round(light, 1) AS lightness_mean, patch_count,
        CASE WHEN l0 >= l1 THEN l0 ELSE l1 END AS lighter_l, round(CASE WHEN l0 >= l1 THEN w0 ELSE w1 END / (w0 + w1), 3) AS lighter_share, round(CASE WHEN l0 >= l1 THEN sqrt(a0 * a0 + b0 * b0) ELSE sqrt(a1 * a1 + b1 * b1) END, 2) AS lighter_chroma FROM y""")
def colour_agent_summary(spark, d):
    """ML11: shares, spread and tests of two given clusters; line items stand for patches, their part for the item."""
    return patches.colour_summary(derive(read(spark, d, "lineitem"), _PATCHES), "entity")


@query("SELECT p_brand, arg_max(p_partkey, (p_size, p_partkey)) AS p_partkey, arg_max(p_name, (p_size, p_partkey)) AS p_name FROM part GROUP BY 1")
def upsert_last_writer(spark, d):
    """SNK3."""
    return ops.last_writer(read(spark, d, "part").select("p_brand", "p_partkey", "p_name", "p_size"), ["p_brand"], ["p_size", "p_partkey"]).drop("p_size")


@query(f"""SELECT entity, arg_max(label, (shipped, image, vendor, price)) AS label, arg_max(vendor, (shipped, image, vendor, price)) AS vendor, max(shipped) AS shipped,
    arg_min(label, (shipped, image, vendor, price)) AS first_label, min(shipped) AS first_at FROM {IMG} GROUP BY 1""")
def bucketed_upsert(spark, d):
    """SNK3, SNK4 as storage: line items up to a day are put by part, then those after it; the first label and time stay."""
    rows = images(spark, d).select("entity", "label", "vendor", "shipped", "image", "price", F.col("label").alias("first_label"), F.col("shipped").alias("first_at"))
    table = keyed.KeyedTable(spark, scratch(spark, "bucketed-upsert"), ["entity"], ["shipped", "image", "vendor", "price"], buckets=64)
    for part in (f"shipped < {SPLIT}", f"shipped >= {SPLIT}"):
        table.upsert(rows.filter(part), keep=("first_label", "first_at"))
    return table.read().select("entity", "label", "vendor", "shipped", "first_label", "first_at")


@query(f"""SELECT least(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) || '|' || greatest(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS pair_key, arg_max(vote, (ts, seq)) AS vote, min(ts) AS voted_at, max(ts) AS updated_at
    FROM {VOT} WHERE a <> b AND vote IN (1, -1) GROUP BY 1""")
def partial_upsert(spark, d):
    """SNK4."""
    return ops.merge_votes(_votes(spark, d), "a", "b", "vote", "ts", "seq")


@query(f"SELECT DISTINCT a, b FROM (SELECT a, b FROM {VOT} UNION SELECT b, a FROM {VOT})")
def edge_union(spark, d):
    """JN12, SET3."""
    return similar.edges(_votes(spark, d))


@query(f"SELECT b AS item FROM {VOT} WHERE vote = -1 AND a = 7 UNION SELECT a FROM {VOT} WHERE vote = -1 AND b = 7")
def suppressed_siblings(spark, d):
    """JN12, FLT7."""
    return similar.neighbours(_votes(spark, d), 7)


@query(f"SELECT DISTINCT key FROM {ATT} WHERE key NOT IN (SELECT key FROM {ATT} WHERE job = 0)")
def insert_absent(spark, d):
    """SNK5."""
    a = _attempts(spark, d).select("key", "job")
    return ops.insert_absent(a.filter("job = 0"), a.select("key"), ["key"])


_STATES = f"(SELECT task, CASE WHEN max(ok::INT) = 1 THEN 'DONE' WHEN sum(failed::INT) >= 3 THEN 'FAILED' ELSE 'PENDING' END AS status, CAST(sum(failed::INT) AS BIGINT) AS n_failed, max(ts) AS last_at FROM {ATT} GROUP BY 1)"


def _states(spark, d):
    return ops.queue_state(_attempts(spark, d), "task", F.col("ok"), "ts")


@query(f"SELECT * FROM {_STATES}")
def queue_state(spark, d):
    """STM2, over all attempts; a task is a user and an hour of the day, fine enough for all states to occur."""
    return _states(spark, d)


@query(f"""SELECT task, CASE WHEN status = 'DONE' THEN status ELSE 'PENDING' END AS all_again, CASE WHEN status = 'DONE' THEN n_failed ELSE 0 END AS failed_all,
    CASE WHEN status = 'FAILED' THEN 'PENDING' ELSE status END AS failed_again, CASE WHEN status = 'FAILED' THEN 0 ELSE n_failed END AS failed_left FROM {_STATES}""")
def queue_reset(spark, d):
    """STM7, X17: both resets side by side."""
    states = _states(spark, d)
    a = ops.reset(states, "status", "n_failed").select("task", F.col("status").alias("all_again"), F.col("n_failed").alias("failed_all"))
    b = ops.reset(states, "status", "n_failed", only_failed=True).select("task", F.col("status").alias("failed_again"), F.col("n_failed").alias("failed_left"))
    return a.join(b, "task")


_LOGGED = f"""(SELECT task, CASE WHEN ok THEN 'done' ELSE 'failed' END AS kind, ts FROM {ATT}
    UNION ALL SELECT {ATTEMPTS['task']}, 'claim', ts + INTERVAL 30 SECONDS FROM events WHERE event_type = 'view')"""


@query(f"""WITH l AS {_LOGGED}, t AS (SELECT task, bool_or(kind = 'done') AS done, count(CASE WHEN kind = 'failed' THEN 1 END) AS n_failed,
        max(CASE WHEN kind <> 'claim' THEN ts END) AS last_at, max(CASE WHEN kind = 'claim' THEN ts END) AS claimed_at FROM l GROUP BY 1), w AS (SELECT max(ts) - INTERVAL 10 MINUTES AS seen FROM l)
    SELECT task, CASE WHEN done THEN 'DONE' WHEN n_failed >= 3 THEN 'FAILED' WHEN claimed_at > last_at AND claimed_at + INTERVAL 5 MINUTES > seen THEN 'PROCESSING' ELSE 'PENDING' END AS status, n_failed, last_at, claimed_at FROM t, w""")
def queue_replay(spark, d):
    """STM1-STM3, DT2: all attempts, and claims half a minute after views, as a stream through the queue's state machine."""
    kept = read(spark, d, "events").schema
    log = spark.readStream.schema(kept).option("pathGlobFilter", "events.parquet").parquet(d)
    outcome = F.struct(F.when(F.expr(ATTEMPTS["ok"]), "done").otherwise("failed").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    claim = F.struct(F.lit("claim").alias("kind"), (F.col("ts") + F.expr("INTERVAL 30 SECONDS")).cast("timestamp").alias("ts"))
    both = F.when(F.col("event_type") == "view", F.array(outcome, claim)).otherwise(F.array(outcome))
    found = queue.follow(log.select(F.expr(ATTEMPTS["task"]).alias("task"), F.inline(both)), "task", scratch(spark, "queue-replay"))
    return found.withColumns({c: F.col(c).cast(kept["ts"].dataType) for c in ("last_at", "claimed_at")})


_JOBS = {"job_id": "event_id", "kind": "event_type", "status": "CASE CAST(floor(value) AS BIGINT) % 3 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' ELSE 'DONE' END", "total": "user_id", "done": "CAST(0 AS BIGINT)"}


@query(f"""SELECT job_id, kind, CASE WHEN job_id = 5 THEN 'FAILED' WHEN kind = 'view' AND status IN ('QUEUED', 'RUNNING') THEN 'CANCELED' ELSE status END AS status, total, done FROM {derived('events', _JOBS)}
    UNION ALL SELECT -1, 'view', 'RUNNING', count(*), count(CASE WHEN status = 'DONE' THEN 1 END) FROM {_STATES}""")
def job_lifecycle(spark, d):
    """STM8: a new job cancels its kind's others, another one is finished."""
    jobs = derive(read(spark, d, "events"), _JOBS)
    return ops.finish_job(ops.create_job(jobs, _states(spark, d), "view", -1), 5, "FAILED")


_ASKED = {"track": "CASE user_id % 3 WHEN 0 THEN 'color' WHEN 1 THEN 'pattern' ELSE 'other' END", "run_id": "CASE WHEN event_id % 11 = 0 THEN '../x' WHEN event_id % 7 = 0 THEN 'gone' ELSE 'r' || CAST(event_id AS STRING) END"}
_RUNS = {"track": _ASKED["track"], "run_id": "'r' || CAST(event_id AS STRING)", "ts": "ts", "status": "CASE event_type WHEN 'click' THEN 'rolled_back' WHEN 'view' THEN 'preview' ELSE 'applied' END", "snapshot": "CASE WHEN event_id % 5 <> 0 THEN 'path' END", "restored": "event_id % 13 <> 0"}


@query(f"""WITH r AS {derived('events', _RUNS)}, q AS {derived('events', _ASKED)}, p AS (SELECT track, run_id, lag(run_id) OVER (PARTITION BY track ORDER BY ts, run_id) AS previous FROM r WHERE status = 'applied'),
    f AS (SELECT q.track, q.run_id, r.status, r.snapshot, r.restored, r.run_id AS known, previous FROM q LEFT JOIN r ON r.track = q.track AND r.run_id = q.run_id LEFT JOIN p ON p.track = q.track AND p.run_id = q.run_id),
    c AS (SELECT *, CASE WHEN track = 'other' OR run_id = '../x' THEN 400 WHEN known IS NULL THEN 404 WHEN status <> 'applied' OR snapshot IS NULL THEN 409 WHEN NOT restored THEN 500 ELSE 200 END AS code FROM f)
    SELECT track, run_id, code, CASE WHEN code = 409 THEN CASE status WHEN 'rolled_back' THEN 'already rolled back' WHEN 'preview' THEN 'nothing was applied: preview' ELSE 'no snapshot was kept' END END AS reason, CASE WHEN code = 200 THEN previous END AS restored_to FROM c""")
def rollback_checks(spark, d):
    """X19: what becomes of each request to roll a run back."""
    e = read(spark, d, "events")
    return ops.check_rollbacks(derive(e, _ASKED), derive(e, _RUNS))


@query(f"SELECT CASE WHEN contains(error, '|') THEN split_part(error, '|', 1) ELSE left(error, 50) END AS reason, count(*) AS n FROM {ATT} WHERE error IS NOT NULL GROUP BY 1")
def failure_reasons(spark, d):
    """AGG16."""
    return ops.failure_reasons(_attempts(spark, d), "error")


@query(f"SELECT job, count(*) AS total, count(CASE WHEN ok THEN 1 END) AS done, count(CASE WHEN seq % 3 = 0 AND NOT ok THEN 1 END) AS failed, round(100.0 * count(CASE WHEN ok THEN 1 END) / count(*), 2) AS pct FROM {ATT} GROUP BY 1")
def job_progress(spark, d):
    """AGG28, X17."""
    s = _attempts(spark, d).withColumn("status", F.expr("CASE WHEN ok THEN 'DONE' WHEN seq % 3 = 0 THEN 'FAILED' ELSE 'PENDING' END"))
    return ops.job_progress(s, "job", "status")


@query(f"SELECT run_id, track, lag(run_id) OVER (PARTITION BY track ORDER BY ts, run_id) AS previous FROM {RUN} WHERE kind = 'applied'")
def prev_applied_run(spark, d):
    """WIN7."""
    r = derive(read(spark, d, "events"), RUNS).filter("kind = 'applied'")
    return ops.previous_run(r, "track", "ts", "run_id").select("run_id", "track", "previous")


@query(f"""SELECT track, arg_max(run_id, (ts, run_id)) FILTER (kind = 'preview') AS preview, coalesce(max(ts) FILTER (kind = 'applied') > max(ts) FILTER (kind = 'preview'), false) AS stale FROM {RUN} GROUP BY 1 HAVING count(*) FILTER (kind = 'preview') > 0""")
def latest_preview_stale(spark, d):
    """WIN8."""
    return ops.preview_state(derive(read(spark, d, "events"), RUNS), "track", "kind", "ts", "run_id")


@query(f"SELECT user_id, max(ts) AS last_at, epoch(TIMESTAMP '2024-01-29 12:00:00') - epoch(date_trunc('second', max(ts))) > 86400 AS interrupted FROM events GROUP BY 1")
def stale_runs(spark, d):
    """DT1."""
    last = read(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_at"))
    return ops.stale_runs(last, ["last_at"], F.to_timestamp(F.lit("2024-01-29 12:00:00")), 86400)


@query("SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 5 MINUTE THEN 'PENDING' WHEN event_type = 'view' THEN 'PROCESSING' ELSE 'DONE' END AS status FROM events")
def lease_expiry(spark, d):
    """DT2."""
    e = read(spark, d, "events").withColumn("status", F.when(F.col("event_type") == "view", "PROCESSING").otherwise("DONE"))
    return ops.expired_leases(e, "status", "ts", F.to_timestamp(F.lit("2024-01-15 00:00:00"))).select("event_id", "status")


@query("SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM events WHERE event_type = 'error') THEN 'rolled_back' WHEN value < 20 THEN 'aborted' WHEN value < 60 THEN 'rejected' WHEN event_type = 'view' THEN 'preview' ELSE 'applied' END AS status FROM events")
def run_history(spark, d):
    """STR15, JN15, SET4."""
    e = read(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("run_id"), (F.col("value") < 20).alias("aborted"), (F.col("value") >= 60).alias("gate_passed"), F.lit(False).alias("rolled_back"), F.when(F.col("event_type") == "view", "preview").otherwise("apply").alias("mode"), "event_type")
    return ops.apply_rollbacks(ops.run_status(e), e.filter("event_type = 'error'")).select("event_id", "status")


# --- event streams (their batch form; tests run them as streams) ------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """Extension: tumbling windows."""
    return stream.tumbling(read(spark, d, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    """Extension: session windows."""
    return stream.sessions(read(spark, d, "events"))


# --- small operators -------------------------------------------------------------------

_FETCHES = {"event_id": "event_id", "status": "CASE event_type WHEN 'click' THEN 404 WHEN 'view' THEN 200 WHEN 'signup' THEN 503 WHEN 'purchase' THEN 429 END", "error": "CASE WHEN event_type = 'error' THEN 'Read Timeout' END", "kind": "CASE WHEN user_id % 2 = 0 THEN 'text/html' ELSE 'image/png' END"}


@query(f"""SELECT event_id, CASE WHEN status = 404 THEN 'http_404' WHEN status = 429 THEN 'rate_limited' WHEN status >= 500 THEN 'server_error' WHEN error IS NOT NULL THEN 'timeout' WHEN kind = 'text/html' THEN 'not_an_image' END AS label FROM {derived('events', _FETCHES)}""")
def error_labels(spark, d):
    """STR11."""
    return derive(read(spark, d, "events"), _FETCHES).select("event_id", text.classify_error(F.col("status"), F.col("error"), F.col("kind")).alias("label"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, '[\"' || event_type || '\"]' AS as_array FROM events")
def json_tags(spark, d):
    """JSN1, JSN3, STR12."""
    from .functions import jsontags

    e = read(spark, d, "events").withColumn("arr", F.to_json(F.array("event_type")))
    both = jsontags.merged(F.lit('{"k": "old", "other": "x"}'), F.col("props"))
    return e.filter(jsontags.scalar(F.col("arr")) == F.col("event_type")).select("event_id", F.get_json_object(both, "$.k").alias("k"), text.tag_text(F.array("event_type"), "array").alias("as_array"))


@query("SELECT event_id, CASE WHEN event_type <> 'view' THEN 'red,' || event_type END AS accents, CASE WHEN event_type <> 'view' THEN CAST(0.25 + user_id AS DOUBLE) END AS strength FROM events")
def accent_tags(spark, d):
    """JSN2: accent colours from JSON, malformed text is none."""
    from .functions import jsontags

    e = read(spark, d, "events")
    made = F.to_json(F.array(F.struct(F.lit("RED").alias("color"), F.lit(0.25).alias("strength")), F.struct(F.upper("event_type").alias("color"), F.col("user_id").cast("double").alias("strength"))))
    got = e.select("event_id", jsontags.accents(F.when(F.col("event_type") == "view", F.lit("{oops")).otherwise(made)).alias("a"))
    return got.select("event_id", F.array_join(F.transform("a", lambda x: x["color"]), ",").alias("accents"), F.round(F.get("a", F.lit(0))["strength"] + F.get("a", F.lit(1))["strength"], 4).alias("strength"))


@query("SELECT event_type AS session, count(*) AS n FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10' GROUP BY 1")
def corrections_today(spark, d):
    """AGG26."""
    return ops.corrections_on(read(spark, d, "events"), "event_type", "ts", "2024-01-10").withColumnRenamed("event_type", "session")


@query(f"SELECT vendor, string_agg(line, ',' ORDER BY line) AS assets FROM (SELECT DISTINCT vendor, CAST(line AS VARCHAR) AS line FROM {IMG}) GROUP BY 1")
def asset_lists(spark, d):
    """AGG27, X1."""
    return ops.assets(images(spark, d), "vendor", "line")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def dataset_listing(spark, d):
    """AGG29."""
    e = read(spark, d, "events").select("event_id", "props")
    return ops.dataset_listing(e, "props", "k bigint").drop("props")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'already rolled back' WHEN 'view' THEN 'nothing was applied: preview' ELSE CASE WHEN user_id % 2 = 0 THEN 'no snapshot was kept' END END AS reason FROM events")
def irreversible_reasons(spark, d):
    """STR16, X19."""
    e = read(spark, d, "events")
    status = F.when(F.col("event_type") == "click", "rolled_back").when(F.col("event_type") == "view", "preview").otherwise("applied")
    return e.select("event_id", ops.irreversible_reason(status, F.when(F.col("user_id") % 2 != 0, F.lit("path"))).alias("reason"))


@query(f"""WITH e AS {_EFFECTIVE} SELECT item, array_to_string(list_filter([CASE WHEN main_color = 'navy' THEN 'same main color' END, CASE WHEN pattern = 'webbed' THEN 'same pattern' END, CASE WHEN tone = 'cool' THEN 'same tone' END,
    CASE WHEN stone_lightness = 'mid' THEN 'same stone lightness' END], lambda x: x IS NOT NULL), '; ') AS chips FROM e""")
def similar_chips(spark, d):
    """FLT14, ARR1."""
    anchor = {"main_color": "navy", "pattern": "webbed", "tone": "cool", "stone_lightness": "mid"}
    return similar.projection(search.effective(items(spark, d)), anchor).select("item", F.array_join("chips", "; ").alias("chips"))


# --- runs, stores and image rules ------------------------------------------------------

_CONTENT = "o_orderpriority || '|' || o_custkey"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderdate, {_CONTENT} AS content FROM orders), first AS (SELECT DISTINCT content FROM o WHERE o_orderdate < {SPLIT})
    SELECT o_orderkey, content IN (SELECT content FROM first) AS was_stored, length(regexp_replace(content, '[^0-9]', '', 'g')) AS n_digits FROM o""")
def stored_results(spark, d):
    """SRC14, SRC15, ML16: orders up to a day fill a store of results by content, then all orders go through it."""

    def count_digits(zero, contents):
        return [zero + sum(c.isdigit() for c in content) for content in contents]

    def compute(rows):
        return encoders.encoded(rows, "content_md5", "content", "digits", int, count_digits, "n_digits bigint", batch=1024)

    rows = read(spark, d, "orders").selectExpr("o_orderkey", "o_orderdate", f"{_CONTENT} AS content").withColumn("content_md5", F.md5("content"))
    store = ResultStore(spark, scratch(spark, "results"), "content_md5", "n_digits bigint", {"version": 1, "mode": "digits"})
    store.fill(rows.filter(f"o_orderdate < {SPLIT}"), compute)
    return store.through(rows, compute)[0].select("o_orderkey", "was_stored", "n_digits")


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 1 END) AS o FROM orders GROUP BY 1)
    SELECT c_custkey AS item, CASE WHEN n IS NULL THEN 'skipped' WHEN f + o > 0 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN f > 0 THEN 1 ELSE 2 END AS attempts,
        CASE WHEN n IS NOT NULL AND f + o = 0 THEN 'NoUrgentOrder' END AS error_class, CASE WHEN f + o > 0 THEN n END AS n_images FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def staged_run(spark, d):
    """STM5, X8, X26: a stage over customers fails for those without a certain order, a second attempt takes more orders."""
    orders = read(spark, d, "orders").withColumnRenamed("o_custkey", "item")

    def how(good: list[str]):
        def run(keys):
            n_good = F.count_if(F.col("o_orderstatus").isin(good) & (F.col("o_orderpriority") == "1-URGENT"))
            per = orders.join(keys, "item", "left_semi").groupBy("item").agg(F.count(F.lit(1)).alias("n_images"), n_good.alias("n_good"))
            return per.select("item", "n_images", F.when(F.col("n_good") == 0, "NoUrgentOrder").alias("error_class"))

        return run

    run = StagedRun(spark, scratch(spark, "staged"), "run", "item")
    work = read(spark, d, "customer").select(F.col("c_custkey").alias("item"))
    for good in (["F"], ["F", "O"]):
        run.stage("cv", work, how(good), slices=2, counters={"n_images": F.sum("n_images")})
    return run.ledger("cv").join(run.results("cv").select("item", "n_images"), "item", "left").select("item", "status", "attempts", "error_class", "n_images")


#: Line items as measures of images.
_MEASURES = {
    "o": "l_orderkey",
    "k": "l_linenumber",
    "s": "l_suppkey",
    "colour_l": "CAST(l_partkey % 101 AS DOUBLE)",
    "colour_a": "CAST(l_suppkey % 61 - 20 AS DOUBLE)",
    "colour_b": "CAST(l_orderkey % 71 - 20 AS DOUBLE)",
    "colour_sat": "l_discount * 3",
    "ground_pixels": "l_quantity * 5",
    "glare_ratio": "l_tax * 5",
    "exposure_score": "l_quantity / 50",
    "top_share": "CAST(34 + l_partkey % 40 AS DOUBLE) / 100",
    "next_share": "CAST(34 - l_suppkey % 10 AS DOUBLE) / 100",
    "top_a": "CAST(l_linenumber * 7 - 20 AS DOUBLE)",
    "top_b": "CAST(l_orderkey % 37 - 15 AS DOUBLE)",
    "next_a": "CAST(l_partkey % 53 - 25 AS DOUBLE)",
    "next_b": "CAST(l_suppkey % 47 - 20 AS DOUBLE)",
    "second_share": "CAST(l_orderkey % 6 AS DOUBLE) / 10",
    "delta_ab": "CAST(l_linenumber * 3 AS DOUBLE)",
    "second_cells": "CAST(l_partkey % 13 AS DOUBLE)",
    "light_mean": "CAST(l_partkey % 100 AS DOUBLE)",
    "light_var": "l_quantity * 20",
    **{f"part{j}_{c}": f"CAST((l_partkey * {j} + l_suppkey) % {m} AS DOUBLE) {more}" for j in (1, 2, 3) for c, m, more in (("share", 7, "/ 10"), ("l", 97, ""), ("a", 59, "- 20"), ("b", 67, "- 20"))},
}


def _faint(l: str, a: str, b: str) -> str:
    return f"sqrt({a} * {a} + {b} * {b}) < greatest(4.0, 8.0 * {l} / 70.0)"


def _near(l: str, a: str, b: str) -> str:
    """The nearest named colour as a struct (d, n)."""

    def of(names):
        return "list_min([" + ", ".join(f"{{'d': sqrt(0.5 * ({l} - {x}) ** 2 + ({a} - {y}) ** 2 + ({b} - {z}) ** 2), 'n': '{n}'}}" for n, (x, y, z) in imaging.CENTRES.items() if n in names) + "])"

    return f"CASE WHEN {_faint(l, a, b)} THEN {of(imaging.NEUTRALS)} ELSE {of(list(imaging.CENTRES))} END"


_LARGE = " || ".join(f"CASE WHEN part{j}_share >= 0.15 THEN [({_near(f'part{j}_l', f'part{j}_a', f'part{j}_b')}).n] ELSE [] END" for j in (1, 2, 3))


@query(f"""WITH m AS (SELECT *, {_near('colour_l', 'colour_a', 'colour_b')} AS near, {_faint('colour_l', 'colour_a', 'colour_b')} AS faint, colour_l >= 75 AND colour_sat <= 0.10 AS white,
        second_share >= 0.30 AND delta_ab >= 10 AND second_cells >= 6 AS exotic, abs((degrees(atan2(top_b, top_a)) + 360) % 360 - (degrees(atan2(next_b, next_a)) + 360) % 360) AS apart,
        (sqrt(top_a ** 2 + top_b ** 2) < 8) <> (sqrt(next_a ** 2 + next_b ** 2) < 8) AS one_neutral, least(0.5 + (0.60 - top_share) * 2, 0.90) AS multi_conf, {_LARGE} AS parts FROM {derived('lineitem', _MEASURES)}),
    c AS (SELECT *, 1 - least(near.d / 50, 0.5) AS conf, top_share < 0.60 AND next_share > 0.30 AND (least(apart, 360 - apart) > 60 OR one_neutral) AND multi_conf >= 0.75 AS multi FROM m),
    r AS (SELECT *, CASE WHEN multi THEN 'multi' WHEN white THEN 'light_unsaturated' WHEN faint THEN 'neutral' WHEN near.n IN ('red', 'green') AND colour_sat < 0.15 THEN 'pale' WHEN near.n IN ('red', 'green') AND conf < 0.75 THEN 'unsure' ELSE 'nearest' END AS rule FROM c),
    f AS (SELECT *, CASE rule WHEN 'multi' THEN 'multi' WHEN 'light_unsaturated' THEN 'white' WHEN 'neutral' THEN CASE WHEN colour_l > 75 THEN 'white' WHEN colour_l < 42 THEN 'black' WHEN colour_b > 8 THEN 'beige' ELSE 'grey' END
            WHEN 'nearest' THEN near.n ELSE CASE near.n WHEN 'red' THEN 'brown' ELSE 'grey' END END AS name,
        CASE rule WHEN 'multi' THEN multi_conf WHEN 'light_unsaturated' THEN 0.85 WHEN 'neutral' THEN CASE WHEN colour_l > 90 OR colour_l < 30 THEN 0.85 ELSE 0.75 END WHEN 'pale' THEN 0.60 ELSE conf END AS sure FROM r)
    SELECT o, k, s, CASE WHEN ground_pixels < 10 THEN 'grey' WHEN exotic THEN 'exotic' ELSE name END AS base_color, CASE WHEN ground_pixels < 10 THEN 'few_pixels' WHEN exotic THEN 'exotic' ELSE rule END AS rule,
        round(CASE WHEN ground_pixels < 10 THEN 0.30 WHEN exotic THEN least(second_share * 2, 0.90) WHEN white THEN least(greatest(sure, 0.80), 0.95)
            ELSE least(sure * greatest(1 - glare_ratio * 1.5, 0.2) * greatest(exposure_score, 0.3), 0.95) END, 6) AS conf,
        CASE WHEN exotic THEN array_to_string(list_filter(parts, lambda x, i: list_position(parts, x) = i), ',') ELSE '' END AS colours,
        CASE WHEN ground_pixels < 10 THEN 'medium' WHEN light_mean < 40 THEN 'dark' WHEN light_mean > 70 THEN 'light' ELSE 'medium' END AS tone,
        round(CASE WHEN ground_pixels < 10 THEN 0.30 ELSE 1 - least(light_var / 1000, 0.5) END, 6) AS tone_conf FROM f""")
def colour_gates(spark, d):
    """ML8-10, COL10: base colour, colours in an exotic image, and tonality, of measures."""
    m = imaging.coloured(derive(read(spark, d, "lineitem"), _MEASURES))
    conf = [F.round(f"{c}_conf", 6).alias(n) for c, n in (("base_color", "conf"), ("tonality", "tone_conf"))]
    return m.select("o", "k", "s", "base_color", F.col("base_color_rule").alias("rule"), *conf, F.array_join("colors_in_stone", ",").alias("colours"), F.col("tonality").alias("tone"))
