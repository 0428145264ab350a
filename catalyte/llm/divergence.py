"""Source divergence audit: how far the term frequencies of a language's sources lie apart.

Every source gives each kept term a share p = 1 + floor(scale * (count + 1) / (N + V)) in
whole numbers, and f(p, q) = floor((p - q)^2 / q) says how far it departs from a share q.
Terms with the same counts in all sources have the same f for every pair of sources, so
terms are grouped by their sparse vector of (source, count) entries first and each distinct
vector is evaluated once, times the number of its terms. Of a vector's pairs only those of
two sources that have its terms are made: a source that lacks them has the share of count
zero, so the other pairs need no more than each source's histogram of counts, and what is
left of the V terms has the one value of two zero counts. Ranks of terms are over the terms
themselves.

Words are sorted in the row, where each word's first place counts for its document, so that only
sums by (lang, source, term) are shuffled, partially summed; no key of these holds a hot
source's rows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, table, text_or_empty

#: What is no letter of a term: ASCII but for A-Z and a-z.
BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and non-ASCII characters, A-Z in lower case, in the order of the text; empty strings stand at breaks at its ends."""
    return F.transform(F.split(text, BREAKS, -1), lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term in each source."""
    rows = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), F.array_sort(words_of(text_or_empty())).alias("all"))
    before = F.concat(F.array(F.lit("")), F.slice("all", F.lit(1), F.size("all") - 1))
    each = rows.select("lang", "source", F.inline(F.arrays_zip("all", before))).toDF("lang", "source", "term", "last").filter("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("term") != F.col("last")).alias("df"))


def share(count: Column, total: Column, kept: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / (total + kept)), exact beyond 64 bits."""
    up = (count + 1).cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.expr("1") + F.call_function("div", up, (total + kept).cast("decimal(20,0)"))


def departure(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, *, least_docs: int = 3, scale: int = 1_000_000_000, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source).

    Null text, lang and source are empty strings. A language keeps the terms of at least
    ``least_docs`` of its documents. Part ``pair`` has each other source of the language, part
    ``term`` the ``top`` terms whose share in the source exceeds the language's; ties go by the
    UTF-8 order of the item. A source without terms has its pairs all the same; a language
    without kept terms has zeros for values; repeated rows count each; other columns are
    ignored, whatever their names; no rows give no rows. A term's vector, and a language's list
    of sources, have as many entries as the language has sources, of which the result holds the
    square. A sum beyond 63 bits is an error.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "divergence")
    entry = F.struct("source", "n")
    kept = (
        term_counts(docs).groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"), F.array_sort(F.collect_list(entry)).alias("counts"))
        .filter(F.col("df") >= least_docs).drop("df")
    )
    kept = keep.write(kept, "terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    sums = kept.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    every = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source")).distinct()
    groups = every.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["source_n", "v", "lang_n"])
    v, source_n = F.col("v"), F.col("source_n")
    none = F.when(v > 0, share(F.lit(0).cast("long"), source_n, F.greatest(v, F.lit(1)), scale))
    groups = keep.write(groups.withColumn("p_none", none), "groups")  # a row a source; written, so that Spark sees its size

    # one row for each distinct vector of a language and entry of it
    vectors = kept.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("m"))
    p = share(F.col("n"), source_n, v, scale)
    with_share = F.transform(
        "counts", lambda c: F.struct(c["source"].alias("source"), share(c["n"], F.element_at("sizes", c["source"]), v, scale).alias("p"), F.element_at("bare", c["source"]).alias("p_none"))
    )
    by_lang = groups.filter("v > 0").groupBy("lang").agg(
        F.map_from_entries(F.collect_list(F.struct("source", "source_n"))).alias("sizes"), F.map_from_entries(F.collect_list(F.struct("source", "p_none"))).alias("bare"), F.first("v").alias("v")
    )
    by_lang = keep.write(by_lang, "langs")
    shares = keep.write(vectors.join(by_lang, "lang").select("lang", "m", with_share.alias("shares")), "vectors")

    a, b = F.col("a"), F.col("b")
    both = shares.select("lang", "m", "shares", F.explode("shares").alias("a")).select("lang", "m", "a", F.explode("shares").alias("b")).filter(a["source"] != b["source"])
    over = departure(a["p"], b["p"]) - departure(a["p"], b["p_none"]) - departure(a["p_none"], b["p"]) + departure(a["p_none"], b["p_none"])
    both = both.groupBy("lang", a["source"].alias("source"), b["source"].alias("item")).agg(F.sum(F.col("m") * over).alias("value"))

    flat = shares.select("lang", "m", F.inline("shares")).groupBy("lang", "source", "p", "p_none").agg(F.sum("m").alias("m"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p_none").alias("q_none"))
    one = flat.join(other, "lang").filter("source <> other")
    q = F.col("q_none")
    mine = one.groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum(F.col("m") * (departure(F.col("p"), q) - departure(F.col("p_none"), q))).alias("value"))
    theirs = one.groupBy("lang", F.col("other").alias("source"), F.col("source").alias("item")).agg(F.sum(F.col("m") * (departure(q, F.col("p")) - departure(q, F.col("p_none")))).alias("value"))

    rest = groups.repartition("lang", "source").join(other, "lang").filter("source <> other")
    rest = rest.select("lang", "source", F.col("other").alias("item"), F.when(v > 0, v * departure(F.col("p_none"), q)).otherwise(F.lit(0).cast("long")).alias("value"))
    pairs = rest.union(both).union(mine).union(theirs).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    found = kept.select("lang", "term", "total", F.inline("counts")).join(groups, ["lang", "source"])
    lang_share = share(F.col("total"), F.col("lang_n"), v, scale)
    found = found.select("lang", "source", F.col("term").alias("item"), p.alias("p"), lang_share.alias("q")).filter("p > q")
    found = found.select("lang", "source", "item", departure(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    found = keep.write(ranked.unionByName(terms.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank"), "result")
    keep.drop("terms", "groups", "langs", "vectors")
    return found


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' sources, compared within their languages."""
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {"op13_divergence": op13_divergence}
ORACLE_SQL = {
    "op13_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), o AS (
            SELECT id, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
            FROM (SELECT id, lang, source, unnest(w) AS w FROM d)
        ), kept AS (
            SELECT lang, term, count(*)::HUGEINT AS total FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 3
        ), c AS (
            SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term
        ), g AS (
            SELECT DISTINCT lang, source FROM d
        ), k AS (
            SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS lang_n FROM kept GROUP BY lang
        ), s AS (
            SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source
        ), p AS (
            SELECT s.lang, s.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n + k.v) AS p,
                   1 + (1000000000::HUGEINT * (kept.total + 1)) // (k.lang_n + k.v) AS q
            FROM s JOIN k USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = kept.term
        ), pair AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
            UNION ALL
            SELECT a.lang, a.source, b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM k)
        ), term AS (
            SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
            UNION ALL
            SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term
        )
        SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """
}
