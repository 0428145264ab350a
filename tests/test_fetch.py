"""Fetching with a stand-in for the network."""

from catalyte.functions import jsontags
from catalyte.sources import fetch
from pyspark.sql import functions as F


def fake(url, agent):
    if url == "refused":
        raise ConnectionError("no route")
    return {"good": (200, "image/png", b"x"), "page": (200, "text/html", b"x"), "gone": (404, "", b""), "busy": (429, "", b"")}[url]


def test_fetch_one():
    pauses = []
    assert fetch.fetch_one(["gone", "good"], fake, pauses.append) == (b"x", 200, None) and pauses == []
    assert fetch.fetch_one(["page"], fake, pauses.append)[2] == "not_an_image"
    assert fetch.fetch_one(["busy"], fake, pauses.append) == (None, 429, "http_429") and pauses == [1.0, 3.0, 7.0]
    assert fetch.fetch_one(["refused"], fake, pauses.append)[2].startswith("ConnectionError|") and fetch.fetch_one([], fake)[2] == "no address"


def test_fetched(spark):
    def local(url, agent):
        return (200, "image/png", b"ok") if url == "good" else (404, "", b"")

    df = spark.createDataFrame([(1, "good", None), (2, "gone", None), (3, None, None)], "id long, url string, original string")
    got = {r.id: (r.content and bytes(r.content), r.error) for r in fetch.fetched(df, "id", "url", "original", local, lambda s: None).collect()}
    assert got == {1: (b"ok", None), 2: (None, "http_404"), 3: (None, "no address")}


def test_json(spark):
    rows = [('["a","b"]',), ('"quoted"',), ("plain",), (" ",), (None,)]
    df = spark.createDataFrame(rows, "v string")
    assert [r.x for r in df.select(jsontags.scalar(F.col("v")).alias("x")).collect()] == ["a", "quoted", "plain", None, None]
    one = spark.range(1).select(jsontags.merged(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3"}')).alias("m"), jsontags.merged(F.lit(None).cast("string"), F.lit("broken")).alias("n"), jsontags.accents(F.lit('[{"color":"Gold","strength":0.5}]')).alias("a"), jsontags.safe_segment(F.lit("../x")).alias("s")).first()
    assert one.m == '{"a":"1","b":"3"}' and one.n == "{}" and one.a[0].color == "gold" and not one.s
