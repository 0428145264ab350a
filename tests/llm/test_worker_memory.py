"""What a Python worker keeps from stage to stage of a session."""

import public_tokenizers

from catalyte.llm import _shared, decontaminate, packing, quality


def test_a_worker_keeps_one_operators_memo_at_a_time():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert quality.units("Some words")[0].size == 2 and list(_shared._KEPT) == ["units"]
    assert len(decontaminate.shingle_hashes([b"some", b"words"], 1)) == 2 and list(_shared._KEPT) == ["hashes"]
    one = packing.encoder(path, 1000)
    assert list(_shared._KEPT) == [("encoder", path, 1000)] and packing.encoder(path, 1000) is one
    assert packing.encoder(path, 10) is not one and len(_shared._KEPT) == 1


def test_decontamination_starts_no_workers_for_rows_of_the_driver(spark, monkeypatch):
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    docs = spark.range(2).selectExpr("id AS doc_id", "'one two three four five six' AS text")
    items = docs.selectExpr("doc_id + 7 AS item_id", "text")
    assert decontaminate.contained(docs, items).count() == 4 and decontaminate.contained(docs, items.limit(0)).count() == 0
    kinds = [k for _, k in decontaminate.contained(docs, items.limit(0)).dtypes]
    assert kinds == ["bigint", "bigint", "int", "int", "double"]
