"""Rows of CSV files are numbered by file and place, however they are split."""

import pytest
from pyspark.sql import functions as F

from catalyte.sources import csv_contract

HEADER = "object_key,url,packing_list_id,company_stone_id,vendor name,name"


@pytest.fixture
def folder(tmp_path):
    """Three files, the last the largest, which Spark would read first; keys repeat within and between them."""
    line = 0
    for name, n in (("a.csv", 40), ("b.csv", 3), ("c.csv", 4000)):
        rows = []
        for _ in range(n):
            rows.append(f"key{line * 7919 % 1500},http://x/{line},p{line % 9},s{line % 50},v,n{line}")
            line += 1
        (tmp_path / name).write_text("\n".join([HEADER, *rows]) + "\n")
    return str(tmp_path), line


@pytest.mark.parametrize("split", ["1m", "9000", "2500"])
@pytest.mark.parametrize("multi_line", [True, False])
def test_order_and_first_wins(spark, folder, split, multi_line):
    path, lines = folder
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        df = csv_contract.read_csv(spark, path, HEADER.split(","), multi_line=multi_line)
        if not multi_line and split != "1m":
            assert df.rdd.getNumPartitions() > 8
        numbered = csv_contract.in_file_order(df).select("ingest_seq", F.substring("url", 10, 9).cast("long").alias("line")).collect()
        assert sorted((r.ingest_seq, r.line) for r in numbered) == [(k, k) for k in range(lines)]
        won = csv_contract.to_dataset(csv_contract.in_file_order(df), "d").select("image_asset_id", "ingest_seq", "stone_name_raw").collect()
        first = {}
        for k in range(lines):
            first.setdefault(f"key{k * 7919 % 1500}", k)
        assert {r.image_asset_id: (r.ingest_seq, r.stone_name_raw) for r in won} == {key: (k, f"n{k}") for key, k in first.items()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
