"""The scan of a split table takes every category that it is for."""

import duckdb

from scoregate.plans import registry


def test_both_categories_are_scanned(spark, tmp_path):
    rows = [(i, f"Brand#{b}", "LARGE TIN", size) for i, (b, size) in enumerate([(1, 30), (1, 30), (1, 5), (11, 30), (11, 15), (12, 30), (10, 5)])]
    part = spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int")
    part.coalesce(1).write.parquet(f"file://{tmp_path}/part.parquet")
    want = [("test", "anomaly", 1, 1), ("test", "normal", 1, 0), ("train", "normal", 3, 0)]
    got = registry.QUERIES["split_table_scan"](spark, f"file://{tmp_path}")
    assert sorted((r["split"], r["label"], r["row_count"], r["mask_count"]) for r in got.collect()) == want
    db = duckdb.connect()
    db.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    found = db.sql(registry.ORACLE_SQL["split_table_scan"])
    assert sorted(tuple(r[found.columns.index(c)] for c in ("split", "label", "row_count", "mask_count")) for r in found.fetchall()) == want
