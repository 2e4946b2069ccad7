"""unpivot_positive with more event types than fifty."""

import pytest
from blockweave.plans.catalog_tables import QUERIES


def test_unpivot_positive_keeps_every_type(spark, tmp_path):
    spark.createDataFrame([(i % 2, f"t{i:02d}") for i in range(60)], "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["unpivot_positive"](spark, str(tmp_path)).collect()
    assert sorted((r.event_type, r.user_id, r.n) for r in out) == [(f"t{i:02d}", i % 2, 1) for i in range(60)]
    before = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "59")
    try:
        with pytest.raises(ValueError):
            QUERIES["unpivot_positive"](spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", before)
