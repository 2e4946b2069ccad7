"""household_struct counts a group's turns without collecting them."""

from blockweave.plans.catalog_models import QUERIES


def test_household_struct_collects_no_turns(spark, sf, tmp_path):
    rows = [(1, i, "user" if i == 0 else "assistant", "x" * i) for i in range(9)] + [(2, 0, "user", "abc"), (3, 0, "system", "ab"), (3, 1, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = QUERIES["household_struct"](spark, str(tmp_path))
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.conv_id, r.people, r.size, r.longest) for r in df.collect()} == {(1, 8, 7, 8), (3, 2, 2, 2)}
