"""Steps whose tasks or comparisons grew with the tables."""

import numpy as np
import pytest
from blockweave.llm.quality import document_features
from blockweave.operators import graph, swap
from blockweave.plans import catalog_models, town
from blockweave.sources import households, scratch
from pyspark.sql import functions as F


def test_wide_cells_are_halved_where_points_are_dense(spark):
    """One cell would hold all 30,000 points, 900 million pairs."""
    points = spark.range(30_000).select("id", F.lit("a").alias("b"), (F.col("id") * 7919 % 10007).cast("double").alias("x"), F.when(F.col("id") == 17, 1e7).otherwise(F.col("id") * 104729 % 9973).cast("double").alias("y"))
    got: dict[int, list] = {}
    for r in swap.nearest_partners(points, ["b"], "id", "x", "y", 3, 1e6).collect():
        got.setdefault(r.id, []).append((r["rank"], r.partner))
    rows = np.array([(r.x, r.y) for r in points.orderBy("id").collect()])
    assert len(got) == 30_000 and all(len(x) == 3 for x in got.values())
    for i in (0, 17, 4_321, 29_999):
        d = np.sqrt(((rows - rows[i]) ** 2).sum(axis=1))
        want = [j for j in np.lexsort((np.arange(len(d)), d)) if d[j] > 0][:3]
        assert sorted(got[i]) == list(enumerate(want, 1))


def test_lines_of_one_number_follow_the_file(spark, tmp_path):
    """The holder of a household is the first of its file's lines with the least number."""
    orders = spark.createDataFrame([(k, 0) for k in range(1, 41)], "o_orderkey long, o_custkey long")
    lines = [(k, 29 if k % 2 else 1, 1) for k in range(1, 41)] + [(k, 1 if k % 2 else 29, 1) for k in range(1, 41)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    people = catalog_models._people(catalog_models.Tables(spark, str(tmp_path)))
    homes = households.parse_households(town.record_lines(spark, people)).orderBy("file", "hh").collect()
    race = [households.RACE_OF_CODE[c] for c in town.CODES]
    assert [h.holder.race for h in homes] == [2 if k % 2 else race[k % 10] for k in range(1, 41)]


def test_lines_of_one_number_follow_the_table_s_files(spark, tmp_path):
    """A household's first line may lie far down in the first file and its second at the head of the next."""
    orders = spark.createDataFrame([(k, 0) for k in range(1, 41)], "o_orderkey long, o_custkey long")
    lines = [(0, 1, 1)] * 10 + [(k, 29 if k % 2 else 1, 1) for k in range(1, 41)], [(k, 1 if k % 2 else 29, 1) for k in range(40, 0, -1)]
    for i, rows in enumerate(lines):  # of one table, file by file
        spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/{i}")
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / str(i)).glob("*.parquet")).rename(tmp_path / f"lineitem.parquet/part-{i}.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    people = catalog_models._people(catalog_models.Tables(spark, str(tmp_path)))
    homes = households.parse_households(town.record_lines(spark, people)).orderBy("file", "hh").collect()
    race = [households.RACE_OF_CODE[c] for c in town.CODES]
    assert [h.holder.race for h in homes] == [2 if k % 2 else race[k % 10] for k in range(1, 41)]


def test_parts_grow_with_the_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "TASK_ROWS", 100)
    assert scratch.parts_of(spark, 100_001) == 1001 and scratch.parts_of(spark, 0) == spark.sparkContext.defaultParallelism
    kept = []
    write = graph.written
    monkeypatch.setattr(graph, "written", lambda d: kept.append(d.rdd.getNumPartitions()) or write(d))
    path = spark.range(1000).select(F.col("id").alias("src"), (F.col("id") + 1 - F.col("id") % 2).alias("dst")).filter("src <> dst")
    assert graph.components(path).count() == 1000
    assert kept[1] == 10


def test_pieces_of_a_split_are_numbered_on_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(households, "PIECE", 7)
    from blockweave.plans import demo

    (tmp_path / "x.txt").write_text("\n".join(line for i in range(300) for line in [demo.header(1, 0), *[demo.person(1, 0, 30 + i % 40)] * (i % 5)]))
    lines = households.read_lines(spark, str(tmp_path))
    assert "piece" in households.number_households(lines)._jdf.queryExecution().logical().toString()
    rows = sorted((r.hh, r.size) for r in households.parse_households(lines).collect())
    assert rows == [(i + 1, i % 5) for i in range(300) if i % 5]


@pytest.mark.parametrize("call", ["frontier_expand", "empirical_steps"])
def test_areas_are_worked_out_once(spark, sf, monkeypatch, call):
    seen, areas = [], catalog_models._areas
    monkeypatch.setattr(catalog_models, "_areas", lambda t: seen.append(1) or areas(t))
    catalog_models.QUERIES[call](spark, sf)
    assert len(seen) == 1


def test_features_are_held_in_32_bits():
    at, count = document_features("some words, some more words")
    assert at.dtype == count.dtype == np.int32 and count.sum() > 10
