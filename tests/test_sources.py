"""Entry files, shards and resumed runs."""

import pytest
from blockweave.functions import keys, report, vectors
from blockweave.operators import audit, graph, pick, solve
from blockweave.plans import demo
from blockweave.plans import generate as plan
from blockweave.sources import blocks, households, shards
from blockweave.streaming import arrivals
from pyspark.sql import functions as F


def plain_households(lines):
    out = []
    for line in lines:
        if not line:
            continue
        if line.startswith("P"):
            if out:
                out[-1].append((int(line[36:38]), int(line[27]), int(line[21:23])))
        else:
            out.append([])
    return [tuple(people) for people in out if people]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_households_across_splits(spark, tmp_path, end):
    lines = [demo.person(1, 0, 30), ""]  # a person before any header belongs to none
    for i in range(700):
        people = [(1 + i % 5, i % 2, 18 + (i * k) % 70) for k in range(i % 6)]
        lines += [demo.header(1, 0), *[demo.person(*p) for p in people]]
    for name, part in (("one", lines), ("two", lines[:60])):
        (tmp_path / f"{name}.txt").write_bytes(end.join(part).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        read = households.read_lines(spark, str(tmp_path))
        assert read.select("file", "split").distinct().count() > 20
        rows = households.parse_households(read).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, part in (("one", lines), ("two", lines[:60])):
        mine = sorted((r for r in rows if r.file.endswith(f"{name}.txt")), key=lambda r: r.hh)
        race = households.RACE_OF_CODE
        assert [tuple((p.race, p.eth, p.age) for p in r.people) for r in mine] == [tuple((race[c], e, a) for c, e, a in h) for h in plain_households(part)]


def test_an_unknown_race_is_an_error(spark, tmp_path):
    (tmp_path / "x.txt").write_text("\n".join([demo.header(1, 0), demo.person(77, 0, 30)]))
    with pytest.raises(Exception, match="unknown race code"):
        households.parse_households(households.read_lines(spark, str(tmp_path))).collect()


def test_keys_stay_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("td_identifier,TOTAL,note\n010010201001000,5,a\n000000000000001,,\n")
    rows = blocks.read_keyed(spark, str(tmp_path), ["td_identifier"], ["TOTAL"]).collect()
    assert [tuple(r) for r in rows] == [("010010201001000", 5, "a"), ("000000000000001", None, None)]
    with pytest.raises(ValueError, match="missing"):
        blocks.read_keyed(spark, str(tmp_path), ["other"], [])
    (tmp_path / "u.csv").write_text("td_identifier,TOTAL,note\n01,x,a\n")
    with pytest.raises(Exception):
        blocks.read_keyed(spark, str(tmp_path), ["td_identifier"], ["TOTAL"]).collect()


def test_identifiers(spark):
    d = spark.createDataFrame([(1, 2, 3, 36), (1, 2, 4, 36)], "COUNTYA int, TRACTA int, BLOCKA int, STATEA int")
    d = d.withColumn("identifier", keys.block_identifier())
    blocks.check_identifiers(d)
    assert [tuple(r) for r in d.select("identifier", keys.swap_identifier(), keys.geoid()).collect()][0] == ("001-000002-0003", "000002-001-0003", "360010000020003")
    for bad in (d.union(d), d.withColumn("identifier", F.concat("identifier", F.lit("9")))):
        with pytest.raises(ValueError):
            blocks.check_identifiers(bad)


def test_shards(spark, tmp_path):
    for task, n in (("a", 1), ("a", 12), ("b", 2)):
        shards.write_once(spark.createDataFrame([(n,)], "n int").coalesce(1), f"{tmp_path}/{task}{n}_20.parquet")
    shards.write_once(spark.createDataFrame([(99,)], "n int"), f"{tmp_path}/a1_20.parquet")  # is there: nothing happens
    assert spark.read.parquet(f"{tmp_path}/a1_20.parquet").first().n == 1
    names = spark.createDataFrame([(f"{t}{n}_20.parquet",) for t, n in (("a", 1), ("a", 12), ("b", 2))] + [("c.txt",)], "name string")
    got = {r.stem: (r.name, r.n) for r in shards.latest(names, "name", r"^([a-z]+)(\d+)_20\.parquet$").collect()}
    assert got == {"a": ("a12_20.parquet", 12), "b": ("b2_20.parquet", 2)}
    flat = tmp_path / "flat"
    flat.mkdir()
    for task, n in (("a", 1), ("b", 2)):
        (flat / f"{task}{n}_20.parquet").write_bytes(next((tmp_path / f"{task}{n}_20.parquet").glob("part-*")).read_bytes())
    rows = shards.read_shards(spark, str(flat), r"^([a-z]+)(\d+)_20\.parquet$", ["task", "part"]).collect()
    assert sorted((r.n, r.task, r.part) for r in rows) == [(1, "a", "1"), (2, "b", "2")]


def test_arriving_shards(spark, tmp_path):
    folder, sink, kind = f"{tmp_path}/in", f"{tmp_path}/out", "id string, version int, x int"
    spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], kind).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    for more in (None, [("a", 3, 9), ("c", 1, 4)]):
        if more:
            spark.createDataFrame(more, kind).write.mode("append").parquet(folder)
        arrivals.follow(spark, schema, folder, sink, f"{tmp_path}/state").awaitTermination()
    assert sorted((r.id, r.x) for r in spark.read.parquet(sink).collect()) == [("a", 2), ("b", 3), ("c", 4)]


def test_an_ended_run_goes_on(spark, tmp_path, monkeypatch):
    members = spark.range(40).select(F.lit(1).alias("COUNTYA"), F.lit(1).alias("TRACTA"), F.floor(F.col("id") / 4).cast("int").alias("BLOCKA"), (F.col("id") % 7).cast("int").alias("kind"))
    table, sample = demo.blocks_of(members), demo.sample_households(spark)
    made, run = [], plan.generate

    def ends(blocks_, households_, **options):
        if len(made) == 1:
            raise KeyboardInterrupt
        made.append(1)
        return run(blocks_, households_, **options)

    monkeypatch.setattr(plan, "generate", ends)
    options = {"parts": 2, "n_best": 20, "refine_steps": 1}
    with pytest.raises(KeyboardInterrupt):
        plan.generate_into(table, sample, f"{tmp_path}/run", **options)
    again = []
    monkeypatch.setattr(plan, "generate", lambda b, h, **o: again.append(1) or run(b, h, **o))
    rows, unsolved = plan.generate_into(table, sample, f"{tmp_path}/run", **options)
    assert len(again) == 1 and unsolved.count() == 0
    sums = {r.identifier: (r.n, r.t) for r in rows.groupBy("identifier").agg(F.max("BLOCK_TOTAL").alias("n"), F.sum("TOTAL").alias("t")).collect()}
    assert len(sums) == 10 and all(n == t for n, t in sums.values())
    plan.generate_into(table, sample, f"{tmp_path}/run", **options)
    assert len(again) == 1


def test_small_functions(spark):
    names = households.category_names()
    assert len(names) == 135 and len(set(names)) == 135
    d = spark.createDataFrame([([0, 2, 1], [1, 0, 2], 1234.0, 0.0004)], "a array<int>, b array<int>, x double, y double")
    row = d.select(vectors.sparse_string("a", ["p", "q", "r"]).alias("s"), vectors.same_multiset("a", "b").alias("m"), report.digits(F.lit(1203)).alias("n"), report.close_to(F.col("y"), F.lit(0.0)).alias("c"), report.close_to(F.col("x"), F.lit(0.0)).alias("f")).first()
    assert tuple(row) == ("q=2,r=1", True, 4, True, False)
    few = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("b", None)], "k string, v int")
    assert sorted((r.k, r.v) for r in pick.top_per_group(few.na.drop(), ["k"], [F.col("v")], 1).collect()) == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="no value"):
        audit.required(few, "v", "no value").collect()
    assert sorted(tuple(r) for r in audit.classify_series(spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 1)], "s string, x int"), "s", "x").select("s", "status").collect()) == [("a", "complete"), ("b", "disconnected"), ("c", "incomplete")]
    loops = graph.with_loops(spark.createDataFrame([(0, 1, 0.25), (1, 0, 1.0)], "src int, dst int, weight double")).collect()
    assert sorted(tuple(r) for r in loops) == [(0, 0, 0.75), (0, 1, 0.25), (1, 0, 1.0), (1, 1, 0.0)]
    found = spark.createDataFrame([("a", 1, 0.0, 0), ("a", 2, 0.0, 2)], "block string, sol_rank int, log_w double, slack int")
    p = {r.sol_rank: r.p for r in solve.solution_probs(found, "block", gamma_slack=(0.5, "slack")).collect()}
    assert p[1] / p[2] == pytest.approx(2.718281828)
    w = solve.likelihoods(spark.createDataFrame([([2, 1], [0.5, 0.25])], "n array<int>, p array<double>"), "n", "p").first().log_w
    assert w == pytest.approx(-1.673976, abs=1e-6)  # ln 3 + 2 ln 0.5 + ln 0.25


def test_draws_follow_their_intervals(spark):
    dist = spark.createDataFrame([("k", i, float(1 + i % 3)) for i in range(50)] + [("one", 7, 0.1)], "k string, v int, p double")
    rows = spark.range(6000).select(F.when(F.col("id") % 6 == 5, "one").when(F.col("id") % 6 == 4, "none").otherwise("k").alias("k"), "id")
    got = pick.conditional_draw(rows, dist, ["k"], ["id"], ["v"], 3, buckets=16).collect()
    assert len(got) == 5000 and {r.v for r in got if r.k == "one"} == {7}
    share = [0] * 3
    for r in got:
        if r.k == "k":
            share[r.v % 3] += 1
    assert [round(x / 4000, 1) for x in share] == [0.2, 0.3, 0.5]
