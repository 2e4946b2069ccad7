"""Near-duplicate embeddings by a dual traversal of a cover tree.

The tree is built level by level over all vectors: the net of a node's children is separated by half the node's
radius, and each vector goes to its nearest child.  The traversal then goes down level by level over pairs of nodes:
a pair whose centres are further apart than both covering radii and the threshold is dropped, a pair that lies
within the threshold as a whole is counted without a look at its vectors, the rest meet as blocks of leaves.

Where vectors lie all about, no bound drops a pair, and every block meets every other.  A block is then sent to half of
the others, which is a multiple of the input that grows with it; so the blocks meet in rounds, each of which sends about as
much as there is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import connected_components, counted_broadcast, discard, materialize, ordered_numbers

LEAF = 4096  # vectors of a node that is not split further, and of a block
LEAF_NUMBERS = 1 << 18  # of the vectors of a block, where they are long
TILE = 1024  # vectors of two blocks that are compared at once
ROUND = 1.5  # of all vectors' numbers that a round sends at most on average
ROUND_NUMBERS = 1 << 25  # that a round sends in any case
TASK_NUMBERS = 1 << 21  # of a task of a round on average
FAN = 32  # children of a node at most
SALT_ROWS = 20_000  # vectors of a node that one task assigns
MAX_LEVELS = 10  # a node that is larger than a leaf after so many levels is cut into blocks, without loss
SLACK = 1e-6  # of distances near 0, where the root of a difference is inexact


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow, no loss of tiny numbers
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _unit_column(v: Column) -> Column:
    """As ``unit``; each step's number is bound once to a lambda variable, not worked out again for each entry."""
    scaled = F.transform(F.array(F.array_max(F.transform(v, F.abs))), lambda m: F.transform(v, lambda x: x / m))[0]
    norms = F.transform(F.array(scaled), lambda y: F.struct(y.alias("y"), F.sqrt(F.aggregate(y, F.lit(0.0), lambda s, x: s + x * x)).alias("n")))
    return F.transform(norms, lambda z: F.transform(z.y, lambda x: x / z.n))[0]


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


def _assign(points: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """Each vector's nearest child of its node."""
    if not len(points) or not len(centres):
        return pd.DataFrame({"pid": points["pid"], "centre": -1, "far": 0.0})
    centres = centres.sort_values("pid").drop_duplicates("pid")
    net = unit(np.stack(centres["v"].to_list()))
    between = chord(net @ net.T)
    half = between[0].max() / 2
    kept = [0]
    for i in range(1, len(net)):
        if len(kept) < FAN and (between[i, kept] > half).all():
            kept.append(i)
    away = chord(unit(np.stack(points["v"].to_list())) @ net[kept].T)
    near = away.argmin(axis=1)
    return pd.DataFrame({"pid": points["pid"], "centre": centres["pid"].to_numpy()[kept][near], "far": away[np.arange(len(near)), near]})


def _block(points: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, weights and unit vectors of a block."""
    v = points.field("v").flatten().to_numpy(zero_copy_only=False)
    return points.field("pid").to_numpy(), points.field("m").to_numpy(), unit(v.reshape(len(points), -1))


def _tile(threshold: float, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], own: bool) -> tuple[np.ndarray, ...]:
    """(pid, t, root) of the vectors of two tiles that link: the weight of those each links with, its component's smallest id."""
    if not own:  # most vectors link with none of the other tile's, as single precision shows: its error is below (n + 2) / 2 ** 24
        least = threshold - (a[2].shape[1] + 8) / 2**23
        near = a[3] @ b[3].T
        rows = np.flatnonzero(near.max(axis=1) >= least)
        cols = np.flatnonzero(near[rows].max(axis=0, initial=-2.0) >= least)
        a, b = tuple(x[rows] for x in a), tuple(x[cols] for x in b)
    (pa_, ma, ua), (pb, mb, ub) = a[:3], b[:3]
    linked = ua @ ub.T >= threshold
    if own:
        np.fill_diagonal(linked, True)
    i, j = np.nonzero(linked)
    ta = np.bincount(i, weights=mb[j], minlength=len(ma)).astype(np.int64)  # whole numbers below 2 ** 53
    tb = np.bincount(j, weights=ma[i], minlength=len(mb)).astype(np.int64)
    big = np.iinfo(np.int64).max
    la, lb = pa_.copy(), pb.copy()
    ra, rb = np.flatnonzero(ta), np.flatnonzero(tb)
    part = linked[np.ix_(ra, rb)]
    while True:  # smallest id over links, to and fro
        lb2 = np.minimum(lb[rb], np.where(part, la[ra][:, None], big).min(axis=0, initial=big))
        la2 = np.minimum(la[ra], np.where(part, lb2[None, :], big).min(axis=1, initial=big))
        done = (lb2 == lb[rb]).all() and (la2 == la[ra]).all()
        la[ra], lb[rb] = la2, lb2
        if done:
            break
    return (pa_[ra], ta[ra], la[ra]) if own else tuple(np.concatenate(x) for x in ((pa_[ra], pb[rb]), (ta[ra], tb[rb]), (la[ra], lb[rb])))


def _meet(threshold: float):
    """Links of a block (a, ka), which comes first, with itself if it is ``alone`` with itself, and with the blocks (b, kb) that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            keys = batch.select(["a", "ka", "own", "alone"]).to_pylist()
            for row, x in zip(keys, batch["x"], strict=True):
                block = _block(x.values)
                block = (*block, block[2].astype(np.float32))
                tiles = [tuple(c[i : i + TILE] for c in block) for i in range(0, len(block[0]), TILE)]
                if row["own"]:
                    at, held = (row["a"], row["ka"]), tiles
                    met = [(p, q, p is q) for i, p in enumerate(tiles) for q in tiles[i:]] if row["alone"] else []
                elif at != (row["a"], row["ka"]):
                    raise ValueError("a block came before the one that it meets")
                else:
                    met = [(p, q, False) for p in held for q in tiles]
                for p, q, own in met:
                    found = _tile(threshold, p, q, own)
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["pid", "t", "root"])

    return run


def _rounds(pairs: DataFrame, blocks: DataFrame) -> tuple[DataFrame, int, int]:
    """Which block goes to which: (a, ka, b, kb, own, alone, round) says that block (b, kb) is sent to (a, ka); the rounds; the tasks of each.

    Of two blocks, chance says which one is sent.  A block that gets others gets itself first (``own``), in the same
    round; ``alone`` says whether its vectors meet each other too.
    """
    listed = materialize(blocks.select("node", "k", F.size("x").cast("long").alias("n"), (F.size("x") * F.size(F.col("x")[0]["v"])).cast("long").alias("numbers")), "listed")
    there = listed.agg(F.coalesce(F.sum("numbers"), F.lit(0))).first()[0]
    one, two = (listed.select(F.col("node").alias(s), F.col("k").alias(f"k{s}"), F.col("numbers").alias(f"n{s}")) for s in "ab")
    met = pairs.select("a", "b").join(one, "a").join(two, "b").filter("a <> b or ka <= kb")
    way = F.pmod(F.xxhash64("a", "ka", "b", "kb"), F.lit(2)) == 0
    x, y = F.struct("a", "ka", "na"), F.struct(F.col("b").alias("a"), F.col("kb").alias("ka"), F.col("nb").alias("na"))
    met = met.select(F.when(way, x).otherwise(y).alias("x"), F.when(way, y).otherwise(x).alias("y"))
    met = materialize(met.select("x.a", "x.ka", "x.na", F.col("y.a").alias("b"), F.col("y.ka").alias("kb"), F.col("y.na").alias("nb")), "met")
    same = F.expr("a = b and ka = kb")
    heads = met.groupBy("a", "ka", "na").agg(F.max(same).alias("alone"))
    heads = heads.select("a", "ka", F.col("a").alias("b"), F.col("ka").alias("kb"), F.col("na").alias("nb"), F.lit(True).alias("own"), "alone")
    sent = materialize(heads.union(met.filter(~same).select("a", "ka", "b", "kb", "nb", F.lit(False), F.lit(False))), "sent")
    total = sent.agg(F.coalesce(F.sum("nb"), F.lit(0))).first()[0]
    rounds = max(1, math.ceil(total / max(ROUND * there, ROUND_NUMBERS)))
    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, math.ceil(total / rounds / TASK_NUMBERS))
    return sent.drop("nb").withColumn("round", F.pmod(F.xxhash64(F.lit(5), "a", "ka"), F.lit(rounds))), rounds, tasks


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """One row per vector: id_col, n_links (other vectors linked directly), component_id, kept.

    Two vectors link when their labels are equal and not null (with ``label_col``), their lengths agree, and their
    cosine in double precision is ``threshold`` or more.  component_id is the smallest id reachable by links, itself
    included; kept says that it is the vector's own.

    Null vectors, and those that are empty, zero or hold a null or a number that is not finite, link with nothing; so do
    rows with a null label or a null id (whose component is null).  Equal vectors are one point with a weight,
    so copies link with each other and cost nothing; rows that repeat an id count as vectors of their own.
    An empty table gives no rows; other columns are ignored.  ``threshold`` is between 0.5 and 1.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold is between 0.5 and 1")
    theta = float(np.sqrt(2 - 2 * threshold))
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()
    label = F.lit("") if label_col is None else F.col(label_col).cast("string")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"), label.alias("label"), F.when(label.isNull(), False).otherwise(F.coalesce(sound, F.lit(False))).alias("sound"))
    rows = rows.withColumn("h1", F.xxhash64("label", "v")).withColumn("h2", F.xxhash64(F.lit(7), "v", "label"))
    named = materialize(rows.select("id", "sound", "h1", "h2"), "vectors")
    copies = materialize(named.filter("sound").groupBy("h1", "h2").agg(F.min("id").alias("pid"), F.count(F.lit(1)).alias("m")), "points")
    per_id = copies.groupBy("pid").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    copies = copies.withColumn("own", F.col("pid"))
    if per_id > 1:  # an id names several points: number the ids in their order and the points of each
        nth = F.row_number().over(Window.partitionBy("pid").orderBy("h1", "h2")) - 1
        numbers = ordered_numbers(copies.select("pid").distinct(), "pid", "number")
        copies = materialize(copies.withColumn("nth", nth).join(numbers, "pid").withColumn("pid", F.col("number") * per_id + F.col("nth")).drop("number", "nth"), "points")
    points = rows.filter("sound").join(copies, ["h1", "h2"]).filter("id = own").dropDuplicates(["h1", "h2"])
    root = F.xxhash64("label", F.size("v"))
    points = materialize(points.select("pid", "m", "v", root.alias("node"), F.array(root).alias("path")), "level")

    weights = points.groupBy("node").agg(F.min("pid").alias("rep"), F.sum("m").alias("weight"))
    pairs = materialize(weights.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(False).alias("inside"), "weight", "rep", F.col("weight").alias("weight_b"), F.col("rep").alias("rep_b")), "pairs")
    inside, largest = None, None
    leaf = F.least(F.lit(LEAF), F.greatest(F.lit(16), F.floor(F.lit(LEAF_NUMBERS) / F.col("dim")))).cast("long")
    for _ in range(MAX_LEVELS):
        sizes = materialize(points.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).withColumn("leaf", leaf).withColumn("split", F.col("n") > F.col("leaf")), "sizes")
        most = sizes.filter("split").agg(F.max("n"), F.count(F.lit(1))).first()
        if most[1] == 0 or tuple(most) == largest:
            break
        largest = tuple(most)
        sized = points.join(counted_broadcast(sizes), "node").withColumn("u", F.pmod(F.xxhash64(F.lit(3), "pid"), F.lit(1 << 30)) / float(1 << 30))
        fan = F.least(F.lit(FAN), F.greatest(F.lit(2), F.ceil(F.col("n") * 2 / F.col("leaf"))))
        salts = F.ceil(F.col("n") / SALT_ROWS)
        centres = sized.filter("split").filter(F.col("u") < 4 * fan / F.col("n")).select("node", "pid", "v", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1)).alias("salt"))
        moved = sized.filter("split").select("node", "pid", "v", F.pmod(F.xxhash64(F.lit(9), "pid"), salts).cast("int").alias("salt"))
        centres = materialize(centres, "centres")
        moved = moved.groupBy("node", "salt").cogroup(centres.groupBy("node", "salt")).applyInPandas(_assign, "pid long, centre long, far double")
        moved = materialize(moved, "assigned")
        child = F.when(F.col("centre") >= 0, F.xxhash64("node", "centre")).otherwise(F.col("node"))
        level = points.join(moved, "pid", "left").withColumn("child", F.coalesce(child, F.col("node")))
        level = materialize(level.select("pid", "m", "v", "node", F.col("child"), "centre", "far", F.concat("path", F.array("child")).alias("path")), "level")
        # a node that is not split is its own only child, with no bound to prune by
        nodes = level.groupBy("node", "child").agg(F.max("far").alias("radius"), F.sum("m").alias("weight"), F.min("pid").alias("rep"), F.min("centre").alias("centre"))
        middle = centres.dropDuplicates(["pid"]).select(F.col("pid").alias("centre"), _unit_column(F.transform("v", lambda x: x.cast("double"))).alias("c"))
        nodes = materialize(nodes.join(middle, "centre", "left").drop("centre"), "nodes")
        x = nodes.select(F.col("node").alias("a"), F.col("child").alias("ca"), F.col("c").alias("va"), F.col("radius").alias("ra"), "weight", "rep")
        y = nodes.select(F.col("node").alias("b"), F.col("child").alias("cb"), F.col("c").alias("vb"), F.col("radius").alias("rb"), F.col("weight").alias("weight_b"), F.col("rep").alias("rep_b"))
        apart = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, z: s + z))
        down = pairs.select("a", "b").join(x, "a").join(y, "b").filter("a <> b or ca <= cb").withColumn("apart", apart)
        down = down.filter(F.coalesce(F.col("apart") <= F.col("ra") + F.col("rb") + theta + SLACK, F.lit(True)))
        down = down.withColumn("inside", F.coalesce(F.col("apart") + F.col("ra") + F.col("rb") <= theta - SLACK, F.lit(False)))
        down = materialize(down.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "inside", "weight", "rep", "weight_b", "rep_b"), "pairs")
        whole = down.filter("inside")
        inside = whole if inside is None else inside.unionByName(whole)
        pairs = down.filter("not inside")
        discard(points, centres, moved)
        points = level.select("pid", "m", "v", F.col("child").alias("node"), "path")

    # leaves meet in blocks, of which each round sends some
    sizes = materialize(points.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).withColumn("leaf", leaf), "sizes")
    block = F.pmod(F.xxhash64(F.lit(9), "pid"), F.ceil(F.col("n") / F.col("leaf"))).cast("int")
    blocks = points.join(counted_broadcast(sizes), "node").withColumn("k", block).groupBy("node", "k").agg(F.collect_list(F.struct("pid", "m", "v")).alias("x"))
    blocks = materialize(blocks, "blocks")
    paths = materialize(points.select("pid", "path"), "paths")
    discard(points)
    sent, rounds, tasks = _rounds(pairs, blocks)
    met = []
    for i in range(rounds):
        now = F.broadcast(sent.filter(F.col("round") == i).drop("round"))  # a row for each block that is sent: as many as all blocks or so
        now = blocks.join(now, (F.col("node") == F.col("b")) & (F.col("k") == F.col("kb"))).select("a", "ka", "own", "alone", "x")
        now = now.repartition(tasks, "a", "ka").sortWithinPartitions("a", "ka", F.col("own").desc())
        now = now.mapInArrow(_meet(threshold), "pid long, t long, root long")
        met.append(materialize(now.groupBy("pid", "root").agg(F.sum("t").alias("t")).select("pid", "t", "root"), "round"))
    found = reduce(DataFrame.unionByName, met)
    discard(blocks)
    if inside is not None:
        sides = inside.select("a", "weight_b", "rep_b").union(inside.filter("a <> b").select("b", "weight", "rep"))
        sides = sides.toDF("node", "t", "root").groupBy("node").agg(F.sum("t").alias("t"), F.min("root").alias("root"))
        through = paths.select("pid", F.explode(F.array_distinct("path")).alias("node")).join(sides, "node").select("pid", "t", "root")
        bridges = inside.select(F.col("rep").alias("pid"), F.lit(0).cast("long").alias("t"), F.col("rep_b").alias("root"))
        found = found.unionByName(through).unionByName(bridges)
    found = materialize(found.groupBy("pid", "root").agg(F.sum("t").alias("t")), "links")
    total = found.groupBy("pid").agg((F.sum("t") - 1).alias("n_links"))
    classes = connected_components(found.select(F.col("pid").alias("u"), F.col("root").alias("v")))
    known = copies.join(total, "pid", "left").join(classes.withColumnRenamed("id", "pid"), "pid", "left")
    known = known.select("h1", "h2", F.lit(True).alias("sound"), "n_links", F.coalesce("component_id", "pid").alias("component_id"))
    if per_id > 1:
        known = known.join(copies.select(F.col("pid").alias("component_id"), "own"), "component_id").drop("component_id").withColumnRenamed("own", "component_id")
    known = materialize(known, "known")
    out = named.join(known, ["h1", "h2", "sound"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )
