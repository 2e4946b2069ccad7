"""End to end: block counts and a sample of households to synthetic household rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.operators.assemble import add_adults, household_rows, microdata, to_output
from blockweave.operators.chains import sample_chains
from blockweave.operators.pick import weighted_draw
from blockweave.operators.solve import MAX_NODES, enumerate_solutions, lexicographic, solution_probs
from blockweave.sources.blocks import IDENTITY, age_is_valid, encode
from blockweave.sources.households import check_ages, household_distribution
from blockweave.sources.scratch import written


def generate(blocks: DataFrame, households: DataFrame, n_best: int = 5000, seed: int = 0, refine_steps: int = 10_000, k: int = 3, max_nodes: int = MAX_NODES, ratios: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(microdata, unsolved blocks: identifier and the level whose search was cut off, null where no level has a solution).

    Households of the sample whose ages contradict their header are left out.  Levels 1, 2 and 3 are tried in turn for the blocks that the one before could not solve; a block of one household with
    valid ages is its own solution.  ``ratios`` (key: 9-vector, ratio) re-weight the sample, as dist.adjustment gives them.  A block whose search was cut off before it found any is not tried at coarser levels.  Of a block's solutions one is drawn by likelihood; where their pool was full, a chain
    goes on from there.  Levels 2 and 3 leave ages out where a block's are contradictory, and draw them from the sample.
    """
    blocks = written(blocks.withColumn("_age", age_is_valid()))
    households = written(households.join(check_ages(households).select("file", "hh"), ["file", "hh"], "left_anti"))
    sample = written(household_distribution(households, 3, ratios=ratios))
    alone = (F.col("H8M001") == 1) & F.col("_age")
    itself = to_output(encode(1), 1, True)
    rows = blocks.filter(alone).select("identifier", F.lit(0).alias("HH_NUM"), itself.alias("out"), F.lit(1).alias("ACCURACY"), F.lit(True).alias("AGE_ACCURACY"))
    left = written(blocks.filter(~alone))
    undecided = None
    for level in (1, 2, 3):
        solved = None
        for use_age in (True,) if level == 1 else (True, False):
            own = left if level == 1 else left.filter(F.col("_age") == use_age)
            elements = written(lexicographic(household_distribution(households, level, use_age, ratios)))
            targets = own.select("identifier", encode(level, use_age).alias("counts"))
            found = written(enumerate_solutions(targets, elements, "identifier", "counts", n_best, max_nodes))
            cut = found.filter("elems is null").select("identifier", F.lit(level).alias("level"))
            undecided = cut if undecided is None else undecided.unionByName(cut)
            found = found.filter("elems is not null")
            chosen = weighted_draw(solution_probs(found, "identifier"), ["identifier"], "p", ["sol_rank"], seed).select("identifier", "elems", "complete")
            open_ = targets.join(chosen.filter("not complete").select("identifier", F.col("elems").alias("start")), "identifier")
            moved = sample_chains(open_, elements, "identifier", "counts", steps=refine_steps, k=k, seed=seed, max_nodes=max_nodes, start="start").filter("exact")
            moved = moved.select("identifier", F.col("elems").alias("moved"))
            chosen = chosen.join(moved, "identifier", "left").select("identifier", F.coalesce("moved", "elems").alias("elems"))
            made = household_rows(chosen, elements, "identifier").select("identifier", F.col("pos").alias("HH_NUM"), to_output(F.col("v"), level, use_age).alias("out"), F.lit(level).alias("ACCURACY"))
            made = made.join(blocks.select("identifier", F.col("_age").alias("AGE_ACCURACY")), "identifier")
            solved = made if solved is None else solved.unionByName(made)
        solved = written(solved)
        rows = rows.unionByName(solved.select(*rows.columns))
        left = written(left.join(solved.select("identifier").distinct(), "identifier", "left_anti").join(undecided.select("identifier"), "identifier", "left_anti"))
    full = add_adults(rows, sample, seed)
    identity = [c for c in IDENTITY if c in blocks.columns]
    return microdata(full, blocks, identity), undecided.unionByName(left.select("identifier", F.lit(None).cast("int").alias("level")))


def generate_into(blocks: DataFrame, households: DataFrame, folder: str, parts: int = 16, **options) -> tuple[DataFrame, DataFrame]:
    """``generate`` in ``parts`` of the blocks, each written to ``folder`` before the next one; what is there already is not made again.

    A run that was ended goes on with the part it was at.  A block's part depends on its identifier only; its rows, in whichever run they are made, on the
    options.  The result is read from the folder.
    """
    spark = blocks.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for i in range(parts):
        own = f"{folder.rstrip('/')}/rows/part={i}", f"{folder.rstrip('/')}/unsolved/part={i}"
        if all(files.exists(path(f"{p}/_SUCCESS")) for p in own):
            continue
        made = generate(blocks.filter(F.pmod(F.xxhash64("identifier"), F.lit(parts)) == i), households, **options)
        for df, p in zip(made, own, strict=True):
            df.write.mode("overwrite").parquet(p)
    return tuple(spark.read.parquet(f"{folder.rstrip('/')}/{what}").drop("part") for what in ("rows", "unsolved"))
