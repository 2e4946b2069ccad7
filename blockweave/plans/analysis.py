"""One row of analysis for each area's chain: its graph, gap, density and mixing bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.functions.bounds import reduced_bounds, simple_bounds
from blockweave.operators.chains import solution_density
from blockweave.operators.spectrum import spectral_gaps
from blockweave.operators.transitions import transition_graphs


def analyse(targets: DataFrame, elements: DataFrame, key: str, counts: str, kind: str, param: float) -> DataFrame:
    """(key, kind, param, num_states, num_solutions, is_connected, spectral_gap, tolerance, density, lower, upper, expected_lower, expected_upper).

    The bounds are of the mixing time; for chains on exact solutions there are no expected ones (null).  An area without a state has no row, one
    whose chain is not connected an infinite upper bound, one that has no solution null ones in the chains on all multisets.
    """
    edges = transition_graphs(targets, elements, key, counts, kind, param)
    mass = solution_density(edges, [key]).select(key, "num_solutions", F.col("solution_density").alias("density"))
    d = spectral_gaps(edges, [key]).join(mass, key)
    # the gap is known up to its tolerance
    high, low = F.least(F.lit(1.0), F.col("spectral_gap") + F.col("tolerance")), F.col("spectral_gap") - F.col("tolerance")
    if kind == "reduced":
        lower, upper = reduced_bounds(F.col("num_states"), low, high, F.col("is_connected"))
        expected = [F.lit(None).cast("double")] * 2
    else:
        lower, upper, *expected = simple_bounds(F.col("num_states"), low, high, F.when(F.col("density") > 0, F.col("density")))
    told = zip((lower, upper, *expected), ("lower", "upper", "expected_lower", "expected_upper"), strict=True)
    return d.select(key, F.lit(kind).alias("kind"), F.lit(float(param)).alias("param"), "num_states", "num_solutions", "is_connected", "spectral_gap", "tolerance", "density", *[c.cast("double").alias(n) for c, n in told])
