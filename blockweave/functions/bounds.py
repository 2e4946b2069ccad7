"""Mixing-time bounds of a reversible lazy chain from its spectral gap."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1 / (2 * math.e)
INF = float("inf")


def reduced_bounds(n: Column, gap_low: Column, gap_high: Column, connected: Column) -> tuple[Column, Column]:
    """(lower, upper) for the chain over exact solutions."""
    lower = F.floor((1 / gap_high - 1) * math.log(1 / (2 * EPSILON))).cast("double")
    upper = F.ceil(F.log(n / EPSILON) / gap_low).cast("double")
    lower = F.when(n == 1, 1.0).when(~connected, INF).otherwise(lower)
    return lower, F.when(n == 1, 1.0).when(~connected | (gap_low <= 0), INF).otherwise(upper)


def simple_bounds(n: Column, gap_low: Column, gap_high: Column, density: Column) -> tuple[Column, Column, Column, Column]:
    """(lower, upper, expected lower, expected upper) for a chain over all partial solutions of this density."""
    lower = F.floor((1 / gap_high - 1) * F.log(3 / (4 * EPSILON * density))).cast("double")
    upper = F.when(gap_low <= 0, INF).otherwise(F.ceil(F.log(3 * n / (2 * EPSILON * density)) / gap_low).cast("double"))
    return lower, upper, lower / (density * (1 + 2 * EPSILON / 3)), upper / (density * (1 - 2 * EPSILON / 3))
