"""Reproducible randomness: uniforms from md5, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """A uniform number in [0, 1) that depends on the seed and the keys only."""
    cols = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *cols)), 1, 8), 16, 10).cast("long") / TWO32


def uniform_52(seed: int | str, *keys: Column | str) -> Column:
    """As ``uniform``, of 52 bits."""
    cols = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *cols)), 1, 13), 16, 10).cast("long") / float(1 << 52)


def laplace(u: Column, scale: Column | float) -> Column:
    """Laplace noise from a uniform of 32 bits; u is moved by half a step, so it is never 0, 1 or the centre exactly."""
    v = u + 0.5 / TWO32
    return -scale * F.signum(v - 0.5) * F.log(1 - 2 * F.abs(v - 0.5))
