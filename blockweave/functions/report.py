"""Formatting of reported values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_value(value: Column, precision: int = 2, whole: Column | None = None) -> Column:
    """Whole numbers with thousands separators, small ones in scientific notation, others fixed."""
    whole = (value == F.floor(value)) if whole is None else whole
    return (
        F.when(value.isNull(), F.lit(None))
        .when(whole, F.format_number(value, 0))
        .when(F.abs(value) < 0.001, F.format_string(f"%.{precision}e", value))
        .otherwise(F.format_string(f"%.{precision}f", value))
    )


def digits(value: Column) -> Column:
    return F.length(value.cast("string"))


def close_to(a: Column, b: Column, tolerance: float = 0.001) -> Column:
    return F.abs(a - b) < tolerance
