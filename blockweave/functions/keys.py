"""Composite geographic keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths of the state, county, tract, block group and block prefixes of a 15-digit geoid.
PREFIXES = (2, 5, 11, 12, 15)


def padded_key(parts: list[tuple[Column | str, int]], sep: str = "-") -> Column:
    """Zero-padded parts joined by ``sep``.  Unlike lpad it never cuts a number that is too wide."""
    return F.format_string(sep.join(f"%0{w}d" for _, w in parts), *[F.col(c) if isinstance(c, str) else c for c, _ in parts])


def block_identifier(county="COUNTYA", tract="TRACTA", block="BLOCKA") -> Column:
    return padded_key([(county, 3), (tract, 6), (block, 4)])


def swap_identifier(tract="TRACTA", county="COUNTYA", block="BLOCKA") -> Column:
    return padded_key([(tract, 6), (county, 3), (block, 4)])


def geoid(state="STATEA", county="COUNTYA", tract="TRACTA", block="BLOCKA") -> Column:
    return padded_key([(state, 2), (county, 3), (tract, 6), (block, 4)], "")


def key_part(key: Column | str, i: int, sep: str = "-") -> Column:
    return F.split(key, sep)[i].cast("int")


def strip_suffix(key: Column | str) -> Column:
    """The key without a trailing household number."""
    return F.regexp_replace(key, "-[0-9]+$", "")
