"""Timestamps at whole-second resolution."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STAMP = "yyyyMMddHHmmss"


def parse_stamp(c: Column | str) -> Column:
    """'yyyyMMddHHmmss' text to a timestamp; NULL where it is not a real date."""
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c, F.lit(STAMP))


def epoch(c: Column | str) -> Column:
    return F.unix_timestamp(c)


def seconds_between(earlier: Column | str, later: Column | str) -> Column:
    return epoch(later) - epoch(earlier)
