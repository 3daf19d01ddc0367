"""Moments as whole microseconds, and bins of them."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without a time zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def bin_of(at: str | Column, width: int | Column) -> Column:
    """Number of the bin of a width that a whole number falls in, exact for all numbers, negative ones too."""
    at, width = F.col(at) if isinstance(at, str) else at, F.lit(width) if isinstance(width, int) else width
    return F.call_function("div", at - F.pmod(at, width), width)
