"""Timings as JSON text and back."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtab.schemas import TIMINGS


def decode_timings(text: Column) -> Column:
    """Null and empty text give an empty list."""
    empty = F.array().cast(TIMINGS)
    return F.coalesce(F.from_json(F.nullif(text, F.lit("")), TIMINGS), empty)


def encode_timings(timings: Column) -> Column:
    return F.to_json(timings)
