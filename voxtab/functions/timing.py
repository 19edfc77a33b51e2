"""Time and rate expressions: estimates, ETAs, word rates, timestamp shapes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtab.constants import (
    FIXED_OVERHEAD_SEC,
    MIN_WORDS_PER_SECOND,
    SECONDS_PER_BLOCK,
    SHORT_CHECK_MIN_SECONDS,
    SHORT_CHECK_SECONDS_PER_WORD,
    SPEED_FACTOR,
)

ETA_FORMAT = "yyyy-MM-dd HH:mm:ss"


def processing_estimate(duration_sec: Column) -> Column:
    blocks = F.ceil(duration_sec / F.lit(SPEED_FACTOR))
    return (blocks * SECONDS_PER_BLOCK + FIXED_OVERHEAD_SEC).cast("bigint")


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("bigint") * 1_000_000)


def eta_text(ts: Column) -> Column:
    """A UTC time as text; the session time zone must be UTC."""
    return F.concat(F.date_format(ts, ETA_FORMAT), F.lit(" UTC"))


def status_eta(created_at: Column, ahead: Column, own: Column) -> Column:
    return eta_text(add_seconds(created_at, ahead + own))


def words_per_second(words: Column, duration_sec: Column) -> Column:
    return F.when(duration_sec > 0, words / duration_sec).otherwise(F.lit(0.0))


def adjusted_confidence(
    confidence: Column, wps: Column, min_wps: float = MIN_WORDS_PER_SECOND
) -> Column:
    """Confidence, scaled down where the pass has too few words for its length."""
    return F.when(wps < min_wps, confidence * (wps / min_wps)).otherwise(confidence)


def is_suspiciously_short(words: Column, duration_sec: Column) -> Column:
    expected = F.floor(duration_sec / SHORT_CHECK_SECONDS_PER_WORD)
    return (duration_sec > SHORT_CHECK_MIN_SECONDS) & (words < expected)


def normalize_ts(df: DataFrame, name: str) -> Column:
    """A timestamp column as double; of an array the first element counts."""
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.get(F.col(name), F.lit(0)).cast("double")
    return F.col(name).cast("double")
