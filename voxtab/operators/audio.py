"""Loudness, gain, noise and duration of PCM frames; which audio file to use."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtab import constants as C
from voxtab.functions.text import file_ext
from voxtab.session import cut


def _frame_sum(term) -> Column:
    return F.aggregate("samples", F.lit(0.0), lambda total, x: total + term(x.cast("double")))


def frame_stats(frames: DataFrame) -> DataFrame:
    """A few numbers per frame, so that shuffles need not carry samples."""
    channels = F.col("channels") if "channels" in frames.columns else F.lit(1)
    peak = F.greatest(F.array_max("samples"), -F.array_min("samples")).cast("double")
    return frames.where(F.col("samples").isNotNull()).select(
        "guid",
        "seq",
        "sample_rate",
        channels.alias("channels"),
        F.size("samples").cast("bigint").alias("n"),
        _frame_sum(lambda x: x * x).alias("sum_sq"),
        _frame_sum(F.abs).alias("sum_abs"),
        peak.alias("peak"),
    )


def loudness(
    frames: DataFrame,
    full_scale: float = C.PCM16_FULL_SCALE,
    target_dbfs: float = C.TARGET_DBFS,
) -> DataFrame:
    """Per guid: loudness in dBFS, the gain to the target and the factor it means,
    duration in seconds, sum and peak of the absolute samples. Silence has no dBFS and
    takes no gain."""
    rms = F.sqrt(F.col("sum_sq") / F.col("n_samples"))
    dbfs = F.when(rms > 0, 20 * F.log10(rms / full_scale))
    gain = F.coalesce(F.lit(target_dbfs) - F.col("dbfs"), F.lit(0.0))
    return (
        frame_stats(frames)
        .groupBy("guid")
        .agg(
            F.sum("n").alias("n_samples"),
            F.sum("sum_sq").alias("sum_sq"),
            F.sum("sum_abs").alias("sum_abs"),
            F.max("peak").alias("peak"),
            F.max("sample_rate").alias("sample_rate"),
            F.max("channels").alias("channels"),
        )
        .where(F.col("n_samples") > 0)
        .withColumn("dbfs", dbfs)
        .withColumn("gain_db", gain)
        .withColumn("factor", F.pow(F.lit(10.0), F.col("gain_db") / 20))
        .withColumn("duration_sec", duration_sec())
        .drop("sum_sq", "sample_rate", "channels")
    )


def duration_sec() -> Column:
    """Length of audio to the millisecond, from sample counts of all channels."""
    seconds = F.col("n_samples") / F.col("channels") / F.col("sample_rate")
    return F.bround(seconds * 1000) / 1000


def _scaled(full_scale: float):
    low, high = F.lit(-float(full_scale)), F.lit(float(full_scale))
    return lambda x: F.least(F.greatest(x.cast("double") * F.col("factor"), low), high)


def normalize_gain(frames: DataFrame, loud: DataFrame, full_scale=C.PCM16_FULL_SCALE):
    """Frames with samples scaled by the factor of their guid in `loud` and clipped to
    full scale."""
    samples = F.transform("samples", _scaled(full_scale)).cast("array<float>")
    return frames.join(loud.select("guid", "factor"), "guid").withColumn("samples", samples).drop("factor")


def noise_energy(
    frames: DataFrame,
    full_scale: float = C.PCM16_FULL_SCALE,
    target_dbfs: float = C.TARGET_DBFS,
) -> DataFrame:
    """`loudness` plus `noise_energy`: the mean absolute sample over full scale, as it
    is after the gain.

    The gain only scales a recording's sum of absolute samples, unless its peak clips.
    Recordings that clip are read a second time, sample by sample. The loudness table, one
    short row a recording, is kept behind a checkpoint for that.
    """
    loud = cut(loudness(frames, full_scale, target_dbfs))
    clipping = loud.where(F.col("peak") * F.col("factor") > full_scale)
    scaled = _scaled(full_scale)
    total = F.aggregate("samples", F.lit(0.0), lambda t, x: t + F.abs(scaled(x)))
    clipped = (
        frames.join(clipping.select("guid", "factor"), "guid")
        .select("guid", total.alias("level"))
        .groupBy("guid")
        .agg(F.sum("level").alias("clipped_level"))
    )
    level = F.coalesce("clipped_level", F.col("sum_abs") * F.col("factor"))
    energy = level / F.col("n_samples") / full_scale
    joined = loud.join(clipped, "guid", "left").withColumn("noise_energy", energy)
    return joined.drop("clipped_level")


def unreadable(frames: DataFrame) -> DataFrame:
    """Recordings that could not be read, as (guid, error): they have no loudness."""
    return frames.where(F.col("error").isNotNull()).select("guid", "error")


def needs_denoise(stats: DataFrame, threshold: float = C.NOISE_THRESHOLD) -> DataFrame:
    return stats.withColumn("needs_denoise", F.col("noise_energy") > threshold)


def resolve_audio(jobs: DataFrame, listing: DataFrame) -> DataFrame:
    """Jobs with `audio_found`, and `audio_path`: the processed file if there is one,
    else the original. Without the original a job has no audio at all.

    `listing` holds (guid, kind); if it holds paths too, the original counts only under
    the extension of the job's file name.
    """
    kind = F.col("kind")
    original = kind == C.ARTIFACT_ORIGINAL
    path = F.col("path") if "path" in listing.columns else F.lit(None).cast("string")
    have = listing.groupBy("guid").agg(
        F.max(original & path.isNull()).alias("has_original"),
        F.max(kind == C.ARTIFACT_PROCESSED).alias("has_processed"),
    )
    named = listing.where(original & path.isNotNull()).select(
        "guid", file_ext(path).alias("own_ext"), F.lit(True).alias("has_own")
    )
    own_ext = file_ext(F.col("filename"))
    jobs = jobs.withColumn("own_ext", own_ext).join(named.distinct(), ["guid", "own_ext"], "left")
    found = F.col("filename").isNotNull() & (
        F.coalesce("has_original", F.lit(False)) | F.coalesce("has_own", F.lit(False))
    )
    suffix = dict(C.ARTIFACT_SUFFIXES)[C.ARTIFACT_PROCESSED]
    path = F.when(F.col("has_processed"), F.concat("guid", F.lit(suffix))).otherwise(
        F.concat("guid", own_ext)
    )
    joined = jobs.join(have, "guid", "left").withColumn("audio_found", found)
    return joined.withColumn("audio_path", F.when(F.col("audio_found"), path)).drop(
        "has_original", "has_processed", "own_ext", "has_own"
    )


def missing_audio(resolved: DataFrame) -> DataFrame:
    return resolved.where(~F.col("audio_found"))
