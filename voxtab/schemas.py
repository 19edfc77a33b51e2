"""Table schemas."""

from pyspark.sql import types as T

TIMING = T.StructType(
    [
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)
TIMINGS = T.ArrayType(TIMING)

JOBS = T.StructType(
    [
        T.StructField("guid", T.StringType(), False),
        T.StructField("filename", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("transcription", T.StringType()),
        T.StructField("timings", TIMINGS),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("processing_time_est", T.LongType()),
        T.StructField("attempt_count", T.IntegerType()),
    ]
)

# Values that a job row takes where a file or a submission leaves them out;
# columns not named here default to null.
JOB_DEFAULTS = {"status": "pending", "processing_time_est": 0, "attempt_count": 0}

SEGMENTS = T.StructType(
    [
        T.StructField("guid", T.StringType()),
        T.StructField("pass_index", T.IntegerType()),
        T.StructField("seg_index", T.IntegerType()),
        T.StructField("seg_start", T.DoubleType()),
        T.StructField("seg_end", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)

RECOGNISED_WORD = T.StructType(
    [
        T.StructField("word_index", T.LongType()),
        T.StructField("word_start", T.DoubleType()),
        T.StructField("word_end", T.DoubleType()),
        T.StructField("probability", T.DoubleType()),
    ]
)

# What a user's recogniser returns for one segment of one pass.
RECOGNISED = T.StructType(
    SEGMENTS.fields + [T.StructField("words", T.ArrayType(RECOGNISED_WORD))]
)

# The same as rows of a stage: `error` is set on the one row of a request that failed.
ATTEMPTS = T.StructType(RECOGNISED.fields + [T.StructField("error", T.StringType())])

JOB_EVENTS = T.StructType(
    [
        T.StructField("guid", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("outcome", T.StringType()),
        # The job's estimate, on any of its events, for the queue monitor.
        T.StructField("processing_time_est", T.LongType()),
    ]
)

FRAMES = T.StructType(
    [
        T.StructField("guid", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("sample_rate", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("samples", T.ArrayType(T.FloatType())),
        # Set on the single row of a file that could not be read, null elsewhere.
        T.StructField("error", T.StringType()),
    ]
)
