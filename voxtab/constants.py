"""Every number and name that results depend on."""

# Queue estimate. seconds = ceil(duration / 15.1) * 5 + 45
SPEED_FACTOR = 15.1
SECONDS_PER_BLOCK = 5
FIXED_OVERHEAD_SEC = 45

# Job status names
PENDING = "pending"
PROCESSING = "processing"
COMPLETED = "completed"
PROCESSED = "processed"
ERROR = "error"
QUARANTINED = "quarantined"
IN_FLIGHT_STATUSES = (PENDING, PROCESSING)
DONE_STATUSES = (COMPLETED, PROCESSED)
FAILED_STATUSES = (ERROR, QUARANTINED)
EXPIRABLE_STATUSES = (COMPLETED, ERROR, QUARANTINED)

# Retry cap and retention
GARBAGE_CAP = 3
RETENTION_SECONDS = 86400

# Garbage classifier
GARBAGE_PREVIEW_CHARS = 1000
GARBAGE_MIN_ALNUM = 50
GARBAGE_MIN_RATIO = 0.2

# Candidate scoring
MIN_WORDS_PER_SECOND = 1.4
SHORT_CHECK_MIN_SECONDS = 5.0
SHORT_CHECK_SECONDS_PER_WORD = 4

# audio
TARGET_DBFS = -20.0
NOISE_THRESHOLD = 0.015
PCM16_FULL_SCALE = 32768

# The five recogniser passes
#   pass_index, temperature, patience, beam_size, condition_on_previous_text
PASSES = (
    (0, 0.2, 3.0, 5, True),
    (1, 0.0, 2.8, 7, True),
    (2, 0.0, 2.5, 1, True),
    (3, 0.3, 3.2, 10, True),
    (4, 0.2, 3.5, 15, False),
)

# Public messages
MSG_PROCESSING = "Transcription is currently in progress"
MSG_FAILED = "Transcription failed"
MSG_UNKNOWN_STATUS = "Unknown status"
ADMITTED = "admitted"
REJECT_NO_FILE = "No file part"
REJECT_NO_NAME = "No selected file"
REJECT_NO_GUID = "GUID is required"
REJECT_BAD_GUID = "Invalid GUID format. Must be a valid UUID v4"
REJECT_KNOWN_GUID = "GUID already exists"

# Artifact names, as (kind, suffix after the guid); the suffix of
# the original is the extension of the uploaded file name
ARTIFACT_ORIGINAL = "original"
ARTIFACT_PROCESSED = "processed"
ARTIFACT_SUFFIXES = (
    (ARTIFACT_PROCESSED, "_processed.mp3"),
    ("transcript", ".txt"),
    ("aligned", "_aligned"),
    ("corpus", "_corpus"),
    ("aligner_input", "_mfa_input"),
)
