"""Text expressions: whitespace, words, garbage, repeats, file names, durations."""

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtab.constants import (
    GARBAGE_MIN_ALNUM,
    GARBAGE_MIN_RATIO,
    GARBAGE_PREVIEW_CHARS,
)
from voxtab.functions.repeats import drop_second_copies, squash_words

# Character classes, written out so that Java, RE2 and Python agree.
# Whitespace is what Python's str.isspace accepts, alphanumeric what str.isalnum does.
WS = r"\t-\r\x1c-\x20\x85\p{Z}"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ALNUM = r"\p{L}\p{N}"
WORD = r"\p{L}\p{N}_"

# The last dot of the last path part, leading dots not counted.
EXTENSION = r"(?s)(?:^|/)\.*[^./][^/]*?(\.[^./]*)\z"


def strip_text(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[^{WS}]+"))


def is_garbage(
    text: Column,
    threshold: float = GARBAGE_MIN_RATIO,
    min_alnum: int = GARBAGE_MIN_ALNUM,
    preview: int = GARBAGE_PREVIEW_CHARS,
) -> Column:
    """Too few letters and digits in the opening of the text. The rule itself looks
    at the first 1000 characters only; null stays null."""
    head = F.substring(text, 1, preview)
    alnum = F.length(F.regexp_replace(head, rf"[^{ALNUM}]", ""))
    share = F.coalesce(F.try_divide(alnum, F.length(head)), F.lit(0.0))
    return F.when(alnum < min_alnum, True).when(text.isNotNull(), share < threshold)


def is_valid_guid(guid: Column) -> Column:
    """Thirty-two hex digits once URN prefixes, outer braces and hyphens are gone."""
    bare = F.replace(F.replace(guid, F.lit("urn:")), F.lit("uuid:"))
    bare = F.replace(F.btrim(bare, F.lit("{}")), F.lit("-"))
    return F.coalesce(bare.rlike(r"\A[0-9A-Fa-f]{32}\z"), F.lit(False))


def file_ext(name: Column) -> Column:
    return F.regexp_extract(name, EXTENSION, 1)


def duration_text(seconds: Column) -> Column:
    """Whole seconds as `[N day[s], ]H:MM:SS`; negative spans borrow from the days."""
    seconds = seconds.cast("bigint")
    rest = F.pmod(seconds, F.lit(86400))
    days = F.floor(seconds / 86400)
    clock = F.format_string(
        "%d:%02d:%02d",
        F.floor(rest / 3600),
        F.floor(F.pmod(rest, F.lit(3600)) / 60),
        F.pmod(rest, F.lit(60)),
    )
    unit = F.when(F.abs(days) == 1, " day, ").otherwise(" days, ")
    return F.when(days == 0, clock).otherwise(
        F.concat(days.cast("string"), unit, clock)
    )


@F.arrow_udf(T.StringType())
def _squash_words(texts: pa.Array) -> pa.Array:
    return squash_words(texts)


@F.arrow_udf(T.StringType())
def _drop_second_copies(texts: pa.Array) -> pa.Array:
    return drop_second_copies(texts)


def squash_repeats(text: Column) -> Column:
    """Words said four or more times in a row are said once."""
    return _squash_words(text)


def remove_boundary_duplicates(text: Column) -> Column:
    """A phrase of two to five words repeated at once loses its second copy, again and
    again from the left until nothing changes."""
    return _drop_second_copies(text)
