"""Quality rules: counts within a text, and how many documents of a host share its lines.

Lines are normalised and hashed; a line that stands in many documents of its host is page
furniture and goes from all texts but the first that has it. Texts that are left with little
are rejected.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from voxtab.llm.common import cut, in_chunks, split_words, text_bytes, tidied


class Limits(NamedTuple):
    """A line is furniture in a host if at least `documents` of its texts hold it and these are
    more than `per_host` of 100 of them or, in a large host, more than `many`. A text is depleted if more than `removed` of 100 of
    its words go. A text fails with fewer than `words` words, or more than `repeated` of 100 in
    windows of three that it repeats."""

    documents: int = 3
    per_host: float = 1.0
    many: int = 1000
    removed: int = 50
    words: int = 50
    repeated: int = 50


# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
ZEROS = bytes(ord("0") if chr(b).isdigit() and b < 128 else b for b in range(256))

STATS = (
    "doc_id long, host string, key long, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, lines array<struct<line: long, words: int>>"
)


def repeated_words(codes: np.ndarray) -> int:
    """Words in windows of three that come twice or more. codes: numbers below 2^63 / n^2."""
    if len(codes) < 4:
        return 0
    _, small = np.unique(codes, return_inverse=True)
    n = int(small.max()) + 1
    if n >= 1 << 21:  # three codes would not fit a long: number the pairs first
        _, pairs = np.unique(small[:-1] * n + small[1:], return_inverse=True)
        windows = pairs[:-1] * n + small[2:]
    else:
        windows = (small[:-2] * n + small[1:-1]) * n + small[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    covered = np.zeros(len(codes), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def line_hash(line: bytes) -> int:
    """Of a line in lower case (A-Z), digits as 0, runs of white space as one."""
    return signed(xxhash.xxh3_64_intdigest(b" ".join(line.lower().translate(ZEROS).split())))


def line_counts(text: bytes) -> tuple[int, dict[int, int]]:
    """Lines with a word that equal an earlier one; words by the hash of their line."""
    seen, repeats, words = set(), 0, {}
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            repeats += line in seen
            seen.add(line)
            h = line_hash(line)
            words[h] = words.get(h, 0) + n
    return repeats, words


def stats_of(texts: list[bytes]) -> Iterator[tuple]:
    codes, unique, bounds = split_words(texts)
    chars = np.array([len(w.decode(errors="replace")) for w in unique], np.int64)[codes]
    totals = np.concatenate([[0], np.cumsum(chars)])
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        repeats, words = line_counts(text)
        symbols = sum(text.count(bytes([s])) for s in SYMBOLS)
        yield (
            int(b - a), int(totals[b] - totals[a]), symbols, repeats, repeated_words(codes[a:b]),
            [{"line": h, "words": n} for h, n in words.items()],
        )


def text_stats(docs: DataFrame, host: str) -> DataFrame:
    """A row a document: its counts, and the hashes of its lines. key: a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for a, b in in_chunks(texts):
                rows = list(stats_of(texts[a:b]))
                columns = list(zip(*rows, strict=True))
                keys = [signed(xxhash.xxh3_64_intdigest(t)) for t in texts[a:b]]
                kinds = [pa.int64()] * 5 + [
                    pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))
                ]
                arrays = [
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                    pa.array(keys, pa.int64()),
                    *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)),
                ]
                names = [
                    "doc_id", "host", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "lines",
                ]
                schema = schema or pa.schema(list(zip(names, [x.type for x in arrays], strict=True)))
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    named = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.col("text").cast("string"),
    )
    return named.mapInArrow(tidied(run), STATS)


def furniture(stats: DataFrame, limits: Limits) -> DataFrame:
    """Lines above the limits: host, line, first (the key of the text with the smallest doc_id
    that holds it). Copies of one text count once. Counting is in two steps, so that a line
    which half of all texts hold is summed up before it meets in one task."""
    lines = stats.select("host", "doc_id", "key", F.inline("lines"))
    counts = lines.groupBy("host", "line").agg(
        F.count_distinct("key").alias("texts"), F.min_by("key", "doc_id").alias("first")
    )
    hosts = stats.groupBy("host").agg(F.count_distinct("key").alias("host_texts"))
    shared = counts.where(F.col("texts") >= limits.documents).join(hosts, "host")
    often = (100 * F.col("texts") > limits.per_host * F.col("host_texts")) | (F.col("texts") > limits.many)
    return shared.where(often).select(
        "host", "line", "first"
    )


def removed_lines(stats: DataFrame, limits: Limits) -> DataFrame:
    """By host and text: the furniture that goes, and how many words it has."""
    lines = stats.select("host", "key", F.inline("lines"))
    gone = lines.join(furniture(stats, limits), ["host", "line"]).where(
        ~F.col("key").eqNullSafe(F.col("first"))
    )
    each = gone.groupBy("host", "key", "line").agg(F.max("words").alias("words"))
    return each.groupBy("host", "key").agg(
        F.sum("words").alias("n_removed_words"), F.collect_list("line").alias("removed_lines")
    )


def judge(docs: DataFrame, limits: Limits | None = None, host: str = "source") -> DataFrame:
    """A row a document: doc_id, host, key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_removed_words, removed_lines, base_failed, kept.

    Columns needed: doc_id, text and the host's. Null texts have no words and fail; a null host
    is a host of its own, and so is the empty one with it. Rows with the same host and text get
    the same verdict. Texts are read once; what is known of them goes behind a checkpoint, which
    holds the hashes of their lines.
    """
    limits = limits or Limits()
    stats = cut(text_stats(docs, host))
    joined = stats.drop("lines").join(removed_lines(stats, limits), ["host", "key"], "left")
    removed = F.coalesce("n_removed_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < limits.words) | (
        100 * F.col("n_repeat_words") > limits.repeated * F.col("n_words")
    )
    depleted = 100 * F.col("n_removed_words") > limits.removed * F.col("n_words")
    return joined.withColumns(
        {"n_removed_words": removed, "base_failed": failed}
    ).withColumn("kept", ~failed & ~depleted)


def clean(docs: DataFrame, judged: DataFrame, host: str = "source") -> DataFrame:
    """The documents that `judge` keeps, without their furniture; other columns stay."""
    found = judged.where("kept").select(
        F.col("host").alias("__host"), F.col("key").alias("__key"), "removed_lines"
    ).dropDuplicates(["__host", "__key"])
    schema, names = docs.schema, docs.columns
    place = names.index("text")

    def hashed(batches):
        for batch in batches:
            keys = [signed(xxhash.xxh3_64_intdigest(t)) for t in text_bytes(batch.column(place))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "__own"]
            )

    def strip(batches):
        for batch in batches:
            texts = []
            for text, gone in zip(
                batch.column(place).to_pylist(), batch.column(len(names)).to_pylist(), strict=True
            ):
                drop = set(gone or ())
                if drop and text:
                    text = "\n".join(x for x in text.split("\n") if line_hash(x.encode()) not in drop)
                texts.append(text)
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    keyed = docs.mapInArrow(tidied(hashed), StructType([*schema.fields, StructField("__own", LongType())]))
    same = (F.col("__own") == F.col("__key")) & (
        F.coalesce(F.col(host).cast("string"), F.lit("")) == F.col("__host")
    )
    joined = keyed.alias("asked").join(found.alias("found"), same)
    joined = joined.select(*[F.col(f"asked.`{c}`") for c in docs.columns], F.col("found.removed_lines").alias("__gone"))
    return joined.mapInArrow(tidied(strip), schema)
