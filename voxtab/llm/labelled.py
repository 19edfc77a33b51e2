"""Bounded samples of labelled documents, for fitting classifiers."""

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtab.llm.common import text_bytes, tidied

# Bytes of a trained model that a row takes to the driver: a JVM holds several copies of each row
# meanwhile, and those of large ones in regions of its heap that hold nothing else.
SLICE_BYTES = 1 << 18


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def known_labels(labels: DataFrame, label: str, allowed: Column) -> DataFrame:
    """doc_id, label: one row for each labelled document. allowed: a condition on labels.doc_id."""
    return labels.where(allowed & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col(label)).cast("int").alias("label")
    ).where(F.col("label").isin(0, 1))


def slice_of(text: Column, key: Column, longest: int) -> Column:
    """The text, or `longest` characters of a longer one from a place that its key decides."""
    over = F.greatest(F.length(text) - longest, F.lit(0))
    start = F.pmod(F.xxhash64(key), over + 1).cast("int")
    return F.when(over > 0, F.substr(text, start + 1, F.lit(longest))).otherwise(text)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int, longest: int
) -> DataFrame:
    """At most `per_class` documents of each label 0 and 1 for training: doc_id, label, lang,
    text.

    allowed: a condition on labels.doc_id. Rows are taken in the order of a hash of the id;
    of rows that repeat an id that with the smallest hash of its text counts. Of texts beyond
    `longest` characters a slice is learnt from, so that what the driver gathers is bounded by
    2 * per_class * longest; null texts are empty.
    """
    known = known_labels(labels, label, allowed)
    ids = None
    for value in (0, 1):
        some = known.where(F.col("label") == value)
        some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = some if ids is None else ids.unionByName(some)
    lang = F.col("lang") if "lang" in docs.columns else F.lit("")
    texts = docs.select(
        F.col("doc_id"), F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    # At most 2 * per_class rows of two numbers: small by construction.
    found = texts.join(F.broadcast(ids), "doc_id").withColumn("text", slice_of(F.col("text"), F.col("doc_id"), longest))
    one = F.min(F.struct(F.xxhash64("text", "lang").alias("order"), "label", "lang", "text")).alias("row")
    found = found.groupBy("doc_id").agg(one).select("doc_id", "row.label", "row.lang", "row.text")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id")


def trained_in_task(sample: DataFrame, train: Callable[[list[bytes], np.ndarray, list[str]], tuple]) -> tuple:
    """train(texts, labels, langs) on a sample of `labelled_sample`, in one task, so that neither texts
    nor what training needs of memory and time are the driver's: (result, ids, labels). The rows
    come in the order of the sample; the result is a tuple of plain values and arrays."""
    ids_type = sample.schema["doc_id"].dataType.simpleString()
    named = sample.select(F.xxhash64("doc_id").alias("place"), "doc_id", "label", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        rows = pa.Table.from_batches(batches).sort_by([("place", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        labels = rows["label"].to_numpy().astype(np.int64)
        made = train(text_bytes(rows["text"].combine_chunks()), labels, rows["lang"].to_pylist())
        data = pickle.dumps(tuple(made))
        slices = [data[a : a + SLICE_BYTES] for a in range(0, len(data), SLICE_BYTES)]
        others = [None] * (len(slices) - 1)
        own_ids = pa.array([rows["doc_id"].to_pylist(), *others], pa.list_(rows.schema.field("doc_id").type))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(slices)), pa.int32()), pa.array(slices), own_ids, pa.array([labels.tolist(), *others])],
            names=["part", "made", "ids", "labels"],
        )

    columns = f"part int, made binary, ids array<{ids_type}>, labels array<bigint>"
    found = sorted(named.repartition(1).mapInArrow(tidied(run), columns).collect(), key=lambda row: row.part)
    if not found:
        return tuple(train([], np.zeros(0, np.int64), [])), [], np.zeros(0, np.int64)
    return pickle.loads(b"".join(row.made for row in found)), found[0].ids, np.array(found[0].labels, np.int64)


def shared_by(model, docs: DataFrame):
    """The model, which is sent to the executors once for all tables that it scores."""
    return model._replace(shared=docs.sparkSession.sparkContext.broadcast(model))


def binned_labels(scored: DataFrame, known: DataFrame, bins: int) -> DataFrame:
    """label, bin, n: how many labelled documents have each score. scored: doc_id, score; known:
    doc_id, label. Rows that repeat id and score count once."""
    step = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    found = scored.select("doc_id", "score").join(known, "doc_id").distinct()
    return found.groupBy("label", step.alias("bin")).agg(F.count("*").alias("n"))
