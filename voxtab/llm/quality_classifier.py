"""Quality: n-gram indicators scaled by class log-count ratios, under a linear hinge loss.

The ratios are those of naive Bayes; the weights come from dual coordinate descent.
"""

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from voxtab.llm.common import in_chunks, split_words, text_bytes, tidied
from voxtab.llm.labelled import binned_labels, known_labels, labelled_sample, trained_in_task
from voxtab.llm.ngram_join import among, marked

BUCKETS = 1 << 18
# Rows of a label that are learnt from at most, and characters of a text.
PER_CLASS = 3000
LONGEST = 20_000
# Bins of scores by which all labelled rows are counted.
BINS = 4096
EPOCHS = 12


class Model(NamedTuple):
    """weights: by bucket, ratios included. slope, shift: from margins to chances."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float


# Letters and digits of a word become signs of their kind; marks stay.
SHAPE = bytes(
    ord("x") if chr(b).islower() or b >= 128 else ord("X") if chr(b).isupper()
    else ord("9") if chr(b).isdigit() else b
    for b in range(256)
)


def shape_of(word: bytes, known: dict[bytes, int]) -> int:
    """A hash of a word's kinds of characters, runs cut to two."""
    signs = word.translate(SHAPE)
    if signs not in known:
        short = bytes(b for i, b in enumerate(signs) if i < 2 or b != signs[i - 1] or b != signs[i - 2])
        known[signs] = zlib.crc32(b"shape " + short[:16])
    return known[signs]


def mixed(values: np.ndarray) -> np.ndarray:
    values = values * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


def indicators(texts: list[bytes]) -> list[np.ndarray]:
    """The buckets that each text has: its words, pairs of words, shapes of words, pairs of
    shapes with whether the word repeats, and the order of magnitude of its length."""
    codes, unique, bounds = split_words(texts)
    known: dict[bytes, int] = {}
    word = np.array([zlib.crc32(w.lower()) for w in unique], np.uint64)[codes]
    shape = np.array([shape_of(w, known) for w in unique], np.uint64)[codes]
    kind = lambda n: np.uint64(n << 40)
    one = [mixed(word + kind(1)), mixed(shape + kind(2))]
    again = (codes[1:] == codes[:-1]).astype(np.uint64)
    two = [
        mixed(mixed(word[:-1] + kind(3)) + word[1:]),
        mixed(mixed(shape[:-1] + kind(4)) + shape[1:] * np.uint64(2) + again),
    ]
    mask = np.uint64(BUCKETS - 1)
    found = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        length = mixed(np.array([int(np.log2(b - a + 1) * 2)], np.uint64) + kind(5))
        own = [*(v[a:b] for v in one), *(v[a : max(a, b - 1)] for v in two), length]
        found.append(np.unique(np.concatenate(own) & mask).astype(np.int64))
    return found


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log ratios of how often the classes have each indicator, smoothed by one."""
    counts = np.ones((2, BUCKETS))
    for row, label in zip(rows, labels, strict=True):
        counts[label, row] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def descend(rows, labels, ratio, epochs: int, cost: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights of min |w|^2 / 2 + cost * sum of hinge losses, one dual variable at a time. Both
    classes cost the same in sum; the bias is one more feature of value 1. Rows have length 1."""
    rng = np.random.default_rng(seed)
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.bincount(labels, minlength=2) / len(labels)
    limit = cost / (2 * share[labels])
    values = [ratio[r] / max(np.sqrt((ratio[r] ** 2).sum()), 1e-9) for r in rows]
    alpha, weights, bias = np.zeros(len(rows)), np.zeros(BUCKETS), 0.0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            row, value = rows[i], values[i]
            slope = sign[i] * (weights[row] @ value + bias) - 1
            new = min(max(alpha[i] - slope / 2, 0.0), limit[i])
            change = (new - alpha[i]) * sign[i]
            if change:
                weights[row] += change * value
                bias += change
                alpha[i] = new
    return weights, bias


def margins(model: Model, rows: list[np.ndarray], ratio_norms: np.ndarray) -> np.ndarray:
    """Margins of texts; ratio_norms: the squared ratio of each bucket."""
    return np.array(
        [model.weights[r].sum() / max(np.sqrt(ratio_norms[r].sum()), 1e-9) + model.bias for r in rows]
    )


def calibrated(
    found: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None, rounds: int = 60
) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins, by Newton's method with a small
    penalty. counts: how often each row is there (default: once). Labels count by class, so that
    both weigh the same."""
    counts = np.ones(len(labels)) if counts is None else counts
    share = np.bincount(labels, counts, minlength=2) / max(counts.sum(), 1)
    if len(labels) == 0 or share.min() == 0:
        return 4.0, 0.0
    weight = 0.5 / share[labels] * counts * (len(labels) / counts.sum())
    x = np.stack([found, np.ones_like(found)], axis=1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        slope = x.T @ (weight * (p - labels)) + 1e-2 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        beta -= np.linalg.solve(curve, slope)
    return float(max(beta[0], 0.1)), float(beta[1])


class Fitted(NamedTuple):
    model: Model
    norms: np.ndarray


def too_few(labels: np.ndarray) -> bool:
    return len(labels) == 0 or min(np.bincount(labels, minlength=2)) < 10


def kept_from_fit(n: int) -> np.ndarray:
    return np.arange(n) % 5 == 4


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, cost: float = 4.0, seed: int = 7) -> Fitted:
    """Fits on four of five rows, calibrates on the fifth. Fewer than ten rows of a label: a
    model that scores the share of label 1 everywhere."""
    n = len(labels)
    if too_few(labels):
        share = (labels.sum() + 1) / (n + 2) if n else 0.5
        flat = np.zeros(BUCKETS, np.float32)
        return Fitted(Model(flat, 0.0, 1.0, float(np.log(share / (1 - share)))), flat)
    rows = [row for a, b in in_chunks(texts) for row in indicators(texts[a:b])]
    held = kept_from_fit(n)
    mine = [rows[i] for i in np.flatnonzero(~held)]
    ratio = ratios(mine, labels[~held])
    weights, bias = descend(mine, labels[~held], ratio, epochs, cost, seed)
    model = Model((weights * ratio).astype(np.float32), float(bias), 1.0, 0.0)
    norms = (ratio**2).astype(np.float32)
    slope, shift = calibrated(margins(model, [rows[i] for i in np.flatnonzero(held)], norms), labels[held])
    return Fitted(model._replace(slope=slope, shift=shift), norms)


def plain(fitted: Fitted) -> tuple:
    return tuple(fitted.model), fitted.norms


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = PER_CLASS) -> Fitted:
    """Trains on at most `per_class` labelled rows of each label, in one task; the curve that
    makes scores of margins comes from all labelled rows but those learnt from, whole texts."""
    sample = labelled_sample(docs, labels, "quality", allowed, per_class, LONGEST)
    made, ids, sampled = trained_in_task(sample, lambda texts, own, _: plain(train(texts, own)))
    fitted = Fitted(Model(*made[0]), made[1])
    if too_few(sampled):
        return fitted
    # At most 2 * per_class ids: small by construction.
    learnt = [(i,) for i, kept in zip(ids, kept_from_fit(len(ids)), strict=True) if not kept]
    learnt = docs.sparkSession.createDataFrame(learnt, sample.select("doc_id").schema)
    learnt = F.broadcast(learnt)
    known = known_labels(labels, "quality", allowed).join(learnt, "doc_id", "left_anti")
    wanted = marked(known.select(F.xxhash64("doc_id").alias("id")))
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.xxhash64("doc_id").alias("__key"), "doc_id", "text")
    bare = fitted._replace(model=fitted.model._replace(slope=1.0, shift=0.0))
    # A row for each label and bin, however many documents there are.
    counts = binned_labels(score(among(rows, wanted, True), bare), known, BINS).toArrow()
    if counts.num_rows == 0 or len(set(counts["label"].to_pylist())) < 2:
        return fitted
    middle = (counts["bin"].to_numpy() + 0.5) / BINS
    slope, shift = calibrated(
        np.log(middle / (1 - middle)), counts["label"].to_numpy().astype(np.int64), counts["n"].to_numpy().astype(float)
    )
    return fitted._replace(model=fitted.model._replace(slope=slope, shift=shift))


def predict(fitted: Fitted, texts: list[bytes]) -> np.ndarray:
    model = fitted.model
    parts = [
        margins(model, indicators(texts[a:b]), fitted.norms) for a, b in in_chunks(texts)
    ]
    return sigmoid(model.slope * np.concatenate([np.zeros(0), *parts]) + model.shift)


def score(docs: DataFrame, fitted: Fitted, text: str = "text") -> DataFrame:
    """The documents with `score`: 0 to 1, higher for good ones. Whole texts count; a null or
    empty one has only the indicator of its length. Repeated rows score alike; a column of the
    input named score gives way. Every row is scored where it is read."""
    kept = docs.drop("score")
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])
    place = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = predict(fitted, text_bytes(batch.column(place)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"]
            )

    return kept.mapInArrow(tidied(run), schema)
