"""What several of these operators share: table access, cut lineage, texts and their words."""

import ctypes
import gc
import sys
import threading
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.session import configure, cut  # noqa: F401

# Bytes of text that a Python task handles at once. Longer single texts are handled whole.
CHUNK_BYTES = 4 << 20
# ASCII white space, which parts words.
SPACES = bytes([9, 10, 11, 12, 13, 32])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def digest(*columns: Column) -> Column:
    """A 64-bit hash of the columns that also tells null from empty."""
    return F.xxhash64(*[part for c in columns for part in (c, c.isNull())])


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def in_chunks(texts: list[bytes], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many bytes each."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_chunks(column: pa.Array, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of about so many bytes together, and the place of their first; only they are taken
    from the column at a time."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    first = 0
    while first < len(column):
        held = ends[first - 1] if first else 0
        last = min(int(np.searchsorted(ends, held + size)) + 1, len(column))
        yield first, text_bytes(column.slice(first, last - first))
        first = last


class Words(NamedTuple):
    """The words of several texts. codes: places in `unique`, all texts after each other;
    bounds: where each text begins, and the end."""

    codes: np.ndarray
    unique: list[bytes]
    bounds: np.ndarray


def cut_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Runs of bytes that are not ASCII white space, all texts after each other, and their bounds as
    in `Words`."""
    data = np.frombuffer(b" ".join([b"", *texts]), np.uint8)
    is_space = np.zeros(256, bool)
    is_space[list(SPACES)] = True
    gap = is_space[data]
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64)
    first = np.flatnonzero(gap[:-1] & ~gap[1:])
    stops = np.flatnonzero(~gap[:-1] & gap[1:])
    if not gap[-1]:
        stops = np.append(stops, len(data) - 1)
    offsets = np.concatenate([[0], np.cumsum(stops - first)]).astype(np.int64)
    letters = data[~gap]
    words = pa.Array.from_buffers(
        pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    )
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.searchsorted(first, begins)


def split_words(texts: list[bytes]) -> Words:
    """The runs of bytes that are not ASCII white space, as codes."""
    cut, bounds = cut_words(texts)
    words = cut.dictionary_encode()
    return Words(words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist(), bounds)


def give_back() -> None:
    """Gives memory that allocators keep after it was freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tidied(run: Callable) -> Callable:
    """The function of a Python stage, after which its worker gives back to the system what memory it
    does not use. A worker lives on for other stages, and allocators keep what was once freed."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


@contextmanager
def kept_by_worker(name: str, make: Callable[[], object], idle: float = 10.0) -> Iterator[object]:
    """An object that a Python worker keeps from task to task, such as a loaded tokenizer, and lets
    go when it has not been used for `idle` seconds: other stages need the memory."""
    store = sys.modules.setdefault("voxtab_llm_kept", types.ModuleType("voxtab_llm_kept"))
    made, uses = getattr(store, name, None) or (make(), 0)
    setattr(store, name, (made, uses + 1))

    def let_go() -> None:
        if getattr(store, name, (None, 0))[1] == uses + 1:
            delattr(store, name)
            gc.collect()

    try:
        yield made
    finally:
        timer = threading.Timer(idle, let_go)
        timer.daemon = True
        timer.start()
