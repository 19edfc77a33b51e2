"""Suffix-array deduplication: suffixes sorted by their first bytes only, most significant digit
first, up to the length that counts as a repeat; equal groups are exactly the repeated windows.

Digits are runs of bytes, compared by 64-bit hashes, and a suffix leaves as soon as its group
holds nothing else:

1. Of each window, its anchor: the run of DIGIT bytes with the smallest hash in it, chosen by
   content, so that equal windows have equal anchors at the same place. Windows that share an
   anchor go together; only anchors are shuffled, about one for every 18 bytes.
2. The anchor's neighbourhood, as far as windows around it reach. Equal neighbourhoods are
   equal windows throughout; of each, only the first document goes on.
3. The windows themselves, where an anchor has several neighbourhoods that agree on half of their
   left or of their right side, as those that share a window do.

Anchors that are very frequent, as in a line that many texts share, skip the second digit, so
that no anchor gathers many rows: their windows are rows of their own.
"""

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from voxtab.llm.common import in_chunks, text_bytes, tidied
from voxtab.llm.ngram_join import TABLE, fixed_table

WINDOW = 50
DIGIT = 16
REACH = WINDOW - DIGIT
PLACES = REACH + 1
AROUND = DIGIT + 2 * REACH
SIDE = REACH // 2
# Bytes handled at once, so that working arrays stay in the processor's caches.
STRIP = 1 << 18
# Bytes of text whose anchors are looked for at once, and documents of one such chunk that an anchor
# is in when it is frequent.
CHUNK = 4 << 20
FREQUENT = 8

# Bits of the first and second digits' hashes that are kept. Rows are shuffled in packs by ranges
# of the first digit; there are so many ranges for each partition of a shuffle.
DIGIT_BITS, AROUND_BITS = 40, 48
DIGIT_SHIFT, AROUND_SHIFT = np.uint64(64 - DIGIT_BITS), np.uint64(64 - AROUND_BITS)
PACKS = 2
# Suffixes and neighbourhoods of a task that are put into packs together: packs of few rows
# compress badly, and the more partitions the fewer rows a pack has. Marks in a pack of marks.
HELD, HELD_NEAR, HELD_MARKS = 1 << 20, 1 << 17, 1 << 15

K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * K2
    return x ^ (x >> np.uint64(29))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number. A view: copied they take eight times as much."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def run_hash(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of runs of `length` bytes from `starts` on."""
    found = np.full(len(starts), length, np.uint64)
    for offset in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        found = stir((found + words[starts + offset]) * K1)
    return found


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` values."""
    n = 1
    while 2 * n <= width:
        values, n = pick(values[:-n], values[n:]), 2 * n
    rest = width - n
    return pick(values[:-rest], values[rest:]) if rest else values


class Anchors:
    """The anchors of several texts laid out in one array, with gaps of zeros between them.

    data: the bytes; begin, end: of each text; places, owner: of each anchor; digit, around: the
    hashes of its first and second digit; left, right: bytes of its text within reach."""

    def __init__(self, texts: list[bytes]):
        gap = b"\0" * (REACH + 8)
        self.data = np.frombuffer(gap + gap.join([*texts, b""]) + gap, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = len(gap) + np.concatenate([[0], np.cumsum(sizes + len(gap))[:-1]]).astype(np.int64)
        self.begin = self.begin[: len(texts)]
        self.end = self.begin + sizes
        self.words = words_at(self.data)
        n = len(self.data) - DIGIT + 1
        parts = []
        whole = np.zeros(len(self.data) + 1, np.int32)
        long = sizes >= WINDOW
        np.add.at(whole, self.begin[long], 1)
        np.add.at(whole, (self.end - WINDOW + 1)[long], -1)
        valid = np.cumsum(whole[:-1], dtype=np.int32) > 0
        del whole
        for a in range(0, max(n - REACH, 1), STRIP):
            parts.append(self._strip(max(a - REACH, 0), min(a + STRIP + REACH, n), a, min(a + STRIP, n), valid))
        self.places = np.concatenate([np.zeros(0, np.int64), *parts])
        self.owner = np.searchsorted(self.begin, self.places, side="right") - 1
        self.digit = run_hash(self.words, self.places, DIGIT)

    @cached_property
    def left(self) -> np.ndarray:
        return np.minimum(self.places - self.begin[self.owner], REACH)

    @cached_property
    def right(self) -> np.ndarray:
        return np.minimum(self.end[self.owner] - DIGIT - self.places, REACH)

    @cached_property
    def around(self) -> np.ndarray:
        around = run_hash(self.words, self.places - REACH, AROUND)
        edges = (self.left * (REACH + 1) + self.right).astype(np.uint64)
        return stir((around + edges) * K1) >> AROUND_SHIFT

    def sides(self, which: np.ndarray) -> np.ndarray:
        """Of some anchors: a byte each for what stands from SIDE bytes before the anchor to its end
        (the low one), and from its start to SIDE bytes behind it; 0 where the text ends before.

        A window holds SIDE bytes before its anchor or SIDE behind it, so neighbourhoods that
        share one have one of these bytes in common."""
        found = np.zeros(len(which), np.uint16)
        for shift, reach, back in ((0, self.left, SIDE), (8, self.right, 0)):
            far = reach[which] >= SIDE
            hashes = run_hash(self.words, self.places[which[far]] - back, DIGIT + SIDE)
            found[far] |= (hashes % np.uint64(255) + np.uint64(1)).astype(np.uint16) << np.uint16(shift)
        return found

    def _strip(self, low: int, high: int, a: int, b: int, valid: np.ndarray) -> np.ndarray:
        """Anchors from a to b. Of each window the places with the smallest hash count."""
        words = self.words
        if high <= low or not valid[low:high].any():
            return np.zeros(0, np.int64)
        hashes = np.full(high - low, DIGIT, np.uint64)
        for offset in range(0, DIGIT, 8):
            hashes = stir((hashes + words[low + offset : high + offset]) * K1)
        if len(hashes) < PLACES:
            return np.zeros(0, np.int64)
        least = slide(hashes, PLACES, np.minimum)
        least = np.where(valid[low : low + len(least)], least, np.uint64(0))
        edge = np.zeros(REACH, np.uint64)
        best = slide(np.concatenate([edge, least, edge]), PLACES, np.maximum)
        found = np.flatnonzero(best == hashes) + low
        return found[(found >= a) & (found < b)]

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some anchors: the starts of the windows that hold them, and for each the anchor."""
        starts = self.places[which, None] - np.arange(PLACES)
        own = self.owner[which, None]
        fits = (starts >= self.begin[own]) & (starts + WINDOW <= self.end[own])
        row, _ = np.nonzero(fits)
        return starts[fits], which[row]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Anchors]]:
    """Ids and anchors of the documents that have an id, by chunks."""
    for batch in batches:
        texts, ids = text_bytes(batch.column(1)), batch.column(0).to_pylist()
        for a, b in in_chunks(texts, CHUNK):
            some = [(i, t) for i, t in zip(ids[a:b], texts[a:b], strict=True) if i is not None and len(t) >= WINDOW]
            if some:
                yield np.array([i for i, _ in some], np.int64), Anchors([t for _, t in some])


def record(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def frequent_digits(docs: DataFrame) -> np.ndarray:
    """A table of fixed size that marks the first digits which are in FREQUENT documents of some
    chunk. Marks shared by chance only change which way an anchor takes."""
    schema = "bucket long, value int"

    def run(batches):
        for ids, found in chunks(batches):
            _, one = np.unique(stir((found.digit + found.owner.astype(np.uint64)) * K1), return_index=True)
            digits, counts = np.unique(found.digit[one], return_counts=True)
            buckets = np.unique(digits[counts >= FREQUENT] % np.uint64(TABLE)).astype(np.int64)
            yield record(schema, buckets, np.ones(len(buckets), np.int32))

    return fixed_table(docs.mapInArrow(tidied(run), schema))


def window_mark(window: np.ndarray) -> np.ndarray:
    """What stands for a window where it has its own row."""
    return stir(window * K1) >> AROUND_SHIFT


def range_key(digit: np.ndarray) -> np.ndarray:
    """The bits of a first digit by which suffixes are sorted. Anchors have small hashes, so these
    are stirred again, for ranges to have like numbers of rows."""
    return stir(digit * K1) >> DIGIT_SHIFT


def range_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key * np.uint64(buckets) >> np.uint64(DIGIT_BITS)).astype(np.int64)


def keyed(found: Anchors, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First digit's key, second digit, sides and text of the suffixes of a chunk. The windows of
    frequent anchors have one digit in place of two."""
    hot = frequent[(found.digit % np.uint64(TABLE)).astype(np.int64)] > 0
    cold = np.flatnonzero(~hot)
    starts, anchor = found.windows(np.flatnonzero(hot))
    starts, place = np.unique(starts, return_index=True)
    window = run_hash(found.words, starts, WINDOW)
    return (
        range_key(np.concatenate([found.digit[cold], window])),
        np.concatenate([found.around[cold], window_mark(window)]),
        np.concatenate([found.sides(cold), np.zeros(len(starts), np.uint16)]),
        np.concatenate([found.owner[cold], found.owner[anchor[place]]]).astype(np.int32),
    )


SUFFIX = "bucket int, pack binary"
# mark: twice the second digit, one more where it is open.
MARK = "doc_id long, mark long"


def bytes_of(values: np.ndarray, low: int, high: int) -> bytes:
    """The bytes from low to high of each number, those of one place together."""
    wide = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(wide[:, low:high].T).tobytes()


def from_bytes(*parts: np.ndarray) -> np.ndarray:
    """Numbers from their bytes, a row for each place, lowest first."""
    rows = np.concatenate(parts)
    wide = np.zeros((rows.shape[1], 8), np.uint8)
    wide[:, : len(rows)] = rows.T
    return wide.view("<i8").ravel()


def table_pack(n: int, plain: list[tuple], dense: list[tuple], owner: np.ndarray, ids: np.ndarray, level: int = 1) -> bytes:
    """A pack of n rows. plain, dense: (values, low, high) as for bytes_of, the former like random
    bytes and so not compressed; owner: the places of their documents in ids, which ascend."""
    docs, place = np.unique(owner, return_inverse=True)
    steps = np.diff(ids[docs], prepend=np.int64(0))
    raw = b"".join(bytes_of(*c) for c in [*plain, (place, 0, 1)])
    rest = b"".join(bytes_of(*c) for c in [*dense, (place, 1, 4), (steps, 0, 8)])
    head = np.array([n, len(docs)], "<i8").tobytes()
    return head + raw + zstandard.ZstdCompressor(level=level).compress(rest)


def table_of(pack: bytes, n: int, plain: list[int], dense: list[int]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of such a pack: the bytes of each column, a row for each place, and the documents' ids."""
    m = int(np.frombuffer(pack, "<i8", 1, 8)[0])
    size = n * (sum(plain) + 1)
    raw = np.frombuffer(pack, np.uint8, size, 16).reshape(-1, n)
    rest = np.frombuffer(zstandard.ZstdDecompressor().decompress(pack[16 + size :]), np.uint8)
    packed, steps = rest[: len(rest) - 8 * m].reshape(-1, n), rest[len(rest) - 8 * m :].reshape(8, m)
    *first, low = np.split(raw, np.cumsum(plain))
    *second, high = np.split(packed, np.cumsum(dense))
    return first, second, np.cumsum(from_bytes(steps))[from_bytes(low, high)]


def packed_rows(key: np.ndarray, around: np.ndarray, sides: np.ndarray, owner: np.ndarray, ids: np.ndarray) -> bytes:
    """Suffixes of one bucket, in order of their keys, of which only the steps are kept."""
    steps = np.diff(key, prepend=np.uint64(0))
    plain = [(steps, 0, 2), (around, 0, 6), (sides, 0, 2)]
    return table_pack(len(key), plain, [(steps, 2, 5)], owner, ids)


def unpacked_rows(pack: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, around, sides and doc_id of a pack."""
    n = int(np.frombuffer(pack, "<i8", 1)[0])
    (low, around, sides), (high,), doc = table_of(pack, n, [2, 6, 2], [3])
    return np.cumsum(from_bytes(low, high)), from_bytes(around), from_bytes(sides), doc


def packed_marks(around: np.ndarray, owner: np.ndarray, ids: np.ndarray) -> bytes:
    """A pack of marks alone, told by the number of its rows, which is below 0."""
    return table_pack(-len(around), [(around, 0, 6)], [], owner, ids)


def unpacked_marks(pack: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """doc_id and mark of such a pack; None for a pack of suffixes."""
    n = int(np.frombuffer(pack, "<i8", 1)[0])
    if n >= 0:
        return None
    (around,), _, doc = table_of(pack, -n, [6], [])
    return doc, 2 * from_bytes(around)


def held(parts: Iterator[tuple], most: int) -> Iterator[list[np.ndarray]]:
    """Columns of several chunks after each other, at least `most` rows each time but the last. The
    first of a part are the ids of its documents, the last the documents' places in them, which
    become places in all ids in ascending order."""
    some, rows = [], 0

    def together() -> list[np.ndarray]:
        ids = np.unique(np.concatenate([p[0] for p in some]))
        owner = np.concatenate([np.searchsorted(ids, p[0]).astype(np.int32)[p[-1]] for p in some])
        columns = [np.concatenate(c) for c in zip(*(p[1:-1] for p in some), strict=True)]
        return [ids, *columns, owner]

    for part in parts:
        some.append(part)
        rows += len(part[-1])
        if rows >= most:
            yield together()
            some, rows = [], 0
    if some:
        yield together()


def by_range(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Buckets in ascending order and the rows that each has."""
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(bucket[a]), a, b


def suffixes(docs: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """Of the chunks that a task holds together, first and second digit, the row of the smallest
    document, packed by ranges of the first digit; and, in a pack without suffixes, the marks of
    the other rows, whose document repeats a smaller one of them."""

    def run(batches):
        parts = ((ids, *keyed(found, frequent)) for ids, found in chunks(batches))
        for ids, key, around, sides, owner in held(parts, HELD):
            if len(owner) and (np.diff(owner) < 0).any():
                order = np.argsort(owner, kind="stable")
                key, around, sides, owner = key[order], around[order], sides[order], owner[order]
            # Neighbourhoods that tie in these bits may lie mixed: what then passes for new is
            # told apart after the shuffle.
            digits = key << np.uint64(64 - DIGIT_BITS) | around >> np.uint64(AROUND_BITS + DIGIT_BITS - 64)
            order = np.argsort(digits, kind="stable")
            key, around, sides, owner = key[order], around[order], sides[order], owner[order]
            del digits, order
            same = (key[1:] == key[:-1]) & (around[1:] == around[:-1])
            new = np.append(True, ~same) if len(key) else np.zeros(0, bool)
            later = owner > owner[new][np.cumsum(new) - 1] if len(key) else new
            later[1:] &= ~(same & (owner[1:] == owner[:-1]))
            again = np.flatnonzero(later)
            again = again[np.argsort(owner[again], kind="stable")]
            for a in range(0, len(again), HELD_MARKS):
                some = again[a : a + HELD_MARKS]
                # Any bucket will do, but each task and piece should take another.
                bucket = stir(ids[owner[some[:1]]].astype(np.uint64) * K1 + around[some[:1]]) % np.uint64(buckets)
                yield record(SUFFIX, bucket.astype(np.int32), [packed_marks(around[some], owner[some], ids)])
            key, around, sides, owner = key[new], around[new], sides[new], owner[new]
            for k, a, b in by_range(range_of(key, buckets)):
                pack = packed_rows(key[a:b], around[a:b], sides[a:b], owner[a:b], ids)
                yield record(SUFFIX, np.array([k], np.int32), [pack])

    return docs.mapInArrow(tidied(run), SUFFIX)


def alike(group: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Which neighbourhoods agree with another of their anchor's (group) on a side."""
    found = np.zeros(len(group), bool)
    for side in (sides & 255, sides >> 8):
        rows = np.flatnonzero(side)
        _, which, counts = np.unique(group[rows] << 8 | side[rows], return_inverse=True, return_counts=True)
        found[rows[counts[which] > 1]] = True
    return found


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packs in order of their buckets: the suffixes repeated from a smaller document, and the
    first of each neighbourhood that agrees with another of its anchor on a side (open)."""

    def marks(key, around, sides, doc):
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key | np.append(True, around[1:] != around[:-1])
        again = (doc > doc[new][np.cumsum(new) - 1]) & ~np.append(False, ~new[1:] & (doc[1:] == doc[:-1]))
        group = np.cumsum(new_key) - 1
        several = np.flatnonzero(new & (np.bincount(group[new]) > 1)[group])
        is_open = np.zeros(len(key), bool)
        is_open[several[alike(group[several], sides[several])]] = True
        which = np.flatnonzero(again | is_open)
        yield record(MARK, doc[which], 2 * around[which] + is_open[which])

    def whole(packs):
        key, around, sides, doc = (np.concatenate(c) for c in zip(*map(unpacked_rows, packs), strict=True))
        order = np.lexsort((doc, around, key))
        yield from marks(key[order], around[order], sides[order], doc[order])

    for packs in by_bucket(batches):
        rows = []
        for pack in packs:
            marked = unpacked_marks(pack)
            if marked is None:
                rows.append(pack)
            else:
                yield record(MARK, *marked)
        if rows:
            yield from whole(rows)


def packed(docs: DataFrame) -> DataFrame:
    """Texts as compressed bytes, for the shuffles."""
    names, place = docs.columns, docs.columns.index("text")
    fields = [StructField(f.name, BinaryType()) if f.name == "text" else f for f in docs.schema.fields]

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array([squeeze(t) for t in text_bytes(batch.column(place))], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(tidied(run), StructType(fields))


def unpacked(column: pa.Array) -> list[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(z) for z in column.to_pylist()]


FLAGS = "doc_id long, around long, places long"


def of_text(around: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Marks of one text told from those of others."""
    return stir((around + (owner.astype(np.uint64) << np.uint64(48))) * K1)


def neighbourhoods(texts: DataFrame, marks: DataFrame, buckets: int) -> DataFrame:
    """The bytes around the open anchors of each document, packed by ranges of the first digit."""

    def opened(batches):
        for batch in batches:
            expanded = unpacked(batch.column(1))
            for a, b in in_chunks(expanded, CHUNK):
                found = Anchors(expanded[a:b])
                wanted = batch.column(2).slice(a, b - a)
                owner = np.repeat(np.arange(b - a), wanted.value_lengths().to_numpy())
                own = (wanted.flatten().to_numpy() >> 1).astype(np.uint64)
                keep = np.isin(of_text(found.around, found.owner), of_text(own, owner))
                which = np.flatnonzero(keep)
                ids = batch.column(0).slice(a, b - a).to_numpy()
                # One row for each neighbourhood of a document is enough.
                _, one = np.unique(of_text(found.around[which], found.owner[which]), return_index=True)
                which = which[one]
                near = found.data[found.places[which, None] + np.arange(-REACH, DIGIT + REACH)]
                yield (
                    ids, range_of(range_key(found.digit[which]), buckets), found.around[which],
                    found.left[which].astype(np.uint8), found.right[which].astype(np.uint8), near,
                    found.owner[which].astype(np.int32),
                )

    def run(batches):
        for ids, bucket, around, left, right, near, owner in held(opened(batches), HELD_NEAR):
            order = np.argsort(bucket, kind="stable")
            for k, a, b in by_range(bucket[order]):
                rows = order[a:b]
                texts = near[rows].tobytes()
                pack = table_pack(
                    len(rows), [(around[rows], 0, 6)], [(left[rows], 0, 1), (right[rows], 0, 1)], owner[rows], ids
                )
                size = np.array([len(pack)], "<i8").tobytes()
                pack = size + pack + zstandard.ZstdCompressor(level=3).compress(texts)
                yield record(SUFFIX, np.array([k], np.int32), [pack])

    # Only texts with an open anchor go on.
    joined = texts.join(marks, F.col("doc_id") == F.col("__id"))
    joined = joined.select("doc_id", "text", F.expr("filter(__marks, m -> m & 1 = 1)").alias("__open"))
    return joined.where(F.size("__open") > 0).mapInArrow(tidied(run), SUFFIX)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The packs of each bucket, from rows in order of their buckets."""
    bucket, held = None, []
    for batch in batches:
        for k, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != bucket and held:
                yield held
                held = []
            bucket = k
            held.append(pack)
    if held:
        yield held


def compare_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packs of neighbourhoods in order of their buckets: the windows of each that a smaller
    document has too, as bits by the anchor's distance from the window's start."""

    def columns(pack: bytes):
        size, n = np.frombuffer(pack, "<i8", 2).tolist()
        (around,), (left, right), doc = table_of(pack[8 : 8 + size], n, [6], [1, 1])
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(pack[8 + size :]), np.uint8)
        return from_bytes(around), doc, left[0].astype(np.int8), right[0].astype(np.int8), data

    for packs in by_bucket(batches):
        around, doc, left, right, data = (np.concatenate(c) for c in zip(*map(columns, packs), strict=True))
        words = words_at(np.append(data, np.zeros(8, np.uint8)))
        bits = np.zeros(len(doc), np.int64)
        base = np.arange(len(doc)) * AROUND + REACH
        hashes, rows, places = [], [], []
        for l in range(PLACES):
            fit = np.flatnonzero((left >= l) & (right >= REACH - l))
            hashes.append(run_hash(words, base[fit] - l, WINDOW))
            rows.append(fit)
            places.append(np.full(len(fit), l))
        hashes, rows, places = (np.concatenate(x) for x in (hashes, rows, places))
        order = np.lexsort((doc[rows], hashes))
        h, d = hashes[order], doc[rows][order]
        if len(h):
            new = np.append(True, h[1:] != h[:-1])
            again = order[d > d[new][np.cumsum(new) - 1]]
            np.bitwise_or.at(bits, rows[again], np.int64(1) << places[again])
        which = np.flatnonzero(bits)
        yield record(FLAGS, doc[which], around[which], bits[which])


def repeated_bytes(found: Anchors, frequent: np.ndarray, owner, around, places) -> np.ndarray:
    """Which bytes windows cover that a smaller document has. owner, around, places: of the
    flags of all texts."""
    start = np.zeros(len(found.data) + 1, bool)
    hot = frequent[(found.digit % np.uint64(TABLE)).astype(np.int64)] > 0
    flag = of_text(around.astype(np.uint64), owner)
    order = np.argsort(flag, kind="stable")
    flag, places = flag[order], places[order]
    if len(flag):
        cold = np.flatnonzero(~hot)
        mine = of_text(found.around[cold], found.owner[cold])
        for side in ("left", "right"):
            # A neighbourhood may be flagged in whole and, by another copy, in part.
            at = np.clip(np.searchsorted(flag, mine, side=side) - (side == "right"), 0, len(flag) - 1)
            hit = np.flatnonzero(flag[at] == mine)
            bits, place, text = places[at[hit]], found.places[cold[hit]], found.owner[cold[hit]]
            for l in range(PLACES):
                some = (bits >> l) & 1 == 1
                first = place[some] - l
                fits = (first >= found.begin[text[some]]) & (first + WINDOW <= found.end[text[some]])
                start[first[fits]] = True
        starts, anchor = found.windows(np.flatnonzero(hot))
        marks = window_mark(run_hash(found.words, starts, WINDOW))
        start[starts[np.isin(of_text(marks, found.owner[anchor]), flag)]] = True
    total = np.cumsum(start[:-1], dtype=np.int32)
    covered = total.copy()
    covered[WINDOW:] -= total[:-WINDOW]
    return covered > 0


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents with `removed` (spans of bytes, end exclusive, in order), `kept` (what is
    left of the UTF-8 bytes) and `n_bytes`; the column text goes.

    A byte is removed if a window of 50 bytes covers it that also starts in a document with a
    smaller doc_id; windows are judged on the input and never cross documents. Null texts are
    empty. Rows without an id are kept whole and remove nothing; rows that repeat an id are one
    document to each other. Columns named removed, kept or n_bytes give way; others stay.

    Texts are read as they come for the first digit, and shuffled by id (compressed) to look at
    open anchors and to cut. Memory: a chunk of texts, one anchor's rows of all chunks.
    """
    docs = docs.drop("removed", "kept", "n_bytes").withColumn("doc_id", F.col("doc_id").cast("long"))
    known = docs.where(F.col("doc_id").isNotNull())
    named = known.select("doc_id", F.col("text").cast("string").alias("text"))
    frequent = frequent_digits(named)
    buckets = PACKS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = suffixes(named, frequent, buckets).repartition("bucket").sortWithinPartitions("bucket")
    marks = ordered.mapInArrow(tidied(sorted_groups), MARK)
    # A task has few marks of any one document: collected before the shuffle they would only grow.
    marks = marks.withColumnRenamed("doc_id", "__id").repartition("__id")
    marks = marks.groupBy("__id").agg(F.collect_list("mark").alias("__marks"))
    # Texts and marks are shuffled once: both joins read the same exchanges.
    texts = packed(known).where(F.col("doc_id").isNotNull())
    near = neighbourhoods(texts.select("doc_id", "text") if len(docs.columns) > 2 else texts, marks, buckets)
    parts = near.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(compare_windows), FLAGS)
    parts = parts.groupBy(F.col("doc_id").alias("__part")).agg(
        F.collect_list(F.struct("around", "places")).alias("__parts")
    )
    joined = texts.join(marks, F.col("doc_id") == F.col("__id"), "left").join(
        parts, F.col("doc_id") == F.col("__part"), "left"
    )
    alone = packed(docs.where(F.col("doc_id").isNull())).withColumns(
        {n: F.lit(None).cast(joined.schema[n].dataType) for n in ("__marks", "__parts")}
    )
    joined = joined.drop("__id", "__part").unionByName(alone)
    others = [f for f in docs.schema.fields if f.name != "text"]
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([
        *others, StructField("removed", ArrayType(span)), StructField("kept", BinaryType()),
        StructField("n_bytes", LongType()),
    ])
    names = [f.name for f in others]
    everything = (1 << PLACES) - 1

    def run(batches):
        for batch in batches:
            texts = unpacked(batch.column(batch.schema.names.index("text")))
            names_in = batch.schema.names
            for a, b in in_chunks(texts, CHUNK):
                flags, flagged = [], np.zeros(b - a, bool)
                for name, second in (("__marks", everything), ("__parts", None)):
                    lists = batch.column(names_in.index(name)).slice(a, b - a)
                    sizes = lists.value_lengths().fill_null(0).to_numpy()
                    rows = lists.flatten()
                    if second:
                        mark = rows.to_numpy(zero_copy_only=False).astype(np.int64)
                        around, use, places = mark >> 1, mark & 1 == 0, np.full(len(rows), second)
                    else:
                        around, places = (rows.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                        use = np.ones(len(rows), bool)
                    owner = np.repeat(np.arange(b - a), sizes)
                    flagged[owner[use]] = True
                    flags.append((owner[use], around[use], places[use].astype(np.int64)))
                owner, around, places = (np.concatenate(c) for c in zip(*flags, strict=True))
                # Of most texts nothing goes: they need no anchors.
                found = Anchors([t if f else b"" for t, f in zip(texts[a:b], flagged.tolist(), strict=True)])
                gone = repeated_bytes(found, frequent, owner, around, places)
                removed, kept = [], []
                for i, text in enumerate(texts[a:b]):
                    if not flagged[i]:
                        removed.append([])
                        kept.append(text)
                        continue
                    mine = gone[found.begin[i] : found.end[i]]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                    removed.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
                    kept.append(np.frombuffer(text, np.uint8)[~mine].tobytes())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(part.schema.names.index(n)) for n in names),
                        pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(kept, pa.binary()),
                        pa.array([len(t) for t in texts[a:b]], pa.int64()),
                    ],
                    names=schema.names,
                )

    return joined.mapInArrow(tidied(run), schema)
