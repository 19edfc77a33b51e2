"""Periodic runs of words, found by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q, at least two periods and SHORTEST
words long, that no neighbouring word extends. At the scale of c words each place stands for the
c words from there on, by a hash, and the smallest hash of each window of c/2 places is that
window's minimizer. A run of period q >= c + c/2 - 1 holds a whole window and the same window one
period later; minimizers depend on content alone, so both have theirs at the same place: two equal
minimizers that are q apart. Each scale looks at the pairs that are between its smallest period and
the next scale's apart; pairs are extended as far as the words repeat. Periods below the first scale
are found by comparing the words with themselves that far on.

Equal minimizers that stand close together lie in one run of a short period, which a smaller
scale has found. They are one cluster, and clusters meet by the distances that their members
can have, so that a long run of a short period costs what its length is and not its square.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from voxtab.llm.common import SPACES, in_chunks, split_words, text_bytes

# Fewest words of a run, and words a place stands for at the first scale (a power of two).
SHORTEST = 12
FIRST_SCALE = 8

K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# Two primes below 2^31 and a base for sums that tell stretches of words apart.
PRIMES, BASE = (2147483647, 2147483629), 1_000_003

RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
WORD = "[^" + "".join(f"\\x{c:02X}" for c in SPACES) + "]+"


def stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * K2
    return x ^ (x >> np.uint64(29))


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of `width` values, a power of two."""
    n = 1
    while n < width:
        values, n = pick(values[:-n], values[n:]), 2 * n
    return values


def shifted(values: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([values[by:], np.zeros(min(by, len(values)), values.dtype)])


def smallest_period(scale: int) -> int:
    return scale + scale // 2 - 1


def minimizers(hashes: np.ndarray, scale: int) -> np.ndarray:
    """Places whose hash is the smallest of a window of scale/2 places; equal ones all count."""
    width = scale // 2
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    least = slide(hashes, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    best = slide(np.concatenate([edge, least, edge]), width, np.maximum)
    return np.flatnonzero(best == hashes)


def pairs_of_scale(places: np.ndarray, key: np.ndarray, owner: np.ndarray, scale: int):
    """Seeds (place, distance) of equal minimizers of one text that are between this scale's and
    the next one's smallest periods apart."""
    low, high = smallest_period(scale), smallest_period(2 * scale)
    order = np.argsort(key, kind="stable")
    places, key, owner = places[order], key[order], owner[order]
    if not len(places):
        return places, places
    new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
    group = np.cumsum(new) - 1
    gaps = np.diff(places)
    apart = np.append(True, new[1:] | (gaps > scale // 2))
    heads = np.flatnonzero(apart)
    tails = np.append(heads[1:], len(places)) - 1
    first, last, group = places[heads], places[tails], group[heads]
    step = np.gcd.reduceat(np.where(apart, 0, np.append(0, gaps)), heads)
    found_at, found_by = [], []
    for ahead in range(1, len(first)):
        a, b = np.arange(len(first) - ahead), np.arange(ahead, len(first))
        near = (group[a] == group[b]) & (first[b] - last[a] < high)
        if not near.any():
            break
        a, b = a[near], b[near]
        base, top = first[b] - last[a], last[b] - first[a]
        every = np.maximum(np.gcd(step[a], step[b]), 1)
        skip = np.maximum(-((base - low) // every), 0)
        count = np.maximum((np.minimum(top, high - 1) - base) // every + 1 - skip, 0)
        row = np.repeat(np.arange(len(a)), count)
        number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + skip[row]
        beyond = number * every[row]
        found_at.append(last[a][row] - np.minimum(beyond, (last[a] - first[a])[row]))
        found_by.append(base[row] + beyond)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found_at]), np.concatenate([empty, *found_by])


class Sums:
    """Sums over a sequence by which any two stretches of it are compared at once."""

    def __init__(self, x: np.ndarray):
        mixed = stir((x.astype(np.uint64) + np.uint64(1)) * K1)
        self.each = []
        for prime in PRIMES:
            power, step = np.ones(1, np.int64), BASE
            while len(power) <= len(x):
                power = np.concatenate([power, power * step % prime])
                step = step * step % prime
            values = (mixed % np.uint64(prime)).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(values * power[: len(x)] % prime)])
            self.each.append((prime, power, total))

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a and from b > a on are the same."""
        same = np.ones(len(a), bool)
        for prime, power, total in self.each:
            left = (total[a + n] - total[a]) % prime * power[b - a] % prime
            same &= left == (total[b + n] - total[b]) % prime
        return same

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that are the same from a and b on, at most `most`."""
        n = np.zeros(len(a), np.int64)
        for bit in reversed(range(int(most.max(initial=0)).bit_length())):
            longer = n + (1 << bit)
            try_at = np.flatnonzero(longer <= most)
            good = self.equal(a[try_at], b[try_at], longer[try_at])
            n[try_at[good]] = longer[try_at[good]]
        return n

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that are the same before a and b, at most `most`."""
        n = np.zeros(len(a), np.int64)
        for bit in reversed(range(int(most.max(initial=0)).bit_length())):
            longer = n + (1 << bit)
            try_at = np.flatnonzero(longer <= most)
            back = longer[try_at]
            good = self.equal(a[try_at] - back, b[try_at] - back, back)
            n[try_at[good]] = back[good]
        return n


def lag_scan(x: np.ndarray, period: int) -> np.ndarray:
    """Rows (start, end, period) of the stretches that repeat after `period` words."""
    if len(x) <= period:
        return np.zeros((0, 3), np.int64)
    same = np.concatenate([[0], (x[:-period] == x[period:]).view(np.int8), [0]])
    starts, stops = np.flatnonzero(np.diff(same)).reshape(-1, 2).T
    long = stops - starts >= max(SHORTEST, 2 * period) - period
    starts, ends = starts[long], stops[long] + period
    return np.column_stack([starts, ends, np.full(len(starts), period)])


def exact(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows as they are if words bear them out, else (sums that agree by chance) what a scan at
    that distance finds around them."""
    good = []
    for start, end, period in rows.tolist():
        inside = np.array_equal(x[start : end - period], x[start + period : end])
        if inside and x[start - 1] != x[start - 1 + period] and x[end] != x[end - period]:
            good.append((start, end, period))
        else:
            good += [tuple(r) for r in lag_scan(x, period).tolist()]
    return np.array(good, np.int64).reshape(-1, 3)


def find_runs(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period), in this order, of the runs of several texts. codes: of
    their words, one text after the other; bounds: where each text begins, and the end."""
    sizes = np.diff(bounds)
    texts = np.flatnonzero(sizes >= SHORTEST)
    if not len(texts):
        return np.zeros((0, 4), np.int64)
    # Marks between the texts equal no word and no other mark.
    mark = int(codes.max()) + 1 + np.arange(len(texts) + 1)
    parts = [mark[:1]]
    for i, t in enumerate(texts.tolist()):
        parts += [codes[bounds[t] : bounds[t + 1]], mark[i + 1 : i + 2]]
    x = np.concatenate(parts)
    size = sizes[texts]
    begin = 1 + np.cumsum(size + 1) - (size + 1)
    owner = np.searchsorted(begin, np.arange(len(x)), side="right") - 1

    found = [lag_scan(x, q) for q in range(1, smallest_period(FIRST_SCALE))]
    where = np.arange(len(x))
    hashes, length = stir((x.astype(np.uint64) + np.uint64(1)) * K1), 1
    at, by = [], []
    scale = FIRST_SCALE
    while 2 * smallest_period(scale) <= size.max():
        # Only texts that can hold two such periods go on.
        keep = (owner[where] >= 0) & (size[owner[where]] >= 2 * smallest_period(scale))
        where, hashes = where[keep], hashes[keep]
        while length < scale:
            hashes = stir(hashes * K1 + shifted(hashes, length))
            length *= 2
        places = minimizers(hashes, scale)
        own = owner[where[places]]
        whole = where[places] + scale <= begin[own] + size[own]
        places, own = places[whole], own[whole]
        place, distance = pairs_of_scale(where[places], hashes[places], own, scale)
        at.append(place)
        by.append(distance)
        scale *= 2
    at, by = np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *by])
    if len(at):
        sums = Sums(x)
        own = owner[at]
        left = sums.backward(at, at + by, at - begin[own])
        right = sums.forward(at, at + by, np.maximum(begin[own] + size[own] - at - by, 0))
        rows = np.column_stack([at - left, at + by + right, by])
        long = rows[:, 1] - rows[:, 0] >= np.maximum(SHORTEST, 2 * by)
        found.append(exact(x, np.unique(rows[long], axis=0)))
    # A stretch found by several distances has the smallest of them as its period.
    rows = np.unique(np.concatenate(found), axis=0)
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))] if len(rows) else rows
    own = owner[rows[:, 0]]
    return np.column_stack([texts[own], rows[:, 0] - begin[own], rows[:, 1] - rows[:, 0], rows[:, 2]])[
        np.lexsort((rows[:, 2], rows[:, 0]))
    ]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The documents with `runs` (start, length and period in words, by start, then period) and
    `collapsed`: their words, joined by one space, without those that any run contains after its
    first period.

    Words are what ASCII white space parts; null and empty texts have none, no runs and an empty
    `collapsed`. Rows are judged each for itself, so repeated rows, ties and rows without an id are
    no matter. Columns named runs or collapsed give way; others, doc_id too, stay as they are.

    Texts are handled where they are read, some 4 MB at a time, a longer one whole: no shuffle.
    """
    docs = docs.drop("runs", "collapsed").withColumn("text", F.col("text").cast("string"))
    names, place = docs.columns, docs.columns.index("text")
    schema = StructType([
        *docs.schema.fields, StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(place))
            for a, b in in_chunks(texts):
                words = split_words(texts[a:b])
                rows = find_runs(words.codes, words.bounds)
                edges = np.searchsorted(rows[:, 0], np.arange(b - a + 1))
                collapsed = []
                for k in range(b - a):
                    codes = words.codes[words.bounds[k] : words.bounds[k + 1]]
                    mine = rows[edges[k] : edges[k + 1]]
                    if len(mine):
                        change = np.zeros(len(codes) + 1, np.int64)
                        np.add.at(change, mine[:, 1] + mine[:, 3], 1)
                        np.add.at(change, mine[:, 1] + mine[:, 2], -1)
                        codes = codes[np.cumsum(change[:-1]) == 0]
                    collapsed.append(b" ".join([words.unique[c] for c in codes.tolist()]))
                run_rows = pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(rows[:, j])) for j in (1, 2, 3)], names=RUN.names
                )
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), run_rows),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    names=[*names, "runs", "collapsed"],
                )

    return docs.mapInArrow(run, schema)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth by crc32 of its id repeats its words from some place on.

    h = crc32 of the id as text, g = h div 10; where h is a multiple of 10, of n > 0 words each
    from a = g % n on becomes that at a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8). Rows
    without an id, and all others, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = docs.withColumn("__words", words).withColumn("__n", F.size("__words"))
    rows = rows.withColumn("__a", F.expr("cast((crc32(cast(cast(doc_id as string) as binary)) div 10) % __n as int)"))
    rows = rows.withColumn(
        "__p", F.expr("cast(1 + (__n - __a) div (3 + (crc32(cast(cast(doc_id as string) as binary)) div 10) % 8) as int)")
    )
    repeated: Column = F.expr(
        "array_join(concat(slice(__words, 1, __a), slice(flatten(array_repeat("
        "slice(__words, __a + 1, __p), cast(ceil((__n - __a) / __p) as int))), 1, __n - __a)), ' ')"
    )
    text = F.when(chosen & (F.col("__n") > 0), repeated).otherwise(F.col("text"))
    return rows.withColumn("text", text).drop("__words", "__n", "__a", "__p")
