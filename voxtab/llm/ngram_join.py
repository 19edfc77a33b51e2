"""N-gram Jaccard join: a size-aware heavy-light join over word shingles, and its components.

Sets are told apart by size. If two sets are alike enough, they share at least c elements among
the first few of each in any common order. Small sets list all pairs of these first elements
and meet where a pair is equal; large sets scan the inverted lists of single elements. Where
small ends is chosen by the cost of both ways. Frequent elements come last in the order, so that
passages which many texts share are seldom among the first.

Large families of copies are not compared pair by pair: a first round links members of short
lists to a few others, and the exact round afterwards looks only at sets which are not yet
connected.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtab.llm.common import cut, in_chunks, text_bytes, tidied
from voxtab.llm.components import components
from voxtab.llm.shingles import mixed, shingle_sets

WIDTH, PERCENT = 5, 75
# Bytes of a shingle's hash that are kept.
ELEMENT_BYTES = 5
# Bits of a set's parity sketch, and elements by which the first round lists a set.
SKETCH_BITS = 1024
LISTED = 6
# Members of a list that each is compared with in the first round.
NEIGHBOURS = 3
# Sets whose list entries are made at once.
TOGETHER = 512
# Rows of a list that stand in a block; longer lists are compared block with block.
BLOCK = 2048
# Parts of a sketch that are put on top of each other for small sets.
FOLDS = 4
# Elements before a frequent one that its list entries name.
EARLIER = 4
# Largest size that can count as small; buckets of the tables of fixed size that tasks get.
SMALLEST_LARGE = 64
TABLE = 1 << 22
# An element is frequent from this count on, in steps of this factor.
FREQUENT, STEP, LEVELS = 8, 8, 3

SETS = "doc_id long, n int, id long, low array<long>, sketch binary, elements binary"


def pack_elements(values: np.ndarray) -> bytes:
    """Sorted hashes, the upper bits of each."""
    upper = (values >> np.uint64(64 - 8 * ELEMENT_BYTES)).astype("<u8")
    return upper.view(np.uint8).reshape(-1, 8)[:, :ELEMENT_BYTES].tobytes()


def unpack_elements(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // ELEMENT_BYTES, 8), np.uint8)
    wide[:, :ELEMENT_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, ELEMENT_BYTES)
    return wide.view("<i8").ravel()


def sketch_of(elements: np.ndarray) -> bytes:
    """For each bit whether an odd number of elements fall on it: each element in only one of
    two sets changes one bit at most."""
    odd = np.bincount((elements % SKETCH_BITS).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def prefix_length(n: np.ndarray | int, common: int = 1):
    """First elements among which two like sets share `common`; n: the size of one of them."""
    return n - (PERCENT * n + 99) // 100 + common


def shingle_table(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, size of its set, a 64-bit id of the set, first elements in the
    order of their hashes, parity sketch and elements. A set's elements stand in the first of
    its rows in each chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in in_chunks(texts):
                sets = shingle_sets(texts[a:b], WIDTH)
                packed = [pack_elements(s) for s in sets]
                ids = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
                ids = np.array(ids, np.uint64).astype(np.int64).tolist()
                seen, first = set(), []
                for i in ids:
                    first.append(i not in seen)
                    seen.add(i)
                keep = [bool(f and p) for f, p in zip(first, packed, strict=True)]
                values = [unpack_elements(p) if k else None for p, k in zip(packed, keep, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array(ids, pa.int64()),
                        pa.array([None if v is None else v[:LISTED] for v in values], pa.list_(pa.int64())),
                        pa.array([None if v is None else sketch_of(v) for v in values], pa.binary()),
                        pa.array([p if k else None for p, k in zip(packed, keep, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "n", "id", "low", "sketch", "elements"],
                )

    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return named.mapInArrow(tidied(run), SETS)


def fixed_table(marks: DataFrame) -> np.ndarray:
    """Marks (bucket: long below TABLE, value: 1 to 255) as an array of TABLE bytes, the largest
    value of each bucket; what reaches the driver does not grow with the data."""
    block = 1 << 12
    each = marks.groupBy("bucket").agg(F.max("value").cast("int").alias("value"))
    blocks = each.groupBy(F.expr(f"bucket div {block}").alias("block")).agg(
        F.collect_list(F.struct(F.col("bucket").cast("int").alias("bucket"), "value")).alias("cells")
    )

    def build(batches):
        for batch in batches:
            rows = batch.to_pylist()
            data = []
            for row in rows:
                cells = np.zeros(block, np.uint8)
                for cell in row["cells"]:
                    cells[cell["bucket"] % block] = cell["value"]
                data.append(cells.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["block"] for r in rows], pa.int64()), pa.array(data, pa.binary())],
                names=["block", "cells"],
            )

    table = np.zeros(TABLE, np.uint8)
    found = blocks.mapInArrow(build, "block long, cells binary").toArrow().to_pylist()
    for row in found:
        table[row["block"] * block : (row["block"] + 1) * block] = np.frombuffer(row["cells"], np.uint8)
    return table


def counted(n: int) -> int:
    """Elements of a set, by hash, that are counted first."""
    return prefix_length(n) + n // 32 + 2


def marks_of(counts: DataFrame) -> tuple[np.ndarray, int]:
    """Levels by bucket from counts by element, and the count at which level 1 begins: the least
    power of FREQUENT that leaves most buckets at 0."""
    counts = cut(counts.groupBy("element").count().where(F.col("count") >= FREQUENT))
    by_size = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).count().collect()
    start = FREQUENT
    while sum(r["count"] for r in by_size if 2 ** (r["power"] + 1) > start) > TABLE // 8:
        start *= STEP
    level = F.lit(0)
    for k in range(LEVELS):
        level = F.when(F.col("count") >= start * STEP**k, k + 1).otherwise(level)
    marks = counts.where(F.col("count") >= start).select(
        F.pmod("element", F.lit(TABLE)).alias("bucket"), level.alias("value")
    )
    return fixed_table(marks), start


def frequency_levels(sets: DataFrame) -> tuple[np.ndarray, int]:
    """How frequent the elements of each bucket are, 0 (seldom) to LEVELS, and a count at which
    level 1 begins.

    Counted are the elements that may come first in a set, over all documents: those with the
    smallest hashes, and where so many of these are frequent that others move up, all others."""
    chosen = sets.where(F.col("elements").isNotNull()).select("elements")

    def elements(pick):
        def run(batches):
            for batch in batches:
                parts = [pick(unpack_elements(data)) for data in batch.column(0).to_pylist()]
                whole = np.concatenate([np.zeros(0, np.int64), *parts])
                yield pa.RecordBatch.from_arrays([pa.array(whole)], names=["element"])

        return chosen.mapInArrow(tidied(run), "element long")

    levels, start = marks_of(elements(lambda own: own[: counted(len(own))]))

    def moved_up(own):
        n = counted(len(own))
        seldom = int((levels[own[:n] % TABLE] == 0).sum())
        return own[n:] if seldom < prefix_length(len(own)) else own[:0]

    more, second = marks_of(elements(moved_up))
    return np.maximum(levels, more), max(start, second)


def level_counts(start: int) -> np.ndarray:
    """A typical count of elements of each level."""
    return np.array([1.0, *(start * STEP**k * np.sqrt(STEP) for k in range(LEVELS))])


def first_elements(elements: np.ndarray, levels: np.ndarray, extra: int) -> np.ndarray:
    """The first elements of a set: by level, then by hash; `extra` more than single ones need."""
    order = np.argsort(levels[elements % TABLE], kind="stable")
    return elements[order[: prefix_length(len(elements)) + extra]]


def choose_boundary(sizes: list[tuple[int, int, float]]) -> int:
    """The largest size that counts as small, by cost. sizes: of small sets, how many there are
    and what their lists hold. Pairs of first elements cost a row each; scanning costs what
    the lists hold. Sets that a large one may still be like have to be listed as well."""
    cost = {}
    for boundary in range(SMALLEST_LARGE + 1):
        total = 0.0
        for n, count, held in sizes:
            p = prefix_length(n) + 1
            if n <= boundary:
                total += count * p * (p - 1) / 2
            if n > boundary or 100 * n >= PERCENT * (boundary + 1):
                total += held
        cost[boundary] = total
    return min(cost, key=lambda b: (cost[b], b))


def size_costs(sets: DataFrame, levels: Broadcast, start: int) -> list[tuple[int, int, float]]:
    typical = level_counts(start)

    def run(batches):
        for batch in batches:
            held = [
                float(typical[levels.value[first_elements(unpack_elements(d), levels.value, 0) % TABLE]].sum())
                for d in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.float64())], names=["n", "held"])

    small = sets.where(F.col("elements").isNotNull() & (F.col("n") <= SMALLEST_LARGE)).select("n", "elements")
    rows = small.mapInArrow(tidied(run), "n int, held double").groupBy("n").agg(F.count("*"), F.sum("held")).collect()
    return [tuple(r) for r in rows]


def keys_and_hints(levels: Broadcast, boundary: int):
    """Functions for `postings`: the keys of a set's elements, with places, levels and the first
    elements; and the hints of keys."""
    bits = 8 * ELEMENT_BYTES
    mask = np.uint64((1 << bits) - 1)

    def keys_of(elements: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, table = len(elements), levels.value
        first = first_elements(elements, table, 1).astype(np.uint64)
        level = table[(first % np.uint64(TABLE)).astype(np.int64)]
        keys, places, frequent = [], [], []
        if n <= boundary:
            i, j = np.triu_indices(len(first), 1) if n > 1 else (np.zeros(1, int), np.zeros(1, int))
            low, high = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
            keys.append((mixed(mixed(low + np.uint64(1)) + high) & mask) + np.uint64(1 << bits))
            places.append(i)
            frequent.append(np.minimum(level[i], level[j]) * (n > 1))
        if n > boundary or 100 * n >= PERCENT * (boundary + 1):
            p = prefix_length(n)
            keys.append(first[:p])
            places.append(np.arange(p))
            frequent.append(level[:p])
        columns = np.concatenate(keys).astype(np.int64), np.concatenate(places), np.concatenate(frequent)
        return *columns, first.astype(np.int64)

    def hints_of(keys, places, frequent, first: np.ndarray, sketch: bytes) -> list[bytes | None]:
        before = np.concatenate([np.full(EARLIER + 1, -1, np.int64), first])
        folded = np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(FOLDS, -1)).tobytes()
        n_pairs = int((keys >= 1 << bits).sum())
        second = np.triu_indices(len(first), 1)[1] if n_pairs > 1 else np.zeros(1, int)
        found: list[bytes | None] = [None] * len(keys)
        for k in np.flatnonzero(frequent).tolist():
            if k < n_pairs:
                j = int(second[k])
                near = before[j : j + EARLIER + 1]  # the five before the second element
                near = near[near != first[places[k]]][-EARLIER:]
                found[k] = folded + near.astype("<i8").tobytes()
            else:
                j = int(places[k])
                found[k] = sketch + before[j + 1 : j + 1 + EARLIER].astype("<i8").tobytes()
        return found
    return keys_of, hints_of


def heavy_keys(sets: DataFrame, levels: Broadcast, start: int, boundary: int) -> DataFrame:
    """Keys with more than BLOCK entries: key, parts (how many components), top (the largest of
    them), n_top and n_rest. Counted are the keys that may have so many by the levels of their
    elements."""
    keys_of, _ = keys_and_hints(levels, boundary)
    least = next((k for k in range(1, LEVELS) if 2 * start * STEP**k > BLOCK), LEVELS)

    def run(batches):
        for batch in batches:
            found = [keys_of(unpack_elements(d)) for d in batch.column(3).to_pylist()]
            picked = [f[0][f[2] >= least] for f in found]
            which = pa.array(np.repeat(np.arange(batch.num_rows), [len(p) for p in picked]))
            keys = pa.array(np.concatenate([np.zeros(0, np.int64), *picked]))
            yield pa.RecordBatch.from_arrays(
                [keys, batch.column(0).take(which), batch.column(2).take(which)], names=["key", "id", "part"]
            )

    rows = sets.mapInArrow(tidied(run), "key long, id long, part long")
    by_part = rows.groupBy("key", F.coalesce("part", "id").alias("part")).agg(F.count("*").alias("n"))
    found = by_part.groupBy("key").agg(
        F.sum("n").alias("total"), F.count("*").alias("parts"), F.max(F.struct("n", "part")).alias("most")
    )
    return found.where(F.col("total") > BLOCK).select(
        "key", "parts", F.col("most.part").alias("top"), F.col("most.n").alias("n_top"),
        (F.col("total") - F.col("most.n")).alias("n_rest"),
    )


def postings(
    sets: DataFrame, levels: Broadcast, boundary: int, marks: Broadcast | None = None, wanted: bool = False
) -> DataFrame:
    """Keys under which sets (id, n, part, elements, sketch) are listed: key, id, part, n, place,
    hint. Pairs of first elements for small sets; single ones for large sets and those small
    ones that may be like a large one. place: of the key's first element in the set's order.
    hint, for frequent elements only: the set's sketch, folded for pairs, then the EARLIER
    elements before the key's last one. marks: take only keys whose bucket is marked (wanted), or
    only others."""
    keys_of, hints_of = keys_and_hints(levels, boundary)

    def parts(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                yield batch.slice(start, TOGETHER)

    def run(batches):
        for batch in parts(batches):
            found = [keys_of(unpack_elements(d)) for d in batch.column(3).to_pylist()]
            if marks is not None:
                kept = [(marks.value[f[0] % TABLE] > 0) == wanted for f in found]
            else:
                kept = [np.ones(len(f[0]), bool) for f in found]
            hints = []
            for f, k, s in zip(found, kept, batch.column(4).to_pylist(), strict=True):
                own = hints_of(f[0], f[1], f[2] * k, f[3], s)
                hints += own if k.all() else [own[x] for x in np.flatnonzero(k)]
            found = [(f[0][k], f[1][k]) for f, k in zip(found, kept, strict=True)]
            counts = [len(f[0]) for f in found]
            which = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)])),
                    *(batch.column(k).take(which) for k in (0, 2, 1)),
                    pa.array(np.concatenate([np.zeros(0, int), *(f[1] for f in found)]).astype(np.int32)),
                    pa.array(hints, pa.binary()),
                ],
                names=["key", "id", "part", "n", "place", "hint"],
            )

    return sets.mapInArrow(tidied(run), "key long, id long, part long, n int, place int, hint binary")


def sizes_fit(n, m):
    return (100 * F.least(n, m)) >= PERCENT * F.greatest(n, m)


def first_round(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets next to each other in lists of single elements: each list in an
    order of its own, so that members of a large family meet others each time."""
    listed = sets.where(F.col("low").isNotNull()).select("id", "n", F.explode("low").alias("element"))
    window = Window.partitionBy("element").orderBy(F.xxhash64("element", "id"), "id")
    before = F.array(*[F.lag(F.struct("id", "n"), d).over(window) for d in range(1, NEIGHBOURS + 1)])
    listed = listed.withColumn("before", before)
    pairs = listed.select("id", "n", F.explode("before").alias("o")).where(
        F.col("o").isNotNull() & sizes_fit(F.col("n"), F.col("o.n"))
    )
    pairs = pairs.select(F.least("id", "o.id").alias("a"), F.greatest("id", "o.id").alias("b"))
    return pairs.where("a <> b").distinct()


def may_be_like(n, m, place, other):
    """Whether sets of these sizes may still be alike if the elements at these places are the
    first that they share: enough must follow in both. True at least where they are the first."""
    fit = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
    most = np.minimum(n - place, m - other)
    return fit & ((100 + PERCENT) * most >= PERCENT * (n + m))


def sketches_fit(apart, both):
    """Whether sets with sizes that add up to `both` may be alike if they differ in at least
    `apart` elements."""
    return 100 * (both - apart) * (100 + PERCENT) >= 200 * PERCENT * both


def pairs_of_list(own, group, size, at, hints, block=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of different components that may be alike. Hints, where a list has
    them, drop pairs whose sketches are too far apart, and those that share one of the elements
    just before the key's last: these met under an earlier key. block: two values; members of one
    are compared with those of the other only."""
    values, counts = np.unique(group, return_counts=True)
    minor = group != values[counts.argmax()]
    after = np.arange(len(own))
    sketch = earlier = None
    if all(h is not None for h in hints):
        data = np.frombuffer(b"".join(hints), np.uint8).reshape(len(own), -1)
        sketch, earlier = data[:, : -8 * EARLIER], data[:, -8 * EARLIER :]
        earlier = np.ascontiguousarray(earlier).view("<i8")
    for i in np.flatnonzero(minor if block is None else block == block.min()):
        other = ~minor | (after > i) if block is None else block != block[i]
        fit = may_be_like(size, size[i], at, at[i]) & (group != group[i]) & other
        which = np.flatnonzero(fit)
        if sketch is not None and len(which):
            apart = np.bitwise_count(sketch[which] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            which = which[sketches_fit(apart, size[which] + size[i])]
            mine = earlier[i][earlier[i] >= 0]
            which = which[~np.isin(earlier[which], mine).any(axis=1)]
        if len(which):
            yield np.minimum(own[which], own[i]), np.maximum(own[which], own[i])


def unique(found) -> pa.RecordBatch:
    both = np.stack([np.concatenate(c) for c in zip(*found, strict=True)], axis=1)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    both = both[np.append(True, (both[1:] != both[:-1]).any(axis=1))]
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets of different components from rows of `postings` in order of their keys. Of
    each list, the largest component's members are not compared with each other."""

    def emit(rows: pa.RecordBatch):
        key, ids, n, place = (rows.column(k).to_numpy().astype(np.int64) for k in (0, 1, 3, 4))
        part = rows.column(2).fill_null(0).to_numpy()
        part = np.where(rows.column(2).is_null().to_numpy(zero_copy_only=False), ids, part)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(key)))
        several = (
            np.logical_or.reduceat(part != np.repeat(part[starts], sizes), starts) if len(key) else sizes > 1
        )
        held, found = 0, []
        for s, m in zip(starts[several].tolist(), sizes[several].tolist(), strict=True):
            columns = (c[s : s + m] for c in (ids, part, n, place))
            for a, b in pairs_of_list(*columns, rows.column(5).slice(s, m).to_pylist()):
                found.append((a, b))
                held += len(a)
                if held > 1_000_000:
                    yield unique(found)
                    held, found = 0, []
        if found:
            yield unique(found)

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        for whole in pa.Table.from_batches([*rest, batch]).combine_chunks().to_batches():
            key = whole.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            yield from emit(whole.slice(0, last))
            rest = [whole.slice(last)]
    for whole in rest:
        yield from emit(whole)


def block_pairs(rows: pa.Table) -> pa.Table:
    """As `list_pairs`, for one pair of blocks of one key: rows of the first with the second, or
    of one block with each other."""
    own, part, n, place, block = (rows[c].to_numpy().astype(np.int64) for c in ("id", "part", "n", "place", "block"))
    first, second = rows["i"][0].as_py(), rows["j"][0].as_py()
    found = []
    if first == second or len(np.unique(block)) == 2:
        hints = rows["hint"].to_pylist()
        found = list(pairs_of_list(own, part, n, place, hints, block if first < second else None))
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    return pa.Table.from_batches([unique(found)]) if found else empty


def in_blocks(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """Rows of `postings` with the blocks that they meet in: key, i, j, block and the rest. Members of
    a key's largest component meet the others only, and keys of one component none."""
    rows = rows.withColumn("part", F.coalesce("part", "id")).dropDuplicates(["key", "id"])
    known = rows.join(heavy, "key", "left").where("parts is null or parts > 1")
    blocks = lambda n: F.ceil(F.coalesce(F.col(n), F.lit(0)) / BLOCK)
    known = known.withColumns({"b_rest": F.greatest(blocks("n_rest"), F.lit(1)), "b_top": blocks("n_top")})
    minor = F.col("parts").isNull() | (F.col("part") != F.col("top"))
    hashed = lambda n: F.pmod(F.xxhash64("id", "key"), F.col(n))
    known = known.withColumn("block", F.when(minor, hashed("b_rest")).otherwise(F.col("b_rest") + hashed("b_top")))
    last = F.when(minor, F.col("b_rest") + F.col("b_top")).otherwise(F.col("b_rest")) - 1
    known = known.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return known.select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "id", "part", "n", "place", "hint",
    )


def sent(table: np.ndarray, df: DataFrame) -> Broadcast:
    """A table that executors get, and the driver holds for them, once for all functions that use it."""
    return df.sparkSession.sparkContext.broadcast(table)


def marked(ids: DataFrame) -> Broadcast:
    """A table of fixed size that marks the buckets of ids."""
    return sent(fixed_table(ids.select(F.pmod("id", F.lit(TABLE)).alias("bucket"), F.lit(1).alias("value"))), ids)


def among(rows: DataFrame, marks: Broadcast, wanted: bool) -> DataFrame:
    """Rows (id first) whose bucket is marked, or those whose is not, before any shuffle."""

    def run(batches):
        for batch in batches:
            hit = marks.value[batch.column(0).to_numpy() % TABLE] > 0
            yield batch.filter(pa.array(hit if wanted else ~hit))

    return rows.mapInArrow(tidied(run), rows.schema)


def exact_round(sets: DataFrame, parts: DataFrame, levels: Broadcast, boundary: int, start: int) -> DataFrame:
    """Pairs (a, b) that share a key, may be alike and are not connected yet. parts: the component
    (root) of sets that have one; a set without is its own, and is not shuffled to learn that."""
    known = parts.select(F.col("node").alias("id"), F.col("root").alias("part"))
    marks = marked(known)
    chosen = sets.where(F.col("elements").isNotNull()).select("id", "n", "elements", "sketch")
    columns = ["id", "n", "part", "elements", "sketch"]
    alone = among(chosen, marks, False).withColumn("part", F.lit(None).cast("long")).select(columns)
    together = among(chosen, marks, True).join(known, "id", "left").select(columns)
    whole = alone.unionByName(together)
    heavy = cut(heavy_keys(whole, levels, start, boundary))
    long_lists = marked(heavy.select(F.col("key").alias("id")))
    rows = postings(whole, levels, boundary, long_lists, False)
    listed = rows.repartition("key").sortWithinPartitions("key")
    found = listed.mapInArrow(tidied(list_pairs), "a long, b long")
    if long_lists.value.any():
        rows = in_blocks(postings(whole, levels, boundary, long_lists, True), heavy)
        found = found.unionByName(rows.groupBy("key", "i", "j").applyInArrow(block_pairs, "a long, b long"))
    return found.distinct()


def alike(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets are alike. Sketches bound the overlap of most others well enough to
    drop them; the rest are compared element by element."""
    known = sets.where(F.col("sketch").isNotNull()).groupBy("id").agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    sides = pairs.join(known.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a")
    sides = sides.join(known.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")), "b")

    def bounded(batches):
        for batch in batches:
            bits = [
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH_BITS // 8)
                for k in (3, 5)
            ]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1).astype(np.int64)
            both = batch.column(2).to_numpy().astype(np.int64) + batch.column(4).to_numpy()
            yield batch.filter(pa.array(sketches_fit(apart, both))).select(["a", "b"])

    sides = sides.select("a", "b", "n_a", "s_a", "n_b", "s_b")
    close = cut(sides.mapInArrow(tidied(bounded), "a long, b long"))
    ids = close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id")))
    full = sets.where(F.col("elements").isNotNull()).select("id", "elements")
    full = among(full, marked(ids), True)
    full = full.groupBy("id").agg(F.first("elements").alias("elements"))
    left = close.join(full.select(F.col("id").alias("a"), F.col("elements").alias("e_a")), "a")
    both = left.join(full.select(F.col("id").alias("b"), F.col("elements").alias("e_b")), "b")

    def compared(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = unpack_elements(x), unpack_elements(y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return both.select("a", "b", "e_a", "e_b").mapInArrow(tidied(compared), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id.

    Two documents are linked when their sets of word shingles (five words, A-Z lowered) have a
    Jaccard similarity of 0.75 or more; component_id is the smallest doc_id that links reach,
    the own one included. Texts with fewer than five words are one shingle; null texts and those
    without words have none and link with nothing, so each is its own component. Documents with
    equal sets are one class from the start. Rows without an id take part and get the smallest
    id of their component, null if it has none. Columns needed: doc_id, text.

    Shingles are 64-bit hashes; sizes come from these, comparisons use 40 of their bits.
    """
    sets = cut(shingle_table(docs))
    levels, start = frequency_levels(sets)
    levels = sent(levels, sets)
    boundary = choose_boundary(size_costs(sets, levels, start))
    first = cut(alike(sets, first_round(sets)))
    roots = components(first)
    second = alike(sets, exact_round(sets, roots, levels, boundary, start))
    merged = components(cut(first.unionByName(second)))
    nodes = merged.select(F.col("node").alias("id"), "root")
    known = sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "id").join(nodes, "id", "left")
    known = known.withColumn("root", F.coalesce("root", "id"))
    lowest = known.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("lowest"))
    return known.join(lowest, "root", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"),
    )
