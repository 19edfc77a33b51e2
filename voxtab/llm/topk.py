"""Exact top-k search: products of blocks of integer rows, of which each query keeps its best."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtab.llm.common import tidied

# Rows of a block, and the weights it has at most unless one row has more.
BLOCK_ROWS, BLOCK_WEIGHTS = 4096, 1 << 19
# Queries that meet a block of candidates at once, and candidates that a query's first threshold is
# taken from: their scores stay in the processor's caches.
TILE, FIRST = 256, 512
# Candidates go to so many shards for each group of queries and again for each group there is, as
# fits queries that are a hundredth of the candidates: then both are copied about as much.
SHARDS_A_GROUP = 50

BLOCK = "place long, pack binary"
FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 1024) -> Column:
    """Integers floor(scale * x) of a vector; null where it is null, or where it holds a null
    or a number that is not finite."""
    odd = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")).cast("float"))
    )
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return F.when(~odd, scaled)


def blocks(rows: DataFrame, size: int = BLOCK_ROWS) -> DataFrame:
    """Rows (id, weights) in packs of up to `size` rows, by id, null last.

    place: a number by which packs can be dealt evenly."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        for whole in batches:
            start = 0
            while start < whole.num_rows:
                batch = whole.slice(start, size)
                ends = np.cumsum(batch.column(1).value_lengths().to_numpy())
                batch = batch.slice(0, max(1, int(np.searchsorted(ends, BLOCK_WEIGHTS, side="right"))))
                start += batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place], pa.int64()), pa.array([packed(batch.column(0), batch.column(1))], pa.binary())],
                    names=["place", "pack"],
                )
                place += 1

    return rows.mapInArrow(tidied(pack), BLOCK)


def packed(ids: pa.Array, vectors: pa.Array) -> bytes:
    """Ids and weights in the smallest whole numbers that hold them."""
    order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
    ids, vectors = ids.take(pa.array(order)), vectors.take(pa.array(order))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("<i8")
    low, high = (int(flat.min()), int(flat.max())) if len(flat) else (0, 0)
    width = next(n for n in (1, 2, 4, 8) if -(1 << 8 * n - 1) <= low and high < 1 << 8 * n - 1)
    parts = [
        np.array([len(ids), ids.null_count, width], "<i8"),
        ids.fill_null(0).to_numpy().astype("<i8"),
        vectors.value_lengths().to_numpy().astype("<i4"),
        flat.astype(f"<i{width}"),
    ]
    return b"".join(p.tobytes() for p in parts)


class Block:
    """A pack's rows. ids, ascending; n_known: the rows that have one, first; weights: as a matrix, what
    a row lacks is 0; norm: no row's root of summed squares is larger."""

    def __init__(self, pack: bytes):
        n, without, width = np.frombuffer(pack, "<i8", 3).tolist()
        self.n_known = n - without
        self.ids = np.frombuffer(pack, "<i8", n, 24)
        lengths = np.frombuffer(pack, "<i4", n, 24 + 8 * n)
        flat = np.frombuffer(pack, f"<i{width}", offset=24 + 12 * n)
        self.weights = dense(lengths, flat)
        squares = (self.weights.astype(np.float64) ** 2).sum(axis=1)
        self.norm = float(np.sqrt(squares.max(initial=0)))


def dense(lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Rows of differing lengths as one matrix; what a row lacks is 0."""
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    matrix = np.zeros((len(lengths), width), flat.dtype)
    matrix[np.arange(width) < lengths[:, None]] = flat
    return matrix


def exact_type(bound: float) -> type:
    """The fastest type in which products and all sums on the way to a score are exact, if no sum of
    their sizes is above the bound."""
    return np.float32 if bound < (1 << 24) - 2 else np.float64 if bound < (1 << 53) - (1 << 12) else np.int64


class Best:
    """The k best candidates of each query of a block so far: score, id and whether it has one."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k, n = queries, k, len(queries.ids)
        self.count = np.zeros(n, np.int64)
        self.score, self.id = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        self.known = np.zeros((n, k), bool)

    def meet(self, block: Block) -> None:
        kind = exact_type(self.queries.norm * block.norm)
        common = min(self.queries.weights.shape[1], block.weights.shape[1])
        left = self.queries.weights[:, :common].astype(kind)
        right = np.ascontiguousarray(block.weights[:, :common].T, kind)
        n = len(block.ids)
        for a in range(0, len(left), TILE):
            b = min(a + TILE, len(left))
            full = n <= FIRST or (self.count[a:b] == self.k).all()
            for c, d in ((0, n),) if full else ((0, FIRST), (FIRST, n)):
                self._tile(a, b, left[a:b] @ right[:, c:d], block, c, d)

    def _tile(self, a: int, b: int, scores: np.ndarray, block: Block, c: int, d: int) -> None:
        """Scores of queries a to b with candidates c to d of the block."""
        k, whole = self.k, scores.dtype.kind == "i"
        lowest = np.iinfo(np.int64).min if whole else -np.inf
        ids = block.ids[: block.n_known]
        own = self.queries.ids[a:b]
        first, last = (np.clip(np.searchsorted(ids, own, side=s), c, d) - c for s in ("left", "right"))
        for i in np.flatnonzero(last > first).tolist():
            scores[i, first[i] : last[i]] = lowest
        # Of equal scores those with smaller ids win, so that a whole block may only tie in vain.
        score, last_id, known = self.score[a:b, k - 1], self.id[a:b, k - 1], self.known[a:b, k - 1]
        vain = known & (block.ids[c] >= last_id) if c < block.n_known else np.ones(b - a, bool)
        least = (score + vain).astype(scores.dtype)
        few = np.flatnonzero(self.count[a:b] < k)
        if len(few):
            least[few] = lowest + 1 if whole else np.finfo(scores.dtype).min
            if scores.shape[1] > k:
                bound = np.partition(scores[few], scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                least[few] = np.maximum(least[few], bound)
        hits = scores >= least[:, None]
        if not hits.any():
            return
        counts = np.count_nonzero(hits, axis=1)
        for i in np.flatnonzero(counts > 32 * k).tolist():
            row = scores[i]
            bound = np.partition(row, len(row) - k)[len(row) - k]
            above = row > bound
            ties = np.flatnonzero(hits[i] & (row == bound))[: k - np.count_nonzero(above)]
            hits[i] &= above
            hits[i, ties] = True
        row, place = np.divmod(np.flatnonzero(hits), hits.shape[1])
        new = scores[row, place].astype(np.int64)
        self._merge(row + a, new, block.ids[c + place], c + place < block.n_known)

    def _merge(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Takes in candidates of queries, of which `row` is in ascending order."""
        k = self.k
        touched = row[np.append(True, row[1:] != row[:-1])]
        old_row, old = np.nonzero(np.arange(k) < self.count[touched, None])
        old_row = touched[old_row]
        row = np.concatenate([old_row, row])
        score = np.concatenate([self.score[old_row, old], score])
        ids = np.concatenate([self.id[old_row, old], ids])
        known = np.concatenate([self.known[old_row, old], known])
        order = np.lexsort((ids, ~known, ~score, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        order, row, rank = order[keep], row[keep], rank[keep]
        self.score[row, rank], self.id[row, rank], self.known[row, rank] = score[order], ids[order], known[order]
        self.count[touched] = np.bincount(row, minlength=len(self.count))[touched]

    def rows(self) -> pa.RecordBatch:
        query, place = np.nonzero(np.arange(self.k) < self.count[:, None])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.queries.ids[query]),
                pa.array(self.id[query, place], mask=~self.known[query, place]),
                pa.array(self.score[query, place]),
            ],
            names=["query_id", "vec_id", "score"],
        )


def search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best candidates of each query of a cell within it. Rows: cell, whether it is a query pack, and
    the pack, in this order."""
    cell, candidates = None, []
    for batch in batches:
        for at, asks, pack in zip(*(batch.column(i) for i in range(3)), strict=True):
            if at.as_py() != cell:
                cell, candidates = at.as_py(), []
            if not asks.as_py():
                candidates.append(Block(pack.as_buffer()))
            elif candidates:
                best = Best(Block(pack.as_buffer()), k)
                for block in candidates:
                    best.meet(block)
                yield best.rows()


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, shards: int | None = None) -> DataFrame:
    """The k candidates with the largest inner product for each query, over all candidates.

    Both tables: a column of ids and a column of integer weights by position (array<long>); a
    position that a row lacks counts as 0, an empty row scores 0 everywhere. Result: query_id,
    rank (from 1), vec_id, score; fewer rows where there are fewer candidates; ties go to the
    smaller vec_id, null last. A candidate with the query's id is the query itself. Rows whose
    weights are null take no part, nor do queries without an id; a repeated query id is
    answered once, from the smallest of its rows; repeated candidates each count. Scores are
    exact while they fit a long.

    Packs of candidates are dealt over shards and packs of queries over groups; about `shards` cells, one
    for each shard and group, hold their candidates (in as few bytes as their weights need) and
    let the queries pass. A cell gives k rows a query, which are ranked in one shuffle.
    """
    spark = candidates.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, round((shards / SHARDS_A_GROUP) ** 0.5))
    shards = -(-shards // groups)
    named = [
        df.select(F.col(df.columns[0]).cast("long").alias("id"), F.col(df.columns[1]).alias("w"))
        .where(F.col("w").isNotNull())
        for df in (candidates, queries)
    ]
    asked = named[1].where(F.col("id").isNotNull()).groupBy("id").agg(F.min("w").alias("w"))
    numbers = [F.sequence(F.lit(0), F.lit(n - 1)) for n in (shards, groups)]
    own = [F.pmod(F.col("place"), F.lit(n)).cast("int") for n in (shards, groups)]
    dealt = [
        blocks(named[0]).select(own[0].alias("shard"), F.explode(numbers[1]).alias("group"), F.lit(False).alias("asks"), "pack"),
        blocks(asked).select(F.explode(numbers[0]).alias("shard"), own[1].alias("group"), F.lit(True).alias("asks"), "pack"),
    ]
    cells = dealt[0].unionByName(dealt[1]).select(
        (F.col("shard") * groups + F.col("group")).alias("cell"), "asks", "pack"
    )
    cells = cells.repartition("cell").sortWithinPartitions("cell", "asks")
    pairs = cells.mapInArrow(tidied(lambda batches: search(batches, k)), FOUND)
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.col("vec_id").asc_nulls_last()
    )
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
