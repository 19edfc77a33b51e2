"""Packing: token sequences of a fixed length, filled by multiway differencing."""

import heapq
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.llm.common import cut_words, give_back, in_chunks, kept_by_worker, text_chunks, tidied

# Tokens of pieces that are left for differencing. Finer pieces balance better.
PIECE = 256
# Windows that are balanced together.
WINDOWS = 64
# Tokens that a window is left short of, so that near-equal ones fit.
SLACK = 16
# Words and parts of words whose ids a worker remembers (about 200 bytes each), bytes of the longest
# word that it does, and words that are learnt together.
KNOWN_WORDS, KNOWN_PARTS = 1 << 17, 1 << 16
KNOWN_BYTES = 64
NEW_WORDS = 1 << 13
# Of those, words that go to the library as they are at a time: it gives about 1 KB for each.
WHOLE_WORDS = 1 << 10
# Bytes of text whose words are looked up together: the more, the fewer lookups. Bytes of text that
# are cut into words together, with about 15 bytes of tables a byte.
TEXT_BYTES = 8 << 20
CUT_BYTES = 1 << 20

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def binaries(column: pa.Array) -> list[bytes]:
    """The values of a large binary column without nulls, which is no slice of another."""
    if not len(column):
        return []
    _, places, data = column.buffers()
    ends, data = np.frombuffer(places, np.int64, len(column) + 1).tolist(), memoryview(data or b"").tobytes()
    return [data[a:b] for a, b in pairwise(ends)]


class WordTokens:
    """Ids of whole texts by a word-level tokenizer, from those of their words.

    The tokenizer's own pattern cuts a text at white space, which it drops, so words can be
    encoded on their own, and those met before need not be. Words of Latin letters, digits and
    marks are cut by that pattern here and go to the library's model in lower case; all other
    words go through the library as they are."""

    # The pattern by which the tokenizer's file cuts words.
    CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    # Characters beyond those that are one code point in any normal form and have simple lower
    # cases, and line ends.
    STRANGE = "[^\\n\\x21-\\x7e\u00a1-\u012f\u0131-\u024f]"

    def __init__(self, path: str):
        import regex
        # A task has one core, and each thread would keep memory of its own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = self._letters(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        self.cut = regex.compile(self.CUT + r"|\n").findall
        strange = regex.compile(self.STRANGE)
        self.strange, self.strange_in = strange.finditer, strange.search
        added = self.whole.get_added_tokens_decoder().values()
        self.special = [token.content.encode() for token in added]
        self.special_in = regex.compile("|".join(regex.escape(token.content) for token in added) or "(?!)").search
        self.parts: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    @staticmethod
    def _letters(byte_level) -> dict[int, str]:
        """The letter by which the model knows each byte that a part can hold."""
        small = {chr(c).lower() for c in range(0x21, 0x250)}
        return {b: x for t in small for b, x in zip(t.encode(), byte_level.pre_tokenize_str(t)[0][0], strict=True)}

    def _learn_parts(self, parts: Iterable[str]) -> None:
        """The model's ids of each part, whose bytes it knows by letters of its own."""
        tokenize, letters, known = self.model.tokenize, self.letters, self.parts
        for part in parts:
            found = tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(letters))
            known[part] = array("I", [token.id for token in found]).tobytes()

    def _odd(self, words: list[bytes], text: str) -> set[int]:
        """Places of words that cannot be cut here. text: the words, a line each."""
        odd = {text.count("\n", 0, m.start()) for m in self.strange(text)} if self.strange_in(text) else set()
        if self.special_in(text):
            odd.update(k for k, w in enumerate(words) if any(s in w for s in self.special))
        return odd

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of words that are not remembered."""
        text = b"\n".join(words).decode(errors="replace")
        odd = self._odd(words, text)
        if not odd:
            return self._cut_ids(text)
        plain = [w for k, w in enumerate(words) if k not in odd]
        found = dict(zip(plain, self._cut_ids(b"\n".join(plain).decode()) if plain else [], strict=True))
        rest = [words[k] for k in sorted(odd)]
        for start in range(0, len(rest), WHOLE_WORDS):
            some = rest[start : start + WHOLE_WORDS]
            encoded = self.whole.encode_batch_fast([w.decode(errors="replace") for w in some], add_special_tokens=False)
            found.update((w, array("I", e.ids).tobytes()) for w, e in zip(some, encoded, strict=True))
        return [found[w] for w in words]

    def _cut_ids(self, text: str) -> list[bytes]:
        """The ids of each line of a text, which is a word that can be cut here."""
        parts = self.cut(text.lower())
        unique = {*parts, "\n"}
        missing = unique - self.parts.keys()
        if len(self.parts) + len(missing) > KNOWN_PARTS:
            self.parts.clear()
            missing = unique
        missing.discard("\n")
        self._learn_parts(missing)
        self.parts["\n"] = b""
        ids = list(map(self.parts.__getitem__, parts))
        ends = list(accumulate(map(len, ids), initial=0))
        lines = [ends[k] for k, part in enumerate(parts) if part == "\n"]
        data = b"".join(ids)
        return [data[a:b] for a, b in zip([0, *lines], [*lines, len(data)], strict=True)]

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; no word twice."""
        known = self.words
        ids = list(map(known.get, words))
        new = [k for k, v in enumerate(ids) if v is None]
        for start in range(0, len(new), NEW_WORDS):
            some = new[start : start + NEW_WORDS]
            for k, own in zip(some, self._learn([words[k] for k in some]), strict=True):
                ids[k] = own
        fresh = ((words[k], ids[k]) for k in new if len(words[k]) <= KNOWN_BYTES)
        if len(known) + len(new) > KNOWN_WORDS:
            # Those met again now are the ones worth keeping, then the new ones, then the others.
            again = {w: v for w, v in zip(words, ids, strict=True) if w in known}
            others = ((w, v) for w, v in known.items() if w not in again)
            again.update(islice(chain(fresh, others), max(KNOWN_WORDS - len(again), 0)))
            self.words = again
        else:
            known.update(fresh)
        return ids

    def encode(self, texts: list[bytes], end: int) -> Iterator[np.ndarray]:
        """The ids of each text, then `end`. Words are cut, and ids put together, for some texts at
        a time; each word of all texts is looked up once."""
        special = [*(name.lower() for name in self.special), b"\xcc", b"\xcd"]
        cut, bounds = [], []
        for first, last in in_chunks(texts, CUT_BYTES):
            # Lower case, but names of special tokens must stay, and letters that may join the marks after
            # them (U+0300 to U+037F): some do in lower case only.
            small = (t if any(s in b for s in special) else b for t, b in ((t, t.lower()) for t in texts[first:last]))
            words, edges = cut_words(list(small))
            cut.append(words)
            bounds.append(edges)
        coded = pa.chunked_array(cut, pa.large_binary()).dictionary_encode()
        del cut
        table = pa.array(self.ids_of(binaries(coded.chunk(0).dictionary) if bounds else []), pa.large_binary())
        stop = np.array([end], np.uint32)
        for words, edges in zip(coded.iterchunks(), bounds, strict=True):
            _, places, data = table.take(words.indices).buffers()
            ends = np.frombuffer(places, np.int64)[edges] // 4 if len(words) else np.zeros(len(edges), np.int64)
            tokens = np.frombuffer(data or b"", np.uint32)
            for a, b in pairwise(ends.tolist()):
                yield np.concatenate([tokens[a:b], stop])


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, of k, for each size: the multiway differencing of Karmarkar and Karp.

    Partial partitions hold k sums. The two that are least even merge, the largest sum of one
    with the smallest of the other, until one is left. Ties: the earlier partition first."""
    heap, made = [], []
    for i, size in enumerate(sizes.tolist()):
        sums = np.zeros(k, np.int64)
        sums[0] = size
        heap.append((-size if k > 1 else 0, i, sums))
        made.append(None)
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = left + right[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        made.append((a, b, order))
        heapq.heappush(heap, (int(sums[-1] - sums[0]), len(made) - 1, sums))
    window = np.zeros(len(sizes), np.int64)
    if heap:
        open_parts = [(heap[0][1], np.arange(k))]
        while open_parts:
            node, target = open_parts.pop()
            if made[node] is None:
                window[node] = target[0]
                continue
            a, b, order = made[node]
            place = np.empty(k, np.int64)
            place[order] = target
            open_parts += [(a, place), (b, place[::-1])]
    return window


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of at most `capacity`, near equal and as few as differencing can fill."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differencing(sizes, k)
        if np.bincount(found, sizes, k).max(initial=0) <= capacity:
            return found
        k += 1


def pieces_of(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n tokens: full sequences, then pieces."""
    full = n - n % capacity
    starts = [*range(0, full, capacity), *range(full, n, piece)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def pack(
    docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = 2048,
    piece: int = PIECE, together: int = WINDOWS,
) -> DataFrame:
    """All documents (doc_id, text) in sequences of at most `capacity` tokens, a row a piece.

    A document is the ids of its text (null: none), then `end`. It is cut into full sequences;
    the rest, in pieces of at most `piece` tokens, goes to windows by multiway differencing,
    `together` windows at a time, one window more whenever one holds too much. Result: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset; the pieces of a sequence follow
    each other from offset 0. Repeated rows and rows without an id are documents like others;
    an empty table gives no rows.

    Documents are packed where they are read: no shuffle, and a task holds the ids of
    `together` windows and of a few texts. A sequence's id is its input partition and number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with kept_by_worker(f"tokens:{tokenizer}", lambda: WordTokens(tokenizer)) as encoder:
            yield from packed(encoder, batches)

    def packed(encoder: WordTokens, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 40
        held: list[list] = []
        tokens = 0

        def emit(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        def close() -> list[list]:
            nonlocal next_id, held, tokens
            found = windows(np.array([row[2] for row in held], np.int64), capacity)
            offsets: dict[int, int] = {}
            for row, window in zip(held, found.tolist(), strict=True):
                row += [next_id + window, offsets.get(window, 0)]
                offsets[window] = row[6] + row[2]
            next_id += int(found.max(initial=-1)) + 1
            rows, held, tokens = held, [], 0
            return rows

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in text_chunks(batch.column(1), TEXT_BYTES):
                rows = []
                for doc_id, own in zip(ids[first : first + len(texts)], encoder.encode(texts, end), strict=True):
                    data = own.astype("<u4").tobytes()
                    for start, length in pieces_of(len(own), capacity, piece):
                        crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                        row = [doc_id, start, length, crc, len(own)]
                        if length == capacity:
                            rows.append([*row, next_id, 0])
                            next_id += 1
                            continue
                        held.append(row)
                        tokens += length
                        if tokens >= together * (capacity - SLACK) - piece:
                            rows += close()
                del texts
                give_back()
                if rows:
                    yield emit(rows)
        if held:
            yield emit(close())

    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return named.mapInArrow(tidied(run), PIECES)
