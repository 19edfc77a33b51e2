import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxtab.llm import packing as P
from voxtab.llm.common import kept_by_worker

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "It's we'LL they'd 'S", "ΑΣ Σ", "İstanbul", "a<|endoftext|>b <|startoftext|>", "x<|ENDOFTEXT|>",
    "é ́ café", "1234 ½²³ ª", "a b c　d", "日本語 テ", "x" * 500, "\x01\x1c\x85 a",
    "\U0001f600\U0001f600 ok", "don't''s", "ǅ ŉ ẞ ß", "­​", "$$$%%% --- a.b.c", "one two " * 5000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_like_the_library(tokenizer):
    words = P.WordTokens(PATH)
    found = words.encode([t.encode() for t in ODD], 1)
    for text, ids in zip(ODD, found, strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_differencing_is_even():
    rng = random.Random(2)
    sizes = np.array([rng.randint(1, 256) for _ in range(500)])
    found = P.differencing(sizes, 16)
    sums = np.bincount(found, sizes, 16)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 3
    assert P.differencing(np.array([5, 5, 4, 3, 3]), 1).tolist() == [0] * 5
    assert len(set(P.differencing(np.array([7, 7]), 2))) == 2


def test_windows_rise_until_they_hold():
    sizes = np.array([60] * 5)
    found = P.windows(sizes, 100)
    assert np.bincount(found, sizes).max() <= 100 and found.max() == 4
    assert P.windows(np.zeros(0, np.int64), 100).tolist() == []


def test_whole_texts_in_gapless_sequences(spark, tokenizer):
    rng = random.Random(4)
    texts = [*ODD, None] + [" ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(1, 2500))) for _ in range(150)]
    rows = [(None if i == 3 else i, t, i) for i, t in enumerate(texts)] + [(5, texts[5], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset long").repartition(2)
    pieces = P.pack(df, PATH).collect()
    ids = {i: (tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in rows}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        own = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert (p.ids_crc32, p.doc_tokens) == (zlib.crc32(own.tobytes()), len(ids[p.doc_id]))
    for doc_id, own in by_doc.items():
        copies = 2 if doc_id == 5 else 1
        assert sum(p.length for p in own) == copies * len(ids[doc_id])
        assert len({(p.start) for p in own}) * copies == len(own)
    used = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        used += at
    assert used / (2048 * len(by_sequence)) > 0.97
    assert P.pack(df.limit(0), PATH).count() == 0


def plain_differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Lists of (sum, members) in full, merged one with another until one is left."""
    parts = [(i, [(s, [i]), *[(0, [])] * (k - 1)]) for i, s in enumerate(sizes)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[1][0][0] - p[1][-1][0]), p[0]))
        (_, a), (_, b), *parts = parts
        both = [(x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b), strict=True)]
        parts.append((made, sorted(both, key=lambda w: -w[0])))
        made += 1
    return [sorted(members) for _, members in parts[0][1]]


def test_differencing_is_karmarkar_and_karps():
    rng = random.Random(9)
    for _ in range(200):
        sizes = [rng.randint(1, 300) for _ in range(rng.randint(1, 40))]
        k = rng.randint(2, 6)
        found = P.differencing(np.array(sizes), k)
        groups = sorted(np.flatnonzero(found == w).tolist() for w in range(k))
        assert groups == sorted(plain_differencing(sizes, k))


def test_what_a_worker_remembers_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(P, "KNOWN_WORDS", 40)
    monkeypatch.setattr(P, "KNOWN_PARTS", 30)
    monkeypatch.setattr(P, "NEW_WORDS", 7)
    rng, words = random.Random(4), P.WordTokens(PATH)
    for _ in range(30):
        texts = [" ".join(rng.choice(["the", "It's", "naïve", "Ünï", "x", "日本"]) + str(rng.randint(0, 60)) for _ in range(50)) for _ in range(3)]
        found = words.encode([t.encode() for t in texts], 1)
        assert [f.tolist() for f in found] == [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert len(words.words) <= 40


def test_workers_let_go_of_what_they_do_not_use():
    made = []
    make = lambda: made.append(0) or [len(made)]
    for _ in range(3):
        with kept_by_worker("test", make, idle=0.3) as kept:
            assert kept == [1]
    with kept_by_worker("test", make, idle=0.3) as kept:
        time.sleep(0.6)  # in use: a task may take long
        with kept_by_worker("test", make, idle=0.3) as again:
            assert again == [1]
    time.sleep(1.0)
    with kept_by_worker("test", make, idle=0.3) as kept:
        assert kept == [2]


def test_encoding_takes_little_memory_beside_the_texts(tokenizer):
    words, text = P.WordTokens(PATH), "It's one of the ten words that come again, naïve. "
    texts = [(text * 500).encode()] * 300
    size = sum(map(len, texts))
    tracemalloc.start()
    try:
        n = sum(len(own) for own in words.encode(texts, 1))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 300 * (len(tokenizer.encode(text * 500, add_special_tokens=False).ids) + 1)
    assert peak < 6 * size


def test_chunks_hold_all_texts_in_order():
    column = pa.array(["", None, "é" * 30, "a" * 100, "", "b", None, "c" * 9, ""])
    for size in (1, 10, 60, 1000):
        found = list(P.text_chunks(column, size))
        assert [t for _, texts in found for t in texts] == [(v or "").encode() for v in column.to_pylist()]
        assert [first for first, _ in found] == np.cumsum([0, *(len(t) for _, t in found)])[:-1].tolist()
        assert all(sum(map(len, texts[:-1])) <= size for _, texts in found)
    assert list(P.text_chunks(column[:0], 10)) == []
    assert [t for _, texts in P.text_chunks(column.slice(2, 3), 10) for t in texts] == ["é".encode() * 30, b"a" * 100, b""]


def test_every_character_that_is_cut_here(tokenizer):
    words = P.WordTokens(PATH)
    texts = [" ".join(f"a{chr(c)}b {chr(c)}{chr(c)} x{chr(c).upper()}" for c in range(k, k + 50)) for k in range(0x21, 0x260, 50)]
    for _ in range(2):
        found = words.encode([t.encode() for t in texts], 1)
        for text, ids in zip(texts, found, strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_odd_words_among_others_keep_their_places(tokenizer):
    texts = ["日本 plain été", "été 語", "plain <|endoftext|>x", "", "plain"]
    found = P.WordTokens(PATH).encode([t.encode() for t in texts], 1)
    for text, ids in zip(texts, found, strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_parts_do_not_call_the_library_for_letters(monkeypatch):
    from tokenizers import pre_tokenizers

    class Counting:
        calls = 0

        def __init__(self, **options):
            self.own = own(**options)

        def pre_tokenize_str(self, text):
            Counting.calls += 1
            return self.own.pre_tokenize_str(text)

    own = pre_tokenizers.ByteLevel
    monkeypatch.setattr(pre_tokenizers, "ByteLevel", Counting)
    words = P.WordTokens(PATH)
    before = Counting.calls
    some = " ".join(f"é{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd")
    list(words.encode([some.encode()], 1))
    assert Counting.calls == before


def test_ids_are_put_together_without_tables_of_places():
    words = P.WordTokens(PATH)
    texts = [b"word of many words " * 20_000]
    list(words.encode(texts, 1))
    tracemalloc.start()
    found = next(words.encode(texts, 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(found)
