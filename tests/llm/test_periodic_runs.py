import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from voxtab.llm import periodic_runs as P
from voxtab.llm.common import table
from voxtab.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """Every distance tried on every place."""
    x = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.zeros(0)
    found = {}
    for q in range(1, len(x) // 2 + 1):
        same = np.concatenate([[0], (x[:-q] == x[q:]).astype(np.int8), [0]])
        for a, b in np.flatnonzero(np.diff(same)).reshape(-1, 2).tolist():
            if b - a + q >= max(12, 2 * q):
                found.setdefault((a, b + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    names = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    codes = np.array([names[w] for t in texts for w in t], np.int64)
    rows = P.find_runs(codes, np.cumsum([0, *map(len, texts)]))
    return [[tuple(r[1:]) for r in rows.tolist() if r[0] == k] for k in range(len(texts))]


def odd_text(rng: random.Random) -> list[int]:
    """Few different words, planted repeats, powers of powers."""
    kind, n = rng.random(), rng.randint(0, 240)
    if kind < 0.2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind < 0.4:
        unit, x = [rng.randrange(2) for _ in range(rng.randint(1, 6))], []
        while len(x) < n:
            x += unit * rng.randint(1, 9) + [rng.randrange(3)] * rng.randint(0, 2)
        return x[:n]
    x = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        for i in range(a, a + rng.randint(0, n - a)):
            x[i] = x[a + (i - a) % p]
    return x


def test_same_as_every_distance_tried():
    rng = random.Random(3)
    for _ in range(150):
        texts = [odd_text(rng) for _ in range(rng.randint(1, 6))]
        texts += [list(texts[0])] * rng.randint(0, 2)
        assert runs_of(texts) == [plain_runs(t) for t in texts]


def test_a_long_run_of_a_short_period_costs_its_length():
    words = [0, 1, 2] * 40_000
    (found,) = runs_of([words])
    assert found == [(0, 120_000, 3)]


def test_a_period_of_a_third_of_a_long_text():
    unit = list(range(30_000))
    (found,) = runs_of([[-1, *unit, *unit, *unit[:7], -2]])
    assert found == [(1, 60_007, 30_000)]


def test_agreeing_sums_are_caught():
    x = np.array([90, 1, 2, 3, 91] * 2 + [92] + [5, 6] * 8 + [93])
    wrong = np.array([[1, 9, 4]])
    assert P.exact(x, wrong).tolist() == P.lag_scan(x, 4).tolist()
    right = np.array([[11, 27, 2]])
    assert P.exact(x, right).tolist() == right.tolist()


@pytest.mark.parametrize("name", ["doc_id", "__n", "start"])
def test_odd_rows(spark, name):
    again = "a b c " * 5
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (None, again, "x"), (4, again, "y"), (4, again, "y"), (5, "word " * 11, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    if name != "doc_id":
        docs = docs.withColumnRenamed("extra", name)
    docs = docs.withColumn("runs", docs.doc_id)
    found = P.periodic_runs(docs).collect()
    assert len(found) == len(rows)
    by_text = {(r["text"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in found}
    assert (again, ((0, 15, 3),), "a b c") in by_text
    assert {t for t in by_text if not t[1]} == {(None, (), ""), ("", (), ""), (" \t\n", (), ""), ("word " * 11, (), " ".join(["word"] * 11))}
    assert P.periodic_runs(docs.limit(0)).collect() == []


def planted(doc_id, words: list[str]) -> list[str]:
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_against_the_plain_rule(spark):
    sf = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for doc_id, text in docs:
        words = planted(doc_id, WORDS.findall(text or ""))
        runs = plain_runs(words)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        best = min(((-n, a, q) for a, n, q in runs), default=None)
        row = found[doc_id]
        assert row["n_runs"] == len(runs)
        assert row["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        assert row["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        expected = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == expected
