import datetime
import os
import random
import re
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from voxtab.functions import repeats
from voxtab.functions import text as X


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", fn(F.col("v")).alias("x")).orderBy("k").collect()]


def random_texts(seed, n, alphabet, longest):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(n)]


SPACES = [" ", "\t", "\n", "\x1c", "\x85", " ", " ", "　"]


def test_whitespace_is_pythons(spark):
    texts = random_texts(1, 2000, ["a", "b.", "é", "​", *SPACES], 12)
    assert apply(spark, X.strip_text, texts) == [t.strip() for t in texts]
    assert apply(spark, X.word_count, texts) == [len(t.split()) for t in texts]


def test_whitespace_list_is_complete():
    assert set(X.WS_CHARS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_garbage_thresholds(spark):
    cases = {
        "": True,
        "a" * 49: True,
        "a" * 50: False,
        "a" * 50 + "." * 200: False,  # exactly one fifth
        "a" * 50 + "." * 201: True,
        "." * 1000 + "a" * 500: True,  # letters after the preview
        "ж1" * 30: False,
        "²½Ⅷ一" * 13: False,
    }
    assert apply(spark, X.is_garbage, list(cases)) == list(cases.values())
    assert apply(spark, X.is_garbage, [None]) == [None]


def test_garbage_against_character_counts(spark):
    texts = random_texts(2, 1500, ["a", "7", "é", "-", " ", "_", "!", "?"], 1300)

    def rule(text):
        head = text[:1000]
        good = len([c for c in head if c.isalnum()])
        return good < 50 or good / len(head) < 0.2

    assert apply(spark, X.is_garbage, texts) == [rule(t) for t in texts]


# The repeated phrase and the repeated word, as Python patterns.
PHRASE = re.compile(r"\b(\w+\s+\w+(?:\s+\w+){0,3})[.,;!?\s]*(\1)\b", re.I)
FOUR_WORDS = re.compile(r"\b(\w+)\s+\1\s+\1\s+\1+")


def phrase_rule(text):
    """Second copy of the leftmost repeated phrase goes, until none is left."""
    while hit := PHRASE.search(text):
        text = text[: hit.start(2)] + text[hit.end(2) :]
    return text


def test_repeated_phrases(spark):
    cases = {
        "the cat sat. the cat sat on": "the cat sat.  on",
        "I amI am here": "I am here",
        "in the in the house": "in the  house",
        "Good day, good day to you": "Good day,  to you",
        "word word": "word word",
        "i b, İ b": None,
        None: None,
    }
    got = apply(spark, X.remove_boundary_duplicates, list(cases))
    for (text, want), have in zip(cases.items(), got, strict=True):
        if want is not None:
            assert have == want, text
    assert got[-1] is None
    texts = random_texts(3, 4000, ["a", "b", "A", "ab", " ", " ", ".", ", ", "_", "\n"], 60)
    assert apply(spark, X.remove_boundary_duplicates, texts) == [phrase_rule(t) for t in texts]


def test_repeated_phrases_over_long_runs(spark):
    texts = ["one two three. " * 400, "tick tock " * 700, "a b c d e f " * 300]
    assert apply(spark, X.remove_boundary_duplicates, texts) == [phrase_rule(t) for t in texts]


def test_squash(spark):
    texts = random_texts(4, 5000, ["a", "a ", " ", "ab", "b ", "A", "."], 25)
    texts += ["a a a abc", "no no no no", "No no no no", "no no no nono no"]
    want = [FOUR_WORDS.sub(r"\1", t) for t in texts]
    assert apply(spark, X.squash_repeats, texts) == want
    assert want[-4:-2] == ["abc", "no"]


def test_guid_forms(spark):
    plain = str(uuid.UUID(int=7))
    cases = {
        plain: True,
        plain.upper(): True,
        "{" + plain + "}": True,
        "urn:uuid:" + plain: True,
        plain.replace("-", ""): True,
        "-" + plain: True,
        plain[:-1]: False,
        plain[:-1] + "g": False,
        plain + "\n": False,
        "": False,
        None: False,
    }
    assert apply(spark, X.is_valid_guid, list(cases)) == list(cases.values())


def test_file_extensions(spark):
    names = random_texts(5, 3000, ["a", ".", "/", "mp3", " ", "\n"], 8)
    assert apply(spark, X.file_ext, names) == [os.path.splitext(n)[1] for n in names]


def test_duration_text(spark):
    rng = random.Random(6)
    spans = [0, 59, 3599, 86399, 86400, 172800, -1, -86400, 10**9]
    spans += [rng.randint(-(10**6), 10**8) for _ in range(500)]
    want = [str(datetime.timedelta(seconds=s)) for s in spans]
    assert apply(spark, X.duration_text, spans, "bigint") == want


def test_repeats_across_texts_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_CHARS", 40)
    texts = random_texts(9, 400, ["in ", "the ", "of", "of ", ". ", "\u0130 ", "i ", "\u03a3", "\u03c3 "], 40)
    found = repeats.drop_second_copies(pa.array([*texts, None, ""])).to_pylist()
    assert found == [*map(phrase_rule, texts), None, ""]
    found = repeats.squash_words(pa.array([*texts, None, ""])).to_pylist()
    assert found == [*(FOUR_WORDS.sub(r"\1", t) for t in texts), None, ""]


def test_one_long_text_of_repeats():
    text = "over and over. " * 3000 + "no " * 3000
    assert repeats.drop_second_copies(pa.array([text])).to_pylist() == [phrase_rule(text)]
    assert repeats.squash_words(pa.array([text])).to_pylist() == [FOUR_WORDS.sub(r"\1", text)]
