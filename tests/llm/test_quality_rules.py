import random
import re
from collections import Counter

from voxtab.llm import quality_rules as Q

WORD = "[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = Counter(x for x in text.split("\n") if re.search(WORD, x))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(n - 1 for n in lines.values()), len(covered))


def texts():
    rng = random.Random(1)
    some = [None, "", " \n\t", "a", "a a a a", "é#ü | x y", "x y z\nx y z\n\nx y z ", "a b c a b c a b"]
    return some + [
        "".join(rng.choice(["a", "b", "cc", "é", " ", " ", "\n", "\x0b", "|", "<"]) for _ in range(rng.randint(0, 300)))
        for _ in range(150)
    ] + ["word " * 200_000]


def test_counts_like_brute_force(spark):
    all_texts = texts()
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(all_texts)], "doc_id long, text string, source string")
    found = {r.doc_id: r for r in Q.judge(df).collect()}
    for i, text in enumerate(all_texts):
        r, want = found[i], brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and (r.kept or failed)
    assert Q.judge(df.limit(0)).count() == 0


def test_furniture_goes_and_depleted_texts_with_it(spark):
    menu = " ".join(f"menu{i}" for i in range(40))
    own = lambda i, n: " ".join(f"own{i}x{j}" for j in range(n))
    rows = [(i, "h", f"{own(i, 30)}\n{menu.upper()} {i % 10}") for i in range(40)]
    rows += [(100, "h", f"{own(100, 90)}\n{menu} 7"), (101, "other", f"{own(101, 30)}\n{menu} 7")]
    rows += [(None, "h", rows[5][2]), (5, "h", rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    # More than 20 texts: the lines of own words, alike but for their digits, are in ten and 30.
    judged = Q.judge(df, Q.Limits(documents=21))
    found = {(r.doc_id, r.host): r for r in judged.collect()}
    assert found[0, "h"].kept and found[0, "h"].n_removed_words == 0  # the first to have the line
    assert not found[1, "h"].kept and found[1, "h"].n_removed_words == 41
    assert not found[5, "h"].kept and not found[None, "h"].kept
    assert found[100, "h"].kept and found[100, "h"].n_removed_words == 41
    assert found[101, "other"].kept and found[101, "other"].n_removed_words == 0
    texts = {r.doc_id: r.text for r in Q.clean(df, judged).collect()}
    assert texts == {0: rows[0][2], 100: own(100, 90), 101: rows[41][2]}


def test_large_codes():
    import numpy as np
    codes = np.arange(1 << 21)
    codes[-3:] = codes[:3]
    assert Q.repeated_words(codes) == 6


def test_limits_go_with_the_host(spark):
    line = "one two three four five six seven"
    letters = str.maketrans("0123456789", "abcdefghij")  # digits are all alike to the rule
    other = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n)).translate(letters)
    small = [(i, "small", f"{other(i, 60)}\n{line}" if i < 3 else other(i, 60)) for i in range(30)]
    large = [(100 + i, "large", f"{other(i, 60)}\n{line}" if i < 5 else other(i, 60)) for i in range(600)]
    judged = Q.judge(spark.createDataFrame(small + large, "doc_id long, source string, text string"))
    removed = {r.doc_id for r in judged.where("n_removed_words > 0").collect()}
    assert removed == {1, 2}
    limits = Q.Limits(many=4)
    judged = Q.judge(spark.createDataFrame(large, "doc_id long, source string, text string"), limits)
    assert {r.doc_id for r in judged.where("n_removed_words > 0").collect()} == {101, 102, 103, 104}


def test_clean_keeps_columns_of_any_name(spark):
    rows = [(i, "h", f"own{i}\nshared line", i) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, removed_lines long")
    limits = Q.Limits(words=0, documents=3, per_host=1.0, removed=100)
    cleaned = Q.clean(df, Q.judge(df, limits)).collect()
    assert {(r.doc_id, r.removed_lines) for r in cleaned} == {(i, i) for i in range(5)}
    assert sum("shared line" in r.text for r in cleaned) == 1
