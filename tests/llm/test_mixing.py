import numpy as np
import pytest

from voxtab.llm import mixing as M


def test_rake_reaches_all_marginals():
    rng = np.random.default_rng(1)
    cells = np.array([(a, b, c) for a in range(4) for b in range(3) for c in range(2)])
    tokens = rng.integers(1, 1000, len(cells)).astype(float)
    targets = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.25, 0.25]), np.array([0.7, 0.3])]
    factors, _ = M.rake(cells, tokens, targets)
    weights = tokens * np.prod([f[cells[:, k]] for k, f in enumerate(factors)], axis=0)
    for k, target in enumerate(targets):
        assert np.allclose(np.bincount(cells[:, k], weights) / weights.sum(), target, atol=1e-6)


def test_rake_leaves_out_what_is_not_there():
    factors, wanted = M.rake(np.array([[0, 0], [1, 0]]), np.array([10.0, 30.0]), [np.array([0.5, 0.25, 0.25]), np.array([1.0])])
    assert np.allclose(wanted[0], [2 / 3, 1 / 3, 0])
    assert M.rake(np.zeros((0, 1), int), np.zeros(0), [np.array([1.0])])[0][0].tolist() == [1.0]


def test_scale_gives_the_budget():
    rng = np.random.default_rng(2)
    weights, tokens = rng.random(50) * 5, rng.integers(1, 100, 50).astype(float)
    for share in (0.1, 0.5, 0.9):
        k = M.scale_for(weights, tokens, share * tokens.sum())
        assert np.isclose((tokens * np.minimum(1, k * weights)).sum(), share * tokens.sum())
    assert (M.scale_for(weights, tokens, 2 * tokens.sum()) * weights >= 1 - 1e-9).all()
    assert M.scale_for(np.zeros(0), np.zeros(0), 0.0) == 1.0


def rows(n):
    return [(i, f"w{i} " * (20 + i % 30), "en" if i % 3 else "fr", "a" if i % 4 else "b") for i in range(n)]


def test_sampled_tokens_follow_targets(spark):
    df = spark.createDataFrame(rows(4000), "doc_id long, text string, lang string, source string")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "fr": 0.5}}
    out = M.mix(df, targets, budget=0.3).collect()
    total = sum(r.tokens for r in out)
    assert all(r.tokens == 20 + r.doc_id % 30 for r in out)
    expected = lambda pick: sum(r.tokens * r.probability for r in out if pick(r))
    assert expected(lambda r: True) == pytest.approx(0.3 * total)
    assert expected(lambda r: r.source == "a") == pytest.approx(0.15 * total, rel=1e-6)
    assert expected(lambda r: r.lang == "fr") == pytest.approx(0.15 * total, rel=1e-6)
    drawn = sum(r.tokens for r in out if r.sampled)
    assert drawn == pytest.approx(0.3 * total, rel=0.1)


def test_odd_rows(spark):
    odd = [(1, None, None, None), (1, "", "en", "a"), (None, "a b", "en", "a"), (2, "x\x0by", "en", "a"), (2, "x\x0by", "en", "a")]
    df = spark.createDataFrame([(*r, "t") for r in odd], "doc_id long, text string, lang string, source string, topic string")
    out = M.mix(df, budget=1.0)
    assert out.columns[:4] == ["doc_id", "text", "lang", "source"]
    found = out.collect()
    assert sorted(r.tokens for r in found) == [0, 0, 2, 2, 2]
    assert all(r.sampled for r in found if r.tokens)
    assert M.mix(df.limit(0)).count() == 0
    assert out.drop("tokens").select("doc_id").count() == 5


def test_plain_sources_without_language(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert M.mix(df).count() == 1


def test_large_unnamed_categories_get_the_rest(spark):
    lang = ["en", "de", "de", "fr", "en", "en", "it", "en", "en", "en"]
    data = [(i, f"w{i} " * 20, lang[i % 10], "a" if i % 3 else "b") for i in range(2000)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    for given in ({"en": 0.3, "(other)": 0.7}, {"en": 0.3}):
        out = M.mix(df, {"lang": given}, budget=0.2).collect()
        expected = {n: sum(r.tokens * r.probability for r in out if r.lang == n) for n in set(lang)}
        whole = sum(expected.values())
        assert expected["en"] / whole == pytest.approx(0.3, rel=1e-6)
        # Within the rest, categories keep their proportions: de 2, fr 1, it 1.
        assert expected["de"] / whole == pytest.approx(0.35, rel=1e-2)
        assert expected["fr"] / whole == pytest.approx(0.175, rel=1e-2)


def test_small_categories_have_targets_of_their_own(spark, monkeypatch):
    """600 sources of 0.05 % each beside a hot one, twenty small languages; on the driver and on
    Spark."""
    data = [
        (i, f"w{i} " * (10 + i % 7), "en" if i // 600 % 2 else f"l{(i + i // 600) % 20}", f"s{i % 600}" if i % 3 else "hot")
        for i in range(6000)
    ]
    # A cell without tokens of which each category has some elsewhere.
    data += [(6000, "only words", "l1", "s1"), (6001, "", "en", "hot"), (6002, "", "en", "hot")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    found = {}
    for held in (M.HELD_CELLS, 0):
        monkeypatch.setattr(M, "HELD_CELLS", held)
        monkeypatch.setattr(M, "ROUNDS", 12)
        monkeypatch.setattr(M.rake, "__defaults__", (12, M.TOLERANCE))
        found[held] = sorted(M.mix(df, {"lang": {"en": 0.7}}, budget=0.05).collect(), key=lambda r: r.doc_id)
    own, other = found.values()
    assert all(a.weight == pytest.approx(b.weight, rel=1e-6) for a, b in zip(own, other, strict=True))
    assert all(a.probability == pytest.approx(b.probability, rel=1e-6) for a, b in zip(own, other, strict=True))
    assert all(r.probability > 0 for r in own)
    tokens, expected = {}, {}
    for r in own:
        tokens[r.source] = tokens.get(r.source, 0) + r.tokens
        expected[r.source] = expected.get(r.source, 0) + r.tokens * r.weight
    powers = {n: v**M.TEMPER for n, v in tokens.items()}
    for n in tokens:
        assert expected[n] / sum(expected.values()) == pytest.approx(powers[n] / sum(powers.values()), rel=1e-2)


def test_rake_is_plain_proportional_fitting():
    rng = np.random.default_rng(4)
    names = [["a", "b", "c"], ["x", "y"], ["p", "q", "r", "s"]]
    table = {(i, j, k): float(rng.integers(1, 500)) for i in range(3) for j in range(2) for k in range(4) if rng.random() < 0.9}
    targets = [rng.dirichlet(np.ones(len(n))) for n in names]
    weights = dict(table)
    for _ in range(400):
        for d, target in enumerate(targets):
            for name, wanted in enumerate(target):
                mine = [c for c in weights if c[d] == name]
                total, reached = sum(weights.values()), sum(weights[c] for c in mine)
                for c in mine:
                    weights[c] *= wanted * total / reached
    cells = np.array(list(table))
    factors, _ = M.rake(cells, np.array(list(table.values())), targets)
    raked = np.array(list(table.values())) * np.prod([f[cells[:, k]] for k, f in enumerate(factors)], axis=0)
    plain = np.array([weights[c] for c in table])
    assert np.allclose(raked / raked.sum(), plain / plain.sum(), atol=1e-5)
