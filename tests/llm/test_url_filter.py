import re

from voxtab.llm import url_filter as U


def rows(spark, urls, rules=U.RULES, **more):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    found = U.filter_urls(df, rules, **more).orderBy("page_id").collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in found]


def test_rules(spark):
    urls = [
        "https://Shop.COM/x?y#z", "http://a.example.com/en/1", "http://www.example.com/en/1",
        "http://m.www.example.com/en/", "http://example.com/En/", "x://t.net/es/", "x://net/fr/",
        "http://b.net/es", "http://spam-farm.example.org/en/", "http://notcom/", "http://a.com",
        None, "", "no scheme", "a://b://c/d", "http://?q", "http://x.org:80/p#f", "http://\u00c9.net/fr/\u00e9",
    ]
    assert rows(spark, urls) == [
        ("shop.com", "/x", "com/", "allow"), ("a.example.com", "/en/1", "example.com/en/", "block"),
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("example.com", "/En/", "com/", "allow"), ("t.net", "/es/", "net/es/", "block"),
        ("net", "/fr/", "net/fr/", "block"), ("b.net", "/es", None, "allow"),
        ("spam-farm.example.org", "/en/", None, "block"), ("notcom", "/", None, "allow"),
        ("a.com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("", "", None, "allow"),
        ("x.org:80", "/p", None, "allow"), ("\u00c9.net", "/fr/\u00e9", "net/fr/", "block"),
    ]


def test_tokens_must_be_whole():
    assert U.index_tokens("||example.com/en/") == ["com", "en", "example"]
    assert U.index_tokens("||example.com/e") == ["com", "example"]
    assert U.index_tokens("*ads*") == []
    assert U.index_tokens("ads.js^") == ["js"]
    assert re.search(U.expression("/a*z^"), "x.y/abcz")


def test_rules_without_tokens_and_ties(spark):
    rules = (
        U.Rule("*ads*", U.BLOCK, "ads", 1), U.Rule("||ads.net^", U.ALLOW, "net", 1),
        U.Rule("||zzz.org/", U.BLOCK, "b", 2), U.Rule("||zzz.org/*", U.BLOCK, "c", 2),
    )
    found = rows(spark, ["http://ads.net/", "http://a.b/", "http://zzz.org/"], rules, default="none")
    assert [(f[2], f[3]) for f in found] == [("ads", "block"), (None, "none"), ("b", "block")]


def test_repeats_extra_columns_empty(spark):
    df = spark.createDataFrame(
        [(1, "http://a.com/", "h"), (1, "http://a.com/", "h"), (None, None, None)],
        "page_id long, url string, host string",
    )
    found = U.filter_urls(df)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted(map(str, found.select("page_id", "host").collect())) == sorted(
        ["Row(page_id=1, host='a.com')"] * 2 + ["Row(page_id=None, host='')"]
    )
    assert U.filter_urls(df.limit(0)).count() == 0
    long = "http://a.net/es/" + "x" * 300_000
    assert rows(spark, [long])[0][2] == "net/es/"


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = U.filter_urls(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_of_any_name_stay(spark):
    names = ("best", "found", "asked", "regex", "token", "rule_verdict")
    df = spark.createDataFrame([(1, "http://a.example.com/en/x")], "page_id long, url string")
    df = df.withColumns({n: df.page_id for n in names})
    row = U.filter_urls(df).first()
    assert [row[n] for n in names] == [1] * len(names)
    assert (row.rule, row.verdict) == ("example.com/en/", "block")


def test_rules_from_a_table_are_the_same(spark):
    patterns = [
        "||example.com/en/", "||ads-", "||*-ads.", "ads.js^", "*ads*", "/a*z^", "||a.b^c", "x(y)[z]{1}+?$|\\", "||é.net/", "/é/",
        "||Shop.COM/A", "a b", "||", "",
    ]
    urls = [
        "http://m.example.com/en/1", "http://ads-x.net/", "http://my-ads.org/", "http://a/ads.js", "http://a/Ads.js?x", "http://q/abcz/",
        "http://a.b/c", "http://k/x(y)[z]{1}+", "http://k/x(y)[z]{1}+?$|", "http://é.net/é/", "http://shop.com/A", "http://shop.com/a", "http://z/a b",
    ]
    table = U.rule_table(spark.createDataFrame([(p, U.BLOCK, p, 1) for p in patterns], "pattern string, verdict string, rule string, rank int"))
    found = {r.pattern: r for r in table.collect()}
    assert set(found) == set(patterns)
    for p in patterns:
        assert sorted(found[p].tokens) == U.index_tokens(p), p
    parts = rows(spark, urls, tuple(U.Rule(p, U.BLOCK, p, k) for k, p in enumerate(patterns)), default="none")
    for host, path, rule, _ in parts:
        hits = [p for p in patterns if re.search(U.expression(p), host + path)]
        assert rule == hits[-1], (host, path)


def test_a_hundred_thousand_rules(spark):
    rules = spark.range(100_000).selectExpr(
        "concat('||h', id % 40000, '.site', id % 977, '.com/p', id % 13, if(id % 3 = 0, '*', '/')) as pattern",
        "if(id % 2 = 0, 'block', 'allow') as verdict", "cast(id as string) as rule", "id as rank",
    )
    wanted = list(range(0, 100_000, 331))
    urls = [f"http://m.h{i % 40000}.site{i % 977}.com/p{i % 13}/x{i}" for i in wanted] + ["http://h1.site2.com/", "http://other.org/p1/"]
    found = rows(spark, urls, rules)
    assert [int(f[2]) for f in found[: len(wanted)]] == wanted
    assert [f[2:] for f in found[len(wanted) :]] == [(None, "allow")] * 2
    parts = spark.createDataFrame([(f[0], f[1]) for f in found], "host string, path string").distinct()
    assert U.candidates(parts, U.rule_table(rules)).count() < 8 * len(urls)


def test_the_patterns_decide_where_no_rule_does(spark):
    urls = [
        "http://ads-track.example.net/en/1", "http://www.cheap-pills.example.org/de/", "http://my-casino.example.net/en/",
        "http://a.example.org/banner/x.html", "http://adsorb.example.org/en/", "http://example.org/roads/1", "http://ads.example.com/x",
    ]
    assert [f[2:] for f in rows(spark, urls)] == [(None, "block")] * 4 + [(None, "allow")] * 2 + [("com/", "allow")]
