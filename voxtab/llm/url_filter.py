"""URL filters: pattern rules found by their rarest literal token, then by regular expression.

A pattern is matched against host and path of a url:

    ||example.com/en/   from the start of the host or of one of its labels, then literally
    *                   any run of characters
    ^                   a separator (anything but letters, digits, _ - . %) or the end

Without `||` a pattern may match anywhere. A token is a run of letters and digits in lower
case; those of a pattern that touch neither `*` nor an open end must be tokens of every url
that it matches, so one of them can stand for the pattern in an index.
"""

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


class Rule(NamedTuple):
    """rule: the name to report, null for patterns that only give a verdict. rank: the greatest
    one wins, then `block`, then the smaller pattern."""

    pattern: str
    verdict: str
    rule: str | None
    rank: int


def host_rule(verdict: str, name: str) -> Rule:
    """A rule `host/path`: the host with all subdomains, the start of a path; longest wins."""
    return Rule("||" + name, verdict, name, len(name))


# The rules that the query reports.
HOST_RULES = (
    host_rule(ALLOW, "com/"),
    host_rule(BLOCK, "example.com/en/"),
    host_rule(ALLOW, "www.example.com/en/"),
    host_rule(BLOCK, "net/es/"),
    host_rule(BLOCK, "net/fr/"),
)
# For urls that no host rule fits. Words by which advertising, tracking, link farms,
# gambling, drug shops, pirated files and the like name their hosts and folders.
SHADY = """
ad ads adserver adservice adsystem adtrack adv advert adverts banner banners click clicks clicktrack counter
doorway track tracker trackers tracking telemetry pixel beacon popunder popup sponsor affiliate affiliates
linkfarm link-farm spam spamfarm spam-farm seo-links buy-links cheap cheap-pills pills pharmacy viagra cialis
replica casino casinos poker betting slots jackpot lottery roulette warez torrent torrents crack cracks keygen
serial-keys free-download porn xxx escort webcam payday loans
""".split()
# As a host's name or folder, whole or with more behind or before a hyphen.
FORMS = ("||{}.", "||{}-", "||*-{}.", "/{}/", "/{}-", "-{}/")
PATTERNS = tuple(Rule(form.format(word), BLOCK, None, 0) for word in SHADY for form in FORMS)
RULES = HOST_RULES + PATTERNS


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where there is no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def expression(pattern: str) -> str:
    """The regular expression of a pattern, for `host` + `path`."""
    anchored = pattern.startswith("||")
    body = pattern.removeprefix("||")
    meaning = {"*": ".*", "^": "(?:[^A-Za-z0-9_.%-]|$)"}
    start = r"(?s)^(?:[^/]*\.)?" if anchored else "(?s)"
    return start + "".join(meaning.get(c) or re.escape(c) for c in body)


def index_tokens(pattern: str) -> list[str]:
    """Tokens that each url matched by the pattern must have."""
    anchored = pattern.startswith("||")
    body = pattern.removeprefix("||")
    found = []
    for m in re.finditer("[A-Za-z0-9]+", body):
        before, after = body[: m.start()], body[m.end() :]
        if (before and before[-1] != "*" or not before and anchored) and after and after[0] != "*":
            found.append(m[0].translate(str.maketrans(UPPER, LOWER)))
    return sorted(set(found))


# What a pattern's signs mean in a regular expression, and the characters that have a
# meaning of their own there.
ANY, END_OF_NAME = ".*", "(?:[^A-Za-z0-9_.%-]|$)"
SPECIAL = r"([\x21-\x29\x2b-\x2f\x3a-\x40\x5b-\x5d\x60\x7b-\x7e\s])"


def rule_table(rules: DataFrame) -> DataFrame:
    """From pattern, verdict, rule, rank: a row for each rule, with its regular expression and
    `tokens`, which each url that it matches must have. As `expression` and `index_tokens`."""
    anchored = F.col("pattern").startswith("||")
    body = F.regexp_replace("pattern", r"^\|\|", "")
    regex = F.replace(
        F.replace(F.regexp_replace(body, SPECIAL, r"\\$1"), F.lit("^"), F.lit(END_OF_NAME)), F.lit("*"), F.lit(ANY)
    )
    # A word at the pattern's start is whole only where the pattern begins a name.
    word = r"[A-Za-z0-9]+(?=[^A-Za-z0-9*])"
    inside = F.regexp_extract_all(body, F.lit(f"(?<=[^A-Za-z0-9*]){word}"), F.lit(0))
    first = F.regexp_extract_all(body, F.lit(f"(?<![A-Za-z0-9*]){word}"), F.lit(0))
    tokens = F.transform(F.when(anchored, first).otherwise(inside), lower_ascii)
    return rules.select(
        "pattern", F.col("verdict").alias("rule_verdict"), F.col("rule").cast("string").alias("rule"),
        F.col("rank").cast("long").alias("rank"),
        F.concat(F.when(anchored, r"(?s)^(?:[^/]*\.)?").otherwise("(?s)"), regex).alias("regex"),
        F.array_distinct(tokens).alias("tokens"),
    ).where("pattern is not null and rule_verdict is not null").distinct()


RULE = ("pattern", "rule_verdict", "rule", "rank", "regex")


def candidates(urls: DataFrame, table: DataFrame) -> DataFrame:
    """Distinct urls (host, path) with each rule of the table that may match them: every rule stands
    under the one of its tokens that fewest urls have."""
    whole = F.concat("host", "path")
    tokens = F.array_distinct(F.split(lower_ascii(whole), "[^a-z0-9]+"))
    keyed = urls.select("host", "path", F.explode(tokens).alias("token"))
    listed = table.select(*RULE, F.explode("tokens").alias("token"))
    wanted = listed.select("token").distinct()
    counts = keyed.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    rare = F.min(F.struct(F.coalesce("urls", F.lit(0)), "token"))["token"].alias("token")
    index = listed.join(counts, "token", "left").groupBy(*RULE).agg(rare)
    return keyed.join(index, "token").drop("token")


def filter_urls(pages: DataFrame, rules: DataFrame | tuple[Rule, ...] = RULES, default: str = ALLOW) -> DataFrame:
    """The pages with `host`, `path`, `rule` and `verdict` of their urls.

    rules: a table of pattern, verdict (allow or block), rule (the name to report, or null) and
    rank, of any size, or a few in a tuple. The rule with the greatest rank decides; of equal
    ranks a blocking one, then the smaller pattern. Urls that no pattern matches, and null urls
    or those without `://` (host and path empty), get `default`. Repeated rows each get their
    verdict. Columns of the input with these four names give way; all others stay. Columns
    needed: url.

    Only distinct hosts and paths are judged. Their tokens meet the index, in which every rule
    stands under the token that fewest of them have; rules without a token meet all urls and
    pass through the driver, so use few of these. The join's sides are left to Spark: the rules
    are broadcast while they are small by its own limit. A url that half of all pages share is one
    row here, and the join back is one that Spark splits where it is skewed.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "pattern string, verdict string, rule string, rank long")
    host, path = url_parts(F.col("url").cast("string"))
    kept = pages.drop("host", "path", "rule", "verdict")
    parts = kept.withColumns({"host": host, "path": path})
    urls = parts.select("host", "path").distinct()
    table = rule_table(rules)
    found = candidates(urls, table.where(F.size("tokens") > 0))
    everywhere = table.where(F.size("tokens") == 0).select(*RULE).collect()
    if everywhere:
        literal = [F.struct(*[F.lit(r[n]).cast(table.schema[n].dataType).alias(n) for n in RULE]) for r in everywhere]
        found = found.unionByName(urls.select("host", "path", F.inline(F.array(*literal))))
    matched = found.where(F.expr("concat(host, path) rlike regex"))
    best = F.struct(
        -F.col("rank"), F.col("rule_verdict") != BLOCK, F.col("pattern")
    )
    judged = matched.groupBy("host", "path").agg(
        F.min_by(F.struct("rule", "rule_verdict"), best).alias("best")
    )
    # Names of the pages and of what was found are told apart by their tables.
    joined = parts.alias("asked").join(judged.alias("found"), ["host", "path"], "left")
    best = F.col("found.best")
    return joined.select(
        *[F.col(f"asked.`{c}`") for c in kept.columns], "host", "path", best["rule"].alias("rule"),
        F.coalesce(best["rule_verdict"], F.lit(default)).alias("verdict"),
    )
