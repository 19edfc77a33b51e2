"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Tokens are counted by source, language and topic, each category for itself however small it
is. Factors for each source, language and topic
are fitted in turn until the weighted tokens have the shares asked for in all three; a
document's weight is the product of its factors, and it is drawn with a probability in
proportion to that, cut at one, so that the expected tokens are those of the budget.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtab.llm.common import cut

OTHER = "(other)"
DIMENSIONS = ("source", "lang", "topic")
# Cells up to which they are raked on the driver (about 100 bytes each); more are raked on
# Spark, by the same steps.
HELD_CELLS = 100_000
ROUNDS, TOLERANCE = 500, 1e-10
# Without targets: shares to this power, so that large categories shrink and small ones grow.
TEMPER = 0.7
BUDGET = 0.8


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    """A topic by the form of a text, where there is no better column: tables, figures, short
    notes, prose."""
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(20 * digits > F.length(text), "figures")
        .when(F.length(text) < 500, "note")
        .otherwise("prose")
    )


def prepared(docs: DataFrame, topic: Column | None) -> DataFrame:
    """The documents with __tokens and their categories in __source, __lang and __topic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = {"__tokens": word_count(text), "__topic": topic if topic is not None else topic_of(text)}
    for name in ("source", "lang"):
        named[f"__{name}"] = F.col(name) if name in docs.columns else F.lit("")
    found = docs.withColumns(named)
    return found.withColumns({f"__{d}": F.coalesce(F.col(f"__{d}").cast("string"), F.lit("")) for d in DIMENSIONS})


def named(dimension: str, given: dict[str, float] | None) -> Column:
    """A document's category. Where a dimension has targets these alone name categories, and all
    else is the rest; where it has none, each category stays itself."""
    column = F.col(f"__{dimension}")
    if not given:
        return column
    names = sorted(set(given) - {OTHER})
    return F.when(column.isin(names), column).otherwise(OTHER) if names else F.lit(OTHER)


def rake(cells: np.ndarray, tokens: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE):
    """Factors, an array for each dimension, by which the tokens of cells get the target shares.

    cells: a row a cell, a column a dimension, numbers of categories. Targets of categories
    without tokens are spread over the others. Targets that contradict each other in the cells
    there are end as near as the last round comes."""
    sums = [np.bincount(cells[:, d], tokens, len(t)) for d, t in enumerate(targets)]
    wanted = []
    for own, target in zip(sums, targets, strict=True):
        target = np.where(own > 0, target, 0.0)
        wanted.append(target / target.sum() if target.sum() > 0 else (own > 0) / max((own > 0).sum(), 1))
    factors = [np.ones(len(t)) for t in targets]
    for _ in range(rounds):
        off = 0.0
        for d, target in enumerate(wanted):
            weights = tokens * np.prod([f[cells[:, k]] for k, f in enumerate(factors)], axis=0)
            reached = np.bincount(cells[:, d], weights, len(target))
            total = reached.sum()
            if total <= 0:
                return factors, wanted
            off = max(off, np.abs(reached / total - target).max())
            factors[d] *= np.divide(target * total, reached, out=np.zeros(len(target)), where=reached > 0)
        if off < tolerance:
            break
    return factors, wanted


def scale_for(weights: np.ndarray, tokens: np.ndarray, budget: float) -> float:
    """k with sum(tokens * min(1, k * weight)) = budget, where that is possible."""
    some = (weights > 0) & (tokens > 0)
    w, t = weights[some], tokens[some].astype(float)
    if not len(w) or budget >= t.sum():
        return float(1 / w.min()) if len(w) else 1.0
    order = np.argsort(-w)
    w, t = w[order], t[order]
    sure = np.concatenate([[0.0], np.cumsum(t)[:-1]])
    rest = np.cumsum((w * t)[::-1])[::-1]
    k = (budget - sure) / rest
    fits = np.flatnonzero(k * w <= 1 + 1e-12)
    return float(k[fits[0]])


def unnamed_share(given: dict[str, float]) -> float:
    """What the named shares leave for the rest."""
    return max(0.0, round(1 - sum(given.values()), 9))


def held_weights(rows: pa.Table, targets: dict[str, dict[str, float]], budget: float) -> tuple[pa.Table, float]:
    """As `spread_weights`, for cells (rows) on the driver."""
    rows = rows.sort_by([(d, "ascending") for d in DIMENSIONS])
    tokens = rows["tokens"].to_numpy().astype(float)
    cells, wanted = np.zeros((len(rows), len(DIMENSIONS)), np.int64), []
    for k, d in enumerate(DIMENSIONS):
        names, cells[:, k] = np.unique(np.array(rows[d].to_pylist(), object), return_inverse=True)
        own = np.bincount(cells[:, k], tokens, len(names))
        given = targets.get(d)
        if given:
            given = {OTHER: unnamed_share(given), **given}
            wanted.append(np.array([given[n] for n in names]))
        else:
            wanted.append((own / max(own.sum(), 1)) ** TEMPER)
    factors, _ = rake(cells, tokens, wanted)
    weights = np.prod([f[cells[:, k]] for k, f in enumerate(factors)], axis=0)
    # The tokens keep their sum.
    weights = weights * tokens.sum() / max((weights * tokens).sum(), 1e-9)
    scale = scale_for(weights, tokens, budget * tokens.sum())
    return rows.drop_columns(["tokens"]).append_column("weight", pa.array(weights)), scale


def target_of(cells: DataFrame, dimension: str, given: dict[str, float] | None) -> DataFrame:
    """name, target: of each category that has tokens, shares that add up to one."""
    own = cells.groupBy(F.col(dimension).alias("name")).agg(F.sum("tokens").alias("own"))
    if given:
        given = {OTHER: unnamed_share(given), **given}
        pairs = [F.lit(x) for n, v in given.items() for x in (n, float(v))]
        own = own.withColumn("target", F.create_map(*pairs)[F.col("name")])
    else:
        own = own.withColumn("target", F.pow(F.col("own").cast("double"), F.lit(TEMPER)))
    whole = own.agg(F.sum("target").alias("whole"), F.count("*").alias("n"))
    share = F.when(F.col("whole") > 0, F.col("target") / F.col("whole")).otherwise(1 / F.col("n"))
    return own.crossJoin(F.broadcast(whole)).select("name", share.alias("target"))


def spread_weights(counts: DataFrame, targets: dict[str, dict[str, float]], budget: float) -> tuple[DataFrame, float]:
    """The weight of each cell, and the scale from weights to probabilities. counts: a row a
    cell with tokens. Each round takes one sum for each dimension, joined back to the cells."""
    cells = counts
    for d in DIMENSIONS:
        goal = target_of(counts.where("tokens > 0"), d, targets.get(d))
        cells = cells.join(goal.withColumnsRenamed({"name": d, "target": f"{d}_target"}), d)
    # A category with target 0 is gone from the start, and its other categories share anew. Cells
    # without tokens get the factors of their categories.
    cells = cut(cells.where(" and ".join(f"{d}_target > 0" for d in DIMENSIONS)))
    whole, total = (t.agg(F.sum("tokens")).first()[0] or 0 for t in (counts, cells))
    for d in DIMENSIONS:
        own = cells.where("tokens > 0").groupBy(d).agg(F.first(f"{d}_target").alias("target"))
        cells = cells.withColumn(f"{d}_target", F.col(f"{d}_target") / F.lit(own.agg(F.sum("target")).first()[0] or 1.0))
    now = cells.withColumn("weight", F.lit(1.0 / max(total, 1)))
    for _ in range(ROUNDS if total else 0):
        off = 0.0
        for d in DIMENSIONS:
            reached = now.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("reached"))
            goal = F.col(f"{d}_target")
            now = cut(now.drop("off", "reached").join(reached, d).withColumns({
                "weight": F.col("weight") * F.coalesce(F.try_divide(goal, F.col("reached")), F.lit(0.0)),
                "off": F.when(F.col("reached") > 0, F.abs(F.col("reached") - goal)).otherwise(0.0),
            }))
            off = max(off, now.agg(F.max("off")).first()[0])
        if off < TOLERANCE:
            break
    now = now.select(*DIMENSIONS, "tokens", (F.col("weight") * F.lit(float(whole))).alias("weight"))
    return now.drop("tokens"), spread_scale(now, budget * whole)


def spread_scale(cells: DataFrame, budget: float) -> float:
    """As `scale_for`: cells that reach probability one are taken out until no more do."""
    some = cells.where("weight > 0 and tokens > 0")
    tokens, least = some.agg(F.sum("tokens"), F.min("weight")).first()
    if not tokens:
        return 1.0
    if budget >= tokens:
        return 1 / least
    k = 0.0
    while True:
        sure = F.col("weight") * k >= 1
        got, rest = some.agg(
            F.sum(F.when(sure, F.col("tokens")).otherwise(0)),
            F.sum(F.when(sure, 0.0).otherwise(F.col("weight") * F.col("tokens"))),
        ).first()
        new = (budget - got) / rest if rest else k
        if new <= k * (1 + 1e-12):
            return k
        k = new


def fit(docs: DataFrame, targets: dict[str, dict[str, float]] | None, budget: float) -> tuple[DataFrame, float]:
    """Weights by cell (source, lang, topic, weight), and the scale to probabilities. docs: as
    `prepared`. Every category counts; cells are a table, of which at most HELD_CELLS reach the
    driver."""
    targets = targets or {}
    groups = [named(d, targets.get(d)).alias(d) for d in DIMENSIONS]
    counts = cut(docs.groupBy(*groups).agg(F.sum("__tokens").alias("tokens")))
    if counts.count() > HELD_CELLS:
        found, scale = spread_weights(counts, targets, budget)
        return found, scale
    rows, scale = held_weights(counts.toArrow(), targets, budget)
    return F.broadcast(docs.sparkSession.createDataFrame(rows)), scale


def mix(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET,
    topic: Column | None = None, seed: int = 11,
) -> DataFrame:
    """The documents with `tokens`, `topic`, `weight`, `probability` and `sampled`.

    targets: shares by dimension (source, lang, topic) and category, "(other)" for all categories
    that are not named; without it these get what the named shares leave of one. Dimensions without targets get their own shares, tempered. budget: the share of all tokens
    to draw in expectation; weights beyond what a whole category holds are cut at probability
    one. Whether a document is drawn depends on a hash of its id and text, so runs repeat, and
    rows that repeat both are drawn or left together. Null sources, languages and texts are empty;
    texts without words have 0 tokens and are drawn like others of their categories. An empty
    table gives no rows. Columns of the input with the five names give way; others stay.
    """
    docs = docs.drop("tokens", "topic", "weight", "probability", "sampled")
    ready = prepared(docs, topic)
    targets = targets or {}
    weights, scale = fit(ready, targets, budget)
    for d in DIMENSIONS:
        ready = ready.withColumn(f"__cell_{d}", named(d, targets.get(d)))
    weights = weights.select(*[F.col(d).alias(f"__cell_{d}") for d in DIMENSIONS], F.col("weight").alias("__weight"))
    ready = ready.join(weights, [f"__cell_{d}" for d in DIMENSIONS], "left")
    chance = F.least(F.lit(1.0), F.lit(scale) * F.col("weight"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    weighed = ready.withColumn("weight", F.coalesce("__weight", F.lit(0.0))).withColumn("probability", chance)
    return weighed.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col("__tokens").alias("tokens"),
        F.col("__topic").alias("topic"), "weight", "probability", (draw < F.col("probability")).alias("sampled"),
    )
