"""Secret scans: strong patterns on their own, weak ones where complementary parts co-occur.

Strong spans are reported as they are found. A credential often comes in parts, none of them
telling alone: an identifier or an endpoint, and a secret. Weak candidates of these kinds are
found by looser patterns; an interval join within each text reports one only if a part of the
other class, strong or weak, lies within reach.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtab.llm.common import cut, digest

IDENTITY, SECRET = "identity", "secret"
REACH = 200
SPAN = "struct<start:int,place:int,end:int,kind:string>"
# Matches whose places are added up in one go; sums over these blocks come first, so that
# the work is not the square of the matches.
BLOCK = 256


class Kind(NamedTuple):
    """least: characters of group `group` that a match must have, or it is dropped. holds: what each
    match holds, a quick test for texts without any."""

    name: str
    pattern: str
    part: str
    group: int = 0
    least: int = 0
    holds: str = ""


def either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in words)


ASSIGN = r"""["']?\x20*[:=]\x20*["']?"""

# The strong kinds, in the order in which spans with one start are listed.
STRONG = (
    Kind(
        "assign",
        "(" + either_case("password|passwd|secret|token|api_?key") + ")" + ASSIGN + "([A-Za-z0-9+/_.=-]+)",
        SECRET, 2, 6,
    ),
    Kind("access", "AKIA[A-Z0-9]{16,}", IDENTITY, holds="AKIA"),
    Kind("hex", "[0-9a-f]{24,}", SECRET),
)
WEAK = (
    Kind(
        "id",
        "(?:" + either_case("client_?id|access_?key_?id|user_?name|login") + ")" + ASSIGN
        + "[A-Za-z0-9@._-]{3,}",
        IDENTITY,
    ),
    Kind(
        "value",
        "(?:" + either_case("access_?key|private_?key|auth_?key|signature|pwd") + ")" + ASSIGN
        + "[A-Za-z0-9+/_.=-]{6,}",
        SECRET,
    ),
    Kind(
        "endpoint",
        r"""(?:https?|ftps?|postgres|postgresql|mysql|redis|amqps?|mongodb)://[^\x20\x09-\x0D"'<>]{4,}""",
        IDENTITY, holds="://",
    ),
    # Who a password is for is often named by an address alone.
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", IDENTITY, holds="@"),
)
KINDS = STRONG + WEAK


def literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def spans_of(text: str, kind: Kind) -> Column:
    """Spans of the matches of one kind in a column named `text`: leftmost, not overlapping,
    in code points. Matches and the gaps between them are measured; sums of these lengths
    are the places."""
    place = [k.name for k in KINDS].index(kind.name)
    p = literal(kind.pattern)
    enough = (
        f"length(regexp_extract(m, {p}, {kind.group})) >= {kind.least}" if kind.least else "true"
    )
    steps = f"""zip_with(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1),
      (m, g) -> named_struct('gap', coalesce(length(g), 0), 'len', coalesce(length(m), 0), 'ok', {enough}))"""
    blocks = f"sequence(0, cast((size(s) - 1) div {BLOCK} as int))"
    part = f"slice(s, b * {BLOCK} + 1, {BLOCK})"
    add = "(a, x) -> a + x.gap + x.len"
    sums = f"transform({blocks}, b -> aggregate({part}, 0, {add}))"
    before = "aggregate(slice(sums, 1, b), 0, (a, x) -> a + x)"
    span = f"named_struct('start', a.at + x.gap, 'place', {place}, 'end', a.at + x.gap + x.len, 'kind', '{kind.name}')"
    walk = f"""aggregate({part},
      named_struct('at', {before}, 'out', cast(array() as array<{SPAN}>)),
      (a, x) -> named_struct('at', a.at + x.gap + x.len,
        'out', if(x.ok and x.len > 0, concat(a.out, array({span})), a.out))).out"""
    # transform over one-element arrays names the steps and their sums.
    found = f"""flatten(transform(array({steps}), s ->
      flatten(flatten(transform(array({sums}), sums -> transform({blocks}, b -> {walk}))))))"""
    quick = f"contains({text}, '{kind.holds}') and " if kind.holds else ""
    return F.expr(f"if({quick}{text} rlike {p}, {found}, cast(array() as array<{SPAN}>))")


def of_class(spans: str, part: str) -> Column:
    names = ", ".join(f"'{k.name}'" for k in KINDS if k.part == part)
    return F.expr(f"filter({spans}, s -> s.kind in ({names}))")


def linked_parts(scanned: DataFrame, reach: int) -> DataFrame:
    """Weak spans with a part of the other class within `reach` characters, per text: key,
    id, linked. Each span stands in the cells of `reach` characters that it may be near to; a
    text's spans meet within cells only."""
    both = (F.size(of_class("parts", IDENTITY)) > 0) & (F.size(of_class("parts", SECRET)) > 0)
    texts = (
        scanned.where((F.size("__weak") > 0))
        .select("__key", "__id", F.concat("__strong", "__weak").alias("parts"), "__weak")
        .where(both)
        .dropDuplicates(["__key", "__id"])
    )
    # Few texts have parts of both classes; both sides of the join read them from here.
    texts = cut(texts)
    identity = F.col("kind").isin([k.name for k in KINDS if k.part == IDENTITY])
    weak = (
        texts.select("__key", "__id", F.inline("__weak"))
        .withColumn("identity", identity)
        .withColumn("cell", F.explode(F.expr(
            f"sequence(cast((start - {reach}) div {reach} - 1 as int), cast((end + {reach}) div {reach} as int))"
        )))
    )
    others = (
        texts.select("__key", "__id", F.inline("parts"))
        .select(
            F.col("__key").alias("o_key"), F.col("__id").alias("o_id"), (~identity).alias("o_identity"),
            F.col("start").alias("o_start"), F.col("end").alias("o_end"),
            F.explode(F.expr(f"sequence(cast(start div {reach} as int), cast(end div {reach} as int))")).alias("o_cell"),
        )
    )
    near = (
        (F.col("__key") == F.col("o_key")) & F.col("__id").eqNullSafe(F.col("o_id"))
        & (F.col("cell") == F.col("o_cell")) & (F.col("identity") == F.col("o_identity"))
        & (F.col("o_start") - F.col("end") <= reach) & (F.col("start") - F.col("o_end") <= reach)
    )
    found = weak.join(others, near, "left_semi")
    span = F.struct("start", "place", "end", "kind")
    return found.groupBy("__key", "__id").agg(F.collect_set(span).alias("linked"))


def scan(docs: DataFrame, reach: int = REACH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with `secret_spans`: array<struct<start, place, end, kind>>, sorted by
    start and kind; code points, end exclusive.

    Null texts are empty and hold nothing. Repeated rows each get their spans; an input column
    named secret_spans gives way. Linking is per row's id and text, so rows that share an id do
    not mix. Texts are scanned twice: for candidates to link, of which the few texts with parts of
    both classes are kept behind a checkpoint, and for the row's own spans, to which the linked
    ones are joined back. Only spans are shuffled.
    """
    docs = docs.drop("secret_spans")
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # The input's other columns travel as one, so that no name of theirs meets one used here.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = docs.select(whole, own.alias("__text"), F.col(f"`{key}`").alias("__id"))
    named = named.withColumn("__key", digest(F.col("__text")))
    strong = F.concat(*[spans_of("__text", k) for k in STRONG])
    weak = F.concat(*[spans_of("__text", k) for k in WEAK])
    scanned = named.withColumns({"__strong": strong, "__weak": weak})
    linked = linked_parts(scanned, reach).select(
        F.col("__key").alias("l_key"), F.col("__id").alias("l_id"), F.col("linked").alias("__linked")
    )
    same = (F.col("__key") == F.col("l_key")) & F.col("__id").eqNullSafe(F.col("l_id"))
    joined = scanned.join(linked, same, "left")
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    spans = F.array_sort(F.concat("__strong", F.coalesce("__linked", empty)))
    return joined.select("row.*", spans.alias("secret_spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))),
        ",",
    )


def redact(docs: DataFrame, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """Documents of `scan` with each run of covered characters replaced by `mark`; the column
    secret_spans goes. Texts without spans stay as they are, null too."""
    covered = f"""aggregate(secret_spans,
      named_struct('at', 0, 'out', cast(array() as array<string>)),
      (a, s) -> named_struct('at', greatest(a.at, s.end),
        'out', if(s.end > a.at and (s.start > a.at or size(a.out) = 0),
          concat(a.out, array(substring({text}, a.at + 1, s.start - a.at), '{mark}')), a.out)),
      a -> concat(array_join(a.out, ''), substring({text}, a.at + 1)))"""
    return docs.withColumn(
        text, F.expr(f"if(size(secret_spans) > 0, {covered}, {text})")
    ).drop("secret_spans")
