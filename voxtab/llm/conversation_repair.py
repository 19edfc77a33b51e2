"""Conversation structure repair: the cheapest edits after which the roles of a conversation read
system (or not), then user and assistant by turns.

Rows are kept for nothing, given another role for 3, deleted for 4 (blank and repeated ones must
be); an empty turn is put in for 3; a truncated row that stays costs 3 more. Of equally cheap edits
the ASCII-least list of initials (Keep, Rerole, Delete, Insert) counts.

The search is a depth-first branch and bound with an explicit stack over stretches of PIECE rows,
from each state of the role order that a stretch can be entered in to each that it can be left in.
A node is dropped where its cost and the least that its remaining rows must cost exceed the
incumbents, or where a prefix that is no dearer and no later in order has been in the same place
and state before. The results of the stretches add up to those of blocks, which tasks find for
themselves, and blocks are strung together by conversation. So of a long conversation no task
holds more than initials and a few numbers a block.
"""

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from voxtab.llm.common import SPACES

# Rows that are searched together, and turns of a block (as a power of two).
PIECE = 16
BLOCK_BITS = 9
RETYPE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3

# Where the role order stands: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
# States that can still come, or are.
EXITS = {START: range(4), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT), ASSISTANT: (USER, ASSISTANT)}
# The role that fits next, for rows that get another one and for turns put in.
FITS = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
LEGAL = {"su", "ua", "au"}
# A row as one letter: its role's initial; in upper case if it must go; truncated ones as digits.
TRUNCATED = {"s": "1", "u": "2", "a": "3", "x": "4"}
PLAIN = {v: k for k, v in TRUNCATED.items()}


def least_costs(rows: str) -> tuple[list[int], list[int]]:
    """What the rows from each place on must cost at least: from the start, and from later states,
    in which a system row cannot be kept."""
    early, late = [0], [0]
    for row in reversed(rows):
        kind, more = PLAIN.get(row, row), CUT_OFF if row in PLAIN else 0
        if row.isupper():
            first = other = DELETE
        else:
            first = min(DELETE, more + (RETYPE if kind == "x" else 0))
            other = min(DELETE, more + (RETYPE if kind in "xs" else 0))
        early.append(early[-1] + first)
        late.append(late[-1] + other)
    return early[::-1], late[::-1]


@lru_cache(maxsize=1 << 14)
def search(rows: str, entry: int) -> dict[int, tuple[int, str]]:
    """For each state that rows, entered in `entry`, can be left in: least cost, least edits."""
    early, late = least_costs(rows)
    best: dict[int, tuple[int, str]] = {}
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, edits = stack.pop()
        known = seen.get((at, state))
        if known is not None and known <= (cost, edits):
            continue
        bound = cost + (early if state == START else late)[at]
        if all(
            s in best and (bound > best[s][0] or bound == best[s][0] and edits > best[s][1][: len(edits)])
            for s in EXITS[state]
        ):
            continue
        seen[at, state] = (cost, edits)
        if at == len(rows):
            if state not in best or (cost, edits) < best[state]:
                best[state] = (cost, edits)
        after = USER if FITS[state] == "user" else ASSISTANT
        # The last one put on the stack is looked at first.
        stack.append((at, after, cost + INSERT, edits + "I"))
        if at == len(rows):
            continue
        row = rows[at]
        stack.append((at + 1, state, cost + DELETE, edits + "D"))
        if row.isupper():
            continue
        kind, more = PLAIN.get(row, row), CUT_OFF if row in PLAIN else 0
        stack.append((at + 1, after, cost + RETYPE + more, edits + "R"))
        if kind in NEXT[state]:
            stack.append((at + 1, NEXT[state][kind], cost + more, edits + "K"))
    return best


def strung(left: dict, right: dict) -> dict:
    """Best ways through two stretches, from those through each: by states before and after.

    Two ways to the same place and state that cost the same never begin one another, as what one
    has more would be turns put in; so the lesser stays the lesser whatever follows."""
    ways: dict[tuple[int, int], tuple[int, str]] = {}
    for (entry, middle), (cost, edits) in left.items():
        for (again, leave), (more, rest) in right.items():
            if again == middle:
                way = (cost + more, edits + rest)
                if (entry, leave) not in ways or way < ways[entry, leave]:
                    ways[entry, leave] = way
    return ways


def ways_through(rows: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Least cost and edits by states before and after the rows."""
    pieces = [rows[a : a + PIECE] for a in range(0, len(rows), PIECE)]
    each = ({(e, s): way for e in range(4) for s, way in search(p, e).items()} for p in pieces)
    return reduce(strung, each)


def slim_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, block, tie (order of rows with the same turn), letter, fault of each row."""
    text, role = F.col("text"), F.col("role")
    bare = F.rtrim(text, F.lit(SPACES.decode()))
    initial = F.substring(role, 1, 1)
    kept = rows.select(
        "conv_id", "turn", F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(-(1 << 62))).alias("block"),
        "tie", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("letter"),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    said = Window.partitionBy("conv_id", "tie").orderBy(F.col("turn").asc_nulls_first())
    again = F.row_number().over(said) > 1
    fault = F.when(F.col("blank"), 1).when(again, 2).when(F.col("truncated"), 3).otherwise(0)
    return kept.select("conv_id", "turn", "block", "tie", "letter", fault.alias("fault"))


def arrow_schema(df: DataFrame, schema: StructType) -> pa.Schema:
    return df.sparkSession.createDataFrame([], schema).toArrow().schema


NUMBERS = ("blank", "duplicate", "truncated", "illegal")


def block_schema(conv_id: StructField) -> StructType:
    longs = [StructField(n, LongType()) for n in ("block", *NUMBERS, "first_turn", "last_turn", "turns")]
    return StructType([
        conv_id, *longs, StructField("ends", StringType()),
        StructField("ways", ArrayType(LongType())), StructField("edits", ArrayType(StringType())),
    ])


def blocks_of(rows: DataFrame) -> DataFrame:
    """A row a block: counts, turns, first and last initial, and the ways through it. `ways` holds
    state before, state after and cost of each, `edits` what belongs to it."""
    schema = block_schema(rows.schema["conv_id"])
    kind = arrow_schema(rows, schema)
    ordered = rows.repartition("conv_id", "block").sortWithinPartitions(
        "conv_id", "block", F.col("turn").asc_nulls_first(), "tie"
    )

    def closed(conv_id, block, turns: list, letters: list, faults: list) -> dict:
        marked = [
            letter.upper() if fault in (1, 2) else TRUNCATED[letter] if fault == 3 else letter
            for letter, fault in zip(letters, faults, strict=True)
        ]
        ways = ways_through("".join(marked))
        known = [t for t in turns if t is not None]
        return {
            "conv_id": conv_id, "block": block,
            **{n: faults.count(k) for k, n in enumerate(NUMBERS[:3], 1)},
            "illegal": sum(a + b not in LEGAL for a, b in zip(letters, letters[1:], strict=False)),
            "first_turn": min(known, default=None), "last_turn": max(known, default=None),
            "turns": len(set(known)), "ends": letters[0] + letters[-1],
            "ways": [v for (a, b), (cost, _) in ways.items() for v in (a, b, cost)],
            "edits": [edits for _, edits in ways.values()],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, out = ([], [], []), None, []
        for batch in batches:
            for conv_id, block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (conv_id, block) and held[0]:
                    out.append(closed(*group, *held))
                    held = ([], [], [])
                group = (conv_id, block)
                for values, value in zip(held, row, strict=True):
                    values.append(value)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
        if held[0]:
            yield pa.RecordBatch.from_pylist([closed(*group, *held)], schema=kind)

    return ordered.select("conv_id", "block", "turn", "letter", "fault").mapInArrow(run, schema)


class Chain:
    """Ways through the blocks of one conversation so far. What all of them begin with is put
    aside, so that a block costs what it holds."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.ways = {START: (0, "")}
        self.done: list[str] = []
        self.numbers = dict.fromkeys(NUMBERS, 0)
        self.first = self.last = None
        self.turns = 0
        self.end = ""

    def add(self, row: dict) -> None:
        for name in NUMBERS:
            self.numbers[name] += row[name]
        self.numbers["illegal"] += bool(self.end) and self.end + row["ends"][0] not in LEGAL
        self.end = row["ends"][1]
        if row["turns"]:
            self.first = row["first_turn"] if self.first is None else min(self.first, row["first_turn"])
            self.last = row["last_turn"] if self.last is None else max(self.last, row["last_turn"])
            self.turns += row["turns"]
        flat = row["ways"]
        block = {
            (a, b): (cost, edits)
            for a, b, cost, edits in zip(flat[::3], flat[1::3], flat[2::3], row["edits"], strict=True)
        }
        ways = strung({(START, s): way for s, way in self.ways.items()}, block)
        common = os.path.commonprefix([edits for _, edits in ways.values()])
        self.done.append(common)
        self.ways = {s: (cost, edits[len(common) :]) for (_, s), (cost, edits) in ways.items()}

    def result(self) -> dict:
        cost, edits = min(self.ways[s] for s in ENDS if s in self.ways)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {
            "conv_id": self.conv_id, "gaps": gaps, **self.numbers, "cost": cost,
            "audit": "".join([*self.done, edits]),
        }


def plan_schema(conv_id: StructField) -> StructType:
    longs = [StructField(n, LongType()) for n in ("gaps", *NUMBERS, "cost")]
    return StructType([conv_id, *longs, StructField("audit", StringType())])


def plans_of(blocks: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of `conversations`: counts, cost and audit."""
    schema = plan_schema(blocks.schema["conv_id"])
    kind = arrow_schema(blocks, schema)
    named = conversations.select("conv_id").distinct()
    listed = blocks.unionByName(named, allowMissingColumns=True)
    ordered = listed.repartition("conv_id").sortWithinPartitions("conv_id", F.col("block").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, out = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] is None:
                    if chain is not None:
                        out.append(chain.result())
                    chain = Chain(row["conv_id"])
                else:
                    chain.add(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
        if chain is not None:
            yield pa.RecordBatch.from_pylist([chain.result()], schema=kind)

    return ordered.mapInArrow(run, schema)


def with_tie(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null roles and texts as one space), tie."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text")
    )
    return rows.withColumn("tie", F.unhex(F.md5(F.concat("role", F.lit("\0"), "text"))))


def plan(conversations: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Per conv_id of `listed` (default: of the conversations): gaps, blank, duplicate, truncated,
    illegal, cost and audit.

    Rows count in order of turn, nulls first; rows of one turn in order of a hash of role and text,
    so that copies follow each other and repeated rows have one order. Null roles and texts are
    one space; null ids are one conversation. A conversation without rows, which only `listed`
    can name, has zeros and an empty audit; other columns are not looked at."""
    rows = with_tie(conversations)
    return plans_of(blocks_of(slim_rows(rows)), conversations if listed is None else listed)


class Rebuild:
    """The rows of one conversation after the edits of its audit, as they come."""

    def __init__(self, edits: str):
        self.edits, self.at, self.state = edits, 0, START

    def _fit(self, text: str) -> tuple[str, str, str]:
        role = FITS[self.state]
        self.state = NEXT[self.state][role[0]]
        return role, text, "insert"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            yield self._fit("")

    def rows(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "R":
            role, text, _ = self._fit(text)
            yield role, text, "rerole"
        elif edit == "K":
            self.state = NEXT[self.state][role[0]]
            yield role, text, "keep"


def rebuilt(conversations: DataFrame, plans: DataFrame, finish, schema: StructType) -> DataFrame:
    """finish(plan, rows) for each conversation; rows: an iterator over (role, text, edit)."""
    kind = arrow_schema(plans, schema)
    head = plans.withColumn("plan", F.struct(*[c for c in plans.columns if c != "conv_id"]))
    head = head.select("conv_id", "plan")
    both = head.unionByName(with_tie(conversations), allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("plan").isNull(), F.col("turn").asc_nulls_first(), "tie"
    )

    def rows_in(batches):
        for batch in batches:
            yield from zip(*(batch.column(n).to_pylist() for n in ("conv_id", "plan", "role", "text")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = rows_in(batches)
        head = next(source, None)
        out, size = [], 0
        while head is not None:
            conv_id, edits = head[0], head[1]
            head = None

            def repaired():
                nonlocal head
                work = Rebuild(edits["audit"])
                for row in source:
                    if row[1] is not None:
                        head = row
                        break
                    yield from work.rows(row[2], row[3])
                yield from work.inserted()

            for made in finish({"conv_id": conv_id, **edits}, repaired()):
                out.append(made)
                size += 1 + len(made.get("text") or "") // 64
                if size > 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return ordered.mapInArrow(run, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text, edit (keep, rerole or
    insert). Order, nulls and repeats are as in `plan`."""
    plans = plan(conversations)
    schema = StructType([
        conversations.schema["conv_id"], StructField("position", LongType()),
        *(StructField(n, StringType()) for n in ("role", "text", "edit")),
    ])

    def listed(head, rows):
        for k, (role, text, edit) in enumerate(rows):
            yield {"conv_id": head["conv_id"], "position": k, "role": role, "text": text, "edit": edit}

    return rebuilt(conversations, plans, listed, schema)


def repair_report(conversations: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """What `plan` gives, with repaired_sha256: of the repaired rows as `role:text`, joined by line
    feeds. A conversation's texts stream through one task, since a digest has one order."""
    plans = plan(conversations, listed)
    schema = StructType([*plans.schema.fields, StructField("repaired_sha256", StringType())])

    def digest(head, rows):
        found, first = hashlib.sha256(), True
        for role, text, _ in rows:
            found.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        yield {**head, "repaired_sha256": found.hexdigest()}

    return rebuilt(conversations, plans, digest, schema)


def with_damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of damaged conversations. By crc32 of `conv_id:turn`, modulo 20: 0
    drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3
    repeats it, 4 makes it the user's. Nulls are one space in the key, and as role or text."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    key = F.concat(blank("conv_id"), F.lit(":"), blank("turn"))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
        F.explode(times).alias("copy"),
    ).drop("copy")
