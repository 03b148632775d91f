"""Conversation repair: cheapest edits that make the roles alternate, by search from both ends.

The rows of a conversation and the roles written so far span a lattice: a node is (rows read,
role written last), an edit an edge.  A forward and a reverse heap grow shortest paths from both
ends until no path can still be as cheap as the best meeting; all meetings of that cost are
looked at and the least concatenated audit is taken.

An audit has one letter an edit, so of two audits of the same rows and ends none is a proper
prefix of the other at equal cost, and the least whole is made of least parts.  Long
conversations are therefore cut into blocks wherever the sort put them: every block is searched
once for each pair of roles it may start and end with, in parallel, and only these few audits are
put together, in order.
"""

import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.llm import common
from retail_lake.llm.common import rows, written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: What has been written: nothing, a system turn, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role's initial leads from; repaired initials are (s?(ua)+)?.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Rows searched at once.
BLOCK_ROWS = 128

WHITE = r"\x20\x09-\x0D"
BLANK = rf"\A[{WHITE}]*\z"
#: The last character that is no white space ends a sentence.
COMPLETE = rf"[.!?][{WHITE}]*\z"
#: Code points of a text by which rows of equal turn and role are put in order; beyond it a digest decides.
HEAD_CHARS = 32


class Row(NamedTuple):
    """Equal rows of one turn: the first one's initial, whether it must go, whether it is cut off; and copies."""

    initial: str
    must_go: bool
    truncated: bool
    copies: int = 1


Label = tuple[int, str]
Node = tuple[int, int]


def _edges(block: list[Row]) -> tuple[dict[Node, list], dict[Node, list]]:
    """``node: [(node, cost, letters)]`` of the lattice, and the same turned round.

    Copies after the first are deleted right behind it: an insert among forced deletions costs
    the same behind them and makes a lesser audit there.
    """
    ahead: dict[Node, list] = {(i, s): [] for i in range(len(block) + 1) for s in range(4)}
    for (i, state), out in ahead.items():
        out += [((i, STEPS[r][state]), INSERT_COST, INSERT) for r in "ua" if state in STEPS[r]]
        if i == len(block):
            continue
        row = block[i]
        more, rest = DELETE * (row.copies - 1), DELETE_COST * (row.copies - 1)
        out.append(((i + 1, state), DELETE_COST + rest, DELETE + more))
        if not row.must_go:
            cost = rest + TRUNCATED_COST * row.truncated
            if state in STEPS.get(row.initial, ()):
                out.append(((i + 1, STEPS[row.initial][state]), cost, KEEP + more))
            out += [((i + 1, STEPS[r][state]), cost + REROLE_COST, REROLE + more) for r in "ua" if state in STEPS[r]]
    behind: dict[Node, list] = {node: [] for node in ahead}
    for node, out in ahead.items():
        for other, cost, letters in out:
            behind[other].append((node, cost, letters))
    return ahead, behind


def cheapest(block: list[Row], start: int, ends: tuple[int, ...], lattice: tuple[dict, dict] | None = None) -> Label | None:
    """Cost and audit of the cheapest edits from role ``start`` to one of ``ends``, ASCII-least of equal cost.

    Equal costs leave the heaps nearest to their own end first: an edge without cost always
    passes a row, so a node's audit is final when it is taken.
    """
    ahead, behind = lattice or _edges(block)
    last = len(block)
    # labels, those taken, heap, edges, heap order of a row, how letters join
    sides = [
        ({(0, start): (0, "")}, set(), [(0, 0, start)], ahead, 1),
        ({(last, s): (0, "") for s in ends}, set(), sorted((0, -last, s) for s in ends), behind, -1),
    ]
    best = None
    while sides[0][2] and sides[1][2]:
        if best is not None and sides[0][2][0][0] + sides[1][2][0][0] > best:
            break
        side = min((0, 1), key=lambda k: sides[k][2][0][0])
        labels, taken, heap, edges, sign = sides[side]
        cost, at, state = heappop(heap)
        node = (sign * at, state)
        if node in taken or labels[node][0] < cost:
            continue
        taken.add(node)
        audit, other_labels = labels[node][1], sides[1 - side][0]
        if node in other_labels:
            through = cost + other_labels[node][0]
            best = through if best is None else min(best, through)
        for other, step, letters in edges[node]:
            found = (cost + step, audit + letters if sign > 0 else letters + audit)
            if other not in taken and (other not in labels or found < labels[other]):
                if other not in labels or found[0] < labels[other][0]:
                    heappush(heap, (found[0], sign * other[0], other[1]))
                labels[other] = found
    if best is None:
        return None
    # every path of the least cost has a step from a node the forward search took to one the reverse search took,
    # or the forward search took it to its end
    (fore, fore_taken, *_), (back, back_taken, *_) = sides
    audits = [fore[n][1] + back[n][1] for n in fore_taken & back.keys() if fore[n][0] + back[n][0] == best]
    for node in fore_taken:
        cost, audit = fore[node]
        for other, step, letters in ahead[node]:
            if other in back_taken and cost + step + back[other][0] == best:
                audits.append(audit + letters + back[other][1])
    return best, min(audits)


def block_paths(block: list[Row], opens: bool = False, closes: bool = False) -> list[tuple[int, int, int, str]]:
    """``start, end, cost, audit`` for each pair of roles that a block may start and end with.

    A block that ``opens`` its conversation starts with nothing written; one that ``closes`` it
    needs one way to whichever end is the cheapest, told as ``ASSISTANT``.
    """
    lattice = _edges(block)
    ends = [(START, ASSISTANT)] if closes else [(b,) for b in range(4)]
    return [
        (a, b[-1], *found)
        for a in range(1 if opens else 4)
        for b in ends
        if (found := cheapest(block, a, b, lattice)) is not None
    ]


def repaired(conversation: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """The rows (``role, text``, in order) after the edits of ``audit``; it alone tells every role."""
    state = START
    conversation = iter(conversation)
    for letter in audit:
        role, text = ("", "") if letter == INSERT else next(conversation)
        if letter == DELETE:
            continue
        if letter != KEEP:
            role = "assistant" if state == USER else "user"
        state = STEPS[role[:1]][state]
        yield role, text


def _prepared(turns: DataFrame, copies: str | None) -> DataFrame:
    """Equal rows of a conversation's turn once, with their number, faults and the keys they are sorted by."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    once = (
        turns.select(
            F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
            role.alias("role"), text.alias("text"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"),
        )
        .where("copies > 0")
        .groupBy("conv", "turn", "role", "text")
        .agg(F.sum("copies").alias("copies"))
    )
    return written(
        once.withColumns(
            {
                "head": F.substring("text", 1, HEAD_CHARS),
                "digest": F.unhex(F.sha2(F.col("text").cast("binary"), 256)),
                "blank": F.col("text").rlike(BLANK),
                "truncated": ~F.col("text").rlike(COMPLETE),
            }
        ),
        "turns",
    )


def _judged(prepared: DataFrame) -> DataFrame:
    """Whether role and text were seen in an earlier turn; moves keys and digests, no texts."""
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    light = prepared.drop("text")
    first = light.groupBy("conv", "role", "digest").agg(F.min(order).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    first = first.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = light["conv"].eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    seen = F.coalesce(F.col("first") != order, F.lit(False))
    return light.join(first, same, "left").select(
        "conv", "turn", "role", "head", "digest", "copies", "blank", "truncated", seen.alias("seen")
    )


BLOCKS = (
    "conv long, part int, block long, n_rows long, blank long, duplicate long, truncated long, illegal long,"
    "first string, last string, low long, high long, turns long, paths array<struct<start:int,end:int,cost:long,audit:string>>"
)
_PATHS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_BLOCK_SCHEMA = pa.schema(
    [("conv", pa.int64()), ("part", pa.int32()), *[(c, pa.int64()) for c in ("block", "n_rows", "blank", "duplicate", "truncated", "illegal")]]
    + [("first", pa.string()), ("last", pa.string()), *[(c, pa.int64()) for c in ("low", "high", "turns")], ("paths", _PATHS)]
)
_LEGAL = {"su", "ua", "au"}


def _summary(conv: int | None, part: int, block: int, held: list[dict], opens: bool, closes: bool) -> list:
    """What the rest of a conversation needs to know of one block; turns count those after the first."""
    lattice = [Row(r["role"][:1], r["blank"] or r["seen"], r["truncated"], r["copies"]) for r in held]
    initials = [r["role"][:1] for r in held]
    blank = sum(r["copies"] for r in held if r["blank"])
    duplicate = sum(r["copies"] - (not r["seen"]) for r in held if not r["blank"])
    truncated = sum(r["truncated"] for r in held if not r["blank"] and not r["seen"])
    illegal = sum(r["copies"] - 1 for r in held) + sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
    turns = [r["turn"] for r in held if r["turn"] is not None]
    paths = [dict(zip(("start", "end", "cost", "audit"), p, strict=True)) for p in block_paths(lattice, opens, closes)]
    changes = sum(a != b for a, b in zip(turns, turns[1:], strict=False))
    low, high = (turns[0], turns[-1]) if turns else (None, None)
    return [conv, part, block, sum(r["copies"] for r in held), blank, duplicate, truncated, illegal, initials[0], initials[-1], low, high, changes, paths]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted rows, cut at conversations, at ``BLOCK_ROWS`` rows and where the task ends."""
    from pyspark import TaskContext

    part, block, conv, held, out = TaskContext.get().partitionId(), 0, None, [], []
    opens = False  # the task's first conversation may have begun in the one before

    def close(ended: bool) -> None:
        nonlocal block, opens
        out.append(_summary(conv, part, block, held, opens, ended))
        held.clear()
        block += 1
        opens = ended

    def flushed() -> pa.RecordBatch:
        batch = rows(_BLOCK_SCHEMA, list(map(list, zip(*out, strict=True))))
        out.clear()
        return batch

    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["conv"] != conv or len(held) >= BLOCK_ROWS):
                close(row["conv"] != conv)
            conv = row["conv"]
            held.append(row)
        if len(out) >= 256:
            yield flushed()
    if held:
        close(False)
    if out:
        yield flushed()


FOLDED = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_FOLDED_SCHEMA = pa.schema(
    [("conv", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())]
)


class _Conversation:
    """Blocks of one conversation, taken in order; holds the best audit for each role written last."""

    def __init__(self, conv: int | None):
        self.conv, self.sums, self.last = conv, [0] * 4, None
        self.low = self.high = None
        self.turns = 0
        self.paths: dict[int, Label] = {START: (0, "")}

    def add(self, b: dict) -> None:
        for k, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.sums[k] += b[name]
        if self.last is not None and self.last + b["first"] not in _LEGAL:
            self.sums[3] += 1
        self.last = b["last"]
        if b["low"] is not None:
            self.turns += b["turns"] + (self.high is None or b["low"] != self.high)
            self.low = b["low"] if self.low is None else self.low
            self.high = b["high"]
        found: dict[int, Label] = {}
        for path in b["paths"]:
            if path["start"] in self.paths:
                cost, audit = self.paths[path["start"]]
                whole = (cost + path["cost"], audit + path["audit"])
                found[path["end"]] = min(whole, found.get(path["end"], whole))
        self.paths = found

    def result(self) -> list:
        cost, audit = min(self.paths[s] for s in (START, ASSISTANT) if s in self.paths)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [self.conv, gaps, *self.sums, cost, audit]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, out = None, []
    for batch in batches:
        for b in batch.to_pylist():
            if current is None or b["conv"] != current.conv:
                if current is not None:
                    out.append(current.result())
                current = _Conversation(b["conv"])
            current.add(b)
        if out:
            yield rows(_FOLDED_SCHEMA, list(map(list, zip(*out, strict=True))))
            out = []
    if current is not None:
        yield rows(_FOLDED_SCHEMA, [[v] for v in current.result()])


def repair_plan(turns: DataFrame, copies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The edits of every conversation, and its rows as they stand before them.

    ``turns`` has ``conv_id, turn, role, text``; ``copies`` names a column that says how often a
    row stands there (zero: not at all), without it each row counts once.  First: ``conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit``, one row for each conv_id, also of conversations without rows.  Second: ``conv, turn,
    role, text, copies, ...`` in no order.

    Rows stand by turn, nulls first, then by role, then by the first ``HEAD_CHARS`` code points
    of the text, then by its digest; a null role or text is one space, a null conv_id is a
    conversation like others.  Equal rows travel once.
    """
    prepared = _prepared(turns, copies)
    parts = common.partitions(turns.sparkSession)
    judged = written(_judged(prepared), "judged")  # the range sampling below would make it twice
    ranged = judged.repartitionByRange(parts, "conv", "turn", "role", "head").sortWithinPartitions(
        "conv", "turn", "role", "head", "digest"
    )
    blocks = written(ranged.mapInArrow(_solve, BLOCKS), "blocks")
    folded = blocks.repartition(parts, "conv").sortWithinPartitions("conv", "part", "block").mapInArrow(_fold, FOLDED)
    convs = turns.select(F.col("conv_id").cast("long").alias("conv")).distinct()
    folded = folded.withColumnRenamed("conv", "of")
    whole = convs.join(folded, F.col("conv").eqNullSafe(F.col("of")), "left").drop("of")
    return written(whole.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill("", ["audit"]), "audits"), prepared


def _in_order(plan: DataFrame, prepared: DataFrame) -> DataFrame:
    """Each conversation's plan followed by its rows in order, one conversation after the other."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = [F.lit(None).cast("long").alias(c) for c in counts]
    heads = plan.select(
        "conv", F.lit(0).alias("kind"), *counts, "audit", F.lit(None).cast("long").alias("turn"),
        *[F.lit(None).cast("string").alias(c) for c in ("role", "text", "head")],
        F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("copies"),
    )
    body = prepared.select(
        "conv", F.lit(1).alias("kind"), *none, F.lit(None).cast("string").alias("audit"),
        "turn", "role", "text", "head", "digest", "copies",
    )
    both = heads.unionAll(body).repartition(common.partitions(plan.sparkSession), "conv")
    return both.sortWithinPartitions("conv", "kind", "turn", "role", "head", "digest")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """The plan of each conversation with its rows; the rows must be used up before the next one."""
    stream = (row for batch in batches for part in range(0, batch.num_rows, 500) for row in batch.slice(part, 500).to_pylist())
    ahead = next(stream, None)

    def said() -> Iterator[tuple[str, str]]:
        nonlocal ahead
        ahead = next(stream, None)
        while ahead is not None and ahead["kind"] == 1:
            for _ in range(ahead["copies"]):
                yield ahead["role"], ahead["text"]
            ahead = next(stream, None)

    while ahead is not None:
        yield ahead, said()


REPAIRED = "conv_id long, place long, role string, text string"


def repaired_turns(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """``conv_id, place, role, text``: the rows of all conversations after repair, numbered from 0."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        out = []
        for plan, said in _conversations(batches):
            for place, (role, text) in enumerate(repaired(said, plan["audit"])):
                out.append((plan["conv"], place, role, text))
                if len(out) >= 500:
                    yield rows(schema, list(map(list, zip(*out, strict=True))))
                    out = []
            for _ in said:
                pass
        if out:
            yield rows(schema, list(map(list, zip(*out, strict=True))))

    return _in_order(*repair_plan(turns, copies)).mapInArrow(write, REPAIRED)


REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def repair_report(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """One row for each conv_id: its faults, the cheapest edits and a digest of the repaired rows.

    The digest is that of ``role:text`` of all repaired rows joined by line feeds.  Rows stream
    through it, so a task holds an audit (one letter a row) and one batch, however long the
    conversation is; a digest is the one thing that must read a conversation from end to end.
    See ``repair_plan`` for order, nulls and repeated rows; an empty table gives no rows.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        schema = pa.schema(
            [("conv_id", pa.int64()), *[(c, pa.int64()) for c in names], ("audit", pa.string()), ("repaired_sha256", pa.string())]
        )
        out = []
        for plan, said in _conversations(batches):
            sha, between = hashlib.sha256(), b""
            for role, text in repaired(said, plan["audit"]):
                sha.update(between + f"{role}:{text}".encode())
                between = b"\n"
            for _ in said:
                pass
            out.append([plan["conv"], *[plan[c] for c in names], plan["audit"], sha.hexdigest()])
            if len(out) >= 500:
                yield rows(schema, list(map(list, zip(*out, strict=True))))
                out = []
        if out:
            yield rows(schema, list(map(list, zip(*out, strict=True))))

    report = _in_order(*repair_plan(turns, copies)).mapInArrow(digest, REPORT)
    return report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with planted faults, chosen by the CRC-32 of ``conv_id:turn`` modulo 20 (nulls: one space).

    0: the row is dropped (``copies`` 0), 1: empty text, 2: without ``.!?``, 3: twice (``copies``
    2), 4: role ``user``.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat_ws(":", *named).cast("binary")) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    return turns.select(
        "conv_id", "turn",
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )
