"""Chat transcripts as training windows within a token budget.

A turn reads ``### role: text</turn>`` and a line feed.  Inside roles and texts a backslash
precedes every backslash, every ``#`` that starts ``###``, every ``</turn>`` and, in roles,
every colon, so the marks of the template cannot be forged and reading undoes it exactly.

The prefix sum of turn tokens places each turn: a conversation's tokens are cut into stretches
of the budget that is left beside the system turn and the repeated history; turns that lie
within a stretch make a window, and a turn across its end makes one of its own.  No turn is cut
and no window depends on how an earlier one came out, so a conversation of any length is
spread over many tasks.  Each window begins with the system turn and the turns of at most
``history`` tokens before it.  The loss mask covers assistant texts, but none that is repeated.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retail_lake.llm.common import partitions, rows, written
from retail_lake.llm.tokens import BYTE_BPE, Pieces, blank_pieces, load

BUDGET = 2048
HISTORY = 256
TARGET = "assistant"
SYSTEM = "system"
HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"

_IN_TEXT = re.compile(r"\\|#(?=##)|</turn>")
_IN_ROLE = re.compile(r"\\|#(?=##)|</turn>|:")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)

WINDOWS = "conv_id long, window long, n_repeated int, text string, mask array<struct<start: int, end: int>>"


def escape(text: str, pattern: re.Pattern = _IN_TEXT) -> str:
    return pattern.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text begins and ends in it."""
    head = HEAD + escape(role, _IN_ROLE) + COLON
    body = escape(text)
    return head + body + TAIL, len(head), len(head) + len(body)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """The turns of a formatted window."""
    at = 0
    while at < len(text):
        turn = _TURN.match(text, at)
        if turn is None:
            raise ValueError(f"no turn at character {at}")
        yield unescape(turn.group(1)), unescape(turn.group(2))
        at = turn.end()


def _counted(conversations: DataFrame, path: str) -> DataFrame:
    names = ["conv", "conv_id", "turn", "role", "text", "n"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(load(path), blank_pieces)
        for batch in batches:
            turns = zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
            n = pieces.counts([format_turn(role, text)[0] for role, text in turns])
            yield rows(schema, [*(batch.column(c) for c in names[:-1]), n])

    # null ids make a conversation of their own
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return conversations.select(
        key.alias("conv"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text")
    ).mapInArrow(count, "conv string, conv_id long, turn long, role string, text string, n long")


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with ``at``, the tokens of their conversation before them, and ``nth``, their place in it.

    Ranges of (conversation, turn) are summed side by side, then the ranges of a conversation.
    """
    order = ["turn", "role", "text"]
    spark = turns.sparkSession
    ranged = turns.repartitionByRange(partitions(spark), "conv", *order).withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "turns")
    sums = ranged.groupBy("conv", "range").agg(F.sum("n").alias("tokens"), F.count("*").alias("turns"))
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        F.col("conv").alias("c"),
        F.col("range").alias("r"),
        F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"),
        F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before"),
    )
    within = Window.partitionBy("conv", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumns(
        {"sum": F.coalesce(F.sum("n").over(within), F.lit(0)), "count": F.count("n").over(within)}
    )
    return running.join(bases, (F.col("conv") == F.col("c")) & (F.col("range") == F.col("r"))).select(
        "conv", "conv_id", "role", "text", "n", (F.col("base") + F.col("sum")).alias("at"), (F.col("turns_before") + F.col("count")).alias("nth")
    )


def chat_windows(
    conversations: DataFrame, path: str = BYTE_BPE, budget: int = BUDGET, history: int = HISTORY, target: str = TARGET
) -> DataFrame:
    """Format all conversations (``conv_id, turn, role, text``) into windows.

    Returns ``conv_id, window`` (ascending in a conversation), ``n_repeated`` (leading turns that
    an earlier window has as well), ``text`` and ``mask``, spans of ``text`` in characters that
    the loss covers.  Rows are ordered by turn, then role and text, null turns first; repeated
    rows are turns of their own.  Null roles and texts are empty, null conv_ids make one
    conversation.  The first turn is the system turn if its role is ``system``.  A window holds
    more tokens than the budget only where the system turn and one other turn do; turns stay whole.  Other columns are not read.
    """
    placed = written(_placed(_counted(conversations, path)), "placed")
    system = placed.where((F.col("nth") == 0) & (F.col("role") == SYSTEM)).select(
        F.col("conv").alias("c"), F.col("n").alias("system_n"), F.col("text").alias("system_text")
    )
    # what is left for new turns beside the system turn and the history, which gives way to a long system turn
    left = F.lit(budget) - F.coalesce("system_n", F.lit(0))
    room = F.greatest(F.lit(1), left - F.least(F.lit(history), F.floor(left / 4)))
    turns = placed.join(system.drop("system_text"), F.col("conv") == F.col("c"), "left").withColumns({"left": left, "room": room})
    # the system turn stands before all stretches
    at = F.col("at") - F.coalesce("system_n", F.lit(0))
    turns = turns.withColumns({"at": at, "is_system": (F.col("nth") == 0) & F.col("system_n").isNotNull()})
    first, last = F.floor(F.col("at") / F.col("room")), F.floor((F.col("at") + F.col("n") - 1) / F.col("room"))
    turns = turns.withColumn("window", F.when(F.col("is_system"), F.lit(-1)).otherwise(2 * first + (last > first).cast("int")))
    turns = written(turns.drop("c", "nth"), "in_windows")
    body = turns.where(~F.col("is_system"))
    # windows by conversation and stretch, for the turns of up to `history` tokens before them
    windows = body.groupBy("conv", "window").agg(
        F.min("at").alias("start"), F.min("room").alias("own_room"), (F.min("left") - F.sum("n")).alias("unused")
    )
    stretches = windows.select(F.col("conv").alias("w_conv"), F.col("window").alias("w"), "start", "unused", F.floor(F.col("start") / F.col("own_room")).alias("stretch"))
    reach = body.withColumn(
        "stretch", F.explode(F.sequence(F.floor(F.col("at") / F.col("room")), F.floor((F.col("at") + history) / F.col("room"))))
    )
    repeated = (
        reach.join(stretches, (F.col("conv") == F.col("w_conv")) & (reach["stretch"] == stretches["stretch"]))
        .where((F.col("w") > F.col("window")) & (F.col("at") >= F.col("start") - F.least(F.lit(history), "unused")))
        .select("conv", "conv_id", F.col("w").alias("window"), "at", "role", "text", F.lit(True).alias("again"))
    )
    heads = turns.where("is_system").select("conv", "conv_id", "text")
    first_window = windows.groupBy("conv").agg(F.min("window").alias("window"))
    # the first window has the system turn as a new one, a conversation of nothing else a window for it
    new_heads = heads.join(first_window, "conv", "left").select(
        "conv", "conv_id", F.coalesce("window", F.lit(0)).alias("window"), F.lit(-1).alias("at"), F.lit(SYSTEM).alias("role"), "text", F.lit(False).alias("again")
    )
    later = windows.join(first_window.withColumnRenamed("window", "least"), "conv").where(F.col("window") > F.col("least"))
    old_heads = heads.join(later.select("conv", "window"), "conv").select(
        "conv", "conv_id", "window", F.lit(-1).alias("at"), F.lit(SYSTEM).alias("role"), "text", F.lit(True).alias("again")
    )
    new = body.select("conv", "conv_id", "window", "at", "role", "text", F.lit(False).alias("again"))
    grouped = (
        new.unionAll(repeated).unionAll(new_heads).unionAll(old_heads)
        .groupBy("conv", "window")
        .agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("at", "again", "role", "text"))).alias("turns"))
    )

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("n_repeated", pa.int32()), ("text", pa.string()), ("mask", span)])
        for batch in batches:
            texts, masks, again = [], [], []
            for turns_of in batch.column("turns").to_pylist():
                done, mask, at = [], [], 0
                for t in turns_of:
                    text, a, b = format_turn(t["role"], t["text"])
                    if t["role"] == target and not t["again"]:
                        mask.append({"start": at + a, "end": at + b})
                    done.append(text)
                    at += len(text)
                texts.append("".join(done))
                masks.append(mask)
                again.append(sum(t["again"] for t in turns_of))
            yield rows(schema, [batch.column("conv_id"), batch.column("window"), again, texts, masks])

    return grouped.select("conv_id", "window", "turns").mapInArrow(form, WINDOWS)


def digests(windows: DataFrame) -> DataFrame:
    """What formatted windows say about each conversation, read from their text and mask alone.

    ``conv_id, n_turns, turns_sha256`` (role, line feed, text, line feed of every turn),
    ``loss_chars, loss_sha256`` (unescaped text under the mask), ``formatted_chars, n_windows``.
    A conversation's windows pass through one task in order, one at a time.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        done: list[tuple] = []
        state = None

        def closed(s):
            return (s["id"], s["turns"], s["all"].hexdigest(), s["loss"], s["under"].hexdigest(), s["chars"], s["windows"])

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or state["id"] != row["conv_id"]:
                    if state is not None:
                        done.append(closed(state))
                    state = {"id": row["conv_id"], "turns": 0, "all": hashlib.sha256(), "loss": 0, "under": hashlib.sha256(), "chars": 0, "windows": 0}
                for k, (role, text) in enumerate(parse(row["text"])):
                    if k >= row["n_repeated"]:
                        state["turns"] += 1
                        state["all"].update(f"{role}\n{text}\n".encode())
                for span in row["mask"]:
                    text = unescape(row["text"][span["start"] : span["end"]])
                    state["loss"] += len(text)
                    state["under"].update(text.encode())
                state["chars"] += len(row["text"])
                state["windows"] += 1
            if done:
                yield rows(schema, [list(c) for c in zip(*done, strict=True)])
                done = []
        if state is not None:
            yield rows(schema, [[v] for v in closed(state)])

    spread = windows.repartition(partitions(windows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window")
    return spread.mapInArrow(
        digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long",
    )
