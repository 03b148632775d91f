"""Mix sources to target weights through blocks of fixed length.

Each source's documents, in a pseudorandom order, make one long run of words that is cut into
blocks.  Every source gets as many slots as its target needs; slots are dealt to output shards
by multinomial draws that are held to the sources' totals, and slot j of a source reads the
block to which a pseudorandom permutation of that source's block numbers sends it.  Once all
blocks are used, a further permutation begins, so a block is never used more often than any
other of its source plus one.  Slots and blocks are joined by source and block number.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retail_lake.llm.common import WORD, mixed, rows, written

BLOCK_WORDS = 128
OUTPUT_SHARDS = 16
#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (1, 2, 3)
#: No source is repeated more often than this.
REPEATS = 3
#: Parts into which the documents of one source are dealt for prefix sums.
SPREAD = 64
SEED = 42


@dataclass(frozen=True)
class Source:
    number: int
    name: str | None
    size: int
    blocks: int
    target: float
    slots: int


def targets(sizes: list[int], weights: list[float], repeats: float = REPEATS) -> list[float]:
    """Share out the sum of sizes by weight; no target exceeds ``repeats`` times its size, the rest is reshared."""
    total, stopped = float(sum(sizes)), [s == 0 for s in sizes]
    found = [0.0] * len(sizes)
    while not all(stopped):
        rest = total - sum(repeats * s for s, full in zip(sizes, stopped, strict=True) if full)
        weight = sum(w for w, full in zip(weights, stopped, strict=True) if not full)
        found = [float(repeats * s) if full else rest * w / weight for s, w, full in zip(sizes, weights, stopped, strict=True)]
        over = [not full and f > repeats * s for f, s, full in zip(found, sizes, stopped, strict=True)]
        if not any(over):
            break
        stopped = [a or b for a, b in zip(stopped, over, strict=True)]
    return found


def shard_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots per output shard and source: multinomial draws given that every source's slots are used up."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left, counts = np.array(slots, np.int64), np.zeros((shards, len(slots)), np.int64)
    for shard in range(shards):
        # a source's slots fall to this shard or a later one, each with the same chance
        counts[shard] = rng.binomial(left, 1.0 / (shards - shard))
        left = left - counts[shard]
    return counts


def _permuted(j: np.ndarray, size: int, key: int) -> np.ndarray:
    """Images of ``j`` under a pseudorandom permutation of 0..size-1 (a Feistel network, walked in cycles)."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for turn in range(4):
            salt = np.uint64((key * 1_000_003 + turn * 7919 + 1) & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (mixed(mixed(right + salt) + salt) & mask)
        return (left << shift) | right

    x = once(j.astype(np.uint64))
    while (outside := x >= size).any():
        x[outside] = once(x[outside])
    return x.astype(np.int64)


def order_hash():
    """The pseudorandom place of a document in its source."""
    return F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), F.col("text").cast("string"))


def sized(docs: DataFrame, spread: int = SPREAD, more: tuple = ()) -> DataFrame:
    """``doc_id, _source, _size`` (words), ``_order``, ``_part``, one of ``spread`` parts of a source, and ``more`` columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("_source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("_size"),
        order_hash().alias("_order"),
        F.pmod(order_hash(), F.lit(spread)).alias("_part"),
        *more,
    )


def _begins(staged: DataFrame) -> DataFrame:
    """Rows with ``_begin``, the words of their source before them in the order of ``_order``.

    The parts of a source are summed first, so no task holds a whole source; equal rows may
    swap places.
    """
    per_part = staged.groupBy("_source", "_part").agg(F.sum("_size").alias("n"))
    parts = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("_source", "_part", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_source", "_part").orderBy("_order", "_size").rowsBetween(Window.unboundedPreceding, -1)
    running = staged.withColumn("_within", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    joined = running.alias("r").join(
        bases.withColumnsRenamed({"_source": "_s", "_part": "_p"}),
        F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")),
    )
    return joined.withColumn("_begin", F.col("_base") + F.col("_within")).drop("_s", "_p", "_base", "_within")


def plan(staged: DataFrame, block: int, weights: tuple = WEIGHTS, repeats: float = REPEATS) -> list[Source]:
    """One entry a source: names and sizes of sources come to the driver, a row each."""
    found = staged.groupBy("_source").agg(F.sum("_size").alias("n")).collect()
    # UTF-8 keeps code point order, Python compares strings so as well
    order = sorted(((r["_source"], int(r["n"])) for r in found), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in order]
    goals = targets(sizes, [weights[k % len(weights)] for k in range(len(order))], repeats)
    plans = []
    for k, ((name, size), goal) in enumerate(zip(order, goals, strict=True)):
        blocks = -(-size // block)
        slots = min(int(repeats * blocks), round(goal / size * blocks)) if size else 0
        plans.append(Source(k, name, size, blocks, goal, slots))
    return plans


def slots(spark, sources: list[Source], shards: int = OUTPUT_SHARDS, seed: int = SEED) -> DataFrame:
    """The mix: ``shard, place, source_number, block`` for every slot, made where it is used.

    Tasks are ranges of a source's slots, so a source of any size is spread over the cluster.
    """
    counts = shard_counts([s.slots for s in sources], shards, seed)
    ends = np.cumsum(counts, axis=0)  # by shard and source, the last slot of that source
    blocks = np.array([s.blocks for s in sources], np.int64)
    before = np.cumsum(counts, axis=1) - counts  # places in a shard before a source's slots
    step = 1 << 16
    tasks = [(s.number, a, min(a + step, s.slots)) for s in sources for a in range(0, s.slots, step)]
    schema = pa.schema([("shard", pa.int32()), ("place", pa.int64()), ("source_number", pa.int32()), ("block", pa.int64())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, a, b in zip(*(batch.column(c).to_pylist() for c in ("number", "a", "b")), strict=True):
                j = np.arange(a, b)
                turn = j // blocks[number]
                block = np.empty(len(j), np.int64)
                for t in np.unique(turn):
                    own = turn == t
                    key = seed * 1_000_003 + number * 65_537 + int(t)
                    block[own] = _permuted(j[own] % blocks[number], int(blocks[number]), key)
                shard = np.searchsorted(ends[:, number], j, side="right")
                first = np.where(shard > 0, ends[np.maximum(shard - 1, 0), number], 0)
                place = before[shard, number] + j - first
                yield rows(schema, [shard.astype(np.int32), place, np.full(len(j), number, np.int32), block])

    wanted = spark.createDataFrame(tasks, "number int, a long, b long")
    return wanted.repartition(min(max(len(tasks), 1), 10_000)).mapInArrow(
        draw, "shard int, place long, source_number int, block long"
    )


def _drawn(docs: DataFrame, block: int, shards: int, seed: int, more: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """The documents with their places (``source_number, _begin``) and plans, and the mix, written (see ``mix``)."""
    spark = docs.sparkSession
    staged = written(sized(docs, more=more), "sizes")
    sources = plan(staged, block)
    named = spark.createDataFrame(
        [(s.number, s.name, s.size, s.target) for s in sources],
        "source_number int, _s string, _source_size long, _target double",
    )
    placed = _begins(staged).join(named, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    placed = written(placed, "spans")
    first, last = F.expr(f"_begin div {block}"), F.expr(f"(_begin + _size - 1) div {block}")
    cut = placed.where("_size > 0").select(
        "doc_id", "source_number", "_begin", "_size", F.explode(F.sequence(first, last)).alias("block")
    )
    begin = F.greatest(F.col("_begin"), F.col("block") * block)
    end = F.least(F.col("_begin") + F.col("_size"), (F.col("block") + 1) * block)
    cut = cut.withColumns({"from_word": begin - F.col("_begin"), "to_word": end - F.col("_begin")})
    drawn = written(slots(spark, sources, shards, seed), "slots")
    # the mix is written, and what it takes of each document is read from it
    output = written(
        drawn.join(cut, ["source_number", "block"]).select(
            "shard", "place", "source_number", "block", "doc_id", "_begin", "from_word", "to_word"
        ),
        "mix",
    )
    return placed, output


def mix(docs: DataFrame, block: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents with what the mix takes of each, and the mix itself.

    First: a row per row of ``docs`` with ``doc_id``, ``_order`` (hash of doc_id and text),
    ``_size``, ``_source_size``, ``_target`` (its source's) and ``_taken`` (words, repeats counted).  Second, written: ``shard, place, source_number,
    block, doc_id, _begin, from_word, to_word``, the words that make up each slot; ``_taken`` is summed from it.

    Sizes are counted in words of the whole text; null and empty texts have none and are never
    taken.  Null is a source of its own and the last.  A source without words has target 0.
    """
    placed, output = _drawn(docs, block, shards, seed)
    taken = output.groupBy("source_number", "_begin").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("_taken"))
    # a document with words is the only one that begins where it does; one without takes nothing
    result = placed.join(taken, ["source_number", "_begin"], "left").withColumn(
        "_taken", F.when(F.col("_size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(F.lit(0)).cast("long")
    )
    return result, output


def _pieces(text, begin, size, block: int):
    """``block, piece`` of each block that a text reaches into: its words there with the white space before them."""
    words = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")

    def piece(words, b):
        low = F.greatest(begin, b * block) - begin
        high = F.least(begin + size, (b + 1) * block) - begin
        # white space behind the last word stays with it
        count = F.when(high == size, F.size(words) - low).otherwise(high - low)
        return F.struct(b.alias("block"), F.array_join(F.slice(words, (low + 1).cast("int"), count.cast("int")), "").alias("piece"))

    blocks = F.sequence(F.floor(begin / block), F.floor((begin + size - 1) / block))
    # the outer function has the text split once, not for every block
    return F.get(F.transform(F.array(words), lambda w: F.transform(blocks, lambda b: piece(w, b))), F.lit(0))


def mixed_blocks(docs: DataFrame, block: int = BLOCK_WORDS, shards: int = OUTPUT_SHARDS, seed: int = SEED) -> DataFrame:
    """The mix with its texts: a row for each document in each slot.

    Columns are those of ``docs``, whose ``text`` is now the part of the document that the slot's
    block holds, and ``shard, place, from_word`` (with ``_`` behind them where ``docs`` has such a
    column): the slot and where in its document the part begins.  Parts of a document joined in the order of ``from_word`` are its whole text, white space included.
    Every row of ``docs`` is a document of its own; those without words are never taken.
    """

    def free(name: str) -> str:
        while name in docs.columns:
            name += "_"
        return name

    row = free("_row")
    # numbered once, as the texts are joined to the places of their rows
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    placed, output = _drawn(numbered, block, shards, seed, (row,))
    # the texts stand in a column of their own names, so that no name clashes
    whole = numbered.select(F.col(row).alias("_n"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_kept"), F.col("text").cast("string").alias("_text"))
    spans = placed.where("_size > 0").select(F.col(row).alias("_m"), "source_number", "_begin", "_size")
    joined = whole.join(spans, F.col("_n") == F.col("_m"))
    cut = F.inline(_pieces(F.col("_text"), F.col("_begin"), F.col("_size"), block))
    parts = joined.select("_kept", "source_number", "_begin", cut)
    found = output.select("shard", "place", "source_number", "block", "_begin", "from_word").join(parts, ["source_number", "block", "_begin"])
    columns = [F.col("piece").alias("text") if c == "text" else F.col(f"_kept.`{c}`").alias(c) for c in docs.columns]
    return found.select(*columns, *[F.col(c).alias(free(c)) for c in ("shard", "place", "from_word")])


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, repeats: float = REPEATS) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix of whole documents takes it.

    A document is the block here: the documents of a source stand in a pseudorandom order, all
    are taken as often as the target holds the whole source, and then once more from the front
    until the target is met.  So every source ends within half a document of its target, and no
    row occurs more than ``repeats`` times.  Texts without words are never taken; rows equal in
    doc_id and text are taken alike, as often as they would be on average.
    """
    spark = docs.sparkSession
    staged = written(sized(docs), "sizes")
    named = spark.createDataFrame(
        [(s.name, s.size, s.target) for s in plan(staged, BLOCK_WORDS, weights, repeats)], "_s string, _source_size long, _target double"
    )
    placed = _begins(staged.where("_size > 0")).join(named, F.col("_source").eqNullSafe(F.col("_s")))
    whole = F.floor(F.col("_target") / F.col("_source_size"))
    rest = F.col("_target") - whole * F.col("_source_size")
    copies = whole + (F.col("_begin") + F.col("_size") / 2 <= rest).cast("int")
    shares = placed.groupBy(F.col("doc_id").alias("_doc_id"), "_order").agg(F.round(F.avg(copies)).cast("int").alias("_copies"))
    rows_of = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("_d"), order_hash().alias("_o"))
    chosen = rows_of.join(shares.where("_copies > 0"), (F.col("_o") == F.col("_order")) & F.col("_d").eqNullSafe(F.col("_doc_id")))
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")
