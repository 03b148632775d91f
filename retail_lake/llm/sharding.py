"""Shards of near equal bytes by histogram sort.

Rows are ordered by a key of three 64-bit numbers (hashes of the text, of doc_id and of both), so equal texts stand together.  A small table of keys and byte sizes is written once;
each round counts the exact bytes below a set of probe keys in every task and adds the counts
up, then puts new probes between the two that bracket each wanted splitter, until the bytes
below a splitter are within the tolerance.  Only then are the rows exchanged, once.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_lake.llm.common import rows, written

SHARDS = 8
#: A shard may differ from an equal share by this part of it, where documents allow.
TOLERANCE = 0.005
#: Probes between the brackets of one splitter in a round.
PROBES = 32
#: Rounds that cut cells of many rows, after the splitters stand.
EVEN_ROUNDS = 2
_LEVELS = ("k1", "k2", "k3")
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1

Key = tuple[int, int, int]


@dataclass(frozen=True)
class Splitters:
    """``cells``: ascending lower ends of the cells; ``shard`` and ``rows_before`` (in the shard) of each."""

    cells: list[Key]
    shard: list[int]
    rows_before: list[int]
    rounds: int


def _size() -> Column:
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1


def _keys(docs: DataFrame) -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return [
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(3), doc_id).alias("k2"),
        F.xxhash64(F.lit(7), doc_id, F.col("text").cast("string")).alias("k3"),
    ]


def _below(keys: list[np.ndarray], probes: np.ndarray) -> np.ndarray:
    """The number of probes that are at most the key, for each key."""
    at = np.searchsorted(probes["k1"], keys[0], side="left")
    tied = np.isin(keys[0], probes["k1"])
    if tied.any():
        own = np.empty(int(tied.sum()), probes.dtype)
        for name, k in zip(_LEVELS, keys, strict=True):
            own[name] = k[tied]
        at[tied] = np.searchsorted(probes, own, side="right")
    return at


def _as_array(probes: list[Key]) -> np.ndarray:
    return np.array(probes, dtype=[(c, np.int64) for c in _LEVELS])


def _histogram(keyed: DataFrame, probes: list[Key]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows in the cells that the probes start; the first cell lies below all of them."""
    table = _as_array(probes)
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("bytes", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(table) + 1, np.int64), np.zeros(len(table) + 1, np.int64)
        for batch in batches:
            cell = _below([batch.column(c).to_numpy() for c in _LEVELS], table)
            np.add.at(n, cell, 1)
            np.add.at(total, cell, batch.column("size").to_numpy())
        cells = np.nonzero(n)[0]
        yield rows(schema, [cells.astype(np.int32), n[cells], total[cells]])

    counted = keyed.mapInArrow(count, "cell int, n long, bytes long").groupBy("cell").agg(F.sum("n"), F.sum("bytes"))
    n, total = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for cell, a, b in counted.collect():  # a row for each probe, however many rows were counted
        n[cell], total[cell] = a, b
    return n, total


def _between(low: Key, high: Key, count: int) -> list[Key]:
    """Keys that cut the open range evenly, on the first level at which its ends differ enough."""
    for level in range(3):
        a = low[level]
        b = high[level] if low[:level] == high[:level] else _HIGH
        if b - a > 1:
            steps = min(count, b - a - 1)
            cuts = [a + (b - a) * (k + 1) // (steps + 1) for k in range(steps)]
            rest = (_LOW,) * (2 - level)
            found = [(*low[:level], c, *rest) for c in cuts]
            return [k for k in sorted(set(found)) if low < k < high]
        if b - a == 1 and low[:level] == high[:level] and level < 2:
            # neighbours on this level: the range holds the rest of the lower one's rows
            edge = (*low[:level], b, *(_LOW,) * (2 - level))
            if low < edge < high:
                return [edge]
    return []


def splitters(keyed: DataFrame, shards: int, tolerance: float, pieces: int) -> Splitters:
    """Refine probes until every splitter is within tolerance or cannot move (a row is larger)."""
    start, end = (_LOW,) * 3, (_HIGH,) * 3
    cuts = shards * pieces
    known: dict[Key, tuple[int, int]] = {}
    wanted: list[float] = []
    probes = [(_LOW + (k * (1 << 64)) // (4 * cuts), _LOW, _LOW) for k in range(1, 4 * cuts)]
    rounds, evened = 0, 0
    fine: set[Key] = set()
    chosen: list[Key] = []
    while True:
        rounds += 1
        ordered = sorted({*known, *probes})
        n, total = _histogram(keyed, ordered)
        rows_below, bytes_below = np.cumsum(n[:-1]).tolist(), np.cumsum(total[:-1]).tolist()
        known = {k: (r, b) for k, r, b in zip(ordered, rows_below, bytes_below, strict=True)}
        all_rows, all_bytes = sum(n), sum(total)
        wanted = [all_bytes * k / shards for k in range(1, shards)]
        marks = [(start, 0, 0), *((k, *known[k]) for k in ordered), (end, all_rows, all_bytes)]
        values = [m[2] for m in marks]
        probes, keep, chosen = [], set(), []
        for goal in wanted:
            at = int(np.searchsorted(values, goal))
            low, high = marks[max(at - 1, 0)], marks[min(at, len(marks) - 1)]
            best = min((low, high), key=lambda m: abs(m[2] - goal))
            chosen.append(best[0])
            keep.update((low[0], high[0]))
            if abs(best[2] - goal) > tolerance * all_bytes / shards / 2 and high[1] - low[1] > 1:
                probes += _between(low[0], high[0], PROBES)
        if not probes and evened < EVEN_ROUNDS:
            # a cell of many rows (copies of one text) is cut by doc_id, so that several tasks rank it
            evened += 1
            for a, b in zip(marks[:-1], marks[1:], strict=True):
                if b[1] - a[1] > 4 * all_rows // cuts + 1:
                    probes += _between(a[0], b[0], PROBES)
            fine.update(probes)
        if not probes:
            break
        # evenly spread cells stay known: they later deal a shard's rows over several tasks
        known = {k: v for k, v in known.items() if k in keep or k in fine or k[1:] == (_LOW, _LOW)}
    cells = [start, *sorted(k for k in known)]
    below = [0, *(known[k][0] for k in cells[1:])]
    chosen = [k for k in chosen]
    shard, first, out = [], [], []
    for cell, before in zip(cells, below, strict=True):
        s = sum(c <= cell for c in chosen)
        if not shard or shard[-1] != s:
            base = before
        shard.append(s)
        first.append(before - base)
        out.append(cell)
    return Splitters(out, shard, first, rounds)


def histogram_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, pieces: int = 4) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row; law is ``bytes``.

    The shards' sums of ``size`` (UTF-8 bytes of the text, null: none, plus 1) are near equal:
    each splitter is within half the tolerance of its place, or the one row there is larger.
    Equal texts stay in one shard unless a splitter falls among them.  ``slot`` counts a shard's
    rows from 0 in key order; rows equal in doc_id and text may swap slots.  Null doc_ids
    are ids like others.  Columns beyond ``doc_id`` and ``text`` are not read.  ``pieces`` is
    the least number of tasks that fill one shard.  ``grown_shard`` is null under this law.
    """
    keyed = written(
        docs.select(
            F.col("doc_id").cast("long"),
            _size().alias("size"),
            F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
            *_keys(docs),
        ),
        "keys",
    )
    found = splitters(keyed.select(*_LEVELS, "size"), shards, tolerance, pieces)
    table = _as_array(found.cells[1:])
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "size", "text_crc32", *_LEVELS)] + [("cell", pa.int32()), ("shard", pa.int32()), ("before", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = np.array(found.shard, np.int32), np.array(found.rows_before, np.int64)
        for batch in batches:
            cell = _below([batch.column(c).to_numpy() for c in _LEVELS], table).astype(np.int32)
            yield rows(schema, [*(batch.column(c) for c in schema.names[:6]), cell, shard[cell], before[cell]])

    placed = keyed.select(*schema.names[:6]).mapInArrow(
        place, "doc_id long, size long, text_crc32 long, k1 long, k2 long, k3 long, cell int, shard int, before long"
    )
    rank = F.row_number().over(Window.partitionBy("shard", "cell", "before").orderBy(*_LEVELS))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + rank - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
