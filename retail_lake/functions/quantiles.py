"""Quantiles: exact ones by narrowing intervals, approximate ones from stored sketches."""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_lake.staging import stage

#: Cells that an interval is cut into in one pass.
CELLS = 1024
#: Rank error of a sketch of ``2**k`` order: about 1.33 % at 200 and falling as 1/k; 0.17 % here (with 99 % confidence).
SKETCH_K = 1_600


@dataclass(frozen=True)
class _Interval:
    """Values between two that occur, ends included, and the ranks that lie in it."""

    low: float
    high: float
    before: int
    ranks: tuple[int, ...]


def _cell(v: Column, low: float, high: float, cells: int, by_ratio: bool) -> Column:
    """The cell of a value in an interval: equally wide ones, or ones that widen with the distance from its low end.

    Whatever the rounding, a larger value never falls into a lower cell, and the ends fall into
    the first and the last one.
    """
    width = high - low
    if math.isinf(width):  # the ends are further apart than a double can say
        share = (v / 2 - low / 2) / (high / 2 - low / 2)
    else:
        share = (v - low) / width
    if by_ratio:
        share = F.log2(share * 2.0**52 + 1) / F.lit(math.log2(2.0**52 + 1))
    return F.least(F.floor(share * cells), F.lit(cells - 1)).cast("int")


def values_at_ranks(values: DataFrame, column: str, low: float, high: float, ranks: list[int], cells: int = CELLS) -> dict[int, float]:
    """The values at given ranks (from 0) of a column of finite doubles between ``low`` and ``high``.

    All ranks are narrowed down together.  A pass counts, by partial aggregation in the tasks,
    how many values fall into each cell of each interval, with the least and the greatest of
    them; a rank then lies in one cell, whose own ends are the next interval.  Values are never
    sorted or moved, the driver sees at most ``cells`` rows for each rank, and a value that
    fills the column is found as fast as any other.  Cells of equal width and cells of equal
    ratio take turns, so that widely spread values need few passes too.
    """
    found: dict[int, float] = {}
    intervals = [_Interval(low, high, 0, tuple(ranks))]
    by_ratio = False
    v = F.col(column)
    while True:
        for i in intervals:
            if i.low == i.high:
                found.update(dict.fromkeys(i.ranks, i.low))
        intervals = [i for i in intervals if i.low != i.high]
        if not intervals:
            return found
        place = [
            F.when((v >= i.low) & (v <= i.high), F.struct(F.lit(k).alias("interval"), _cell(v, i.low, i.high, cells, by_ratio).alias("cell")))
            for k, i in enumerate(intervals)
        ]
        # ends of intervals are values and no value lies in two intervals
        lies_in_one = F.lit(False)
        for i in intervals:
            lies_in_one = lies_in_one | ((v >= i.low) & (v <= i.high))
        counted = (
            values.where(lies_in_one)
            .select(F.col(column).alias("v"), F.coalesce(*place).alias("place"))
            .groupBy("place.interval", "place.cell")
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        )
        narrowed: list[_Interval] = []
        rows = sorted(counted.collect(), key=lambda r: (r.interval, r.cell))
        before = [i.before for i in intervals]
        for r in rows:
            own = tuple(k for k in intervals[r.interval].ranks if before[r.interval] <= k < before[r.interval] + r.n)
            if own:
                narrowed.append(_Interval(r.low, r.high, before[r.interval], own))
            before[r.interval] += r.n
        intervals, by_ratio = narrowed, not by_ratio


def exact_quantiles(df: DataFrame, column: str, probs: list[float]) -> DataFrame:
    """One row with columns ``q0..qn``: the exact quantiles of ``column``, linearly interpolated; null without values.

    The column alone is staged, since every pass reads it.  Infinite values take their place at
    the ends, and NaN after them.
    """
    v = F.col(column).cast("double")
    values = stage(df.where(F.col(column).isNotNull()).select(v.alias("v")))
    finite = (F.abs("v") < math.inf) & ~F.isnan("v")
    seen = values.agg(
        F.count_if(F.col("v") == -math.inf).alias("below"),
        F.count_if(finite).alias("finite"),
        F.count_if(F.col("v") == math.inf).alias("above"),
        F.count(F.lit(1)).alias("all"),
        F.min(F.when(finite, F.col("v"))).alias("low"),
        F.max(F.when(finite, F.col("v"))).alias("high"),
    ).first()
    wanted = [(seen["all"] - 1) * p for p in probs] if seen["all"] else []
    ranks = sorted({r for w in wanted for r in (math.floor(w), math.ceil(w))})
    inside = [r - seen.below for r in ranks if seen.below <= r < seen.below + seen.finite]
    found = values_at_ranks(values.where(finite), "v", seen.low, seen.high, inside) if inside else {}

    def value(rank: int) -> float:
        if rank < seen.below:
            return -math.inf
        if rank < seen.below + seen.finite:
            return found[rank - seen.below]
        return math.inf if rank < seen.below + seen.finite + seen.above else math.nan

    result = []
    for w in wanted:
        a, b = value(math.floor(w)), value(math.ceil(w))
        result.append(a if a == b else a + (b - a) * (w - math.floor(w)))
    fields = ", ".join(f"q{i} double" for i in range(len(probs)))
    return df.sparkSession.createDataFrame([result or [None] * len(probs)], fields)


def sketches(df: DataFrame, keys: list[str], column: str, k: int = SKETCH_K) -> DataFrame:
    """``keys``, ``n`` and a mergeable quantile sketch of ``column`` for each group, to be stored.

    A sketch holds a few thousand values at most, however many went in.
    """
    v = F.col(column).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def sketched_quantiles(stored: DataFrame, keys: list[str], probs: list[float], k: int = SKETCH_K) -> DataFrame:
    """``keys``, ``n`` and an array ``quantiles``: those of all rows behind the stored sketches of each group.

    Any selection of the stored rows can be asked (days, categories); the rows themselves are
    not read.  Each quantile is a value that occurs, whose rank is right within the sketch's error.
    """
    merged = stored.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    asked = F.array(*[F.lit(float(p)) for p in probs])
    return merged.select(*keys, "n", F.kll_sketch_get_quantile_double("sketch", asked).alias("quantiles"))
