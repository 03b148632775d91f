import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retail_lake.functions import quantiles
from retail_lake.functions.quantiles import exact_quantiles, sketched_quantiles, sketches, values_at_ranks

PROBS = [0.0, 0.25, 0.5, 0.9, 0.95, 1.0]


def check(spark, values, partitions=3):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(partitions)
    got = list(exact_quantiles(df, "x", PROBS).first())
    np.testing.assert_allclose(got, np.percentile(values, [100 * p for p in PROBS]), rtol=1e-9, atol=1e-9)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_equals_linear_interpolation(spark, values):
    check(spark, values)


def test_one_value_holding_most_rows(spark):
    check(spark, [7.0] * 500 + list(range(200)))


def test_many_distinct_values(spark):
    check(spark, np.random.default_rng(1).normal(size=20_000), 16)


@pytest.mark.parametrize("cells", [2, 3, 1024])
def test_every_rank_of_awkward_values(spark, cells):
    """Widely spread, close and repeated values; few cells need many passes."""
    values = [2.0**k for k in range(-60, 61, 12)] + [-1.7e308, 1.7e308, 0.0, -0.5, 1.0, 1.0, np.nextafter(1, 2), -3.0, -3.0, 5e-324]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    ranks = list(range(len(values))) if cells > 2 else [0, 7, 11, 20]
    found = values_at_ranks(df, "x", min(values), max(values), ranks, cells)
    assert found == {r: sorted(values)[r] for r in ranks}


def test_infinite_values_and_nan_stand_at_the_ends(spark):
    df = spark.createDataFrame([(v,) for v in (float("inf"), 1.0, float("-inf"), 2.0, float("nan"))], "x double")
    got = list(exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0]).first())
    assert got[:4] == [-np.inf, 1.0, 2.0, np.inf] and np.isnan(got[4])


def test_nulls_are_left_out_and_no_rows_give_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert exact_quantiles(df, "x", [0.5]).first()["q0"] == pytest.approx(2.0)
    assert exact_quantiles(df.where(F.col("x").isNull()), "x", [0.5]).first()["q0"] is None


def test_passes_neither_sort_nor_move_values(spark, monkeypatch):
    """Only counted cells are exchanged."""
    plans = []
    monkeypatch.setattr(quantiles, "stage", lambda df: df)
    collect = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: (plans.append(self._jdf.queryExecution().executedPlan().toString()), collect(self))[1])
    df = spark.range(50_000).select((F.hash("id") / 1000).alias("x")).repartition(4)
    exact_quantiles(df, "x", PROBS)
    assert len(plans) >= 2
    for plan in plans:
        assert "Sort " not in plan and "Window" not in plan and "RangePartitioning" not in plan and "partial_count" in plan


def test_sketches_of_days_add_up(spark):
    rng = np.random.default_rng(3)
    values, days = np.concatenate([rng.lognormal(3, 2, 60_000), [7.0] * 20_000]), rng.integers(0, 30, 80_000)
    df = spark.createDataFrame(list(zip(days.tolist(), values.tolist(), strict=True)), "day int, x double").repartition(5)
    stored = sketches(df.union(spark.createDataFrame([(3, None), (4, float("nan"))], "day int, x double")), ["day"], "x").cache()
    assert stored.agg(F.sum("n")).first()[0] == 80_000 and stored.count() == 30
    for first, last in ((0, 29), (5, 11), (8, 8)):
        told = sketched_quantiles(stored.where(F.col("day").between(first, last)), [], PROBS).first()
        own = np.sort(values[(days >= first) & (days <= last)])
        assert told.n == len(own)
        for p, q in zip(PROBS, told.quantiles, strict=True):
            low, high = np.searchsorted(own, q, "left"), np.searchsorted(own, q, "right")
            assert q in own and low / len(own) - 0.005 <= p <= high / len(own) + 0.005
