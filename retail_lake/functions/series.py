"""Windows over dense daily series."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

RUN = "_run"
HISTORY = "_is_history"


def split_runs(df: DataFrame, date: str, history: int, span: int) -> DataFrame:
    """Cut every series into runs of ``span`` days, each led by the ``history`` days before it.

    A window that looks back at most ``history`` rows then gives the same answer inside a
    run as over the whole series, so one long series is spread over many tasks instead of
    one.  Drop the lead rows with :func:`drop_history` once the window columns are there.
    """
    if span <= history:
        raise ValueError("a run must be longer than the history it carries")
    day = F.unix_date(F.col(date))
    home = F.floor(day / span).cast("int")
    near_end = F.pmod(day, F.lit(span)) >= span - history
    runs = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_home", home).withColumn(RUN, F.explode(runs)).withColumn(
        HISTORY, F.col(RUN) != F.col("_home")
    ).drop("_home")


def drop_history(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HISTORY)).drop(RUN, HISTORY)


def run_window(key: str, date: str) -> WindowSpec:
    return Window.partitionBy(key, RUN).orderBy(date)


def previous(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the current one."""
    return w.rowsBetween(-n, -1)


def rolling_columns(value: str, w: WindowSpec, means: list[int], spread: list[int]) -> dict[str, Column]:
    """Means and sample deviations over each window in ``means``, max and min over ``spread``; today excluded."""
    out = {}
    for n in means:
        out[f"rolling_mean_{n}"] = F.avg(value).over(previous(w, n))
        out[f"rolling_std_{n}"] = F.coalesce(F.stddev_samp(value).over(previous(w, n)), F.lit(0.0))
    for n in spread:
        out[f"rolling_max_{n}"] = F.max(value).over(previous(w, n))
        out[f"rolling_min_{n}"] = F.min(value).over(previous(w, n))
    return out
