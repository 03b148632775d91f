"""Connected components of a graph given as rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.llm.common import written


def _mins(both: DataFrame) -> DataFrame:
    """The least neighbour of every node, itself included."""
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u``, ``v``: long); root is the least node reachable.

    Alternates the large-star and the small-star step until nothing changes.  Least neighbours
    are aggregates joined back, so that a hub's neighbours never meet in one task's memory.
    Rows with a null end and loops add nothing.
    """
    edges = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_mins(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        small = down.join(_mins(down), "u")
        edges = written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "stars",
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
