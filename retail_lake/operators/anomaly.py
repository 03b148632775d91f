"""Anomaly detection with an isolation forest grown and applied by Spark tasks."""

import json
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retail_lake.functions.quantiles import exact_quantiles
from retail_lake.schema import ANOMALY_COLUMNS, ANOMALY_FEATURES
from retail_lake.staging import stage

# Forest settings.
TREES = 100
SAMPLE_ROWS = 256
CONTAMINATION = 0.05
SEED = 42

_HASH_SPAN = 2**40
_NODE_SCHEMA = "tree int, node int, feature int, cut double, path double"


def scaling(features: list[str]) -> Column:
    """Aggregate giving a struct (mean, std) per feature; population deviation, zero taken as one."""
    parts = []
    for c in features:
        spread = F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0))
        parts.append(F.struct(F.avg(c).alias("mean"), spread.alias("std")).alias(c))
    return F.struct(*parts)


def standardise(df: DataFrame, features: list[str] = ANOMALY_FEATURES) -> DataFrame:
    """Replace each feature by its distance from the mean in population deviations."""
    scaled = df.withColumn("_s", df.agg(scaling(features)).scalar())
    return scaled.withColumns(
        {c: (F.col(c) - F.col(f"_s.{c}.mean")) / F.col(f"_s.{c}.std") for c in features}
    ).drop("_s")


def mean_path(n):
    """Mean search depth in a random tree of n rows: the part of a path a leaf of n rows leaves out."""
    n = np.asarray(n, dtype=float)
    big = np.where(n > 2, n, 3.0)
    # 0.5772156649 is Euler's constant.
    grown = 2.0 * (np.log(big - 1.0) + 0.5772156649) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, grown, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees in heap order (children of i are 2i+1 and 2i+2) with the scaling of their inputs."""

    features: list[str]
    means: list[float]
    stds: list[float]
    sample_rows: int
    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    threshold: float | None = None


def _grower(per_tree: int, depth_limit: int, seed: int):
    """The per-tree function: at most ``per_tree`` rows in, the nodes of one tree out."""
    leaf_path = mean_path(np.arange(per_tree + 1))

    def grow(key, rows):
        tree = int(key[0])
        rng = np.random.default_rng([seed, tree])
        x = np.array(rows.sort_values("place")["x"].tolist(), dtype=float)
        nodes, open_nodes = [], [(0, 0, np.arange(len(x)))]
        while open_nodes:
            node, depth, member = open_nodes.pop()
            low, high = x[member].min(axis=0), x[member].max(axis=0)
            varying = np.flatnonzero(high > low)
            if depth >= depth_limit or len(member) < 2 or len(varying) == 0:
                nodes.append((tree, node, -1, 0.0, depth + float(leaf_path[len(member)])))
                continue
            f = int(rng.choice(varying))
            cut = float(rng.uniform(low[f], high[f]))
            right = x[member, f] > cut
            nodes.append((tree, node, f, cut, 0.0))
            open_nodes.append((2 * node + 1, depth + 1, member[~right]))
            open_nodes.append((2 * node + 2, depth + 1, member[right]))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "path"])

    return grow


def fit(
    df: DataFrame,
    keys: list[str],
    features: list[str] = ANOMALY_FEATURES,
    trees: int = TREES,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = SEED,
) -> Forest:
    """Grow the forest; ``keys`` identify a row.

    Every tree takes the rows with the smallest hash of (key, tree).  A first cut on the
    hash keeps about 1.5 x ``sample_rows`` rows per tree, so the shuffle carries
    trees x 384 rows however many rows there are, and each tree is grown by one task.
    """
    stats = df.agg(F.count(F.lit(1)).alias("n"), scaling(features).alias("s")).first()
    n = stats["n"]
    if n < 2:
        raise ValueError("an isolation forest needs at least two rows")
    means = [float(stats["s"][c]["mean"]) for c in features]
    stds = [float(stats["s"][c]["std"]) for c in features]
    per_tree = min(sample_rows, n)
    first_cut = int(_HASH_SPAN * min(1.0, 1.5 * per_tree / n + 64.0 / n))

    def place(tree):
        return F.pmod(F.xxhash64(*keys, tree, F.lit(seed)), F.lit(_HASH_SPAN))

    wanted = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: place(t) < first_cut)
    x = F.array(*[((F.col(c) - m) / s).cast("double") for c, m, s in zip(features, means, stds, strict=True)])
    members = df.select(*keys, x.alias("x"), F.explode(wanted).alias("tree")).withColumn("place", place(F.col("tree")))
    # Few bytes but much work per row, so the number of tasks is set rather than left to their size.
    tasks = min(trees, df.sparkSession.sparkContext.defaultParallelism)
    members = members.repartition(tasks, "tree")
    order = F.row_number().over(Window.partitionBy("tree").orderBy("place", *keys))
    members = members.withColumn("rank", order).where(F.col("rank") <= per_tree)

    depth_limit = int(np.ceil(np.log2(max(per_tree, 2))))
    # At most trees x 2^(depth + 1) nodes, whatever the size of the data.
    nodes = members.select("tree", "place", "x").groupBy("tree").applyInPandas(
        _grower(per_tree, depth_limit, seed), _NODE_SCHEMA
    ).toPandas()
    return _from_nodes(nodes, features, means, stds, per_tree, depth_limit, trees)


def _from_nodes(nodes, features, means, stds, per_tree, depth_limit, trees) -> Forest:
    shape = (trees, 2 ** (depth_limit + 1) - 1)
    feature, cut, path = np.full(shape, -1, dtype=np.int32), np.zeros(shape), np.zeros(shape)
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    feature[at], cut[at], path[at] = nodes["feature"], nodes["cut"], nodes["path"]
    return Forest(features, means, stds, per_tree, feature, cut, path)


def score(df: DataFrame, forest: Forest) -> DataFrame:
    """Add ``anomaly_score`` in (0, 1], higher for odder rows; only the features reach Python."""
    means, stds = np.array(forest.means), np.array(forest.stds)
    feature, cut, path = forest.feature, forest.cut, forest.path
    trees, width = feature.shape
    steps = int(np.log2(width + 1)) - 1
    scale = float(mean_path(forest.sample_rows))

    def depths(*columns: pd.Series) -> pd.Series:
        x = (np.column_stack([c.to_numpy(dtype=float) for c in columns]) - means) / stds
        row = np.arange(len(x))
        total = np.zeros(len(x))
        for t in range(trees):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(steps):
                f = feature[t, node]
                below = 2 * node + 1 + (x[row, np.maximum(f, 0)] > cut[t, node])
                node = np.where(f < 0, node, below)
            total += path[t, node]
        return pd.Series(2.0 ** (-total / trees / scale))

    udf = F.pandas_udf(depths, "double")
    return df.withColumn("anomaly_score", udf(*[F.col(c).cast("double") for c in forest.features]))


def flag(scored: DataFrame, threshold) -> DataFrame:
    """Add ``anomaly_flag``: 1 above the threshold."""
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold
    return scored.withColumn("anomaly_flag", (F.col("anomaly_score") > limit).cast("int"))


def detect(
    df: DataFrame, keys: list[str], contamination: float = CONTAMINATION, **settings
) -> tuple[DataFrame, Forest]:
    """Fit, score and flag the oddest share of the rows; returns the scored rows and the forest."""
    forest = fit(df, keys, **settings)
    scored = stage(score(df, forest))
    threshold = float(exact_quantiles(scored, "anomaly_score", [1.0 - contamination]).first()["q0"])
    return flag(scored, threshold), replace(forest, threshold=threshold)


def export_table(scored: DataFrame) -> DataFrame:
    """The exported anomaly table."""
    named = scored.withColumnsRenamed({"date": "Date", "product_category": "Product Category"})
    return named.select(*ANOMALY_COLUMNS)


def save(spark: SparkSession, forest: Forest, path: str) -> None:
    """Store the forest as two small parquet tables: nodes and settings."""
    tree, node = np.nonzero((forest.feature >= 0) | (forest.path > 0))
    nodes = pd.DataFrame(
        {
            "tree": tree.astype("int32"),
            "node": node.astype("int32"),
            "feature": forest.feature[tree, node],
            "cut": forest.cut[tree, node],
            "path": forest.path[tree, node],
        }
    )
    settings = {
        "features": forest.features, "means": forest.means, "stds": forest.stds,
        "sample_rows": forest.sample_rows, "threshold": forest.threshold, "shape": list(forest.feature.shape),
    }
    spark.createDataFrame(nodes, _NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(json.dumps(settings),)], "settings string").write.mode("overwrite").parquet(
        f"{path}/settings"
    )


def load(spark: SparkSession, path: str) -> Forest:
    s = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
    nodes = spark.read.parquet(f"{path}/nodes").toPandas()
    trees, width = s["shape"]
    depth_limit = int(np.log2(width + 1)) - 1
    forest = _from_nodes(nodes, s["features"], s["means"], s["stds"], s["sample_rows"], depth_limit, trees)
    return replace(forest, threshold=s["threshold"])
