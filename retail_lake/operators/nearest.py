"""Nearest vectors by cosine similarity: an exact join of blocks, and a stored index of hash tables."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from retail_lake.functions.encode import or_one
from retail_lake.staging import stage, work_path

#: Bytes of vectors that one row of a packed table holds.
BLOCK_BYTES = 2 << 20


def vector_report(vectors: DataFrame, vector: str) -> DataFrame:
    """One row: how many rows there are, how many lack a vector (null, empty or with a null in it), and their kinds."""
    lacking = F.coalesce(F.size(vector) <= 0, F.lit(True)) | F.exists(vector, lambda x: x.isNull())
    zero = F.forall(vector, lambda x: x == 0)
    return vectors.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(lacking).alias("without_vector"),
        F.count_if(~lacking & zero).alias("zero_vectors"),
        F.min(F.when(~lacking, F.size(vector))).alias("least_dimensions"),
        F.max(F.when(~lacking, F.size(vector))).alias("most_dimensions"),
    )


def _usable(vectors: DataFrame, name: str, vector: str, *more: str) -> DataFrame:
    """Rows with a whole vector as ``v``; floats stay floats, which take half the room."""
    whole = (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    return vectors.where(whole).select(name, F.col(vector).cast(kind).alias("v"), *more)


def _packed(vectors: DataFrame, name: str, vector: str, parts: int, block_bytes: int, hashes: str | None = None) -> DataFrame:
    """Vectors in blocks: ``part, dimensions, ids, kind, matrix, hashes``; no row leaves its task for it."""
    kind = to_arrow_type(vectors.schema[name].dataType)
    schema = pa.schema(
        [("part", pa.int32()), ("dimensions", pa.int32()), ("ids", pa.list_(kind)), ("kind", pa.string())]
        + [("matrix", pa.binary()), ("hashes", pa.binary())]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        held: dict[int, tuple[list, list, list]] = {}

        def row(width: int) -> pa.RecordBatch:
            nonlocal block
            ids, chunks, keys = held.pop(width)
            x = np.vstack(chunks)
            block += 1
            columns = [[block % parts], [width], [ids], [x.dtype.str], [x.tobytes()], [np.concatenate(keys).tobytes() if keys else None]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            vectors_of, names = batch.column("v"), batch.column(name).to_pylist()
            ends = vectors_of.offsets.to_numpy()
            flat, widths = vectors_of.values.to_numpy(zero_copy_only=False), np.diff(ends)
            own = np.array(batch.column(hashes).to_pylist(), np.int64) if hashes and batch.num_rows else None
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                rows = flat[ends[at][:, None] + np.arange(width)]
                step = max(1, block_bytes // (8 * width))
                for k in range(0, len(at), step):
                    ids, chunks, keys = held.setdefault(width, ([], [], []))
                    ids.extend(names[j] for j in at[k : k + step])
                    chunks.append(rows[k : k + step])
                    if own is not None:
                        keys.append(own[at[k : k + step]])
                    if len(ids) >= step:
                        yield row(width)
        for width in list(held):
            yield row(width)

    kind_name = vectors.schema[name].dataType.simpleString()
    usable = _usable(vectors, name, vector, *([hashes] if hashes else []))
    return usable.mapInArrow(pack, f"part int, dimensions int, ids array<{kind_name}>, kind string, matrix binary, hashes binary")


class _Nearest:
    """The k nearest so far of each query of a block."""

    def __init__(self, names: pa.Array, k: int, least_similarity: float):
        self.names, self.k, self.floor = names, k, least_similarity - 1e-9
        self.least: np.ndarray | None = None
        self.owner, self.value = np.zeros(0, np.int64), np.zeros(0)
        self.ids: pa.Array | None = None

    def add(self, similarity: np.ndarray, ids: pa.Array, hashes: tuple[np.ndarray, np.ndarray] | None) -> None:
        """Rows of ``similarity`` are neighbours, columns queries; with ``hashes`` only pairs that share one count."""
        n, queries = similarity.shape
        if self.least is None:
            self.least = np.full(queries, -np.inf)
            if hashes is not None:
                shared = np.zeros(similarity.shape, bool)
                for a, b in zip(hashes[0].T, hashes[1].T, strict=True):
                    shared |= a[:, None] == b[None, :]
                similarity = np.where(shared, similarity, -np.inf)
            least = np.partition(similarity, n - min(self.k, n), axis=0)[n - min(self.k, n)]
        else:
            least = self.least
        # rounding may lift a value to the least kept one
        row, owner = np.nonzero(similarity >= np.maximum(least - 1e-9, self.floor))
        if hashes is not None and len(row):
            shared = (hashes[0][row] == hashes[1][owner]).any(axis=1)
            row, owner = row[shared], owner[shared]
        if not len(row):
            return
        value = np.concatenate([self.value, np.round(similarity[row, owner], 9)])
        owner = np.concatenate([self.owner, owner])
        found = ids.take(pa.array(row))
        found = found if self.ids is None else pa.concat_arrays([self.ids, found])
        order = np.lexsort((np.unique(found.to_numpy(zero_copy_only=False), return_inverse=True)[1], -value, owner))
        starts = np.searchsorted(owner[order], np.arange(queries))
        kept = order[np.arange(len(order)) - starts[owner[order]] < self.k]
        self.owner, self.value, self.ids = owner[kept], value[kept], found.take(pa.array(kept))
        full = np.bincount(self.owner, minlength=queries) >= self.k
        lowest = np.full(queries, np.inf)
        np.minimum.at(lowest, self.owner, self.value)
        self.least = np.where(full, lowest, -np.inf)


def _nearest_by_blocks(
    corpus: DataFrame,
    queries: DataFrame,
    corpus_id: str,
    query_id: str,
    vectors: tuple[str, str],
    k: int,
    block_bytes: int,
    hashes: str | None = None,
    least_similarity: float = -2.0,
) -> DataFrame:
    """The k best of every query, by blocks; with ``hashes`` only of pairs that share one of them.

    The corpus moves once.  A task keeps the k best of each query over all its blocks, so what
    it sends on grows with the queries and not with the corpus.
    """
    spark = corpus.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _packed(corpus, corpus_id, vectors[0], parts, block_bytes, hashes)
    asked = stage(_packed(queries, query_id, vectors[1], 1, block_bytes, hashes).withColumn("asked_block", F.monotonically_increasing_id()))
    asked = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "dimensions", "asked_block", F.col("ids").alias("asked"),
        F.col("kind").alias("query_kind"), F.col("matrix").alias("query_matrix"), F.col("hashes").alias("query_hashes"),
    )
    query_kind, corpus_kind = queries.schema[query_id].dataType, corpus.schema[corpus_id].dataType
    schema = pa.schema([(query_id, to_arrow_type(query_kind)), (corpus_id, to_arrow_type(corpus_kind)), ("similarity", pa.float64())])

    def units(batch: pa.RecordBatch, j: int, count: int, side: str) -> np.ndarray:
        kind = np.dtype(batch.column(f"{side}kind")[j].as_py())
        x = np.frombuffer(batch.column(f"{side}matrix")[j].as_buffer(), kind).reshape(count, -1).astype(np.float64)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(length == 0, 1.0, length)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Nearest] = {}
        for batch in batches:
            for j in range(batch.num_rows):
                ids, names = batch.column("ids")[j].values, batch.column("asked")[j].values
                block = batch.column("asked_block")[j].as_py()
                if block not in best:
                    # a copy, which does not keep the whole batch
                    best[block] = _Nearest(pa.array(names.to_pylist(), names.type), k, least_similarity)
                similarity = units(batch, j, len(ids), "") @ units(batch, j, len(names), "query_").T
                keys = None
                if hashes:
                    keys = tuple(
                        np.frombuffer(batch.column(c)[j].as_buffer(), np.int64).reshape(count, -1)
                        for c, count in (("hashes", len(ids)), ("query_hashes", len(names)))
                    )
                best[block].add(similarity, ids, keys)
        for own in best.values():
            if own.ids is not None:
                columns = [own.names.take(pa.array(own.owner)), own.ids, pa.array(own.value)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    # its size before it is repeated for every part says nothing, so it must not be judged small by that
    pairs = blocks.join(asked.hint("merge"), ["part", "dimensions"]).drop("part", "dimensions")
    kinds = f"`{query_id}` {query_kind.simpleString()}, `{corpus_id}` {corpus_kind.simpleString()}, similarity double"
    return _ranked(pairs.mapInArrow(nearest, kinds), query_id, corpus_id, k)


def vector_top_k(
    corpus: DataFrame, queries: DataFrame, corpus_id: str, query_id: str, vector: str, k: int = 4, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The k nearest corpus vectors for every query vector, exactly: ``query_id, corpus_id, similarity, rank``.

    Both sides are packed into blocks; every block of queries meets every block of the corpus
    once, as a row of a join, whose task multiplies the two matrices and keeps k rows of each
    query.  Blocks of queries are dealt to all parts of the corpus, so the corpus moves once, and
    no vector passes the driver.  Only vectors of equal size are compared.  Rows without a vector
    are no neighbours; ``vector_report`` counts them.  Equal similarities (to nine decimals) rank
    by ``corpus_id``; a zero vector has similarity 0.
    """
    return _nearest_by_blocks(corpus, queries, corpus_id, query_id, (vector, vector), k, block_bytes)


def _ranked(near: DataFrame, query_id: str, corpus_id: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("similarity"), corpus_id))
    return near.withColumn("rank", place).where(F.col("rank") <= k)


@dataclass(frozen=True)
class VectorIndex:
    """Stored hash tables of a corpus and the projections they were made with."""

    path: str
    corpus_id: str


def _hashable(vectors: DataFrame, name: str, vector: str) -> DataFrame:
    """Vectors as they came (``v``) and unit vectors as MLlib takes them; a zero vector points nowhere and stays out."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    units = _usable(vectors, name, vector).withColumn("_length", length).where("_length > 0")
    scaled = F.transform("v", lambda x: x / or_one(F.col("_length")))
    # MLlib's functions fail on the rows left out; a generator is a barrier that keeps them behind the filter
    kept = units.select(F.inline(F.array(F.struct(F.col(name), "v", scaled.alias("scaled")))))
    return kept.select(name, "v", array_to_vector(F.col("scaled")).alias("unit"))


def _hashed(model: BucketedRandomProjectionLSHModel, units: DataFrame, name: str) -> DataFrame:
    """``name, v, hashes``: the hash of each table as a number."""
    told = model.transform(units)
    one = [vector_to_array(F.get("hashes", F.lit(i)))[0].cast("long") for i in range(model.getNumHashTables())]
    return told.select(name, "v", F.array(*one).alias("hashes"))


def write_vector_index(
    corpus: DataFrame, corpus_id: str, vector: str, path: str | None = None, bucket_length: float = 2.0, tables: int = 8, seed: int = 17
) -> VectorIndex:
    """Hash every vector into ``tables`` tables of random projections and store them.

    Wider buckets and more tables find more of the true neighbours and look at more candidates;
    vectors must all have the same size.
    """
    path = path or work_path(corpus.sparkSession, "vector_index")
    units = _hashable(corpus, corpus_id, vector)
    lsh = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed)
    model = lsh.fit(units)
    model.write().overwrite().save(f"{path}/projections")
    _hashed(model, units, corpus_id).write.mode("overwrite").parquet(f"{path}/hashed")
    return VectorIndex(path, corpus_id)


def index_top_k(
    spark: SparkSession,
    index: VectorIndex,
    queries: DataFrame,
    query_id: str,
    vector: str,
    k: int = 4,
    least_similarity: float = 0.0,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """About the k nearest stored vectors of every query: those that share a hash with it in some table.

    Candidates are measured exactly, by blocks as in ``vector_top_k``: a pair is looked at once
    however many hashes it shares, and no vector is repeated for its tables.  Neighbours of less
    than ``least_similarity`` are left out.  ``recall`` tells what share of the true neighbours
    is found.
    """
    model = BucketedRandomProjectionLSHModel.load(f"{index.path}/projections")
    stored = spark.read.parquet(f"{index.path}/hashed")
    asked = _hashed(model, _hashable(queries, query_id, vector), query_id)
    return _nearest_by_blocks(stored, asked, index.corpus_id, query_id, ("v", "v"), k, block_bytes, "hashes", least_similarity)


def recall(found: DataFrame, exact: DataFrame, query_id: str) -> DataFrame:
    """One row: queries, true neighbours, and the share of those for which something as near was found.

    Neighbours are compared by rank and similarity, so that one of several equally near vectors
    is as good as another.
    """
    own = found.select(query_id, "rank", F.col("similarity").alias("got"))
    both = exact.join(own, [query_id, "rank"], "left")
    hit = F.coalesce((F.col("got") >= F.col("similarity") - 1e-6).cast("int"), F.lit(0))
    return both.agg(F.countDistinct(query_id).alias("queries"), F.count(F.lit(1)).alias("neighbours"), F.avg(hit).alias("recall"))
