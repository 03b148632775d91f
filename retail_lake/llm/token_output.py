"""Token ids in Parquet: sorted list columns, small row groups, page indexes.

Ids are dictionary encoded (a row group's dictionary holds at most the vocabulary), the plain
number columns delta encoded (version 2 pages).  Row groups and pages are small, and Parquet's
column and offset indexes are written, so a reader that filters on ``doc_id`` opens the pages
of those documents only, and metadata reads leave the ids alone.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retail_lake.llm import common
from retail_lake.llm.common import rows
from retail_lake.llm.tokens import WORD_BPE, Pieces, load, word_pieces

END = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
SLICE = 500

FILES = "part int, doc_id long, at long, n_tokens long, ids array<int>"


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """Upper ends of ranges of doc_id with about equally many rows each; reads that column only."""
    if parts < 2:
        return []
    quantiles = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile(
        "d", [k / parts for k in range(1, parts)], 0.1 / parts
    )
    return sorted({int(q) for q in quantiles or []})


def write_token_ids(docs: DataFrame, out: str, path: str = WORD_BPE, end: int = END, parts: int | None = None) -> str:
    """Encode ``text`` (null: empty), append ``end``, and write the ids in ascending doc_id order to ``out``.

    File k holds the k-th range of doc_id, sorted; rows with a null doc_id come first and rows
    of equal doc_id stand in no fixed order.  Columns: ``part`` (the file), ``doc_id``, ``at``
    (ids before the document in its file), ``n_tokens``, ``ids``.  Other columns of ``docs`` are
    not read.  Texts are encoded where they are read; the one shuffle moves packed ids.
    """
    parts = parts or common.partitions(docs.sparkSession)
    bounds = _bounds(docs, parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(load(path), word_pieces)
        kind = pieces.kind if end <= np.iinfo(pieces.kind).max else np.dtype("<u4")
        last = np.array([end], kind).tobytes()
        schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary())])
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                packed = pieces.packed([t or "" for t in batch.column("text").to_pylist()])
                if kind != pieces.kind:
                    packed = (np.frombuffer(b, pieces.kind).astype(kind).tobytes() for b in packed)
                ids = [b + last for b in packed]
                at = [0 if d is None else int(np.searchsorted(bounds, d)) for d in batch.column("doc_id").to_pylist()]
                yield rows(schema, [at, batch.column("doc_id"), [kind.itemsize == 4] * len(ids), ids])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
        before = 0
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                # all rows of one table are of one kind
                kind = np.dtype("<u4" if batch.column("wide")[0].as_py() else "<u2")
                packed = batch.column("ids").to_pylist()
                sizes = np.fromiter((len(b) // kind.itemsize for b in packed), np.int64, len(packed))
                ends = before + np.cumsum(sizes)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), kind).astype(np.int32)))
                yield rows(schema, [batch.column("part"), batch.column("doc_id"), ends - sizes, sizes, lists])
                before = int(ends[-1])

    encoded = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        encode, "part int, doc_id long, wide boolean, ids binary"
    )
    placed = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id").mapInArrow(place, FILES)
    (
        placed.write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("compression", "zstd")
        .parquet(out)
    )
    return out


def read_token_ids(spark: SparkSession, out: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The written rows, or those of ``low <= doc_id <= high``; the filter reaches the page indexes."""
    table = spark.read.schema(FILES).parquet(out)
    if low is not None:
        table = table.where(F.col("doc_id") >= low)
    if high is not None:
        table = table.where(F.col("doc_id") <= high)
    return table


def token_index(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files: place among all ids, count and checksum.

    ``start`` adds the totals of earlier files, one number a file, to the place in the file.
    """
    table = read_token_ids(spark, out)
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            lists = batch.column("ids")
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield rows(schema, [batch.column(c) for c in ("part", "doc_id", "at", "n_tokens")] + [sums])

    read = table.mapInArrow(check, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(starts, "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
