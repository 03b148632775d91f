"""What several operators share: staged tables, word shingles and small Arrow helpers."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from retail_lake.staging import work_path

#: Words of a text are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
#: Near duplicates have 100 * intersection >= SIMILAR * union.
SIMILAR = 75

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


#: Bytes of rows handed to Python at once; rows may hold whole groups.
BATCH_BYTES = "4m"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    Meanwhile batches of rows for Python are bounded in bytes, not in number alone.
    """
    spark, setting = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    path, before = work_path(spark, label), spark.conf.get(setting, None)
    spark.conf.set(setting, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(words: list[bytes], table: WordHashes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all word shingles in order; fewer words than ``size`` make one shingle of them all."""
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    x = one[:n] + np.uint64(size)
    for j in range(1, size):
        x = x * _STEP + one[j : j + n]
    return mixed(x)


def lower_words(text: bytes | None) -> list[bytes]:
    """Words after A-Z became a-z; ``bytes`` methods know ASCII only, just as the definition does."""
    return text.lower().split() if text else []


def byte_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows that share ``key``, from batches sorted by it."""
    current, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != current:
                yield current, held
                held = []
            current = row[key]
            held.append(row)
    if held:
        yield current, held
