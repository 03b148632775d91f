"""CSV readers and writers for raw transactions.

Every reader of raw files binds values by the header of the file they stand in, so files may order
their columns freely, and keeps the text of each line that does not fit in the corrupt column.
"""

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from retail_lake.schema import (
    CORRUPT_COLUMN,
    RAW_COLUMNS,
    RAW_SCHEMA_CHECKED,
    missing_columns,
)
from retail_lake.staging import stage

# The functions that tasks run travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A field behind its comma: in quotes, with quotes inside doubled, or bare.
FIELD = r',("[^"]*+(?:""[^"]*+)*+"|[^",][^,]*+|)'
#: What a line is read with; the file and the place of its block in it.
LINE_COLUMNS = ["value", "file_path", "file_name", "block_start"]
#: What names a block of a file, and what its records are told with.
BLOCK = ["file_path", "block_start", "block_length"]
NAMED = ["file_path", "file_name", "block_start"]
#: Blocks whose states are sent to all tasks, some 100 bytes each; more are joined by a shuffle.
BLOCKS_SENT = 200_000
#: A line that begins outside quotes and ends inside: whole fields, then one that is not closed.
OPENS = re.compile(r'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?+,)*+"[^"]*+(?:""[^"]*+)*+\Z')
#: The rest of a quoted field up to its comma or the end of the line.
CLOSES = re.compile(r'[^"]*+(?:""[^"]*+)*+"[^,]*+(,?)')
CUT = pa.schema(
    [("file_path", pa.string()), ("file_name", pa.string()), ("block_start", pa.int64()), ("value", pa.string())]
    + [("place", pa.int64()), ("begins", pa.bool_()), ("ends", pa.bool_())]
)


def lines(reader, path: str) -> DataFrame:
    """The lines of the CSV files of a folder, by ``spark.read`` or ``spark.readStream``."""
    return reader.format("text").option("pathGlobFilter", "*.csv").load(path).select(
        # a byte order mark goes
        F.when(F.startswith("value", F.lit("\ufeff")), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value")).alias("value"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def _unquoted(field: Column) -> Column:
    inner = F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    return F.nullif(F.when(field.startswith('"'), inner).otherwise(field), F.lit(""))


def split_line(line: Column) -> Column:
    """The fields of a line, empty ones as null; null where quotes are not closed or stand inside a quoted field."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(FIELD), F.lit(1))
    return F.when(F.array_join(found, ",") == line, F.transform(found, _unquoted))


def _values(line: Column) -> Column:
    """As ``split_line``, but empty fields may be empty texts.

    Most lines have no quotes at all, or each field in quotes and no others: those are cut at their
    separators, without matching field by field.
    """
    inner = F.substring(line, F.lit(2), F.length(line) - 2)
    all_quoted = (F.length(line) >= 2) & line.startswith('"') & line.endswith('"')
    return (
        F.when(~F.contains(line, F.lit('"')), F.split(line, ",", -1))
        .when(all_quoted & ~F.contains(F.replace(inner, F.lit('","'), F.lit("")), F.lit('"')), F.split(inner, '","', -1))
        .otherwise(split_line(line))
    )


def headers(found: DataFrame) -> DataFrame:
    """``file_path, file_name, header, names`` of each file: its first line that is not blank, and its cleaned fields.

    Lines come in the order of their files, or with their ``place`` in the block.  Takes one pass
    over them.  The result is staged, so that its size is known when lines
    are joined to it: a small one is broadcast and the lines stay where they are, a large one
    is not, and adaptive joins split a large file.
    """
    first = (
        found.where((F.col("block_start") == 0) & (F.trim("value") != ""))
        .withColumn("place", F.col("place") if "place" in found.columns else F.monotonically_increasing_id())
        .groupBy("file_path", "file_name")
        .agg(F.min_by("value", "place").alias("header"))
    )
    # fixed rule of the headers: blanks and markdown stars around a name go
    clean = lambda name: F.regexp_replace(name, r"^[\s*]+|[\s*]+$", "")
    return stage(first.withColumn("names", F.coalesce(F.transform(split_line(F.col("header")), clean), F.array().cast("array<string>"))))


def bind(found: DataFrame, heads: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``lines`` by the names in their file's header (``heads``, from ``headers``).

    Returns ``columns`` as text, the corrupt column, ``file_path``, ``file_name`` and ``lacking``,
    those of ``columns`` that the file has not.  A line with other than the header's number of
    fields, or with quotes out of place, is kept whole in the corrupt column and has nulls
    elsewhere.  A line equal to its file's header is a header again; blank lines are no rows.
    """
    known = heads.select(
        "file_path",
        "header",
        F.size("names").alias("n_names"),
        F.array(*[F.array_position("names", c).cast("int") for c in columns]).alias("places"),
        F.filter(F.array(*map(F.lit, columns)), lambda c: ~F.coalesce(F.array_contains("names", c), F.lit(False))).alias("lacking"),
    )
    rows = (
        found.where(F.trim("value") != "")
        .join(known, "file_path", "left")
        .where(~F.col("value").eqNullSafe(F.col("header")))
        .withColumn("fields", _values(F.col("value")))
    )
    fits = F.coalesce(F.size("fields") == F.col("n_names"), F.lit(False))
    place = lambda i: F.get("places", F.lit(i))
    field = lambda i: F.get("fields", place(i) - 1)
    values = {c: F.when(fits & (place(i) > 0) & (field(i) != ""), field(i)) for i, c in enumerate(columns)}
    corrupt = F.when(~fits, F.col("value"))
    if CORRUPT_COLUMN in values:
        corrupt = F.coalesce(corrupt, values.pop(CORRUPT_COLUMN))
    return rows.select(
        *[v.alias(c) for c, v in values.items()], corrupt.alias(CORRUPT_COLUMN), "file_path", "file_name", "lacking"
    )


def _ends_open(line: str, is_open: bool) -> bool:
    """Whether a quoted field is open behind a line, if one was (``is_open``) or was not before it."""
    if is_open:
        rest = CLOSES.match(line)
        if rest is None:
            return True
        if not rest[1]:
            return False
        line = line[rest.end() :]
    return OPENS.match(line) is not None


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of lines of one block."""
    path = batch.column("file_path").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    start = batch.column("block_start").to_numpy(zero_copy_only=False)
    cuts = (np.nonzero((np.diff(path) != 0) | (np.diff(start) != 0))[0] + 1).tolist()
    yield from zip([0, *cuts], [*cuts, batch.num_rows], strict=True)


def _block_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: whether a quoted field is open behind it, for either state before it."""
    key, state = None, (False, True)

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(BLOCK, key, strict=True)) | {"from_closed": state[0], "from_open": state[1]}])

    for batch in batches:
        quoted = pc.fill_null(pc.match_substring(batch.column("value"), '"'), False)
        for begin, end in _runs(batch):
            own = tuple(batch.column(c)[begin].as_py() for c in BLOCK)
            if own != key:
                if key is not None:
                    yield told()
                key, state = own, (False, True)
            # a line without quotes leaves the state as it is
            for line in batch.column("value").slice(begin, end - begin).filter(quoted.slice(begin, end - begin)).to_pylist():
                state = (_ends_open(line, state[0]), _ends_open(line, state[1]))
    if key is not None:
        yield told()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each block, and the parts of records that reach out of it.

    ``begins`` and ``ends`` tell whether a part holds the begin and the end of its record.
    """
    key, is_open, begun, place, held = None, False, True, 0, []

    def part(ends: bool) -> dict:
        return {"value": "\n".join(held), "place": place - len(held), "begins": begun, "ends": ends}

    for batch in batches:
        for begin, end in _runs(batch):
            own = tuple(batch.column(c)[begin].as_py() for c in NAMED)
            out: list[dict] = []
            if own != key:
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(NAMED, key, strict=True)) | part(False)], schema=CUT)
                is_open = batch.column("open_before")[begin].as_py()
                if is_open is None:
                    raise ValueError(f"{own[0]}: files changed, or were split differently, while they were read")
                key, begun, place, held = own, not is_open, 0, []
            for line in batch.column("value").slice(begin, end - begin).to_pylist():
                held.append(line)
                place += 1
                if '"' in line:
                    is_open = _ends_open(line, is_open)
                if not is_open:
                    out.append(part(True))
                    begun, held = True, []
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(NAMED, key, strict=True)) | row for row in out], schema=CUT)
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(NAMED, key, strict=True)) | part(False)], schema=CUT)


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of the CSV files of a folder, which may hold line breaks in quotes; files are split like any text.

    Whether a line begins inside quotes hangs on all lines before it.  A first pass tells for each
    block how it ends, for either way it may begin; chaining these small rows gives the state
    before each block, and a second pass cuts the blocks into records side by side.  Parts of
    records that reach over blocks are put together again; a record must fit in memory, as any value.

    A quote opens a field only at the field's begin, so one inside a bare field is a character.  A
    quoted field that is never closed reaches to the end of its file, kept whole.  Lines end in
    ``\\n`` or ``\\r\\n``.  Returns ``LINE_COLUMNS`` and ``place``, the line of the block it begins at.
    """
    found = (
        spark.read.format("text").option("pathGlobFilter", "*.csv").option("lineSep", "\n").load(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.col("_metadata.file_block_length").alias("block_length"),
        )
    )
    # a byte order mark would hide a quote behind it
    mark = (F.col("block_start") == 0) & F.col("value").startswith("\ufeff")
    found = found.withColumn("value", F.when(mark, F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value")))
    states = found.mapInArrow(_block_states, "file_path string, block_start long, block_length long, from_closed boolean, from_open boolean")
    order = Window.partitionBy("file_path").orderBy("block_start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # a block that ends alike from both states decides, and each later one that turns the state turns it
    states = states.withColumn("turns", F.sum((F.col("from_closed") & ~F.col("from_open")).cast("int")).over(order))
    fixed = F.when(F.col("from_closed") == F.col("from_open"), F.struct(F.col("from_open").alias("state"), "turns"))
    known = F.last(fixed, ignorenulls=True).over(earlier)
    turned = F.coalesce(F.max("turns").over(earlier), F.lit(0)) - F.coalesce(known["turns"], F.lit(0))
    before = F.coalesce(known["state"], F.lit(False)) != (turned % 2 == 1)
    blocks = stage(states.withColumn("open_before", before).select(*BLOCK, "open_before"))
    if blocks.count() <= BLOCKS_SENT:
        known = found.join(F.broadcast(blocks), BLOCK, "left")
    else:
        numbered = found.withColumn("line", F.monotonically_increasing_id()).join(blocks, BLOCK, "left")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        known = numbered.repartition(parts, "file_path", "block_start").sortWithinPartitions("file_path", "block_start", "line")
    kind = "file_path string, file_name string, block_start long, value string, place long, begins boolean, ends boolean"
    parts = stage(known.select("value", *NAMED, "block_length", "open_before").mapInArrow(_cut, kind))

    # an end-part of a block stands before its begin-part
    order = Window.partitionBy("file_path").orderBy("block_start", "place")
    reaching = parts.where("NOT (begins AND ends)").withColumn("record", F.sum(F.col("begins").cast("int")).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("block_start", "place", "value")))
    whole = reaching.groupBy("file_path", "file_name", "record").agg(pieces.alias("p"))
    whole = whole.select(
        F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"),
        "file_path", "file_name", F.get("p", F.lit(0))["block_start"].alias("block_start"), F.get("p", F.lit(0))["place"].alias("place"),
    )
    records = parts.where("begins AND ends").select(*LINE_COLUMNS, "place").unionByName(whole)
    return records.withColumn("value", F.regexp_replace("value", "\r$", ""))


def read_raw(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns of all files as text, by name, and the corrupt column; a column that a file lacks is null there.

    ``multi_line`` reads values with line breaks in quotes, by ``quoted_records``.
    """
    # staged, as its headers and its rows are read
    found = stage(quoted_records(spark, path)) if multi_line else lines(spark.read, path)
    heads = headers(found)
    # as many rows as there are different column names
    names = heads.select(F.explode("names").alias("name")).where("name <> ''").distinct().collect()
    named = {r["name"] for r in names}
    columns = [c for c in RAW_COLUMNS if c in named] + sorted(named - set(RAW_COLUMNS))
    return bind(found, heads, columns).select(*[f"`{c}`" for c in columns if c != CORRUPT_COLUMN], CORRUPT_COLUMN)


def read_with_schema(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA_CHECKED) -> DataFrame:
    """Read the columns of a schema by name; rows that do not fit it keep their text in the corrupt column."""
    wanted = [f for f in schema.fields if f.name != CORRUPT_COLUMN]
    found = lines(spark.read, path)
    rows = bind(found, headers(found), [f.name for f in wanted])
    typed = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in wanted}
    bad = F.lit(False)
    for f in wanted:
        bad = bad | (F.col(f"`{f.name}`").isNotNull() & typed[f.name].isNull())
    whole = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in wanted]))
    corrupt = F.coalesce(CORRUPT_COLUMN, F.when(bad, whole))
    return rows.select(*[v.alias(c) for c, v in typed.items()], corrupt.alias(CORRUPT_COLUMN))


#: Types that inference tries, narrowest first; what fits none stays text.
INFERRED = ["int", "bigint", "double", "date", "timestamp", "boolean"]


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Read CSV files of unknown types by name, with the corrupt column; inference costs one more pass over the files.

    A column has the first of ``INFERRED`` that all its values fit; values are bound by the header
    of their own file, as everywhere in this module.
    """
    # staged, so that the lines are not split again for every type that is tried, nor for the result
    raw = stage(read_raw(spark, path))
    columns = [c for c in raw.columns if c != CORRUPT_COLUMN]
    if not columns:
        return raw
    # a bit for each type that some value of a column does not fit; one expression for all columns
    misfit = F.lit(0)
    for k, kind in enumerate(INFERRED):
        misfit = misfit + F.when(F.col("value").try_cast(kind).isNull(), 1 << k).otherwise(0)
    values = raw.select(F.posexplode(F.array(*[f"`{c}`" for c in columns])).alias("place", "value")).where("value IS NOT NULL")
    seen = {r.place: r.misfits for r in values.groupBy("place").agg(F.bit_or(misfit).alias("misfits")).collect()}
    every = (1 << len(INFERRED)) - 1
    kinds = [
        next((kind for k, kind in enumerate(INFERRED) if not seen.get(i, every) >> k & 1), "string") for i in range(len(columns))
    ]
    typed = [F.col(f"`{c}`").try_cast(k).alias(c) for c, k in zip(columns, kinds, strict=True)]
    return raw.select(*typed, CORRUPT_COLUMN)


def read_uploads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the uploads that have all columns, and ``file_name, lacking`` of the others.

    The rows are ``RAW_COLUMNS``, the corrupt column and ``file_name``.  All files are read together.
    """
    found = lines(spark.read, path)
    heads = headers(found)
    rows = bind(found, heads, RAW_COLUMNS).where(F.size("lacking") == 0)
    lacking = F.array_sort(F.array_except(F.array(*map(F.lit, RAW_COLUMNS)), "names"))
    judged = heads.select("file_name", lacking.alias("lacking"))
    return rows.drop("lacking", "file_path"), judged.where(F.size("lacking") > 0)


def check_headers(df: DataFrame) -> DataFrame:
    if lacking := missing_columns(df):
        raise ValueError(f"missing columns: {lacking}")
    return df


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> str:
    """Write a folder of CSV files with a header line each; blanks around values stay."""
    df.write.mode("overwrite").csv(
        path, header=True, quoteAll=quote_all, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return path


def copy_to_bronze(spark: SparkSession, source: str, target: str, multi_line: bool = False) -> str:
    """Land raw files unchanged in value, every field quoted; lines that do not fit land in the corrupt column."""
    return write_csv(read_raw(spark, source, multi_line), target, quote_all=True)
