"""Document fingerprints: one-permutation MinHash in DataFrame expressions only.

The hash of each word shingle falls into a bin by its leading bits, and a bin keeps its least
hash.  An empty bin copies a filled one that it finds by probing bins in a pseudorandom order of
its own (optimal densification), the same order for every document.  Of each bin the low eight
bits are kept, eight bins to a number; likeness corrects for bins that agree by chance.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_lake.llm.common import SHINGLE_WORDS, partitions, written

#: 2^8 bins: the leading byte of a hash is its bin, its last byte is what is kept.
BINS = 256
BITS = 8
PROBES = 8
_PER_LONG = 64 // BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingle_hashes(text: Column, size: int) -> Column:
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(h: Column) -> Column:
        shingle = F.transform(
            F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])
        )
        none = F.array().cast("array<bigint>")
        return F.when(F.size(h) == 0, none).when(F.size(h) < size, F.array(F.xxhash64(h))).otherwise(shingle)

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashes)


def _bin(h: Column) -> Column:
    return F.shiftright(h, 64 - BITS).cast("int")


def _dense(firsts: Column) -> Column:
    """Every bin's value, from the least hashes of the filled bins."""
    half = BINS // 2

    def fill(sparse: Column) -> Column:
        def value(i: Column) -> Column:
            tries = [F.get(sparse, F.pmod(F.xxhash64(i, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(PROBES)]
            # past the first probes, the rest of the order is given by a rank of each filled bin
            ranked = F.transform(firsts, lambda x: F.struct(F.xxhash64(i, _bin(x)).alias("rank"), x.alias("x")))
            return F.coalesce(F.get(sparse, i), *tries, F.array_min(ranked)["x"])

        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)

    def spread(filled: Column) -> Column:
        at = lambda b: F.get(firsts, (F.array_position(filled, b) - 1).cast("int"))
        sparse = F.transform(F.sequence(F.lit(-half), F.lit(half - 1)), at)
        return let(sparse, fill)

    return F.when(F.size(firsts) == BINS, firsts).otherwise(let(F.transform(firsts, _bin), spread))


def _packed(dense: Column) -> Column:
    def number(j: Column) -> Column:
        parts = [
            F.shiftleft(F.get(dense, j * _PER_LONG + k).bitwiseAND(F.lit((1 << BITS) - 1)), BITS * k)
            for k in range(_PER_LONG)
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.bitwiseOR(part)
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)), number)


def fingerprint(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """Packed bins as an array of numbers; a text without words has an empty one."""

    def bins(ordered: Column) -> Column:
        firsts = F.filter(
            ordered, lambda x, i: (i == 0) | (F.shiftright(x, 64 - BITS) != F.shiftright(F.get(ordered, i - 1), 64 - BITS))
        )
        return F.when(F.size(ordered) == 0, ordered).otherwise(let(firsts, lambda f: let(_dense(f), _packed)))

    return let(F.sort_array(_shingle_hashes(text, size)), bins)


def as_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets; two texts without words are alike, one is like no other."""

    def differing(x: Column, y: Column) -> Column:
        # the lowest bit of each byte becomes the disjunction of that byte's bits
        folded = let(x.bitwiseXOR(y), lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 4)))
        folded = let(folded, lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 2)))
        folded = let(folded, lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 1)))
        return F.bit_count(folded.bitwiseAND(F.lit(0x0101010101010101)))

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda total, n: total + n)
    chance = 1.0 / (1 << BITS)
    estimate = ((1 - apart / F.lit(float(BINS))) - chance) / (1 - chance)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))
    )


def next_documents(ids: DataFrame) -> DataFrame:
    """``doc_id, next_id`` in descending order of distinct ids, null last; after the last comes the first.

    Ranges of ids are ordered side by side, and their first ids, one row a range, link them.
    """
    spark = ids.sparkSession
    down = F.col("doc_id").desc_nulls_last()
    ranged = written(
        ids.repartitionByRange(partitions(spark), down).withColumn("range", F.spark_partition_id()), "ranges"
    )
    # a struct, as the first id of a range may be null
    heads = ranged.groupBy("range").agg(F.max(F.struct("doc_id")).alias("head"))
    by_range = Window.orderBy("range")
    everything = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select(
        F.col("range").alias("r"), F.coalesce(F.lead("head").over(by_range), F.first("head").over(everything)).alias("after")
    )
    follow = F.lead(F.struct("doc_id")).over(Window.partitionBy("range").orderBy(down))
    linked = ranged.withColumn("follow", follow).join(after, F.col("range") == F.col("r"))
    return linked.select(*ids.columns, F.coalesce("follow", "after")["doc_id"].alias("next_id"))


def fingerprints_with_edits(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited form, one row per input row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of
    the next document's (or all of it), in descending order of doc_id; after the last comes the
    first.  Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.  Null texts are empty.  Rows with one doc_id have the same next
    document, and the one of them with the least text hash stands for them as the next; null
    doc_ids count as one id, the last.  Other columns are not read.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    # the least hash of a doc_id's texts says which stands for it; half: what its edited texts can take
    ids = own.groupBy("doc_id").agg(
        F.min(F.xxhash64("text")).alias("pick"), F.max(F.floor(F.char_length("text") / 2)).cast("int").alias("half")
    )
    linked = written(next_documents(ids), "next")
    picks = linked.select(F.col("doc_id").alias("p"), F.col("pick").alias("next_pick"))
    wanted = linked.join(picks, F.col("next_id").eqNullSafe(F.col("p"))).select(
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.isnull("doc_id").alias("no_id"),
        "half",
        F.coalesce("next_id", F.lit(0)).alias("n_id"),
        F.isnull("next_id").alias("n_no_id"),
        "next_pick",
    )
    # both joins read one exchange of the texts by these two columns, so fingerprints are made after it
    texts = own.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("no_id"), "text")
    prefixes = (
        texts.withColumnsRenamed({"id": "n_id", "no_id": "n_no_id"})
        .join(wanted, ["n_id", "n_no_id"])
        # written so that it does not become a key of the join
        .where(F.xxhash64("text").bitwiseXOR(F.col("next_pick")) == 0)
        .select("id", "no_id", F.expr("left(text, half)").alias("prefix"), fingerprint(F.col("text"), size).alias("next_packed"))
        .dropDuplicates(["id", "no_id"])
    )
    joined = texts.join(prefixes, ["id", "no_id"]).withColumn("doc_id", F.when(~F.col("no_id"), F.col("id")))
    edited = joined.withColumn("n_chars", F.char_length("text").cast("long")).withColumn(
        "edited",
        F.expr("concat(left(text, int(n_chars - n_chars div 2)), left(prefix, int(n_chars div 2)))"),
    )
    both = edited.withColumns(
        {"packed": fingerprint(F.col("text"), size), "edited_packed": fingerprint(F.col("edited"), size)}
    )
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("packed")).alias("fingerprint"),
        as_text(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
