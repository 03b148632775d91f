"""Spelling variants: words one edit apart, found in a sorted permuterm index.

A word marked with a terminator, ``word$``, is turned so that any chosen character stands last:
the rotation that starts behind that character.  Two words that differ in one replaced character
share the prefix before it, and a word with one character more has the *whole* rotation of the
shorter word as that prefix.  So every rotation is filed under its prefix without the last
character, and every rotation of the shorter kind under itself; a sort brings equal prefixes
together, and one scan of each group finds all pairs.  A group holds distinct words that differ
only in one character, so its size is bounded by the alphabet, however many rows there are, and
the scan keeps sums and the best two instead of pairs.
"""

import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_lake.llm.common import rows, written

TERMINATOR = "$"
LEAST_CHARS = 6
LEAST_COUNT = 5
#: A near word is taken for the right form when it is so many times as frequent.
FORM_TIMES = 5
#: One run in so many is damaged, for measuring.
DAMAGE_ONE_IN = 199
#: Words a task counts before it hands them on.
FLUSH_WORDS = 200_000


def typed_words(docs: DataFrame, least_chars: int = LEAST_CHARS, damage: int | None = DAMAGE_ONE_IN) -> DataFrame:
    """``word, n``: how often each word of at least ``least_chars`` code points occurs in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case.  ``damage``
    deletes one code point of every run whose CRC-32 with the doc_id it divides (a null doc_id is
    written as nothing).  Tasks count before the exchange; their table is handed on whenever it
    holds ``FLUSH_WORDS`` words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        held: dict[bytes, int] = {}
        # one byte a character: all that is no letter of the range becomes a question mark
        find = regex.compile(rb"[a-z\xc0-\xff]{%d,}" % least_chars).findall

        def handed_on() -> pa.RecordBatch:
            batch = rows(schema, [[w.decode("latin-1") for w in held], list(held.values())])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                own: dict[bytes, int] = {}
                for word in find(text.encode("latin-1", "replace").lower()):
                    own[word] = own.get(word, 0) + 1
                for word, n in own.items():
                    if damage:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_chars:
                                continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= FLUSH_WORDS:
                    yield handed_on()
        if held:
            yield handed_on()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """``key, word, n, kind``: all rotations of ``word$``, each under the key it is found by.

    ``kind`` is 0 for a whole rotation (the word itself lacks the edited character), 1 for a
    rotation without its last character, 2 for such a rotation whose dropped character repeats
    the one before it: deleting either gives the same word, so only the first counts as deletion.
    """
    marked = F.concat("word", F.lit(TERMINATOR))
    at = F.col("at")
    turned = F.concat(F.substring("marked", at, F.length("marked")), F.substring("marked", F.lit(1), at - 1))
    behind = F.concat(F.substring("marked", at + 1, F.length("marked")), F.substring("marked", F.lit(1), at - 1))
    repeats = (at > 1) & (F.substring("marked", at, F.lit(1)) == F.substring("marked", at - 1, F.lit(1)))
    dropped = F.struct(behind.alias("key"), F.when(repeats, 2).otherwise(1).alias("kind"))
    whole = F.struct(turned.alias("key"), F.lit(0).alias("kind"))
    # the terminator can have a character put in before it, but is never itself edited
    entries = F.when(at < F.length("marked"), F.array(whole, dropped)).otherwise(F.array(whole))
    placed = words.withColumn("marked", marked).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("marked"))))
    return placed.select("word", "n", F.explode(entries).alias("e")).select("e.key", "word", "n", "e.kind")


def _rank(n: Column, word: Column) -> Column:
    """Orders words by frequency, most frequent first, then by code points."""
    return F.struct((-n).alias("less"), word.alias("word"))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best``: number of words one edit away and the first of them in ``_rank`` order.

    ``words`` has distinct ``word`` with ``n``.  Every pair of near words meets under one key
    only, so the sums of the groups add up.
    """
    group = Window.partitionBy("key")
    ordered = group.orderBy("less", "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct("less", "word")
    kind = F.col("kind")
    scanned = (
        rotations(words)
        .withColumn("less", -F.col("n"))
        .select(
            "key", "word", "less", "kind",
            F.count("*").over(group).alias("members"),
            F.sum(F.when(kind > 0, 1)).over(group).alias("drops"),
            F.sum(F.when(kind == 1, 1)).over(group).alias("deletions"),
            F.max(F.when(kind == 0, own)).over(group).alias("shorter"),
            F.nth_value(F.when(kind > 0, own), 1, ignoreNulls=True).over(ordered).alias("first"),
            F.nth_value(F.when(kind > 0, own), 2, ignoreNulls=True).over(ordered).alias("second"),
            F.nth_value(F.when(kind == 1, own), 1, ignoreNulls=True).over(ordered).alias("first_deletion"),
        )
        .where("members > 1")
    )
    replaced = F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    shorter = F.when(kind == 1, F.col("shorter"))
    near = F.when(kind == 0, F.coalesce("deletions", F.lit(0))).otherwise(
        F.col("drops") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)
    )
    best = F.when(kind == 0, F.col("first_deletion")).otherwise(F.least(replaced, shorter))
    found = scanned.select("word", near.cast("long").alias("near"), best.alias("best")).where("near > 0")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for all words with a form (``word, form``); every step doubles the way gone.

    Forms are at least ``FORM_TIMES`` as frequent as their words, so there are no circles and
    ways are as long as the logarithm of the largest count.
    """
    way = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = way.join(further, "root", "left")
        if joined.where("next IS NOT NULL").isEmpty():
            return way
        way = written(joined.select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(
    docs: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_count: int = LEAST_COUNT,
    times: int = FORM_TIMES,
    damage: int | None = None,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the texts that occurs often enough.

    ``form`` is the near word of the largest count (ties: least in code-point order) if that is
    at least ``times`` the word's own, else null; ``root`` follows forms to the last.  Null and
    empty texts have no words, repeated rows count again, other columns are not read; an empty
    table gives no rows.
    """
    words = written(typed_words(docs, least_chars, damage).where(F.col("n") >= least_count), "words")
    near = near_words(words).select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.less")).alias("best_n"))
    is_form = F.col("best_n") >= times * F.col("n")
    told = written(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
        ),
        "variants",
    )
    roots = _roots(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
