"""Benchmark passages in documents: SimHash of windows, Hamming search, exact check.

A window can only be similar to an item if they share a word shingle, so windows of the item's
size are laid where a shingle of it occurs, at the place that shingle has in the item.  Words
put into a copy or left out of it change its size, so further windows reach from the beginning
of any run of the item's shingles to the end of any other; without repeated shingles the most
similar window is among them.  Each window's SimHash is
looked up among the items' in an index of several blocks of bits: two fingerprints within the
radius are within radius / blocks in at least one block, so the index misses none of them.
What it returns is checked by the exact Jaccard similarity of the two sets of shingles.  All shingles
weigh the same, so an item's similarity to a window does not hang on the other items.
"""

import re
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from retail_lake.llm.common import SHINGLE_WORDS, SIMILAR, WordHashes, rows, shingles

TOKEN = re.compile(r"\w+")
BLOCKS = 4
BLOCK_BITS = 16
#: At a similarity of 0.75 fingerprints differ in 11 of 64 bits, with a standard deviation of 3.
RADIUS = 20
#: Items that are held in a task's memory at once; more are searched in several passes.
ITEMS_AT_ONCE = 20_000
#: For bounds that are computed in floats.
SLACK = 1e-6


def words_of(text: str) -> list[bytes]:
    return [w.encode() for w in TOKEN.findall(text.lower())]


def simhash(own: np.ndarray) -> int:
    """Each bit is the majority of the distinct shingles' bits."""
    bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes = 2 * bits.sum(axis=0, dtype=np.int64) - len(own)
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "little")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles, each sorted and without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


class HammingIndex:
    """Fingerprints by their blocks of bits."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        self.blocks = []
        for k in range(BLOCKS):
            values, inverse = np.unique(self._block(prints, k), return_inverse=True)
            self.blocks.append((values, inverse))

    @staticmethod
    def _block(prints: np.ndarray, k: int) -> np.ndarray:
        return (prints >> np.uint64(k * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)

    def within(self, one: int) -> np.ndarray:
        """Places of all fingerprints within the radius."""
        own = np.array([one], np.uint64)
        near = np.zeros(len(self.prints), bool)
        for k, (values, inverse) in enumerate(self.blocks):
            close = np.bitwise_count(values ^ self._block(own, k)) <= self.radius // BLOCKS
            near |= close[inverse]
        at = np.nonzero(near)[0]
        return at[np.bitwise_count(self.prints[at] ^ own[0]) <= self.radius]


class Items:
    """The benchmark: shingles by hash with their places, fingerprints, and short items whole; equal texts are held once."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int, radius: int):
        table = WordHashes()
        self.ids, self.counts, self.sets, self.short = [], [], [], {}
        anchors: list[tuple[int, int, int]] = []
        place: dict[bytes, int] = {}
        for item_id, text in items:
            words = words_of(text or "")
            hashes = shingles(words, table, size)
            if len(words) < size:
                if words:
                    self.short.setdefault(int(hashes[0]), []).append(item_id)
                continue
            k = place.setdefault(b" ".join(words), len(self.ids))
            if k < len(self.ids):
                self.ids[k].add(item_id)
                continue
            anchors += [(h, k, j) for j, h in enumerate(hashes.tolist())]
            self.ids.append({item_id})
            self.counts.append(len(words))
            self.sets.append(np.unique(hashes))
        self.counts = np.array(self.counts, np.int64)
        self.distinct = np.array([len(own) for own in self.sets], np.int64)
        prints = [simhash(own) for own in self.sets]
        self.index = HammingIndex(np.array(prints, np.uint64), radius)
        anchors.sort()
        self.anchor_hash = np.array([a[0] for a in anchors], np.uint64)
        self.anchor_item = np.array([a[1] for a in anchors], np.int64)
        self.anchor_at = np.array([a[2] for a in anchors], np.int64)

    def matches(self, words: list[bytes], table: WordHashes, size: int, least: float) -> dict[int | None, tuple[float, int]]:
        """Items found in a text with their best similarity and the first word of that window."""
        hashes = shingles(words, table, size)
        best: dict[int | None, tuple[float, int]] = {}
        if not len(hashes):
            return best
        if len(words) < size:
            return {i: (1.0, 0) for i in self.short.get(int(hashes[0]), [])}
        low = np.searchsorted(self.anchor_hash, hashes, side="left")
        many = np.searchsorted(self.anchor_hash, hashes, side="right") - low
        at = np.nonzero(many)[0]
        if not len(at):
            return best
        first = np.repeat(low[at], many[at])
        turn = np.arange(len(first)) - np.repeat(np.cumsum(many[at]) - many[at], many[at])
        anchor, where = first + turn, np.repeat(at, many[at])
        laid = self._windows(hashes, anchor, where, len(words), size, least)
        for (a, w), group in groupby(laid, key=lambda r: r[:2]):
            window, own = np.unique(hashes[a : a + w - size + 1]), {k for _, _, k in group}
            for k in self.index.within(simhash(window)).tolist():
                # only items that laid the window, so that no item's result hangs on which others are held
                alike = similarity(window, self.sets[k]) if k in own else 0.0
                if alike < least:
                    continue
                for item_id in self.ids[k]:
                    if alike > best.get(item_id, (0.0, 0))[0]:
                        best[item_id] = (alike, a)
        return best

    def _windows(self, hashes: np.ndarray, anchor: np.ndarray, where: np.ndarray, n: int, size: int, least: float) -> list:
        """First word and number of words of the windows that can be similar to an item, and that item."""
        item, rank = self.anchor_item[anchor], np.unique(hashes, return_inverse=True)[1]
        # a window is at most as similar to an item as the share of its shingles that the text holds
        seen = np.unique(item * len(hashes) + rank[where]) // len(hashes)
        likely = np.bincount(seen, minlength=len(self.ids)) >= least * self.distinct - SLACK
        kept = np.nonzero(likely[item])[0]
        if not len(kept):
            return []
        kept = kept[np.lexsort((where[kept], item[kept]))]
        item, where, anchor = item[kept], where[kept], anchor[kept]
        width = np.minimum(self.counts[item], n)
        start = np.clip(where - self.anchor_at[anchor], 0, n - width)
        found = [np.stack([start, width, item], 1)]
        for places in np.split(np.arange(len(item)), np.nonzero(np.diff(item))[0] + 1):
            k = item[places[0]]
            for own in between(np.unique(where[places]), least * self.distinct[k], (self.counts[k] - size + 1) / least, size):
                found.append(np.insert(own, 2, k, axis=1))
        return np.unique(np.concatenate(found), axis=0).tolist()


def between(places: np.ndarray, fewest: float, most: float, size: int) -> Iterator[np.ndarray]:
    """First word and number of words from the beginning of a run of ``places`` to the end of the same or a later one.

    Windows hold ``fewest`` of the places or more and no more than ``most`` shingles.
    """
    cut = np.nonzero(np.diff(places) > 1)[0]
    begins, ends = np.append(0, cut + 1), np.append(cut, len(places) - 1)
    for run, at in enumerate(begins.tolist()):
        last = int(np.searchsorted(places[ends], places[at] + most - 1 + SLACK, side="right"))
        end = ends[run:last]
        end = end[end - at + 1 >= fewest - SLACK]
        if len(end):
            yield np.stack([np.full(len(end), places[at]), places[end] - places[at] + size], 1)


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE_WORDS, least: float = SIMILAR / 100, radius: int = RADIUS
) -> DataFrame:
    """``doc_id, item_id, similarity, start_word``: benchmark items that occur in documents.

    One row per document row and item with the best window's similarity (Jaccard of the sets
    of 5-word shingles, words in lower case without punctuation) of ``least`` or more.  Items of
    fewer than ``size`` words match only a text that consists of those words.  Null and empty
    texts on either side match nothing; null ids are carried as they are; repeated items with
    one id count once.  Columns beyond ``doc_id, text`` and ``item_id, text`` are not read.

    Tasks hold ``ITEMS_AT_ONCE`` items; a larger benchmark is searched in several passes, whose
    matches are merged, so their number does not show in the result.
    """
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    searched = [_search(texts, items, k, size, least, radius) for k, items in enumerate(_passes(benchmark))]
    return _merged(reduce(DataFrame.unionAll, searched))


def without_benchmark(
    docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE_WORDS, least: float = SIMILAR / 100, radius: int = RADIUS
) -> DataFrame:
    """The rows of ``docs``, all columns, in which ``benchmark_matches`` finds nothing; no row is shuffled."""
    for items in _passes(benchmark):
        docs = _clean(docs, items, size, least, radius)
    return docs


def _passes(benchmark: DataFrame) -> Iterator[list]:
    """The items in lists of about ``ITEMS_AT_ONCE`` at most."""
    count = benchmark.count()
    # hashes spread items unevenly: twice as many lists leave room
    passes = 1 if count <= ITEMS_AT_ONCE else -(-2 * count // ITEMS_AT_ONCE)
    own = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    dealt = own.withColumn("pass", F.pmod(F.xxhash64("text"), F.lit(passes)))
    for k in range(passes):
        yield [(r["item_id"], r["text"]) for r in dealt.where(F.col("pass") == k).collect()]


def _clean(docs: DataFrame, items: list, size: int, least: float, radius: int) -> DataFrame:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = Items(items, size, radius), WordHashes()
        for batch in batches:
            good = [not known.matches(words_of(t or ""), table, size, least) for t in batch.column("text").to_pylist()]
            yield batch.select(["row"]).filter(pa.array(good))

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = docs.select(F.col("text").cast("string").alias("text"), whole).mapInArrow(clean, StructType([StructField("row", docs.schema)]))
    return kept.select("row.*")


def _merged(found: DataFrame) -> DataFrame:
    """The best window of each document row and item, whichever passes found texts of that item.

    Rows equal in doc_id and text match alike in a pass; they are counted and laid out again.
    """
    keys = ["doc_id", "text_hash", "item_id"]
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("back"))).alias("best")
    by_pass = found.groupBy(*keys, "pass").agg(best, F.count("*").alias("n"))
    merged = by_pass.groupBy(*keys).agg(F.max("best").alias("best"), F.max("n").alias("n"))
    each = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return each.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start_word"))


def _search(texts: DataFrame, items: list, turn: int, size: int, least: float, radius: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.float64(), pa.int64(), pa.int32()]
        schema = pa.schema(list(zip(["doc_id", "text_hash", "item_id", "similarity", "start_word", "pass"], kinds, strict=True)))
        known, table = Items(items, size, radius), WordHashes()
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")]
            for doc_id, text_hash, text in zip(*columns, strict=True):
                found = known.matches(words_of(text or ""), table, size, least)
                out += [(doc_id, text_hash, item, alike, at, turn) for item, (alike, at) in found.items()]
            if out:
                yield rows(schema, [list(c) for c in zip(*out, strict=True)])

    return texts.mapInArrow(search, "doc_id long, text_hash long, item_id long, similarity double, start_word long, pass int")
