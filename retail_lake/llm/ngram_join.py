"""Exact Jaccard self-join on word n-grams through a token-group matrix.

Similar documents are put into groups, each group stores the union of its members' tokens, a
document's overlap with that union bounds its overlap with every member, and only groups whose
bound reaches the needed overlap are opened and compared exactly.

The tokens travel packed: a flush is a run of documents in one task, and for each range of token
hashes it sends one row with the tokens of all of them, 6 bytes a token and 3 for whose it is.

1. ``token_sets``: per document the number of its distinct shingles and a key of the set.
   Equal sets have equal keys and are one class.
2. Token ranges count how many sets hold a token and return to the flushes the tokens that two
   or more hold.  A set with too few of them has no partner: this exact test ends the work
   for nearly all documents.  (Copies in other flushes count too, which only lets more pass.)
3. What remains is sorted by min-hashes and cut into groups of bounded size.
4. The matrix: ranges of the rarest tokens of each class (so many that every partner must share
   one) hold the groups they occur in, and name the pairs of groups that can hold partners.
5. Each pair of groups: bound each member by the other group's union, open, count exactly.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.llm.common import (
    SHINGLE_WORDS,
    SIMILAR,
    WordHashes,
    byte_texts,
    lower_words,
    mixed,
    partitions,
    rows,
    runs,
    shingles,
    written,
)
from retail_lake.llm.graph import components

FLUSH_TOKENS = 1 << 20
FLUSH_DOCS = 60_000
#: Tokens that one range of hashes holds on average, and the least number of ranges.
RANGE_TOKENS = 1_000_000
RANGES = 64
GROUP_DOCS = 64
GROUP_LEAST = 16
GROUP_TOKENS = 1 << 17
#: Cells of the 0/1 matrices that are multiplied at once.
DENSE_CELLS = 1 << 22

SETS = "doc_id long, n_shingles long, key long"
#: A row of tokens: whose they are (places in the flush and counts), their low and middle bits, and how many
#: sets hold each.  A row without tokens is the flush's table: keys and sizes of its sets by place.
BLOCKS = "part int, flush long, places binary, counts binary, low binary, mid binary, seen binary, keys binary, sizes binary"
_BINARY = ("places", "counts", "low", "mid", "seen", "keys", "sizes")
_BLOCKS = pa.schema([("part", pa.int32()), ("flush", pa.int64())] + [(c, pa.binary()) for c in _BINARY])
CLASSES = "key long, n long, tokens binary, prefix binary, m1 long, m2 long"
GROUPS = "gid long, keys binary, sizes binary, weights binary, tokens binary, members binary, counts binary, prefix binary"
_GROUPS = pa.schema([("gid", pa.int64())] + [(c, pa.binary()) for c in ("keys", "sizes", "weights", "tokens", "members", "counts", "prefix")])


def needed(n: np.ndarray | int):
    """Least overlap of a set of ``n`` tokens with any set that is similar enough."""
    return -(-SIMILAR * n // 100)


def _set_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def token_sets(docs: DataFrame, size: int = SHINGLE_WORDS, hashed: bool = False) -> DataFrame:
    """``doc_id, n_shingles, key``: the size and a 64-bit key of each document's shingle set (null: empty).

    With ``hashed`` also ``text_hash``, which with the doc_id finds the rows again.
    """
    more = ["text_hash"] if hashed else []

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        schema = pa.schema([(c, pa.int64()) for c in ["doc_id", "n_shingles", "key", *more]])
        for batch in batches:
            found = [np.unique(shingles(lower_words(t), table, size)) for t in byte_texts(batch)]
            keys = [_set_key(t) if len(t) else None for t in found]
            yield rows(schema, [batch.column("doc_id"), [len(t) for t in found], keys, *[batch.column(c) for c in more]])

    told = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[text_hash().alias(c) for c in more])
    return told.mapInArrow(sets, ", ".join([SETS, *[f"{c} long" for c in more]]))


def text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def _blocks(flush: int, places, tokens: np.ndarray, of: np.ndarray, seen=None) -> Iterator[pa.RecordBatch]:
    """One row for each part in ``of``: the tokens and their owners' places, grouped by owner."""
    order = np.argsort(of, kind="stable")
    places, tokens, of = places[order], tokens[order], of[order]
    seen = None if seen is None else seen[order]
    starts = np.concatenate([[0], np.nonzero(np.diff(of))[0] + 1, [len(of)]]).tolist()
    out: dict[str, list] = {c: [] for c in _BLOCKS.names}
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        first = np.concatenate([[0], np.nonzero(np.diff(places[a:b]))[0] + 1])
        out["part"].append(int(of[a]))
        out["flush"].append(flush)
        out["places"].append(places[a:b][first].astype(np.uint16).tobytes())
        out["counts"].append(_counts_out(np.diff(np.append(first, b - a))))
        out["low"].append(tokens[a:b].astype(np.uint32).tobytes())
        out["mid"].append((tokens[a:b] >> np.uint64(32)).astype(np.uint16 if seen is None else np.uint32).tobytes())
        out["seen"].append(None if seen is None else np.minimum(seen[a:b], 65535).astype(np.uint16).tobytes())
        out["keys"].append(None)
        out["sizes"].append(None)
        if len(out["part"]) == 64:
            yield rows(_BLOCKS, list(out.values()))
            out = {c: [] for c in _BLOCKS.names}
    if out["part"]:
        yield rows(_BLOCKS, list(out.values()))


def _counts_out(counts: np.ndarray) -> bytes:
    """Counts in one byte each; 255 announces four more bytes at the end."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype(np.uint32).tobytes()


def _counts_in(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    if len(data) > n:
        counts[counts == 255] = np.frombuffer(data[n:], np.uint32)
    return counts


def _tokens_in(row: dict, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Owner's place and token, side by side."""
    places = np.frombuffer(row["places"], np.uint16)
    low = np.frombuffer(row["low"], np.uint32).astype(np.uint64)
    mid = np.frombuffer(row["mid"], np.uint32 if wide else np.uint16).astype(np.uint64)
    return np.repeat(places, _counts_in(row["counts"], len(places))), (mid << np.uint64(32)) | low


def _token_blocks(docs: DataFrame, parts: int, size: int) -> DataFrame:
    """The distinct tokens of all documents, dealt by their leading bits; copies within a flush go once.

    Parts from ``parts`` on are the flushes' tables.
    """

    def emit(held, nth: int):
        keys = np.array([k for k, _ in held], np.int64)
        sizes = np.array([len(t) for _, t in held], np.int64)
        # a name of its own for the flush, the same if the task runs again
        seed = (TaskContext.get().partitionId() << 32) + nth
        flush = xxhash.xxh3_64_intdigest(keys.tobytes(), seed=seed) - (1 << 63)
        none = [None] * (len(_BINARY) - 2)
        yield rows(_BLOCKS, [[parts], [flush], *([v] for v in none), [keys.tobytes()], [sizes.astype(np.uint32).tobytes()]])
        tokens = np.concatenate([t for _, t in held])
        of = (((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint16)
        yield from _blocks(flush, np.repeat(np.arange(len(held)), sizes), tokens, of)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, total, known, nth = WordHashes(), [], 0, set(), 0
        for batch in batches:
            for text in byte_texts(batch):
                tokens = np.unique(shingles(lower_words(text), table, size))
                if not len(tokens) or (key := _set_key(tokens)) in known:
                    continue
                known.add(key)
                held.append((key, tokens))
                total += len(tokens)
                if total >= FLUSH_TOKENS or len(held) >= FLUSH_DOCS:
                    yield from emit(held, nth)
                    held, total, known, nth = [], 0, set(), nth + 1
        if held:
            yield from emit(held, nth)

    return docs.select(F.col("text").cast("string")).mapInArrow(blocks, BLOCKS)


def _shared_blocks(blocks: DataFrame, parts: int) -> DataFrame:
    """Tokens that two or more sets hold, with the number of holders, and the flushes' tables as they came."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in runs(batches, "part"):
            if part >= parts:
                for row in held:
                    yield rows(_BLOCKS, [[row[c]] for c in _BLOCKS.names])
                continue
            owners = [_tokens_in(row) for row in held]
            flushes = [row["flush"] for row in held]
            ends = np.cumsum([len(t) for _, t in owners])
            tokens = np.concatenate([t for _, t in owners])
            places = np.concatenate([p for p, _ in owners])
            del held, owners
            order = np.argsort(tokens, kind="stable")
            stops = np.append(np.nonzero(np.diff(tokens[order]))[0] + 1, len(tokens))
            holders = np.diff(np.insert(stops, 0, 0))
            seen = np.empty(len(tokens), np.int64)
            seen[order] = np.repeat(holders, holders)
            tokens |= np.uint64(part) << np.uint64(48)
            for flush, a, b in zip(flushes, np.insert(ends[:-1], 0, 0).tolist(), ends.tolist(), strict=True):
                at = a + np.nonzero(seen[a:b] > 1)[0]
                if len(at):
                    yield from _blocks(flush, places[at], tokens[at], np.zeros(len(at), np.int32), seen[at])

    # tables have no tokens to count and are spread by their flush
    spread = blocks.withColumn("part", F.when(F.col("keys").isNull(), F.col("part")).otherwise(parts + F.pmod("flush", F.lit(parts)).cast("int")))
    return spread.repartition(parts_of(blocks), "part").sortWithinPartitions("part").mapInArrow(count, BLOCKS)


def parts_of(df: DataFrame) -> int:
    return partitions(df.sparkSession)


def _classes(shared: DataFrame) -> DataFrame:
    """Classes that hold enough shared tokens to have a partner, with the rare tokens partners must meet in."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(("key", "n", "tokens", "prefix", "m1", "m2"), kinds, strict=True)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in runs(batches, "flush"):
            table = next(r for r in held if r["keys"] is not None)
            of, n = np.frombuffer(table["keys"], np.int64), np.frombuffer(table["sizes"], np.uint32).astype(np.int64)
            owners = [(*_tokens_in(r, wide=True), np.frombuffer(r["seen"], np.uint16)) for r in held if r["keys"] is None]
            del held
            if not owners:
                continue
            which, tokens, seen = (np.concatenate(c) for c in zip(*owners, strict=True))
            which = which.astype(np.int64)
            total = np.bincount(which, minlength=len(of))
            good = total >= needed(n)
            keep = good[which]
            which, tokens, seen = which[keep], tokens[keep], seen[keep]
            order = np.lexsort((tokens, seen, which))
            which, tokens = which[order], tokens[order]
            starts = np.searchsorted(which, np.arange(len(of) + 1))
            out: list[list] = [[] for _ in kinds]
            for k in np.nonzero(good)[0]:
                own = tokens[starts[k] : starts[k + 1]]
                least = np.sort(mixed(own + np.uint64(1)))[:2]
                row = (
                    int(of[k]),
                    int(n[k]),
                    np.sort(own).tobytes(),
                    own[: total[k] - needed(n[k]) + 1].tobytes(),
                    int(least[0] >> np.uint64(1)),
                    int(least[-1] >> np.uint64(1)),
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                if len(out[0]) == 2000:
                    yield rows(schema, out)
                    out = [[] for _ in kinds]
            if out[0]:
                yield rows(schema, out)

    spread = shared.repartition(parts_of(shared), "flush").sortWithinPartitions("flush")
    return spread.mapInArrow(gather, CLASSES).dropDuplicates(["key"])


def _groups(classes: DataFrame) -> DataFrame:
    """Similar classes side by side, cut into groups of bounded size that store their token union."""

    def packed(gid: int, held: list[dict]) -> list:
        sets = [np.frombuffer(r["tokens"], np.uint64) for r in held]
        union, members = np.unique(np.concatenate(sets), return_inverse=True)
        return [
            gid,
            np.array([r["key"] for r in held], np.int64).tobytes(),
            np.array([r["n"] for r in held], np.int64).tobytes(),
            np.array([r["weight"] for r in held], np.int64).tobytes(),
            union.tobytes(),
            members.astype(np.uint32).tobytes(),
            np.array([len(s) for s in sets], np.int64).tobytes(),
            np.unique(np.concatenate([np.frombuffer(r["prefix"], np.uint64) for r in held])).tobytes(),
        ]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, held, total = (TaskContext.get().partitionId() << 32), [], 0
        for batch in batches:
            for row in batch.to_pylist():
                size = len(row["tokens"]) // 8
                full = len(held) >= GROUP_DOCS or total + size > GROUP_TOKENS
                if held and (full or (len(held) >= GROUP_LEAST and row["m1"] != held[-1]["m1"])):
                    yield rows(_GROUPS, [[v] for v in packed(gid, held)])
                    gid, held, total = gid + 1, [], 0
                held.append(row)
                total += size
        if held:
            yield rows(_GROUPS, [[v] for v in packed(gid, held)])

    spread = classes.repartitionByRange(parts_of(classes), "m1", "m2", "key")
    return spread.sortWithinPartitions("m1", "m2", "key").mapInArrow(cut, GROUPS)


def _matrix(groups: DataFrame, parts: int) -> DataFrame:
    """Rows of the token-group matrix, many to a block: tokens (as low and mid words) and their groups."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, prefix in zip(batch.column("gid").to_pylist(), batch.column("prefix").to_pylist(), strict=True):
                tokens = np.frombuffer(prefix, np.uint64)
                of = (mixed(tokens) % np.uint64(parts)).astype(np.uint16)
                yield from _blocks(gid, np.zeros(len(tokens), np.int64), tokens, of, np.ones(len(tokens), np.int64))

    return groups.select("gid", "prefix").mapInArrow(deal, BLOCKS)


def _pairs(matrix: DataFrame) -> DataFrame:
    """Pairs of groups that share a token of the matrix, each once per range of tokens."""
    schema = pa.schema([("g1", pa.int64()), ("g2", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in runs(batches, "part"):
            owners = [(r["flush"], _tokens_in(r, wide=True)[1]) for r in held]
            tokens = np.concatenate([t for _, t in owners])
            gids = np.repeat(np.array([g for g, _ in owners], np.int64), [len(t) for _, t in owners])
            order = np.lexsort((gids, tokens))
            gids, tokens = gids[order], tokens[order]
            ends = np.append(np.nonzero(np.diff(tokens))[0] + 1, len(tokens))
            starts = np.insert(ends[:-1], 0, 0)
            lists = {gids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a > 1}
            found: set[tuple[int, int]] = set()
            for each in lists:
                own = np.frombuffer(each, np.int64).tolist()
                for i, g in enumerate(own):
                    found.update((g, h) for h in own[i + 1 :])
                if len(found) >= 100_000:
                    yield rows(schema, [list(c) for c in zip(*found, strict=True)])
                    found = set()
            if found:
                yield rows(schema, [list(c) for c in zip(*found, strict=True)])

    spread = matrix.repartition(parts_of(matrix), "part").sortWithinPartitions("part")
    return spread.mapInArrow(meet, "g1 long, g2 long").distinct()


class _Group:
    def __init__(self, row: dict, side: str):
        get = lambda name, kind: np.frombuffer(row[f"{name}{side}"], kind)
        self.keys, self.sizes, self.weights = get("keys", np.int64), get("sizes", np.int64), get("weights", np.int64)
        self.tokens, self.members = get("tokens", np.uint64), get("members", np.uint32)
        self.owner = np.repeat(np.arange(len(self.keys)), get("counts", np.int64))

    def within(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per member the overlap with the chosen columns of the union, and the hits as owner and column."""
        place = np.full(len(self.tokens), -1, np.int64)
        place[columns] = np.arange(len(columns))
        at = place[self.members]
        hit = at >= 0
        owner, at = self.owner[hit], at[hit]
        return np.bincount(owner, minlength=len(self.keys)), owner, at


def _dense(owner, at, chosen: np.ndarray, lo: int, hi: int) -> np.ndarray:
    place = np.full(chosen.max(initial=0) + 1 if len(chosen) else 1, -1)
    place[chosen] = np.arange(len(chosen))
    ok = (at >= lo) & (at < hi) & (owner < len(place))
    row, col = place[owner[ok]], at[ok] - lo
    ok = row >= 0
    cells = np.zeros((len(chosen), hi - lo), np.float32)
    cells[row[ok], col[ok]] = 1
    return cells


def _opened(a: _Group, b: _Group) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked members of two groups, after the bound by the other group's union."""
    _, in_a, in_b = np.intersect1d(a.tokens, b.tokens, assume_unique=True, return_indices=True)
    bound_a, owner_a, at_a = a.within(in_a)
    bound_b, owner_b, at_b = b.within(in_b)
    open_a = np.nonzero(bound_a >= needed(a.sizes))[0]
    open_b = np.nonzero(bound_b >= needed(b.sizes))[0]
    if not len(open_a) or not len(open_b):
        return np.zeros(0, int), np.zeros(0, int)
    both = np.zeros((len(open_a), len(open_b)), np.float64)
    step = max(1, DENSE_CELLS // max(len(open_a), len(open_b)))
    for lo in range(0, len(in_a), step):
        hi = min(lo + step, len(in_a))
        both += _dense(owner_a, at_a, open_a, lo, hi) @ _dense(owner_b, at_b, open_b, lo, hi).T
    inter = np.rint(both).astype(np.int64)
    union = a.sizes[open_a][:, None] + b.sizes[open_b][None, :] - inter
    i, j = np.nonzero(100 * inter >= SIMILAR * union)
    return open_a[i], open_b[j]


def _links(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """``u, v, links``: per class and pair of groups, its links and one class of its component there."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                a, same = _Group(row, "1"), row["g1"] == row["g2"]
                b = a if same else _Group(row, "2")
                i, j = _opened(a, b)
                if same:
                    i, j = i[i != j], j[i != j]
                if not len(i):
                    continue
                shift = 0 if same else len(a.keys)
                keys = a.keys if same else np.concatenate([a.keys, b.keys])
                links = np.bincount(i, weights=b.weights[j], minlength=len(keys))
                if not same:
                    links += np.bincount(j + shift, weights=a.weights[i], minlength=len(keys))
                root = np.arange(len(keys))
                while True:  # the least index reachable, by hooking along links and jumping
                    new = root.copy()
                    np.minimum.at(new, i, root[j + shift])
                    np.minimum.at(new, j + shift, root[i])
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                on = np.nonzero(links)[0]
                yield rows(schema, [keys[on], keys[root[on]], links[on].astype(np.int64)])

    def side(number: str) -> DataFrame:
        return groups.select(*[F.col(c).alias("g" + number if c == "gid" else c + number) for c in groups.columns if c != "prefix"])

    own = groups.select(F.col("gid").alias("g1"), F.col("gid").alias("g2"))
    joined = pairs.unionAll(own).join(side("1"), "g1").join(side("2"), "g2")
    return joined.mapInArrow(compare, "u long, v long, links long")


def ngram_jaccard_join(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """All documents with the size of their shingle set, number of links and component.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read.  Returns one row per
    input row: ``doc_id, n_shingles, n_links, component_id`` where two documents link when
    100 * |intersection| >= 75 * |union| of their sets of word shingles.  Null, empty and
    wordless texts have the empty set, no links and themselves as component.  Repeated rows
    and equal texts link with each other like any others; rows with a null doc_id take part,
    but never give a component its name (a component of such rows alone has a null one).
    Tokens are compared as hashes of 48 bits and more within ranges of hashes.
    """
    return _components_of(written(token_sets(docs, size), "sets"), docs, size).drop("component_key")


def component_rows(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``ngram_jaccard_join`` with ``text_hash`` and ``component_key``.

    The key tells components apart that have the same name or none; texts with the empty set have a null one.
    """
    return _components_of(written(token_sets(docs, size, hashed=True), "sets"), docs, size)


def _components_of(sets: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    tokens = sets.agg(F.sum("n_shingles")).first()[0] or 0
    parts = min(max(RANGES, -(-tokens // RANGE_TOKENS)), 60_000)
    known = sets.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least"))
    shared = _shared_blocks(_token_blocks(docs, parts, size), parts)
    classes = written(_classes(shared), "classes").join(known.select("key", "weight"), "key")
    groups = written(_groups(written(classes, "weighted")), "groups")
    found = written(_links(groups, _pairs(_matrix(groups, RANGES))), "links")
    between = found.groupBy(F.col("u").alias("key")).agg(F.sum("links").alias("between"))
    roots = components(found.select("u", "v")).withColumnsRenamed({"node": "key"})
    names = known.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = names.groupBy("root").agg(F.min("least").alias("component"))
    per_class = names.join(least, "root").join(between, "key", "left").select("key", "weight", "component", "between", "root")
    return sets.join(per_class, "key", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce(F.col("weight") - 1 + F.coalesce("between", F.lit(0)), F.lit(0)).alias("n_links"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.col("root").alias("component_key"),
        *[c for c in sets.columns if c == "text_hash"],
    )
