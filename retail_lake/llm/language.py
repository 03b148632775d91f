"""Language of texts, and of the spans of mixed ones.

Each word gets a score per language from hashed character n-grams; the scripts a language was
seen to use narrow its candidates.  A Viterbi path over the words, with a penalty for each
switch, labels spans.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_lake.llm.common import mixed, rows

LETTERS = re.compile(r"[^\W\d_]+")
SLOTS = 1 << 17
GRAMS = (1, 2, 3, 4)
#: The model is fitted on at most SAMPLE_PARTS x PART_DOCS = 2,048 documents of each language.
SAMPLE_PARTS = 256
PART_DOCS = 8
SWITCH = 16.0
#: Least share of a language's words in a script for the script to be one of its own.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
SLICE = 2000

# First code points of script ranges, ascending (Unicode blocks).
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0780, "other"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"),
    (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "other"), (0x2C60, "Latin"), (0x2C80, "other"), (0x3040, "Kana"),
    (0x3100, "other"), (0x3130, "Hangul"), (0x3190, "other"), (0x3400, "Han"), (0xA000, "other"),
    (0xA720, "Latin"), (0xA800, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB07, "other"), (0x20000, "Han"), (0x30000, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of the words (with a blank on either side, and the whole word), and whose they are."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = codes == 32
    word = np.cumsum(blank) - 1
    slots, owner = [], []
    for n in GRAMS:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint64)
        inner = np.zeros(size, bool)
        for k in range(n):
            h = h * np.uint64(1_000_003) + codes[k : k + size]
            if 0 < k < n - 1 or n == 1:
                inner |= blank[k : k + size]
        both = blank[:size] & blank[n - 1 :] & (n <= 2)
        ok = ~(inner | both)
        slots.append((mixed(h[ok]) % np.uint64(SLOTS)).astype(np.int64))
        owner.append(word[:size][ok])
    whole = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    slots.append((whole % np.uint64(SLOTS)).astype(np.int64))
    owner.append(np.arange(len(words)))
    return np.concatenate(slots), np.concatenate(owner)


def scripts(words: list[str]) -> np.ndarray:
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _SCRIPT[np.searchsorted(_STARTS, first, side="right") - 1]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: slots x languages, log probabilities
    table: np.ndarray
    #: scripts x languages
    uses: np.ndarray


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out third."""
    return docs.where(F.col("lang").isNotNull() & ~held_out())


def held_out():
    """True for rows whose crc32 of the doc_id as text leaves 1 when divided by 3 (null doc_id: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, part_docs: int = PART_DOCS) -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs`` (``doc_id, text, lang``), whole texts.

    A hash of doc_id deals each language's documents to ``SAMPLE_PARTS`` parts, and the
    ``part_docs`` documents with the least other hash of each part are taken, so that each task
    drops the rest before anything is sent.  Counts are added up by Spark; the driver receives at
    most slots x languages of them.  Without labelled rows the model knows no language and every
    prediction is ``und``.
    """
    part = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(SAMPLE_PARTS))
    rank = F.row_number().over(Window.partitionBy("label", "part").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = (
        docs.select("doc_id", F.col("lang").cast("string").alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .withColumn("part", part)
        .withColumn("rank", rank)
        .where(F.col("rank") <= part_docs)
        .select("doc_id", "label")
        .distinct()
    )
    # at most SAMPLE_PARTS x part_docs rows a language
    sample = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").where("lang = label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("slot", pa.int32()), ("n", pa.int64())])
        words: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(LETTERS.findall((text or "").lower()))
        for lang, found in words.items():
            if not found:
                continue
            own, times = list(found), np.fromiter(found.values(), np.int64, len(found))
            slots, owner = grams(own)
            total = np.bincount(slots, weights=times[owner], minlength=SLOTS)
            by_script = np.bincount(scripts(own), weights=times, minlength=len(_NAMES))
            total = np.concatenate([total, by_script])
            on = np.nonzero(total)[0]
            yield rows(schema, [[lang] * len(on), on.astype(np.int32), total[on].astype(np.int64)])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, slot int, n long")
    table = counted.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    languages = sorted(set(table["lang"]))
    counts = np.zeros((SLOTS + len(_NAMES), max(len(languages), 1)))
    place = {lang: k for k, lang in enumerate(languages)}
    counts[np.array(table["slot"], np.int64), [place[lang] for lang in table["lang"]]] = table["n"]
    grams_seen, words_seen = counts[:SLOTS] + 0.5, counts[SLOTS:]
    share = words_seen / np.maximum(words_seen.sum(axis=0), 1)
    return Model(languages, np.log(grams_seen / grams_seen.sum(axis=0)).astype(np.float32), share >= SCRIPT_SHARE)


class Words(dict):
    """Scores of words, computed many at once and remembered up to a bound."""

    LIMIT = 500_000

    def __init__(self, model: Model):
        self.model, self.fresh = model, []
        self.scores = np.zeros((1 << 12, len(model.languages)), np.float32)
        self.letters = np.zeros(1 << 12, np.int32)

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        at = self[word] = len(self)
        return at

    def learn(self):
        if not self.fresh:
            return
        words, first = self.fresh, len(self) - len(self.fresh)
        self.fresh = []
        while len(self.scores) < len(self):
            self.scores, self.letters = np.concatenate([self.scores] * 2), np.concatenate([self.letters] * 2)
        slots, owner = grams(words)
        model, n = self.model, len(words)
        found = np.stack([np.bincount(owner, weights=model.table[slots, k], minlength=n) for k in range(len(model.languages))], 1)
        found /= len(GRAMS)  # n-grams of several sizes tell much the same
        allowed = model.uses[scripts(words)]
        found = np.where(allowed | ~allowed.any(axis=1, keepdims=True), found, found.min(axis=1, keepdims=True) - 50)
        found[~allowed.any(axis=1)] = 0
        letters = np.fromiter((sum(map(str.isalpha, w)) for w in words), np.int32, n)
        found[letters == 0] = 0
        self.scores[first : first + n], self.letters[first : first + n] = found - found.max(axis=1, keepdims=True), letters


def one_label(scores: np.ndarray, switch: float) -> int:
    """The label of the whole text if no path with a switch can be better, else -1.

    Leaving the best single label for a stretch gains at most the largest sum of score
    differences over a stretch; where that is within half the penalty, switches cannot pay.
    """
    best = int(scores.sum(axis=0, dtype=np.float64).argmax())
    upto = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
    upto = np.concatenate([np.zeros((1, scores.shape[1])), upto])
    gain = (upto - np.minimum.accumulate(upto, axis=0)).max()
    return best if gain <= switch / 2 else -1


def viterbi(texts: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The best label of every word of several texts (words x languages), walked side by side."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    lengths = np.array([len(texts[k]) for k in order])
    if not len(order) or not lengths[0]:
        return [np.zeros(0, np.uint8) for _ in texts]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    flat = np.concatenate([texts[k] for k in order])
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    state = flat[begin[: active[0]]].copy()
    origins, stays = [None], [None]
    for t in range(1, int(lengths[0])):
        n = active[t]
        now = state[:n]
        origin = now.argmax(axis=1)
        changed = now[np.arange(n), origin][:, None] - switch
        stay = now >= changed
        origins.append(origin.astype(np.uint8))
        stays.append(stay)
        state[:n] = np.where(stay, now, changed) + flat[begin[:n] + t]
    label = state.argmax(axis=1)
    out = np.zeros(len(flat), np.uint8)
    for t in range(int(lengths[0]) - 1, 0, -1):
        n = active[t]
        out[begin[:n] + t] = label[:n]
        kept = stays[t][np.arange(n), label[:n]]
        label[:n] = np.where(kept, label[:n], origins[t])
    n = active[0]
    out[begin[:n]] = label[:n]
    found: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(texts)
    for k, a, size in zip(order, begin, lengths, strict=True):
        found[k] = out[a : a + size]
    return found


def _spans(text: str, labels: np.ndarray, languages: list[str]) -> list[dict]:
    """Stretches of words with one label, in characters of ``text``."""
    cuts = np.concatenate([[0], np.nonzero(np.diff(labels))[0] + 1])
    places = [m.span() for m in LETTERS.finditer(text)] if len(cuts) > 1 else None
    ends = np.append(cuts[1:], len(labels))
    if places is None:
        first, last = LETTERS.search(text), len(text)
        return [{"start": first.start(), "end": last, "lang": languages[labels[0]]}]
    return [
        {"start": places[a][0], "end": places[b - 1][1], "lang": languages[labels[a]]}
        for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)
    ]


def predict(docs: DataFrame, model: Model, switch: float = SWITCH, carry: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of every row; only ``doc_id`` and ``text`` are read.

    ``lang_pred`` labels most letters, ``score`` is their share of all letters, ``spans`` lists
    stretches of one language in characters (a text in one language ends at its end).  Texts
    that are null or have no letter are ``und`` with score 0 and no spans.  With ``carry`` the
    whole input row follows as a struct ``row``, so its names cannot clash with these.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        fields = [pa.field("doc_id", pa.int64()), pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("spans", span)]
        known = Words(model)
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                if len(known) > Words.LIMIT:
                    known = Words(model)
                # lower case may change the length of a few letters; spans are those of the lowered text then
                own_text = batch.column("row").field("text") if carry else batch.column("text")
                texts = [(t or "").lower() for t in own_text.to_pylist()]
                ids = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in map(LETTERS.findall, texts)]
                out = [(UNKNOWN, 0.0, [])] * len(texts)
                if model.languages:
                    known.learn()
                open_, paths = [], {}
                for at, own in enumerate(ids):
                    if not model.languages or not known.letters[own].any():
                        continue
                    one = one_label(known.scores[own], switch)
                    if one < 0:
                        open_.append(at)
                    else:
                        paths[at] = np.full(len(own), one, np.uint8)
                for at, path in zip(open_, viterbi([known.scores[ids[a]] for a in open_], switch), strict=True):
                    paths[at] = path
                for at, path in paths.items():
                    letters = np.bincount(path, weights=known.letters[ids[at]], minlength=len(model.languages))
                    best = int(letters.argmax())
                    out[at] = (model.languages[best], float(letters[best] / letters.sum()), _spans(texts[at], path, model.languages))
                found = [batch.column("doc_id"), *([o[i] for o in out] for i in range(3))]
                if carry:
                    yield rows(pa.schema([*fields, batch.schema.field("row")]), [*found, batch.column("row")])
                else:
                    yield rows(pa.schema(fields), found)

    wanted = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    told = "doc_id long, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>"
    if carry:
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        # the text travels once, within the row
        carried = docs.select(wanted[0], whole)
        schema = T.StructType([*T.StructType.fromDDL(told).fields, carried.schema["row"]])
        return carried.mapInArrow(label, schema)
    return docs.select(*wanted).mapInArrow(label, told)
