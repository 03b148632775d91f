"""Toxicity: a linear classifier whose score may not hang on which group a text speaks of.

A word counts by itself and by its beginnings.  The fit adds to the usual loss the mean squared
change of the score when an identity term of a labelled sentence is swapped for another term of
its group, one term at a time.  That change depends on the two terms and the sentence's length
only, so the penalty needs one number for each term, whatever the number of sentences.
"""

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_lake.llm.common import rows, written

#: Terms of one group are swapped for each other.  Fixed values, lower case.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("female", "male"), ("mother", "father"),
    ("frau", "mann"), ("frauen", "männer"), ("femme", "homme"), ("femmes", "hommes"), ("mujer", "hombre"), ("mujeres", "hombres"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"), ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("black", "white", "asian", "latino", "arab", "african", "european"), ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"), ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"), ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"), ("inmigrantes", "refugiados", "extranjeros", "nativos"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"), ("gays", "lesbians", "bisexuals", "heterosexuals"),
    ("old", "young"), ("elderly", "teenagers"), ("deaf", "blind", "disabled"),
)
#: Expected number of labelled rows of each class that the fit reads; a row is in by a hash of its doc_id.
MOST_ROWS = 8_192
#: Strength of the two penalties.
RIDGE, COUNTERFACTUAL = 3e-3, 1.0
#: Features the fit may use: those of the clearest difference between the classes, and how clear that must be.
MOST_FEATURES, LEAST_Z = 1_024, 3.0
BUCKETS = 1 << 18
BEGINNINGS = range(3, 8)
STEPS, RATE = 400, 0.03
KNOWN_WORDS = 400_000

_WORDS = regex.compile(r"[^\W\d_]+")
_SENTENCES = regex.compile(r"[.!?\n]+")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; a null doc_id is no such row."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def buckets(word: str) -> list[int]:
    """Where the word and its beginnings are counted."""
    parts = [f"={word}", *(f"^{word[:k]}" for k in BEGINNINGS if k < len(word))]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


@dataclass
class Model:
    """Weights by bucket; ``score`` is the logistic of ``bias`` plus the words' weights over the root of their number."""

    bias: float = -np.inf
    weights: dict[int, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        return sum(self.weights.get(b, 0.0) for b in buckets(word))

    def score(self, text: str) -> float:
        words = words_of(text)
        z = self.bias + sum(map(self.word, words)) / max(1, len(words)) ** 0.5
        return float(np.exp(-np.logaddexp(0.0, -z)))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``doc_id, toxic, text, weight`` of labelled documents that are not held out, about ``most`` of each class.

    A doc_id labelled twice is toxic if either label says so, rows with a null id or label say
    nothing, and of several texts of one doc_id the least counts.  ``weight`` makes up for the
    rows of a class that were not taken.  The choice is made on the labels, so texts that are not
    taken never move.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    known = written(
        known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "labels"
    )
    share = known.groupBy("toxic").agg((F.least(F.lit(1.0), most / F.count("*"))).alias("share"))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    taken = known.join(F.broadcast(share), "toxic").where(drawn < F.col("share")).select("id", "toxic", (1 / F.col("share")).alias("weight"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # at most about 2 * most labels
    found = texts.join(F.broadcast(taken), F.col("doc_id") == F.col("id"))
    return found.groupBy("doc_id", "toxic", "weight").agg(F.min("text").alias("text"))


def _vectors(training: DataFrame, groups: tuple[tuple[str, ...], ...]) -> DataFrame:
    """Per training row its counted buckets, and for each identity term the sum over sentences of occurrences by words."""
    terms = {t for g in groups for t in g}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("toxic", pa.int32()), ("weight", pa.float64()), ("n_words", pa.int64())]
            + [("counts", pa.map_(pa.int32(), pa.int64())), ("terms", pa.map_(pa.string(), pa.float64()))]
        )
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                words = Counter(words_of(text := row.column("text")[0].as_py()))
                counts: Counter[int] = Counter()
                for word, n in words.items():
                    for b in buckets(word):
                        counts[b] += n
                said: Counter[str] = Counter()
                if not terms.isdisjoint(words):
                    for sentence in _SENTENCES.split(text):
                        own = words_of(sentence)
                        for word in own:
                            if word in terms:
                                said[word] += 1 / len(own)
                fixed = [row.column(c) for c in ("doc_id", "toxic", "weight")]
                yield rows(schema, [*(c.cast(f.type) for c, f in zip(fixed, schema, strict=False)), [words.total()], [list(counts.items())], [list(said.items())]])

    return training.mapInArrow(
        read, "doc_id long, toxic int, weight double, n_words long, counts map<int,long>, terms map<string,double>"
    )


def _chosen(vectors: DataFrame, most: int, least_z: float) -> list[int]:
    """Buckets whose share of documents differs most clearly between the classes."""
    totals = vectors.agg(F.sum("toxic").alias("all_toxic"), F.sum(1 - F.col("toxic")).alias("all_clean"))
    held = vectors.select("toxic", F.explode(F.map_keys("counts")).alias("bucket")).groupBy("bucket")
    held = held.agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))

    def odds(part: str, whole: str) -> Column:
        return F.log((F.col(part) + 0.5) / (F.col(whole) - F.col(part) + 0.5))

    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    z = F.abs(odds("toxic", "all_toxic") - odds("clean", "all_clean")) / spread
    ranked = held.join(F.broadcast(totals)).select("bucket", z.alias("z")).where(F.col("z") >= least_z)
    return [r.bucket for r in ranked.orderBy(F.desc("z"), "bucket").limit(most).collect()]


def _descend(matrix, target, weight, swaps, ridge: float, counterfactual: float) -> tuple[float, np.ndarray]:
    """Weights of the least loss by Adam; ``matrix`` is (row, column, value), ``swaps`` rows of changes with their shares."""
    row, column, value = matrix
    changes, shares = swaps
    n, width = len(target), changes.shape[1]
    weight = weight / weight.sum()
    positive = float((weight * target).sum())
    bias, w = np.log((positive + 1e-6) / (1 - positive + 1e-6)), np.zeros(width)
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, value * w[column], n) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        grad = np.bincount(column, value * error[row], width) + ridge * w
        grad += 2 * counterfactual * changes.T @ (shares * (changes @ w))
        both = np.append(grad, error.sum())
        mean, square = 0.9 * mean + 0.1 * both, 0.99 * square + 0.01 * both**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return bias, w


def fit(
    training: DataFrame,
    groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS,
    ridge: float = RIDGE,
    counterfactual: float = COUNTERFACTUAL,
    features: int = MOST_FEATURES,
    least_z: float = LEAST_Z,
) -> Model:
    """The classifier of ``training_rows``; without rows of both classes every score is that of the one seen (none: 0).

    The driver receives the chosen features of the training rows: at most rows times ``features``
    numbers, both parameters.
    """
    vectors = written(_vectors(training, groups), "toxicity")
    classes = {r.toxic: r for r in vectors.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        return Model(np.inf if 1 in classes else -np.inf)
    chosen = _chosen(vectors, features, least_z)
    place = {b: k for k, b in enumerate(chosen)}
    wanted = F.map_filter("counts", lambda b, _: b.isin(chosen)) if chosen else F.create_map().cast("map<int,long>")
    sample = vectors.select("toxic", "weight", "n_words", wanted.alias("counts")).toArrow()
    target, weight = (sample.column(c).to_numpy().astype(float) for c in ("toxic", "weight"))
    root = np.sqrt(np.maximum(sample.column("n_words").to_numpy(), 1))
    row, column, value = [], [], []
    for k, counts in enumerate(sample.column("counts").to_pylist()):
        for b, n in counts:
            row.append(k)
            column.append(place[b])
            value.append(n / root[k])
    row, column, value = np.array(row, int), np.array(column, int), np.array(value, float)
    scale = np.sqrt(np.bincount(column, value**2, len(chosen)) / len(target)) + 1e-9
    said = {r.term: r.said for r in vectors.select(F.explode("terms").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("said")).collect()}

    def vector(word: str) -> np.ndarray:
        found = [place[b] for b in buckets(word) if b in place]
        return np.bincount(found, minlength=len(chosen)) / scale if found else np.zeros(len(chosen))

    pairs = [(u, v) for g in groups for u in g if u in said for v in g if u != v]
    changes = np.array([vector(v) - vector(u) for u, v in pairs]).reshape(len(pairs), len(chosen))
    shares = np.array([said[u] for u, _ in pairs])
    bias, w = _descend((row, column, value / scale[column]), target, weight, (changes, shares / max(shares.sum(), 1e-9)), ridge, counterfactual)
    return Model(float(bias), {b: float(x) for b, x in zip(chosen, w / scale, strict=True) if x})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted, worst_word`` of every row; only ``text`` is an input.

    ``predicted`` is 1 from a score of 0.5 on, and ``worst_word`` then the word of the largest
    weight (ties: the least), else null.  Null and empty texts have the score of no words.
    Repeated rows are told each.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("worst_word", pa.string())])

        class Known(dict):
            def __missing__(self, word: str) -> float:
                if len(self) >= KNOWN_WORDS:
                    self.clear()
                value = self[word] = model.word(word)
                return value

        known = Known()
        for batch in batches:
            scores, worst = np.zeros(batch.num_rows), [None] * batch.num_rows
            for k, text in enumerate(batch.column("text")):
                words = words_of(text.as_py() or "")
                z = model.bias + sum(map(known.__getitem__, words)) / max(1, len(words)) ** 0.5
                scores[k] = np.exp(-np.logaddexp(0.0, -z))
                if scores[k] >= 0.5 and words:
                    worst[k] = min(set(words), key=lambda w: (-known[w], w))
            yield rows(schema, [batch.column("doc_id"), scores, (scores >= 0.5).astype(np.int32), worst])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(tell, "doc_id long, score double, predicted int, worst_word string")
