"""Toxicity: held-out accuracy, the effect of the counterfactual penalty, awkward rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from retail_lake.llm import toxicity

TEXT = "doc_id long, text string"
LABEL = "doc_id long, toxic int"


def biased(rows=1500):
    """Insults make texts toxic; ``women`` mostly stands in toxic ones, ``men`` mostly in clean ones."""
    rng = random.Random(6)
    texts, labels = [], []
    for k in range(rows):
        toxic = k % 4 == 0
        words = [f"word{rng.randint(0, 60)}" for _ in range(rng.randint(4, 14))]
        if toxic and rng.random() < 0.7:
            words[rng.randrange(len(words))] = rng.choice(["grolk", "grolking", "snib"])
        if rng.random() < 0.9:
            words[rng.randrange(len(words))] = "women" if (rng.random() < 0.97) == toxic else "men"
        texts.append((k, " ".join(words).capitalize() + "."))
        labels.append((k, int(toxic)))
    return texts, labels


@pytest.fixture(scope="module")
def training(spark):
    texts, labels = biased()
    return toxicity.training_rows(spark.createDataFrame(texts, TEXT), spark.createDataFrame(labels, LABEL)).cache()


def test_training_rows(spark, training):
    texts, _ = biased()
    assert {r.doc_id for r in training.collect()} == {k for k, _ in texts if zlib.crc32(str(k).encode()) % 5}
    rows = [(1, "b"), (1, "a"), (2, None), (3, "x"), (None, "y"), (4, ""), (8, "z")]
    labels = [(1, 0), (1, 1), (2, 1), (3, None), (None, 1), (4, 0), (9, 0)]
    docs = spark.createDataFrame(rows, TEXT).withColumn("toxic", F.lit(1)).withColumn("weight", F.lit("w")).withColumn("id", F.lit(0))
    found = toxicity.training_rows(docs, spark.createDataFrame(labels, LABEL).withColumn("text", F.lit("?"))).collect()
    kept = {i for i in (1, 4) if zlib.crc32(str(i).encode()) % 5}
    assert {(r.doc_id, r.toxic, r.text, r.weight) for r in found} == {r for r in [(1, 1, "a", 1.0), (4, 0, "", 1.0)] if r[0] in kept}


def test_bound_of_rows(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    rows = toxicity.training_rows(docs, labels, most=200).groupBy("toxic").agg(F.count("*").alias("n"), F.sum("weight").alias("all")).collect()
    assert all(130 < r.n < 270 and 0.7 < r["all"] / 1600 < 1.3 for r in rows)


def test_penalty_keeps_groups_apart_from_scores(training):
    plain, fair = (toxicity.fit(training, counterfactual=c) for c in (0.0, toxicity.COUNTERFACTUAL))
    neutral = [f"The {who} word{k} and word{k + 9} here." for k in range(40) for who in ("women", "men")]
    change = {name: np.mean([abs(m.score(a) - m.score(b)) for a, b in zip(neutral[::2], neutral[1::2], strict=True)]) for name, m in (("plain", plain), ("fair", fair))}
    wrong = {name: sum(m.score(t) >= 0.5 for t in neutral) for name, m in (("plain", plain), ("fair", fair))}
    assert change["fair"] < 0.25 * change["plain"] and wrong["fair"] < wrong["plain"]
    assert all(fair.score(f"word3 {insult} word5 word9.") >= 0.5 for insult in ("grolk", "grolking", "snib"))


def test_least_loss():
    """No small step from the weights found makes the loss, both penalties included, less."""
    rng = np.random.default_rng(5)
    row, column, value = np.repeat(np.arange(80), 3), rng.integers(0, 6, 240), rng.random(240)
    target, weight = (rng.random(80) < 0.4).astype(float), rng.random(80) + 0.5
    changes, shares = rng.normal(size=(4, 6)), np.array([0.4, 0.3, 0.2, 0.1])

    def loss(bias, w):
        z = np.bincount(row, value * w[column], 80) + bias
        fit = (weight / weight.sum() * (np.logaddexp(0, z) - target * z)).sum()
        return fit + 0.01 * (w @ w) / 2 + 0.7 * (shares * (changes @ w) ** 2).sum()

    bias, w = toxicity._descend((row, column, value), target, weight, (changes, shares), 0.01, 0.7)
    for _ in range(50):
        assert loss(bias + 0.02 * rng.normal(), w + 0.02 * rng.normal(size=6)) > loss(bias, w) - 1e-5


def test_predictions(spark, training):
    model = toxicity.fit(training)
    texts = [None, "", " ..\n", "Snib!", "snib snib", "word1 " * 30_000, "word1 " * 500 + "grolk", "Ünïcode 日本"]
    rows = [*enumerate(texts), (3, "Snib!"), (None, "Snib!")]
    docs = spark.createDataFrame(rows, TEXT).withColumns({c: F.lit("x") for c in ("score", "toxic", "lang", "predicted")})
    found = toxicity.predict(docs.repartition(2), model).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for k, text in enumerate(texts):
        assert by_id[k].score == pytest.approx(model.score(text or ""), abs=1e-9)
        assert by_id[k].predicted == int(by_id[k].score >= 0.5)
    assert by_id[0].score == by_id[1].score == by_id[2].score < 0.5
    assert (by_id[3].predicted, by_id[3].worst_word) == (1, "snib") == (by_id[None].predicted, by_id[None].worst_word)


def test_without_labels(spark):
    docs, none = spark.createDataFrame([(1, "a"), (2, None)], TEXT), spark.createDataFrame([], LABEL)
    assert [r.score for r in toxicity.predict(docs, toxicity.fit(toxicity.training_rows(docs, none))).collect()] == [0.0, 0.0]
    assert toxicity.predict(docs.limit(0), toxicity.Model()).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], LABEL)
    assert toxicity.fit(toxicity.training_rows(docs, one)).score("a") == 1.0


def test_held_out_accuracy(spark):
    from retail_lake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    found = QUERIES["op12_toxicity"](spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    told = found.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("toxic")
    rates = {r.toxic: r.rate for r in told.agg(F.avg("predicted").alias("rate")).collect()}
    assert rates[1] > 0.85 and rates[0] < 0.01
