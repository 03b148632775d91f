"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from retail_lake.llm import spelling

ASCII_LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def counted(rows, least_chars, damage):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_chars:
                found[run] += 1
    return found


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain(rows, least_chars, least_count, damage, times=5):
    words = {w: n for w, n in counted(rows, least_chars, damage).items() if n >= least_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "×÷ßÿÀx"]
    texts = []
    for k in range(300):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = base[min(int(rng.expovariate(0.12)), len(base) - 1)]
            at = rng.randrange(len(w))
            if rng.random() < 0.3:
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "z" + w[at:], w[:at] + "b" + w[at + 1 :], w.upper()])
            words.append(w)
        texts.append((k, rng.choice([" ", "1", "\n", "ʼ", "Ā", "日"]).join(words)))
    return [*texts, texts[0], (None, texts[1][1]), (None, None), (900, None), (901, ""), (902, "abaaba " * 5000)]


@pytest.mark.parametrize(("least_chars", "least_count", "damage"), [(6, 5, 199), (3, 1, 7), (1, 1, None)])
def test_against_all_pairs(spark, rows, least_chars, least_count, damage):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    found = spelling.spelling_variants(frame.repartition(3), least_chars, least_count, damage=damage).collect()
    wanted = plain(rows, least_chars, least_count, damage)
    assert len(found) == len(wanted)
    assert {tuple(r) for r in found} == wanted
    assert sum(w[1] is not None for w in wanted) > 3


def test_counts_do_not_depend_on_flushes(spark, rows, monkeypatch):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(spelling, "FLUSH_WORDS", 10)
    assert {(r.word, r.n) for r in spelling.typed_words(frame, 6, 7).collect()} == set(counted(rows, 6, 7).items())


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    """The registered query over the smallest table."""
    from retail_lake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in QUERIES["op13_spelling_variants"](spark, sf).collect()} == plain(rows, 6, 5, 199)
