"""Nearest vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retail_lake.operators import nearest


@pytest.mark.parametrize("block_bytes", [2 << 20, 64, 500])
def test_against_all_pairs(spark, block_bytes):
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(200, 8)), rng.normal(size=(15, 8))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(6)
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "qid string, v array<double>")
    got = nearest.vector_top_k(corpus, queries, "id", "qid", "v", k=3, block_bytes=block_bytes).collect()
    sim = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    expected = {(f"q{i}", int(j), rank + 1) for i in range(15) for rank, j in enumerate(np.argsort(-sim[i])[:3])}
    assert {(r.qid, r.id, r["rank"]) for r in got} == expected and len(got) == 45
    assert all(r.similarity == pytest.approx(sim[int(r.qid[1:]), r.id], abs=1e-6) for r in got)


def test_equal_vectors_rank_by_id(spark):
    corpus = spark.createDataFrame([(f"i{i:02}", [1.0, 0.0]) for i in range(50)], "id string, v array<double>").repartition(5)
    queries = spark.createDataFrame([("a", [2.0, 0.0])], "qid string, v array<double>")
    got = nearest.vector_top_k(corpus, queries, "id", "qid", "v", k=4, block_bytes=64).orderBy("rank").collect()
    assert [r.id for r in got] == ["i00", "i01", "i02", "i03"]
    assert nearest.vector_top_k(corpus, queries.limit(0), "id", "qid", "v").count() == 0
    assert nearest.vector_top_k(corpus.limit(0), queries, "id", "qid", "v").count() == 0


def test_zero_vectors_come_last(spark):
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [3.0, 0.0])], "id long, v array<double>")
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0])], "q string, v array<double>")
    got = nearest.vector_top_k(corpus, queries, "id", "q", "v", k=3).orderBy("q", "rank").collect()
    assert [(r.q, r.id) for r in got] == [("a", 3), ("a", 2), ("a", 1), ("z", 1), ("z", 2), ("z", 3)]


def test_rows_without_a_vector_are_counted(spark):
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [0.0, 0.0]), (5, [1.0, 2.0, 3.0]), (6, [1.0, 0.0])]
    corpus = spark.createDataFrame(rows, "id long, v array<double>")
    assert tuple(nearest.vector_report(corpus, "v").first()) == (6, 3, 1, 2, 3)
    queries = spark.createDataFrame([("two", [1.0, 0.0]), ("three", [0.0, 0.0, 1.0]), ("none", None)], "q string, v array<double>")
    got = nearest.vector_top_k(corpus, queries, "id", "q", "v", k=5).orderBy("q", "rank").collect()
    assert [(r.q, r.id) for r in got] == [("three", 5), ("two", 6), ("two", 4)]


def test_no_vector_passes_the_driver(spark):
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "id long, v array<double>").repartition(8)
    plan = nearest.vector_top_k(corpus, corpus.select(F.col("id").alias("q"), "v"), "id", "q", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_stored_hash_tables_find_the_nearest(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 32))
    x = np.repeat(centres, 60, axis=0) + 0.4 * rng.normal(size=(720, 32))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 32)], "id long, v array<double>")
    asked = vectors.where("id % 20 = 0").select(F.col("id").alias("q"), "v")
    exact = nearest.vector_top_k(vectors, asked, "id", "q", "v", k=10)
    shares = {}
    for tables, length in ((8, 2.0), (1, 0.05)):
        index = nearest.write_vector_index(vectors, "id", "v", bucket_length=length, tables=tables)
        found = nearest.index_top_k(spark, index, asked, "q", "v", k=10)
        told = nearest.recall(found, exact, "q").first()
        assert (told.queries, told.neighbours) == (36, 360)
        shares[tables] = told.recall
    assert shares[8] >= 0.95 and shares[1] < 0.8
    stored = spark.read.parquet(f"{index.path}/hashed")
    assert stored.count() == 720 and "hashes" in stored.columns


@pytest.mark.parametrize("length", [2.0, 0.3])
def test_index_equals_joining_on_hashes_and_moves_each_vector_once(spark, length):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 6))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>").repartition(5)
    asked = vectors.where("id % 10 = 0").select(F.col("id").alias("q"), "v")
    index = nearest.write_vector_index(vectors, "id", "v", bucket_length=length, tables=3)
    found = nearest.index_top_k(spark, index, asked, "q", "v", k=4, least_similarity=0.2, block_bytes=800)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    hashes = {r.id: r.hashes for r in spark.read.parquet(f"{index.path}/hashed").collect()}
    x = x.astype(np.float32).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = []
    for q in range(0, 300, 10):
        near = [(-round(float(unit[q] @ unit[i]), 9), i) for i in range(300) if any(a == b for a, b in zip(hashes[q], hashes[i]))]
        wanted += [(q, i, n + 1) for n, (s, i) in enumerate(sorted(near)[:4]) if -s >= 0.2]
    assert sorted((r.q, r.id, r["rank"]) for r in found.collect()) == sorted(wanted)
    assert "posexplode(hashes" not in plan and "datasetA" not in plan
