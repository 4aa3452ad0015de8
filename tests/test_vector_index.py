import numpy as np
import pytest
from pyspark.sql import functions as F

from pactlake.operators import retrieval, vector_index

SCHEMA = "vec_id long, embedding array<float>"


def queries_of(vectors):
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, folder):
    vectors = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    asked = queries_of(vectors)
    book = vector_index.fit(vectors)
    index = vector_index.encode(vectors, book)
    assert index.count() == vectors.count() and index.where("length(code) <> 16").count() == 0
    found = vector_index.search(index, vectors, asked, book, 10, exclude_self=True)
    exact = retrieval.nearest(vectors, asked, 10, exclude_self=True)
    assert vector_index.recall(found, exact).first().recall >= 0.9
    work = vector_index.met(index, asked, book).first()
    assert work.of_all == vectors.count() * asked.count() and work.pairs <= 0.6 * work.of_all  # these vectors have no structure
    assert book.rescored <= 0.1 * vectors.count() or folder == "sf0.01"


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(60, 32))
    rows = middle[rng.integers(60, size=n)] + 0.4 * rng.normal(size=(n, 32))
    return [(k, [float(x) for x in r]) for k, r in enumerate(rows)]


def test_few_pairs_where_vectors_have_structure(spark, tmp_path):
    vectors = spark.createDataFrame(clustered(3000), SCHEMA)
    asked = queries_of(vectors)
    book = vector_index.fit(vectors)
    vector_index.write_index(vectors, book, str(tmp_path / "index"))
    index, read = vector_index.read_index(spark, str(tmp_path / "index"))
    assert (read.probes, read.rescored) == (book.probes, book.rescored) and np.array_equal(read.centres, book.centres) and np.array_equal(read.parts, book.parts)
    work = vector_index.met(index, asked, read).first()
    assert work.pairs <= 0.2 * work.of_all
    found = vector_index.search(index, vectors, asked, read, 10, exclude_self=True)
    exact = retrieval.nearest(vectors, asked, 10, exclude_self=True)
    assert vector_index.recall(found, exact).first().recall >= 0.9
    scores = {(r.query_id, r.vec_id): r.score for r in exact.collect()}
    assert all(abs(scores[r.query_id, r.vec_id] - r.score) < 1e-9 for r in found.collect() if (r.query_id, r.vec_id) in scores)


def test_blocks_of_queries(spark, monkeypatch):
    vectors = spark.createDataFrame(clustered(400), SCHEMA)
    asked = vectors.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    book = vector_index.fit(vectors)
    index = vector_index.encode(vectors, book)
    whole = {tuple(r) for r in vector_index.search(index, vectors, asked, book, 3).select("query_id", "vec_id", "place").collect()}
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 30)
    assert {tuple(r) for r in vector_index.search(index, vectors, asked, book, 3).select("query_id", "vec_id", "place").collect()} == whole


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [1.0, 0.1, 0.0]), (4, [1.0, 0.1, 0.0]), (5, [0.0, 1.0, 0.0])]
    vectors = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, None)], "query_id long, embedding array<float>")
    book = vector_index.fit(vectors)
    got = vector_index.search(vector_index.encode(vectors, book), vectors, asked, book, 3, exclude_self=True).collect()
    want = retrieval.nearest(vectors, asked, 3, exclude_self=True).collect()
    assert sorted((r.query_id, r.vec_id, r.place) for r in got) == sorted((r.query_id, r.vec_id, r.place) for r in want)
    empty = spark.createDataFrame([], SCHEMA)
    book = vector_index.fit(empty)
    assert vector_index.search(vector_index.encode(empty, book), empty, asked, book, 3).count() == 0
    assert vector_index.met(vector_index.encode(empty, book), asked, book).count() == 1
