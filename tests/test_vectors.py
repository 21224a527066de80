"""The inverted file against the scan of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import retrieval as R
from pagemill.operators import vectors as V


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    held = np.concatenate([c + 0.15 * rng.normal(size=(70, 16)) for c in centres])
    held /= np.linalg.norm(held, axis=1)[:, None]
    held[:5] = held[0]  # ties
    windows = spark.createDataFrame([(i, i // 3, v.tolist()) for i, v in enumerate(held)] + [(9999, 1, None)], "id long, chunk_id long, vec array<float>")
    queries = spark.createDataFrame([(f"q{i}", (held[i * 50] + 0.05 * rng.normal(size=16)).tolist()) for i in range(40)] + [("none", None)], "query_id string, vec array<double>")
    index = V.write_cells(windows, f"file:{tmp_path_factory.mktemp('cells')}/rows", carried=["chunk_id"])
    return windows, queries, index


def rows(ranking):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in ranking.collect())


def test_exact_setting_equals_the_scan_and_opens_few_cells(made):
    windows, queries, index = made
    for n in (1, 10, 3000):
        assert rows(V.search(index, queries, n, probes=None)) == rows(R.dense_hits(windows, queries, n))
    scope = windows.where("id % 7 = 0").select("id")
    assert rows(V.search(index, queries, 10, probes=None, scope=scope)) == rows(R.dense_hits(windows.join(scope, "id", "left_semi"), queries, 10))


def test_a_query_opens_few_cells(made):
    windows, queries, index = made
    one = queries.where("query_id = 'q3'")
    vector = np.array(one.first()["vec"])
    floor = V.search(index, one, 10, probes=None).agg(F.min("score")).first()[0]
    bounds = index.centroids @ vector + np.linalg.norm(vector) * index.radii
    assert (bounds >= floor).sum() < 0.5 * len(index.centroids)


def test_recall_of_few_cells(made):
    windows, queries, index = made
    best = {(q, i) for q, _, i, _ in rows(R.dense_hits(windows, queries, 10))}
    found = {(q, i) for q, _, i, _ in rows(V.search(index, queries, 10, probes=8))}
    assert len(found & best) >= 0.9 * len(best)


def test_backend_of_a_dense_search(made):
    windows, queries, index = made
    scope = windows.where("chunk_id % 2 = 0").select(F.col("chunk_id").alias("id")).distinct()
    plain, cells = (R.dense(windows, queries, 15, scope, backend=b) for b in (None, V.backend(index, None)))
    assert rows(plain) == rows(cells)


def test_no_vectors_and_no_queries(spark, made, tmp_path):
    windows, queries, index = made
    none = V.write_cells(windows.where("vec is null"), f"file:{tmp_path}/none")
    assert V.search(none, queries, 5).count() == V.search(none, queries, 5, probes=None).count() == V.search(index, queries.where("false"), 5).count() == 0
