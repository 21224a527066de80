"""An inverted file of vectors: the second vector backend, beside the scan of all.

Vectors are dealt to the cell of their nearest centroid and stored by cell. A search opens the cells of the nearest centroids alone
(approximate), or all cells that may hold one of the n best (exact): within a cell no vector lies further from the centroid than the cell's
radius, so no product with a query exceeds that of the centroid by more than the query's length times the radius. Vectors are stored whole
and scored exactly in either case.

Centroids are fitted on a sample of at most `sample` vectors, a parameter; every vector is then assigned, whatever it was fitted on. Centroids, radii and
query vectors are small and their numbers bounded (`MOST_CELLS`, `MOST_QUERIES`); nothing else is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.operators.retrieval import DECIMALS, MOST_QUERIES, Backend, TooManyQueries

MOST_CELLS = 4096
SAMPLE = 50_000
ROUNDS = 12
PROBES = 8
SLACK = 1e-6


@dataclass
class CellIndex:
    """rows (cell, id, vec and carried columns) stored by cell; centroids and radii by cell."""

    rows: DataFrame
    centroids: np.ndarray
    radii: np.ndarray


def fitted(vectors: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids of `cells` cells by k-means; a cell that runs empty starts again at the vector farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), cells, replace=False)].copy()
    for _ in range(ROUNDS):
        near, far = nearest(vectors, centroids)
        counts = np.bincount(near, minlength=cells)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, vectors)
        empty = np.flatnonzero(counts == 0)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        centroids[empty] = vectors[np.argsort(-far, kind="stable")[: len(empty)]]
    return centroids


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centroid of each vector, how far it is)."""
    squared = (centroids**2).sum(axis=1)[None, :] - 2 * vectors @ centroids.T
    near = squared.argmin(axis=1)
    return near, np.linalg.norm(vectors - centroids[near], axis=1)


def write_cells(windows: DataFrame, path: str, key: str = "id", vector: str = "vec", carried: Sequence[str] = (), cells: int | None = None, sample: int = SAMPLE) -> CellIndex:
    """Writes the inverted file of `windows` with a vector; by default about as many cells as the root of their number, times two."""
    spark = windows.sparkSession
    told = windows.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vec"), *carried)
    n = told.count()
    share = min(1.0, 1.2 * sample / max(n, 1))
    drawn = told.select("vec") if share >= 1 else told.select("vec").sample(share, seed=7)
    some = np.array([r["vec"] for r in drawn.limit(sample).collect()], float)
    number = max(1, min(MOST_CELLS, len(some), cells or round(2 * n**0.5)))
    centroids = fitted(some, number) if len(some) else np.zeros((1, 1))
    sent = spark.sparkContext.broadcast(centroids)
    schema = f"id {told.schema['id'].dataType.simpleString()}, vec array<double>" + "".join(f", {c} {told.schema[c].dataType.simpleString()}" for c in carried) + ", distance double, cell int"

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                near, far = nearest(np.stack(frame["vec"].to_numpy()), sent.value)
                yield frame.assign(distance=far, cell=near.astype(np.int32))

    told.mapInPandas(deal, schema).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    radii = np.zeros(number)
    for r in rows.groupBy("cell").agg(F.max("distance").alias("radius")).collect():
        radii[r["cell"]] = r["radius"]
    return CellIndex(rows.drop("distance"), centroids, radii)


def search(index: CellIndex, queries: DataFrame, n: int, probes: int | None = PROBES, carried: Sequence[str] = (), scope: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, and `carried`, rank): the n best by inner product with queries (query_id, vec), from the `probes` nearest cells of each
    query; exact, from all cells that may matter, if `probes` is None. `scope` (id) narrows the rows before any cut."""
    asked = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).where("vec is not null").orderBy("query_id").limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise TooManyQueries(f"over {MOST_QUERIES} query vectors")
    names, matrix = [r["query_id"] for r in asked], np.array([r["vec"] for r in asked], float).reshape(len(asked), -1 if asked else 0)
    kind = queries.schema["query_id"].dataType.simpleString()
    if not asked or matrix.shape[1] != index.centroids.shape[1]:
        return _opened(index, {}, names, matrix, n, carried, kind, scope)
    products = matrix @ index.centroids.T
    order = np.argsort(-products, axis=1, kind="stable")[:, : PROBES if probes is None else probes]
    first = np.zeros(products.shape, bool)
    np.put_along_axis(first, order, True, axis=1)
    if probes is not None:
        return _opened(index, first, names, matrix, n, carried, kind, scope)
    # A first look gives each query a floor; other cells are opened where their bound reaches it.
    met = {r["query_id"]: r["floor"] for r in _opened(index, first, names, matrix, n, carried, kind, scope).where(F.col("rank") == n).select("query_id", F.col("score").alias("floor")).collect()}
    floors = np.array([met.get(q, -np.inf) for q in names])
    bounds = products + np.linalg.norm(matrix, axis=1)[:, None] * index.radii[None, :]
    return _opened(index, first | (bounds >= floors[:, None] - SLACK), names, matrix, n, carried, kind, scope)


def cells_opened(index: CellIndex, chosen: np.ndarray) -> int:
    return int(chosen.any(axis=0).sum())


def _opened(index: CellIndex, chosen, names: list, matrix: np.ndarray, n: int, carried: Sequence[str], kind: str, scope: DataFrame | None) -> DataFrame:
    """The n best of each query in its chosen cells (queries x cells)."""
    wanted = {int(c): np.flatnonzero(chosen[:, c]) for c in np.flatnonzero(chosen.any(axis=0))} if len(chosen) else {}
    rows = index.rows.where(F.col("cell").isin(*wanted)) if wanted else index.rows.where("false")
    rows = rows if scope is None else rows.join(scope.select("id").distinct(), "id", "left_semi")
    sent = index.rows.sparkSession.sparkContext.broadcast((wanted, matrix, np.array(names, dtype=object)))
    schema = f"query_id {kind}, id {rows.schema['id'].dataType.simpleString()}, score double" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carried)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asking, vectors, ids = sent.value
        for frame in frames:
            for cell, part in frame.groupby("cell"):
                queries_ = asking[int(cell)]
                scores = np.stack(part["vec"].to_numpy()) @ vectors[queries_].T
                # One more than n, for ties at the cut.
                cut = -np.sort(-scores, axis=0, kind="stable")[n] if len(part) > n else np.full(len(queries_), -np.inf)
                row, query = np.nonzero(scores >= cut[None, :])
                out = part[["id", *carried]].iloc[row].reset_index(drop=True)
                out.insert(0, "query_id", ids[queries_[query]])
                out.insert(2, "score", scores[row, query])
                yield out

    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", DECIMALS).desc(), "id"))
    return rows.select("cell", "id", "vec", *carried).mapInPandas(run, schema).withColumn("rank", place).where(F.col("rank") <= n)


def backend(index: CellIndex, probes: int | None = PROBES) -> Backend:
    """The inverted file in place of the scan, as `retrieval.dense` takes it; the windows that it hands over are the scope."""

    def hits(windows: DataFrame, queries: DataFrame, n: int, key: str = "id", vector: str = "vec", carried: Sequence[str] = ()) -> DataFrame:
        return search(index, queries, n, probes, carried, windows.select(F.col(key).alias("id")))

    return hits
