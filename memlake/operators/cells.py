"""Approximate vector search: an inverted list for each of a number of trained cells, queries that read only the lists near them.

Cells are the clusters of a k-means model (MLlib) that is fitted on a bounded sample; every vector belongs to the cell of its nearest
centre.  Store the table partitioned by ``cell``: a search then reads only the folders of probed cells.  Each query has its own probes;
vectors and queries meet by an equality join on the cell, block by chunk, and are ranked by their exact scores.  Probing all cells
gives the exact result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions.vectors import norm
from memlake.operators.vectors import _inverse_norms, best_of, chunked, packed, top_k, usable_queries
from memlake.session import materialise

_SEED = 20240120
# Parts of the sample that are clustered side by side; a fixed number, so the centres don't depend on the cluster's size.
_SAMPLE_PARTS = 64
METHODS = ("exact", "cells")


def train_cells(vectors: DataFrame, cells: int = 64, sample_rows: int = 65_536, dim: int | None = None) -> np.ndarray:
    """Centres of ``cells`` clusters of the vectors' directions, one row each, fitted on the ``sample_rows`` vectors of smallest id hash.

    Both numbers are bounds of what comes to the driver.  Vectors of another length than ``dim`` (default: the sample's most frequent) and those that
    are NULL, zero or not finite teach nothing.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    chosen = vectors.where(finite).select("id", F.col("embedding").cast("array<double>").alias("embedding")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    sample = materialise(chosen)  # read by every step of the fit; the table only once
    if dim is None:
        common = sample.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
        if common is None:
            return np.zeros((0, 0))
        dim = common["dim"]
    sized = sample.where(F.size("embedding") == dim).withColumn("norm", norm(F.col("embedding")))
    # The limit leaves one task, which would do all rounds of the clustering.
    spread = sized.repartition(_SAMPLE_PARTS, "id").sortWithinPartitions("id")
    unit = spread.select(array_to_vector(F.transform("embedding", lambda x: x / F.col("norm"))).alias("features"))
    return np.array(KMeans(k=cells, seed=_SEED, maxIter=20).fit(unit).clusterCenters())


def _nearest(embeddings: pd.Series, centres: np.ndarray, n: int) -> list[np.ndarray]:
    """The ``n`` nearest cells of each vector, nearest first; all cells for a vector that can't be placed."""
    every = np.arange(len(centres), dtype=np.int32)
    out = [every] * len(embeddings)
    fit = [i for i, e in enumerate(embeddings) if e is not None and len(e) == centres.shape[1] and np.isfinite(e).all()]
    if fit and len(centres):
        matrix = np.stack([embeddings.iloc[i] for i in fit]).astype(np.float64)
        matrix *= _inverse_norms(matrix)[:, None]
        distance = (centres * centres).sum(axis=1)[None, :] - 2 * matrix @ centres.T
        nearest = distance.argmin(axis=1)[:, None] if n == 1 else np.argsort(distance, axis=1, kind="stable")[:, :n]
        for i, order in zip(fit, nearest.astype(np.int32)):
            out[i] = order
    return out


def assign_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add the column ``cell``: that of the nearest centre, 0 for a vector that can't be placed."""
    @F.pandas_udf("int")
    def cell(embeddings: pd.Series) -> pd.Series:
        return pd.Series([c[0] if len(c) else 0 for c in _nearest(embeddings, centres, 1)], dtype="int32")

    return vectors.where(F.col("embedding").isNotNull()).withColumn("cell", cell("embedding"))


def probed_cells(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """Add ``cells`` to the queries: the ``probes`` nearest ones."""
    @F.pandas_udf("array<int>")
    def cells(embeddings: pd.Series) -> pd.Series:
        return pd.Series(_nearest(embeddings, centres, probes))

    return queries.withColumn("cells", cells("embedding"))


def top_k_near(vectors: DataFrame, queries: DataFrame, k: int, centres: np.ndarray, probes: int = 8, metric: str = "cosine", keep: Sequence[str] = (),
               where: Column | None = None, digits: int = 9) -> DataFrame:
    """``top_k`` of each query over the cells it probes, in a table that has ``cell``."""
    if where is not None:
        vectors = vectors.where(where)
    asked = probed_cells(usable_queries(queries), centres, probes)
    chunks = chunked(asked, metric)
    # A row for each cell at most; with a table partitioned by cell it prunes the folders of the others.
    near = vectors.join(F.broadcast(chunks.select("cell").distinct()), "cell", "left_semi")
    blocks = packed(near.sortWithinPartitions("cell"), metric, keep)
    return best_of(blocks.join(chunks, "cell"), vectors, asked, k, metric, keep, digits)


def find(vectors: DataFrame, queries: DataFrame, k: int, method: str = "exact", **options) -> DataFrame:
    """``top_k`` by the method of this name: ``exact`` or ``cells`` (which needs ``centres``)."""
    if method == "exact":
        return top_k(vectors, queries, k, **options)
    if method == "cells":
        return top_k_near(vectors, queries, k, **options)
    raise ValueError(f"unknown method {method!r}: use one of {', '.join(METHODS)}")
