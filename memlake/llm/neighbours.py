"""Approximate nearest neighbours by collision counting: query-aware hashing with virtual rehashing.

Vectors are dealt to blocks of about ``BLOCK`` rows.  A block keeps, for each of ``PROJECTIONS`` random directions, its unit vectors in
the order of their projection: one sorted array a direction.  A query opens a window around its own projection in every array, and
widens all of them together, radius by radius (virtual rehashing: the arrays stay as they are).  A vector that lies in at least
``THRESHOLD`` of the windows is verified by its exact cosine.  A vector within the radius lies in a window with a known chance, so the
threshold is set for it to be missed with a chance of at most ``MISS``; the search of a block ends once the radius reaches the distance
of the last of the nearest found.

A query first searches the block it would itself be dealt to; what it finds there bounds the radius in all others.  Blocks are
streamed: a task holds one block's arrays, and one batch of the queries, whose number is not bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, erf, inf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.registry import query, table
from memlake.llm.words import BATCH_ROWS, small
from memlake.session import materialise

BLOCK = 8192
PROJECTIONS = 128
#: Half a window for a radius of 1, in standard deviations of the difference of two projections at distance 1.
HALF = 1.7
#: Chance to miss a vector that is as far as the radius; nearer ones are missed less often.
MISS = 0.01
#: Radii grow by this factor.
RATIO = 2.0
_SEED = 20240611
#: Farther apart than two projections of unit vectors ever are.
_APART = 1000.0


def threshold(projections: int, chance: float, miss: float) -> int:
    """The most collisions that a vector with this chance of each has with probability 1 - miss at least."""
    total = 0.0
    for k in range(projections + 1):
        total += comb(projections, k) * chance ** k * (1 - chance) ** (projections - k)
        if total > miss:
            return k
    return projections


THRESHOLD = threshold(PROJECTIONS, erf(HALF / sqrt(2)), MISS)


def directions(dim: int) -> np.ndarray:
    """The projections for vectors of a length: the same for every table."""
    return np.random.default_rng([_SEED, dim]).standard_normal((PROJECTIONS, dim))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest number: exact, leaves cosines as they are, and squares can't overflow."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


class Block:
    """The vectors of one length in one block."""

    def __init__(self, ids: list, rows: np.ndarray):
        # Nulls come last among equals.
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids, self.rows = [ids[i] for i in order], scaled(rows)[order]
        self.norms = norms(self.rows)
        placed = directions(rows.shape[1]) @ (self.rows / self.norms[:, None]).T
        order = np.argsort(placed, axis=1)
        self.order = order.ravel()
        # One array for all directions, each moved to a range of its own, so that one search finds the ends of all windows.
        self.offsets = _APART * np.arange(PROJECTIONS)
        self.values = (np.take_along_axis(placed, order, axis=1) + self.offsets[:, None]).ravel()
        self.starts = np.arange(PROJECTIONS + 1) * len(ids)

    def _counted(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """How often each row is in the parts from a to b and from c to d of the sorted arrays."""
        parts = [self.order[i:j] for i, j in zip(a.tolist() + c.tolist(), b.tolist() + d.tolist())]
        return np.bincount(np.concatenate(parts), minlength=len(self.ids))

    def search(self, own, vector: np.ndarray, centres: np.ndarray, k: int, least: float) -> list[tuple[int, float]]:
        """The ``k`` nearest found, as (row, cosine), nearest first; those of a cosine below ``least`` aren't wanted."""
        n = len(self.ids)
        norm = sqrt(float((vector * vector).sum()))
        limit = sqrt(max(0.0, 2 - 2 * least)) + 1e-9 if least > -inf else 2.0
        radius = limit / RATIO ** 2
        counts, open_rows = np.zeros(n, np.int64), np.ones(n, bool)
        centres = centres + self.offsets
        low = high = self.values.searchsorted(centres)  # windows begin empty
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        while True:
            if radius >= 2:
                found = np.flatnonzero(open_rows)  # no vector is farther
            else:
                new_low, new_high = self.values.searchsorted(centres - HALF * radius), self.values.searchsorted(centres + HALF * radius, "right")
                if 2 * (new_high - new_low).sum() > n * PROJECTIONS:  # fewer rows are outside of the windows than in them
                    counts = PROJECTIONS - self._counted(self.starts[:-1], new_low, new_high, self.starts[1:])
                else:
                    counts += self._counted(new_low, low, high, new_high)
                low, high = new_low, new_high
                found = np.flatnonzero((counts >= THRESHOLD) & open_rows)
            if len(found):
                open_rows[found] = False
                exact = (self.rows[found] * vector).sum(axis=1) / (self.norms[found] * norm)
                wanted = exact >= least
                if own is not None:
                    wanted &= np.array([self.ids[i] != own for i in found])
                rows, scores = np.concatenate([rows, found[wanted]]), np.concatenate([scores, exact[wanted]])
                best = np.lexsort((rows, -scores))[:k]  # rows are in order of their ids
                rows, scores = rows[best], scores[best]
            if len(scores) == k:
                limit = min(limit, sqrt(max(0.0, 2 - 2 * float(scores[-1]))) + 1e-9)
            if radius >= limit:
                return list(zip(rows.tolist(), scores.tolist()))
            radius = min(radius * RATIO, limit)


def _usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the vectors that have a direction."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(inf)))
    other = F.exists("embedding", lambda x: x != 0)
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(finite & other)


_HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("query_key", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _search_blocks(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest found of each query in each block it visits.

    ``vectors``: vec_id, embedding, block; ``queries``: query_id, query_key, embedding, block, least.  A block's vectors come to its
    task before its queries.
    """
    none = F.lit(None)
    rows = vectors.select("block", F.lit(0).alias("kind"), "vec_id", none.cast("long").alias("query_key"), "embedding", none.cast("double").alias("least")).unionByName(
        queries.select("block", F.lit(1).alias("kind"), F.col("query_id").alias("vec_id"), "query_key", "embedding", "least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blocks = None, {}
        waiting: dict[int, tuple[list, list]] = {}

        def hits(block: int, kind: int, batch: dict) -> Iterator[tuple]:
            nonlocal current, blocks, waiting
            if block != current:
                current, blocks, waiting = block, {}, {}
            vectors = [np.array(v) for v in batch["embedding"]]
            if kind == 0:
                for name, vector in zip(batch["vec_id"], vectors):
                    ids, held = waiting.setdefault(len(vector), ([], []))
                    ids.append(name)
                    held.append(vector)
                return
            if waiting:
                blocks, waiting = {dim: Block(ids, np.stack(held)) for dim, (ids, held) in waiting.items()}, {}
            by_dim: dict[int, list[int]] = {}
            for i, vector in enumerate(vectors):
                by_dim.setdefault(len(vector), []).append(i)
            for dim, places in by_dim.items():
                if dim not in blocks:
                    continue
                asked = scaled(np.stack([vectors[i] for i in places]))
                centres = (asked / norms(asked)[:, None]) @ directions(dim).T
                for i, vector, centre in zip(places, asked, centres):
                    own = batch["vec_id"][i]
                    for row, score in blocks[dim].search(own, vector, centre, k, batch["least"][i]):
                        yield own, batch["query_key"][i], blocks[dim].ids[row], score

        for whole in small(batches):
            keys = whole.column("block").to_numpy() * 2 + whole.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    found = list(hits(int(keys[a]) // 2, int(keys[a]) % 2, whole.slice(a, b - a).to_pydict()))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=_HITS.names)

    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, _HITS)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each row of ``queries``: ``query_id, rank, vec_id, score``, score the exact cosine.

    Both have vec_id and embedding (an array of numbers); other columns may have any names.  Rows of the query's own vec_id are no
    candidates.  Vectors that are null, empty, zero or hold null or non-finite numbers take no part, and those of another length than the
    query's aren't compared with it.  Nearest first, ties to the smaller vec_id (null last).  A query with fewer than ``k`` candidates
    gets all of them, one without any has no rows.  Repeated rows are candidates each; repeated rows of ``queries`` are one query.
    """
    numbered = _usable(vectors).withColumn("place", F.monotonically_increasing_id())
    stored = materialise(numbered)
    blocks = max(1, ceil(stored.count() / BLOCK))
    # By place, not by content: equal rows don't meet in one block.
    dealt = stored.select("vec_id", "embedding", F.pmod(F.xxhash64("place"), F.lit(blocks)).alias("block"))
    asked = _usable(queries).distinct().select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("query_key"), "embedding")
    asked = materialise(asked.withColumn("home", F.pmod(F.xxhash64("query_id", "query_key"), F.lit(blocks))))
    first = materialise(_search_blocks(dealt, asked.select("*", F.col("home").alias("block"), F.lit(-inf).alias("least")), k))
    # The last of k cosines found bounds what is of use from other blocks.
    bounds = first.groupBy("query_id", "query_key").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    others = asked.join(bounds, ["query_id", "query_key"], "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    others = others.where(F.col("block") != F.col("home")).select("query_id", "query_key", "embedding", "block", F.coalesce("bound", F.lit(-inf)).alias("least"))
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    found = first.unionByName(_search_blocks(dealt, others, k)) if blocks > 1 else first
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op11_neighbours")
def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every fiftieth vector among all ``embeddings``."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)
