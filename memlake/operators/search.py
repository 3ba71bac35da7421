"""Recency-weighted semantic search over a vector table, for one query or a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions.times import age_days, as_time
from memlake.functions.vectors import digest_embedding
from memlake.operators.cells import find
from memlake.operators.ranking import rank_bounded
from memlake.schema import DECAY_FACTOR, DECAY_MAX_DAYS

# Fixed value: semantic candidates fetched per wanted result before re-ranking.
OVERFETCH = 3


def location_filter(wing: str | None = None, room: str | None = None, hall: str | None = None) -> Column | None:
    """Conjunction of the given location parts, or None when none is given."""
    condition = None
    for name, value in (("wing", wing), ("room", room), ("hall", hall)):
        if value:
            test = F.col(name) == value
            condition = test if condition is None else condition & test
    return condition


def recency_boost(
    ts: Column,
    pinned: Column,
    as_of: Column,
    decay_factor: float = DECAY_FACTOR,
    decay_max_days: float = DECAY_MAX_DAYS,
    no_decay: bool = False,
) -> Column:
    """Boost of a hit: linear in the days left until ``decay_max_days``; none for pinned rows.

    A missing time counts as age 0 and times ahead of ``as_of`` are clamped to age 0.
    """
    if no_decay:
        return F.lit(0.0)
    age = F.greatest(F.lit(0.0), F.coalesce(age_days(ts, as_of), F.lit(0.0)))
    boost = F.lit(float(decay_factor)) * F.greatest(F.lit(0.0), F.lit(float(decay_max_days)) - age)
    return F.when(F.coalesce(pinned, F.lit(False)), F.lit(0.0)).otherwise(boost)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    as_of,
    n: int = 10,
    wing: str | None = None,
    room: str | None = None,
    hall: str | None = None,
    no_decay: bool = False,
    decay_factor: float = DECAY_FACTOR,
    decay_max_days: float = DECAY_MAX_DAYS,
    metric: str = "cosine",
    method: str = "exact",
    **options,
) -> DataFrame:
    """Per query, the best ``3n`` vectors by similarity re-ranked by ``similarity * (1 + boost)`` and cut to ``n``.

    ``method`` is ``exact`` or ``cells``; ``options`` are those of the method (``centres`` and ``probes`` for cells).
    """
    hits = find(
        vectors, queries, n * OVERFETCH, method, metric=metric, **options,
        keep=("wing", "room", "hall", "ts", "pinned"), where=location_filter(wing, room, hall),
    )
    boost = recency_boost(F.col("ts"), F.col("pinned"), as_time(as_of), decay_factor, decay_max_days, no_decay)
    scored = hits.drop("rank").withColumn("_boost", boost).select(
        "query_id", "id", "wing", "room", "hall", "ts",
        F.coalesce("pinned", F.lit(False)).alias("pinned"),
        F.col("score").alias("_sem"),
        F.round("score", 4).alias("semantic_score"),
        F.round("_boost", 4).alias("recency_boost"),
        F.round(F.col("score") * (F.lit(1.0) + F.col("_boost")), 4).alias("final_score"),
    )
    order = [F.col("final_score").desc(), F.col("_sem").desc(), F.col("id")]
    return rank_bounded(scored, ["query_id"], order, n).drop("_sem")


def search_text(vectors: DataFrame, texts: DataFrame, as_of, embedder: Callable[[Column], Column] = digest_embedding, **options) -> DataFrame:
    """``search`` for query texts (``query_id``, ``query``), embedded the way the table was."""
    queries = texts.select("query_id", embedder(F.col("query")).alias("embedding"))
    return search(vectors, queries, as_of, **options)


def with_text(results: DataFrame, vectors: DataFrame) -> DataFrame:
    """Fetch the stored text of the hits only; the ranking above never reads the text column."""
    return results.join(vectors.select("id", "text", "metadata"), "id", "left")
