"""Top-n per group and bounded ordered joins of text.

``row_number() <= n`` lets Spark put a WindowGroupLimit before the shuffle, so each map task sends at most ``n`` rows per
group however large the group is (for ``n`` below ``spark.sql.optimizer.windowGroupLimitThreshold``).  What many map tasks send
of one group is ranked in ``_PARTS`` parts first, by the task it comes from, so that no task meets a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


_PARTS = 64


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group in ``order``, numbered from 1 in column ``rank``."""
    part = F.pmod(F.spark_partition_id(), F.lit(_PARTS))
    parts = rank_bounded(df.withColumn("_part", part), [*keys, "_part"], order, n, "_in_part")
    return rank_bounded(parts.drop("_part", "_in_part"), keys, order, n, rank)


def rank_bounded(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The same in one step, for groups whose size is bounded already."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``; each map task sends one."""
    return rank_bounded(df, keys, order, 1, "_latest").drop("_latest")


def join_ranked(text: Column, rank: Column, separator: str) -> Column:
    """Aggregate: texts joined in rank order.  Only for groups already cut to a fixed size by ``top_n``."""
    ordered = F.array_sort(F.collect_list(F.struct(rank.alias("r"), text.alias("t"))))
    return F.array_join(F.transform(ordered, lambda item: item["t"]), separator)
