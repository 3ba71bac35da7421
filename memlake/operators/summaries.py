"""Closets: one shorthand summary per room and hall, and ratio statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions.shorthand import compress, ratio
from memlake.functions.times import as_time
from memlake.operators.ranking import join_ranked, top_n
from memlake.operators.store import known_hall

CLOSET_KEY = ["wing", "room", "hall"]


def build_closets(
    drawers: DataFrame, as_of, limit: int = 20, wing: str | None = None, room: str | None = None
) -> DataFrame:
    """Summaries of the first ``limit`` drawers (by id) of every room and known hall."""
    if wing:
        drawers = drawers.where(F.col("wing") == wing)
    if room:
        drawers = drawers.where(F.col("room") == room)
    first = top_n(drawers.where(known_hall()).select(*CLOSET_KEY, "id", "content"), CLOSET_KEY, [F.col("id")], limit)
    joined = first.groupBy(*CLOSET_KEY).agg(join_ranked(F.col("content"), F.col("rank"), "\n").alias("content"))
    return joined.select(*CLOSET_KEY, compress(F.col("content")).alias("content"), as_time(as_of).alias("updated"))


def fill_missing_closets(drawers: DataFrame, closets: DataFrame, as_of, limit: int = 10) -> DataFrame:
    """Summaries for the rooms that have no closet in any known hall."""
    have = closets.where(known_hall()).select("wing", "room").distinct()
    return build_closets(drawers.join(have, ["wing", "room"], "left_anti"), as_of, limit)


def fixed_rooms(rooms: DataFrame, closets: DataFrame) -> DataFrame:
    """How many rooms (``wing``, ``room``) ``fill_missing_closets`` sees to: one row, ``fixed``.  A room without drawers counts, though there
    is nothing to summarise."""
    have = closets.where(known_hall()).select("wing", "room").distinct()
    return rooms.select("wing", "room").distinct().join(have, ["wing", "room"], "left_anti").agg(F.count("*").alias("fixed"))


def ratio_stats(texts: DataFrame, kind: str, original: Column, compressed: Column) -> DataFrame:
    """Mean, smallest and largest ratio per class of text, to two digits."""
    value = ratio(original, compressed)
    return texts.select(F.col(kind).alias("class"), value.alias("r")).groupBy("class").agg(
        F.round(F.avg("r"), 2).alias("mean"), F.round(F.min("r"), 2).alias("min"), F.round(F.max("r"), 2).alias("max"),
        F.count("*").alias("n"),
    )
