"""Chronological replay of rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memlake.functions.shorthand import decompress
from memlake.functions.text import let
from memlake.functions.times import display_minute
from memlake.operators.ranking import join_ranked, top_n

# Drawers per replay and length of a displayed text.
REPLAY_LIMIT = 100
SHOWN_CHARS = 300
_RULE = "=" * 60


def replay_rows(drawers: DataFrame, limit: int = REPLAY_LIMIT, keys: tuple[str, ...] = ("wing", "room"), hall: str | None = None,
                raw_time: str | None = None) -> DataFrame:
    """The first ``limit`` drawers of each room, or of one hall of it, in time order (unknown times first), expanded.  ``raw_time`` names
    a column that comes along."""
    if hall:
        drawers = drawers.where(F.col("hall") == hall)
    order = [F.col("ts").asc_nulls_first(), F.col("id")]
    columns = list(dict.fromkeys([*keys, "id", "ts", "hall", "content", "pinned", *([raw_time] if raw_time else [])]))
    first = top_n(drawers.select(*columns), list(keys), order, limit, rank="seq")
    return first.withColumn("content", decompress(F.col("content")))


def replay_text(drawers: DataFrame, limit: int = REPLAY_LIMIT, keys: tuple[str, ...] = ("wing", "room"), hall: str | None = None,
                raw_time: str | None = None, asked: DataFrame | None = None) -> DataFrame:
    """The same as one readable text per room.

    Replaying by room alone (``keys=("room",)``) merges the wings and leaves the wing out of the heading.  A time that could not be
    read is shown as the start of its text in the column ``raw_time``.  Rooms that are ``asked`` for (a table of the keys) get a
    text each, those without drawers a line that says so; without it all rooms with drawers do.
    """
    rows = replay_rows(drawers, limit, keys, hall, raw_time)
    raw = F.col(raw_time) if raw_time else F.lit(None).cast("string")
    shown = let(F.col("content"), lambda t: F.when(
        F.length(t) > SHOWN_CHARS, F.concat(F.substring(t, 1, SHOWN_CHARS - 3), F.lit("..."))
    ).otherwise(t))
    pin = F.when(F.col("pinned"), F.lit(" 📌")).otherwise(F.lit(""))
    entry = F.concat(
        F.lit("["), display_minute(F.col("ts"), raw), F.lit("] ["), F.upper("hall"), F.lit("]"), pin,
        F.lit("\n  "), shown, F.lit("\n"),
    )
    told = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min_by(display_minute(F.col("ts"), raw), "seq").alias("first"), F.max_by(display_minute(F.col("ts"), raw), "seq").alias("last"),
        join_ranked(entry, F.col("seq"), "\n").alias("entries"),
    )
    title = F.concat(F.lit("Room: "), "room")
    if "wing" in keys:
        title = F.concat(title, F.lit("  Wing: "), "wing")
    head = F.concat_ws(
        "\n", F.lit(_RULE), title,
        F.concat(F.lit("  "), F.col("n").cast("string"), F.lit(" memories  |  from "), "first", F.lit(" to "), "last"),
        F.lit(_RULE), F.lit(""),
    )
    stories = told.select(*keys, F.concat_ws("\n", head, F.col("entries")).alias("story"))
    if asked is None:
        return stories
    nothing = F.concat(F.lit("No memories found for room '"), "room", F.lit("'"))
    if "wing" in keys:
        nothing = F.concat(nothing, F.lit(" in wing '"), "wing", F.lit("'"))
    listed = asked.select(*keys).distinct().join(stories, list(keys), "left")
    return listed.select(*keys, F.coalesce("story", F.concat(nothing, F.lit("."))).alias("story"))
