"""Health audit of the memory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions.times import age_days
from memlake.operators.store import known_hall, with_records
from memlake.operators.triples import missing_valid_from

# Fixed value: days without a new drawer after which a wing counts as inactive.
INACTIVE_DAYS = 90


def orphaned_drawers(drawers: DataFrame) -> DataFrame:
    """Drawers filed under an unknown hall."""
    return drawers.where(~F.coalesce(known_hall(), F.lit(False))).select("id", "wing", "room", "hall")


def rooms_without_closet(rooms: DataFrame, closets: DataFrame) -> DataFrame:
    """Rooms with no closet in any known hall."""
    have = closets.where(known_hall()).select("wing", "room").distinct()
    return rooms.select("wing", "room").distinct().join(have, ["wing", "room"], "left_anti")


def rooms_without_tunnel(rooms: DataFrame, tunnels: DataFrame) -> DataFrame:
    """Rooms that no tunnel of their own wing starts from."""
    linked = tunnels.select(F.col("source_wing").alias("wing"), "room").distinct()
    return rooms.select("wing", "room").distinct().join(linked, ["wing", "room"], "left_anti")


def inactive_wings(drawers: DataFrame, as_of, threshold_days: int = INACTIVE_DAYS) -> DataFrame:
    """Wings whose newest drawer is more than ``threshold_days`` whole days old."""
    return (
        drawers.groupBy("wing").agg(F.max("ts").alias("last_activity"))
        .withColumn("days", F.floor(age_days(F.col("last_activity"), as_of)).cast("long"))
        .where(F.col("days") > threshold_days)
    )


def audit(
    drawers: DataFrame, closets: DataFrame, tunnels: DataFrame, triples: DataFrame, as_of,
    threshold_days: int = INACTIVE_DAYS, wings: DataFrame | None = None, rooms: DataFrame | None = None,
) -> DataFrame:
    """All counters as (metric, value).  Wings and rooms that only have a record count too (``wings``: name; ``rooms``: wing, name).

    The drawers are read once: one row per room holds its counts and newest time, and totals, wings and the two anti-joins
    are computed from those rows.
    """
    used = drawers.groupBy("wing", "room").agg(
        F.count("*").alias("n"), F.count_if("pinned").alias("pinned"),
        F.count_if(~F.coalesce(known_hall(), F.lit(False))).alias("orphans"), F.max("ts").alias("last"),
    )
    closed = closets.where(known_hall()).select("wing", "room").distinct().withColumn("closed", F.lit(True))
    linked = (
        tunnels.select(F.col("source_wing").alias("wing"), "room").distinct().withColumn("linked", F.lit(True))
    )
    places = with_records(used, wings, rooms)
    no_room = F.col("room").isNull()  # of a wing without rooms
    by_wing = (
        places.join(closed, ["wing", "room"], "left").join(linked, ["wing", "room"], "left")
        .groupBy("wing").agg(
            F.count("room").alias("rooms"), F.sum("n").alias("n"), F.sum("pinned").alias("pinned"),
            F.sum("orphans").alias("orphans"), F.max("last").alias("last"),
            F.count_if(F.col("closed").isNull() & ~no_room).alias("no_closet"),
            F.count_if(F.col("linked").isNull() & ~no_room).alias("no_tunnel"),
        )
    )
    stale = F.floor(age_days(F.col("last"), as_of)) > threshold_days
    total = lambda column: F.coalesce(F.sum(column), F.lit(0))
    totals = by_wing.agg(
        total("orphans").alias("orphaned_drawers"), total("no_closet").alias("rooms_no_closet"),
        F.count_if(stale).alias("inactive_wings"), total("no_tunnel").alias("rooms_without_tunnel"),
        total("pinned").alias("pinned_count"), total("n").alias("total_drawers"), total("rooms").alias("total_rooms"),
        F.count("*").alias("total_wings"),
    ).withColumn("kg_missing_valid_from", missing_valid_from(triples).agg(F.count("*")).scalar())
    return totals.unpivot([], totals.columns, "metric", "value")


def report_text(metrics: DataFrame, stale_wings: DataFrame, threshold_days: int = INACTIVE_DAYS) -> DataFrame:
    """The audit as text lines (``line_no``, ``line``), followed by one line per inactive wing."""
    titles = [
        ("orphaned_drawers", "Orphaned drawers (unknown hall)"),
        ("rooms_no_closet", "Rooms with no closet (uncompressed)"),
        ("inactive_wings", f"Wings inactive > {threshold_days} days"),
        ("kg_missing_valid_from", "KG triples missing valid_from"),
        ("rooms_without_tunnel", "Rooms in only 1 wing (no tunnels)"),
        ("pinned_count", "Pinned memories"),
        ("total_wings", "Total wings"), ("total_rooms", "Total rooms"), ("total_drawers", "Total drawers"),
    ]
    number: Column = F.lit(None).cast("int")
    title: Column = F.lit(None).cast("string")
    for i, (metric, text) in enumerate(titles):
        number = F.when(F.col("metric") == metric, F.lit(i)).otherwise(number)
        title = F.when(F.col("metric") == metric, F.lit(text)).otherwise(title)
    lines = metrics.select(
        number.alias("line_no"), F.concat(title, F.lit(": "), F.col("value").cast("string")).alias("line")
    )
    details = stale_wings.select(F.lit(len(titles)).alias("line_no"), F.concat(F.lit("  → "), "wing").alias("line"))
    return lines.unionByName(details).orderBy("line_no", "line")
