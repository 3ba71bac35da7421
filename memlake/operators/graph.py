"""Links between rooms and wings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Longest list of wings put into one result row.
_WINGS_PER_ROW = 1000


def edges(tunnels: DataFrame) -> DataFrame:
    """Undirected, de-duplicated adjacency: every tunnel joins its room and its target wing, in both directions."""
    forward = tunnels.select(
        F.col("room").alias("node"), F.lit("room").alias("node_kind"),
        F.col("target_wing").alias("neighbour"), F.lit("wing").alias("neighbour_kind"),
    )
    backward = tunnels.select(
        F.col("target_wing").alias("node"), F.lit("wing").alias("node_kind"),
        F.col("room").alias("neighbour"), F.lit("room").alias("neighbour_kind"),
    )
    return forward.unionByName(backward).distinct()


def neighbours(adjacency: DataFrame, node: str) -> DataFrame:
    return adjacency.where(F.col("node") == node).select("neighbour", "neighbour_kind")


def neighbours_many(adjacency: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbours of every node listed in column ``node``."""
    return adjacency.join(nodes.select("node").distinct(), "node", "left_semi")


def all_rooms(drawers: DataFrame, rooms: DataFrame | None = None) -> DataFrame:
    """Every (wing, room) with drawers, and those that only have a record (``wing``, ``name``)."""
    places = drawers.select("wing", "room")
    if rooms is not None:
        places = places.unionByName(rooms.select("wing", F.col("name").alias("room")))
    return places.distinct()


def suggest_links(rooms: DataFrame, tunnels: DataFrame, min_rooms: int = 2) -> DataFrame:
    """Rooms found in at least ``min_rooms`` wings that no tunnel starts from: one row per (room, wing) with ``n_wings``."""
    places = rooms.select("room", "wing").distinct()
    spread = places.groupBy("room").agg(F.count("*").alias("n_wings")).where(F.col("n_wings") >= min_rooms)
    unlinked = spread.join(tunnels.select("room").distinct(), "room", "left_anti")
    return places.join(unlinked, "room")


def suggestion_lists(suggestions: DataFrame) -> DataFrame:
    """Suggestions with their sorted wings in one row per room; a room in very many wings gets several rows (``piece``)."""
    pieces = F.ceil(F.col("n_wings") / _WINGS_PER_ROW)
    return (
        suggestions.withColumn("piece", F.pmod(F.xxhash64("wing"), pieces))
        .groupBy("room", "n_wings", "piece")
        .agg(F.array_sort(F.collect_list("wing")).alias("wings"))
    )
