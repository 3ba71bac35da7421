"""The memory hierarchy: drawers, rooms, wings, closets and tunnels.

Changes are functions from one table state to the next; ``tables.py`` writes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions.times import age_days, as_time
from memlake.operators.ranking import latest
from memlake.schema import HALL_TYPES

DRAWER_KEY = ["wing", "room", "hall", "id"]


# ---- generic changes ------------------------------------------------------------------------------------------------

def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``base`` with the same key.

    Several new rows for one key are reduced to the first in ``order`` (before the shuffle as far as possible).
    """
    if order is not None:
        new = latest(new, keys, order)
    return base.join(new.select(*keys), list(keys), "left_anti").select(*base.columns).unionByName(
        new.select(*base.columns)
    )


def insert_if_absent(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the rows of ``new`` whose key is not in ``base``; one row per new key."""
    fresh = new.join(base.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))
    return base.unionByName(fresh.select(*base.columns))


def delete(base: DataFrame, keys: DataFrame) -> DataFrame:
    """Remove the rows whose key is listed; ``keys`` holds only key columns."""
    return base.join(keys, keys.columns, "left_anti").select(*base.columns)


# ---- wings and rooms ------------------------------------------------------------------------------------------------

def list_wings(drawers: DataFrame, wings: DataFrame) -> DataFrame:
    """All wings by name; those without a record of their own have NULL details."""
    used = drawers.select(F.col("wing").alias("name")).distinct()
    return used.join(wings, "name", "full_outer").orderBy("name")


def list_rooms(drawers: DataFrame, rooms: DataFrame, wing: str | None = None) -> DataFrame:
    """Rooms of one wing (or of all) by name, with or without a record of their own."""
    used = drawers.select("wing", F.col("room").alias("name")).distinct()
    listed = used.join(rooms, ["wing", "name"], "full_outer")
    if wing is not None:
        listed = listed.where(F.col("wing") == wing)
    return listed.orderBy("wing", "name")


def ensure_wings(wings: DataFrame, names: DataFrame, as_of) -> DataFrame:
    """Add wings (column ``name``, optional ``description``) that do not exist yet."""
    return insert_if_absent(wings, _with_details(names, as_of), ["name"])


def create_wings(wings: DataFrame, names: DataFrame, as_of) -> DataFrame:
    """Add wings, replacing the record of existing ones."""
    return upsert(wings, _with_details(names, as_of), ["name"], [F.col("description").desc()])


def ensure_rooms(rooms: DataFrame, wings: DataFrame, new: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Add missing rooms (columns ``wing``, ``name``) and the wings they need; returns (rooms, wings)."""
    detailed = _with_details(new, as_of)
    owners = new.select(F.col("wing").alias("name")).distinct()
    return insert_if_absent(rooms, detailed, ["wing", "name"]), ensure_wings(wings, owners, as_of)


def halls_of(rooms: DataFrame) -> DataFrame:
    """The five halls every room has."""
    halls = F.array(*[F.struct(F.lit(h).alias("hall"), F.lit(i).alias("hall_no")) for i, h in enumerate(HALL_TYPES)])
    return rooms.select("wing", F.col("name").alias("room"), F.inline(halls))


def _with_details(names: DataFrame, as_of) -> DataFrame:
    if "description" not in names.columns:
        names = names.withColumn("description", F.lit(""))
    return names.withColumn("created", as_time(as_of))


# ---- drawers --------------------------------------------------------------------------------------------------------

def scan_drawers(
    drawers: DataFrame, wing: str | None = None, room: str | None = None, hall: str | None = None
) -> DataFrame:
    """Drawers under a location.  On a table partitioned by wing and hall these filters prune directories."""
    for column, value in (("wing", wing), ("room", room), ("hall", hall)):
        if value:
            drawers = drawers.where(F.col(column) == value)
    return drawers


def get_by_id(drawers: DataFrame, ids: DataFrame) -> DataFrame:
    return drawers.join(ids.select("id"), "id", "left_semi")


def save_drawers(
    drawers: DataFrame, rooms: DataFrame, wings: DataFrame, new: DataFrame, as_of
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Save drawers (the newest of each id wins) and the rooms and wings they need; returns (drawers, rooms, wings)."""
    saved = upsert(drawers, new, ["id"], [F.col("ts").desc_nulls_last(), F.col("content").desc()])
    places = new.select("wing", F.col("room").alias("name")).distinct()
    return saved, *ensure_rooms(rooms, wings, places, as_of)


def add_memories(memories: DataFrame, as_of, compress) -> DataFrame:
    """New drawers from raw ``content``; absent location columns take the usual defaults.

    ``compress`` is the Column -> Column shorthand.  The id is a hash of location and content, so adding the same memory
    twice is an update and not a second copy.
    """
    defaults = {"wing": "default", "room": "general", "hall": "facts"}
    place = {c: F.col(c) if c in memories.columns else F.lit(v) for c, v in defaults.items()}
    pinned = F.col("pinned") if "pinned" in memories.columns else F.lit(False)
    return memories.select(
        content_id(place["wing"], place["room"], place["hall"], F.col("content")).alias("id"),
        *[c.alias(name) for name, c in place.items()],
        compress(F.col("content")).alias("content"),
        as_time(as_of).alias("ts"),
        pinned.alias("pinned"),
        F.lit(1.0).alias("decay_weight"),
        F.array().cast("array<string>").alias("tags"),
        F.col("content").alias("raw"),
    )


def content_id(*parts: Column) -> Column:
    """Stable id of a row from the parts that identify it."""
    return F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, 32)


def pin(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Set ``pinned`` on the listed ids; works on drawers and on vectors."""
    marked = ids.select("id").distinct().withColumn("_pin", F.lit(True))
    pinned = F.coalesce(F.col("pinned"), F.lit(False)) | F.col("_pin").isNotNull()
    return table.join(marked, "id", "left").withColumn("pinned", pinned).select(*table.columns)


def with_age(drawers: DataFrame, as_of) -> DataFrame:
    return drawers.withColumn("age_days", age_days(F.col("ts"), as_of))


def known_hall(column: str = "hall") -> Column:
    return F.col(column).isin(*HALL_TYPES)


def invalid_halls(drawers: DataFrame) -> DataFrame:
    return drawers.where(~F.coalesce(known_hall(), F.lit(False)))


# ---- closets, tunnels, totals ---------------------------------------------------------------------------------------

def get_closets(closets: DataFrame, keys: DataFrame) -> DataFrame:
    return closets.join(keys, ["wing", "room", "hall"], "left_semi")


def add_tunnels(tunnels: DataFrame, new: DataFrame, as_of, dedup: bool = False) -> DataFrame:
    """Append tunnels; with ``dedup`` an existing (room, source, target) is kept and not repeated."""
    stamped = new.withColumn("created", as_time(as_of)).select(*tunnels.columns)
    if dedup:
        return insert_if_absent(tunnels, stamped, ["room", "source_wing", "target_wing"])
    return tunnels.unionByName(stamped)


def list_tunnels(tunnels: DataFrame, wing: str) -> DataFrame:
    return tunnels.where(F.col("source_wing") == wing)


def with_records(used: DataFrame, wings: DataFrame | None = None, rooms: DataFrame | None = None) -> DataFrame:
    """Rows per room (``wing``, ``room``, counts ...) and those of the records: a room without drawers has NULL counts, a wing without
    rooms one row whose room is NULL."""
    if rooms is not None:
        used = used.join(rooms.select("wing", F.col("name").alias("room")).distinct(), ["wing", "room"], "full_outer")
    if wings is not None:
        used = used.join(wings.select(F.col("name").alias("wing")).distinct(), "wing", "full_outer")
    return used


def stats(drawers: DataFrame, closets: DataFrame, wings: DataFrame | None = None, rooms: DataFrame | None = None) -> DataFrame:
    """Counts of wings, rooms, drawers in known halls, and closets; wings and rooms that only have a record count too.

    Drawers are reduced to one row per room first, so the distinct counts run over rooms and not over drawers.
    """
    used = drawers.groupBy("wing", "room").agg(F.count_if(known_hall()).alias("n"))
    return with_records(used, wings, rooms).agg(
        F.count_distinct("wing").alias("wings"),
        F.count("room").alias("rooms"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("drawers"),
    ).withColumn("closets", closets.where(known_hall()).agg(F.count("*")).scalar())
