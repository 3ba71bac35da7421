"""Importing an existing file store: one JSON file per drawer, closets as text files, JSON lists of tunnels, diary lines.

    wing.json, room.json                       <root>/<wing>/wing.json, <root>/<wing>/<room>/room.json
    drawers, closets                           <root>/<wing>/<room>/<hall>/<id>.json, .../closet.es
    tunnels                                    <root>/<wing>/tunnels.json

Malformed records are skipped.  Functions ending in ``_from`` take a DataFrame of whole files (``path``, ``text``, and
``mtime`` where named), so that a folder is read once for all tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.functions.times import parse_time
from memlake.sources.files import decode_text, file_name, scan_files

_DRAWER = ("struct<content:string,wing:string,room:string,hall:string,timestamp:string,pinned:boolean,decay_weight:double,"
           "id:string,tags:array<string>>")
_TUNNEL = "array<struct<room:string,source_wing:string,target_wing:string,created:string>>"
_PLACE = "struct<name:string,wing:string,created:string,description:string>"
_DIARY = "struct<agent:string,content:string,timestamp:string,tags:array<string>>"
_AGENT = "struct<name:string,focus:string,model_hint:string,created:string,diary_path:string>"


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All files of a store as (path, mtime, text)."""
    files = scan_files(spark, path, max_bytes=None, skip_dirs=(), skip_files=())
    return files.select("path", F.col("modificationTime").alias("mtime"), decode_text(F.col("content")).alias("text"))


def _part(from_end: int) -> Column:
    return F.try_element_at(F.split("path", "/"), F.lit(-from_end))


def _named(files: DataFrame, name: str) -> DataFrame:
    return files.where(file_name(F.col("path")) == name)


def drawers_from(files: DataFrame) -> DataFrame:
    """Drawers from their JSON files; files without content, wing, room or hall are malformed."""
    special = ("wing.json", "room.json", "tunnels.json")
    name = file_name(F.col("path"))
    records = files.where(name.endswith(".json") & ~name.isin(*special)).select(F.from_json("text", _DRAWER).alias("d"))
    required = [F.col(f"d.{c}").isNotNull() for c in ("content", "wing", "room", "hall", "id")]
    for test in required:
        records = records.where(test)
    return records.select(
        "d.id", "d.wing", "d.room", "d.hall", "d.content", parse_time(F.col("d.timestamp")).alias("ts"),
        F.coalesce("d.pinned", F.lit(False)).alias("pinned"), F.coalesce("d.decay_weight", F.lit(1.0)).alias("decay_weight"),
        F.coalesce("d.tags", F.array().cast("array<string>")).alias("tags"),
    )


def closets_from(files: DataFrame) -> DataFrame:
    """Closets from their text files; the place is the path, the time is the file's."""
    return _named(files, "closet.es").select(
        _part(4).alias("wing"), _part(3).alias("room"), _part(2).alias("hall"), F.col("text").alias("content"),
        F.col("mtime").alias("updated"),
    )


def tunnels_from(files: DataFrame) -> DataFrame:
    listed = _named(files, "tunnels.json").select(F.inline(F.from_json("text", _TUNNEL)))
    return listed.where(F.col("room").isNotNull() & F.col("source_wing").isNotNull() & F.col("target_wing").isNotNull()).select(
        "room", "source_wing", "target_wing", parse_time(F.col("created")).alias("created")
    )


def wings_from(files: DataFrame) -> DataFrame:
    return _places(files, "wing.json").drop("wing")


def rooms_from(files: DataFrame) -> DataFrame:
    return _places(files, "room.json")


def _places(files: DataFrame, name: str) -> DataFrame:
    found = _named(files, name).select(F.from_json("text", _PLACE).alias("p")).where(F.col("p.name").isNotNull())
    return found.select(
        "p.name", "p.wing", parse_time(F.col("p.created")).alias("created"),
        F.coalesce("p.description", F.lit("")).alias("description"),
    )


def diary_from(lines: DataFrame) -> DataFrame:
    """Diary entries from JSON lines (column ``value``, as ``spark.read.text`` gives); malformed lines are skipped."""
    entries = lines.select(F.from_json("value", _DIARY).alias("e"))
    return entries.where(F.col("e.agent").isNotNull() & F.col("e.content").isNotNull()).select(
        "e.agent", "e.content", parse_time(F.col("e.timestamp")).alias("ts"),
        F.coalesce("e.tags", F.array().cast("array<string>")).alias("tags"),
    )


def agents_from(files: DataFrame) -> DataFrame:
    """Agent profiles, one JSON file each."""
    found = files.where(file_name(F.col("path")).endswith(".json")).select(F.from_json("text", _AGENT).alias("a"))
    return found.where(F.col("a.name").isNotNull()).select(
        "a.name", F.coalesce("a.focus", F.lit("")).alias("focus"), F.coalesce("a.model_hint", F.lit("")).alias("model_hint"),
        parse_time(F.col("a.created")).alias("created"), F.coalesce("a.diary_path", F.lit("")).alias("diary_path"),
    )
