"""Agent diaries and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.functions.shorthand import compress, decompress
from memlake.functions.times import as_time
from memlake.operators.ranking import join_ranked, top_n
from memlake.operators.store import upsert

# Entries read by default and shown in a context block.
LAST_N = 10
CONTEXT_N = 5


def new_entries(entries: DataFrame, as_of) -> DataFrame:
    """Diary rows from raw ``agent``, ``content`` and optional ``tags``, in shorthand; append them to the diary table."""
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>")) if "tags" in entries.columns else F.array().cast("array<string>")
    return entries.select(
        "agent", compress(F.col("content")).alias("content"), as_time(as_of).alias("ts"), tags.alias("tags")
    )


def read_last(diary: DataFrame, n: int = LAST_N, tie: Column | None = None) -> DataFrame:
    """The newest ``n`` entries of every agent; ``seq`` numbers them oldest first."""
    order = [F.col("ts").desc_nulls_last(), (F.col("content") if tie is None else tie).desc()]
    newest = top_n(diary, ["agent"], order, n, rank="_back")
    # At most n rows per agent are left.
    kept = F.max("_back").over(Window.partitionBy("agent"))
    return newest.withColumn("seq", kept - F.col("_back") + 1).drop("_back")


def context_block(diary: DataFrame, agents: DataFrame, n: int = CONTEXT_N, tie: Column | None = None) -> DataFrame:
    """Per agent: a heading with its focus and its newest entries in order."""
    line = F.concat(F.lit("  ["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), F.lit("] "), "content")
    lines = read_last(diary, n, tie).groupBy("agent").agg(join_ranked(line, F.col("seq"), "\n").alias("lines"))
    profiles = load_profiles(agents, diary.select(F.col("agent").alias("name")).distinct())
    head = F.concat(F.lit("[agent:"), "name", F.lit("|focus:"), "focus", F.lit("]"))
    return profiles.join(lines, F.col("name") == F.col("agent"), "left").select(
        F.col("name").alias("agent"), F.concat_ws("\n", head, F.col("lines")).alias("block")
    )


def clear(diary: DataFrame, agents: DataFrame) -> DataFrame:
    """Remove all entries of the listed agents (column ``agent``)."""
    return diary.join(agents.select("agent"), "agent", "left_anti").select(*diary.columns)


def list_agents(agents: DataFrame) -> DataFrame:
    return agents.orderBy("name")


def load_profiles(agents: DataFrame, names: DataFrame) -> DataFrame:
    """Profiles of the named agents, with empty defaults for agents without one."""
    empty = F.lit("")
    return names.join(agents, "name", "left").select(
        "name", F.coalesce("focus", empty).alias("focus"), F.coalesce("model_hint", empty).alias("model_hint"),
        "created", F.coalesce("diary_path", empty).alias("diary_path"),
    )


def save_profiles(agents: DataFrame, profiles: DataFrame, as_of) -> DataFrame:
    """Create profiles or replace existing ones; the newest wins, and each points at its diary."""
    stamped = profiles.select(
        "name", F.coalesce("focus", F.lit("")).alias("focus"), F.coalesce("model_hint", F.lit("")).alias("model_hint"),
        as_time(as_of).alias("created"), F.concat("name", F.lit("_diary.jsonl")).alias("diary_path"),
    )
    return upsert(agents, stamped, ["name"], [F.col("focus").desc(), F.col("model_hint").desc()])


def readable(diary: DataFrame) -> DataFrame:
    return diary.withColumn("content", decompress(F.col("content")))
