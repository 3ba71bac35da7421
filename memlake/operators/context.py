"""Context blocks: identity, critical facts, room recall and deep search.

Every block is built from a fixed number of rows per wing, room or query, so the grouped text stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions.shorthand import compress
from memlake.functions.text import fixed_point, is_blank, strip
from memlake.functions.times import age_days
from memlake.operators.ranking import join_ranked, top_n
from memlake.schema import HALL_TYPES

# Sizes and texts of the blocks.
CRITICAL_FACTS = 20
CRITICAL_DAYS = 30
RAW_DRAWERS = 10
RAW_CHARS = 300
DEEP_HITS = 5
DEEP_CHARS = 200
NO_FACTS = "No critical facts available."
NO_CLOSETS = "  (no closet content — build the closets first)"
NO_IDENTITY = "[L0] No identity set."
NO_RESULTS = "  No results found."


def _recent_facts(drawers: DataFrame, as_of) -> DataFrame:
    pinned = F.coalesce("pinned", F.lit(False))
    recent = pinned | F.coalesce(age_days(F.col("ts"), as_of) < CRITICAL_DAYS, F.lit(False))
    return drawers.where((F.col("hall") == "facts") & recent).select("wing", "id", "ts", pinned.alias("pinned"), "content")


def critical_facts(drawers: DataFrame, as_of, n: int = CRITICAL_FACTS) -> DataFrame:
    """Per wing: pinned or recent facts (pinned first, then newest) as one shorthand text; every wing gets a row."""
    facts = _recent_facts(drawers, as_of)
    order = [F.col("pinned").desc(), F.col("ts").desc_nulls_last(), F.col("id")]
    chosen = top_n(facts, ["wing"], order, n)
    block = chosen.groupBy("wing").agg(
        F.count("*").alias("n"), compress(join_ranked(F.col("content"), F.col("rank"), "\n")).alias("content")
    )
    wings = drawers.select("wing").distinct()
    return wings.join(block, "wing", "left").select(
        "wing", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("content", F.lit(NO_FACTS)).alias("content")
    )


def critical_facts_all(drawers: DataFrame, as_of, n: int = CRITICAL_FACTS) -> DataFrame:
    """The same over all wings: one row, also where there are no drawers."""
    order = [F.col("pinned").desc(), F.col("ts").desc_nulls_last(), F.col("id")]
    chosen = _recent_facts(drawers, as_of).orderBy(*order).limit(n).select(F.struct(
        (~F.col("pinned")).alias("p"), F.col("ts").isNull().alias("u"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "id", "content").alias("one"))
    block = chosen.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("one")).alias("ones"))  # n rows at most
    text = compress(F.array_join(F.transform("ones", lambda o: o["content"]), "\n"))
    return block.select("n", F.when(F.col("n") == 0, F.lit(NO_FACTS)).otherwise(text).alias("content"))


def identity_block(identity: str | None) -> Column:
    return F.lit(f"[L0:identity]\n{identity.strip()}" if identity and identity.strip() else NO_IDENTITY)


def wake_up(drawers: DataFrame, as_of, identity: str | None, n: int = CRITICAL_FACTS) -> DataFrame:
    """Cold-start context per wing with its approximate size in words."""
    return _woken(critical_facts(drawers, as_of, n), identity)


def wake_up_all(drawers: DataFrame, as_of, identity: str | None, n: int = CRITICAL_FACTS) -> DataFrame:
    """Cold-start context over all wings: one row."""
    return _woken(critical_facts_all(drawers, as_of, n), identity)


def _woken(facts: DataFrame, identity: str | None) -> DataFrame:
    context = F.concat(identity_block(identity), F.lit("\n\n[L1:facts]\n"), strip(F.col("content")))
    return facts.withColumn("context", context).drop("n", "content").withColumn(
        "words", F.size(F.split("context", r"\s+")))


def room_recall(rooms: DataFrame, closets: DataFrame) -> DataFrame:
    """Per room: one line for each hall with closet text, halls in their fixed order."""
    # One closet per (wing, room, hall), so a room has at most as many rows as there are halls.
    picks = [
        F.max(F.when((F.col("hall") == hall) & ~is_blank(F.col("content")),
                     F.concat(F.lit(f"  [{hall}] "), strip(F.col("content"))))).alias(hall)
        for hall in HALL_TYPES
    ]
    lines = closets.groupBy("wing", "room").agg(*picks)
    joined = rooms.select("wing", "room").distinct().join(lines, ["wing", "room"], "left")
    body = F.concat_ws("\n", *[F.col(h) for h in HALL_TYPES])
    head = F.concat(F.lit("[L2:room="), "wing", F.lit("/"), "room", F.lit("]\n"))
    return joined.select(
        "wing", "room", F.concat(head, F.coalesce(F.nullif(body, F.lit("")), F.lit(NO_CLOSETS))).alias("block")
    )


def room_raw(drawers: DataFrame, n: int = RAW_DRAWERS) -> DataFrame:
    """Per room: the newest ``n`` drawers, each shown by its first characters."""
    order = [F.col("ts").desc_nulls_last(), F.col("id")]
    newest = top_n(drawers.select("wing", "room", "hall", "id", "ts", "content"), ["wing", "room"], order, n)
    line = F.concat(F.lit("  ["), "hall", F.lit("] "), F.substring("content", 1, RAW_CHARS))
    head = F.concat(F.lit("[L2:room="), "wing", F.lit("/"), "room", F.lit(":raw]\n"))
    lines = newest.groupBy("wing", "room").agg(join_ranked(line, F.col("rank"), "\n").alias("lines"))
    return lines.select("wing", "room", F.concat(head, "lines").alias("block"))


def deep_search_block(queries: DataFrame, results: DataFrame, text: str = "text") -> DataFrame:
    """Per query (``query_id``, ``query``): its hits from ``search`` with text, one line each."""
    place = F.concat_ws("/", F.coalesce("wing", F.lit("?")), F.coalesce("room", F.lit("?")), F.coalesce("hall", F.lit("?")))
    line = F.concat(
        F.lit("  ["), F.col("rank").cast("string"), F.lit("|"), place, F.lit("|score="),
        fixed_point(F.col("final_score"), 3), F.lit("] "), F.substring(F.coalesce(F.col(text), F.lit("")), 1, DEEP_CHARS),
    )
    lines = results.groupBy("query_id").agg(join_ranked(line, F.col("rank"), "\n").alias("lines"))
    head = F.concat(F.lit("[L3:search='"), "query", F.lit("']\n"))
    return queries.select("query_id", "query").join(lines, "query_id", "left").select(
        "query_id", F.concat(head, F.coalesce("lines", F.lit(NO_RESULTS))).alias("block")
    )
