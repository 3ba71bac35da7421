"""From raw text to the two stored forms: the drawer (shorthand) and the vector entry (embedding of the raw text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions.vectors import digest_embedding
from memlake.operators.vectors import metadata_map, metadata_value
from memlake.schema import EXCERPT_CHARS

_DRAWER_COLUMNS = ["id", "wing", "room", "hall", "content", "ts", "pinned", "decay_weight", "tags"]


def drawer_columns(df: DataFrame, *carry: str) -> DataFrame:
    """The stored drawer columns of an ingested frame (defaults for those it does not set), and ``carry``."""
    if "pinned" not in df.columns:
        df = df.withColumn("pinned", F.lit(False))
    return df.withColumn("decay_weight", F.lit(1.0)).select(*_DRAWER_COLUMNS, *carry)


def vector_entries(
    df: DataFrame,
    raw: str = "raw",
    embedder: Callable[[Column], Column] = digest_embedding,
    excerpt_chars: int | None = EXCERPT_CHARS,
    extra: tuple[str, ...] = (),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Vector entries of an ingested frame that still carries its raw text.

    An entry keeps an excerpt of the raw text (``excerpt_chars``; None keeps all of it) and embeds exactly what it keeps.
    ``extra`` names further columns that go into the metadata, lists and structs as JSON.
    """
    text = F.col(raw) if excerpt_chars is None else F.substring(F.col(raw), 1, excerpt_chars)
    pinned = F.col("pinned") if "pinned" in df.columns else F.lit(False)
    details = {name: metadata_value(df, name) for name in ("wing", "room", "hall", *extra)}
    details["timestamp"] = F.col("ts").cast("string")
    return df.select(
        "id", text.alias("text"), "wing", "room", "hall", "ts", pinned.alias("pinned"), metadata_map(**details).alias("metadata"),
        *carry,
    ).withColumn("embedding", F.transform(embedder(F.col("text")), lambda x: x.cast("float")))
