"""Table schemas and the small fixed vocabularies the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

# The hall names a memory may be filed under, in display order.
HALL_TYPES = ("facts", "events", "discoveries", "preferences", "advice")

# Defaults of the recency model.
DECAY_FACTOR = 0.005
DECAY_MAX_DAYS = 90

# Fixed value: characters of raw text a vector entry keeps beside its embedding.
# Pass ``excerpt_chars=None`` to keep (and embed) the whole text instead.
EXCERPT_CHARS: int | None = None

EMBED_DIM = 384

DRAWER = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("wing", T.StringType(), False),
    T.StructField("room", T.StringType(), False),
    T.StructField("hall", T.StringType(), False),
    T.StructField("content", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("pinned", T.BooleanType()),
    T.StructField("decay_weight", T.DoubleType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

CLOSET = T.StructType([
    T.StructField("wing", T.StringType(), False),
    T.StructField("room", T.StringType(), False),
    T.StructField("hall", T.StringType(), False),
    T.StructField("content", T.StringType()),
    T.StructField("updated", T.TimestampType()),
])

WING = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("created", T.TimestampType()),
    T.StructField("description", T.StringType()),
])

ROOM = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("wing", T.StringType(), False),
    T.StructField("created", T.TimestampType()),
    T.StructField("description", T.StringType()),
])

TUNNEL = T.StructType([
    T.StructField("room", T.StringType(), False),
    T.StructField("source_wing", T.StringType(), False),
    T.StructField("target_wing", T.StringType(), False),
    T.StructField("created", T.TimestampType()),
])

TRIPLE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("subject", T.StringType(), False),
    T.StructField("predicate", T.StringType(), False),
    T.StructField("object", T.StringType(), False),
    T.StructField("valid_from", T.TimestampType()),
    T.StructField("valid_until", T.TimestampType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("source", T.StringType()),
])

VECTOR = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("wing", T.StringType()),
    T.StructField("room", T.StringType()),
    T.StructField("hall", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("pinned", T.BooleanType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

DIARY = T.StructType([
    T.StructField("agent", T.StringType(), False),
    T.StructField("content", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

AGENT = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("focus", T.StringType()),
    T.StructField("model_hint", T.StringType()),
    T.StructField("created", T.TimestampType()),
    T.StructField("diary_path", T.StringType()),
])

# What every note, page or issue reader returns.
DOCUMENT = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

# What every conversation reader returns.
MESSAGE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("convo_idx", T.IntegerType()),
    T.StructField("msg_idx", T.IntegerType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

# What a look at a folder found: each file with the ids of what it became.
FOLDER_STATE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids", T.ArrayType(T.StringType())),
])
