"""Conversation exports: format detection, one parser per format, and messages as drawers.

Parsers take a DataFrame of whole export files (``path``, ``text``) and return messages; further columns of the files are
carried along.  A file that cannot be parsed yields no messages; ``unparsed`` lists those files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.functions.shorthand import compress
from memlake.functions.text import strip
from memlake.functions.times import as_time, parse_epoch, parse_time
from memlake.operators.store import content_id
from memlake.sources.files import decode_text, scan_files, stem, suffix

# Folders left out, the shortest message kept, whose messages are facts, and the transcript heading.
SKIP_DIRS = ("__pycache__", ".git", ".venv", "venv", "node_modules")
MIN_CHARS = 20
HUMAN_ROLES = ("human", "user")
SPEAKER = r"(?iu)\*\*(Human|Assistant|User|Claude):\*\*"

FORMATS = ("claude", "chatgpt", "slack", "markdown")

_CLAUDE = "array<struct<chat_messages:array<struct<sender:string,content:variant,created_at:string>>>>"
_CHATGPT = ("array<struct<mapping:map<string,struct<message:struct<author:struct<role:string>,"
            "content:struct<parts:array<variant>>,create_time:string>>>>>")
_SLACK = "array<struct<text:string,ts:string,user:string,username:string>>"


def detect_format(path: Column, text: Column) -> Column:
    """``claude``, ``chatgpt``, ``slack``, ``markdown`` or ``unknown``, from the suffix and the first JSON object's keys."""
    keys = F.coalesce(F.json_object_keys(F.get_json_object(text, "$[0]")), F.array().cast("array<string>"))
    has = lambda key: F.array_contains(keys, key)
    kind = (
        F.when(has("chat_messages"), "claude").when(has("mapping"), "chatgpt")
        .when(has("text") & has("ts"), "slack").otherwise("unknown")
    )
    return F.when(suffix(path) == ".md", "markdown").when(suffix(path) == ".json", kind).otherwise("unknown")


def _variant_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _joined(texts: Column) -> Column:
    return F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), "\n")


def _message(convo_idx: Column, msg_idx: Column, role: Column, text: Column, ts: Column) -> Column:
    return F.struct(
        convo_idx.cast("int").alias("convo_idx"), msg_idx.cast("int").alias("msg_idx"),
        F.coalesce(role, F.lit("unknown")).alias("role"), strip(text).alias("text"), ts.alias("ts"),
    )


def claude_messages(text: Column) -> Column:
    """Message content is either one string or a list of parts whose texts are joined by line breaks."""
    def content(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        parts = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda p: F.try_variant_get(p, "$.text", "string"))
        return F.when(F.startswith(kind, F.lit("ARRAY")), _joined(parts)).when(kind == "STRING", _variant_text(value))

    return F.flatten(F.transform(F.from_json(text, _CLAUDE), lambda c, ci: F.transform(
        F.coalesce(c["chat_messages"], F.array()),
        lambda m, mi: _message(ci, mi, m["sender"], content(m["content"]), parse_time(m["created_at"])),
    )))


def chatgpt_messages(text: Column) -> Column:
    """Nodes in file order; parts joined by line breaks; times are epoch seconds."""
    return F.flatten(F.transform(F.from_json(text, _CHATGPT), lambda c, ci: F.transform(
        F.coalesce(F.map_values(c["mapping"]), F.array()),
        lambda n, ni: _message(
            ci, ni, n["message"]["author"]["role"], _joined(F.transform(n["message"]["content"]["parts"], _variant_text)),
            parse_epoch(n["message"]["create_time"]),
        ),
    )))


def slack_messages(text: Column) -> Column:
    return F.transform(F.from_json(text, _SLACK), lambda m, mi: _message(
        F.lit(0), mi, F.coalesce(m["user"], m["username"]), m["text"], parse_epoch(m["ts"])
    ))


def markdown_messages(text: Column) -> Column:
    """Text between speaker headings; text before the first heading has the role ``unknown``."""
    speakers = F.transform(
        F.regexp_extract_all(text, F.lit(SPEAKER), F.lit(1)),
        lambda s: F.when(F.lower(s).isin("human", "user"), F.lit("human")).otherwise(F.lit("assistant")),
    )
    turns = F.arrays_zip(
        F.concat(F.array(F.lit("unknown")), speakers).alias("role"), F.split(text, SPEAKER, -1).alias("body")
    )
    return F.transform(turns, lambda t, i: _message(F.lit(0), i, t["role"], t["body"], F.lit(None).cast("timestamp")))


PARSERS = {
    "claude": claude_messages, "chatgpt": chatgpt_messages, "slack": slack_messages, "markdown": markdown_messages,
}


def parse_exports(files: DataFrame) -> DataFrame:
    """Messages of all formats from export files (``path``, ``text``), in one pass: each file meets its own parser only."""
    carried = [c for c in files.columns if c != "text"]
    messages = F.lit(None)
    for name, parser in PARSERS.items():
        messages = F.when(F.col("format") == name, parser(F.col("text"))).otherwise(messages)
    tagged = files.withColumn("format", detect_format(F.col("path"), F.col("text")))  # unknown: no messages
    return tagged.select(*carried, "format", F.inline(messages)).where(F.col("text") != "")


def unparsed(files: DataFrame) -> DataFrame:
    """Export files (path, text) that are no valid JSON, or of a known JSON format whose content is not valid for it: (path, format)."""
    tagged = files.withColumn("format", detect_format(F.col("path"), F.col("text")))
    schemas = {"claude": _CLAUDE, "chatgpt": _CHATGPT, "slack": _SLACK}
    broken = (suffix(F.col("path")) == ".json") & F.try_parse_json("text").isNull()
    for name, schema in schemas.items():
        broken = broken | ((F.col("format") == name) & F.from_json("text", schema).isNull())
    return tagged.where(broken).select("path", "format")


def scan_exports(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Export files below ``path`` as (path, text)."""
    files = scan_files(spark, path, since, max_bytes=None, skip_dirs=SKIP_DIRS, skip_files=())
    return files.where(suffix(F.col("path")).isin(".md", ".json")).select(
        "path", decode_text(F.col("content")).alias("text")
    )


def messages_to_drawers(messages: DataFrame, as_of, wing: str = "default", room: str | Column | None = None,
                        carry: tuple[str, ...] = ()) -> DataFrame:
    """Drawers from messages of at least ``MIN_CHARS`` characters, keeping ``raw`` and ``role`` for the vector entry."""
    place = stem(F.col("path")) if room is None else (room if isinstance(room, Column) else F.lit(room))
    hall = F.when(F.col("role").isin(*HUMAN_ROLES), "facts").otherwise("discoveries")
    return messages.where(F.length("text") >= MIN_CHARS).select(
        content_id(F.col("path"), F.col("convo_idx"), F.col("msg_idx")).alias("id"),
        F.lit(wing).alias("wing"), place.alias("room"), hall.alias("hall"),
        compress(F.col("text")).alias("content"),
        F.coalesce(F.col("ts"), as_time(as_of)).alias("ts"),
        F.array(F.lit("conversation"), F.col("role")).alias("tags"),
        F.col("text").alias("raw"), "role", *carry,
    )


def mine_conversations(spark: SparkSession, path: str, as_of, wing: str = "default", room: str | None = None,
                       since=None) -> DataFrame:
    return messages_to_drawers(parse_exports(scan_exports(spark, path, since)), as_of, wing, room)
