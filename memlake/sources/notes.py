"""Note vaults, page exports and issue exports as documents, and documents as drawers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.functions.text import join_present, strip
from memlake.functions.times import as_time, parse_time
from memlake.operators.store import content_id
from memlake.sources.files import decode_text, full_path, plain_path, scan_files, stem, suffix

# Folders of a vault that hold no notes, the heading block of a note, and text lengths.
VAULT_SKIP_DIRS = (".obsidian", ".trash", "node_modules")
FRONT_MATTER = r"(?s)^---\s*\n(.*?)\n---\s*\n"
DESCRIPTION_CHARS = 500
DOCUMENT_CHARS = 4000

_STATE = "title:string,description:string,state:variant,assignee:variant,createdAt:string,updatedAt:string,id:string"


# ---- vault notes ----------------------------------------------------------------------------------------------------

def parse_notes(files: DataFrame, tags_filter: list[str] | None = None) -> DataFrame:
    """Documents from notes (``path``, ``mtime``, ``text``): body, time and heading fields.

    The time is the heading's ``created`` or ``date`` when it can be read, otherwise the file's.  ``tags`` may be one tag or
    a list in brackets or with commas; ``tags_filter`` keeps notes with any of the given tags.
    """
    # Never NULL: no heading gives an empty match.
    block = F.regexp_extract("text", FRONT_MATTER, 1)
    fields = F.filter(F.split(block, r"\r\n|\n|\r"), lambda line: F.contains(line, F.lit(":")))
    pairs = F.transform(fields, lambda line: F.struct(
        strip(F.substring_index(line, ":", 1)).alias("key"),
        strip(F.regexp_replace(line, "(?s)^[^:]*:", "")).alias("value"),
    ))
    # The last line of a repeated key wins.
    latest = F.filter(pairs, lambda p, i: ~F.exists(
        F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda later: later["key"] == p["key"]
    ))
    heading = F.map_from_entries(latest)
    raw_tags = F.try_element_at("heading", F.lit("tags"))
    tags = F.filter(
        F.transform(F.split(F.regexp_replace(raw_tags, r"^\[|\]$", ""), ","), lambda t: F.btrim(strip(t), F.lit("'\""))),
        lambda t: t != "",
    )
    notes = (
        files.withColumn("heading", heading)
        .withColumn("body", strip(F.regexp_replace("text", FRONT_MATTER, "")))
        .where(F.col("body") != "")
        .withColumn("tags", F.coalesce(tags, F.array().cast("array<string>")))
    )
    if tags_filter:
        notes = notes.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags_filter])))
    stated = F.coalesce(
        F.nullif(F.try_element_at("heading", F.lit("created")), F.lit("")),
        F.try_element_at("heading", F.lit("date")),
    )
    own = F.map_from_entries(F.array(*[
        F.struct(F.lit(key).alias("key"), value.alias("value")) for key, value in (
            ("source", F.lit("obsidian")), ("path", F.col("path")), ("title", stem(F.col("path"))), ("tags", F.to_json("tags")),
        )
    ]))
    # Heading fields replace the note's own entries of the same name, except tags.
    extra = F.map_filter("heading", lambda k, v: k != "tags")
    kept = F.map_filter(own, lambda k, v: ~F.map_contains_key(extra, k))
    return notes.select(
        F.col("body").alias("content"),
        F.coalesce(parse_time(stated), F.col("mtime")).alias("ts"),
        F.map_concat(kept, extra).alias("metadata"),
    )


def read_vault(spark: SparkSession, path: str, tags_filter: list[str] | None = None, since=None) -> DataFrame:
    return parse_notes(_markdown(spark, path, since, VAULT_SKIP_DIRS), tags_filter)


# ---- pages ----------------------------------------------------------------------------------------------------------

def parse_pages(files: DataFrame) -> DataFrame:
    """Documents from exported pages (``path``, ``mtime``, ``text``)."""
    return files.select(
        strip(F.col("text")).alias("content"), F.col("mtime").alias("ts"),
        F.create_map(F.lit("source"), F.lit("notion"), F.lit("path"), F.col("path"), F.lit("title"), stem(F.col("path"))).alias("metadata"),
    ).where(F.col("content") != "")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return parse_pages(_markdown(spark, path, None, ()))


# ---- issues ---------------------------------------------------------------------------------------------------------

def parse_issues(files: DataFrame) -> DataFrame:
    """Documents from issue exports (``path``, ``text``): a list of issues or an object with ``issues``.

    State and assignee may be an object with a name or (state) plain text.
    """
    # from_json reads a single object as a list of one, so the two forms are told apart by their first character.
    listed = F.when(F.startswith(strip(F.col("text")), F.lit("[")), F.from_json("text", f"array<struct<{_STATE}>>")).otherwise(
        F.from_json("text", f"struct<issues:array<struct<{_STATE}>>>")["issues"]
    )
    issues = files.select("path", F.explode(listed).alias("i"))

    def name_of(field: str) -> Column:
        return F.try_variant_get(F.col(field), "$.name", "string")

    def is_object(field: str) -> Column:
        return F.startswith(F.schema_of_variant(F.col(field)), F.lit("OBJECT"))

    state_text = F.when(~is_object("i.state"), F.try_variant_get("i.state", "$", "string"))
    status = F.when(is_object("i.state"), F.coalesce(name_of("i.state"), F.lit(""))).otherwise(F.nullif(state_text, F.lit("")))
    assignee = F.when(is_object("i.assignee"), F.nullif(name_of("i.assignee"), F.lit("")))
    line = lambda title, value: F.concat(F.lit(title), value)
    content = join_present(
        "\n",
        line("Title: ", F.nullif("i.title", F.lit(""))),
        line("Description: ", F.nullif(F.substring("i.description", 1, DESCRIPTION_CHARS), F.lit(""))),
        line("Status: ", status),
        line("Assignee: ", assignee),
    )
    blank = F.lit("")
    return issues.select(
        content.alias("content"),
        parse_time(F.coalesce(F.nullif("i.createdAt", blank), F.nullif("i.updatedAt", blank))).alias("ts"),
        F.create_map(
            F.lit("source"), F.lit("linear"), F.lit("id"), F.coalesce("i.id", blank),
            F.lit("title"), F.coalesce("i.title", blank), F.lit("status"), F.coalesce(status, blank),
            F.lit("assignee"), F.coalesce(assignee, blank),
        ).alias("metadata"),
    ).where(F.col("content") != "")


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    files = scan_files(spark, path, max_bytes=None, skip_dirs=(), skip_files=())
    json_files = files.where((suffix(F.col("path")) == ".json") | (F.col("path") == plain_path(F.lit(full_path(spark, path)))))
    return parse_issues(json_files.select("path", decode_text(F.col("content")).alias("text")))


# ---- registry and drawers -------------------------------------------------------------------------------------------

READERS: dict[str, Callable[..., DataFrame]] = {"obsidian": read_vault, "notion": read_pages, "linear": read_issues}


def get_reader(name: str) -> Callable[..., DataFrame]:
    """A document reader ``(spark, path, **options)`` by name; new readers are added to ``READERS``."""
    if name not in READERS:
        raise ValueError(f"unknown reader {name!r}: choose from {', '.join(sorted(READERS))}")
    return READERS[name]


def documents_to_drawers(documents: DataFrame, reader: str, as_of, wing: str = "default",
                         max_chars: int | None = None) -> DataFrame:
    """Drawers from documents, not in shorthand; the room is the stem of the document's path, else ``unknown``.

    A drawer keeps the first ``max_chars`` characters of a document (None: all of it); ``raw`` is always whole.
    """
    path = F.col("metadata")["path"]
    content = F.col("content") if max_chars is None else F.substring("content", 1, max_chars)
    # An edited note keeps its id; only a document with neither path nor id is known by its content.
    known = F.coalesce(F.nullif(path, F.lit("")), F.nullif(F.col("metadata")["id"], F.lit("")))
    return documents.select(
        F.when(known.isNotNull(), content_id(F.lit(reader), known)).otherwise(content_id(F.lit(reader), F.lit(""), F.col("content"))).alias("id"),
        F.lit(wing).alias("wing"), F.coalesce(stem(path), F.lit("unknown")).alias("room"), F.lit("facts").alias("hall"),
        content.alias("content"), F.coalesce("ts", as_time(as_of)).alias("ts"),
        F.array(F.lit("plugin"), F.lit(reader)).alias("tags"),
        F.col("content").alias("raw"), F.lit(reader).alias("source"),
    )


def _markdown(spark: SparkSession, path: str, since, skip_dirs: tuple[str, ...]) -> DataFrame:
    files = scan_files(spark, path, since, max_bytes=None, skip_dirs=skip_dirs, skip_files=())
    return files.where(suffix(F.col("path")) == ".md").select(
        "path", F.col("modificationTime").alias("mtime"), decode_text(F.col("content")).alias("text")
    )
