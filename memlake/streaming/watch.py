"""Watch mode: files that arrive in a folder become drawers and vector entries, continuously.

``watch`` follows a stream of files, such as Spark's file source, which reports every path once.  ``watch_changes`` looks at the folder
again and again instead: it also sees files that were changed, shortened or deleted, and takes away what they no longer hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from memlake.functions.vectors import digest_embedding
from memlake.operators.claims import text_conflicts
from memlake.operators.ranking import latest
from memlake.operators.tables import read_current, table_exists, write_change
from memlake.schema import EXCERPT_CHARS, FOLDER_STATE
from memlake.session import materialise
from memlake.sources import conversations as cv
from memlake.sources import files as fi
from memlake.sources.entries import drawer_columns, vector_entries

# Suffixes that are watched.
WATCHED = (".py", ".js", ".ts", ".md", ".txt", ".json", ".yaml")

_BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def watch_folder(spark: SparkSession, path: str, max_files_per_trigger: int = 10_000) -> DataFrame:
    """Stream of new files (path, mtime, length, text, is_text) with a watched suffix, at any depth."""
    arrived = (
        spark.readStream.format("binaryFile").schema(_BINARY_FILE)
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files_per_trigger).load(path)
    )
    return watched_text(arrived)


def watched_text(files: DataFrame) -> DataFrame:
    path = fi.plain_path(F.col("path"))
    return files.withColumn("path", path).where(fi.suffix(F.col("path")).isin(*WATCHED)).select(
        "path", F.col("modificationTime").alias("mtime"), "length",
        fi.decode_text(F.col("content")).alias("text"), fi.looks_like_text(F.col("path"), F.col("content")).alias("is_text"),
    )


def changed_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (path, mtime, ...) not yet ingested in their present state; ``seen`` has (path, mtime)."""
    return files.join(seen.select("path", "mtime"), ["path", "mtime"], "left_anti")


def ingest_batch(
    files: DataFrame,
    name: str,
    drawers_path: str,
    vectors_path: str | None,
    errors_path: str | None,
    as_of,
    wing: str = "default",
    mode: str = "files",
    embedder: Callable[[Column], Column] = digest_embedding,
    excerpt_chars: int | None = EXCERPT_CHARS,
) -> None:
    """Ingest one batch of files (path, mtime, length, text, is_text) as change set ``name``.

    A path that occurs twice in the batch is taken in its newest state.  Ids come from the path (and the message's place in
    it), and the file time orders versions, so ingesting a batch again changes nothing.  Files that are not text or, in
    ``convos`` mode, not a known export, go to the error table; they never stop the batch.
    """
    files = latest(files, ["path"], [F.col("mtime").desc()])
    good, reason = _usable(mode)
    mined, extra = _mined(files.where(good), as_of, wing, mode)
    seq = F.unix_micros(F.col("mtime").cast("timestamp"))
    write_change(drawer_columns(mined, "mtime"), drawers_path, name, seq)
    if vectors_path is not None:
        entries = vector_entries(mined, embedder=embedder, excerpt_chars=excerpt_chars, extra=extra, carry=("mtime",))
        write_change(entries, vectors_path, name, seq)
    if errors_path is not None:
        rejected = files.where(~F.coalesce(good, F.lit(False))).select("path", "mtime", F.lit(reason).alias("reason"))
        write_change(rejected, errors_path, name, seq)


def _usable(mode: str) -> tuple[Column, str]:
    """Which files (path, text, is_text) the mode takes, and what is said of the others."""
    if mode == "files":
        return F.col("is_text"), "not text"
    if mode == "convos":
        return F.col("is_text") & (cv.detect_format(F.col("path"), F.col("text")) != "unknown"), "not a known export"
    raise ValueError(f"unknown mode {mode!r}: use files or convos")


def _mined(usable: DataFrame, as_of, wing: str, mode: str) -> tuple[DataFrame, tuple[str, ...]]:
    """What the files become, with their path and mtime, and the columns that go into the metadata."""
    if mode == "files":
        # A single watched file is filed under its own name.
        return fi.files_to_drawers(usable, as_of, wing, fi.stem(F.col("path")), carry=("mtime",)), ("path",)
    messages = cv.parse_exports(usable.select("path", "mtime", "text"))
    return cv.messages_to_drawers(messages, as_of, wing, carry=("path", "mtime")), ("role",)


def poll_folder(
    spark: SparkSession,
    path: str,
    state_path: str,
    name: str,
    at: int,
    drawers_path: str,
    vectors_path: str | None = None,
    errors_path: str | None = None,
    as_of=None,
    wing: str = "default",
    mode: str = "files",
    embedder: Callable[[Column], Column] = digest_embedding,
    excerpt_chars: int | None = EXCERPT_CHARS,
) -> bool:
    """One look at a folder, as change set ``name``; whether anything had changed.

    The folder's state at the last look is a table at ``state_path``: path, mtime, length and the ids of what the file became.  Files whose
    state is new are read and ingested; ids that a changed file no longer gives, and all ids of a deleted one, are deleted from drawers
    and vectors.  ``at`` (microseconds) is the time of the look and orders versions: later looks win, whatever the files' own times are.
    Files that can't be read go to the error table and are tried again at the next look.  The state is written last, in one change set,
    so a look that failed half-way is done again from the same state and replaces its own change sets.
    """
    listed = fi.list_files(spark, path).where(F.col("error").isNull() & fi.suffix(F.col("path")).isin(*WATCHED)).select(
        "path", F.col("modificationTime").alias("mtime"), "length")
    if table_exists(spark, state_path):
        known = read_current(spark, state_path, ["path"], FOLDER_STATE)
    else:
        known = spark.createDataFrame([], FOLDER_STATE)
    same = (F.col("path") == F.col("_path")) & F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("length").eqNullSafe(F.col("_length"))
    changed = listed.join(known.select(F.col("path").alias("_path"), F.col("mtime").alias("_mtime"), F.col("length").alias("_length")), same, "left_anti")
    gone = known.join(listed.select("path"), "path", "left_anti")
    if changed.isEmpty() and gone.isEmpty():
        return False

    read = fi.read_files(changed.select("path", F.col("mtime").alias("modificationTime"), "length", F.lit(None).cast("string").alias("error")))
    files = materialise(read.select(
        "path", F.col("modificationTime").alias("mtime"), "length", fi.decode_text(F.col("content")).alias("text"),
        F.coalesce(fi.looks_like_text(F.col("path"), F.col("content")), F.lit(False)).alias("is_text"), "error"))
    good, reason = _usable(mode)
    mined, extra = _mined(files.where(F.col("error").isNull() & good), as_of, wing, mode)
    seq = F.lit(at)
    now = materialise(mined.select("path", "id"))
    before = known.join(files.where("error is null").select("path"), "path", "left_semi").unionByName(gone).select(F.explode("ids").alias("id"))
    vanished = before.join(now, "id", "left_anti").distinct()

    def write(rows: DataFrame, table: str) -> None:
        write_change(rows, table, name, seq)
        blank = [F.col("id") if f.name == "id" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
        write_change(vanished.select(*blank), table, f"{name}-gone", seq, deleted=F.lit(True))

    write(drawer_columns(mined), drawers_path)
    if vectors_path is not None:
        write(vector_entries(mined, embedder=embedder, excerpt_chars=excerpt_chars, extra=extra), vectors_path)
    if errors_path is not None:
        said = F.coalesce("error", F.when(~F.coalesce(good, F.lit(False)), F.lit(reason)))
        write_change(files.select("path", "mtime", said.alias("reason")).where("reason is not null"), errors_path, name, seq)
    ids = now.groupBy("path").agg(F.collect_list("id").alias("ids"))  # at most the messages of one file
    state = files.where("error is null").select("path", "mtime", "length").join(ids, "path", "left").select(
        "path", "mtime", "length", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), F.lit(False).alias("is_gone"))
    rows = state.unionByName(gone.withColumn("is_gone", F.lit(True)))
    write_change(rows, state_path, name, seq, deleted=F.col("is_gone"))
    return True


def watch_changes(spark: SparkSession, path: str, state_path: str, drawers_path: str, as_of, interval: str = "10 seconds", **options) -> StreamingQuery:
    """Looks at the folder every ``interval``; ``query.stop()`` ends it.  ``options`` are those of ``poll_folder``.

    A clock stream drives the looks, so that they are numbered and one that failed is repeated under its number when the stream starts
    again.
    """
    def each_batch(batch: DataFrame, number: int) -> None:
        at = batch.agg(F.max(F.unix_micros("timestamp"))).first()[0]
        if at is not None:
            poll_folder(spark, path, state_path, f"look-{number:012d}", at, drawers_path, as_of=as_of, **options)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(each_batch).option("checkpointLocation", f"{state_path}/_checkpoint").trigger(processingTime=interval).start()


def without_repeats(files: DataFrame, within: str) -> DataFrame:
    """A stream of files (path, mtime, text, ...) without those that repeat path and text of an earlier one by less than ``within``."""
    hashed = files.withColumn("mtime", F.col("mtime").cast("timestamp")).withColumn("_text", F.md5(F.coalesce("text", F.lit(""))))
    return hashed.withWatermark("mtime", within).dropDuplicatesWithinWatermark(["path", "_text"]).select(*files.columns)


def watch(
    files: DataFrame,
    drawers_path: str,
    as_of,
    wing: str = "default",
    mode: str = "files",
    vectors_path: str | None = None,
    errors_path: str | None = None,
    checkpoint: str | None = None,
    available_now: bool = False,
    burst: str | None = None,
    **options,
) -> StreamingQuery:
    """Start the stream; ``query.stop()`` ends it.

    ``files`` is ``watch_folder`` or any stream of the same columns.  The checkpoint lives with the table by default, so
    micro-batch numbers, which name the change sets, belong to one table.

    Editors and copies report a file several times in a row.  With ``burst`` (such as ``10 minutes``) a path that comes again with the
    same text within that time is left out before anything is embedded or written; the state kept for it is bounded by that time.
    """
    if burst is not None:
        files = without_repeats(files, burst)

    def each_batch(batch: DataFrame, number: int) -> None:
        batch.persist()  # read for drawers, vectors and errors
        try:
            if batch.isEmpty():
                return
            name = f"stream-{number:012d}"
            ingest_batch(batch, name, drawers_path, vectors_path, errors_path, as_of, wing, mode, **options)
        finally:
            batch.unpersist()

    writer = files.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint or f"{drawers_path}/_checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def watch_conflicts(files: DataFrame, triples: DataFrame, as_of, conflicts_path: str, available_now: bool = False) -> StreamingQuery:
    """Check every arriving text against the stored assignments; conflicts are written per micro-batch.

    A conflict is identified by path, verb, claim_no and stored_id: read the table with these keys.
    """
    def each_batch(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        found = text_conflicts(batch.where("is_text").select("path", "mtime", "text"), triples, as_of)
        write_change(found.withColumn("stored_id", F.col("stored.id")), conflicts_path, f"stream-{number:012d}",
                     F.unix_micros(F.col("mtime").cast("timestamp")))

    writer = files.writeStream.foreachBatch(each_batch).option("checkpointLocation", f"{conflicts_path}/_checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
