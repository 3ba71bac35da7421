"""Project files: scan, classify and turn into drawers."""

from __future__ import annotations

import mimetypes
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from memlake.functions.shorthand import compress
from memlake.functions.text import is_blank
from memlake.functions.times import as_time
from memlake.session import materialise, spread

# Hall of a file by its extension (everything else is a fact), extensions treated as code, names left out of a
# scan and the largest file read.
EXTENSION_HALLS = {
    ".py": "discoveries", ".js": "discoveries", ".ts": "discoveries", ".tsx": "discoveries", ".jsx": "discoveries",
    ".go": "discoveries", ".rs": "discoveries", ".c": "discoveries", ".cpp": "discoveries", ".java": "discoveries",
    ".rb": "discoveries", ".php": "discoveries",
    ".md": "facts", ".rst": "facts", ".txt": "facts", ".json": "facts", ".yaml": "facts", ".yml": "facts",
    ".toml": "facts", ".env": "facts",
    ".sh": "advice", ".bash": "advice", ".zsh": "advice",
}
DEFAULT_HALL = "facts"
CODE_EXTENSIONS = (".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".c", ".cpp", ".java", ".rb", ".php")
SKIP_DIRS = (
    "__pycache__", ".git", ".venv", "venv", "node_modules", ".mypy_cache", ".pytest_cache", "dist", "build", ".eggs",
    "chroma_db", ".memlake",
)
SKIP_FILES = (".DS_Store", "Thumbs.db", ".gitignore")
MAX_FILE_BYTES = 500_000  # a usual ``max_bytes``; without one every file is read
SNIFF_BYTES = 512

_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("error", T.StringType()),
])
#: A round of listing: files, and folders still to be listed.
_STEP = T.StructType([*_FILE.fields[:3], T.StructField("error", T.StringType()), T.StructField("open", T.BooleanType())])
_FOLDERS_PER_ROUND = 1000
# Read contents that are handed on together: so many bytes or files at most, or one larger file.
_BATCH_BYTES, _BATCH_FILES = 1 << 20, 1000


# ---- path parts -----------------------------------------------------------------------------------------------------

def plain_path(path: Column) -> Column:
    """Local file URIs as plain paths; other schemes stay as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Extension with its dot; empty for names without one and for names that only start with a dot."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def parent_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def file_id(path: Column) -> Column:
    """Stable id of a file, so reading it again updates its drawer."""
    return F.substring(F.sha2(path, 256), 1, 16)


# ---- scan -----------------------------------------------------------------------------------------------------------

def scan_files(
    spark: SparkSession,
    path: str,
    since=None,
    max_bytes: int | None = None,
    skip_dirs: tuple[str, ...] = SKIP_DIRS,
    skip_files: tuple[str, ...] = SKIP_FILES,
) -> DataFrame:
    """All files below ``path``, or the file ``path``, as (path, modificationTime, length, content, error).

    Names that start with ``_`` or ``.`` (such as ``__init__.py``), which Spark's own listing leaves out, are files like others.  A
    folder that can't be listed or a file that can't be read is a row with its ``error`` and no content; the others are not affected.
    Size and time limits hold before any content is read.

    Stores that only Spark's readers reach (see ``list_files``) are read with its ``binaryFile`` source: without those names, and one
    unreadable file ends the job there.
    """
    return read_files(select_files(list_files(spark, path, skip_dirs), since, max_bytes, skip_files))


def list_files(spark: SparkSession, path: str, skip_dirs: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """The files below ``path`` as (path, modificationTime, length, error), contents unread.

    Folders are listed by tasks, in rounds: a task walks on from the folders it was given, and what it has not reached after
    ``_FOLDERS_PER_ROUND`` folders is dealt to all tasks again in the next round.  So neither the driver nor one task lists a large tree,
    and wide and deep trees take few rounds.
    """
    root = full_path(spark, path)
    if not _is_known(root):
        return _listed_by_spark(spark, root, skip_dirs)
    frontier = spark.createDataFrame([(root,)], "folder string").coalesce(1)
    rounds: list[DataFrame] = []
    while True:
        step = materialise(frontier.mapInArrow(_walk(root, skip_dirs), _STEP))
        rounds.append(step.where(~F.col("open")))
        frontier = spread(step.where("open").select(F.col("path").alias("folder")), "folder")
        if frontier.isEmpty():
            break
    return reduce(DataFrame.unionAll, rounds).drop("open").withColumn("path", plain_path(F.col("path")))


def select_files(listed: DataFrame, since=None, max_bytes: int | None = None, skip_files: tuple[str, ...] = ()) -> DataFrame:
    """Listed files within the limits; rows with an error stay.  A time that can't be read is no limit."""
    failed = F.col("error").isNotNull()
    if max_bytes is not None:
        listed = listed.where(failed | (F.col("length") <= max_bytes))
    if since is not None:
        start = F.try_to_timestamp(F.lit(since)) if isinstance(since, str) else as_time(since)
        listed = listed.where(failed | start.isNull() | (F.col("modificationTime") >= start))
    return listed.where(~file_name(F.col("path")).isin(*skip_files)) if skip_files else listed


def read_files(listed: DataFrame) -> DataFrame:
    """Listed files with their ``content``, spread over all tasks by path and opened one by one."""
    if "content" in listed.columns:
        return listed
    return spread(listed, "path").mapInArrow(_read_contents, _FILE)


def unreadable(files: DataFrame) -> DataFrame:
    """What a scan could not list or read: (path, error)."""
    return files.where(F.col("error").isNotNull()).select("path", "error")


def full_path(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark resolves it, without a trailing slash."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/")


def _listed_by_spark(spark: SparkSession, root: str, skip_dirs: tuple[str, ...]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.split(F.replace("path", F.lit(root + "/"), F.lit("")), "/")
    in_skipped = F.arrays_overlap(F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0))), F.array(*[F.lit(d) for d in skip_dirs]).cast("array<string>"))
    return files.where(~in_skipped).withColumn("error", F.lit(None).cast("string"))


def _filesystem(uri: str):
    """File system and the path in it.  Names of the same store in other systems' spelling are known too."""
    from pyarrow import fs

    if uri.startswith("file:") or uri.startswith("/"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    for other, usual in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if uri.startswith(other):
            uri = usual + uri.removeprefix(other)
    return fs.FileSystem.from_uri(uri)


def _is_known(uri: str) -> bool:
    """Whether tasks can open this store without Spark's readers."""
    try:
        _filesystem(uri)
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


def _walk(root: str, skip_dirs: tuple[str, ...]):
    def rows(folder: str) -> Iterator[tuple]:
        """Files and unreached folders (``open``) below a folder."""
        from pyarrow import fs

        filesystem, start = _filesystem(folder)
        scheme = folder[: len(folder) - len(start)] if not folder.startswith("file:") else ""
        info = filesystem.get_file_info(start)
        if info.type != fs.FileType.Directory:
            if folder == root:
                yield scheme + start, info.mtime, info.size, None if info.type == fs.FileType.File else "not found", False
            return
        waiting, reached = [start], 0
        while waiting and reached < _FOLDERS_PER_ROUND:
            here = waiting.pop()
            reached += 1
            try:
                found = filesystem.get_file_info(fs.FileSelector(here))
            except OSError as error:
                yield scheme + here, None, None, _said(error), False
                continue
            for info in found:
                if info.type != fs.FileType.Directory:
                    yield scheme + info.path, info.mtime, info.size, None, False
                elif info.base_name not in skip_dirs:
                    waiting.append(info.path)
        for rest in waiting:
            yield (scheme or "file:") + rest, None, None, None, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def given() -> pa.RecordBatch:
            paths, times, sizes, errors, unreached = zip(*out)
            return pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(times, pa.timestamp("us", "UTC")), pa.array(sizes, pa.int64()), pa.array(errors, pa.string()),
                 pa.array(unreached, pa.bool_())], names=_STEP.names)

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for row in rows(folder):
                    out.append(row)
                    if len(out) >= 10_000:
                        yield given()
                        out = []
        if out:
            yield given()

    return run


def _said(error: Exception) -> str:
    return f"{type(error).__name__}: {str(error).splitlines()[0]}"


def _read_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
    for batch in batches:
        rows, held = [], 0
        for row in batch.select(["path", "modificationTime", "length", "error"]).to_pylist():
            content = None
            if row["error"] is None:
                try:
                    filesystem, path = _filesystem(row["path"])
                    with filesystem.open_input_stream(path) as stream:
                        content = stream.read()
                except OSError as failure:
                    row["error"] = _said(failure)
            size = len(content or b"")
            if rows and (held + size > _BATCH_BYTES or len(rows) >= _BATCH_FILES):  # small batches keep memory flat
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
            rows.append({**row, "content": content})
            held += size
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


# ---- text and class -------------------------------------------------------------------------------------------------

def non_text_extensions() -> list[str]:
    """Extensions whose registered media type is not text, except those the hall table names."""
    known = mimetypes.MimeTypes(filenames=()).types_map[True]
    return sorted(e for e, kind in known.items() if not kind.startswith("text") and e not in EXTENSION_HALLS)


def looks_like_text(path: Column, content: Column) -> Column:
    """The extension is not a known binary one and the first bytes are UTF-8 (the last character may be cut)."""
    head = lambda n: F.is_valid_utf8(F.substring(content, 1, n).cast("string"))
    starts = head(SNIFF_BYTES)
    for cut in (1, 2, 3):
        starts = starts | ((F.length(content) > SNIFF_BYTES) & head(SNIFF_BYTES - cut))
    return ~F.lower(suffix(path)).isin(*non_text_extensions()) & starts


def decode_text(content: Column) -> Column:
    """Bytes as text, malformed sequences replaced."""
    return F.make_valid_utf8(content.cast("string"))


def read_text(files: DataFrame) -> DataFrame:
    """Scanned files that hold text, decoded: (path, mtime, length, text)."""
    return files.where(looks_like_text(F.col("path"), F.col("content"))).select(
        "path", F.col("modificationTime").alias("mtime"), "length", decode_text(F.col("content")).alias("text")
    )


def classify(files: DataFrame) -> DataFrame:
    """Add ``ext``, ``hall`` and ``is_code`` from the path."""
    ext = F.lower(suffix(F.col("path")))
    halls = F.create_map(*[F.lit(x) for pair in EXTENSION_HALLS.items() for x in pair])
    return files.withColumn("ext", ext).withColumn(
        "hall", F.coalesce(F.try_element_at(halls, F.col("ext")), F.lit(DEFAULT_HALL))
    ).withColumn("is_code", F.col("ext").isin(*CODE_EXTENSIONS))


def files_to_drawers(files: DataFrame, as_of, wing: str = "default", room: str | Column | None = None,
                     max_bytes: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drawers from text files (path, length, text), keeping ``raw`` and ``path`` for the vector entry.

    The room is the given one or the name of the file's folder.  Blank and oversized files are left out.
    """
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    place = parent_name(F.col("path")) if room is None else (room if isinstance(room, Column) else F.lit(room))
    return classify(files.where(~is_blank(F.col("text")))).select(
        file_id(F.col("path")).alias("id"),
        F.lit(wing).alias("wing"), place.alias("room"), "hall",
        compress(F.col("text"), is_code=F.col("is_code")).alias("content"),
        as_time(as_of).alias("ts"),
        F.array(F.replace("ext", F.lit("."), F.lit("")), F.lit("file")).alias("tags"),
        F.col("text").alias("raw"), "path", *carry,
    )


def mine_files(spark: SparkSession, path: str, as_of, wing: str = "default", room: str | None = None, since=None) -> DataFrame:
    """Drawers of all text files below ``path``; a single file's room is its stem.

    Pass the result to ``drawer_columns`` and ``vector_entries`` for the two tables.
    """
    files = read_text(scan_files(spark, path, since))
    single = F.col("path") == plain_path(F.lit(full_path(spark, path)))
    place = F.lit(room) if room else F.when(single, stem(F.col("path"))).otherwise(parent_name(F.col("path")))
    return files_to_drawers(files, as_of, wing, place)
