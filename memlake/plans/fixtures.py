"""Memory tables derived from the given analytical tables.

Every view covers its whole source table.  ``oracles.py`` states the same derivations as SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memlake.session import use_all_cores, use_utc
from memlake.sources.files import _filesystem

AS_OF = "2024-01-20 00:00:00"
BASE = "2023-08-01 00:00:00"

# Turns of a conversation that share one generated export file; bounds every file.
TURNS_PER_FILE = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_all_cores(table(spark, sf_dir, "documents"), "doc_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_all_cores(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_all_cores(table(spark, sf_dir, "pages"), "page_id")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream; it may be one Parquet file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _tag(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _after_base(minutes: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit(BASE).cast("timestamp")) + minutes.cast("long") * 60_000_000)


def _ntz(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def drawers(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.concat(conv.cast("string"), F.lit("-"), turn.cast("string")).alias("id"),
        _tag("w", conv % 7).alias("wing"),
        _tag("r", conv % 23).alias("room"),
        F.when((conv * 7 + turn) % 41 == 0, "misc")
        .when(F.col("role").isin("human", "user"), "facts")
        .otherwise("discoveries").alias("hall"),
        F.col("text").alias("content"),
        F.col("role"),
        _ntz(_after_base(((conv % 7) * 28 + conv % 10) * 1440 + turn)).alias("ts"),
        ((conv * 13 + turn) % 17 == 0).alias("pinned"),
    )


def tunnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    room_no, wing_no = F.substring("room", 2, 9).cast("int"), F.substring("wing", 2, 9).cast("int")
    return (
        drawers(spark, sf_dir).where(room_no % 5 == 0)
        .select("room", F.col("wing").alias("source_wing"), _tag("w", (wing_no + 1) % 7).alias("target_wing"))
        .distinct()
    )


def closets(spark: SparkSession, sf_dir: str) -> DataFrame:
    room_no = F.substring("room", 2, 9).try_cast("int")
    return (
        drawers(spark, sf_dir).where((room_no % 3 != 0) & (F.col("hall") != "misc"))
        .groupBy("wing", "room", "hall").agg(F.min("content").alias("content"), F.max("ts").alias("updated"))
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    ends = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (event % 15 + 1) * 86_400_000_000)
    return table(spark, sf_dir, "events").select(
        event.alias("id"),
        _tag("u", F.col("user_id")).alias("subject"),
        F.col("event_type").alias("predicate"),
        F.concat(F.lit("k"), F.regexp_extract("props", "([0-9]+)", 1)).alias("object"),
        F.when(event % 29 != 0, F.col("ts")).alias("valid_from"),
        F.when(event % 3 != 0, _ntz(ends)).alias("valid_until"),
        ((F.lit(1) + event % 4).cast("double") / 4).alias("confidence"),
        F.lit("event").alias("source"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.col("vec_id")
    hall = F.element_at(
        F.array(*[F.lit(h) for h in ("facts", "events", "discoveries", "preferences", "advice")]),
        (vec % 5 + 1).cast("int"),
    )
    return table(spark, sf_dir, "embeddings").select(
        _tag("v", vec).alias("id"),
        _tag("w", F.col("label") % 7).alias("wing"),
        _tag("r", vec % 23).alias("room"),
        hall.alias("hall"),
        _ntz(_after_base((vec % 500) * 8 * 60)).alias("ts"),
        (vec % 17 == 0).alias("pinned"),
        F.col("label"),
        F.col("embedding"),
    )


def topic_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean of all its vectors."""
    return (
        table(spark, sf_dir, "embeddings")
        .select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("xs"))
        .select(F.col("label").alias("query_id"), F.transform("xs", lambda e: e["x"]).alias("embedding"))
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(table(spark, sf_dir, "documents"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for queries that work on the whole text."""
    return files_of(documents(spark, sf_dir))


def files_of(docs: DataFrame, *more: str) -> DataFrame:
    doc = F.col("doc_id")
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in (".py", ".md", ".txt", ".sh", ".json", ".go", ".log", ".rst")]),
        (doc % 8 + 1).cast("int"),
    )
    return docs.select(
        "doc_id",
        F.concat(F.lit("/data/"), "source", F.lit("/"), "lang", F.lit("/f"), doc.cast("string"), suffix).alias("path"),
        _ntz(_after_base(doc)).alias("mtime"),
        F.col("n_chars").alias("length"),
        "text",
        *more,
    )


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    ends = F.timestamp_micros(F.unix_micros(date.cast("timestamp")) + F.lit(30 * 86_400_000_000))
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        _tag("Clerk", F.col("o_custkey") % 50).alias("subject"),
        F.lit("assigned_to").alias("predicate"),
        _tag("task-", key).alias("object"),
        date.alias("valid_from"),
        F.when(F.col("o_orderstatus") == "F", _ntz(ends)).alias("valid_until"),
        F.lit(1.0).alias("confidence"),
        F.lit("orders").alias("source"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims_of(table(spark, sf_dir, "orders"))


def claims_of(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    person = _tag("Clerk", (F.col("o_custkey") + key % 2) % 50)
    return orders.select(
        key.alias("claim_id"),
        F.concat(person, F.lit(" finished the task-"), key.cast("string"), F.lit(". Then rest.")).alias("text"),
    )


def diary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawers(spark, sf_dir).select(
        F.col("role").alias("agent"), F.col("content"), F.col("ts"), F.col("id"),
    )


def turn_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with the export file they are written to: at most ``TURNS_PER_FILE`` turns per file."""
    part = F.floor(F.col("turn") / TURNS_PER_FILE).cast("string")
    return turns(spark, sf_dir).withColumn(
        "file", F.concat(F.lit("/exports/c"), F.col("conv_id").cast("string"), F.lit("_"), part)
    )


def write_joined(pieces: DataFrame, path: str) -> None:
    """Write texts (column ``text``) one after the other, in the order they come in, as one JSON list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, where = _filesystem(path)
        filesystem.create_dir(where.rsplit("/", 1)[0], recursive=True)
        with filesystem.open_output_stream(where) as stream:
            comma = b"["
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    stream.write(comma + text.encode())
                    comma = b",\n"
            stream.write(b"]")
        yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

    pieces.select("text").mapInArrow(run, "n long").collect()


def write_files(files: DataFrame, root: str) -> None:
    """Write each text (path, text; a null text deletes the file) below ``root``, by the tasks that have the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                filesystem, where = _filesystem(root + path)
                if text is None:
                    filesystem.delete_file(where)
                    continue
                if (folder := where.rsplit("/", 1)[0]) != made:
                    filesystem.create_dir(folder, recursive=True)
                    made = folder
                with filesystem.open_output_stream(where) as stream:
                    stream.write(text.encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    files.select("path", "text").mapInArrow(run, "n long").agg(F.sum("n")).collect()
