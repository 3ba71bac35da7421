"""Writing tables that change: a base plus change sets, merged when read.

Parquet has no row updates, and rewriting a large table for every small batch does not scale.  A table folder therefore holds
``base`` (one row per key) and change sets beside it; reading takes the newest version of each key.  A change set is named by
its writer (for a stream: the micro-batch number), and writing it again replaces it, so a repeated batch leaves no duplicates.
``_seq`` orders the versions of a key.  ``compact`` writes the merged table as the base of a new folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from memlake.operators.ranking import latest

BASE = "base"
CHANGES = "changes"
_MARKS = [T.StructField("_seq", T.LongType()), T.StructField("_deleted", T.BooleanType()), T.StructField("change", T.StringType())]


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Write a complete table (one row per key), for example drawers partitioned by wing and hall.

    Rows are rebalanced by the partition columns first: small partitions share a task and so get one file, and Spark splits
    those that are too large.  ``sort_by`` orders the rows of each file, so that lookups on these columns (``id``, ``subject``)
    skip row groups by their statistics.  A folder that already has change sets is refused: they are newer than any base, so
    they would show through the new rows.
    """
    if _exists(df.sparkSession, f"{path}/{CHANGES}"):
        raise ValueError(f"{path} has change sets: save the table in a new folder")
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if partition_by or sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/{BASE}")


def append_rows(df: DataFrame, path: str) -> None:
    """Plain append for logs such as diaries."""
    df.write.mode("append").parquet(path)


def write_change(df: DataFrame, path: str, name: str, seq: Column, deleted: Column | None = None) -> None:
    """Write new versions (or deletions) of rows as the change set ``name``."""
    marked = df.withColumn("_seq", seq.cast("long")).withColumn(
        "_deleted", F.lit(False) if deleted is None else deleted
    )
    marked.write.mode("overwrite").parquet(f"{path}/{CHANGES}/change={name}")


def read_current(spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """The newest version of every row; deleted rows are left out.

    Only the change sets are ranked.  The base is read once and loses the keys they mention.  ``schema`` is that of the table's
    rows (see ``memlake.schema``): with it a partition column keeps its type ("007" stays text), and a text column declared
    without NULLs gives back an empty partition value as empty.  Without it Spark guesses the types of partition columns.
    """
    def read(folder: str, marks: Sequence[T.StructField] = ()) -> DataFrame:
        if schema is None:
            return spark.read.parquet(f"{path}/{folder}")
        rows = spark.read.schema(T.StructType([*schema.fields, *marks])).parquet(f"{path}/{folder}")
        whole = [f.name for f in schema if not f.nullable and f.dataType == T.StringType()]
        return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in whole})

    has_base, has_changes = _exists(spark, f"{path}/{BASE}"), _exists(spark, f"{path}/{CHANGES}")
    if not has_changes:
        return read(BASE)
    changes = read(CHANGES, _MARKS)
    newest = latest(changes, keys, [F.col("_seq").desc(), F.col("change").desc()])
    alive = newest.where(~F.col("_deleted")).drop("_seq", "_deleted", "change")
    if not has_base:
        return alive
    base = read(BASE)
    untouched = base.join(changes.select(*keys).distinct(), list(keys), "left_anti")
    return untouched.select(*base.columns).unionByName(alive.select(*base.columns))


def compact(
    spark: SparkSession, path: str, to: str, keys: Sequence[str], partition_by: Sequence[str] = (), sort_by: Sequence[str] = (),
    schema: T.StructType | None = None,
) -> None:
    """Write the merged table into another folder; the folder being read is never overwritten."""
    if to.rstrip("/") == path.rstrip("/"):
        raise ValueError("compact needs a new folder: the table is read while it is written")
    save_table(read_current(spark, path, keys, schema), to, partition_by, sort_by)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything was written to this table."""
    return _exists(spark, f"{path}/{BASE}") or _exists(spark, f"{path}/{CHANGES}")
