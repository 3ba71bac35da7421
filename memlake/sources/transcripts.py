"""Splitting concatenated transcripts at rule lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.functions.text import strip
from memlake.sources.files import decode_text, scan_files, stem, suffix

# Fixed value: a line of three or more dashes or equals signs.
RULE_LINE = r"(?Umd)^---+[\s\x1c-\x1f]*$|^={3,}[\s\x1c-\x1f]*$"


def split_transcripts(files: DataFrame) -> DataFrame:
    """Numbered parts of every file (``path``, ``text``) that has a rule line.

    Numbers count blank parts, which are left out.  ``name`` is the file name the part would be written to.
    """
    cut = files.select("path", F.split("text", RULE_LINE, -1).alias("parts")).where(F.size("parts") > 1)
    return cut.select("path", F.posexplode("parts").alias("pos", "part")).select(
        "path", (F.col("pos") + 1).alias("part_no"), strip(F.col("part")).alias("text"),
        F.concat(stem(F.col("path")), F.lit("_"), (F.col("pos") + 1).cast("string"), F.lit(".md")).alias("name"),
    ).where(F.col("text") != "")


def count_parts(files: DataFrame) -> DataFrame:
    """Dry run: number of parts (blank ones included) of each file that would be split."""
    return files.select("path", F.size(F.split("text", RULE_LINE, -1)).alias("parts")).where(F.col("parts") > 1)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    files = scan_files(spark, path, max_bytes=None, skip_dirs=(), skip_files=())
    return files.where(suffix(F.col("path")) == ".md").select("path", decode_text(F.col("content")).alias("text"))
