import sys
from pathlib import Path

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

sys.path.insert(0, str(Path(__file__).parent))

from conftest_rows import ROWS  # noqa: E402

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType()),
                   # columns whose names the operators use themselves
                   StructField("uid", StringType()), StructField("spans", StringType()), StructField("kept", StringType()), StructField("node", StringType())])



@pytest.fixture(scope="session")
def parquet(spark, tmp_path_factory):
    """Rows written as a table and read again."""

    def make(rows):
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        full = [(i, t, lang, source, None if t is None else len(t), "u", "s", "k", "n") for i, t, lang, source in rows]
        spark.createDataFrame(full, DOCS).coalesce(2).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def odd(parquet):
    return parquet(ROWS)


@pytest.fixture(scope="session")
def empty(parquet):
    return parquet([])
