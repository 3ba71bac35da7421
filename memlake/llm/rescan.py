"""Reading a table twice and telling its rows apart by their place.

``placed`` numbers the rows by task and place in the task.  Files give the same numbers when they are read again in the same session,
so what was decided for a row is written by task (``save_parts``), and the task that reads those rows again fetches just its own
part (``load_part``); whole texts need not be shuffled for it.  Callers check a digest of each row they meet again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.words import bounded
from memlake.session import shared_folder


def placed(df: DataFrame, name: str = "uid") -> DataFrame:
    return bounded(df).select(F.monotonically_increasing_id().alias(name), "*")


def part_of(uid: int) -> int:
    return uid >> 33


def save_parts(df: DataFrame, uid: str = "uid") -> str:
    """Writes ``df`` to a new shared folder, a subfolder for each task that had the rows."""
    folder = shared_folder(df.sparkSession)
    part = F.shiftright(uid, 33)
    df.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(folder)
    return folder


def file_system(uri: str):
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def load_part(folder: str, part: int, columns: list[str]) -> pa.Table | None:
    """The rows that ``save_parts`` wrote for a task; None if there are none."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, root = file_system(folder)
    found = system.get_file_info(fs.FileSelector(f"{root}/part={part}", allow_not_found=True))
    files = sorted(f.path for f in found if f.base_name.endswith(".parquet"))
    if not files:
        return None
    return pa.concat_tables([pq.ParquetFile(system.open_input_file(f)).read(columns=columns) for f in files])


def check_of(columns: list[str]) -> Column:
    """A hash of some columns, by which a row is known again."""
    return F.xxhash64(*[F.col(c).cast("string") for c in columns], F.concat(*[F.col(c).isNull().cast("string") for c in columns]))


def without(docs: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` without the rows of ``gone`` (uid and check, as ``placed`` and ``check_of(columns)`` gave them); columns stay, nothing is shuffled.

    A row to leave out that isn't met at its place, or is another one by its hash, ends the job: ``docs`` gave other rows than before,
    and the wrong ones would stay.  Rows equal in ``columns`` may stand for each other.  Nulls, empty and very long texts are values
    like others; an empty table, or nothing to leave out, changes nothing; columns of ``docs`` may have any names.
    """
    folder = save_parts(gone.select("uid", "check"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dropped: np.ndarray | None = None
        checks = np.zeros(0, np.int64)
        met = 0
        for batch in batches:
            uids = batch.column(0).to_numpy()
            if len(uids) and dropped is None:
                part = load_part(folder, part_of(int(uids[0])), ["uid", "check"])
                part = pa.table({"uid": pa.array([], pa.int64()), "check": pa.array([], pa.int64())}) if part is None else part.sort_by("uid")
                dropped, checks = part.column("uid").to_numpy(), part.column("check").to_numpy()
            rest = batch
            if len(uids):
                hit = np.isin(uids, dropped)
                met += int(hit.sum())
                if (checks[np.searchsorted(dropped, uids[hit])] != batch.column(1).to_numpy()[hit]).any():
                    raise ValueError("docs gave other rows when read again")
                rest = batch.filter(pa.array(~hit))
            yield pa.RecordBatch.from_arrays(rest.columns[2:], schema=pa.schema(list(rest.schema)[2:]))
        if dropped is not None and met != len(dropped):
            raise ValueError("docs gave fewer rows when read again")

    # Both new columns come first and are taken by place, so names may clash.
    numbered = bounded(docs).select(F.monotonically_increasing_id().alias("_place"), check_of(columns).alias("_check"), "*")
    return numbered.mapInArrow(keep, docs.schema)
