"""Token-ID output: binary record files with checksums, and a separate offset index for reading in any order.

A shard is ``MAGIC``, the id width (u32), a zero (u32), then records.  A record frames one document:

    u64 length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload

The payload is u8 (1: the document has an id), i64 doc_id, then the ids as little-endian unsigned integers of the id width (2 bytes
where the vocabulary allows it).  The index file is ``MAGIC`` and a u64 file offset for each record.  All numbers are little-endian.
The checksum is zlib's CRC-32, masked as usual for such files, so that a checksum of data that holds checksums stays useful.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm.registry import query, table
from memlake.llm.words import bounded, small
from memlake.llm.rescan import file_system
from memlake.llm.tokens import default_vocabulary, encoder
from memlake.session import shared_folder

MAGIC = b"MEMTOK01"
HEADER = 16
_ROWS = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("index", pa.string()), ("records", pa.int64()),
                   ("tokens", pa.int64()), ("bytes", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
READ_BYTES = 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def _writer(folder: str, vocabulary: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = np.array([end_id], encode.dtype).tobytes()
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        # Each attempt writes files of its own; only those that the manifest names count.
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        offsets, tokens, at = [], 0, HEADER
        with system.open_output_stream(f"{root}/{name}.bin") as out:
            out.write(MAGIC + struct.pack("<II", encode.width, 0))
            for batch in small(batches):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    ids = encode.encode(text or "") + end
                    record = frame(struct.pack("<Bq", doc_id is not None, doc_id or 0) + ids)
                    out.write(record)
                    offsets.append(at)
                    at += len(record)
                    tokens += len(ids) // encode.width
        with system.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(MAGIC + np.array(offsets, "<u8").tobytes())
        yield pa.RecordBatch.from_pylist([{"shard": shard, "file": f"{folder}/{name}.bin", "index": f"{folder}/{name}.idx",
                                           "records": len(offsets), "tokens": tokens, "bytes": at}], schema=_ROWS)

    return write


def write_records(docs: DataFrame, folder: str, *, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Writes shards in ascending doc_id order (shard by shard, and inside each) and a manifest below ``folder``; returns the manifest.

    The manifest has a row for each shard: shard, file, index, records, tokens, bytes and start (ids of all shards before it).

    Null doc_ids come first; documents with one doc_id are in the order of a hash of their text; a null or empty text is
    ``end_id`` alone; repeated rows are records of their own, and may lie in several shards; an empty table gives empty shards or
    none; other columns are not looked at.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"),
                       F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "hash", "row"]  # the last two split what many rows share
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    written = ranged.mapInArrow(_writer(f"{folder}/shards", vocabulary, end_id),
                                "shard long, file string, index string, records long, tokens long, bytes long")
    written.write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard only
    return spark.read.parquet(f"{folder}/manifest").withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _parse(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    has_id, doc_id = struct.unpack_from("<Bq", payload)
    return doc_id if has_id else None, np.frombuffer(payload, f"<u{width}", offset=9)


def _checked(head: bytes, rest: bytes, where: str) -> bytes:
    payload = rest[:-4]
    if masked(head[:8]) != struct.unpack_from("<I", head, 8)[0] or masked(payload) != struct.unpack("<I", rest[-4:])[0]:
        raise ValueError(f"damaged record in {where}")
    return payload


def _records(file: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records of a shard in order, read as a stream."""
    system, path = file_system(file)
    with system.open_input_stream(path, buffer_size=1 << 20) as stream:
        head = stream.read(HEADER)
        if head[:8] != MAGIC:
            raise ValueError(f"{file} is no shard")
        width = struct.unpack_from("<I", head, 8)[0]
        while head := stream.read(12):
            length = struct.unpack_from("<Q", head)[0] if len(head) == 12 and masked(head[:8]) == struct.unpack_from("<I", head, 8)[0] else None
            if length is None:
                raise ValueError(f"damaged record in {file}")
            rest = stream.read(length + 4)
            if len(rest) != length + 4:
                raise ValueError(f"cut record in {file}")
            yield _parse(_checked(head, rest, file), width)


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            start, rows, held, seen = row["start"], [], 0, 0
            for doc_id, ids in _records(row["file"]):
                rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                start += len(ids)
                seen += 1
                held += 4 * len(ids)
                if held > READ_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)
            if seen != row["records"] or start != row["start"] + row["tokens"]:
                raise ValueError(f"{row['file']} does not hold what the manifest says")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.types)], schema=_READ)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record from the shards, checked: doc_id, start (ids before it), n_tokens, ids (little-endian unsigned 32 bit)."""
    shards = read_manifest(spark, folder).select("shard", "file", "records", "tokens", "start")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return shards.repartition(n, "shard").mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids binary")


def read_shuffled(spark: SparkSession, folder: str, seed: int, block: int = 256) -> DataFrame:
    """All records in a seeded order, by way of the index: (position, doc_id, n_tokens, ids).

    Blocks of neighbouring records are dealt out by a seeded hash; each task fetches its blocks' offsets from the index files and
    reads just those stretches of the shards, then orders them by hash.
    """
    shards = read_manifest(spark, folder).where("records > 0")
    blocks = shards.select("file", "index", "records", F.explode(F.sequence(F.lit(0), ((F.col("records") - 1) / block).cast("long"))).alias("block"))
    dealt = blocks.withColumn("position", F.xxhash64(F.lit(seed), "file", "block")).repartitionByRange("position").sortWithinPartitions("position")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _fetch_block(row, block)

    return dealt.mapInArrow(fetch, "position long, doc_id long, n_tokens long, ids binary")


def _fetch_block(row: dict, block: int) -> pa.RecordBatch:
    lo, hi = row["block"] * block, min(row["records"], (row["block"] + 1) * block)
    system, path = file_system(row["index"])
    with system.open_input_file(path) as f:
        f.seek(8 + 8 * lo)
        offsets = np.frombuffer(f.read(8 * (hi - lo)), "<u8").tolist()
    system, path = file_system(row["file"])
    out = []
    with system.open_input_file(path) as f:
        f.seek(8)
        width = struct.unpack("<I", f.read(4))[0]
        for at in offsets:
            f.seek(at)
            head = f.read(12)
            doc_id, ids = _parse(_checked(head, f.read(struct.unpack_from("<Q", head)[0] + 4), row["file"]), width)
            out.append((row["position"], doc_id, len(ids), ids.astype("<u4").tobytes()))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["position", "doc_id", "n_tokens", "ids"])


@query("op3_records")
def op3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write_records(table(spark, sf_dir), folder)
    return read_records(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
