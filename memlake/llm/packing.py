"""Packing: documents into training sequences, first fit decreasing, independently in randomised groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.registry import query, table
from memlake.llm.tokens import default_vocabulary, encoder
from memlake.llm.words import bounded, mix, seeded, small
from memlake.session import materialise

SEQUENCE = 1024
GROUP_PIECES = 2048
_CUT = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()),
                  ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_PACKED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


class Bins:
    """Bins of one size under a tournament tree: each inner node holds the larger free room of its two children."""

    def __init__(self, items: int, size: int):
        self.leaves = 1 << max(0, items - 1).bit_length()
        self.room = [size] * (2 * self.leaves)
        self.size = size

    def first_fit(self, length: int) -> tuple[int, int]:
        """Puts ``length`` into the first bin with room: the bin's number and the place in it."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        place = self.size - room[node]
        room[node] -= length
        bin_number = node - self.leaves
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return bin_number, place


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each piece; the longest come first, equal ones in the given order."""
    bins = Bins(len(lengths), size)
    number, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        number[i], place[i] = bins.first_fit(int(lengths[i]))
    return number, place


def _cutter(vocabulary: str, size: int, end_id: int, seed: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        width, end = encode.width, np.array([end_id], encode.dtype).tobytes()
        salt = seeded(seed)
        for batch in small(batches):
            out: list[tuple] = []
            held = 0
            for uid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = encode.encode(text or "") + end
                total = len(ids) // width
                starts = np.arange(0, total, size, dtype=np.int64)
                keys = mix(mix(np.array([uid], np.uint64) + salt) + starts.astype(np.uint64))
                for start, key in zip(starts.tolist(), keys.view(np.int64).tolist()):
                    part = ids[start * width:(start + size) * width]
                    out.append((key, doc_id, start, len(part) // width, total, part))
                held += len(ids)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _CUT.types)], schema=_CUT)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _CUT.types)], schema=_CUT)

    return cut


def _packer(vocabulary: str, size: int):
    def flush(parts: list[pa.RecordBatch], dtype: np.dtype) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(parts)
        lengths = group.column("length").to_numpy()
        number, place = first_fit_decreasing(lengths, size)
        sequence = group.column("group").to_numpy() * (1 << 32) + number
        ids = [np.frombuffer(x, dtype).astype("<u4").tobytes() for x in group.column("ids").to_pylist()]
        columns = [group.column("doc_id"), group.column("start"), pa.array(lengths, pa.int64()), group.column("doc_tokens"),
                   pa.array(sequence), pa.array(place), pa.array(ids, pa.binary())]
        yield from pa.table(columns, schema=_PACKED).to_batches()

    def pack_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(vocabulary).dtype
        parts: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            for a, b in zip(cuts, cuts[1:]):
                if parts and groups[a] != current:
                    yield from flush(parts, dtype)
                    parts = []
                current = groups[a]
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from flush(parts, dtype)

    return pack_groups


def pack(docs: DataFrame, *, size: int = SEQUENCE, end_id: int = 0, vocabulary: str | None = None, seed: int = 0,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32 bit).

    A document is its token ids and ``end_id``.  It is cut every ``size`` ids; all pieces are dealt to groups by a seeded hash of
    their row and place (so that copies of a document part) and each group, of about ``group_pieces`` pieces, is packed by itself, so
    the work of a group is bounded for any length of text and the order of the corpus doesn't matter.  Sequences are gapless from offset 0; at most ``size`` long.  What is left free at
    the end of a sequence is padding.

    A null or empty text is a document of ``end_id`` alone; a null doc_id stays null; repeated rows are documents of their own;
    very long texts become many pieces; an empty table gives no rows; other columns are not looked at.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = bounded(docs).select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = materialise(rows.mapInArrow(_cutter(vocabulary, size, end_id, seed),
                                      "key long, doc_id long, start long, length int, doc_tokens long, ids binary"))
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("key", F.pmod("key", F.lit(groups).cast("long"))).withColumnRenamed("key", "group")
    dealt = dealt.repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(_packer(vocabulary, size), "doc_id long, start long, length long, doc_tokens long, sequence_id long, "
                                                       "offset long, ids binary")


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
