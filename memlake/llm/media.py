"""Media columns in a store of content-defined chunks: rolling gear hash cuts, chunks kept once, ordered lists that rebuild the media.

A medium is a payload of 8-bit samples.  It is cut where a rolling hash of the last 32 bytes has ten zero bits, so that equal passages of
different media give equal chunks.  The store has a row for each different payload:

    media_id (sha256 of the payload), plan (ordered chunks: digest, length, place), own (the bytes of chunks only this payload has),
    given (chunks that other payloads have too, kept here for all of them)

A chunk's ``place`` says whether it lies in ``own``, in ``given``, or is borrowed from the row that gives it.  Which chunks are shared
and who gives them comes from joins of digests; bytes are written by the task that reads them, and only borrowed chunks are moved
when media are read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.registry import query, table
from memlake.llm.rescan import load_part, part_of, placed, save_parts
from memlake.llm.words import raw_texts, slices, small
from memlake.session import materialise, shared_folder

UNIT = 192
LEAST, MOST, ZERO_BITS = 256, 8192, 10
OWN, GIVEN, BORROWED = 0, 1, 2
_GEAR = np.random.default_rng(192).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


def payload_of(raw: bytes) -> bytes:
    """``raw`` and spaces up to a positive multiple of UNIT bytes."""
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gear values of the 32 bytes up to it, shifted by their distance."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def chunk_ends(payloads: list[bytes]) -> list[list[int]]:
    """End positions of the chunks of each payload.

    No chunk but the last is shorter than LEAST, which is more than the hash looks back, so neighbours in the buffer don't matter.
    """
    buffer = np.frombuffer(b"".join(payloads), np.uint8)
    cuts = (np.flatnonzero(gear_hash(buffer) >> np.uint32(32 - ZERO_BITS) == 0) + 1).tolist() if len(buffer) else []
    out, begin = [], 0
    for payload in payloads:
        end, at, ends = begin + len(payload), begin, []
        while end - at > LEAST:
            k = bisect_left(cuts, at + LEAST)
            cut = min(cuts[k] if k < len(cuts) else end, at + MOST, end)
            ends.append(cut - begin)
            at = cut
        if at < end:
            ends.append(end - begin)
        out.append(ends)
        begin = end
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _chunks(payload: bytes, ends: list[int]) -> list[bytes]:
    return [payload[a:b] for a, b in zip([0, *ends], ends)]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        raws = raw_texts(batch.column("media"))
        for lo, hi in slices(raws, 4 << 20):
            payloads = [payload_of(r) for r in raws[lo:hi]]
            chunks = [_chunks(p, e) for p, e in zip(payloads, chunk_ends(payloads))]
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [part.column("uid"), part.column("doc_id"), pa.array([len(r) for r in raws[lo:hi]], pa.int64()),
                 pa.array([hashlib.sha256(p).digest() for p in payloads], pa.binary()), pa.array([[digest_of(c) for c in x] for x in chunks], pa.list_(pa.binary()))],
                names=["uid", "doc_id", "n_bytes", "media_id", "digests"])


_PLAN = pa.list_(pa.struct([("digest", pa.binary()), ("length", pa.int32()), ("place", pa.int32())]))
_GIVEN = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))
_STORE = pa.schema([("media_id", pa.binary()), ("plan", _PLAN), ("own", pa.binary()), ("given", _GIVEN)])


def _packer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners: dict[int, tuple] | None = None
        for batch in small(batches):
            uids = batch.column("uid").to_pylist()
            if uids and owners is None:
                part = load_part(folder, part_of(uids[0]), ["uid", "media_id", "lent", "borrowed"])
                owners = {} if part is None else {r[0]: r[1:] for r in zip(*(c.to_pylist() for c in part.columns))}
            at = [k for k, u in enumerate(uids) if u in owners]
            if not at:
                continue
            raws = raw_texts(batch.column("media").take(pa.array(at)))
            for lo, hi in slices(raws, 4 << 20):
                payloads = [payload_of(r) for r in raws[lo:hi]]
                rows = []
                for k, payload, ends in zip(at[lo:hi], payloads, chunk_ends(payloads)):
                    media_id, lent, borrowed = owners[uids[k]]
                    if hashlib.sha256(payload).digest() != media_id:
                        raise ValueError("docs gave other rows when read again")
                    rows.append((media_id, *_packed(payload, ends, set(lent or ()), set(borrowed or ()))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _STORE.types)], schema=_STORE)

    return run


def _packed(payload: bytes, ends: list[int], lent: set[int], borrowed: set[int]) -> tuple:
    plan, own, given = [], [], []
    for i, chunk in enumerate(_chunks(payload, ends)):
        place = BORROWED if i in borrowed else GIVEN if i in lent else OWN
        digest = digest_of(chunk)
        plan.append({"digest": digest, "length": len(chunk), "place": place})
        if place == OWN:
            own.append(chunk)
        elif place == GIVEN:
            given.append({"digest": digest, "bytes": chunk})
    return plan, b"".join(own), given


def write_store(docs: DataFrame, folder: str, *, media: str = "text") -> DataFrame:
    """Writes the store below ``folder`` and returns a row for each row of ``docs``: uid, doc_id, n_bytes, media_id.

    A null is an empty text, whose payload is one unit of spaces; equal payloads are stored once; media of any size are whole; other
    columns are not looked at; an empty table gives an empty store.  ``docs`` is read twice and must give the same rows both times.
    """
    rows = placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(media).alias("media")))
    recipes = materialise(rows.mapInArrow(_describe, "uid long, doc_id long, n_bytes long, media_id binary, digests array<binary>"))
    owners = recipes.groupBy("media_id").agg(F.min("uid").alias("uid"))
    chunks = materialise(recipes.select("uid", "digests").join(owners.select("uid"), "uid").select("uid", F.posexplode("digests").alias("at", "digest")))
    # The smallest place of a shared chunk gives it; further places borrow it, also those in the same payload.
    shared = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("uid", "at")).alias("home")).where("n > 1")
    used = chunks.join(shared, "digest").withColumn("gives", F.struct("uid", "at") == F.col("home"))
    lists = used.groupBy("uid").agg(F.collect_list(F.when(F.col("gives"), F.col("at"))).alias("lent"), F.collect_list(F.when(~F.col("gives"), F.col("at"))).alias("borrowed"))
    decided = save_parts(owners.join(lists, "uid", "left"))
    rows.select("uid", "media").mapInArrow(_packer(decided), "media_id binary, plan array<struct<digest:binary,length:int,place:int>>, own binary, given array<struct<digest:binary,bytes:binary>>"
                                           ).write.option("compression", "zstd").parquet(f"{folder}/store")
    return recipes.select("uid", "doc_id", "n_bytes", "media_id")


def manifest(plan: list[tuple[bytes, int]], payload_bytes: int) -> bytes:
    """The head of a stored medium: everything about it but the chunks' bytes."""
    return b"MEMCDC01" + struct.pack("<QI", payload_bytes, len(plan)) + b"".join(d + struct.pack("<I", n) for d, n in plan)


def _rebuild(plan: list[dict], own: bytes, given: list[dict], lent: list[dict] | None) -> bytes:
    """The payload, every chunk checked."""
    kept = {g["digest"]: g["bytes"] for g in [*given, *(lent or ())]}
    out, at = [], 0
    for step in plan:
        if step["place"] == OWN:
            chunk = own[at:at + step["length"]]
            at += step["length"]
        else:
            chunk = kept[step["digest"]]
        if digest_of(chunk) != step["digest"]:
            raise ValueError("damaged chunk")
        out.append(chunk)
    return b"".join(out)


def feature_of(payload: bytes, n_chunks: int) -> str:
    """Number of chunks and, over the samples, different values, sum, sum of squares, and of steps between neighbours."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64)
    return (f"chunks={n_chunks};values={len(np.unique(samples))};sum={samples.sum()};squares={(samples * samples).sum()};"
            f"steps={np.abs(np.diff(samples)).sum()}")


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for media_id, plan, own, given, lent in zip(*(batch.column(c).to_pylist() for c in ["media_id", "plan", "own", "given", "lent"])):
                payload = _rebuild(plan, own, given, lent)
                found = hashlib.sha256(payload).digest()
                if found != media_id:
                    raise ValueError("damaged medium")
                # The stored form is one string of bytes: the head, as the stored plan has it, and the chunks in order, as they were read.
                head = manifest([(s["digest"], s["length"]) for s in plan], len(payload))
                stored = hashlib.sha256(head)
                stored.update(payload)
                rows.append((media_id, len(payload), found.hex(), zlib.crc32(payload[-16:]), len(head) + len(payload), stored.hexdigest(),
                             feature_of(payload, len(plan)), *([payload] if with_payload else [])))
            if rows:
                kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.binary()] if with_payload else [])]
                names = ["media_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["payload"] if with_payload else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def read_store(spark: SparkSession, folder: str, *, with_payload: bool = False) -> DataFrame:
    """A row for each stored payload, rebuilt and checked: media_id, payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes),
    media_bytes and media_sha256 (length and digest of the stored form: its head and then its chunks), feature, and the payload if asked for.

    Payloads without borrowed chunks are read where they lie; the others meet the chunks they borrow by digest.
    """
    store = spark.read.parquet(f"{folder}/store")
    borrows = F.exists("plan", lambda s: s["place"] == BORROWED)
    alone = store.where(~borrows).withColumn("lent", F.lit(None).cast("array<struct<digest:binary,bytes:binary>>"))
    wanted = store.select("media_id", F.explode(F.filter("plan", lambda s: s["place"] == BORROWED)).alias("s")).select("media_id", F.col("s.digest").alias("digest")).distinct()
    given = store.select(F.explode("given").alias("g")).select("g.digest", "g.bytes")
    lent = wanted.join(given, "digest").groupBy("media_id").agg(F.collect_list(F.struct("digest", "bytes")).alias("lent"))
    met = store.where(borrows).join(lent, "media_id")
    schema = "media_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", payload binary" if with_payload else "")
    return alone.unionByName(met).mapInArrow(_read(with_payload), schema)


@query("op10_media")
def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    recipes = write_store(table(spark, sf_dir), folder)
    return recipes.join(read_store(spark, folder), "media_id").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
