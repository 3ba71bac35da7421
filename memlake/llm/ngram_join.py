"""N-gram Jaccard join: chosen-path recursion on sampled shingles, brute force in small buckets, repeated runs.

A document is the set of its five-word shingles (48-bit hashes); documents with equal sets are one node.  In each run a node picks, by
hash, about ``BRANCH / similarity`` of its shingles.  Nodes that picked the same shingle share a bucket; a bucket that is too large is
split by the shingles that its nodes pick next, ``CHILDREN`` of each node and level, those of smallest hash, unless its nodes are so
alike that splitting keeps most of them together.  Only nodes of large buckets pick more than once, so only their texts are read
again for it.

A pair of nodes at the threshold shares ``BRANCH`` first picks on average, and so stays together with probability
``1 - exp(-BRANCH)`` at least; a later pick is equal with a probability of their similarity, so ``CHILDREN`` of them keep it with
``1 - (1 - similarity) ** CHILDREN``.  The number of runs follows from that and the target recall.

Each pair is compared in one bucket only, the first of those that both nodes are in, so that links can be counted without listing
pairs, and only nodes with such a pair are sent on with their sets.  Large buckets are compared block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.registry import query, table
from memlake.llm.rescan import check_of, load_part, part_of, placed, save_parts, without
from memlake.llm.words import mix, raw_texts, seeded, slices, small, Words
from memlake.llm.worker import forget_large
from memlake.session import materialise

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.9999  # of a pair at the threshold all of whose buckets are split down to the last level
BRANCH = 1.2
CHILDREN = 2
LEVELS = 4
BUCKET = 256
_48 = np.uint64((1 << 48) - 1)


def runs_for(recall: float, similarity: float = SIMILARITY) -> int:
    kept = (1 - exp(-BRANCH)) * (1 - (1 - similarity) ** CHILDREN) ** (LEVELS - 1)
    return max(1, ceil(log(1 - recall) / log(1 - kept)))


def shingle_sets(raws: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted shingle hashes of each text.  A text of fewer words is one shingle, of all its words; one without words has none."""
    out: list[np.ndarray] = []
    for lo, hi in slices(raws):
        words = Words(raws[lo:hi])
        first, value = words.windows(size)
        value &= _48
        counts = np.bincount(words.doc[first], minlength=hi - lo)
        n_words = words.per_doc()
        word_start = np.concatenate([[0], np.cumsum(n_words)])
        at = 0
        for i in range(hi - lo):
            if counts[i]:
                out.append(np.unique(value[at:at + counts[i]]))
                at += counts[i]
            elif n_words[i]:
                h = np.full(1, n_words[i], np.uint64)
                for w in words.id[word_start[i]:word_start[i + 1]]:
                    h = mix(h * np.uint64(31) + w)
                out.append(h & _48)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _nested(doc: np.ndarray, run: np.ndarray, token: np.ndarray, n: int, runs: int) -> pa.Array:
    """Lists of lists: for each document and run, its picked tokens."""
    order = np.argsort(doc * runs + run, kind="stable")
    counts = np.bincount(doc * runs + run, minlength=n * runs)
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(token[order].view(np.int64)))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * runs + 1, runs), pa.int32()), inner)


def _picker(similarity: float, runs: int, seed: int):
    """Digest and size of each row's set, and its first picks of every run."""
    factors = np.array([seeded(seed + run) | np.uint64(1) for run in range(runs)], np.uint64)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_large()
        for batch in small(batches):
            raws = raw_texts(batch.column("text"))
            for lo, hi in slices(raws):
                sets = shingle_sets(raws[lo:hi])
                sizes = np.array([len(s) for s in sets], np.int64)
                doc = np.repeat(np.arange(hi - lo), sizes)
                tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                spread = mix(tokens)
                chance = np.minimum(1.0, BRANCH / similarity / np.maximum(sizes, 1))
                limit = (chance * float(2**64 - 2**12)).astype(np.uint64)[doc]
                found = [np.flatnonzero(spread * factor <= limit) for factor in factors]
                at = np.concatenate(found)
                picks = _nested(doc[at], np.repeat(np.arange(runs), [len(f) for f in found]), tokens[at], hi - lo, runs)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), part.column("check"), part.column("doc_id"), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array(sizes), picks],
                    names=["uid", "check", "doc_id", "cid", "size", "picks"])

    return pick


def next_picks(shingles: np.ndarray, run: int, seed: int) -> list[list[int]]:
    """For each level after the first, the shingles of smallest hash under ``CHILDREN`` keys."""
    factors = np.array([seeded(seed + 1000 * level + 100_000 * k + run) | np.uint64(1) for level in range(1, LEVELS) for k in range(CHILDREN)], np.uint64)
    least = shingles[(mix(shingles)[None, :] * factors[:, None]).argmin(1)].view(np.int64).reshape(LEVELS - 1, CHILDREN)
    return [list(dict.fromkeys(row)) for row in least.tolist()]


def _read_again(rows: DataFrame, wanted: DataFrame, columns: list[str], given, schema: str) -> DataFrame:
    """What ``given(uid, shingles, entries)`` makes of the sets of the ``wanted`` rows (uid, cid, columns; an entry a row).

    The sets are made again by the tasks that hold the texts, which fetch their own rows of ``wanted``; a digest shows whether the sets
    are the same."""
    folder = save_parts(wanted.select("uid", "cid", *columns))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_large()
        part, starts, ends = None, {}, {}
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

        for batch in small(batches):
            uids = batch.column("uid").to_pylist()
            if uids and part is None:
                part = load_part(folder, part_of(uids[0]), ["uid", "cid", *columns])
                if part is None:
                    return
                part = part.sort_by("uid")
                known, first = np.unique(part.column("uid").to_numpy(), return_index=True)
                starts, ends = dict(zip(known.tolist(), first.tolist())), dict(zip(known.tolist(), [*first[1:].tolist(), part.num_rows]))
            at = [k for k, u in enumerate(uids) if u in starts]
            found = shingle_sets(raw_texts(batch.column("text").take(pa.array(at, pa.int64()))))
            for shingles, k in zip(found, at):
                uid = uids[k]
                own = part.slice(starts[uid], ends[uid] - starts[uid])
                if set_digest(shingles) != own.column("cid")[0].as_py():
                    raise ValueError("docs gave other rows when read again")
                for row in given(uid, shingles, list(zip(*[own.column(c).to_pylist() for c in columns]))):
                    out.append(row)
                    if len(out) >= 128:
                        yield made()
                        out = []
        if out:
            yield made()

    return rows.select("uid", "text").mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``keys`` columns; the rows come sorted by them."""
    forget_large()
    parts: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for v in values:
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(v[a] for v in values)
            if parts and key != current:
                yield pa.Table.from_batches(parts)
                parts = []
            current = key
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


def _candidate_pairs(own: int, block: np.ndarray, sizes: np.ndarray, leaves: list[np.ndarray], i: int, j: int, similarity: float) -> np.ndarray:
    """Which pairs this bucket compares: across its two blocks, of fitting sizes, and in no earlier bucket together."""
    n = len(sizes)
    wanted = np.triu(np.ones((n, n), bool), 1) if i == j else (block[:, None] == i) & (block[None, :] == j)
    wanted &= np.minimum(sizes[:, None], sizes[None, :]) >= similarity * np.maximum(sizes[:, None], sizes[None, :]) - 1e-9
    counts = np.array([np.searchsorted(x, own) for x in leaves])
    earlier = np.concatenate([x[:c] for x, c in zip(leaves, counts)])
    if len(earlier):
        names, number, often = np.unique(earlier, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(often > 1)
        if len(shared):
            position = np.full(len(names), -1)
            position[shared] = np.arange(len(shared))
            member = np.zeros((n, len(shared)), np.float32)
            row, column = np.repeat(np.arange(n), counts), position[number]
            member[row[column >= 0], column[column >= 0]] = 1
            wanted &= (member @ member.T) == 0
    return wanted


def _prefilter(similarity: float):
    """The nodes of each bucket that have a pair to compare there, in order, and with which of them (``wanted``, a bit for each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches, 3):
            if group.num_rows < 2:
                continue
            leaf, i, j = (group.column(k)[0].as_py() for k in range(3))
            node, block, sizes = (group.column(k).to_numpy() for k in (3, 4, 5))
            leaves = [np.array(x, np.int64) for x in group.column(6).to_pylist()]
            wanted = _candidate_pairs(leaf, block, sizes, leaves, i, j, similarity)
            met = np.flatnonzero(wanted.any(0) | wanted.any(1))
            bits = np.packbits(wanted[np.ix_(met, met)], axis=1)
            out += [(leaf, i, j, int(node[k]), row.tobytes()) for k, row in zip(met, bits)]
            if len(out) > 5000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["leaf", "i", "j", "node", "wanted"])

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, over the shingles that two sets share, some thousand at a time."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.int64)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    position = np.cumsum(often > 1) - 1
    shared = often[number] > 1
    row, column = row[shared], position[number[shared]]
    out = np.zeros((n, n))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 8192
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        member = np.zeros((n, width), np.float32)
        member[row[a:b], column[a:b] - start] = 1
        out += member @ member.T
    return out.astype(np.int64)


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def _pack(shingles: np.ndarray) -> bytes:
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _linker(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for group in _groups(batches, 3):
            if group.num_rows < 2:
                continue
            node, copies = (group.column(k).to_numpy() for k in (3, 4))
            sets = [_unpack(x) for x in group.column(5).to_pylist()]
            sizes = np.array([len(s) for s in sets])
            bits = np.frombuffer(b"".join(group.column(6).to_pylist()), np.uint8).reshape(len(sets), -1)
            wanted = np.unpackbits(bits, axis=1, count=len(sets)).astype(bool)
            both = _overlaps(sets)
            linked = wanted & (both + 1e-9 >= similarity * (sizes[:, None] + sizes[None, :] - both))
            linked |= linked.T
            hit = np.flatnonzero(linked.any(1))
            root = np.arange(len(node))
            while len(hit):  # the smallest node of each connected part
                lower = np.where(linked[hit], node[root][None, :], np.iinfo(np.int64).max).argmin(1)
                new = root.copy()
                new[hit] = np.where(node[root[lower]] < node[root[hit]], root[lower], root[hit])
                if (new == root).all():
                    break
                root = new
            links = linked @ copies
            out += [(int(node[k]), int(links[k]), int(node[root[k]])) for k in hit.tolist()]
            if len(out) > 10000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["node", "links", "root"])

    return run


def _buckets(rows: DataFrame, picks: DataFrame, classes: DataFrame, bucket: int, seed: int) -> DataFrame:
    """Final buckets with two nodes or more: (leaf, node, n)."""
    first = picks.select(F.col("uid").alias("node"), F.posexplode("picks").alias("run", "tokens")).withColumn("run", F.col("run").cast("long")).join(classes.select("node"), "node", "left_semi")
    members = materialise(first.select(F.explode("tokens").alias("token"), "run", "node").select(F.xxhash64("run", "token").alias("path"), "run", "node"))
    leaves: DataFrame | None = None
    further: DataFrame | None = None
    for level in range(LEVELS):
        counts = members.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        counted = materialise(members.join(counts, "path"))
        small = counted.where(F.col("n") <= bucket)
        large = counted.where(F.col("n") > bucket)
        if level == LEVELS - 1:
            small = counted
            large = None
        elif large.isEmpty():
            large = None
        else:
            if further is None:
                asked = large.select(F.col("node").alias("uid"), "run").distinct().join(classes.select(F.col("node").alias("uid"), "cid"), "uid")
                further = materialise(_read_again(rows, asked, ["run"], lambda uid, shingles, runs: ((uid, r, next_picks(shingles, r, seed)) for r, in runs),
                                                  "node long, run long, picks array<array<long>>"))
            split = materialise(large.join(further.select("node", "run", F.col("picks")[level].alias("tokens")), ["node", "run"]))
            # Two nodes pick the same first token with a probability of their similarity: their shares of the bucket tell how alike it is.
            sizes = split.groupBy("path", "n", F.col("tokens")[0].alias("token")).agg(F.count("*").alias("c"))
            alike = sizes.groupBy("path", "n").agg((F.sum(F.col("c") * F.col("c")) / F.col("n")).alias("usual"))
            alike = materialise(alike.where(F.col("usual") >= 0.5 * F.col("n")).select("path"))
            small = small.unionByName(large.join(alike, "path", "left_semi"))
            members = materialise(split.join(alike, "path", "left_anti").select("path", "run", "node", F.explode("tokens").alias("token"))
                                  .select(F.xxhash64("path", "token").alias("path"), "run", "node"))
        done = small.select(F.col("path").alias("leaf"), "node", "n")
        leaves = done if leaves is None else leaves.unionByName(done)
        if large is None:
            break
    return leaves


def _components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each connected part, by label spreading and pointer jumping."""
    both = materialise(edges.union(edges.select("root", "node")).toDF("node", "other").distinct())
    labels = materialise(both.groupBy("node").agg(F.min("other").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        seen = both.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("new"))
        jumped = lower.join(labels.toDF("new", "far"), "new").select("node", F.least("new", "far").alias("new"), "label")
        after = materialise(jumped)
        if after.where("new < label").isEmpty():
            return labels
        labels = after.select("node", F.col("new").alias("label"))


def join_classes(docs: DataFrame, *, similarity: float = SIMILARITY, recall: float = RECALL, bucket: int = BUCKET, seed: int = 7) -> DataFrame:
    """A row for each row of ``docs``: uid (its place), check (hash of doc_id and text), doc_id, cid (digest of its shingle set), class_id, n_links, first (one row a class).

    Rows link if the Jaccard similarity of their shingle sets is ``similarity`` or more; ``n_links`` counts the other rows a row links
    with, equal ones included; ``class_id`` is the smallest doc_id of all rows connected by links.

    A text without words (null, empty or white space) links with nothing and is a class by itself; a shorter text than a shingle links
    with equal texts; repeated rows are rows of their own and link; a null doc_id is null in the result, and a class of null doc_ids
    only has a null class_id; of equal doc_ids the earlier row comes first; very long texts are whole sets; other columns are not
    looked at; an empty table gives no rows.  ``docs`` is read up to three times and
    must give the same rows each time, as files do.
    """
    runs = runs_for(recall, similarity)
    rows = placed(docs.select(check_of(["doc_id", "text"]).alias("check"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    picks = materialise(rows.mapInArrow(_picker(similarity, runs, seed), "uid long, check long, doc_id long, cid binary, size long, picks array<array<long>>"))
    classes = materialise(picks.where("cid is not null").groupBy("cid").agg(
        F.min("uid").alias("node"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("size").alias("size")))

    leaves = materialise(_buckets(rows, picks, classes, bucket, seed))
    lists = leaves.groupBy("node").agg(F.sort_array(F.collect_set("leaf")).alias("leaves")).join(classes.select("node", "size"), "node")
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    dealt = leaves.join(lists, "node").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", "leaf"), "blocks").cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "size", "leaves")
    met = dealt.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "node")
    pairs = materialise(met.mapInArrow(_prefilter(similarity), "leaf long, i int, j int, node long, wanted binary"))

    # Sets go straight from the tasks that hold the texts to the buckets where they have a pair to compare.
    wanted = pairs.join(classes.select("node", "cid", "copies"), "node").withColumnRenamed("node", "uid")
    compared = _read_again(rows, wanted, ["leaf", "i", "j", "copies", "wanted"],
                           lambda uid, shingles, entries: ((leaf, i, j, uid, copies, _pack(shingles), bits) for leaf, i, j, copies, bits in entries),
                           "leaf long, i long, j long, node long, copies long, shingles binary, wanted binary")
    found = materialise(compared.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "node")
                        .mapInArrow(_linker(similarity), "node long, links long, root long"))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = _components(found.select("node", "root").where("node <> root"))
    named = classes.select("cid", "node", "first_id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = named.groupBy("label").agg(F.min("first_id").alias("class_id"), F.min_by("node", F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("head"))
    named = named.join(heads, "label").join(links, "node", "left").select(
        "cid", "node", "class_id", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    firsts = picks.where("cid is not null").groupBy("cid").agg(F.min_by("uid", F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first_uid"))
    named = named.join(firsts, "cid")
    out = picks.select("uid", "check", "doc_id", "cid").join(named, "cid", "left")
    alone = F.col("cid").isNull()
    return out.select("uid", "check", "doc_id", "cid", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      (alone | ((F.col("node") == F.col("head")) & (F.col("uid") == F.col("first_uid")))).alias("first"))


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id.  All columns stay as they are; no text is shuffled."""
    classed = join_classes(docs, **parameters)
    return without(docs, classed.where(~F.col("first")), ["doc_id", "text"])


_ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT rid, array_to_string(w, ' ') AS g FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 5 * common >= 4 * (a.n + b.n - common)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(least(d.doc_id, min(o.doc_id)), d.doc_id) AS class_id, CAST(coalesce(any_value(k.n), 0) AS BIGINT) AS n_links
FROM d LEFT JOIN r ON r.x = d.rid LEFT JOIN d o ON o.rid = r.y LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) k ON k.x = d.rid
GROUP BY d.rid, d.doc_id
"""


@query("op1_ngram_join", _ORACLE)
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(table(spark, sf_dir)).select("doc_id", "class_id", "n_links")
