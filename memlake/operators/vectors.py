"""Exact vector top-k for query batches of any size, and the vector table's write side.

The score is a matrix product.  Tasks pack the vectors they scan into blocks, one row each, and queries are packed into chunks, one row
each; every block meets every chunk (or, in ``cells.py``, the chunks of its cell) and gives its best ``k`` rows per query.  Vectors are
never shuffled and queries never come to the driver; each task cuts what it found to ``k`` rows per query before the shuffle.
A product in single precision leaves out what can't be among a query's ``k`` best, by a bound of its error; the rest is scored in double
precision.  Filters are plain column predicates in front of the scan and reach Parquet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from memlake.functions.vectors import NORM_EPSILON
from memlake.operators.ranking import top_n
from memlake.session import materialise

#: Vectors in a block and queries in a chunk at most, and the bytes of either: with 64 numbers 2,048 rows, with 384 numbers 341.
BLOCK_ROWS = 2048
CHUNK_ROWS = 2048
_TILE_BYTES = 1 << 20
#: Queries of a chunk that are multiplied at a time, and bytes that a task keeps of its queries' best scores.
_STEP_ROWS = 256
_HELD_BYTES = 32 << 20


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "cosine",
    keep: Sequence[str] = (),
    where: Column | None = None,
    digits: int = 9,
    first_pass: float | None = None,
) -> DataFrame:
    """Best ``k`` vectors per query: ``query_id, id, <keep>, score, rank``.

    ``vectors`` has ``id`` and ``embedding``; ``queries`` has ``query_id`` and ``embedding``.  ``metric`` is ``cosine`` or
    ``inner``.  Scores are rounded to ``digits`` and ties go to the smaller id, so the result is the same for any partitioning.
    Vectors and queries that are NULL, hold NULL or other than finite numbers, or differ in length can't be compared: they are no
    hits, and get none.

    ``first_pass`` is a share of the vectors that is searched first: the k-th best score a query finds there is a lower bound, and the
    whole search gives rows at or above it only.  The rows shuffled then are about ``k / first_pass`` per query in place of ``k`` per
    query and task, for a second scan: worth it for large batches over very many tasks.
    """
    if where is not None:
        vectors = vectors.where(where)
    asked = usable_queries(queries)
    chunks = materialise(chunked(asked.withColumn("cells", F.array(F.lit(0))), metric))
    if first_pass is not None:
        # Chosen by id, so that both passes mean the same vectors.
        sampled = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(first_pass * (1 << 20)))
        chunks = materialise(_bounded(sampled, chunks, k, metric, digits))
    blocks = packed(vectors.withColumn("cell", F.lit(0)), metric, keep).drop("cell")
    if first_pass is not None:
        blocks = materialise(blocks)  # a large batch: else each of its tasks packs its vectors again
    # Every block meets every chunk, once: a batch of queries against all vectors, in blocks.
    return best_of(blocks.crossJoin(chunks), vectors, asked, k, metric, keep, digits)


def usable_queries(queries: DataFrame) -> DataFrame:
    """``query_id, embedding, least`` of the queries that can be compared with anything."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).where(finite & (F.size("embedding") > 0))
    return asked.withColumn("least", F.lit(None).cast("double"))


def packed(vectors: DataFrame, metric: str, keep: Sequence[str]) -> DataFrame:
    """Blocks of the vectors (id, embedding, cell, ``keep``): ``cell, dim, matrix`` and a list of each of the other columns.

    For cosine the rows of a matrix are divided by their norms.
    """
    if metric not in ("cosine", "inner"):
        raise ValueError(f"unknown metric {metric!r}: use 'cosine' or 'inner'")
    names = ["id", *keep]
    rows = vectors.select("cell", "embedding", *[F.col(c).alias(f"v{i}") for i, c in enumerate(names)])
    lists = [T.StructField(f"v{i}", T.ArrayType(vectors.schema[c].dataType)) for i, c in enumerate(names)]
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("dim", T.IntegerType()), T.StructField("matrix", T.BinaryType()), *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            embedding = batch.column(1)
            # Here and not as a filter, which would compute an embedding expression once more.
            lengths = pc.fill_null(pc.list_value_length(embedding), 0).to_numpy(zero_copy_only=False)
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            for cell, dim in sorted(set(zip(cells.tolist(), lengths.tolist()))):
                found = np.flatnonzero((cells == cell) & (lengths == dim)) if dim else ()
                for part in _parts(found, dim, BLOCK_ROWS):
                    part = pa.array(part)
                    matrix = _matrix(embedding.take(part))
                    good = np.isfinite(matrix).all(axis=1)
                    if not good.all():
                        part, matrix = part.filter(pa.array(good)), matrix[good]
                    if not len(part):
                        continue
                    if metric == "cosine":
                        matrix = matrix * _inverse_norms(matrix)[:, None]
                    columns = [batch.column(2 + i).take(part) for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cell], pa.int32()), pa.array([dim], pa.int32()), pa.array([matrix.tobytes()], pa.binary()),
                         *[pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), c) for c in columns]],
                        names=schema.names)

    return rows.mapInArrow(run, schema)


def chunked(asked: DataFrame, metric: str) -> DataFrame:
    """Chunks of the queries (query_id, embedding, least, cells): ``cell, chunk, part, asked_dim, wanted, floors, owners``.

    ``wanted`` are the vectors (divided by their norms for cosine), ``floors`` the least scores that matter, ``owners`` the ids.
    """
    numbered = asked.withColumn("chunk", F.floor(F.monotonically_increasing_id() / CHUNK_ROWS))
    one = F.struct("query_id", "embedding", "least")
    lists = numbered.select("chunk", F.explode("cells").alias("cell"), one.alias("one")).groupBy("cell", "chunk").agg(F.collect_list("one").alias("queries"))
    schema = T.StructType([
        T.StructField("cell", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("asked_dim", T.IntegerType()),
        T.StructField("wanted", T.BinaryType()), T.StructField("floors", T.BinaryType()), T.StructField("owners", T.ArrayType(asked.schema["query_id"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                queries = batch.column("queries")[row].values
                embedding, least = queries.field("embedding"), queries.field("least").to_numpy(zero_copy_only=False).astype(np.float64)
                lengths = pc.list_value_length(embedding).to_numpy(zero_copy_only=False)
                parts = [(dim, part) for dim in np.unique(lengths).tolist() for part in _parts(np.flatnonzero(lengths == dim), dim, CHUNK_ROWS)]
                for number, (dim, part) in enumerate(parts):
                    wanted = _matrix(embedding.take(pa.array(part)))
                    if metric == "cosine":
                        wanted = wanted * _inverse_norms(wanted)[:, None]
                    floors = np.where(np.isnan(least[part]), -np.inf, least[part])
                    owners = queries.field("query_id").take(pa.array(part))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("cell").slice(row, 1), batch.column("chunk").slice(row, 1), pa.array([number], pa.int32()), pa.array([dim], pa.int32()),
                         pa.array([wanted.tobytes()], pa.binary()), pa.array([floors.tobytes()], pa.binary()),
                         pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), owners)],
                        names=schema.names)

    return lists.select("cell", "chunk", "queries").mapInArrow(run, schema)


def _parts(rows: np.ndarray, dim: int, most: int) -> list[np.ndarray]:
    """``rows`` in parts of at most ``most`` rows and about _TILE_BYTES."""
    size = max(1, min(most, _TILE_BYTES // (8 * dim))) if dim else most
    return [rows[at:at + size] for at in range(0, len(rows), size)]


def _bounded(sampled: DataFrame, chunks: DataFrame, k: int, metric: str, digits: int) -> DataFrame:
    """The chunks with the k-th best scores among the sampled vectors as floors.  Only scores are shuffled, a row per chunk and task."""
    blocks = materialise(packed(sampled.withColumn("cell", F.lit(0)), metric, ())).drop("cell")
    schema, names = "chunk long, part int, scores binary", chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for tile in _tiles(batches):
            best.rows(tile, digits, None)
            if best.full():
                yield from give(best.clear())
        yield from give(best.clear())

    def give(held: dict) -> Iterator[pa.RecordBatch]:
        for (_, chunk, part), scores in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([scores.tobytes()], pa.binary())], names=["chunk", "part", "scores"])

    def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = batch.column("found")[row].values
                floors = np.frombuffer(batch.column("floors")[row].as_buffer())
                if found is not None and len(found):
                    scores = np.concatenate([np.frombuffer(x.as_buffer()).reshape(len(floors), k) for x in found], axis=1)
                    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                    # A last digit less: the other pass may round the same score the other way.
                    floors = np.maximum(floors, kth - 10.0 ** -digits)
                columns = [pa.array([floors.tobytes()], pa.binary()) if c == "floors" else batch.column(c).slice(row, 1) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    met = blocks.crossJoin(chunks).select("dim", "matrix", "cell", "chunk", "part", "asked_dim", "wanted", "floors")
    found = met.mapInArrow(run, schema).groupBy("chunk", "part").agg(F.collect_list("scores").alias("found"))
    return chunks.join(found, ["chunk", "part"], "left").select(*names, "found").mapInArrow(raised, chunks.schema)


def best_of(met: DataFrame, vectors: DataFrame, asked: DataFrame, k: int, metric: str, keep: Sequence[str], digits: int) -> DataFrame:
    """The best ``k`` rows per query of blocks that met chunks."""
    names = ["id", *keep]
    lists = [f"v{i}" for i in range(len(names))]
    fields = [T.StructField("query_id", asked.schema["query_id"].dataType), *[T.StructField(c, vectors.schema[c].dataType) for c in names]]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for tile in _tiles(batches):
            columns = [tile[c].values for c in lists]
            which, picked, scores = best.rows(tile, digits, columns[0])
            if best.full():
                best.clear()
            if len(which):
                owner, taken = tile["owners"].values.take(pa.array(which)), pa.array(picked)
                yield pa.RecordBatch.from_arrays([owner, *[c.take(taken) for c in columns], pa.array(scores)], names=schema.names)

    met = met.select("dim", "matrix", *lists, "cell", "chunk", "part", "asked_dim", "wanted", "floors", "owners")
    return top_n(met.mapInArrow(run, schema), ["query_id"], [F.col("score").desc(), F.col("id")], k)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows whose vectors can be compared."""
    for batch in batches:
        same = np.flatnonzero(batch.column("dim").to_numpy() == batch.column("asked_dim").to_numpy())
        for row in same.tolist():
            yield {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}


class _Best:
    """The ``k`` best scores of each query that a task has met so far, by chunk: rows below them are not among the task's ``k`` best."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def full(self) -> bool:
        return sum(x.nbytes for x in self.held.values()) > _HELD_BYTES

    def clear(self) -> dict:
        held, self.held = self.held, {}
        return held

    def rows(self, tile: dict, digits: int, ids: pa.Array | None):
        """Query, row and score of a tile's rows that may be among the ``k`` best."""
        dim, k = tile["dim"].as_py(), self.k
        matrix = np.frombuffer(tile["matrix"].as_buffer()).reshape(-1, dim)
        wanted = np.frombuffer(tile["wanted"].as_buffer()).reshape(-1, dim)
        floors = np.frombuffer(tile["floors"].as_buffer())
        key = tuple(tile[c].as_py() for c in ("cell", "chunk", "part"))
        best = self.held.get(key)
        if best is None:
            best = np.full((len(wanted), k), -np.inf)
        which, picked, scores = _best_rows(matrix, wanted, np.maximum(floors, best.min(axis=1)), k, ids, digits)
        self.held[key] = best = _merged(best, which, scores)
        may = scores >= best.min(axis=1)[which]
        return which[may], picked[may], scores[may]


def _merged(best: np.ndarray, which: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The best scores of each query, with those found (ordered by query)."""
    if not len(which):
        return best
    k = best.shape[1]
    order = np.lexsort((-scores, which))
    which, scores = which[order], scores[order]
    touched, starts, counts = np.unique(which, return_index=True, return_counts=True)
    place = np.arange(len(which)) - np.repeat(starts, counts)
    new = np.full((len(touched), k), -np.inf)
    first = place < k
    new[np.repeat(np.arange(len(touched)), counts)[first], place[first]] = scores[first]
    best = best.copy()
    best[touched] = np.partition(np.concatenate([best[touched], new], axis=1), k, axis=1)[:, k:]
    return best


def _best_rows(matrix: np.ndarray, wanted: np.ndarray, floors: np.ndarray, k: int, ids: pa.Array | None, digits: int):
    """Query, row and score of the ``k`` best rows for each query, those below its floor left out; ties by id."""
    size, sizes = np.sqrt((matrix * matrix).sum(axis=1)).max(), np.sqrt((wanted * wanted).sum(axis=1))
    single = max(size, sizes.max()) < 1e18  # else its numbers and products may be too large
    rows, queries = (matrix.astype(np.float32), wanted.astype(np.float32)) if single else (matrix, wanted)
    # By which a single-precision score may differ from the rounded one, twice over.
    error = (matrix.shape[1] + 4) * 2.0 ** -23 * size * sizes + 10.0 ** -digits if single else np.full(len(wanted), 10.0 ** -digits)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(wanted), _STEP_ROWS):
        part = slice(at, at + _STEP_ROWS)
        rough, floor = queries[part] @ rows.T, floors[part]
        found = np.flatnonzero(rough >= _below(floor - error[part], rough.dtype)[:, None])
        if len(found) > 4 * k * len(rough) and len(rows) > k:  # the floors are no help yet
            kth = np.partition(rough, len(rows) - k, axis=1)[:, len(rows) - k]
            found = np.flatnonzero(rough >= _below(np.maximum(floor, kth - error[part]) - error[part], rough.dtype)[:, None])
        which, picked = np.divmod(found, len(rows))
        scores = np.round(_scores(matrix, wanted[part], which, picked), digits)
        good = scores >= floor[which]
        which, picked, scores = which[good], picked[good], scores[good]
        if ids is not None and len(which) > k * len(rough):  # more rows than k share the last place
            order = np.lexsort((_sortable(ids)[picked], -scores, which))
            which, picked, scores = which[order], picked[order], scores[order]
            starts = np.searchsorted(which, np.arange(len(rough)))
            first = np.arange(len(which)) - starts[which] < k
            which, picked, scores = which[first], picked[first], scores[first]
        out.append((which + at, picked, scores))
    return tuple(np.concatenate(x) for x in zip(*out))


def _below(values: np.ndarray, kind) -> np.ndarray:
    """The values in another precision, none of them raised."""
    return np.nextafter(values.astype(kind), kind.type(-np.inf))


def _scores(matrix: np.ndarray, wanted: np.ndarray, which: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """Products of single pairs; of all, if there are many."""
    if 8 * len(which) > len(matrix) * len(wanted):
        return (wanted @ matrix.T)[which, picked]
    step = max(1, 4 * _TILE_BYTES // (8 * matrix.shape[1]))
    found = [np.einsum("ij,ij->i", matrix[picked[at:at + step]], wanted[which[at:at + step]]) for at in range(0, len(which), step)]
    return np.concatenate(found) if found else np.zeros(0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a float64 matrix; NULLs become NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _inverse_norms(matrix: np.ndarray) -> np.ndarray:
    return 1.0 / (np.sqrt((matrix * matrix).sum(axis=1)) + NORM_EPSILON)


def _sortable(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def embed(df: DataFrame, embedder, text: str = "text", to: str = "embedding") -> DataFrame:
    """Add an embedding column.  ``embedder`` is any Column -> Column function: a built-in expression such as
    ``digest_embedding`` or a model wrapped as a pandas UDF (``predict_batch_udf`` loads it once per worker)."""
    return df.withColumn(to, embedder(F.col(text)))


def metadata_map(**columns: Column) -> Column:
    """Metadata as ``map<string,string>``: scalars are cast, arrays, maps and structs become JSON, NULLs are left out."""
    entries = [F.struct(F.lit(name).alias("key"), value.alias("value")) for name, value in columns.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def metadata_value(df: DataFrame, column: str) -> Column:
    """One column as metadata text."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.col(column))
    return F.col(column).cast("string")
