"""A Merkle manifest of a dataset: a tree of digests for each source, and one over all sources.

Trees have ``ARITY`` children a node.  A level is one shuffle on (tree, run): a run's 16 rows meet in one window, where lag and lead
columns of fixed offsets, masked by slot and run length, hold the siblings, and the run's first row hashes the parent.  Places are
counted from a range partitioning, so neither a source that holds most rows nor one tree over all of them meets in one task.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm.registry import query, table
from memlake.session import materialise

#: Children of a node; fixed by the manifest's format.
ARITY = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts in a row, as lowercase hex."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value that can't run into its neighbours: `-` for null, else its UTF-8 bytes behind their number."""
    plain = value.cast("string")
    return F.when(plain.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain))


def _tree(name: Column) -> Column:
    """A tree's name as a key that is never null and sorts bytewise, null first."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (tree, hash, ...) with ``pos``, the place in its tree by ``order``, and ``n``, the tree's leaves.

    Rows are sorted in ranges over all tasks and written; a place is then the row's place in its range plus what earlier ranges hold of
    its tree, so only one small row for each range and tree is ever summed up.  Rows equal in tree and order come in any order.
    ``leaves`` is read twice, as ranges are found from a sample.
    """
    ranged = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    stored = materialise(ranged.withColumn("row", F.monotonically_increasing_id())).withColumn("part", F.shiftright("row", 33))
    parts = stored.groupBy("part", "tree").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", "tree", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"),
                          F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    return stored.join(starts, ["part", "tree"]).withColumn("pos", F.col("row") - F.col("first") + F.col("before")).drop("part", "row", "first", "before")


def _run() -> Column:
    return F.floor(F.col("pos") / ARITY)


def _siblings() -> tuple[Column, Column]:
    """The run's digests before and after this row's, each joined; empty in a tree of one node."""
    window = Window.partitionBy("tree", "run").orderBy("pos")
    slot, length = F.col("pos") - F.col("run") * ARITY, F.least(F.lit(ARITY), F.col("n") - F.col("run") * ARITY)
    before = [F.when(slot >= k, F.lag("hash", k).over(window)) for k in range(ARITY - 1, 0, -1)]
    after = [F.when(slot + k < length, F.lead("hash", k).over(window)) for k in range(1, ARITY)]
    return F.concat_ws("", *before), F.concat_ws("", *after)


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level: each run's first row hashes the run; the single node of a finished tree goes up as it is."""
    _, after = _siblings()
    level = nodes.select("tree", "pos", "n", "hash", _run().alias("run"))
    level = level.select("tree", "pos", "run", "n", "hash", after.alias("after")).where(F.col("pos") == F.col("run") * ARITY)
    up = F.when(F.col("n") > 1, digest(F.col("hash"), F.col("after"))).otherwise(F.col("hash"))
    return level.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / ARITY).alias("n"), up.alias("hash"))


def grow(leaves: DataFrame) -> list[DataFrame]:
    """All levels of the trees over ``leaves`` (tree, pos, n, hash), leaves first; in the last one every tree has one node, its root."""
    levels = [leaves]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        levels.append(materialise(_parents(levels[-1])))
    return levels


def _with_path(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` with the columns of ``above`` (tree, pos, path, ...), of their parents, where ``path`` is the siblings on the way to
    the root, the node's own first.  A tree of one node has no siblings and no parent of its own.  One exchange serves window and join."""
    before, after = _siblings()
    level = nodes.withColumn("run", _run()).withColumns({"before": before, "after": after})
    met = level.join(above.withColumnRenamed("pos", "run").withColumnRenamed("path", "rest"), ["tree", "run"])
    step = F.array(F.struct("before", "after")).cast(f"array<{_STEP}>")
    return met.withColumn("path", F.when(F.col("n") > 1, F.concat(step, F.col("rest"))).otherwise(F.col("rest"))).drop("run", "before", "after", "rest")


def _above_leaves(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The paths of the leaves' parents: ``tree, pos, path`` and what else ``top`` (tree, path, ...) has for each tree's root."""
    above = top.withColumn("pos", F.lit(0).cast("long"))
    for level in reversed(levels[1:-1]):
        above = materialise(_with_path(level, above).drop("n", "hash"))
    return above


def fold(start: Column, path: Column) -> Column:
    """The root that a digest and its path give."""
    return F.aggregate(path, start, lambda h, s: digest(s["before"], h, s["after"]))


def manifest(rows: DataFrame, fields: list[str], source: str = "source", order: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``rows``: the columns of ``keep``, ``leaf``, ``subroot``, ``root`` and ``path``, its proof.

    A leaf is the digest of the ``fields``, framed, so a null differs from an empty or any other value.  Leaves ascend by ``order``
    (nulls first, then by digest) in their ``source``; sources ascend bytewise, null first, and are the leaves of the last tree.
    Repeated rows are leaves of their own with equal digests.  Texts, however long, are read once and as a whole, and only digests are
    shuffled.  No other columns are read, so these may have any names.  An empty table gives no rows.
    """
    kept = keep or {}
    # The caller's columns stay inside one struct, where their names can't clash.
    leaves = materialise(rows.select(
        _tree(F.col(source)).alias("tree"), F.col(order).alias("at"), digest(*[framed(F.col(f)) for f in fields]).alias("hash"),
        F.struct(F.lit(0).alias("_"), *[c.alias(name) for name, c in kept.items()]).alias("kept")))
    placed = materialise(numbered(leaves, ["at", "hash"]).drop("at"))
    levels = grow(placed.drop("kept"))
    sources = materialise(numbered(levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "hash"), ["source"]))
    top = grow(sources.drop("source"))
    root = top[-1].select("tree", F.array().cast(f"array<{_STEP}>").alias("path"), F.col("hash").alias("root"))
    ends = materialise(_with_path(sources, _above_leaves(top, root)).select(F.col("source").alias("tree"), "path", F.col("hash").alias("subroot"), "root"))
    proven = _with_path(placed, _above_leaves(levels, ends))
    return proven.select(*[F.col("kept")[name].alias(name) for name in kept], F.col("hash").alias("leaf"), "subroot", "root", "path")


def proof(path: Column) -> Column:
    """All siblings of a path, left to right, level by level."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _levels_sql(tree: str, leaves: str, depth: int, n: str) -> str:
    """``depth`` levels of the trees ``leaves`` (tree, pos, hash) in SQL: runs as lists, parents of their joined digests."""
    parts = [f"{n}0 AS (SELECT tree, pos, hash, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"]
    for k in range(depth):
        parts.append(f"""{n}r{k} AS (SELECT tree, pos // {ARITY} AS run, list(hash ORDER BY pos) AS run_hashes, any_value(n) AS n FROM {n}{k} GROUP BY tree, pos // {ARITY})""")
        parts.append(f"""{n}{k + 1} AS (SELECT tree, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(run_hashes, '')) ELSE run_hashes[1] END AS hash,
  (n + {ARITY - 1}) // {ARITY} AS n FROM {n}r{k})""")
    return ",\n".join(parts)


def _climb_sql(start: str, depth: int, n: str, out: str) -> str:
    """Rows of ``start`` (tree, place, folded, siblings, ...) taken up ``depth`` levels, folding and gathering siblings."""
    parts, last = [], start
    for k in range(depth):
        name = f"{out}{k}"
        parts.append(f"""{name} AS (SELECT s.* REPLACE (place // {ARITY} AS place,
    CASE WHEN r.n > 1 THEN sha256(array_to_string(run_hashes[1:place % {ARITY}], '') || folded || array_to_string(run_hashes[place % {ARITY} + 2:], '')) ELSE folded END AS folded,
    CASE WHEN r.n > 1 THEN siblings || array_to_string(run_hashes[1:place % {ARITY}], '') || array_to_string(run_hashes[place % {ARITY} + 2:], '') ELSE siblings END AS siblings)
  FROM {last} s JOIN {n}r{k} r ON s.tree IS NOT DISTINCT FROM r.tree AND s.place // {ARITY} = r.run)""")
        last = name
    return ",\n".join(parts)


def _framed_sql(expr: str) -> str:
    return f"coalesce(strlen({expr}) || ':' || {expr}, '-')"


#: CRC-32 of a short text, bit by bit; -1 stands for a shift.
_CRC_SQL = """CASE WHEN {0} IS NOT NULL THEN xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length({0}) + 1),
  lambda i: list_concat([ord({0}[i])::BIGINT], list_transform(range(8), lambda j: -1::BIGINT))))),
  lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) END"""

_DEPTH, _TOP_DEPTH = 6, 4  # enough for 16^6 documents of a source and 16^4 sources
_ORACLE = f"""
WITH d AS (SELECT *, {_CRC_SQL.format('cast(doc_id AS varchar)')} AS crc FROM documents),
h AS (SELECT doc_id, source AS tree,
    sha256({' || '.join(_framed_sql(f'cast({f} AS varchar)') for f in _FIELDS)}) AS hash,
    sha256({' || '.join(_framed_sql(f'cast({f} AS varchar)') for f in _FIELDS[:-1])} || {_framed_sql(f"CASE WHEN crc % 5 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END")}) AS changed
  FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos FROM h),
{_levels_sql('tree', 'p', _DEPTH, 'l')},
subs AS (SELECT NULL::varchar AS tree, tree AS source, hash, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos FROM l{_DEPTH}),
{_levels_sql('tree', 'subs', _TOP_DEPTH, 't')},
s AS (SELECT doc_id, hash AS leaf, tree, pos AS place, changed AS folded, '' AS siblings FROM p),
{_climb_sql('s', _DEPTH, 'l', 'u')},
s2 AS (SELECT doc_id, leaf, subs.hash AS subroot, subs.tree, subs.pos AS place, folded, siblings FROM u{_DEPTH - 1} u JOIN subs ON u.tree IS NOT DISTINCT FROM subs.source),
{_climb_sql('s2', _TOP_DEPTH, 't', 'v')}
SELECT doc_id, leaf, subroot, t.hash AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = t.hash AS verified
FROM v{_TOP_DEPTH - 1}, t{_TOP_DEPTH} t
"""


@query("op13_merkle", _ORACLE)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, and the check of each row after every fifth one by the hash of its id had its capitals lowered."""
    docs = table(spark, sf_dir)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(hit, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    changed = digest(*[framed(F.col(f)) for f in _FIELDS[:-1]], framed(text))
    listed = manifest(docs, _FIELDS, keep={"doc_id": F.col("doc_id"), "changed": changed})
    folded = listed.withColumn("folded_root", fold(F.col("changed"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))
