"""Temporal triples: a table of (subject, predicate, object) facts with inclusive validity bounds; NULL means open.

Every operator takes and returns DataFrames.  "Now" is always the explicit ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from memlake.functions.times import as_time
from memlake.operators.intervals import count_covering, count_overlapping, covered_periods, point_in_interval_join

SPO = ["subject", "predicate", "object"]
_COLUMNS = ["id", *SPO, "valid_from", "valid_until", "confidence", "source"]

# New triples are numbered in this many independent buckets.
_ID_BUCKETS = 2048
# Exact copies of one new triple that are written out by one row of work.
_COPIES_PER_ROW = 100_000
# Longest list of objects (or other members) put into one result row.
_ITEMS_PER_PIECE = 1000


def is_active(at, valid_from: str = "valid_from", valid_until: str = "valid_until") -> Column:
    """Both bounds inclusive, NULL bounds open."""
    at = as_time(at)
    return (F.col(valid_from).isNull() | (F.col(valid_from) <= at)) & (
        F.col(valid_until).isNull() | (F.col(valid_until) >= at)
    )


# ---- writes ---------------------------------------------------------------------------------------------------------

def add(triples: DataFrame, new: DataFrame) -> DataFrame:
    """Append ``new`` without removing duplicates; ids continue after the largest existing id without gaps.

    ``new`` has the columns of a triple except ``id``; missing ``valid_from``, ``valid_until`` are NULL, ``confidence`` is 1.0
    and ``source`` is ``manual``.  The numbering is the same however the input is partitioned: rows are counted per
    content-hash bucket, the buckets get offsets, and rows are ranked inside their bucket.  Exact copies are counted before
    the shuffle and written out afterwards, so a heavily repeated row costs no more than a rare one.
    """
    defaults = {"valid_from": F.lit(None), "valid_until": F.lit(None), "confidence": F.lit(1.0), "source": F.lit("manual")}
    values = [c for c in _COLUMNS if c != "id"]
    typed = new.select(*[
        (F.col(c) if c in new.columns else defaults[c]).cast(triples.schema[c].dataType).alias(c) for c in values
    ])
    bucket = F.pmod(F.xxhash64(*values), F.lit(_ID_BUCKETS))
    distinct = typed.groupBy(*values).agg(F.count("*").alias("_copies")).withColumn("_bucket", bucket)

    # _ID_BUCKETS rows at most, so a window without partitions is safe here.
    offsets = (
        distinct.groupBy("_bucket").agg(F.sum("_copies").alias("_n"))
        .select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_offset"))
    )
    last = F.coalesce(triples.agg(F.max("id")).scalar(), F.lit(0))
    in_bucket = Window.partitionBy("_bucket").orderBy(*values).rowsBetween(Window.unboundedPreceding, 0)
    first = F.sum("_copies").over(in_bucket) - F.col("_copies")
    numbered = (
        distinct.withColumn("_first", first)
        .join(offsets, "_bucket")
        .withColumn("_from", last + F.col("_offset") + F.col("_first") + 1)
    )
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / _COPIES_PER_ROW).cast("long"))
    spread = numbered.withColumn("_chunk", F.explode(chunks)).repartition("_from", "_chunk")
    start = F.col("_chunk") * _COPIES_PER_ROW
    stop = F.least(start + _COPIES_PER_ROW, F.col("_copies")) - 1
    added = spread.withColumn("_step", F.explode(F.sequence(start, stop))).withColumn("id", F.col("_from") + F.col("_step"))
    return triples.select(*_COLUMNS).unionByName(
        added.select(F.col("id").cast(triples.schema["id"].dataType).alias("id"), *values)
    )


def invalidate(triples: DataFrame, endings: DataFrame) -> DataFrame:
    """End matching triples.  ``endings`` has subject, predicate, object, ``ended``.

    A triple is changed when it is open or ends later than ``ended``.  Several endings of one fact applied in any order leave
    the earliest, so they are reduced before the join.  The result carries ``changed`` for counting; drop it to store.
    """
    ended = endings.groupBy(*SPO).agg(F.min("ended").alias("_ended"))
    joined = triples.join(ended, SPO, "left")
    hit = F.col("_ended").isNotNull() & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col("_ended")))
    until = F.when(hit, F.col("_ended").cast(triples.schema["valid_until"].dataType)).otherwise(F.col("valid_until"))
    return joined.select(
        *[until.alias("valid_until") if c == "valid_until" else F.col(c) for c in triples.columns],
        hit.alias("changed"),
    )


def delete_by_id(triples: DataFrame, ids: DataFrame) -> DataFrame:
    return triples.join(ids.select("id"), "id", "left_anti").select(*triples.columns)


# ---- reads ----------------------------------------------------------------------------------------------------------

def query(triples: DataFrame, entity: str, predicate: str | None = None, active_at=None) -> DataFrame:
    """Triples naming ``entity`` as subject or object, newest start first (open starts last)."""
    found = triples.where((F.col("subject") == entity) | (F.col("object") == entity))
    return _narrow(found, predicate, active_at).orderBy(F.col("valid_from").desc_nulls_last(), "id")


def query_many(triples: DataFrame, entities: DataFrame, predicate: str | None = None, active_at=None) -> DataFrame:
    """``query`` for a DataFrame of entities (column ``entity``), as two equi-joins.

    A triple whose subject and object are the same entity is taken from the subject side only.
    """
    narrowed = _narrow(triples, predicate, active_at)
    wanted = entities.select("entity").distinct()
    by_subject = narrowed.join(wanted, F.col("subject") == F.col("entity"))
    by_object = narrowed.where(F.col("subject") != F.col("object")).join(wanted, F.col("object") == F.col("entity"))
    return by_subject.unionByName(by_object)


def timeline(triples: DataFrame, entity: str) -> DataFrame:
    """All triples of an entity in time order, open starts first."""
    return query(triples, entity).orderBy(F.col("valid_from").asc_nulls_first(), "id")


def timeline_many(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Timelines of many entities, sorted by entity and time with a range-partitioned sort."""
    return query_many(triples, entities).orderBy("entity", F.col("valid_from").asc_nulls_first(), "id")


def find(triples: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None) -> DataFrame:
    """Exact lookup by any of the three parts, newest id first; empty arguments are ignored."""
    for column, value in (("subject", subject), ("predicate", predicate), ("object", obj)):
        if value:
            triples = triples.where(F.col(column) == value)
    return triples.orderBy(F.col("id").desc())


def all_triples(triples: DataFrame) -> DataFrame:
    return triples.orderBy("id")


def missing_valid_from(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("valid_from").isNull())


def active(triples: DataFrame, as_of) -> DataFrame:
    return triples.where(is_active(as_of))


def facts_at(points: DataFrame, triples: DataFrame, entity: str, at: str) -> DataFrame:
    """Each row of ``points`` with every triple about its ``entity`` that is active at its own time ``at``."""
    facts = triples.withColumnRenamed("subject", entity)
    return point_in_interval_join(points, facts, [entity], at, "valid_from", "valid_until")


def count_facts_at(points: DataFrame, triples: DataFrame, entity: str, at: str, name: str = "n_facts") -> DataFrame:
    """Each row of ``points`` with the number of triples about its ``entity`` active at its own time; no pairs are formed."""
    facts = triples.select(F.col("subject").alias(entity), "valid_from", "valid_until")
    return count_covering(points, facts, [entity], at, "valid_from", "valid_until", name)


def _narrow(triples: DataFrame, predicate: str | None, active_at) -> DataFrame:
    if predicate:
        triples = triples.where(F.col("predicate") == predicate)
    if active_at is not None:
        triples = triples.where(is_active(active_at))
    return triples


# ---- conflicts ------------------------------------------------------------------------------------------------------

def tenure_conflicts(triples: DataFrame, as_of) -> DataFrame:
    """(subject, predicate) pairs with different objects active at ``as_of``.

    One row per conflict: number of active triples and of objects, and id and object of the newest triple (largest id).  Rows
    are first reduced per object (numbers only, so by hash), then per pair; a pair that holds much of the table never meets
    in one task.
    """
    per_object = active(triples, as_of).groupBy(*SPO).agg(
        F.count("*").alias("_n"), F.max("id").alias("_last"), F.min("id").alias("_first")
    )
    return (
        per_object.groupBy("subject", "predicate")
        .agg(
            F.sum("_n").alias("n_active"), F.count("*").alias("n_objects"),
            F.max(F.struct("_last", "object")).alias("_top"), F.min("_first").alias("first_id"),
        )
        .where(F.col("n_objects") > 1)
        .select("subject", "predicate", "n_active", "n_objects", "first_id",
                F.col("_top._last").alias("stored_id"), F.col("_top.object").alias("stored_object"))
    )


def tenure_members(triples: DataFrame, as_of) -> DataFrame:
    """The active triples of every conflicting pair, one row each (all of them, however many a pair has)."""
    keys = tenure_conflicts(triples, as_of).select("subject", "predicate", "n_active", "first_id", "stored_id")
    return active(triples, as_of).join(keys, ["subject", "predicate"])


def tenure_lists(triples: DataFrame, as_of, separator: str = " vs ", whole: bool = False) -> DataFrame:
    """Objects of each conflict joined newest id first, with the id of its newest triple.

    A pair with more than ``_ITEMS_PER_PIECE`` members gets several rows: its id range is cut into that many equal steps and
    each row (``piece`` 0, 1, ...) lists one step.  Reading the pieces in order gives the whole list.  With ``whole`` the pieces
    of a pair are put together again, as one row (``piece`` 0), which then holds all of its objects.
    """
    members = tenure_members(triples, as_of)
    pieces = F.ceil(F.col("n_active") / _ITEMS_PER_PIECE)
    # Cast first: an id distance, and more so its product with the piece count, may leave 64 bits.
    back = lambda c: F.col("stored_id").cast("decimal(20,0)") - F.col(c)
    # In whole numbers: a quotient rounded to a few decimals may reach the next step.
    piece = F.call_function("div", back("id") * pieces, back("first_id") + 1)
    listed = F.sort_array(F.collect_list(F.struct("id", "object")), asc=False)
    lists = (
        members.withColumn("piece", piece)
        .groupBy("subject", "predicate", "stored_id", "piece")
        .agg(F.array_join(F.transform(listed, lambda m: m["object"]), separator).alias("objects"))
    )
    if not whole:
        return lists
    parts = F.array_sort(F.collect_list(F.struct("piece", "objects")))
    joined = F.array_join(F.transform(parts, lambda p: p["objects"]), separator)
    return lists.groupBy("subject", "predicate", "stored_id").agg(F.lit(0).cast("long").alias("piece"), joined.alias("objects"))


def conflict_periods(triples: DataFrame) -> DataFrame:
    """When each (subject, predicate) had two objects or more at once: maximal periods, ``subject, predicate, valid_from, valid_until``.

    Periods of one object are merged first, so an object that is stated twice is no conflict with itself.  The result grows with the
    number of changes, however many triples hold at once.
    """
    one_each = covered_periods(triples.select(*SPO, "valid_from", "valid_until"), SPO, "valid_from", "valid_until")
    return covered_periods(one_each, ["subject", "predicate"], "valid_from", "valid_until", least=2)


def overlap_conflicts(triples: DataFrame) -> DataFrame:
    """Triples whose period overlaps that of another object of the same subject and predicate, at any time.

    ``n_overlaps`` counts those other triples: the overlaps in the (subject, predicate) group less those of the same object.
    """
    periods = triples.select("id", *SPO, "valid_from", "valid_until")
    counted = count_overlapping(periods, {"_all": ["subject", "predicate"], "_same": SPO}, "valid_from", "valid_until")
    return counted.withColumn("n_overlaps", F.col("_all") - F.col("_same")).where(F.col("n_overlaps") > 0).select(
        "id", *SPO, "n_overlaps"
    )
