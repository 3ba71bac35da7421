"""Joining points to the intervals that contain them, and counting without joining.

An equality join on the key with a range test compares every point of a key with every interval of that key.  Instead, time is
divided into fixed cells of 2^36 microseconds (about 19 hours) arranged as a tree with a fixed fan-out.  An interval is written
as the few tree nodes that exactly cover its cells; a point looks at its own cell's ancestors, one per level.  The join is then
an equality on (key, node), its work follows the number of true matches, and a heavy key is spread over its nodes.  Times
outside 1831 to 2401 share the first and last cell, so outliers change nothing for the others.

Where only numbers are wanted, ``count_covering`` and ``count_overlapping`` need no pairs at all: an interval that starts no later
than a time and does not end before it covers it, so differences of running counts give the answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

_FANOUT = 8
_MAX_LEVELS = 16
_NODE_CELL_BITS = 36
_LEVELS = 6
_CELLS = _FANOUT ** _LEVELS
_FIRST_CELL = -64_000  # cell 0 of the tree starts in the year 1831

# Open bounds as numbers, and the length of a cell of the running counts: 2^32 microseconds, a little over an hour.
_ALWAYS = 2 ** 62
_CELL_BITS = 32


def point_in_interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str,
) -> DataFrame:
    """Inner join on ``keys`` and ``start <= at <= end``; NULL bounds are open.  Points without a time match nothing."""
    keys = list(keys)
    last = _CELLS - 1

    def cell(name: str) -> Column:
        number = F.shiftright(F.unix_micros(F.col(name).cast("timestamp")), _NODE_CELL_BITS) - _FIRST_CELL
        return F.greatest(F.lit(0).cast("long"), F.least(F.lit(last).cast("long"), number))

    def known(name: str, otherwise: int) -> Column:
        return F.when(F.col(name).isNull(), F.lit(otherwise).cast("long")).otherwise(cell(name))

    covered = (
        intervals
        .withColumn("_a", known(start, 0)).withColumn("_b", known(end, last))
        .where(F.col("_a") <= F.col("_b"))
        .withColumn("_node", F.explode(_cover(F.col("_a"), F.col("_b"), _LEVELS + 1)))
        .drop("_a", "_b")
    )
    probes = F.array(*[_node(level, F.shiftright("_c", 3 * level)) for level in range(_LEVELS + 1)])
    probing = (
        points.where(F.col(at).isNotNull())
        .withColumn("_c", cell(at)).withColumn("_node", F.explode(probes)).drop("_c")
    )
    within = (F.col(start).isNull() | (F.col(start) <= F.col(at))) & (F.col(end).isNull() | (F.col(end) >= F.col(at)))
    return probing.join(covered, [*keys, "_node"]).where(within).drop("_node")


def _node(level: int, number: Column) -> Column:
    """A tree node as one number, which joins faster than a (level, number) pair."""
    return number * _MAX_LEVELS + level


def _cover(a: Column, b: Column, levels: int) -> Column:
    """Tree nodes that cover cells ``a..b`` exactly once."""
    def nodes(level, first, last, when):
        run = F.when(when & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(run, lambda n: _node(level, n))

    parts = []
    for level in range(levels):
        size, parent = _FANOUT ** level, _FANOUT ** (level + 1)
        first = F.ceil(a / size).cast("long")
        last = F.floor((b + 1) / size).cast("long") - 1
        up_first = F.ceil(a / parent).cast("long")
        up_last = F.floor((b + 1) / parent).cast("long") - 1
        present = first <= last
        if level == levels - 1:
            parts.append(nodes(level, first, last, present))
            continue
        climbs = up_first <= up_last
        parts.append(nodes(level, first, last, present & ~climbs))
        parts.append(nodes(level, first, up_first * _FANOUT - 1, present & climbs))
        parts.append(nodes(level, (up_last + 1) * _FANOUT, last, present & climbs))
    return F.concat(*parts)


# ---- counting -------------------------------------------------------------------------------------------------------

def count_covering(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, name: str = "n"
) -> DataFrame:
    """``points`` with the number of intervals of their key that cover them (0 for points without a time or key)."""
    keys = list(keys)
    timed = points.withColumn("_at", F.unix_micros(F.col(at).cast("timestamp")))
    # Never NULL, so that no extra filter keeps Spark from reusing the shuffle below.
    known = F.coalesce("_at", F.lit(0).cast("long")).alias("_at")
    probes = timed.where(F.col("_at").isNotNull()).select(*keys, known, F.lit(0).alias("_s"), F.lit(0).alias("_e"))
    running = _running_counts(_bounds(_as_numbers(intervals, start, end), keys).unionByName(probes), keys)
    counted = timed.join(running, [*keys, "_at"], "left")
    return counted.select(
        *points.columns, F.coalesce(F.col("_started") - F.col("_ended"), F.lit(0)).cast("long").alias(name)
    )


def count_overlapping(intervals: DataFrame, groups: dict[str, Sequence[str]], start: str, end: str) -> DataFrame:
    """``intervals`` with, for each named list of key columns, the number of intervals of that group that overlap them.

    An interval counts itself.  Rows must be distinct (have an id).  Intervals that end before they start overlap nothing and
    are left out.
    """
    numbered = _as_numbers(intervals, start, end)
    both_ends = F.inline(F.array(
        F.struct(F.col("_end").alias("_at"), F.lit(True).alias("_is_end")),
        F.struct(F.col("_start").alias("_at"), F.lit(False).alias("_is_end")),
    ))
    looked_up = []
    for name, keys in groups.items():
        running = _running_counts(_bounds(numbered, list(keys)), list(keys))
        found = numbered.select(*intervals.columns, both_ends).join(running, [*keys, "_at"])
        share = F.when(F.col("_is_end"), F.col("_started")).otherwise(-F.col("_ended"))
        looked_up.append(found.select(*intervals.columns, F.lit(name).alias("_group"), share.alias("_share")))
    return reduce(DataFrame.unionByName, looked_up).groupBy(*intervals.columns).agg(
        *[F.sum(F.when(F.col("_group") == name, F.col("_share"))).alias(name) for name in groups]
    )


def covered_periods(intervals: DataFrame, keys: Sequence[str], start: str, end: str, least: int = 1) -> DataFrame:
    """The maximal periods of each key in which at least ``least`` of its intervals hold at any time: keys, ``start``, ``end``.

    Bounds belong to their intervals, so intervals that touch go on in one period; a NULL bound is open, and so are those of the result.
    Intervals that end before they start are left out.  Counting runs over cells of the time axis, and what opens and closes periods is
    numbered in the same way and paired by number, so a key with very many intervals is never ordered in one task.
    """
    keys = list(keys)
    running = _running_counts(_bounds(_as_numbers(intervals, start, end), keys), keys)
    level = F.col("_started") - F.col("_ended")
    opens, closes = (level >= least) & (level - F.col("_s") < least), (level >= least) & (level - F.col("_e") < least)
    marks = running.select(*keys, "_at", opens.cast("int").alias("_s"), closes.cast("int").alias("_e")).where("_s + _e > 0")
    numbered = _running_counts(marks, keys)
    first = numbered.where("_s = 1").select(*keys, F.col("_started").alias("_k"), F.col("_at").alias("_from"))
    last = numbered.where("_e = 1").select(*keys, (F.col("_ended") + 1).alias("_k"), F.col("_at").alias("_until"))
    bound = lambda c: F.timestamp_micros(F.when(F.abs(F.col(c)) < _ALWAYS, F.col(c)))
    return first.join(last, [*keys, "_k"]).select(*keys, bound("_from").alias(start), bound("_until").alias(end))


def _as_numbers(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Bounds as microseconds, open ones as far away; only intervals that do not end before they start."""
    micros = lambda c, default: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(default))
    return intervals.withColumn("_start", micros(start, -_ALWAYS)).withColumn("_end", micros(end, _ALWAYS)).where(
        F.col("_start") <= F.col("_end")
    )


def _bounds(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """Two rows per interval: one start and one end."""
    return numbered.select(*keys, F.inline(F.array(
        F.struct(F.col("_start").alias("_at"), F.lit(1).alias("_s"), F.lit(0).alias("_e")),
        F.struct(F.col("_end").alias("_at"), F.lit(0).alias("_s"), F.lit(1).alias("_e")),
    )))


def _running_counts(bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and time: how many intervals have started by then (``_started``) and ended before it (``_ended``).

    Rows are first reduced to one per key and time.  Running counts are those of whole cells of the time axis plus the rows
    inside the cell, so that a key with very many rows is counted by many tasks.
    """
    inside = Window.partitionBy(*keys, "_cell").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    times = (
        bounds.groupBy(*keys, "_at").agg(F.sum("_s").alias("_s"), F.sum("_e").alias("_e"))
        .withColumn("_cell", F.shiftright("_at", _CELL_BITS))
        .withColumn("_in_s", F.sum("_s").over(inside)).withColumn("_in_e", F.sum("_e").over(inside))
    )
    # A cell's totals are its last running counts; reading them from the same rows lets Spark shuffle those only once.
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = times.groupBy(*keys, "_cell").agg(F.max("_in_s").alias("_s"), F.max("_in_e").alias("_e")).select(
        *keys, "_cell", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_cs"),
        F.coalesce(F.sum("_e").over(before), F.lit(0)).alias("_ce"),
    )
    return times.join(cells, [*keys, "_cell"]).select(
        *keys, "_at", "_s", "_e", (F.col("_in_s") + F.col("_cs")).alias("_started"),
        (F.col("_in_e") - F.col("_e") + F.col("_ce")).alias("_ended"),
    )
