"""Temporal triples: behaviour cases, busy keys and numbering."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from memlake.operators import claims as cl
from memlake.operators import triples as kg
from memlake.operators.intervals import point_in_interval_join
from memlake.schema import TRIPLE

AS_OF = "2026-01-20 00:00:00"


def at(text):
    return None if text is None else dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


def table(spark, *rows):
    """Rows of (subject, predicate, object[, valid_from[, valid_until]]), numbered from 1."""
    full = []
    for i, row in enumerate(rows, 1):
        s, p, o, start, end = (*row, *[None] * (5 - len(row)))
        full.append((i, s, p, o, at(start), at(end), 1.0, "manual"))
    return spark.createDataFrame(full, TRIPLE)


def ids(df):
    return [r.id for r in df.collect()]


def test_activity_bounds_are_inclusive_and_open(spark):
    t = table(
        spark, ("a", "p", "open"), ("a", "p", "future", "2099-01-01"), ("a", "p", "past", None, "2020-01-01"),
        ("a", "p", "starts now", "2026-01-20"), ("a", "p", "ends now", None, "2026-01-20"),
    )
    assert sorted(r.object for r in kg.active(t, AS_OF).collect()) == ["ends now", "open", "starts now"]


def test_query_matches_both_sides_and_orders(spark):
    t = table(spark, ("Kai", "works_on", "Orion", "2025-01-01"), ("Orion", "owned_by", "Maya", "2025-06-01"),
              ("Maya", "knows", "Kai"), ("x", "y", "z"))
    assert ids(kg.query(t, "Orion")) == [2, 1]
    assert ids(kg.query(t, "Kai")) == [1, 3]
    assert ids(kg.query(t, "Kai", predicate="knows")) == [3]
    assert ids(kg.timeline(t, "Kai")) == [3, 1]
    assert ids(kg.query(t, "nobody")) == []


def test_query_many_takes_self_loops_once(spark):
    t = table(spark, ("a", "p", "a"), ("a", "p", "b"))
    found = kg.query_many(t, spark.createDataFrame([("a",), ("a",), ("b",)], "entity string"))
    assert sorted((r.entity, r.id) for r in found.collect()) == [("a", 1), ("a", 2), ("b", 2)]


def test_find_ignores_empty_parts(spark):
    t = table(spark, ("a", "p", "x"), ("a", "q", "x"), ("b", "p", "x"))
    assert ids(kg.find(t, subject="a")) == [2, 1]
    assert ids(kg.find(t, obj="x", predicate="p")) == [3, 1]
    assert ids(kg.find(t, subject="")) == [3, 2, 1]


def test_invalidate_ends_open_and_later_triples(spark):
    t = table(spark, ("a", "p", "x"), ("a", "p", "x", None, "2030-01-01"), ("a", "p", "x", None, "2020-01-01"), ("a", "p", "y"))
    endings = spark.createDataFrame([("a", "p", "x", at("2026-03-01")), ("a", "p", "x", at("2026-02-01"))],
                                    "subject string, predicate string, object string, ended timestamp")
    rows = {r.id: (r.changed, r.until) for r in kg.invalidate(t, endings).withColumn(
        "until", F.date_format("valid_until", "yyyy-MM-dd")).collect()}
    assert rows == {1: (True, "2026-02-01"), 2: (True, "2026-02-01"), 3: (False, "2020-01-01"), 4: (False, None)}


def test_add_numbers_without_gaps_and_keeps_copies(spark, monkeypatch):
    monkeypatch.setattr(kg, "_COPIES_PER_ROW", 7)
    t = table(spark, ("a", "p", "x"), ("a", "p", "y"))
    new = spark.createDataFrame([("hot", "p", "x")] * 50 + [(f"s{i}", "p", "x") for i in range(20)],
                                "subject string, predicate string, object string")
    rows = kg.add(t, new.repartition(3)).collect()
    assert sorted(r.id for r in rows) == list(range(1, 73))
    assert sum(r.subject == "hot" for r in rows) == 50
    again = kg.add(t, new.repartition(5)).collect()
    assert {(r.id, r.subject) for r in rows} == {(r.id, r.subject) for r in again}
    assert {(r.confidence, r.source, r.valid_from) for r in rows if r.id > 2} == {(1.0, "manual", None)}


def test_add_to_empty_table_starts_at_one(spark):
    empty = spark.createDataFrame([], TRIPLE)
    assert ids(kg.add(empty, spark.createDataFrame([("a", "b", "c")], "subject string, predicate string, object string"))) == [1]


def test_tenure_conflicts(spark):
    t = table(spark, ("Kai", "assigned_to", "orion"), ("Kai", "assigned_to", "driftwood"), ("Kai", "manages", "orion"),
              ("Maya", "assigned_to", "orion"), ("Maya", "assigned_to", "orion"))
    rows = cl.tenure_conflict_rows(t, AS_OF).collect()
    assert [(r.description, r.stored.id, r.piece) for r in rows] == [("Kai assigned_to — driftwood vs orion", 2, 0)]
    ended = kg.invalidate(t, spark.createDataFrame([("Kai", "assigned_to", "orion", at("2026-01-01"))],
                                                   "subject string, predicate string, object string, ended timestamp"))
    assert kg.tenure_conflicts(ended.drop("changed"), AS_OF).count() == 0


def test_large_conflicts_are_listed_whole_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(kg, "_ITEMS_PER_PIECE", 10)
    t = table(spark, *[("hot", "p", f"o{i}") for i in range(95)], ("b", "p", "x"), ("b", "p", "y"))
    rows = sorted(kg.tenure_lists(t, AS_OF).collect(), key=lambda r: (r.subject, r.piece))
    hot = [r.objects for r in rows if r.subject == "hot"]
    assert len(hot) == 10
    assert " vs ".join(hot) == " vs ".join(f"o{i}" for i in reversed(range(95)))
    assert kg.tenure_members(t, AS_OF).where("subject = 'hot'").count() == 95


def test_distant_ids_are_one_piece(spark):
    t = table(spark, ("a", "p", "x"), ("a", "p", "y"), ("a", "p", "z"))
    for last in (6_000_000, 2**62):
        far = t.withColumn("id", F.when(F.col("id") == F.lit(2), last).when(F.col("id") > 2, last - 1).otherwise(F.lit(-5)).cast("long"))
        assert [(r.piece, r.objects) for r in kg.tenure_lists(far, AS_OF).collect()] == [(0, "y vs z vs x")]


@pytest.mark.parametrize("name", ["conflict_labels", "kg_tenure_descriptions"])
def test_a_large_conflict_is_one_row_as_in_its_sql(spark, monkeypatch, name):
    import __spark_entry__ as entry
    from contract import DATA, compare, duck

    monkeypatch.setattr(kg, "_ITEMS_PER_PIECE", 2)
    sf_dir = str(DATA / "sf0.01")
    assert compare(spark, duck(sf_dir), sf_dir, entry.queries()[name], entry.oracle_sql()[name])[0] == "equal"


def test_resolution_policies(spark):
    t = table(spark, ("Kai", "assigned_to", "orion"), ("Kai", "assigned_to", "driftwood"))
    found = cl.tenure_headers(t, AS_OF)
    for policy, count, ended in (("keep", 1, 0), ("skip", 0, 0), ("update", 1, 1)):
        state, resolved = cl.resolve(found, t, AS_OF, policy)
        assert resolved.first()[0] == count
        assert state.where("valid_until IS NOT NULL").count() == ended
    with pytest.raises(ValueError):
        cl.resolve(found, t, AS_OF, "other")


def test_decision_adds_replacement(spark):
    t = table(spark, ("Kai", "assigned_to", "orion"))
    decisions = spark.createDataFrame(
        [("update", "Kai", "assigned_to", "orion", ""), ("keep", "Kai", "assigned_to", "orion", "z")],
        "action string, subject string, predicate string, object string, new_object string")
    rows = {r.id: r for r in cl.apply_decisions(decisions, t, AS_OF).collect()}
    assert len(rows) == 2 and rows[1].valid_until is not None
    assert (rows[2].object, rows[2].source) == ("unknown", "conflict_resolver")


# ---- counting and joining over time, against brute force ---------------------------------------------------------------

def random_periods(seed, n, keys):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = None if rng.random() < 0.1 else rng.randrange(0, 3000)
        end = None if rng.random() < 0.2 else (start or 0) + rng.choice([-5, 0, 1, 50, 2000])
        # One key holds most rows.
        rows.append((i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(keys)}", rng.choice("pq"), f"o{rng.randrange(4)}", start, end))
    return rows


def periods_table(spark, rows):
    df = spark.createDataFrame(rows, "id long, subject string, predicate string, object string, s long, e long")
    base = 1_700_000_000
    return df.select("id", "subject", "predicate", "object", F.timestamp_seconds(F.col("s") * 600 + base).alias("valid_from"),
                     F.timestamp_seconds(F.col("e") * 600 + base).alias("valid_until"))


def test_overlap_counts_match_brute_force(spark):
    rows = random_periods(1, 300, 3)
    expected = {}
    for i, s, p, o, a, b in rows:
        n = 0
        for j, s2, p2, o2, a2, b2 in rows:
            fits = all(x is None or y is None or x <= y for x, y in ((a, b), (a2, b2), (a, b2), (a2, b)))
            n += (s, p) == (s2, p2) and o != o2 and fits
        if n:
            expected[i] = n
    assert {r.id: r.n_overlaps for r in kg.overlap_conflicts(periods_table(spark, rows)).collect()} == expected


def test_counts_at_times_match_brute_force(spark):
    rows = random_periods(4, 250, 4)
    rng = random.Random(5)
    points = [(i, rng.choice(["hot", "k0", "k1", "absent", None]), rng.choice([None, *range(-10, 3200, 11)])) for i in range(200)]
    expected = {
        i: sum(key == s and t is not None and (a is None or a <= t) and (b is None or t <= b) and (a is None or b is None or a <= b)
               for _, s, _, _, a, b in rows)
        for i, key, t in points
    }
    df = spark.createDataFrame(points, "pid long, subject string, t long").withColumn(
        "ts", F.timestamp_seconds(F.col("t") * 600 + 1_700_000_000))
    got = kg.count_facts_at(df, periods_table(spark, rows), "subject", "ts").collect()
    assert {r.pid: r.n_facts for r in got} == expected


@pytest.mark.parametrize("stretch", [1, 1000, 50_000])
def test_interval_join_matches_brute_force(spark, stretch):
    """Times minutes, months or years apart; the longest leave the range of the cells on both sides."""
    rows = random_periods(2, 250, 4)
    rng = random.Random(3)
    points = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", rng.choice([None, *range(-10, 3200, 7)])) for i in range(200)]
    expected = {
        (i, j) for i, key, t in points for j, s, _, _, a, b in rows
        if t is not None and key == s and (a is None or a <= t) and (b is None or t <= b)
    }
    df = spark.createDataFrame(points, "pid long, subject string, t long").withColumn(
        "ts", F.timestamp_seconds(F.col("t") * 600 + 1_700_000_000))
    def stretched(name):
        return F.timestamp_seconds((F.unix_seconds(F.col(name)) - 1_700_000_000 - 600 * 1500) * stretch + 1_700_000_000)

    periods = periods_table(spark, rows).withColumns({c: stretched(c) for c in ("valid_from", "valid_until")})
    joined = point_in_interval_join(
        df.withColumn("ts", stretched("ts")), periods, ["subject"], "ts", "valid_from", "valid_until")
    got = [(r.pid, r.id) for r in joined.collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected


def test_conflict_periods_against_all_moments(spark):
    """Whole numbers as days: the periods hold at exactly the moments (days and half days) where two objects hold."""
    import random

    rng = random.Random(2)
    rows = []
    for i in range(120):
        start = rng.choice([None, *range(1, 28)])
        rows.append((i, rng.choice("AB"), "p", rng.choice("xyz"), start, rng.choice([None, *range(1, 29)]) if rng.random() < 0.3 else (start or 1) + rng.randrange(-1, 4)))
    rows += [(1000 + i, "hot", "p", f"o{i % 3}", 5, 6) for i in range(300)] + [(2000, "touch", "p", "x", 1, 5), (2001, "touch", "p", "y", 5, 9), (2002, "touch", "p", "x", 9, 12),
             (2003, "same", "p", "x", 1, 9), (2004, "same", "p", "x", 3, 5)]
    day = lambda c: f"timestamp_micros(cast({c} as bigint) * 86400000000)"
    df = spark.createDataFrame(rows, "id long, subject string, predicate string, object string, a int, b int").selectExpr(
        "id", "subject", "predicate", "object", f"{day('a')} AS valid_from", f"{day('b')} AS valid_until").repartition(5)
    found = kg.conflict_periods(df).selectExpr("subject", "unix_micros(valid_from) / 86400000000 AS a", "unix_micros(valid_until) / 86400000000 AS b").collect()
    holds = lambda a, b, t: (a is None or a <= t) and (b is None or t <= b)
    for subject in {r[1] for r in rows}:
        for t in [x / 2 for x in range(-2, 70)]:
            objects = {o for _, s, _, o, a, b in rows if s == subject and holds(a, b, t) and not (a is not None and b is not None and b < a)}
            assert sum(holds(r.a, r.b, t) for r in found if r.subject == subject) == (len(objects) > 1), (subject, t)
    assert [(r.a, r.b) for r in found if r.subject == "hot"] == [(5, 6)]
    assert sorted((r.a, r.b) for r in found if r.subject == "touch") == [(5, 5), (9, 9)] and not [r for r in found if r.subject == "same"]
    assert kg.conflict_periods(df.where("false")).count() == 0
