"""Hierarchy, links, changing tables, audit and diary."""

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from memlake.functions.shorthand import compress
from memlake.operators import audit as au
from memlake.operators import context as co
from memlake.operators import diary as di
from memlake.operators import graph as gr
from memlake.operators import ranking as rk
from memlake.operators import replay as re
from memlake.operators import store as st
from memlake.operators import summaries as su
from memlake.operators import tables as tb
from memlake.schema import AGENT, CLOSET, DIARY, DRAWER, ROOM, TUNNEL, WING

AS_OF = "2026-01-20 00:00:00"


def when(days):
    return None if days is None else dt.datetime(2026, 1, 20, tzinfo=dt.timezone.utc) - dt.timedelta(days=days)


def drawers(spark, *rows):
    """Rows of (id, wing, room, hall, content, days old, pinned)."""
    return spark.createDataFrame([(i, w, r, h, c, when(d), p, 1.0, []) for i, w, r, h, c, d, p in rows], DRAWER)


@pytest.fixture(scope="module")
def base(spark):
    return drawers(
        spark,
        ("a", "w1", "auth", "facts", "the first fact", 5, False), ("b", "w1", "auth", "events", "an event and more", 3, False),
        ("c", "w1", "db", "facts", "pinned fact", 400, True), ("d", "w2", "auth", "misc", "lost", 100, False),
        ("e", "w2", "ui", "advice", "x" * 400, None, False),
    )


def test_scan_lookup_pin_delete(spark, base):
    assert {r.id for r in st.scan_drawers(base, wing="w1", hall="facts").collect()} == {"a", "c"}
    assert {r.id for r in st.scan_drawers(base).collect()} == set("abcde")
    ids = spark.createDataFrame([("a",), ("zz",)], "id string")
    assert {r.id for r in st.get_by_id(base, ids).collect()} == {"a"}
    assert {r.id for r in st.pin(base, ids).where("pinned").collect()} == {"a", "c"}
    keys = base.where("id = 'a'").select(*st.DRAWER_KEY)
    assert {r.id for r in st.delete(base, keys).collect()} == set("bcde")


def test_wings_and_rooms(spark, base):
    wings = spark.createDataFrame([("w1", when(0), "one"), ("w9", when(0), "empty")], WING)
    assert [(r.name, r.description) for r in st.list_wings(base, wings).collect()] == [("w1", "one"), ("w2", None), ("w9", "empty")]
    rooms = spark.createDataFrame([], ROOM)
    assert [r.name for r in st.list_rooms(base, rooms, "w1").collect()] == ["auth", "db"]
    assert st.list_rooms(base, rooms, "nowhere").count() == 0
    new = spark.createDataFrame([("w1", "auth"), ("w3", "auth"), ("w3", "auth")], "wing string, name string")
    grown, owners = st.ensure_rooms(rooms, wings, new, AS_OF)
    assert sorted((r.wing, r.name) for r in grown.collect()) == [("w1", "auth"), ("w3", "auth")]
    assert sorted(r.name for r in owners.collect()) == ["w1", "w3", "w9"]
    assert st.halls_of(grown).count() == 10
    renamed = st.create_wings(wings, spark.createDataFrame([("w1", "new")], "name string, description string"), AS_OF)
    assert {r.name: r.description for r in renamed.collect()} == {"w1": "new", "w9": "empty"}


def test_stats_and_age(spark, base):
    closets = spark.createDataFrame([("w1", "auth", "facts", "c", when(0)), ("w1", "auth", "misc", "c", when(0))], CLOSET)
    assert st.stats(base, closets).first().asDict() == {"wings": 2, "rooms": 4, "drawers": 4, "closets": 1}
    ages = {r.id: r.age_days for r in st.with_age(base, AS_OF).collect()}
    assert ages["a"] == 5.0 and ages["e"] is None


def test_add_memories_is_idempotent(spark):
    new = spark.createDataFrame([("the plan and the goal",), ("the plan and the goal",)], "content string")
    added = st.add_memories(new, AS_OF, compress)
    row = added.first()
    assert (row.wing, row.room, row.hall, row.content, row.pinned) == ("default", "general", "facts", "plan & goal", False)
    assert added.select("id").distinct().count() == 1


def test_save_drawers_creates_parents(spark, base):
    new = drawers(spark, ("n", "w7", "attic", "facts", "old", 2, False), ("n", "w7", "attic", "facts", "new", 1, False))
    saved, rooms, wings = st.save_drawers(base, spark.createDataFrame([], ROOM), spark.createDataFrame([], WING), new, AS_OF)
    assert {r.id: r.content for r in saved.collect()}["n"] == "new" and saved.count() == 6
    assert [(r.wing, r.name) for r in rooms.collect()] == [("w7", "attic")]
    assert [r.name for r in wings.collect()] == ["w7"]


def test_upsert_takes_first_in_order(spark, base):
    new = drawers(spark, ("a", "w1", "auth", "facts", "v1", 1, False), ("a", "w1", "auth", "facts", "v2", 0, False), ("n", "w", "r", "facts", "n", 0, False))
    merged = {r.id: r.content for r in st.upsert(base, new, ["id"], [F.col("ts").desc()]).collect()}
    assert merged["a"] == "v2" and merged["n"] == "n" and len(merged) == 6


def test_links(spark, base):
    tunnels = spark.createDataFrame([("auth", "w1", "w2", when(0)), ("auth", "w1", "w2", when(1))], TUNNEL)
    edges = gr.edges(tunnels)
    assert edges.count() == 2
    assert [r.neighbour for r in gr.neighbours(edges, "auth").collect()] == ["w2"]
    assert [r.neighbour for r in gr.neighbours(edges, "w2").collect()] == ["auth"]
    none = spark.createDataFrame([], TUNNEL)
    assert [(r.room, r.wings) for r in gr.suggestion_lists(gr.suggest_links(gr.all_rooms(base), none)).collect()] == [("auth", ["w1", "w2"])]
    assert gr.suggest_links(gr.all_rooms(base), tunnels).count() == 0
    assert st.add_tunnels(tunnels, tunnels, AS_OF).count() == 4


def test_suggestions_of_a_very_wide_room_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(gr, "_WINGS_PER_ROW", 10)
    rooms = spark.createDataFrame([("hot", f"w{i}") for i in range(200)] + [("one", "w1")], "room string, wing string")
    rows = gr.suggestion_lists(gr.suggest_links(rooms, spark.createDataFrame([], TUNNEL))).collect()
    assert len(rows) > 1 and sorted(w for r in rows for w in r.wings) == sorted(f"w{i}" for i in range(200))


def test_audit(spark, base):
    closets = spark.createDataFrame([("w1", "auth", "facts", "c", when(0))], CLOSET)
    tunnels = spark.createDataFrame([("auth", "w1", "w2", when(0))], TUNNEL)
    triples = spark.createDataFrame([(1, None), (2, when(0))], "id long, valid_from timestamp")
    metrics = au.audit(base, closets, tunnels, triples, AS_OF)
    assert {r.metric: r.value for r in metrics.collect()} == {
        "orphaned_drawers": 1, "rooms_no_closet": 3, "inactive_wings": 1, "rooms_without_tunnel": 3, "pinned_count": 1,
        "total_drawers": 5, "total_rooms": 4, "total_wings": 2, "kg_missing_valid_from": 1}
    stale = au.inactive_wings(base, AS_OF)
    assert [(r.wing, r.days) for r in stale.collect()] == [("w2", 100)]
    lines = [r.line for r in au.report_text(metrics, stale).collect()]
    assert lines[0] == "Orphaned drawers (unknown hall): 1" and lines[-1] == "  → w2" and len(lines) == 10


def test_closets_and_context(spark, base):
    closets = su.build_closets(base, AS_OF)
    assert {(r.wing, r.room, r.hall): r.content for r in closets.collect()}[("w1", "auth", "facts")] == "first fact"
    missing = su.fill_missing_closets(base, closets.where("room = 'auth'"), AS_OF)
    assert {(r.wing, r.room) for r in missing.collect()} == {("w1", "db"), ("w2", "ui")}
    facts = {r.wing: (r.n, r.content) for r in co.critical_facts(base, AS_OF).collect()}
    assert facts == {"w1": (2, "pinned fact\nfirst fact"), "w2": (0, "No critical facts available.")}
    assert {r.n for r in co.critical_facts(base, AS_OF, n=1).collect()} == {0, 1}
    woken = {r.wing: r for r in co.wake_up(base, AS_OF, " Me ").collect()}
    assert woken["w1"].context == "[L0:identity]\nMe\n\n[L1:facts]\npinned fact\nfirst fact" and woken["w1"].words == 7
    assert co.wake_up(base, AS_OF, None).first().context.startswith("[L0] No identity set.")
    blocks = {(r.wing, r.room): r.block for r in co.room_recall(gr.all_rooms(base), closets).collect()}
    assert blocks[("w1", "auth")] == "[L2:room=w1/auth]\n  [facts] first fact\n  [events] an event & m|e"
    assert blocks[("w2", "auth")].endswith(co.NO_CLOSETS)
    raw = {(r.wing, r.room): r.block for r in co.room_raw(base).collect()}
    assert raw[("w2", "ui")] == "[L2:room=w2/ui:raw]\n  [advice] " + "x" * 300


def test_deep_search_without_hits(spark):
    queries = spark.createDataFrame([(1, "q")], "query_id int, query string")
    none = spark.createDataFrame([], "query_id int, wing string, room string, hall string, rank int, final_score double, text string")
    assert co.deep_search_block(queries, none).first().block == "[L3:search='q']\n  No results found."


def test_replay(spark, base):
    rows = re.replay_rows(base).where("wing = 'w1' AND room = 'auth'").orderBy("seq").collect()
    assert [(r.seq, r.id) for r in rows] == [(1, "a"), (2, "b")]
    story = {(r.wing, r.room): r.story for r in re.replay_text(base).collect()}
    assert story[("w1", "auth")].splitlines()[1:3] == ["Room: auth  Wing: w1", "  2 memories  |  from 2026-01-15 00:00 to 2026-01-17 00:00"]
    assert "📌" in story[("w1", "db")]
    assert "  " + "x" * 297 + "...\n" in story[("w2", "ui")] and "unknown" in story[("w2", "ui")]
    assert re.replay_rows(base, limit=1).where("room = 'auth'").count() == 2


def test_diary_append(spark, tmp_path):
    path = str(tmp_path / "diary")
    for text in ("the first", "the second"):
        entry = spark.createDataFrame([("bot", text)], "agent string, content string")
        tb.append_rows(di.new_entries(entry, AS_OF), path)
    assert sorted(r.content for r in spark.read.parquet(path).collect()) == ["first", "second"]


def test_diary(spark):
    empty = spark.createDataFrame([], AGENT)
    agents = di.save_profiles(empty, spark.createDataFrame([("bot", "review", None)], "name string, focus string, model_hint string"), AS_OF)
    assert agents.first().diary_path == "bot_diary.jsonl"
    log = spark.createDataFrame([("bot", f"e{i}", when(10 - i), []) for i in range(8)] + [("other", "x", when(0), [])], DIARY)
    assert [r.content for r in di.read_last(log, 3).where("agent = 'bot'").orderBy("seq").collect()] == ["e5", "e6", "e7"]
    blocks = {r.agent: r.block for r in di.context_block(log, agents, 2).collect()}
    assert blocks["bot"] == "[agent:bot|focus:review]\n  [2026-01-16T00:00] e6\n  [2026-01-17T00:00] e7"
    assert blocks["other"].startswith("[agent:other|focus:]")
    written = di.new_entries(spark.createDataFrame([("bot", "the database", None)], "agent string, content string, tags array<string>"), AS_OF)
    assert (written.first().content, written.first().tags) == ("db", [])
    assert di.readable(written).first().content == "database"
    assert {r.agent for r in di.clear(log, spark.createDataFrame([("bot",)], "agent string")).collect()} == {"other"}
    assert [r.name for r in di.list_agents(agents).collect()] == ["bot"]


def test_changing_table(spark, base, tmp_path):
    path = str(tmp_path / "t")
    tb.save_table(base, path, ["wing", "hall"])
    assert tb.read_current(spark, path, ["id"]).count() == 5
    newer = base.where("id IN ('a', 'b')").withColumn("content", F.lit("v2"))
    for _ in range(2):  # a repeated change set replaces itself
        tb.write_change(newer, path, "s-1", F.lit(2))
    tb.write_change(base.where("id = 'a'").withColumn("content", F.lit("late but older")), path, "s-2", F.lit(1))
    tb.write_change(base.where("id = 'c'"), path, "s-3", F.lit(3), deleted=F.lit(True))
    state = {r.id: r.content for r in tb.read_current(spark, path, ["id"]).collect()}
    assert state["a"] == state["b"] == "v2" and "c" not in state and len(state) == 4
    tb.compact(spark, path, str(tmp_path / "t2"), ["id"], ["wing", "hall"])
    assert {r.id: r.content for r in tb.read_current(spark, str(tmp_path / "t2"), ["id"]).collect()} == state
    with pytest.raises(ValueError):
        tb.compact(spark, path, path, ["id"])


def test_location_filter_prunes_partitions(spark, base, tmp_path):
    tb.save_table(base, str(tmp_path / "t"), ["wing", "hall"])
    found = st.scan_drawers(tb.read_current(spark, str(tmp_path / "t"), ["id"]), wing="w1", hall="facts")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(wing" in plan
    assert found.count() == 2


def test_partition_values_keep_their_type_and_old_changes_never_show(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("1", "007", "a"), ("2", "010", "b"), ("3", "", "c")], "id string, wing string, content string")
    declared = T.StructType([T.StructField(c, T.StringType(), False) for c in ("id", "wing", "content")])
    tb.save_table(rows, path, ["wing"])
    assert sorted(map(tuple, tb.read_current(spark, path, ["id"], declared).select("id", "wing").collect())) == [
        ("1", "007"), ("2", "010"), ("3", "")]
    tb.write_change(rows.where("id = '3'").withColumn("content", F.lit("new")), path, "7", F.lit(1))
    current = tb.read_current(spark, path, ["id"], declared)
    assert sorted(map(tuple, current.select("id", "wing", "content").collect())) == [("1", "007", "a"), ("2", "010", "b"), ("3", "", "new")]
    with pytest.raises(ValueError, match="change sets"):
        tb.save_table(rows, path, ["wing"])


@pytest.mark.parametrize("n", [1, 7, 1500])
def test_top_n_of_a_hot_group_matches_sorting(spark, n):
    rows = [("hot" if i % 9 else f"k{i % 4}", i, (i * 37) % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id int, v int")
    got = rk.top_n(df, ["k"], [F.col("v").desc(), F.col("id")], n).collect()
    expected = set()
    for key in {k for k, _, _ in rows}:
        best = sorted((-v, i) for k, i, v in rows if k == key)[:n]
        expected |= {(key, i, -v, r) for r, (v, i) in enumerate(best, 1)}
    assert {(r.k, r.id, r.v, r["rank"]) for r in got} == expected
    assert len(got) == len(expected)
