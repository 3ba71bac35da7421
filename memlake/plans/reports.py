"""Closets, context blocks, replays, audits and diaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions.shorthand import compress
from memlake.operators import audit as au
from memlake.operators import context as co
from memlake.operators import diary as di
from memlake.operators import graph as gr
from memlake.operators import replay as rp
from memlake.operators import search as se
from memlake.operators import store as st
from memlake.operators import summaries as su
from memlake.operators.tables import append_rows
from memlake.plans import fixtures as fx
from memlake.plans.oracles import AS_OF, compressed, decompressed, over
from memlake.plans.recall import _ranked
from memlake.plans.registry import query
from memlake.schema import AGENT
from memlake.session import shared_folder

_KNOWN = "hall IN ('facts','events','discoveries','preferences','advice')"


def _closets(limit: int, where: str = "true") -> str:
    return f"""
WITH first AS (SELECT wing, room, hall, id, content FROM fx_drawers WHERE {_KNOWN} AND {where}
  QUALIFY row_number() OVER (PARTITION BY wing, room, hall ORDER BY id) <= {limit}),
joined AS (SELECT wing, room, hall, string_agg(content, chr(10) ORDER BY id) AS content FROM first GROUP BY ALL)
SELECT wing, room, hall, {compressed('content')} AS content FROM joined"""


@query("closets_rebuild", over("drawers", _closets(20)))
def closets_rebuild(spark, sf_dir):
    return su.build_closets(fx.drawers(spark, sf_dir), fx.AS_OF).drop("updated")


@query("closets_fill_missing", over("drawers closets", _closets(
    10, "NOT EXISTS (SELECT 1 FROM fx_closets c WHERE c.wing = fx_drawers.wing AND c.room = fx_drawers.room)")))
def closets_fill_missing(spark, sf_dir):
    return su.fill_missing_closets(fx.drawers(spark, sf_dir), fx.closets(spark, sf_dir), fx.AS_OF).drop("updated")


_L1 = f"""
WITH chosen AS (SELECT wing, content, row_number() OVER (PARTITION BY wing ORDER BY pinned DESC, ts DESC, id) AS r FROM fx_drawers
  WHERE hall = 'facts' AND (pinned OR date_diff('microsecond', ts, {AS_OF}) / 86400000000.0 < 30) QUALIFY r <= 20),
joined AS (SELECT wing, count(*) AS n, string_agg(content, chr(10) ORDER BY r) AS content FROM chosen GROUP BY wing),
block AS (SELECT w.wing, coalesce(n, 0) AS n, coalesce({compressed('content')}, 'No critical facts available.') AS content
  FROM (SELECT DISTINCT wing FROM fx_drawers) w LEFT JOIN joined USING (wing))"""


@query("l1_facts", over("drawers", f"{_L1} SELECT * FROM block"))
def l1_facts(spark, sf_dir):
    return co.critical_facts(fx.drawers(spark, sf_dir), fx.AS_OF)


@query("wake_up", over("drawers", f"""{_L1}
SELECT wing, concat('[L0:identity]', chr(10), 'I keep notes.', chr(10), chr(10), '[L1:facts]', chr(10), content) AS context FROM block"""))
def wake_up(spark, sf_dir):
    return co.wake_up(fx.drawers(spark, sf_dir), fx.AS_OF, "I keep notes.").drop("words")


_ALL_L1 = f"""
WITH chosen AS (SELECT content, row_number() OVER (ORDER BY pinned DESC, ts DESC, id) AS r FROM fx_drawers
  WHERE hall = 'facts' AND (pinned OR date_diff('microsecond', ts, {AS_OF}) / 86400000000.0 < 30) QUALIFY r <= 20),
joined AS (SELECT count(*) AS n, string_agg(content, chr(10) ORDER BY r) AS content FROM chosen),
block AS (SELECT n, CASE WHEN n = 0 THEN 'No critical facts available.' ELSE {compressed('content')} END AS content FROM joined)"""


@query("wake_up_all", over("drawers", rf"""{_ALL_L1}
SELECT *, cast(len(string_split_regex(context, '\s+')) AS int) AS words FROM (SELECT concat('[L0:identity]', chr(10), 'I keep notes.', chr(10), chr(10), '[L1:facts]', chr(10),
  regexp_replace(content, '^\s+|\s+$', '', 'g')) AS context FROM block)"""))
def wake_up_all(spark, sf_dir):
    return co.wake_up_all(fx.drawers(spark, sf_dir), fx.AS_OF, "I keep notes.")


@query("l1_facts_all", over("drawers", f"""{_ALL_L1} SELECT * FROM block"""))
def l1_facts_all(spark, sf_dir):
    return co.critical_facts_all(fx.drawers(spark, sf_dir), fx.AS_OF)


@query("room_recall", over("rooms closets", r"""
WITH lines AS (SELECT wing, room, string_agg(concat('  [', hall, '] ', regexp_replace(content, '^\s+|\s+$', '', 'g')), chr(10)
  ORDER BY list_position(['facts','events','discoveries','preferences','advice'], hall)) AS l
  FROM fx_closets WHERE regexp_matches(content, '\S') GROUP BY wing, room)
SELECT wing, room, concat('[L2:room=', wing, '/', room, ']', chr(10),
  coalesce(l, '  (no closet content — build the closets first)')) AS block FROM fx_rooms LEFT JOIN lines USING (wing, room)"""))
def room_recall(spark, sf_dir):
    return co.room_recall(gr.all_rooms(fx.drawers(spark, sf_dir)), fx.closets(spark, sf_dir))


@query("room_raw", over("drawers", """
SELECT wing, room, concat('[L2:room=', wing, '/', room, ':raw]', chr(10),
  string_agg(concat('  [', hall, '] ', substr(content, 1, 300)), chr(10) ORDER BY r)) AS block
FROM (SELECT *, row_number() OVER (PARTITION BY wing, room ORDER BY ts DESC, id) AS r FROM fx_drawers QUALIFY r <= 10)
GROUP BY wing, room"""))
def room_raw(spark, sf_dir):
    return co.room_raw(fx.drawers(spark, sf_dir))


@query("deep_search_block", over("vectors queries", f"""
WITH hits AS ({_ranked(15)}),
scored AS (SELECT *, round(sem * (1.0 + cast(CASE WHEN pinned THEN 0.0 ELSE 0.005 * greatest(0.0, 90.0 -
  greatest(0.0, epoch_us({AS_OF}) / 86400000000.0 - epoch_us(ts) / 86400000000.0)) END AS double)), 4) AS final_score FROM hits),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, sem DESC, id) AS r FROM scored QUALIFY r <= 5)
SELECT query_id, concat('[L3:search=''topic ', query_id, ''']', chr(10), string_agg(concat('  [', r, '|', wing, '/', room, '/', hall,
  '|score=', printf('%.3f', final_score), '] memory ', id), chr(10) ORDER BY r)) AS block FROM best GROUP BY query_id"""))
def deep_search_block(spark, sf_dir):
    vectors = fx.vectors(spark, sf_dir).withColumn("text", F.concat(F.lit("memory "), "id")).withColumn(
        "metadata", F.create_map(F.lit("source"), F.lit("embeddings"))
    )
    queries = fx.topic_queries(spark, sf_dir)
    named = queries.select("query_id", F.concat(F.lit("topic "), F.col("query_id").cast("string")).alias("query"))
    hits = se.with_text(se.search(vectors, queries, fx.AS_OF, n=co.DEEP_HITS), vectors)
    return co.deep_search_block(named, hits)


@query("replay_rows", over("drawers", f"""
SELECT wing, room, id, ts, hall, {decompressed('content')} AS content, pinned, seq FROM (
  SELECT *, cast(row_number() OVER (PARTITION BY wing, room ORDER BY ts, id) AS int) AS seq FROM fx_drawers QUALIFY seq <= 100)"""))
def replay_rows(spark, sf_dir):
    return rp.replay_rows(fx.drawers(spark, sf_dir))


def _story(keys: str, title: str) -> str:
    return over("drawers", f"""
WITH r AS (SELECT *, {decompressed('content')} AS full_text, row_number() OVER (PARTITION BY {keys} ORDER BY ts, id) AS seq
  FROM fx_drawers QUALIFY seq <= 100),
e AS (SELECT *, concat('[', strftime(ts, '%Y-%m-%d %H:%M'), '] [', upper(hall), ']', CASE WHEN pinned THEN ' 📌' ELSE '' END, chr(10), '  ',
  CASE WHEN length(full_text) > 300 THEN concat(substr(full_text, 1, 297), '...') ELSE full_text END, chr(10)) AS entry FROM r)
SELECT {keys}, concat(repeat('=', 60), chr(10), {title}, chr(10), '  ', count(*), ' memories  |  from ',
  strftime(min(ts), '%Y-%m-%d %H:%M'), ' to ', strftime(max(ts), '%Y-%m-%d %H:%M'), chr(10), repeat('=', 60), chr(10), chr(10),
  string_agg(entry, chr(10) ORDER BY seq)) AS story FROM e GROUP BY {keys}""")


@query("replay_text", _story("wing, room", "'Room: ', room, '  Wing: ', wing"))
def replay_text(spark, sf_dir):
    return rp.replay_text(fx.drawers(spark, sf_dir))


@query("replay_text_by_room", _story("room", "'Room: ', room"))
def replay_text_by_room(spark, sf_dir):
    return rp.replay_text(fx.drawers(spark, sf_dir), keys=("room",))


_AUDIT_SQL = f"""
SELECT 'orphaned_drawers' AS metric, (SELECT count(*) FROM fx_drawers WHERE NOT ({_KNOWN})) AS value
UNION ALL SELECT 'rooms_no_closet', (SELECT count(*) FROM fx_rooms r WHERE NOT EXISTS (SELECT 1 FROM fx_closets c WHERE c.wing = r.wing AND c.room = r.room))
UNION ALL SELECT 'inactive_wings', (SELECT count(*) FROM (SELECT wing FROM fx_drawers GROUP BY wing HAVING floor(date_diff('microsecond', max(ts), {AS_OF}) / 86400000000.0) > 90))
UNION ALL SELECT 'rooms_without_tunnel', (SELECT count(*) FROM fx_rooms r WHERE NOT EXISTS (SELECT 1 FROM fx_tunnels t WHERE t.source_wing = r.wing AND t.room = r.room))
UNION ALL SELECT 'pinned_count', (SELECT count(*) FROM fx_drawers WHERE pinned)
UNION ALL SELECT 'total_drawers', (SELECT count(*) FROM fx_drawers)
UNION ALL SELECT 'total_rooms', (SELECT count(*) FROM fx_rooms)
UNION ALL SELECT 'total_wings', (SELECT count(DISTINCT wing) FROM fx_drawers)
UNION ALL SELECT 'kg_missing_valid_from', (SELECT count(*) FROM fx_triples WHERE valid_from IS NULL)"""


@query("audit_metrics", over("drawers rooms closets tunnels triples", _AUDIT_SQL))
def audit_metrics(spark, sf_dir):
    return au.audit(fx.drawers(spark, sf_dir), fx.closets(spark, sf_dir), fx.tunnels(spark, sf_dir),
                    fx.triples(spark, sf_dir), fx.AS_OF)


def _records(spark, sf_dir):
    """Records of wings and rooms, some of which have no drawers: an attic in every second wing, and a planned wing for each."""
    used = fx.drawers(spark, sf_dir).select("wing").distinct()
    wings = used.select(F.concat("wing", F.lit("-planned")).alias("name")).unionByName(used.select(F.col("wing").alias("name")))
    attic = used.where(F.substring("wing", 2, 9).cast("int") % 2 == 0).select("wing", F.lit("attic").alias("name"))
    return wings, attic.unionByName(gr.all_rooms(fx.drawers(spark, sf_dir)).withColumnRenamed("room", "name"))


_ATTICS = "(SELECT count(DISTINCT wing) FROM fx_drawers WHERE cast(substr(wing, 2) AS int) % 2 = 0)"


@query("audit_with_records", over("drawers rooms closets tunnels triples", f"""
SELECT metric, value + CASE WHEN metric IN ('rooms_no_closet', 'rooms_without_tunnel', 'total_rooms') THEN {_ATTICS}
  WHEN metric = 'total_wings' THEN (SELECT count(DISTINCT wing) FROM fx_drawers) ELSE 0 END AS value FROM ({_AUDIT_SQL})"""))
def audit_with_records(spark, sf_dir):
    wings, rooms = _records(spark, sf_dir)
    return au.audit(fx.drawers(spark, sf_dir), fx.closets(spark, sf_dir), fx.tunnels(spark, sf_dir), fx.triples(spark, sf_dir), fx.AS_OF, wings=wings, rooms=rooms)


@query("stats_with_records", over("drawers rooms closets", f"""
SELECT 2 * count(DISTINCT wing) AS wings, count(DISTINCT concat(wing, '/', room)) + {_ATTICS} AS rooms, count(*) FILTER ({_KNOWN}) AS drawers,
  (SELECT count(*) FROM fx_closets) AS closets FROM fx_drawers"""))
def stats_with_records(spark, sf_dir):
    wings, rooms = _records(spark, sf_dir)
    return st.stats(fx.drawers(spark, sf_dir), fx.closets(spark, sf_dir), wings, rooms)


@query("rooms_fixed", over("rooms closets drawers", f"""
SELECT {_ATTICS} + (SELECT count(*) FROM (SELECT wing, room FROM fx_rooms EXCEPT SELECT wing, room FROM fx_closets)) AS fixed"""))
def rooms_fixed(spark, sf_dir):
    _, rooms = _records(spark, sf_dir)
    return su.fixed_rooms(gr.all_rooms(fx.drawers(spark, sf_dir), rooms), fx.closets(spark, sf_dir))


@query("replay_of_hall", over("drawers", f"""
WITH r AS (SELECT *, {decompressed('content')} AS full_text, CASE WHEN pinned THEN 'about 2023, mayb' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS shown,
    row_number() OVER (PARTITION BY wing, room ORDER BY CASE WHEN pinned THEN NULL ELSE ts END NULLS FIRST, id) AS seq FROM fx_drawers WHERE hall = 'facts' QUALIFY seq <= 100),
e AS (SELECT *, concat('[', shown, '] [FACTS]', CASE WHEN pinned THEN ' 📌' ELSE '' END, chr(10), '  ',
  CASE WHEN length(full_text) > 300 THEN concat(substr(full_text, 1, 297), '...') ELSE full_text END, chr(10)) AS entry FROM r),
s AS (SELECT wing, room, concat(repeat('=', 60), chr(10), 'Room: ', room, '  Wing: ', wing, chr(10), '  ', count(*), ' memories  |  from ', arg_min(shown, seq), ' to ',
  arg_max(shown, seq), chr(10), repeat('=', 60), chr(10), chr(10), string_agg(entry, chr(10) ORDER BY seq)) AS story FROM e GROUP BY wing, room)
SELECT wing, room, story FROM s
UNION ALL SELECT wing, room, concat('No memories found for room ', chr(39), room, chr(39), ' in wing ', chr(39), wing, chr(39), '.') FROM (
  SELECT DISTINCT wing, 'attic' AS room FROM fx_drawers UNION SELECT DISTINCT wing, room FROM fx_drawers) ANTI JOIN s USING (wing, room)"""))
def replay_of_hall(spark, sf_dir):
    """One hall of every room; pinned drawers have times that can't be read, and every wing is asked for a room that it hasn't."""
    drawers = fx.drawers(spark, sf_dir)
    unclear = drawers.withColumn("said", F.when(F.col("pinned"), F.lit("about 2023, maybe")).otherwise(F.col("ts").cast("string"))).withColumn(
        "ts", F.when(~F.col("pinned"), F.col("ts")))
    asked = gr.all_rooms(drawers).unionByName(drawers.select("wing").distinct().select("wing", F.lit("attic").alias("room")))
    return rp.replay_text(unclear, hall="facts", raw_time="said", asked=asked)


@query("diary_append", over("diary", f"""
SELECT agent, md5({compressed('content')}) AS digest, 2 AS copies FROM fx_diary WHERE agent = 'user' UNION ALL
SELECT agent, md5({compressed('content')}), 1 FROM fx_diary WHERE agent <> 'user'"""))
def diary_append(spark, sf_dir):
    """Every message appended to a stored diary, those of one agent twice."""
    path = f"{shared_folder(spark)}/diary"
    diary = fx.diary(spark, sf_dir)
    entries = di.new_entries(diary.select("agent", "content", F.array("id").alias("tags")), fx.AS_OF)
    append_rows(entries, path)
    append_rows(entries.where(F.col("agent") == "user"), path)
    stored = spark.read.parquet(path).groupBy("agent", "tags", "content").agg(F.count("*").cast("int").alias("copies"))
    return stored.select("agent", F.md5("content").alias("digest"), "copies")


@query("inactive_wings", over("drawers", f"""
SELECT wing, max(ts) AS last_activity, cast(floor(date_diff('microsecond', max(ts), {AS_OF}) / 86400000000.0) AS bigint) AS days
FROM fx_drawers GROUP BY wing HAVING days > 90"""))
def inactive_wings(spark, sf_dir):
    return au.inactive_wings(fx.drawers(spark, sf_dir), fx.AS_OF)


@query("orphaned_drawers", over("drawers", f"SELECT id, wing, room, hall FROM fx_drawers WHERE NOT ({_KNOWN})"))
def orphaned_drawers(spark, sf_dir):
    return au.orphaned_drawers(fx.drawers(spark, sf_dir))


@query("rooms_no_closet", over("rooms closets", """
SELECT wing, room FROM fx_rooms EXCEPT SELECT wing, room FROM fx_closets"""))
def rooms_no_closet(spark, sf_dir):
    return au.rooms_without_closet(gr.all_rooms(fx.drawers(spark, sf_dir)), fx.closets(spark, sf_dir))


@query("rooms_without_tunnel", over("rooms tunnels", """
SELECT wing, room FROM fx_rooms EXCEPT SELECT source_wing, room FROM fx_tunnels"""))
def rooms_without_tunnel(spark, sf_dir):
    return au.rooms_without_tunnel(gr.all_rooms(fx.drawers(spark, sf_dir)), fx.tunnels(spark, sf_dir))


@query("diary_last_n", over("diary", """
SELECT agent, id, ts, content, cast(row_number() OVER (PARTITION BY agent ORDER BY ts, id) AS int) AS seq FROM (
  SELECT * FROM fx_diary QUALIFY row_number() OVER (PARTITION BY agent ORDER BY ts DESC, id DESC) <= 10)"""))
def diary_last_n(spark, sf_dir):
    return di.read_last(fx.diary(spark, sf_dir), tie=F.col("id")).select("agent", "id", "ts", "content", "seq")


@query("diary_context", over("diary", """
SELECT agent, concat('[agent:', agent, '|focus:', CASE WHEN agent = 'user' THEN '' ELSE upper(agent) END, ']', chr(10),
  string_agg(concat('  [', strftime(ts, '%Y-%m-%dT%H:%M'), '] ', content), chr(10) ORDER BY ts, id)) AS block FROM (
  SELECT * FROM fx_diary QUALIFY row_number() OVER (PARTITION BY agent ORDER BY ts DESC, id DESC) <= 5) GROUP BY agent"""))
def diary_context(spark, sf_dir):
    diary = fx.diary(spark, sf_dir)
    agents = diary.where(F.col("agent") != "user").select(F.col("agent").alias("name")).distinct().select(
        "name", F.upper("name").alias("focus"), F.lit("").alias("model_hint"), F.lit(None).cast("timestamp").alias("created"),
        F.lit("").alias("diary_path"),
    )
    return di.context_block(diary, agents, tie=F.col("id"))


@query("diary_write_clear", over("diary", f"""
SELECT agent, {compressed('content')} AS content FROM fx_diary WHERE agent <> 'system'"""))
def diary_write_clear(spark, sf_dir):
    """Write every message as a diary entry, then clear the diary of one agent."""
    diary = fx.diary(spark, sf_dir)
    written = di.new_entries(diary.select("agent", "content"), fx.AS_OF)
    cleared = di.clear(written, diary.where(F.col("agent") == "system").select("agent").distinct())
    return cleared.select("agent", "content")


_AUDIT_TITLES = """VALUES ('orphaned_drawers', 0, 'Orphaned drawers (unknown hall)'), ('rooms_no_closet', 1, 'Rooms with no closet (uncompressed)'),
  ('inactive_wings', 2, 'Wings inactive > 90 days'), ('kg_missing_valid_from', 3, 'KG triples missing valid_from'),
  ('rooms_without_tunnel', 4, 'Rooms in only 1 wing (no tunnels)'), ('pinned_count', 5, 'Pinned memories'), ('total_wings', 6, 'Total wings'),
  ('total_rooms', 7, 'Total rooms'), ('total_drawers', 8, 'Total drawers')"""


@query("audit_report", over("drawers rooms closets tunnels triples", f"""
WITH m AS ({_AUDIT_SQL})
SELECT cast(t.n AS int) AS line_no, concat(t.title, ': ', m.value) AS line FROM m JOIN ({_AUDIT_TITLES}) t(metric, n, title) USING (metric)
UNION ALL SELECT 9, concat('  → ', wing) FROM fx_drawers GROUP BY wing HAVING floor(date_diff('microsecond', max(ts), {AS_OF}) / 86400000000.0) > 90"""))
def audit_report(spark, sf_dir):
    return au.report_text(audit_metrics(spark, sf_dir), inactive_wings(spark, sf_dir))


@query("agent_profiles", over("diary", """
SELECT agent AS name, CASE WHEN agent = 'system' THEN '' ELSE concat('focus of ', agent) END AS focus,
  CASE WHEN agent = 'system' THEN '' ELSE concat(agent, '_diary.jsonl') END AS diary_path FROM (SELECT DISTINCT agent FROM fx_diary)"""))
def agent_profiles(spark, sf_dir):
    """Profiles saved twice for all agents but one, then loaded for every agent."""
    names = fx.diary(spark, sf_dir).select(F.col("agent").alias("name")).distinct()
    blank = F.lit(None).cast("string")
    known = names.where(F.col("name") != "system").select("name", F.concat(F.lit("focus of "), "name").alias("focus"), blank.alias("model_hint"))
    none = spark.createDataFrame([], AGENT)
    agents = di.save_profiles(di.save_profiles(none, known.withColumn("focus", F.lit("old")), fx.AS_OF), known, fx.AS_OF)
    return di.load_profiles(agents, names).select("name", "focus", "diary_path")


@query("diary_readable", over("diary", f"""
SELECT id, {decompressed(compressed('content'))} AS content FROM fx_diary"""))
def diary_readable(spark, sf_dir):
    diary = fx.diary(spark, sf_dir)
    return di.readable(diary.withColumn("content", compress(F.col("content")))).select("id", "content")
