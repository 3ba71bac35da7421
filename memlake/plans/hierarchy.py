"""Queries over the memory hierarchy and the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import graph as gr
from memlake.operators import store as st
from memlake.plans import fixtures as fx
from memlake.plans.oracles import over
from memlake.plans.registry import query


def _wing_records(spark, sf_dir):
    """Records for the wings that own tunnels; the others are known from their drawers only."""
    return fx.tunnels(spark, sf_dir).select(F.col("target_wing").alias("name")).distinct().select(
        "name", F.lit(fx.BASE).cast("timestamp_ntz").alias("created"), F.lit("linked").alias("description")
    )


def _room_records(spark, sf_dir):
    return fx.closets(spark, sf_dir).select(F.col("room").alias("name"), "wing").distinct().select(
        "name", "wing", F.lit(fx.BASE).cast("timestamp_ntz").alias("created"), F.lit("summarised").alias("description")
    )


@query("memory_stats", over("drawers closets", """
SELECT count(DISTINCT wing) AS wings, count(DISTINCT concat(wing, '/', room)) AS rooms,
  count(*) FILTER (hall IN ('facts','events','discoveries','preferences','advice')) AS drawers,
  (SELECT count(*) FROM fx_closets) AS closets FROM fx_drawers"""))
def memory_stats(spark, sf_dir):
    return st.stats(fx.drawers(spark, sf_dir), fx.closets(spark, sf_dir))


@query("list_wings", over("drawers tunnels", """
SELECT coalesce(d.name, m.name) AS name, m.created, m.description
FROM (SELECT DISTINCT wing AS name FROM fx_drawers) d FULL JOIN
  (SELECT DISTINCT target_wing AS name, TIMESTAMP '2023-08-01 00:00:00' AS created, 'linked' AS description FROM fx_tunnels) m
  ON d.name = m.name"""))
def list_wings(spark, sf_dir):
    return st.list_wings(fx.drawers(spark, sf_dir), _wing_records(spark, sf_dir))


@query("list_rooms", over("drawers closets", """
SELECT d.wing, d.room AS name, m.created, m.description FROM (SELECT DISTINCT wing, room FROM fx_drawers) d LEFT JOIN
  (SELECT DISTINCT wing, room, TIMESTAMP '2023-08-01 00:00:00' AS created, 'summarised' AS description FROM fx_closets) m
  USING (wing, room)"""))
def list_rooms(spark, sf_dir):
    return st.list_rooms(fx.drawers(spark, sf_dir), _room_records(spark, sf_dir))


@query("drawer_scan", over("drawers", """
SELECT id, wing, room, hall, ts, pinned, date_diff('microsecond', ts, TIMESTAMP '2024-01-20 00:00:00') / 86400000000.0 AS age_days
FROM fx_drawers WHERE wing = 'w3' AND hall = 'facts'"""))
def drawer_scan(spark, sf_dir):
    found = st.scan_drawers(fx.drawers(spark, sf_dir), wing="w3", hall="facts")
    return st.with_age(found, fx.AS_OF).select("id", "wing", "room", "hall", "ts", "pinned", "age_days")


@query("drawer_lookup", over("drawers closets", """
SELECT id, wing, room, hall, content FROM fx_drawers WHERE content IN (SELECT content FROM fx_closets)"""))
def drawer_lookup(spark, sf_dir):
    """Batch point lookup: the drawers whose text became a closet."""
    drawers = fx.drawers(spark, sf_dir)
    ids = drawers.join(fx.closets(spark, sf_dir).select("content"), "content", "left_semi").select("id")
    return st.get_by_id(drawers, ids).select("id", "wing", "room", "hall", "content")


@query("pin_and_delete", over("drawers", """
SELECT id, wing, room, hall, pinned OR role = 'system' AS pinned FROM fx_drawers WHERE hall <> 'misc'"""))
def pin_and_delete(spark, sf_dir):
    """Pin what the system said, delete the drawers filed under an unknown hall."""
    drawers = fx.drawers(spark, sf_dir)
    pinned = st.pin(drawers, drawers.where(F.col("role") == "system"))
    orphans = st.invalid_halls(drawers).select(*st.DRAWER_KEY)
    return st.delete(pinned, orphans).select("id", "wing", "room", "hall", "pinned")


@query("drawer_upsert", over("drawers", """
SELECT id, wing, room, hall, CASE WHEN role = 'assistant' THEN concat('edited: ', content) ELSE content END AS content FROM fx_drawers
UNION ALL SELECT concat('n', id), wing, room, hall, concat('edited: ', content) FROM fx_drawers WHERE role = 'system'"""))
def drawer_upsert(spark, sf_dir):
    """Replace what the assistant said and add one new drawer per system message; every change arrives twice."""
    drawers = fx.drawers(spark, sf_dir)
    changed = drawers.where(F.col("role").isin("assistant", "system")).withColumn(
        "id", F.when(F.col("role") == "system", F.concat(F.lit("n"), "id")).otherwise(F.col("id"))
    )
    newer = changed.withColumn("content", F.concat(F.lit("edited: "), "content")).withColumn("version", F.lit(2))
    older = changed.withColumn("version", F.lit(1))
    merged = st.upsert(drawers, newer.unionByName(older), ["id"], [F.col("version").desc()])
    return merged.select("id", "wing", "room", "hall", "content")


@query("insert_if_absent", over("drawers closets tunnels", f"""
WITH have AS (SELECT DISTINCT wing, room AS name, 'summarised' AS description FROM fx_closets),
want AS (SELECT DISTINCT wing, room AS name FROM fx_drawers)
SELECT wing, name, description FROM have
UNION ALL SELECT wing, name, '' FROM want w WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.wing = w.wing AND h.name = w.name)"""))
def insert_if_absent(spark, sf_dir):
    wanted = fx.drawers(spark, sf_dir).select("wing", F.col("room").alias("name"))
    rooms, _ = st.ensure_rooms(_room_records(spark, sf_dir), _wing_records(spark, sf_dir), wanted, fx.AS_OF)
    return rooms.select("wing", "name", "description")


@query("halls_of_rooms", over("rooms", """
SELECT r.wing, r.room, h.hall, h.hall_no FROM fx_rooms r, (VALUES ('facts', 0), ('events', 1), ('discoveries', 2),
  ('preferences', 3), ('advice', 4)) h(hall, hall_no)"""))
def halls_of_rooms(spark, sf_dir):
    return st.halls_of(gr.all_rooms(fx.drawers(spark, sf_dir)).withColumnRenamed("room", "name"))


@query("invalid_halls", over("drawers", "SELECT id, hall FROM fx_drawers WHERE hall = 'misc'"))
def invalid_halls(spark, sf_dir):
    return st.invalid_halls(fx.drawers(spark, sf_dir)).select("id", "hall")


@query("closet_lookup", over("closets drawers", """
SELECT * FROM fx_closets c WHERE EXISTS (SELECT 1 FROM fx_drawers d WHERE d.pinned AND d.wing = c.wing AND d.room = c.room AND d.hall = c.hall)"""))
def closet_lookup(spark, sf_dir):
    keys = fx.drawers(spark, sf_dir).where("pinned").select("wing", "room", "hall")
    return st.get_closets(fx.closets(spark, sf_dir), keys)


@query("tunnels_add", over("tunnels", """
SELECT room, source_wing, target_wing FROM fx_tunnels UNION SELECT room, target_wing, source_wing FROM fx_tunnels"""))
def tunnels_add(spark, sf_dir):
    """Add the way back for every tunnel, twice; existing and repeated ones stay single."""
    tunnels = fx.tunnels(spark, sf_dir).withColumn("created", F.lit(fx.BASE).cast("timestamp"))
    back = tunnels.select("room", F.col("target_wing").alias("source_wing"), F.col("source_wing").alias("target_wing"))
    grown = st.add_tunnels(tunnels, back.unionByName(back), fx.AS_OF, dedup=True)
    return grown.select("room", "source_wing", "target_wing")


@query("tunnels_of_wing", over("tunnels", "SELECT * FROM fx_tunnels WHERE source_wing = 'w2'"))
def tunnels_of_wing(spark, sf_dir):
    return st.list_tunnels(fx.tunnels(spark, sf_dir), "w2")


@query("graph_neighbours", over("tunnels rooms", """
SELECT DISTINCT room AS node, 'room' AS node_kind, target_wing AS neighbour, 'wing' AS neighbour_kind FROM fx_tunnels
UNION SELECT DISTINCT target_wing, 'wing', room, 'room' FROM fx_tunnels WHERE target_wing IN (SELECT wing FROM fx_rooms)"""))
def graph_neighbours(spark, sf_dir):
    rooms = gr.all_rooms(fx.drawers(spark, sf_dir))
    nodes = rooms.select(F.explode(F.array("wing", "room")).alias("node"))
    return gr.neighbours_many(gr.edges(fx.tunnels(spark, sf_dir)), nodes)


@query("graph_suggest_links", over("rooms tunnels", """
SELECT room, count(*) AS n_wings, cast(0 AS bigint) AS piece, string_agg(wing, ',' ORDER BY wing) AS wings FROM fx_rooms
WHERE room NOT IN (SELECT room FROM fx_tunnels) GROUP BY room HAVING count(*) >= 2"""))
def graph_suggest_links(spark, sf_dir):
    rooms = gr.all_rooms(fx.drawers(spark, sf_dir))
    listed = gr.suggestion_lists(gr.suggest_links(rooms, fx.tunnels(spark, sf_dir)))
    return listed.withColumn("wings", F.array_join("wings", ","))


@query("closet_upsert", over("drawers closets", """
WITH fresh AS (SELECT wing, room, hall, concat('latest: ', max(content)) AS content, TIMESTAMP '2024-01-20 00:00:00' AS updated
  FROM fx_drawers WHERE pinned GROUP BY ALL)
SELECT * FROM fresh UNION ALL SELECT c.wing, c.room, c.hall, c.content, c.updated FROM fx_closets c ANTI JOIN fresh USING (wing, room, hall)"""))
def closet_upsert(spark, sf_dir):
    """New closets for the places with pinned drawers replace the old ones."""
    fresh = fx.drawers(spark, sf_dir).where("pinned").groupBy("wing", "room", "hall").agg(
        F.concat(F.lit("latest: "), F.max("content")).alias("content"), F.lit(fx.AS_OF).cast("timestamp_ntz").alias("updated")
    )
    return st.upsert(fx.closets(spark, sf_dir), fresh, ["wing", "room", "hall"])


@query("vector_upsert_delete", over("vectors", """
SELECT id, CASE WHEN pinned THEN 'moved' ELSE wing END AS wing, room, hall, pinned, round(embedding[1], 6) AS first_value,
  (SELECT count(*) FROM fx_vectors WHERE hall <> 'advice') AS total
FROM fx_vectors WHERE hall <> 'advice'"""))
def vector_upsert_delete(spark, sf_dir):
    """Move the pinned vectors to another wing, delete those of one hall, count the rest."""
    vectors = fx.vectors(spark, sf_dir)
    moved = st.upsert(vectors, vectors.where("pinned").withColumn("wing", F.lit("moved")), ["id"])
    kept = st.delete(moved, vectors.where(F.col("hall") == "advice").select("id"))
    return kept.select(
        "id", "wing", "room", "hall", "pinned", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"),
        kept.agg(F.count("*")).scalar().alias("total"),
    )


@query("wings_create", over("drawers tunnels", """
WITH have AS (SELECT DISTINCT target_wing AS name, 'linked' AS description FROM fx_tunnels),
named AS (SELECT wing AS name, concat('holds ', max(room)) AS description FROM fx_drawers GROUP BY wing)
SELECT name, description FROM named UNION ALL SELECT name, description FROM have ANTI JOIN named USING (name)"""))
def wings_create(spark, sf_dir):
    """Create a record for every wing in use, replacing the ones that exist."""
    names = fx.drawers(spark, sf_dir).groupBy(F.col("wing").alias("name")).agg(
        F.concat(F.lit("holds "), F.max("room")).alias("description")
    )
    return st.create_wings(_wing_records(spark, sf_dir), names, fx.AS_OF).select("name", "description")
