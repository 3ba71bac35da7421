"""Vector top-k and recency-weighted search."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions.vectors import digest_embedding
from memlake.operators import cells as ce
from memlake.operators import search as se
from memlake.operators import vectors as ve
from memlake.plans import fixtures as fx
from memlake.plans.oracles import AS_OF, over
from memlake.plans.registry import query

# Cosine with the same guard against zero norms as the operator.
_SCORE = """round(list_dot_product(v.embedding, q.embedding) / ((sqrt(list_dot_product(v.embedding, v.embedding)) + 1e-9)
  * (sqrt(list_dot_product(q.embedding, q.embedding)) + 1e-9)), 9)"""


def _ranked(k: int, where: str = "true", score: str = _SCORE) -> str:
    return f"""
SELECT query_id, id, wing, room, hall, ts, pinned, sem, cast(row_number() OVER (PARTITION BY query_id ORDER BY sem DESC, id) AS int) AS rank FROM (
  SELECT q.query_id, v.id, v.wing, v.room, v.hall, v.ts, v.pinned, {score} AS sem FROM fx_vectors v, fx_queries q WHERE {where})
QUALIFY rank <= {k}"""


def _search_sql(n: int, where: str = "true", no_decay: bool = False) -> str:
    boost = "0.0" if no_decay else f"""CASE WHEN pinned THEN 0.0 ELSE 0.005 * greatest(0.0, 90.0 -
      greatest(0.0, epoch_us({AS_OF}) / 86400000000.0 - epoch_us(ts) / 86400000000.0)) END"""
    return over("vectors queries", f"""
WITH hits AS ({_ranked(3 * n, where)}),
scored AS (SELECT query_id, id, wing, room, hall, ts, pinned, sem, round(sem, 4) AS semantic_score,
  round(cast({boost} AS double), 4) AS recency_boost, round(sem * (1.0 + cast({boost} AS double)), 4) AS final_score FROM hits)
SELECT query_id, id, wing, room, hall, ts, pinned, semantic_score, recency_boost, final_score,
  cast(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, sem DESC, id) AS int) AS rank
FROM scored QUALIFY rank <= {n}""")


@query("search_recency", _search_sql(10))
def search_recency(spark, sf_dir):
    return se.search(fx.vectors(spark, sf_dir), fx.topic_queries(spark, sf_dir), fx.AS_OF, n=10)


@query("search_filtered_no_decay", _search_sql(5, "v.wing = 'w3' AND v.hall = 'facts'", no_decay=True))
def search_filtered_no_decay(spark, sf_dir):
    return se.search(fx.vectors(spark, sf_dir), fx.topic_queries(spark, sf_dir), fx.AS_OF, n=5,
                     wing="w3", hall="facts", no_decay=True)


@query("vector_topk_batch", over("vectors queries", f"""
SELECT query_id, id, round(sem, 6) AS score, rank FROM ({_ranked(10)})"""))
def vector_topk_batch(spark, sf_dir):
    hits = ve.top_k(fx.vectors(spark, sf_dir), fx.topic_queries(spark, sf_dir), 10)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("vector_topk_inner", over("vectors queries", f"""
SELECT query_id, id, round(sem, 6) AS score, rank FROM (
{_ranked(10, "v.hall = 'advice'", "round(list_dot_product(v.embedding, q.embedding), 9)")})"""))
def vector_topk_inner(spark, sf_dir):
    hits = ve.top_k(fx.vectors(spark, sf_dir), fx.topic_queries(spark, sf_dir), 10, metric="inner",
                    where=F.col("hall") == "advice")
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("vector_topk_all", over("vectors", f"""
WITH fx_queries AS (SELECT id AS query_id, embedding FROM fx_vectors)
SELECT query_id, id, round(sem, 6) AS score, rank FROM ({_ranked(5)})"""))
def vector_topk_all(spark, sf_dir):
    """The nearest of every vector: a batch as large as the table, its bounds found in an eighth of the vectors first."""
    vectors = fx.vectors(spark, sf_dir)
    hits = ve.top_k(vectors, vectors.select(F.col("id").alias("query_id"), "embedding"), 5, first_pass=1 / 8)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("vector_topk_damaged", over("vectors", f"""
WITH sound AS (SELECT * FROM fx_vectors WHERE cast(substr(id, 2) AS bigint) % 11 > 5),
ranked AS ({_ranked(7).replace("fx_vectors v, fx_queries q", "sound v, (SELECT id AS query_id, embedding FROM sound WHERE cast(substr(id, 2) AS bigint) % 7 = 0) q")})
SELECT query_id, id, round(sem, 6) AS score, rank FROM ranked"""))
def vector_topk_damaged(spark, sf_dir):
    """More than half of the vectors are damaged, each in one of six ways, and so are the queries taken from them: they neither hit nor
    are hit, and the others' results are those of the sound vectors alone."""
    vectors = fx.vectors(spark, sf_dir)
    kind, e = F.substring("id", 2, 20).cast("long") % 11, F.col("embedding").cast("array<double>")
    at = lambda place, value: F.transform(e, lambda x, i: F.when(i == place, F.lit(value).cast("double")).otherwise(x))
    forms = [F.lit(None).cast("array<double>"), F.array().cast("array<double>"), F.slice(e, 1, 63), at(4, float("nan")), at(63, float("inf")), at(0, None)]
    damaged = e
    for i, form in enumerate(forms):
        damaged = F.when(kind == i, form).otherwise(damaged)
    damaged = vectors.withColumn("embedding", damaged)
    # Those of 63 numbers would find each other.
    queries = damaged.where((F.substring("id", 2, 20).cast("long") % 7 == 0) & (kind != 2)).select(F.col("id").alias("query_id"), "embedding")
    return ve.top_k(damaged, queries, 7).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("vector_topk_cells")
def vector_topk_cells(spark, sf_dir):
    """Approximate search by name: 512 cells trained on the table (its directions hardly cluster), 110 probed by each query."""
    vectors = fx.vectors(spark, sf_dir)
    centres = ce.train_cells(vectors, cells=512)
    hits = ce.find(ce.assign_cells(vectors, centres), fx.topic_queries(spark, sf_dir), 10, "cells", centres=centres, probes=110)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _embedded(text: str) -> str:
    """The digest embedding in SQL, without its repetition: 32 values give the same cosine as their twelve copies."""
    return f"list_transform(range(0, 32), lambda i: cast(('0x' || substr(sha256({text}), cast(i * 2 + 1 AS int), 2)) AS int) / 255.0::double)"


@query("search_text", f"""
WITH v AS (SELECT concat('d', doc_id) AS id, doc_id % 17 = 0 AS pinned, {_embedded('text')} AS e FROM documents),
q AS (SELECT item_id AS query_id, {_embedded('text')} AS e FROM benchmark),
s AS (SELECT query_id, id, pinned, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS sem FROM v, q),
best AS (SELECT query_id, max(sem) AS sem FROM s GROUP BY query_id)
SELECT query_id, round(sem, 4) AS best FROM best""")
def search_text(spark, sf_dir):
    """Every benchmark passage as a query text over the documents; the best similarity per query."""
    docs = fx.documents(spark, sf_dir).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text",
        F.lit("w").alias("wing"), F.lit("r").alias("room"), F.lit("facts").alias("hall"),
        F.lit(fx.AS_OF).cast("timestamp").alias("ts"), (F.col("doc_id") % 17 == 0).alias("pinned"),
    )
    texts = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = se.search_text(ve.embed(docs, digest_embedding), texts, fx.AS_OF, n=10, no_decay=True)
    return hits.where(F.col("rank") == 1).select("query_id", F.col("semantic_score").alias("best"))
