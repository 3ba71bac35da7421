"""Vector top-k and recency search against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from memlake.functions import vectors as vx
from memlake.operators import cells as ce
from memlake.operators import search as se
from memlake.operators import vectors as ve
from memlake.plans import fixtures as fx
from memlake.plans.catalog import QUERIES
from memlake.sources import entries as en

AS_OF = "2026-01-20 00:00:00"
VECTORS = "id string, embedding array<float>, wing string, room string, hall string, ts timestamp, pinned boolean"


def table(spark, rows):
    """Rows of (id, embedding, days old or None, pinned)."""
    df = spark.createDataFrame([(i, list(map(float, e)), None if d is None else float(d), p) for i, e, d, p in rows], "id string, embedding array<double>, d double, pinned boolean")
    ts = F.timestamp_micros(F.unix_micros(F.lit(AS_OF).cast("timestamp")) - (F.col("d") * 86_400_000_000).cast("long"))
    return df.select("id", F.col("embedding").cast("array<float>").alias("embedding"), F.lit("w").alias("wing"), F.lit("r").alias("room"),
                     F.lit("facts").alias("hall"), ts.alias("ts"), "pinned")


def query(spark, *vectors):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vectors)], "query_id int, embedding array<double>")


def test_boost_formula_and_order(spark):
    t = table(spark, [("fresh", [1, 0], 0, False), ("old", [1, 0], 200, False), ("pin", [1, 0], 0, True), ("future", [1, 0], -5, False),
                      ("none", [1, 0], None, None), ("half", [1, 1], 45, False)])
    rows = {r.id: r for r in se.search(t, query(spark, [1, 0]), AS_OF).collect()}
    assert rows["fresh"].recency_boost == rows["future"].recency_boost == rows["none"].recency_boost == 0.45
    assert rows["fresh"].final_score == 1.45
    assert rows["old"].recency_boost == rows["pin"].recency_boost == 0.0
    assert rows["half"].recency_boost == 0.225 and rows["half"].semantic_score == 0.7071
    assert [r.id for r in sorted(rows.values(), key=lambda r: r.rank)] == ["fresh", "future", "none", "old", "pin", "half"]
    flat = se.search(t, query(spark, [1, 0]), AS_OF, no_decay=True).collect()
    assert {r.recency_boost for r in flat} == {0.0}


def test_overfetch_limits_reranking(spark):
    # The best three by similarity are old; a fresh fourth one is outside 3n and must not win.
    t = table(spark, [(f"o{i}", [1, i / 100], 400, False) for i in range(3)] + [("fresh", [1, 0.05], 0, False)])
    assert [r.id for r in se.search(t, query(spark, [1, 0]), AS_OF, n=1).collect()] == ["o0"]


def test_location_filters(spark):
    t = table(spark, [("a", [1, 0], 0, False)]).withColumn("wing", F.lit("x")).unionByName(table(spark, [("b", [1, 0], 0, False)]))
    assert [r.id for r in se.search(t, query(spark, [1, 0]), AS_OF, wing="x", hall="facts").collect()] == ["a"]
    assert se.search(t, query(spark, [1, 0]), AS_OF, room="nowhere").count() == 0
    assert se.location_filter() is None


@pytest.mark.parametrize("metric", ["cosine", "inner"])
def test_top_k_matches_brute_force_with_ties(spark, metric):
    rng = np.random.RandomState(7)
    data = rng.randint(-2, 3, (600, 4)).astype(float)
    data[:200] = data[0]  # a third of all rows are copies
    ids = [f"v{i}" for i in rng.permutation(600)]
    queries = rng.randint(-2, 3, (5, 4)).astype(float)
    df = spark.createDataFrame(list(zip(ids, data.tolist())), "id string, embedding array<float>").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = ve.top_k(df, query(spark, *queries), 9, metric=metric).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for j, q in enumerate(queries):
        scored = []
        for i, v in zip(ids, data):
            score = float(v @ q)
            if metric == "cosine":
                score /= (np.linalg.norm(v) + 1e-9) * (np.linalg.norm(q) + 1e-9)
            scored.append((-round(score, 9), i))
        expected = [i for _, i in sorted(scored)[:9]]
        assert [r.id for r in sorted((r for r in got if r.query_id == j), key=lambda r: r["rank"])] == expected


def brute_force(vectors, queries, k):
    """Ids of the best rows by cosine for plain lists of (id, vector)."""
    out = {}
    for q, wanted in queries:
        scored = [(-round(float(v @ wanted) / ((np.linalg.norm(v) + 1e-9) * (np.linalg.norm(wanted) + 1e-9)), 9), i) for i, v in vectors]
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def found_ids(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("first_pass", [None, 0.25])
def test_query_batches_of_any_size_take_one_path(spark, monkeypatch, first_pass):
    """More queries than a chunk and more vectors than a block, some queries and vectors equal."""
    monkeypatch.setattr(ve, "CHUNK_ROWS", 7)
    monkeypatch.setattr(ve, "BLOCK_ROWS", 11)
    rng = np.random.RandomState(11)
    data = rng.randint(-2, 3, (150, 4)).astype(float)
    vectors = [(f"v{i:03d}", v) for i, v in enumerate(data)]
    queries = [(i, v) for i, v in enumerate(rng.randint(-2, 3, (40, 4)).astype(float))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors], "id string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in queries], "query_id int, embedding array<double>").repartition(3)
    assert found_ids(ve.top_k(df, asked, 6, first_pass=first_pass)) == brute_force(vectors, queries, 6)


def test_queries_that_cannot_be_compared_get_no_hits(spark):
    df = spark.createDataFrame([(f"v{i}", [float(i), 1.0]) for i in range(9)] + [("odd", [1.0, 2.0, 3.0])], "id string, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 1.0]), (1, None), (2, [float("nan"), 1.0]), (3, [1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (6, []),
                                   (7, [1.0, 1.0, 1.0]), (8, [0.0, 0.0])], "query_id int, embedding array<double>")
    got = found_ids(ve.top_k(df, asked, 2))
    assert set(got) == {0, 7, 8} and got[0] == ["v1", "v2"] and got[7] == ["odd"] and got[8] == ["v0", "v1"]
    assert found_ids(ve.top_k(df, asked, 2, first_pass=0.5)) == got


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "id string, embedding array<float>")
    assert ve.top_k(df, query(spark, [1, 0]), 3).count() == 0
    full = spark.createDataFrame([("a", [1.0, 0.0])], "id string, embedding array<float>")
    none = query(spark, [1, 0]).where("query_id > 5")
    assert ve.top_k(full, none, 3).count() == 0
    with pytest.raises(ValueError):
        ve.top_k(full, query(spark, [1, 0]), 3, metric="other")


def test_cells_probe_all_is_exact(spark):
    rng = np.random.RandomState(3)
    df = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(rng.randn(300, 8))], "id string, embedding array<float>")
    centres = ce.train_cells(df, cells=12)
    stored = ce.assign_cells(df, centres)
    q = query(spark, *rng.randn(3, 8))
    exact = found_ids(ce.find(df, q, 5))
    assert found_ids(ce.find(stored, q, 5, "cells", centres=centres, probes=12)) == exact
    assert set(found_ids(ce.find(stored, q, 5, "cells", centres=centres, probes=1))) == set(exact)
    with pytest.raises(ValueError, match="unknown method"):
        ce.find(df, q, 5, "other")
    with pytest.raises(ValueError, match="unknown method"):
        se.search(table(spark, [("a", [1, 0], 0, False)]), q, AS_OF, method="other")


def test_cells_recall_on_the_whole_table(spark):
    """Recall of at least 0.9 while a query reads less than 30 % of the rows."""
    sf_dir = "/root/testdata/sf0.1"
    vectors, queries = fx.vectors(spark, sf_dir), fx.topic_queries(spark, sf_dir)
    exact = found_ids(ce.find(vectors, queries, 10))
    near = found_ids(QUERIES["vector_topk_cells"](spark, sf_dir))
    recall = sum(len(set(exact[q]) & set(near[q])) for q in exact) / sum(map(len, exact.values()))
    centres = ce.train_cells(vectors, cells=512)
    sizes = {r.cell: r["count"] for r in ce.assign_cells(vectors, centres).groupBy("cell").count().collect()}
    asked = ce.probed_cells(queries, centres, 110).collect()
    share = sum(sizes.get(c, 0) for r in asked for c in r.cells) / len(asked) / vectors.count()
    assert recall >= 0.9 and share < 0.3, (recall, share)


def test_cells_take_tables_with_unusable_vectors(spark):
    rows = [(f"g{i}", [1.0, float(i)]) for i in range(30)] + [("nan", [float("nan"), 1.0]), ("short", [1.0]), ("none", None), ("zero", [0.0, 0.0]), ("null", [None, 1.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    centres = ce.train_cells(df, cells=4)
    asked = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 0.0])], "query_id int, embedding array<double>")
    got = found_ids(ce.find(ce.assign_cells(df, centres), asked, 3, "cells", centres=centres, probes=4))
    assert got == {0: ["g2", "g3", "g1"]} or got[0][0] == "g2"
    empty = df.where("false")
    none = ce.train_cells(empty, cells=4)
    assert ce.find(ce.assign_cells(empty, none), asked, 3, "cells", centres=none, probes=4).count() == 0


def test_native_cosine_and_digest_embeddings(spark):
    import hashlib

    df = spark.createDataFrame([("hello",), ("",), ("ünï",)], "t string")
    rows = df.select("t", vx.digest_embedding(F.col("t")).alias("a"), vx.digest_embedding_padded(F.col("t")).alias("b"),
                     vx.cosine(vx.digest_embedding(F.col("t")), vx.digest_embedding(F.col("t"))).alias("c")).collect()
    for row in rows:
        raw = hashlib.sha256(row.t.encode()).digest()
        floats = ([b / 255.0 for b in raw] * 13)[:384]
        norm = math.sqrt(sum(x * x for x in floats)) + 1e-9
        assert np.allclose(row.a, [x / norm for x in floats], atol=1e-15)
        padded = np.pad(np.frombuffer(raw, dtype=np.uint8).astype(float), (0, 352))
        assert np.allclose(row.b, padded / (np.linalg.norm(padded) + 1e-9), atol=1e-12)
        assert abs(row.c - 1) < 1e-6


def test_model_embedder_hook(spark):
    """Any Column function works as embedder, for example a pandas UDF around a model."""
    @F.pandas_udf("array<float>")
    def model(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(t.count("a")), float(t.count("b")), 1.0])

    memories = spark.createDataFrame([("m1", "aaa"), ("m2", "bbb"), ("m3", "abab")], "id string, raw string").select(
        "id", "raw", *[F.lit(x).alias(c) for c, x in (("wing", "w"), ("room", "r"), ("hall", "facts"))],
        F.lit(AS_OF).cast("timestamp").alias("ts"))
    vectors = en.vector_entries(memories, embedder=model)
    texts = spark.createDataFrame([(1, "aaaa"), (2, "b b")], "query_id int, query string")
    hits = se.with_text(se.search_text(vectors, texts, AS_OF, embedder=model, n=1), vectors).collect()
    assert {r.query_id: (r.id, r.text) for r in hits} == {1: ("m1", "aaa"), 2: ("m2", "bbb")}


def test_metadata_values(spark):
    df = spark.createDataFrame([(1, True, ["a"], None)], "n int, b boolean, l array<string>, z string")
    value = df.select(ve.metadata_map(n=ve.metadata_value(df, "n"), b=ve.metadata_value(df, "b"), l=ve.metadata_value(df, "l"),
                                      z=ve.metadata_value(df, "z")).alias("m")).first().m
    assert value == {"n": "1", "b": "true", "l": '["a"]'}


def test_vectors_that_cannot_be_compared_are_no_hits(spark):
    good = [(f"g{i}", [1.0, float(i)]) for i in range(8)]
    bad = [("nan", [float("nan"), 1.0]), ("inf", [float("inf"), 1.0]), ("null", [None, 1.0]), ("short", [1.0]), ("long", [0.0, 1.0, 0.0]), ("none", None)]
    schema = "id string, embedding array<double>"
    query = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    clean = ve.top_k(spark.createDataFrame(good, schema), query, 3).collect()
    mixed = ve.top_k(spark.createDataFrame(bad[:3] + good + bad[3:], schema).coalesce(1), query, 3).collect()
    assert len(clean) == 3 and sorted(map(tuple, mixed)) == sorted(map(tuple, clean))


def test_cells_are_trained_by_many_tasks(spark, monkeypatch):
    import pyspark.ml.clustering as ml

    seen = []
    fit = ml.KMeans.fit
    monkeypatch.setattr(ml.KMeans, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    rows = spark.range(200).select(F.col("id").cast("string").alias("id"), F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("embedding"))
    assert ce.train_cells(rows, cells=4).shape == (4, 2)
    assert seen == [ce._SAMPLE_PARTS]  # one before, whatever the sample's size


def test_a_task_gives_what_it_met_best_so_far(spark, monkeypatch):
    """Later blocks of a task give no rows below what its earlier blocks gave (before, each block gave its own best)."""
    monkeypatch.setattr(ve, "BLOCK_ROWS", 11)
    monkeypatch.setattr(ve, "top_n", lambda found, *_: found)
    vectors = spark.createDataFrame([(f"v{i:03d}", [1.0, i / 100]) for i in range(150)], "id string, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(i, [1.0, -float(i)]) for i in range(5)], "query_id int, embedding array<double>").coalesce(1)
    assert ve.top_k(vectors, asked, 6).count() == 5 * 6


def test_first_pass_gives_floors_and_no_rows(spark, monkeypatch):
    """A row per chunk and task is shuffled, and a floor is the k-th best of the sampled vectors, where there are so many."""
    monkeypatch.setattr(ve, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ve, "CHUNK_ROWS", 3)
    rng = np.random.RandomState(2)
    data, asked = rng.randn(60, 4), rng.randn(8, 4)
    vectors = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(data)], "id string, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, embedding array<double>").coalesce(1)
    chunks = ve.materialise(ve.chunked(ve.usable_queries(queries).withColumn("cells", F.array(F.lit(0))), "inner"))
    for k in (5, 61):
        floors = {q: f for r in ve._bounded(vectors, chunks, k, "inner", 9).collect() for q, f in zip(r.owners, np.frombuffer(r.floors))}
        least = {q: np.sort(data @ v)[-k] if k <= 60 else -np.inf for q, v in enumerate(asked)}
        assert floors == pytest.approx(least, abs=2e-9) and len(floors) == 8
        assert all(floors[q] <= least[q] for q in least)


def test_scores_closer_than_single_precision(spark, monkeypatch):
    monkeypatch.setattr(ve, "BLOCK_ROWS", 16)
    rng = np.random.RandomState(4)
    close = [(f"v{i:03d}", np.array([1.0, 1.0, 0.5]) + 3e-8 * rng.randint(-9, 9, 3)) for i in range(120)]
    queries = [(i, np.array([1.0, 0.9 + i / 50, 0.1])) for i in range(9)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in close], "id string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in queries], "query_id int, embedding array<double>")
    for first_pass in (None, 0.5):
        assert found_ids(ve.top_k(df, asked, 4, first_pass=first_pass)) == brute_force(close, queries, 4)
    # Numbers that single precision doesn't hold, very small and very large ones.
    large = spark.createDataFrame([(f"v{i}", [float(i), 10.0 ** (3 * i)]) for i in range(20)], "id string, embedding array<double>")
    assert found_ids(ve.top_k(large, query(spark, [0, 1e20], [1, 0], [1, -1e-56]), 2, metric="inner")) == {0: ["v19", "v18"], 1: ["v19", "v18"], 2: ["v18", "v17"]}


def test_blocks_of_long_vectors_are_small(spark):
    """A block holds a megabyte, not a number of rows: with 384 numbers it was up to six."""
    vectors = spark.range(1000).coalesce(1).select(F.col("id").cast("string").alias("id"), F.array_repeat(F.col("id").cast("double"), 384).alias("embedding"), F.lit(0).alias("cell"))
    blocks = ve.packed(vectors, "inner", ()).select(F.length("matrix").alias("bytes"), F.size("v0").alias("rows")).collect()
    assert sum(r.rows for r in blocks) == 1000 and max(r.bytes for r in blocks) <= 1 << 20
