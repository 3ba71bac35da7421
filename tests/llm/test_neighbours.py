"""Collision-counting search against brute force."""

import math
from math import comb, erf, inf, nan, sqrt

import numpy as np
import pytest

from memlake.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label string, block string, kind string, query_id string, place string"


def stored(spark, rows, folder):
    df = spark.createDataFrame([(i, e, "l", "b", "k", "q", "p") for i, e in rows], SCHEMA).repartition(3)
    df.write.parquet(f"{folder}/embeddings.parquet")
    return spark.read.parquet(f"{folder}/embeddings.parquet")


def usable(e):
    return e is not None and any(e) and all(x is not None and math.isfinite(x) for x in e)


def brute(rows, query, own, k=5):
    same = [(i, np.float32(e).astype(float)) for i, e in rows if usable(e) and len(e) == len(query) and i != own]
    query = np.float32(query).astype(float)
    scored = [(-round(float(e @ query) / math.sqrt(float(e @ e)) / math.sqrt(float(query @ query)), 12), i is None, i or 0) for i, e in same]
    return [(-s, None if none else i) for s, none, i in sorted(scored)[:k]]


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((round(r.score, 12), r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(found, wanted):
    return sum(len({i for _, i in found.get(q, [])} & {i for _, i in w}) for q, w in wanted.items()) / sum(map(len, wanted.values()))


@pytest.mark.parametrize("spread", [0.05, 0.5, 10])
def test_recall_over_several_blocks(spark, tmp_path, monkeypatch, spread):
    """Close clusters, loose clusters, and nearly none."""
    monkeypatch.setattr(nb, "BLOCK", 700)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 24))
    rows = [(i, (centres[i % 30] + spread * rng.standard_normal(24)).tolist()) for i in range(3000)]
    df = stored(spark, rows, tmp_path)
    found = lists(nb.op11_neighbours(spark, str(tmp_path)))
    wanted = {i: brute(rows, e, i) for i, e in rows if i % 50 == 0}
    assert recall(found, wanted) >= 0.95
    for q, hits in found.items():  # scores are exact, and each is of its own row
        exact = {i: s for s, i in brute(rows, rows[q][1], q, 3000)}
        assert all(abs(exact[i] - s) < 1e-11 for s, i in hits) and len(hits) == 5
    assert df.count() == 3000


def test_recall_on_the_whole_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    found = lists(nb.op11_neighbours(spark, "/root/testdata/sf0.1"))
    wanted = {i: brute(rows, e, i) for i, e in rows if i % 50 == 0}
    assert recall(found, wanted) >= 0.95


def test_copies_ties_and_unusable_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 100)
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # more than a third are copies of a query
    rows += [(2000 + i, [2 * x for x in rows[50][1]]) for i in range(4)] + [(None, rows[100][1])] * 3
    bad = [None, [], [0.0] * 8, [1.0] * 7 + [nan], [1.0] * 7 + [inf], [1.0] * 7 + [None]]
    rows += [(3000 + 50 * i, e) for i, e in enumerate(bad)] + [(4000 + i, [1.0, float(i)]) for i in range(3)] + [(4500, [1.0])]
    rows += [rows[150]] * 3  # repeated rows
    stored(spark, rows, tmp_path)
    found = lists(nb.op11_neighbours(spark, str(tmp_path)))
    wanted = {i: brute(rows, e, i) for i, e in rows if i is not None and i % 50 == 0 and usable(e)}
    assert found[0] == wanted[0] == [(1.0, 1000 + i) for i in range(5)]
    assert found[1000] == [(1.0, 0), *[(1.0, 1001 + i) for i in range(4)]]
    assert [i for _, i in found[50]][:4] == [2000, 2001, 2002, 2003]
    assert [i for _, i in found[100]][:3] == [None] * 3
    assert found[4000] == wanted[4000] and len(found[4000]) == 2  # vectors of its length only: all there are
    assert 4500 not in found and set(found) == {q for q, w in wanted.items() if w}
    assert recall(found, wanted) >= 0.95


def test_empty_and_single(spark, tmp_path):
    empty = stored(spark, [], tmp_path)
    assert nb.nearest(empty, empty).count() == 0
    one = spark.createDataFrame([(50, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert nb.nearest(one, one).count() == 0
    far = spark.createDataFrame([(50, [1e200, 0.0]), (51, [3e-200, 4e-200])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, round(r.score, 9)) for r in nb.nearest(far, far).orderBy("query_id").collect()] == [(50, 51, 0.6), (51, 50, 0.6)]


def test_threshold_is_the_quantile():
    for m, p, miss in ((128, 0.9, 0.02), (16, 0.5, 0.1)):
        at = nb.threshold(m, p, miss)
        below = lambda k: sum(comb(m, j) * p ** j * (1 - p) ** (m - j) for j in range(k))
        assert below(at) <= miss < below(at + 1)
    assert nb.THRESHOLD == nb.threshold(nb.PROJECTIONS, erf(nb.HALF / sqrt(2)), nb.MISS)
