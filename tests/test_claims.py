"""Claims in text, containment matching and conflict texts."""

import random

from pyspark.sql import functions as F

from memlake.operators import claims as cl
from test_triples import AS_OF, table


def conflicts(spark, text, *triples):
    texts = spark.createDataFrame([(1, text)], "n int, text string")
    return cl.text_conflicts(texts, table(spark, *triples), AS_OF).collect()


def test_other_person_is_a_conflict(spark):
    rows = conflicts(spark, "On Monday Ines shipped the billing-portal again.", ("Tomas", "assigned_to", "billing-portal"))
    assert [(r.type, r.incoming_text, r.description, r.stored.subject) for r in rows] == [
        ("assignment", '"Ines finished billing-portal again"', "Attribution conflict on 'billing-portal'", "Tomas")]


def test_same_person_ended_triple_or_empty_table_is_none(spark):
    assert conflicts(spark, "tomas closed billing-portal.", ("Tomas", "assigned_to", "billing-portal")) == []
    assert conflicts(spark, "Ines closed ledger.", ("Tomas", "assigned_to", "ledger", None, "2021-06-30")) == []
    assert conflicts(spark, "Ines closed ledger.", ("Tomas", "likes", "ledger")) == []
    assert conflicts(spark, "Ines closed ledger.") == []


def test_both_patterns_and_both_directions(spark):
    rows = conflicts(
        spark, "Ravi is working on the cache. Uma owns Ledger; Jo closed q",
        ("Tomas", "assigned_to", "cache rewrite for everyone"), ("Tomas", "assigned_to", "led"), ("Tomas", "assigned_to", "zzz"),
    )
    assert sorted((r.person, r.verb, r.stored.object) for r in rows) == [
        ("Ravi", "owns", "cache rewrite for everyone"), ("Uma", "owns", "led")]


def test_very_long_claim_is_matched_whole(spark):
    words = " ".join(f"w{i}" for i in range(20_000))
    rows = conflicts(spark, f"Uma owns {words} harbour", ("Tomas", "assigned_to", "w19999 harbour"), ("Tomas", "assigned_to", "harbours"))
    assert [r.stored.object for r in rows] == ["w19999 harbour"]


def test_containment_pairs_match_brute_force(spark):
    rng = random.Random(5)
    make = lambda n, longest: sorted({"".join(rng.choice("ab-") for _ in range(rng.randrange(1, longest))) for _ in range(n)})
    containers = make(120, 30)
    parts = make(80, 14) + [c[2:-1] for c in containers if len(c) > 14] + ["not there at all", "a", "aaaaaaaaaaaaa"]
    parts = sorted(set(parts) - {""})
    got = cl.containment_pairs(
        spark.createDataFrame([(c,) for c in containers], "container string"),
        spark.createDataFrame([(p,) for p in parts], "part string"),
    ).collect()
    assert sorted(map(tuple, got)) == sorted((c, p) for c in containers for p in parts if p in c)


def test_label_detail_and_quoted_entity(spark):
    df = spark.createDataFrame([("tenure", "a b"), ("assignment", "a b"), ("date", ""), ("other kind", "c")], "k string, d string")
    assert [r[0] for r in df.select(cl.label(F.col("k"), F.col("d"))).collect()] == [
        "🔴 [TENURE] a b", "🟡 [ASSIGNMENT] a b", "🟠 [DATE] ", "⚪ [OTHER KIND] c"]
    texts = spark.createDataFrame([('report on "north pier", then "south"',), ("nothing marked",)], "t string")
    assert [r[0] for r in texts.select(cl.quoted_entity(F.col("t"))).collect()] == ["north pier", None]
    rows = spark.createDataFrame(
        [("Uma", "runs", "Ledger", "2023-03-04", "fresh", "dock/crane", "d"), (None, None, None, None, "", None, "only this")],
        "s string, p string, o string, f string, i string, l string, d string")
    detail = rows.select(cl.detail_text(*[F.col(c) for c in "spofild"]).alias("t")).collect()
    assert detail[0].t == "  Stored:  Uma runs Ledger (from 2023-03-04)\n  New:     fresh\n  Location: dock/crane"
    assert detail[1].t == "only this"


def test_candidates_come_once_with_their_columns_and_few_pieces(spark):
    numbered = [f"task-{n}" for n in range(150)] + ["x" * 5000 + "task-7" + "y" * 5000 + "task-7"]
    texts = spark.createDataFrame([(t,) for t in numbered], "whole string")
    parts = spark.createDataFrame([(i, t) for i in (1, 2) for t in numbered], "copy int, part string")
    found = cl.candidates(texts, parts, "whole", "part").join(texts.withColumn("_container", cl.text_id("whole")), "_container")
    got = found.where("contains(whole, part)").select("copy", "part", "whole").collect()
    assert sorted(map(tuple, got)) == sorted((i, p, w) for i in (1, 2) for p in numbered for w in numbered if p in w)

    bits = cl._bits(parts.where("length(part) < 10").select(cl._start(F.col("part"), F.length("part")).alias("start")))
    pieces = cl._pieces(texts.where("length(whole) < 10").select(F.xxhash64("whole").alias("id"), F.col("whole").alias("text")),
                        F.array(*[F.lit(n) for n in (6, 7, 8)]), bits)
    assert pieces.count() == 10 + 90 * 2 + 50 * 3  # only those that begin with "task-" and a digit; all of them were 610
