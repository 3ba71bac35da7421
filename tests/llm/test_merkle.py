"""The Merkle manifest against a plain recursive one."""

import hashlib
import random
import zlib

import pytest

from conftest_rows import ROWS
from memlake.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[f] for f in FIELDS)])


def proofs(leaves):
    """The root over ``leaves`` and each leaf's levels of (digests before, digests after)."""
    steps, nodes, owners = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        above, owned = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at:at + 16]
            for k in range(len(run)):
                for i in owners[at + k]:
                    steps[i].append((run[:k], run[k + 1:]))
            above.append(h(*run))
            owned.append([i for o in owners[at:at + 16] for i in o])
        nodes, owners = above, owned
    return nodes[0], steps


def brute(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append(row)
    if not rows:
        return []
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        subs[s] = proofs([leaf(r) for r in by_source[s]])
    root, tops = proofs([subs[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for row, own in zip(by_source[s], subs[s][1]):
            path = own + top
            hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0
            low = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
            changed = dict(row, text=row["text"] if row["text"] is None or not hit else "".join(low.get(c, c) for c in row["text"]))
            folded = leaf(changed)
            for before, after in path:
                folded = h(*before, folded, *after)
            out.append((row["doc_id"], leaf(row), subs[s][0], root, h(*[x for b, a in path for x in b + a]), folded, folded == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(spark, rows, folder):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tree string, pos string, hash string, path string, kept string, row string, n string, run string, at string")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    found = merkle.op13_merkle(spark, str(folder))
    assert found.columns == COLUMNS
    plain = [dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r)) for r in rows]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(plain)


def full(doc_id, text, lang, source):
    return (doc_id, text, lang, source, None if text is None else len(text), "t", "p", "h", "x", "k", "r", "n", "u", "a")


def test_sizes_around_the_arity_nulls_ties_and_repeats(spark, tmp_path):
    rng = random.Random(13)
    rows = [full(*r) for r in ROWS]
    at = 100
    for source, n in (("", 1), ("one", 1), ("sixteen", 16), ("next", 17), ("Ünï", 33), ("hot", 700), (None, 20)):
        for _ in range(n):
            at += 1
            rows.append(full(at, rng.choice(["Same Text", f"Text {at}", None, "", "ÄB c"]), rng.choice(["en", None]), source))
    rows += [rows[-1]] * 40 + [full(None, None, None, "hot")] * 20
    check(spark, rows, tmp_path)


def test_many_sources(spark, tmp_path):
    check(spark, [full(i, f"T{i}", "en", f"s{i}") for i in range(300)], tmp_path)


@pytest.mark.parametrize("rows", [[], [(7, "Alone", "en", "s")]])
def test_none_and_one(spark, tmp_path, rows):
    check(spark, [full(*r) for r in rows], tmp_path)


def test_proof_tells_what_changed(spark, tmp_path):
    """A proof holds for its own leaf only."""
    df = spark.createDataFrame([(i, f"text {i}", "s") for i in range(40)], "doc_id long, text string, source string")
    listed = merkle.manifest(df, ["doc_id", "text"], keep={"doc_id": df["doc_id"], "other": merkle.digest(merkle.framed(df["text"]))})
    rows = listed.select("root", merkle.fold(listed["leaf"], listed["path"]).alias("own"), merkle.fold(listed["other"], listed["path"]).alias("changed")).collect()
    assert len(rows) == 40 and all(r.own == r.root != r.changed for r in rows)
