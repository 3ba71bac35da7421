"""Conversation repair against all edit sequences, tried one by one, and on odd, empty and very long conversations."""

import hashlib
import random
import re
import zlib

import pytest

from memlake.llm import dialogue
from memlake.llm.dialogue import Decoder

WORD = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(turns):
    """(cost, audit, lines) by plain dynamic programming over whole strings; turns of (role, fault, text)."""
    def inserted(table):
        out = dict(table)
        for _ in range(3):
            for state, (cost, audit, lines) in list(out.items()):
                role, target = {0: ("user", 2), 1: ("user", 2), 3: ("user", 2), 2: ("assistant", 3)}[state]
                new = (cost + 5, audit + "I", lines + [role + ":"])
                if target not in out or new < out[target]:
                    out[target] = new
        return out

    table = {0: (0, "", [])}
    for role, fault, text in turns:
        new = {}

        def offer(state, *value):
            if state not in new or value < new[state]:
                new[state] = value

        for state, (cost, audit, lines) in inserted(table).items():
            offer(state, cost + 2, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            cost += 5 * (fault == "truncated")
            if state == 0 and role[:1] == "s":
                offer(1, cost, audit + "K", lines + [f"{role}:{text}"])
            wanted, target = ("assistant", 3) if state == 2 else ("user", 2)
            if role[:1] == wanted[0]:
                offer(target, cost, audit + "K", lines + [f"{role}:{text}"])
            else:
                offer(target, cost + 1, audit + "R", lines + [f"{wanted}:{text}"])
        table = new
    return min(v for s, v in inserted(table).items() if s in (0, 3))


def decode(turns):
    decoder, audit, most = Decoder(), [], 0
    for role, fault, text in turns:
        audit += decoder.turn(role, fault, text.encode())
        most = max(most, len(decoder.tree.parent) - len(decoder.tree.free))
    cost, rest, digest = decoder.end()
    return cost, "".join(audit + rest), digest, most


def sha(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("roles", [["user", "assistant"], ["user", "assistant", "system", "", "x"], ["user"], ["assistant"], ["system"], ["system", "user"]])
def test_decoder_equals_plain_programming(roles):
    rng = random.Random(len(roles))
    for _ in range(1500):
        faults = rng.choice([[""], ["", "", "blank", "truncated", "duplicate"], ["blank", "truncated"], ["truncated"]])
        turns = [(rng.choice(roles), rng.choice(faults), str(i)) for i in range(rng.randrange(14))]
        cost, audit, lines = cheapest(turns)
        assert decode(turns)[:3] == (cost, audit, sha(lines)), turns


def test_the_tree_stays_small_where_paths_meet():
    rng = random.Random(4)
    turns = [(("user", "assistant")[i % 2] if rng.random() < 0.9 else rng.choice(["user", "system"]), rng.choice(["", "", "", "blank", "truncated"]), "t") for i in range(30000)]
    cost, audit, _, most = decode(turns)
    assert len(audit.replace("I", "")) == len(turns) and most < 2000


def test_paths_that_never_meet_are_compared_whole():
    """Turns of one role: which one goes is open to the end, so two paths differ from their first edit on."""
    for n in (2001, 2002):
        turns = [("user", "", "t")] * n
        cost, audit, lines = cheapest(turns)
        assert decode(turns)[:3] == (cost, audit, sha(lines))
    assert decode([("user", "", "t")] * 60001)[1].startswith("DKR")


# --- the whole operator

def brute(rows):
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        kept = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            name = " " if conv is None else str(conv), " " if turn is None else str(turn)
            hit = zlib.crc32(":".join(name).encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if hit:
                row = (turn, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)
                kept += [row] * (2 if hit == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, turns = set(), []
        for turn, role, text in kept:
            ends = WORD.findall(text)
            turns.append((role, "blank" if not ends else "duplicate" if (role, text) in seen else "" if ends[-1] in ".!?" else "truncated", text))
            seen.add((role, text))
        numbers = [t for t, _, _ in kept if t is not None]
        counted = [sum(f == x for _, f, _ in turns) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(turns)
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *counted, illegal, cost, audit, sha(lines)))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, fault string, lost string, hit string, copy string, nth string"


def stored(spark, rows, folder):
    df = spark.createDataFrame([(*r, "f", "l", "h", "c", "n") for r in rows], SCHEMA).repartition(3)
    df.write.parquet(f"{folder}/conversations.parquet")
    return spark.read.parquet(f"{folder}/conversations.parquet")


def some_rows():
    rng = random.Random(9)
    texts = ["Fine.", "Cut off", "", " \n", None, "Oh!  \t", "Étè?", "x" * 30000 + ".", "end. ", "tab.\x0b"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "", "tool"]), rng.choice(texts)) for c in range(60) for t in range(rng.randrange(9))]
    rows += [(None, t, "user", "Hi.") for t in (None, None, 1, 5)] + [(100, 3, "user", "Same.")] * 30 + [(101, None, None, None)]
    return rows + [(102, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(3000)]


def test_operator_equals_brute_force(spark, tmp_path):
    rows = some_rows()
    stored(spark, rows, tmp_path)
    found = dialogue.op12_dialogue(spark, str(tmp_path))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_edits_and_texts_agree_with_the_audit(spark, tmp_path):
    turns = stored(spark, some_rows(), tmp_path).drop("lost")
    audits = {r.conv_id: r for r in dialogue.audit(turns).collect()}
    steps, lines = {}, {}
    for r in sorted(dialogue.edits(turns).collect(), key=lambda r: r.step):
        steps.setdefault(r.conv_id, []).append(r.edit)
    for r in sorted(dialogue.repaired(turns).collect(), key=lambda r: r.step):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, a in audits.items():
        assert "".join(steps.get(conv, [])) == a.audit and sha(lines.get(conv, [])) == a.repaired_sha256


def test_empty_and_wholly_lost(spark, tmp_path):
    empty = stored(spark, [], tmp_path)
    assert dialogue.audit(empty.drop("lost")).count() == dialogue.edits(empty.drop("lost")).count() == dialogue.repaired(empty.drop("lost")).count() == 0
    lost = spark.createDataFrame([("c", 1, "user", "Hi.", True)], "conv_id string, turn long, role string, text string, gone boolean")
    assert [tuple(r) for r in dialogue.audit(lost, lost["gone"]).collect()] == [("c", 0, 0, 0, 0, 0, 0, "", sha([]))]
