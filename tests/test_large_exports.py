"""Exports read in byte ranges against the same files read whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from memlake.sources import conversations as cv
from memlake.sources import large_exports as lx


def rows(messages):
    return sorted((r.path.rsplit("/", 1)[1], r.format, r.convo_idx, r.msg_idx, r.role, r.text, str(r.ts)) for r in messages.collect())


def some_exports(seed):
    rng = random.Random(seed)
    odd = ['plain', 'quote " and \\ backslash', 'ends in backslash \\', '\\\\"[{', '}]}] , : {"chat_messages":[', 'été 中文 \U0001f600', '', '\n\t', 'x' * 400, '"' * 9, '\\' * 8]
    text = lambda: " ".join(rng.choice(odd) for _ in range(rng.randrange(1, 4)))
    claude = [{"uuid": text(), "extra": [{"a": {"b": [text()]}}, {"c": 1}], "chat_messages": [
        rng.choice([{"sender": "human", "content": text(), "files": [{"n": text()}], "created_at": "2024-01-05T10:00:00Z"},
                    {"sender": "x", "content": [{"type": "text", "text": text()}, {"text": text()}]}]) for _ in range(rng.randrange(6))],
        "after": {"k": [{"z": {"chat_messages": text()}}]}} for _ in range(6)]
    chatgpt = [{"title": text(), "mapping": {f"n{i}{text()}": {"message": rng.choice([None, {"author": {"role": "user"}, "content": {"parts": [text(), ""]}, "create_time": 1700000000.5}]),
                                                              "children": [text()]} for i in range(rng.randrange(5))}, "current": [{"q": {"w": 1}}]} for _ in range(5)]
    slack = [{"ts": "1700000000.5", "text": text(), "user": "u", "blocks": [{"e": [{"t": text()}]}]} for _ in range(12)]
    return {"claude.json": claude, "chatgpt.json": chatgpt, "slack.json": slack}


@pytest.mark.parametrize("seed,size,indent", [(1, 37, None), (2, 5, None), (3, 61, 2), (4, 1 << 20, 1), (5, 1, None)])
def test_ranges_of_any_size_give_the_messages_of_the_whole_file(spark, tmp_path, seed, size, indent):
    for name, content in some_exports(seed).items():
        (tmp_path / name).write_text(json.dumps(content, indent=indent, ensure_ascii=seed % 2 == 0))
    whole = cv.parse_exports(cv.scan_exports(spark, str(tmp_path)))
    split, state = lx.split_exports(spark, str(tmp_path), range_bytes=size)
    assert rows(split) == rows(whole) and len(rows(split)) > 5
    assert state.count() == 0


def test_a_bad_message_loses_only_itself(spark, tmp_path):
    good = [json.dumps({"ts": "1", "text": f"message {i}", "user": "u"}) for i in range(9)]
    (tmp_path / "a.json").write_text("[" + ",".join([*good[:4], '{"ts": "1" "text": broken here}', *good[4:], "7", good[0]]) + "]")
    for name, text in {"empty.json": "", "list.json": "[]", "other.json": '{"turns": [1]}', "numbers.json": "[1, 2]", "cut.json": "[" + good[0] + ',{"ts": "2", "te', "x.txt": "["}.items():
        (tmp_path / name).write_text(text)
    split, state = lx.split_exports(spark, str(tmp_path), range_bytes=16)
    found = rows(split)
    assert [(r[3], r[5]) for r in found if r[0] == "a.json"] == sorted([(i + (i >= 4), f"message {i}") for i in range(9)] + [(11, "message 0")])
    assert [r[5] for r in found if r[0] == "cut.json"] == ["message 0"]
    assert {r.path.rsplit("/", 1)[1]: r.state for r in state.collect()} == {k: "unknown" for k in ("empty.json", "list.json", "other.json", "numbers.json")}
    # Read whole, the same file gives nothing.
    assert cv.parse_exports(cv.scan_exports(spark, str(tmp_path))).where(F.col("path").endswith("/a.json")).count() == 0


def test_no_files(spark, tmp_path):
    split, state = lx.split_exports(spark, str(tmp_path))
    assert split.count() == 0 and state.count() == 0
