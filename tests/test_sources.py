"""Readers over real files, and watch mode."""

import json
import os

import pytest
from pyspark.sql import functions as F

from memlake.operators.tables import read_current
from memlake.sources import conversations as cv
from memlake.sources import entries as en
from memlake.sources import files as fi
from memlake.sources import notes as no
from memlake.sources import transcripts as tr
from memlake.streaming import watch as wa

AS_OF = "2026-01-20 00:00:00"


def write(root, files, mtime=None):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        if mtime:
            os.utime(path, (mtime, mtime))
    return str(root)


@pytest.fixture
def project(tmp_path):
    return write(tmp_path / "proj", {
        "app/main.py": "def run(a: int = 1) -> None:\n    pass\n", "app/__init__.py": "import os", "app/.env": "KEY=1",
        ".hidden/notes.md": "hidden notes", "docs/read me%20.md": "the docs", "docs/run.sh": "echo hi", "docs/conf.json": "{}",
        "docs/blank.txt": "  \n ", "docs/pic.png": "text in disguise", "docs/bad.txt": b"\xff\xfe\x00binary",
        "docs/late.txt": b"a" * 600 + b"\xff tail", "docs/cut.txt": ("a" * 511 + "é and more").encode(), "docs/huge.txt": "x" * 500_001,
        "node_modules/x.js": "skip", ".git/config": "skip", "build/out.txt": "skip", "docs/.gitignore": "skip", "noext": "plain",
        "a/b/__pycache__/c.py": "skip", "_private/p.rst": "private",
    })


def test_project_scan(spark, project):
    rows = {r.path[len(project) + 1:]: r for r in fi.mine_files(spark, project, AS_OF, wing="w").collect()}
    assert set(rows) == {
        "app/main.py", "app/__init__.py", "app/.env", ".hidden/notes.md", "docs/read me%20.md", "docs/run.sh", "docs/conf.json",
        "docs/late.txt", "docs/cut.txt", "docs/huge.txt", "noext", "_private/p.rst"}
    main = rows["app/main.py"]
    assert (main.room, main.hall, main.tags, main.content) == ("app", "discoveries", ["py", "file"], "fn:run(a: int)->None\n pass")
    assert rows["docs/run.sh"].hall == "advice" and rows["docs/read me%20.md"].content == "docs"
    assert (rows["app/.env"].tags, rows["app/.env"].hall) == (["", "file"], "facts")
    assert rows["noext"].room == "proj" and rows["docs/late.txt"].raw.endswith("� tail")
    again = {r.id for r in fi.mine_files(spark, project, AS_OF).collect()}
    assert again == {r.id for r in rows.values()}


def test_single_file_and_since(spark, project):
    row = fi.mine_files(spark, project + "/app/main.py", AS_OF).first()
    assert row.room == "main"
    os.utime(project + "/noext", (1_000_000_000, 1_000_000_000))
    recent = fi.mine_files(spark, project, AS_OF, since="2010-01-01")
    assert recent.where(F.col("path").endswith("noext")).count() == 0 and recent.count() == 11
    assert fi.mine_files(spark, project, AS_OF, room="fixed").select("room").distinct().first().room == "fixed"


def test_entries(spark):
    files = spark.createDataFrame([("/x/y/a.md", 5, "é" * 3000)], "path string, length long, text string")
    mined = fi.files_to_drawers(files, AS_OF, "w")
    entry = en.vector_entries(mined, extra=("path",), excerpt_chars=2000).first()
    assert entry.text == "é" * 2000 and len(entry.embedding) == 384
    assert entry.metadata == {"wing": "w", "room": "y", "hall": "facts", "path": "/x/y/a.md", "timestamp": AS_OF}
    assert en.vector_entries(mined).first().text == "é" * 3000
    assert en.drawer_columns(mined).columns == ["id", "wing", "room", "hall", "content", "ts", "pinned", "decay_weight", "tags"]


CLAUDE = [{"chat_messages": [
    {"sender": "human", "content": [{"type": "text", "text": "first part"}, "junk", {"type": "image"}, {"text": "second part"}], "created_at": "2024-01-05T10:00:00.5Z"},
    {"sender": "assistant", "content": "  [not a list] plain  ", "created_at": "bad"}, {"content": "   "}, {"content": "nobody said this", "created_at": ""}, {"sender": "x"}]},
    {"chat_messages": [{"sender": "human", "content": "second conversation"}]}, {}]
CHATGPT = [{"mapping": {"z": {"message": None}, "b": {"message": {"author": {"role": "user"}, "content": {"parts": ["hello", "", None, "there"]}, "create_time": 1700000000.25}},
                        "a": {"message": {"author": {"role": "assistant"}, "content": {"parts": ["answer"]}, "create_time": None}}, "c": {"message": {"content": {"parts": []}}}}}]
SLACK = [{"text": " hi ", "ts": "1700000000.0001", "user": "u1"}, {"text": "yo", "ts": "junk", "username": "bot"}, {"text": "", "ts": "1"}, {"text": "anon", "ts": 1700000001}]
MARKDOWN = "intro\n**Human:** ask **me**\n**assistant:**\nanswer\n**USER:**   \n**Claude:** more"


@pytest.fixture
def exports(tmp_path):
    return write(tmp_path / "exp", {
        "c.json": json.dumps(CLAUDE), "g.json": json.dumps(CHATGPT), "s.json": json.dumps(SLACK), "talk.md": MARKDOWN,
        "o.json": json.dumps({"chat_messages": []}), "e.json": "[]", "broken.json": '[{"chat_messages": [{"sender":', "x.txt": "ignored",
        "venv/talk.md": MARKDOWN, "nums.json": "[1,2]",
    })


def test_export_parsers(spark, exports):
    rows = cv.parse_exports(cv.scan_exports(spark, exports)).orderBy("path", "convo_idx", "msg_idx").collect()
    by = lambda name: [(r.convo_idx, r.msg_idx, r.role, r.text, r.ts and round(r.ts.timestamp() * 10 ** 4)) for r in rows if r.path.endswith("/" + name)]
    assert by("c.json") == [
        (0, 0, "human", "first part\nsecond part", 17044488005000), (0, 1, "assistant", "[not a list] plain", None),
        (0, 3, "unknown", "nobody said this", None), (1, 0, "human", "second conversation", None)]
    assert by("g.json") == [(0, 1, "user", "hello\nthere", 17000000002500), (0, 2, "assistant", "answer", None)]
    assert by("s.json") == [(0, 0, "u1", "hi", 17000000000001), (0, 1, "bot", "yo", None), (0, 3, "unknown", "anon", 17000000010000)]
    assert by("talk.md") == [(0, 0, "unknown", "intro", None), (0, 1, "human", "ask **me**", None), (0, 2, "assistant", "answer", None), (0, 4, "assistant", "more", None)]
    assert len(rows) == 13


def test_formats_and_unparsed(spark, exports):
    files = cv.scan_exports(spark, exports)
    kinds = {r.path.rsplit("/", 1)[1]: r.f for r in files.select("path", cv.detect_format(F.col("path"), F.col("text")).alias("f")).collect()}
    assert {k: v for k, v in kinds.items() if v != "unknown"} == {"c.json": "claude", "g.json": "chatgpt", "s.json": "slack", "talk.md": "markdown"}


def test_messages_to_drawers(spark, exports):
    rows = cv.mine_conversations(spark, exports, AS_OF, wing="w").collect()
    assert sorted((r.room, r.hall, r.tags[1], r.raw) for r in rows) == [("c", "facts", "human", "first part\nsecond part")]


def test_vault(spark, tmp_path):
    root = write(tmp_path / "v", {
        "a.md": "---\ntitle: A: b\ntags: [x, 'y']\ncreated: 2024-02-03\n---\nbody\n", "b.md": "no heading", "c.md": "---\ndate: nonsense\ntags: z\n---\n\ncc",
        "empty.md": "---\nk: v\n---\n  ", ".obsidian/d.md": "skip", ".trash/e.md": "skip", "f.txt": "skip", "sub/.note.md": "hidden note"}, 1_700_000_000)
    rows = {r.metadata["title"]: r for r in no.get_reader("obsidian")(spark, root).collect()}
    assert rows["A: b"].content == "body" and rows["A: b"].metadata["tags"] == '["x","y"]'
    assert rows["A: b"].ts.strftime("%Y-%m-%d") == "2024-02-03" and rows["c"].ts.strftime("%Y") == "2023"
    assert set(rows) == {"A: b", "b", "c", ".note"}
    assert [r.content for r in no.read_vault(spark, root, tags_filter=["y", "q"]).collect()] == ["body"]
    assert no.read_vault(spark, root, since="2024-01-01").count() == 0
    drawers = {r.room: r for r in no.documents_to_drawers(no.read_vault(spark, root), "obsidian", AS_OF).collect()}
    assert (drawers["a"].hall, drawers["a"].tags) == ("facts", ["plugin", "obsidian"])
    with pytest.raises(ValueError):
        no.get_reader("other")


def test_pages_and_issues(spark, tmp_path):
    root = write(tmp_path / "n", {"p.md": "  page  ", "e.md": " "})
    assert [(r.content, r.metadata["title"]) for r in no.read_pages(spark, root).collect()] == [("page", "p")]
    issues = [{"id": "1", "title": "T", "description": "d" * 600, "state": {"name": "Done"}, "assignee": {"name": "Ann"}, "createdAt": "2024-01-01T00:00:00Z"},
              {"id": "2", "title": "U", "state": "open", "assignee": "Bob", "updatedAt": "2024-01-02T00:00:00Z"}, {"id": "3", "description": "", "state": {}}, {"id": "4"}]
    path = write(tmp_path / "i", {"a.json": json.dumps(issues), "b.json": json.dumps({"issues": issues[1:2]}), "bad.json": "{oops"})
    rows = sorted(no.read_issues(spark, path).collect(), key=lambda r: r.metadata["id"])
    assert [r.content for r in rows] == ["Title: T\nDescription: " + "d" * 500 + "\nStatus: Done\nAssignee: Ann", "Title: U\nStatus: open", "Title: U\nStatus: open", "Status: "]
    assert rows[0].metadata["assignee"] == "Ann" and rows[1].metadata["assignee"] == "" and rows[1].ts.day == 2
    assert no.read_issues(spark, path + "/a.json").count() == 3
    drawer = no.documents_to_drawers(no.read_issues(spark, path + "/a.json"), "linear", AS_OF).first()
    assert drawer.room == "unknown"


def test_split(spark, tmp_path):
    root = write(tmp_path / "t", {"a.md": "one\n---\n\n=====  \ntwo\n----\n three \n", "b.md": "no rule -- here"})
    files = tr.read_transcripts(spark, root)
    assert [(r.part_no, r.text, r.name) for r in tr.split_transcripts(files).orderBy("part_no").collect()] == [
        (1, "one", "a_1.md"), (3, "two", "a_3.md"), (4, "three", "a_4.md")]
    assert [r.parts for r in tr.count_parts(files).collect()] == [4]


def test_watch_files(spark, tmp_path):
    src, out, vec, err = (str(tmp_path / n) for n in ("in", "drawers", "vectors", "errors"))
    write(tmp_path / "in", {"a.md": "the first", "b.py": "def f(x=1):\n pass", "c.bin": "no", "sub/d.txt": "deep", "bad.md": b"\xff\xfe\xff"})

    def run():
        wa.watch(wa.watch_folder(spark, src), out, AS_OF, wing="w", vectors_path=vec, errors_path=err, available_now=True).awaitTermination()
        return {r.room: r.content for r in read_current(spark, out, ["id"]).collect()}

    assert run() == {"a": "first", "b": "fn:f(x)\n pass", "d": "deep"}
    assert run() == {"a": "first", "b": "fn:f(x)\n pass", "d": "deep"}
    write(tmp_path / "in", {"e.md": "new and late"})
    assert run()["e"] == "new & late"
    assert read_current(spark, vec, ["id"]).count() == 4
    assert [r.reason for r in read_current(spark, err, ["path"]).collect()] == ["not text"]

    # A file changed in place is found by the batch comparison and replaces its drawer.
    write(tmp_path / "in", {"a.md": "the second"})
    os.utime(f"{src}/a.md", (2_000_000_000, 2_000_000_000))
    listing = wa.watched_text(fi.scan_files(spark, src))
    old = listing.select("path", F.when(F.col("path").endswith("a.md"), F.lit("2020-01-01").cast("timestamp")).otherwise(F.col("mtime")).alias("mtime"))
    changed = wa.changed_files(listing, old)
    assert [r.path for r in changed.collect()] == [f"{src}/a.md"]
    for _ in range(2):
        wa.ingest_batch(changed, "rescan-1", out, vec, err, AS_OF, "w")
    assert {r.room: r.content for r in read_current(spark, out, ["id"]).collect()} == {"a": "second", "b": "fn:f(x)\n pass", "d": "deep", "e": "new & late"}


def test_watch_conversations(spark, exports, tmp_path):
    out, err = str(tmp_path / "d"), str(tmp_path / "e")
    stream = wa.watch_folder(spark, exports)
    wa.watch(stream, out, AS_OF, mode="convos", errors_path=err, available_now=True).awaitTermination()
    assert [r.content for r in read_current(spark, out, ["id"]).where("room = 'c'").collect()] == ["first part\nsecond part"]
    reasons = {r.path.rsplit("/", 1)[1] for r in read_current(spark, err, ["path"]).collect()}
    assert {"o.json", "e.json", "x.txt", "nums.json"} <= reasons


def test_watch_conflicts(spark, tmp_path):
    from test_triples import table

    src = write(tmp_path / "in", {"a.md": "Soren finished auth.", "b.md": "Maya finished auth."})
    out = str(tmp_path / "c")
    triples = table(spark, ("Maya", "assigned_to", "auth"))
    wa.watch_conflicts(wa.watch_folder(spark, src), triples, AS_OF, out, available_now=True).awaitTermination()
    assert [(r.path, r.person) for r in read_current(spark, out, ["path", "person"]).collect()] == [(f"{src}/a.md", "Soren")]


def test_import_of_a_file_store(spark, tmp_path):
    from memlake.sources import stored as sd

    drawer = {"content": "c", "wing": "w", "room": "r", "hall": "facts", "timestamp": "2024-01-01T00:00:00+00:00", "pinned": True,
              "decay_weight": 1.0, "id": "d1", "tags": ["t"]}
    root = write(tmp_path / "store", {
        "w/wing.json": json.dumps({"name": "w", "created": "2024-01-01", "description": "x"}),
        "w/r/room.json": json.dumps({"name": "r", "wing": "w", "created": "bad"}),
        "w/r/facts/d1.json": json.dumps(drawer, indent=2), "w/r/facts/d2.json": "{broken", "w/r/facts/d3.json": json.dumps({"content": "no place"}),
        "w/r/facts/closet.es": "short", "w/tunnels.json": json.dumps([{"room": "r", "source_wing": "w", "target_wing": "v", "created": ""}, {"room": "x"}]),
        "v/tunnels.json": "oops", "_odd/r/facts/d4.json": json.dumps({**drawer, "id": "d4", "wing": "_odd"}),
    })
    files = sd.read_store(spark, root)
    assert sorted((r.id, r.wing, r.pinned, r.tags[0]) for r in sd.drawers_from(files).collect()) == [("d1", "w", True, "t"), ("d4", "_odd", True, "t")]
    assert [(r.wing, r.room, r.hall, r.content) for r in sd.closets_from(files).collect()] == [("w", "r", "facts", "short")]
    assert [(r.room, r.target_wing) for r in sd.tunnels_from(files).collect()] == [("r", "v")]
    assert [(r.name, r.description) for r in sd.wings_from(files).collect()] == [("w", "x")]
    assert [(r.name, r.wing, r.created) for r in sd.rooms_from(files).collect()] == [("r", "w", None)]
    lines = spark.createDataFrame([('{"agent":"a","content":"x","timestamp":"2024-01-01","tags":[]}',), ("junk",), ('{"agent":"a"}',)], "value string")
    assert [(r.agent, r.content) for r in sd.diary_from(lines).collect()] == [("a", "x")]
    agents = write(tmp_path / "agents", {"a.json": '{"name":"a","focus":"f","other":1}', "a_diary.jsonl": "{}", "b.json": "junk"})
    assert [(r.name, r.focus, r.model_hint) for r in sd.agents_from(sd.read_store(spark, agents)).collect()] == [("a", "f", "")]


def test_times_that_cannot_be_read(spark):
    from memlake.functions import times

    texts = ["NaN", "Infinity", "-Infinity", "1e300", "junk", "", None, "1700000000.5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_micros(times.parse_epoch(F.col("t"))).alias("u"))
    assert [r.u for r in df.collect()] == [None] * 7 + [1_700_000_000_500_000]
    files = spark.createDataFrame([("a", 1, None)], "path string, length long, error string").withColumn("modificationTime", F.current_timestamp())
    assert fi.select_files(files, "not a time").count() == 1
    assert fi.select_files(files, "2999-01-01").count() == 0


# --- scanning folders and looking at them again

def test_scan_goes_on_after_errors(spark, tmp_path, monkeypatch):
    """Folders in several rounds, a link to nowhere, a file that vanishes after the listing, and an unknown store."""
    monkeypatch.setattr(fi, "_FOLDERS_PER_ROUND", 2)
    root = write(tmp_path / "in", {f"d{i}/e{i}/_f/{j}.md": f"text {i} {j}" for i in range(5) for j in range(3)} | {"top.md": "top", "build/x.md": "skipped", "gone.md": "gone"})
    os.symlink(f"{root}/nowhere", f"{root}/dangling.md")
    listed = fi.list_files(spark, root)
    os.remove(f"{root}/gone.md")
    rows = {r.path.removeprefix(root + "/"): r for r in fi.read_files(listed).collect()}
    assert len(rows) == 17 and bytes(rows["d3/e3/_f/1.md"].content) == b"text 3 1" and "build/x.md" not in rows
    assert {p for p, r in rows.items() if r.error} == {"gone.md"} and rows["gone.md"].content is None  # a link to nowhere is no file
    assert [r.error.split(":")[0] for r in fi.unreadable(fi.read_files(listed)).collect()] == ["FileNotFoundError"]
    assert fi.unreadable(fi.scan_files(spark, root)).count() == 0
    assert fi.scan_files(spark, f"{root}/top.md").first().content == b"top"
    assert not fi._is_known("viewfs://store/in") and fi._is_known(root)
    by_spark = fi._listed_by_spark(spark, f"file:{root}", ("build",))
    assert {r.path.rsplit("/", 1)[1] for r in by_spark.where("path like '%.md'").select("path").collect()} >= {"top.md"}


def test_unparsed_exports(spark, exports):
    assert {r.path.rsplit("/", 1)[1] for r in cv.unparsed(cv.scan_exports(spark, exports)).collect()} == {"broken.json"}


def test_looks_at_a_changing_folder(spark, tmp_path):
    root = write(tmp_path / "in", {"a.md": "the first", "b.md": "stays", "c.md": "goes", "d.bin": "not watched", "bad.md": b"\xff\xfe\xff"})
    state, out, vec, err = (str(tmp_path / n) for n in ("state", "drawers", "vectors", "errors"))

    def look(n):
        return wa.poll_folder(spark, root, state, f"look-{n}", n, out, vec, err, AS_OF, "w")

    def stored(table=out):
        return {r.room: r for r in read_current(spark, table, ["id"]).collect()}

    assert look(1) and {k: r.content for k, r in stored().items()} == {"a": "first", "b": "stays", "c": "goes"}
    assert not look(2)
    write(tmp_path / "in", {"a.md": "changed", "e.md": "late", "b.md": "   "})
    os.remove(f"{root}/c.md")
    for _ in range(2):  # a look that is done again replaces its own change sets
        assert look(3)
        assert {k: r.content for k, r in stored().items()} == {"a": "changed", "e": "late"}
        assert set(stored(vec)) == {"a", "e"}
        for f in (tmp_path / "state" / "changes" / "change=look-3").iterdir():
            f.unlink()
        (tmp_path / "state" / "changes" / "change=look-3").rmdir()
    assert [r.reason for r in read_current(spark, err, ["path"]).collect()] == ["not text"]
    # A file that comes back with an older time than its deletion is seen too.
    assert look(4)
    write(tmp_path / "in", {"c.md": "is back"}, 1_000_000_000)
    assert look(5) and stored()["c"].content == "is back"


def test_looks_take_vanished_messages_away(spark, tmp_path):
    talk = "**Human:** the first message is long enough\n**Assistant:** and so is the second message\n"
    root = write(tmp_path / "in", {"t.md": talk, "bad.json": "[1"})
    state, out = str(tmp_path / "state"), str(tmp_path / "drawers")

    def look(n):
        wa.poll_folder(spark, root, state, f"look-{n}", n, out, as_of=AS_OF, mode="convos")
        return sorted(r.content for r in read_current(spark, out, ["id"]).collect())

    assert len(look(1)) == 2
    write(tmp_path / "in", {"t.md": talk.split("**Assistant")[0]})
    assert look(2) == ["first message:long enough"]
    os.remove(f"{root}/t.md")
    assert look(3) == []


def test_watch_changes_runs_as_a_stream(spark, tmp_path):
    import time

    root = write(tmp_path / "in", {"a.md": "first"})
    state, out = str(tmp_path / "state"), str(tmp_path / "drawers")
    query = wa.watch_changes(spark, root, state, out, AS_OF, interval="1 second")
    try:
        for content in ("first", "second one"):
            write(tmp_path / "in", {"a.md": content})
            deadline = time.time() + 60
            while time.time() < deadline:
                try:
                    found = [r.content for r in read_current(spark, out, ["id"]).collect()]
                except Exception:  # nothing written yet, or being written
                    found = []
                if found == [content]:
                    break
                time.sleep(0.5)
            assert found == [content] and query.exception() is None
    finally:
        query.stop()


def test_few_small_paths_are_read_by_many_tasks(spark, tmp_path):
    root = write(tmp_path / "in", {f"d{i % 7}/f{i}.md": "x" * i for i in range(60)} | {"empty.md": ""})
    read = fi.read_files(fi.list_files(spark, root))
    rows = read.select("path", "length", "content", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 61 and all(len(r.content) == r.length for r in rows)
    assert len({r.task for r in rows}) > 3  # one before: Spark merges tasks by the bytes of the paths


def test_contents_are_handed_on_in_bounded_batches(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fi, "_BATCH_BYTES", 100)
    for i, size in enumerate((40, 40, 40, 300, 1, 0)):
        (tmp_path / f"f{i}").write_bytes(b"x" * size)
    listed = pa.RecordBatch.from_pylist([{"path": f"{tmp_path}/f{i}", "modificationTime": None, "length": 0, "error": None} for i in range(7)],
                                        schema=pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("error", pa.string())]))
    batches = list(fi._read_contents(iter([listed])))
    assert [[len(c) if c is not None else None for c in b.column("content").to_pylist()] for b in batches] == [[40, 40], [40], [300], [1, 0, None]]
    assert "FileNotFoundError" in batches[-1].column("error")[2].as_py()
