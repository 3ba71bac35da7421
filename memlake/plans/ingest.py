"""Ingest queries: files, exports, notes, issues, transcripts and the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions.shorthand import compress
from memlake.operators import store as st
from memlake.operators.tables import read_current, save_table, write_change
from memlake.plans import fixtures as fx
from memlake.plans.knowledge import CONTRADICTIONS
from memlake.plans.oracles import compressed, over, stripped
from memlake.plans.registry import query
from memlake.session import materialise, shared_folder
from memlake.sources import conversations as cv
from memlake.sources import entries as en
from memlake.sources import files as fi
from memlake.sources import large_exports as lx
from memlake.sources import notes as no
from memlake.sources import stored as sd
from memlake.sources import transcripts as tr
from memlake.streaming import watch as wa

_HALL = """CASE WHEN ext IN ('.py','.js','.ts','.tsx','.jsx','.go','.rs','.c','.cpp','.java','.rb','.php') THEN 'discoveries'
  WHEN ext IN ('.sh','.bash','.zsh') THEN 'advice' ELSE 'facts' END"""
_CLASSIFIED = f"""SELECT *, {_HALL} AS hall, ext IN ('.py','.js','.ts','.tsx','.jsx','.go','.rs','.c','.cpp','.java','.rb','.php') AS is_code
  FROM (SELECT *, regexp_extract(path, '(\\.[^./]+)$', 1) AS ext, split_part(path, '/', -2) AS room FROM fx_files)"""


# ---- files ----------------------------------------------------------------------------------------------------------

@query("files_classify", over("files", f"SELECT doc_id, ext, hall, is_code FROM ({_CLASSIFIED})"))
def files_classify(spark, sf_dir):
    return fi.classify(fx.files(spark, sf_dir)).select("doc_id", "ext", "hall", "is_code")


@query("files_since", over("files", """
SELECT doc_id FROM fx_files WHERE mtime >= TIMESTAMP '2023-08-01 06:00:00'"""))
def files_since(spark, sf_dir):
    files = fx.files(spark, sf_dir).withColumnRenamed("mtime", "modificationTime").withColumn("error", F.lit(None).cast("string"))
    return fi.select_files(files, "2023-08-01 06:00:00").select("doc_id")


@query("files_to_drawers", over("files", rf"""
SELECT substr(sha256(path), 1, 16) AS id, 'docs' AS wing, room, hall, md5({compressed('text')}) AS digest,
  concat(substr(ext, 2), ',file') AS tags
FROM ({_CLASSIFIED}) WHERE regexp_matches(text, '\S')"""))
def files_to_drawers(spark, sf_dir):
    return fi.files_to_drawers(fx.text_files(spark, sf_dir), fx.AS_OF, "docs").select(
        "id", "wing", "room", "hall", F.md5("content").alias("digest"), F.array_join("tags", ",").alias("tags")
    )


@query("file_vector_entries", over("files", r"""
SELECT substr(sha256(path), 1, 16) AS id, md5(text) AS digest, path, 'docs' AS wing, 384 AS dim
FROM fx_files WHERE regexp_matches(text, '\S')"""))
def file_vector_entries(spark, sf_dir):
    mined = fi.files_to_drawers(fx.text_files(spark, sf_dir), fx.AS_OF, "docs")
    return en.vector_entries(mined, extra=("path",)).select(
        "id", F.md5("text").alias("digest"), F.col("metadata")["path"].alias("path"),
        F.col("metadata")["wing"].alias("wing"), F.size("embedding").alias("dim"),
    )


def _places(spark, sf_dir) -> DataFrame:
    """The documents as files, some below a folder whose name starts with a dot, some below one that scans leave out."""
    doc = F.col("doc_id")
    top = F.when(doc % 13 == 0, F.lit("/node_modules")).when(doc % 10 == 0, F.lit("/.notes/_old")).otherwise(F.lit(""))
    files = fx.text_files(spark, sf_dir).withColumn("path", F.concat(top, F.replace("path", F.lit("/data/"), F.lit("/"))))
    return files.select("doc_id", "path", F.coalesce("text", F.lit("")).alias("text"))


_PLACES = """(SELECT doc_id, concat(CASE WHEN doc_id % 13 = 0 THEN '/node_modules' WHEN doc_id % 10 = 0 THEN '/.notes/_old' ELSE '' END,
  replace(path, '/data/', '/')) AS path, coalesce(text, '') AS text FROM fx_files)"""


def _below(root: str) -> Column:
    return F.replace("path", fi.plain_path(F.lit(root)), F.lit(""))


@query("scan_folder", over("files", f"""
SELECT path, strlen(text) AS length, md5(text) AS digest FROM {_PLACES} WHERE doc_id % 13 <> 0"""))
def scan_folder(spark, sf_dir):
    """Every document written as a file, the folder listed and read."""
    root = f"{shared_folder(spark)}/docs"
    fx.write_files(_places(spark, sf_dir), root)
    found = fi.scan_files(spark, root).where("error is null")
    return found.select(_below(root).alias("path"), "length", F.md5("content").alias("digest"))


@query("broken_exports", over("files", r"""
SELECT concat('/', doc_id, '.json') AS path, CASE WHEN doc_id % 11 = 0 THEN 'unreadable' WHEN doc_id % 7 = 0 THEN 'broken'
  WHEN doc_id % 5 = 0 THEN 'unknown' ELSE 'read' END AS state, CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN
  CASE WHEN regexp_matches(text, '\S') THEN 2 ELSE 1 END ELSE 0 END AS messages FROM fx_files"""))
def broken_exports(spark, sf_dir):
    """Documents written as exports of two messages; some are cut short, some are none, some vanish between listing and reading.  Each
    spoils only itself."""
    root = f"{shared_folder(spark)}/exports"
    doc = F.col("doc_id")
    message = F.concat(F.lit('{"text":'), _json(F.coalesce("text", F.lit(""))), F.lit(',"ts":"1","user":"u"}'))
    whole = F.concat(F.lit("["), message, F.lit(',{"text":"end","ts":"2","user":"u"}]'))
    text = F.when(doc % 7 == 0, F.substring(whole, F.lit(1), F.length(whole) - 9)).when(doc % 5 == 0, F.lit('{"turns":[]}')).otherwise(whole)
    files = fx.text_files(spark, sf_dir).select("doc_id", F.concat(F.lit("/"), doc.cast("string"), F.lit(".json")).alias("path"), text.alias("text"))
    fx.write_files(files, root)
    listed = fi.list_files(spark, root)
    fx.write_files(files.where(doc % 11 == 0).withColumn("text", F.lit(None).cast("string")), root)
    scanned = materialise(fi.read_files(listed).select("path", "error", fi.decode_text(F.col("content")).alias("text")))
    exports = scanned.where("error is null").select("path", "text")
    messages = cv.parse_exports(exports).groupBy("path").agg(F.count("*").alias("messages"))
    broken = cv.unparsed(exports).select("path", F.lit("broken").alias("said"))
    known = exports.select("path", F.when(cv.detect_format(F.col("path"), F.col("text")) == "unknown", "unknown").otherwise("read").alias("kind"))
    states = scanned.select("path", "error").join(broken, "path", "left").join(known, "path", "left").join(messages, "path", "left")
    return states.select(_below(root).alias("path"), F.when(F.col("error").isNotNull(), "unreadable").otherwise(F.coalesce("said", "kind")).alias("state"),
                         F.coalesce("messages", F.lit(0)).alias("messages"))


# ---- conversations --------------------------------------------------------------------------------------------------

@query("messages_to_drawers", over("turn_files", rf"""
SELECT substr(sha256(concat('["', file, '","', conv_id, '","', turn, '"]')), 1, 32) AS id, 'work' AS wing,
  regexp_extract(file, '([^/]+)$', 1) AS room, CASE WHEN role IN ('human','user') THEN 'facts' ELSE 'discoveries' END AS hall,
  md5({compressed('text')}) AS digest, concat('conversation,', role) AS tags
FROM fx_turn_files WHERE length(text) >= 20"""))
def messages_to_drawers(spark, sf_dir):
    turns = fx.turn_files(spark, sf_dir)
    messages = turns.select(
        F.col("file").alias("path"), F.col("conv_id").alias("convo_idx"), F.col("turn").alias("msg_idx"), "role", "text",
        F.lit(None).cast("timestamp").alias("ts"),
    )
    return cv.messages_to_drawers(messages, fx.AS_OF, "work").select(
        "id", "wing", "room", "hall", F.md5("content").alias("digest"), F.array_join("tags", ",").alias("tags")
    )


def _json(text: Column) -> Column:
    """A JSON string literal."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _export_files(spark, sf_dir) -> DataFrame:
    """Every conversation written as one export file of each format; a file has a fixed largest number of turns."""
    turn = F.col("t")["turn"]
    role, text = F.col("t")["role"], F.col("t")["text"]
    body = _json(text)
    seconds = (F.lit(1_690_848_000) + turn * 60).cast("string")
    claude = F.concat(
        F.lit('{"uuid":"x","sender":'), _json(role), F.lit(',"content":'),
        F.when(turn % 2 == 0, body).otherwise(F.concat(F.lit('[{"type":"text","text":'), body, F.lit('},"junk",{"type":"image"}]'))),
        F.lit(',"created_at":"'), F.date_format(F.timestamp_seconds(seconds.cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}'),
    )
    chatgpt = F.concat(
        F.lit('"n'), turn.cast("string"), F.lit('":{"message":{"author":{"role":'), _json(role),
        F.lit('},"content":{"parts":['), body, F.lit(',""]},"create_time":'), seconds, F.lit(".25}}"),
    )
    slack = F.concat(
        F.lit('{"text":'), body, F.lit(',"ts":"'), seconds, F.lit('.000100","'),
        F.when(turn % 2 == 0, F.lit("user")).otherwise(F.lit("username")), F.lit('":'), _json(role), F.lit("}"),
    )
    speaker = F.when(role == "user", "Human").when(role == "assistant", "CLAUDE").otherwise("user")
    markdown = F.concat(F.lit("**"), speaker, F.lit(":**\n\n"), text, F.lit("\n"))

    turns = fx.turn_files(spark, sf_dir).select("file", F.struct("turn", "role", "text").alias("t"))
    # At most TURNS_PER_FILE rows per file: (conv_id, turn) is unique.
    files = turns.select("file", "t", claude.alias("c"), chatgpt.alias("g"), slack.alias("s"), markdown.alias("m")).groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct(F.col("t.turn").alias("turn"), "c", "g", "s", "m"))).alias("ts")
    )
    column = lambda name, sep: F.array_join(F.transform("ts", lambda t: t[name]), sep)
    forms = {
        "claude.json": F.concat(F.lit('[{"name":"x","chat_messages":['), column("c", ","), F.lit("]}]")),
        "chatgpt.json": F.concat(F.lit('[{"mapping":{"root":{"message":null},'), column("g", ","), F.lit("}}]")),
        "slack.json": F.concat(F.lit("["), column("s", ","), F.lit("]")),
        "talk.md": column("m", ""),
        "other.json": F.concat(F.lit('{"turns":['), column("s", ","), F.lit("]}")),
    }
    whole = F.array(*[F.struct(F.lit(ending).alias("ending"), text.alias("text")) for ending, text in forms.items()])
    return files.select("file", F.inline(whole)).select(F.concat("file", F.lit("/"), "ending").alias("path"), "text")


@query("export_formats", over("turn_files", """
SELECT format, count(*) AS n FROM (SELECT DISTINCT file FROM fx_turn_files),
  (VALUES ('claude'), ('chatgpt'), ('slack'), ('markdown'), ('unknown')) f(format) GROUP BY format"""))
def export_formats(spark, sf_dir):
    files = _export_files(spark, sf_dir)
    return files.groupBy(cv.detect_format(F.col("path"), F.col("text")).alias("format")).agg(F.count("*").alias("n"))


@query("json_exports", over("turn_files", rf"""
WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY turn) AS pos,
  TIMESTAMP '2023-08-01 00:00:00' + turn * INTERVAL '1' MINUTE AS said_at FROM fx_turn_files)
SELECT concat(file, '/', ending) AS path, format, 0 AS convo_idx, cast(pos + shift AS int) AS msg_idx,
  CASE WHEN format <> 'markdown' THEN role WHEN role = 'assistant' THEN 'assistant' ELSE 'human' END AS role,
  md5({stripped('text')}) AS digest, CASE WHEN format = 'markdown' THEN NULL ELSE epoch_us(said_at) + micros END AS at_micros
FROM numbered, (VALUES ('claude.json', 'claude', -1, 0), ('chatgpt.json', 'chatgpt', 0, 250000), ('slack.json', 'slack', -1, 100),
  ('talk.md', 'markdown', 0, 0)) f(ending, format, shift, micros) WHERE regexp_matches(text, '\S')"""))
def json_exports(spark, sf_dir):
    """All four parsers over exports generated from every conversation give the conversations back."""
    return cv.parse_exports(_export_files(spark, sf_dir)).select(
        "path", "format", "convo_idx", "msg_idx", "role", F.md5("text").alias("digest"), F.unix_micros("ts").alias("at_micros")
    )


_TURNS = """WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY turn) AS pos, dense_rank() OVER (ORDER BY file) - 1 AS place,
  row_number() OVER (ORDER BY file, turn) - 1 AS n, TIMESTAMP '2023-08-01 00:00:00' + turn * INTERVAL '1' MINUTE AS said_at FROM fx_turn_files)"""


@query("json_exports_split", over("turn_files", rf"""{_TURNS}
SELECT concat(file, '/', ending) AS path, format, 0 AS convo_idx, cast(pos + shift AS int) AS msg_idx, role,
  md5({stripped('text')}) AS digest, epoch_us(said_at) + micros AS at_micros
FROM numbered, (VALUES ('claude.json', 'claude', -1, 0), ('chatgpt.json', 'chatgpt', 0, 250000), ('slack.json', 'slack', -1, 100)) f(ending, format, shift, micros)
WHERE regexp_matches(text, '\S')"""))
def json_exports_split(spark, sf_dir):
    """The JSON exports of all conversations as files, read in ranges of 700 bytes: the same messages as of whole files."""
    root = f"{shared_folder(spark)}/exports"
    fx.write_files(_export_files(spark, sf_dir).select(F.replace("path", F.lit("/exports/"), F.lit("/")).alias("path"), "text"), root)
    messages, _ = lx.split_exports(spark, root, range_bytes=700)
    return messages.select(F.concat(F.lit("/exports"), _below(root)).alias("path"), "format", "convo_idx", "msg_idx", "role", F.md5("text").alias("digest"),
                           F.unix_micros("ts").alias("at_micros"))


@query("json_exports_large", over("turn_files", rf"""{_TURNS}
SELECT format, cast(CASE WHEN format = 'slack' THEN 0 ELSE place END AS int) AS convo_idx,
  cast(CASE format WHEN 'slack' THEN n WHEN 'claude' THEN pos - 1 ELSE pos END AS int) AS msg_idx, role, md5({stripped('text')}) AS digest
FROM numbered, (VALUES ('claude'), ('chatgpt'), ('slack')) f(format) WHERE regexp_matches(text, '\S')"""))
def json_exports_large(spark, sf_dir):
    """One file of each format that holds all conversations, read by many tasks."""
    root = f"{shared_folder(spark)}/large"
    files = _export_files(spark, sf_dir).withColumn("text", F.substring("text", F.lit(2), F.length("text") - 2))
    for name in ("claude", "chatgpt", "slack"):
        own = files.where(F.col("path").endswith(f"/{name}.json"))
        fx.write_joined(own.repartitionByRange(1, "path").sortWithinPartitions("path"), f"{root}/{name}.json")
    messages, _ = lx.split_exports(spark, root, range_bytes=1 << 16)
    return messages.select("format", "convo_idx", "msg_idx", "role", F.md5("text").alias("digest"))


@query("split_transcripts", over("turn_files", rf"""
WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY turn) AS pos, count(*) OVER (PARTITION BY file) AS n FROM fx_turn_files)
SELECT concat(file, '.md') AS path, cast(pos AS int) AS part_no, md5({stripped('text')}) AS digest,
  concat(regexp_extract(file, '([^/]+)$', 1), '_', pos, '.md') AS name FROM numbered WHERE n > 1 AND regexp_matches(text, '\S')"""))
def split_transcripts(spark, sf_dir):
    return tr.split_transcripts(_joined_turns(spark, sf_dir)).select("path", "part_no", F.md5("text").alias("digest"), "name")


@query("split_dry_run", over("turn_files", """
SELECT concat(file, '.md') AS path, cast(count(*) AS int) AS parts FROM fx_turn_files GROUP BY file HAVING count(*) > 1"""))
def split_dry_run(spark, sf_dir):
    return tr.count_parts(_joined_turns(spark, sf_dir))


def _joined_turns(spark, sf_dir) -> DataFrame:
    turns = fx.turn_files(spark, sf_dir).groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("ts")  # at most TURNS_PER_FILE
    )
    rules = F.array(F.lit("\n---\n"), F.lit("\n======  \n"), F.lit("\n-----\t\n"))
    parts = F.transform("ts", lambda t: F.concat(
        F.when(t["turn"] == F.col("ts")[0]["turn"], F.lit("")).otherwise(F.element_at(rules, (t["turn"] % 3 + 1).cast("int"))), t["text"]
    ))
    return turns.select(F.concat("file", F.lit(".md")).alias("path"), F.array_join(parts, "").alias("text"))


@query("text_sniff", over("files", """
SELECT doc_id, CASE WHEN doc_id % 8 = 4 AND doc_id % 3 = 1 THEN 'a.png' ELSE 'a.txt' END AS name,
  NOT (doc_id % 3 = 1 AND doc_id % 8 = 4) AND doc_id % 5 <> 2 AS is_text FROM fx_files"""))
def text_sniff(spark, sf_dir):
    """Documents as bytes: some named as images, some with bytes that are no text at their beginning, others only far behind it."""
    doc = F.col("doc_id")
    name = F.when((doc % 8 == 4) & (doc % 3 == 1), F.lit("a.png")).otherwise(F.lit("a.txt"))
    body = F.coalesce("text", F.lit("")).cast("binary")
    padding = F.concat(F.lit("x"), F.repeat(F.lit("é"), F.lit(300))).cast("binary")  # the 512th byte is the first one of a character
    junk = F.unhex(F.lit("FFFEFF"))
    content = F.when(doc % 5 == 2, F.concat(junk, body)).when(doc % 5 == 3, F.concat(padding, junk, body)).otherwise(body)
    return fx.text_files(spark, sf_dir).select("doc_id", name.alias("name"), fi.looks_like_text(name, content).alias("is_text"))


@query("vector_metadata", over("files", rf"""
SELECT substr(sha256(path), 1, 16) AS id, concat('["', substr(ext, 2), '","file"]') AS tags, cast(is_code AS varchar) AS code, room
FROM ({_CLASSIFIED}) WHERE regexp_matches(text, '\S')"""))
def vector_metadata(spark, sf_dir):
    """Metadata of vector entries is text; a list of tags is JSON."""
    mined = fi.files_to_drawers(fx.text_files(spark, sf_dir), fx.AS_OF, "docs").withColumn("code", F.col("hall") == "discoveries")
    entries = en.vector_entries(mined, extra=("tags", "code"))
    meta = F.col("metadata")
    return entries.select("id", meta["tags"].alias("tags"), meta["code"].alias("code"), meta["room"].alias("room"))


# ---- notes, pages, issues -------------------------------------------------------------------------------------------

def _notes(spark, sf_dir) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    heading = F.concat(F.lit("---\nname: Note "), doc, F.lit("\ntags: [doc, "), "lang", F.lit("]\ncreated: 2023-11-05T10:00:00\n---\n\n"))
    noted = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(heading, "text"))
    docs = fx.documents(spark, sf_dir)
    return fx.files_of(docs, "lang").select(
        F.concat(F.lit("/vault/n"), doc, F.lit(".md")).alias("path"), F.col("mtime").cast("timestamp").alias("mtime"), noted.alias("text")
    )


@query("vault_notes", over("files", rf"""
SELECT concat('n', f.doc_id) AS title, md5({stripped('f.text')}) AS digest,
  CASE WHEN f.doc_id % 3 = 0 THEN epoch_us(mtime) ELSE epoch_us(TIMESTAMP '2023-11-05 10:00:00') END AS at_micros,
  CASE WHEN f.doc_id % 3 = 0 THEN '[]' ELSE concat('["doc","', lang, '"]') END AS tags,
  CASE WHEN f.doc_id % 3 = 0 THEN NULL ELSE concat('Note ', f.doc_id) END AS name
FROM fx_files f JOIN documents d ON d.doc_id = f.doc_id WHERE regexp_matches(f.text, '\S')"""))
def vault_notes(spark, sf_dir):
    meta = F.col("metadata")
    return no.parse_notes(_notes(spark, sf_dir)).select(
        meta["title"].alias("title"), F.md5("content").alias("digest"), F.unix_micros("ts").alias("at_micros"),
        meta["tags"].alias("tags"), meta["name"].alias("name"),
    )


@query("vault_tags_filter", r"""
SELECT concat('n', doc_id) AS title FROM documents WHERE doc_id % 3 <> 0 AND lang IN ('fr', 'de') AND regexp_matches(text, '\S')""")
def vault_tags_filter(spark, sf_dir):
    return no.parse_notes(_notes(spark, sf_dir), ["fr", "de"]).select(F.col("metadata")["title"].alias("title"))


@query("page_export", rf"""
SELECT concat('p', page_id) AS title, md5({stripped('html')}) AS digest FROM pages WHERE regexp_matches(html, '\S')""")
def page_export(spark, sf_dir):
    pages = fx.pages(spark, sf_dir).select(
        F.concat(F.lit("/export/p"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"),
        F.lit(fx.BASE).cast("timestamp").alias("mtime"), F.col("html").alias("text"),
    )
    return no.parse_pages(pages).select(F.col("metadata")["title"].alias("title"), F.md5("content").alias("digest"))


def _issues(spark, sf_dir) -> DataFrame:
    doc = F.col("doc_id")
    state = F.when(doc % 2 == 0, F.concat(F.lit('{"name":'), _json(F.col("lang")), F.lit("}"))).otherwise(_json(F.col("lang")))
    assignee = F.when(doc % 3 == 0, F.lit("null")).otherwise(F.concat(F.lit('{"name":'), _json(F.col("source")), F.lit("}")))
    issue = F.concat(
        F.lit('{"id":"I-'), doc.cast("string"), F.lit('","title":"Issue '), doc.cast("string"), F.lit('","description":'),
        _json(F.col("text")), F.lit(',"state":'), state, F.lit(',"assignee":'), assignee,
        F.when(doc % 2 == 0, F.lit(',"createdAt":"2023-10-01T08:00:00Z"')).otherwise(F.lit(',"updatedAt":"2023-10-02T08:00:00.000Z"')),
        F.lit("}"),
    )
    wrapped = F.when(doc % 5 == 0, F.concat(F.lit('{"issues":['), issue, F.lit("]}"))).otherwise(F.concat(F.lit("["), issue, F.lit("]")))
    return fx.documents(spark, sf_dir).select(
        F.concat(F.lit("/issues/i"), doc.cast("string"), F.lit(".json")).alias("path"), wrapped.alias("text")
    )


_ISSUE_TEXT = """concat('Title: Issue ', doc_id, CASE WHEN text = '' THEN '' ELSE concat(chr(10), 'Description: ', substr(text, 1, 500)) END,
  chr(10), 'Status: ', lang, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat(chr(10), 'Assignee: ', source) END)"""


@query("issue_export", f"""
SELECT concat('I-', doc_id) AS id, md5({_ISSUE_TEXT}) AS digest,
  CASE WHEN doc_id % 2 = 0 THEN epoch_us(TIMESTAMP '2023-10-01 08:00:00') ELSE epoch_us(TIMESTAMP '2023-10-02 08:00:00') END AS at_micros,
  lang AS status, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS assignee FROM documents""")
def issue_export(spark, sf_dir):
    meta = F.col("metadata")
    return no.parse_issues(_issues(spark, sf_dir)).select(
        meta["id"].alias("id"), F.md5("content").alias("digest"), F.unix_micros("ts").alias("at_micros"),
        meta["status"].alias("status"), meta["assignee"].alias("assignee"),
    )


@query("documents_to_drawers", rf"""
SELECT room, digest, tags FROM (
  SELECT concat('p', page_id) AS room, md5({stripped('html')}) AS digest, 'plugin,notion' AS tags
  FROM pages WHERE regexp_matches(html, '\S')
  UNION ALL SELECT 'unknown', md5({_ISSUE_TEXT}), 'plugin,linear' FROM documents)""")
def documents_to_drawers(spark, sf_dir):
    pages = fx.pages(spark, sf_dir).select(
        F.concat(F.lit("/export/p"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"),
        F.lit(fx.BASE).cast("timestamp").alias("mtime"), F.col("html").alias("text"),
    )
    both = no.documents_to_drawers(no.parse_pages(pages), "notion", fx.AS_OF).unionByName(
        no.documents_to_drawers(no.parse_issues(_issues(spark, sf_dir)), "linear", fx.AS_OF)
    )
    return both.select("room", F.md5("content").alias("digest"), F.array_join("tags", ",").alias("tags"))


@query("reader_registry", rf"""
SELECT reader, title, digest FROM (
  SELECT 'obsidian' AS reader, concat('n', doc_id) AS title, md5({stripped('text')}) AS digest FROM documents WHERE regexp_matches(text, '\S')
  UNION ALL SELECT 'notion', concat('p', page_id), md5({stripped('html')}) FROM pages WHERE regexp_matches(html, '\S'))""")
def reader_registry(spark, sf_dir):
    """Notes and pages written as files and read by the name of their reader."""
    folder = shared_folder(spark)
    notes = _notes(spark, sf_dir).select(F.replace("path", F.lit("/vault/"), F.lit("/")).alias("path"), "text").where("text is not null")
    pages = fx.pages(spark, sf_dir).select(F.concat(F.lit("/p"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.coalesce("html", F.lit("")).alias("text"))
    fx.write_files(notes, f"{folder}/vault")
    fx.write_files(pages, f"{folder}/export")
    read = [no.get_reader(name)(spark, f"{folder}/{place}").select(F.lit(name).alias("reader"), F.col("metadata")["title"].alias("title"), F.md5("content").alias("digest"))
            for name, place in (("obsidian", "vault"), ("notion", "export"))]
    return read[0].unionByName(read[1])


@query("notes_edited", rf"""
SELECT concat('n', doc_id) AS room, md5(concat('edited ', {stripped('text')})) AS digest, cast(count(*) OVER () AS bigint) AS total
FROM documents WHERE regexp_matches(text, '\S')""")
def notes_edited(spark, sf_dir):
    """Notes saved as drawers and saved again after an edit: the same drawers, with the new text."""
    notes = no.parse_notes(_notes(spark, sf_dir))
    first = no.documents_to_drawers(notes, "obsidian", fx.AS_OF)
    second = no.documents_to_drawers(notes.withColumn("content", F.concat(F.lit("edited "), "content")), "obsidian", fx.AS_OF)
    merged = st.upsert(first, second, ["id"])
    return merged.select("room", F.md5("content").alias("digest"), merged.agg(F.count("*")).scalar().alias("total"))


# ---- changing tables and the stream ---------------------------------------------------------------------------------

@query("table_merge_on_read", over("drawers", """
SELECT id, wing, hall, CASE WHEN role = 'assistant' THEN concat('v2 ', content) ELSE content END AS content
FROM fx_drawers WHERE hall <> 'misc'"""))
def table_merge_on_read(spark, sf_dir):
    """Save a partitioned table, write two change sets (the second one twice) and a deletion, read the merged state."""
    path = f"{shared_folder(spark)}/drawers"
    drawers = fx.drawers(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    save_table(drawers, path, ["wing", "hall"], ["room", "id"])
    said = drawers.where(F.col("role") == "assistant")
    for version in (1, 2, 2):
        newer = said.withColumn("content", F.concat(F.lit(f"v{version} "), "content"))
        write_change(newer, path, f"batch-{version}", F.lit(version))
    write_change(drawers.where(F.col("hall") == "misc"), path, "batch-3", F.lit(3), deleted=F.lit(True))
    return read_current(spark, path, ["id"], drawers.schema).select("id", "wing", "hall", "content")


@query("watch_ingest", over("files", rf"""
SELECT substr(sha256(path), 1, 16) AS id, 'watched' AS wing, regexp_extract(path, '([^/]+)\.[^./]+$', 1) AS room, hall,
  md5({compressed('text')}) AS digest
FROM ({_CLASSIFIED}) WHERE regexp_matches(text, '\S')"""))
def watch_ingest(spark, sf_dir):
    """The documents table read as a stream of files and ingested, twice; the second run finds nothing new."""
    path = f"{shared_folder(spark)}/drawers"
    for _ in range(2):
        arriving = fx.files_of(fx.table_stream(spark, sf_dir, "documents")).select("path", "mtime", "length", "text", F.lit(True).alias("is_text"))
        wa.watch(arriving, path, fx.AS_OF, wing="watched", available_now=True).awaitTermination()
    return read_current(spark, path, ["id"]).select("id", "wing", "room", "hall", F.md5("content").alias("digest"))


@query("watch_burst", over("files", rf"""
SELECT substr(sha256(path), 1, 16) AS id, 1 + cast(doc_id % 4 = 0 AS int) AS versions, md5({compressed("CASE WHEN doc_id % 4 = 0 THEN concat(text, ' again') ELSE text END")}) AS digest
FROM fx_files WHERE regexp_matches(text, '\S')"""))
def watch_burst(spark, sf_dir):
    """Every file reported four times within minutes, one in four changed on the way: each text is written once."""
    path = f"{shared_folder(spark)}/drawers"
    doc = F.col("doc_id")
    events = fx.files_of(fx.table_stream(spark, sf_dir, "documents")).withColumn("n", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    text = F.when((doc % 4 == 0) & (F.col("n") >= 2), F.concat("text", F.lit(" again"))).otherwise(F.col("text"))
    later = F.timestamp_micros(F.unix_micros(F.col("mtime").cast("timestamp")) + F.col("n") * 60_000_000)
    arriving = events.select("path", later.alias("mtime"), "length", text.alias("text"), F.lit(True).alias("is_text"), "doc_id")

    changed = (doc % 4 == 0) & F.col("text").endswith(" again")

    def in_order(batch, number):  # within one batch only the newest state of a path would be taken
        for part, wanted in enumerate((~changed, changed)):
            wa.ingest_batch(batch.where(wanted), f"batch-{number}-{part}", path, None, None, fx.AS_OF, "w")

    writer = wa.without_repeats(arriving, "1 hour").writeStream.foreachBatch(in_order).option("checkpointLocation", f"{path}/_checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    versions = spark.read.parquet(f"{path}/changes").groupBy("id").agg(F.count("*").cast("int").alias("versions"))
    current = read_current(spark, path, ["id"]).select("id", F.md5("content").alias("digest"))
    return versions.join(current, "id")


_WATCHED_TEXT = "CASE doc_id % 4 WHEN 0 THEN concat(text, ' and more of it') WHEN 1 THEN substr(text, 1, 10) ELSE text END"


@query("watch_modified", over("files", rf"""
SELECT doc_id, md5({compressed('changed')}) AS digest, CASE WHEN doc_id % 6 = 5 OR doc_id % 4 IN (0, 1) THEN 2 ELSE 1 END AS looks FROM (
  SELECT doc_id, coalesce(text, '') AS text, coalesce({_WATCHED_TEXT}, '') AS changed FROM fx_files)
WHERE doc_id % 4 <> 2 AND regexp_matches(changed, '\S')"""))
def watch_modified(spark, sf_dir):
    """A folder looked at three times.  After the first look files are added, lengthened, shortened and deleted; the third finds nothing.
    ``looks`` tells which look gave the stored version."""
    folder = shared_folder(spark)
    root, doc = f"{folder}/in", F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    docs = fx.text_files(spark, sf_dir).select("doc_id", F.concat(F.lit("/"), doc.cast("string"), F.lit(".md")).alias("path"), text.alias("text"))
    changed = F.when(doc % 4 == 0, F.concat("text", F.lit(" and more of it"))).when(doc % 4 == 1, F.substring("text", 1, 10)).when(
        doc % 4 == 2, F.lit(None).cast("string")).otherwise(F.col("text"))
    look = lambda n: wa.poll_folder(spark, root, f"{folder}/state", f"look-{n}", n, f"{folder}/drawers", f"{folder}/vectors", as_of=fx.AS_OF)
    late = doc % 6 == 5
    fx.write_files(docs.where(~late | (doc % 4 == 2)), root)
    look(1)
    fx.write_files(docs.select("doc_id", "path", changed.alias("text")).where(late | (doc % 4 != 3)), root)
    look(2)
    if look(3):
        raise ValueError("a look at an unchanged folder found changes")
    stored = spark.read.parquet(f"{folder}/drawers/changes").groupBy("id").agg(F.max("_seq").cast("int").alias("looks"))
    current = read_current(spark, f"{folder}/drawers", ["id"])
    kept = read_current(spark, f"{folder}/vectors", ["id"]).select("id")  # both tables lose the same rows
    return current.join(kept, "id", "left_semi").join(stored, "id").select(F.col("room").cast("long").alias("doc_id"), F.md5("content").alias("digest"), "looks")


# ---- adding and importing memories ----------------------------------------------------------------------------------

@query("memories_add", f"""
SELECT substr(sha256(concat('["default","general","facts",', q, ']')), 1, 32) AS id, wing, room, hall, digest, pinned FROM (
  SELECT to_json(text) AS q, 'default' AS wing, 'general' AS room, 'facts' AS hall, md5({compressed('text')}) AS digest, false AS pinned
  FROM benchmark)""")
def memories_add(spark, sf_dir):
    texts = fx.table(spark, sf_dir, "benchmark").select(F.col("text").alias("content"))
    return st.add_memories(texts, fx.AS_OF, compress).select("id", "wing", "room", "hall", F.md5("content").alias("digest"), "pinned")


@query("drawer_json_import", over("drawers", """
SELECT id, wing, room, hall, content, epoch_us(ts) AS at_micros, pinned, 'a,b' AS tags FROM fx_drawers WHERE hall <> 'misc'"""))
def drawer_json_import(spark, sf_dir):
    """Every drawer written as its JSON file and read back; those of the unknown hall are cut short and so malformed."""
    drawers = fx.drawers(spark, sf_dir)
    record = F.to_json(F.struct(
        "content", "wing", "room", "hall", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"), "pinned",
        F.lit(1.0).alias("decay_weight"), "id", F.array(F.lit("a"), F.lit("b")).alias("tags"),
    ))
    whole = F.when(F.col("hall") == "misc", F.substring(record, F.lit(1), F.length(record) - 5)).otherwise(record)
    files = drawers.select(F.concat_ws("/", F.lit("/store"), "wing", "room", "hall", F.concat("id", F.lit(".json"))).alias("path"), whole.alias("text"))
    return sd.drawers_from(files).select(
        "id", "wing", "room", "hall", "content", F.unix_micros("ts").alias("at_micros"), "pinned", F.array_join("tags", ",").alias("tags")
    )


@query("watch_conflicts", over("claims assignments", f"""WITH {CONTRADICTIONS}
SELECT claim_id, id AS stored_id FROM found"""))
def watch_conflicts(spark, sf_dir):
    """Claims arriving as a stream, checked against the stored assignments."""
    path = f"{shared_folder(spark)}/conflicts"
    arriving = fx.claims_of(fx.table_stream(spark, sf_dir, "orders")).select(
        "claim_id", F.concat(F.lit("/notes/"), F.col("claim_id").cast("string")).alias("path"),
        F.lit(fx.AS_OF).cast("timestamp").alias("mtime"), "text", F.lit(True).alias("is_text"),
    )
    stored = fx.assignments(spark, sf_dir)
    wa.watch_conflicts(arriving, stored, fx.AS_OF, path, available_now=True).awaitTermination()
    found = read_current(spark, path, ["path", "verb", "claim_no", "stored_id"])
    return found.select(F.substring("path", 8, 20).cast("long").alias("claim_id"), "stored_id")
