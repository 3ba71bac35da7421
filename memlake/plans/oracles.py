"""The fixture views of ``fixtures.py`` as SQL, for the side-by-side check."""

from __future__ import annotations

from memlake.functions.shorthand import SYMBOLS

AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"

VIEWS = {
    "drawers": """
SELECT concat(cast(conv_id AS varchar), '-', cast(turn AS varchar)) AS id,
  concat('w', cast(conv_id % 7 AS varchar)) AS wing, concat('r', cast(conv_id % 23 AS varchar)) AS room,
  CASE WHEN (conv_id * 7 + turn) % 41 = 0 THEN 'misc' WHEN role IN ('human','user') THEN 'facts' ELSE 'discoveries' END AS hall,
  text AS content, role,
  TIMESTAMP '2023-08-01 00:00:00' + (((conv_id % 7) * 28 + conv_id % 10) * 1440 + turn) * INTERVAL '1' MINUTE AS ts,
  (conv_id * 13 + turn) % 17 = 0 AS pinned
FROM conversations""",
    "tunnels": """
SELECT DISTINCT room, wing AS source_wing,
  concat('w', cast((cast(substr(wing, 2) AS int) + 1) % 7 AS varchar)) AS target_wing
FROM fx_drawers WHERE cast(substr(room, 2) AS int) % 5 = 0""",
    "closets": """
SELECT wing, room, hall, min(content) AS content, max(ts) AS updated
FROM fx_drawers WHERE cast(substr(room, 2) AS int) % 3 <> 0 AND hall <> 'misc' GROUP BY wing, room, hall""",
    "triples": """
SELECT event_id AS id, concat('u', cast(user_id AS varchar)) AS subject, event_type AS predicate,
  concat('k', regexp_extract(props, '([0-9]+)', 1)) AS object,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE ts END AS valid_from,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + (event_id % 15 + 1) * INTERVAL '1' DAY END AS valid_until,
  cast(1 + event_id % 4 AS double) / 4 AS confidence, 'event' AS source
FROM events""",
    "vectors": """
SELECT concat('v', cast(vec_id AS varchar)) AS id, concat('w', cast(label % 7 AS varchar)) AS wing,
  concat('r', cast(vec_id % 23 AS varchar)) AS room,
  CASE vec_id % 5 WHEN 0 THEN 'facts' WHEN 1 THEN 'events' WHEN 2 THEN 'discoveries' WHEN 3 THEN 'preferences' ELSE 'advice' END AS hall,
  TIMESTAMP '2023-08-01 00:00:00' + ((vec_id % 500) * 8) * INTERVAL '1' HOUR AS ts,
  vec_id % 17 = 0 AS pinned, label, cast(embedding AS double[]) AS embedding
FROM embeddings""",
    "queries": """
SELECT label AS query_id, list(x ORDER BY pos) AS embedding FROM (
  SELECT label, pos, round(avg(x), 9) AS x FROM (
    SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(cast(embedding AS double[])) AS x FROM embeddings
  ) GROUP BY label, pos) GROUP BY label""",
    "files": """
SELECT doc_id, concat('/data/', source, '/', lang, '/f', cast(doc_id AS varchar),
    CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.txt' WHEN 3 THEN '.sh' WHEN 4 THEN '.json' WHEN 5 THEN '.go' WHEN 6 THEN '.log' ELSE '.rst' END) AS path,
  TIMESTAMP '2023-08-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS mtime, n_chars AS length, text
FROM documents""",
    "assignments": """
SELECT o_orderkey AS id, concat('Clerk', cast(o_custkey % 50 AS varchar)) AS subject, 'assigned_to' AS predicate,
  concat('task-', cast(o_orderkey AS varchar)) AS object, o_orderdate AS valid_from,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '30' DAY ELSE NULL END AS valid_until
FROM orders""",
    "claims": """
SELECT o_orderkey AS claim_id, concat('Clerk', cast((o_custkey + o_orderkey % 2) % 50 AS varchar), ' finished the task-',
  cast(o_orderkey AS varchar), '. Then rest.') AS text FROM orders""",
    "diary": """
SELECT role AS agent, content, ts, id FROM fx_drawers""",
    "rooms": """
SELECT DISTINCT wing, room FROM fx_drawers""",
    "turn_files": """
SELECT *, concat('/exports/c', cast(conv_id AS varchar), '_', cast(turn // 16 AS varchar)) AS file FROM conversations""",
}

# Views that read another view.
_NEEDS = {"tunnels": ["drawers"], "closets": ["drawers"], "diary": ["drawers"], "rooms": ["drawers"]}

ACTIVE = f"(valid_from IS NULL OR valid_from <= {AS_OF}) AND (valid_until IS NULL OR valid_until >= {AS_OF})"


def over(views: str, sql: str) -> str:
    """``sql`` with the named fixture views (``fx_<name>``) in front of it."""
    ordered: list[str] = []
    for name in views.split():
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    ctes = ",\n".join(f"fx_{name} AS ({VIEWS[name]})" for name in ordered)
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"


def compressed(expr: str) -> str:
    """The shorthand of a text expression as nested SQL replacements."""
    for word, symbol in SYMBOLS:
        expr = f"regexp_replace({expr}, '{word}', '{symbol}', 'gi')"
    expr = rf"regexp_replace({expr}, '[ \t]{{2,}}', ' ', 'g')"
    expr = rf"regexp_replace({expr}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return stripped(expr)


def decompressed(expr: str) -> str:
    """Expansion of shorthand without diffs and function headers."""
    for word, symbol in reversed(SYMBOLS):
        if symbol:
            expr = f"replace({expr}, '{symbol}', '{word}')"
    return stripped(expr)


def stripped(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"
