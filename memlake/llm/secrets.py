"""Secret scans: known shapes, and sliding-window entropy over candidate strings with an allow-list."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.registry import query, table
from memlake.llm.words import bounded, small

#: Kinds in the order in which equal starts are listed.
KINDS = ["assign", "access", "hex", "entropy"]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
WINDOW = 20
#: Candidate strings: long enough for one window, and with a digit beside letters somewhere.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Character classes, the narrowest that holds a whole window counts: its least entropy in bits for a character.
CLASSES = [("hex", frozenset("0123456789abcdef"), 3.0), ("HEX", frozenset("0123456789ABCDEF"), 3.0),
           ("upper", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 3.4),
           ("alnum", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 3.7),
           ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 3.7)]
#: Candidates that are no secrets: only digits and marks, words joined by marks, paths of words with small numbers, UUIDs, fillers.
ALLOWED = [r"[0-9+/_=-]+", r"[A-Za-z]+(?:[+/_=-]+[A-Za-z]+)*[+/_=-]*", r"(?:[+/_=-]*[A-Za-z]+[0-9]{0,4})(?:[+/_=-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,4}))*[+/_=-]*",
           r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", r"(.)\1+"]
_COST = [0.0] + [n * log2(n) for n in range(1, WINDOW + 1)]


def entropy_runs(text: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches of ``text`` covered by windows whose entropy reaches that of their class.

    A window's entropy is ``log2(w) - sum(c * log2(c)) / w`` over its character counts ``c``; the sum, and how many of the window's
    characters each class holds, are kept up to date as one character enters and one leaves.  A window without both a digit and a
    letter never counts.
    """
    cost = _COST if window == WINDOW else [0.0] + [n * log2(n) for n in range(1, window + 1)]
    counts: dict[str, int] = {}
    held = [0] * len(CLASSES)
    digits = letters = 0
    total, top, runs = 0.0, log2(window), []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += cost[n + 1] - cost[n]
        counts[c] = n + 1
        digits += c.isdigit()
        letters += c.isalpha()
        for k, (_, members, _) in enumerate(CLASSES):
            held[k] += c in members
        if i + 1 < window:
            continue
        least = next((least for k, (_, _, least) in enumerate(CLASSES) if held[k] == window), None)
        if least is not None and digits and letters and top - total / window >= least:
            if runs and i + 1 - window <= runs[-1][1]:
                runs[-1] = (runs[-1][0], i + 1)
            else:
                runs.append((i + 1 - window, i + 1))
        out = text[i + 1 - window]
        n = counts[out]
        total += cost[n - 1] - cost[n]
        counts[out] = n - 1
        digits -= out.isdigit()
        letters -= out.isalpha()
        for k, (_, members, _) in enumerate(CLASSES):
            held[k] -= out in members
    return runs


def _digit_near(text: str, allowed: re.Pattern) -> Iterator[tuple[int, int]]:
    for m in _CANDIDATE.finditer(text):
        found = m.group()
        if not found.isalpha() and not allowed.fullmatch(found):
            yield m.start(), m.end()


def spans(text: str, allowed: re.Pattern) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of everything found, in order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for start, end in _digit_near(text, allowed):
        found += [(start + a, 3, start + b) for a, b in entropy_runs(text[start:end])]
    return sorted(found)


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scanner(allowed: list[str]):
    pattern = re.compile("|".join(f"(?:{a})" for a in allowed) if allowed else r"(?!)", re.A)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            at = batch.schema.get_field_index("_scanned")
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t, pattern)] if t else []
                     for t in batch.column(at).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _FOUND)], names=[*names, "spans"])

    return scan


def scan_secrets(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, allowed: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default doc_id) and ``spans``: array of (kind, start, end) in code points, end exclusive.

    Known shapes: ``assign`` (a name such as password, a sign and 12 or more characters), ``access`` (AKIA keys of 18 or more),
    ``hex`` (16 or more hexadecimal digits).  ``entropy``: windows of 20 characters over longer strings whose entropy reaches that
    of their character class, joined where they meet; candidates that one of ``allowed`` matches as a whole are left alone.
    Known shapes are found inside allowed strings too.

    A null or empty text has no spans; repeated rows are scanned each; texts of any length are scanned whole; other columns, also one
    called spans, are not looked at unless kept; an empty table gives no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    if "spans" in keep:
        raise ValueError("the result's own column is called spans")
    rows = bounded(docs).select(*keep, F.col(text).alias("_scanned"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    allowed_now = ALLOWED if allowed is None else allowed
    return rows.mapInArrow(_scanner(allowed_now), f"{kept + ', ' if kept else ''}spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, *, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``, overlapping ones by one; n_chars follows.  All rows and columns stay."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile("|".join(f"(?:{a})" for a in ALLOWED), re.A)
        for batch in small(batches):
            at = batch.schema.get_field_index("text")
            texts = [t if t is None else _redacted(t, spans(t, pattern), mark) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    cleaned = bounded(docs).mapInArrow(clean, docs.schema)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def _redacted(text: str, found: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def listed(kind_filter: list[str] | None = None):
    """Spans as ``kind:start:end``, joined by commas."""
    found = F.col("spans") if kind_filter is None else F.filter("spans", lambda s: s["kind"].isin(kind_filter))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op9_secrets")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir))
    counts = [F.size(F.filter(F.col("spans.kind"), F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(listed(KINDS[:3]), 256).alias("base_sha256"), listed().alias("spans"))
