"""JSON exports of any size: one file is many tasks, and a message that can't be parsed loses only itself.

``parse_exports`` takes whole files.  Here a file is cut into byte ranges.  A first pass counts each range's quotes and brackets; summed
up over the file they tell where strings and nested values are at every range's start.  A second pass then cuts the messages that begin in
its range, reading on to their ends, and each message is parsed for itself.  Only counts of ranges are ever ordered by file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from memlake.session import materialise, spread
from memlake.sources.conversations import PARSERS, SKIP_DIRS
from memlake.sources.files import _filesystem, list_files, select_files, suffix

RANGE_BYTES = 8 << 20
# Cut messages that are handed on together: so many bytes at most, or one larger message.
_BATCH_BYTES = 1 << 20
_QUOTE, _BACKSLASH, _COMMA, _COLON = 34, 92, 44, 58
_SIGN = np.zeros(256, np.int8)
_SIGN[[ord("{"), ord("[")]] = 1
_SIGN[[ord("}"), ord("]")]] = -1
_SPACES = b" \t\r\n"
#: Nesting of a message's own brace, and how to parse a single one.
_MESSAGE_DEPTH = {"slack": 2, "claude": 4, "chatgpt": 4}
_KEY = {"claude": "chat_messages", "chatgpt": "mapping"}
_WRAPPED = {"slack": ("[", "]"), "claude": ('[{"chat_messages":[', "]}]"), "chatgpt": ('[{"mapping":{"m":', "}}]")}

_RANGE = "path string, start long, stop long, length long"


class Reader:
    """One file, read at any place."""

    def __init__(self, path: str):
        filesystem, where = _filesystem(path)
        self.file = filesystem.open_input_file(where)
        self.length = self.file.size()

    def bytes(self, start: int, stop: int) -> np.ndarray:
        start, stop = max(0, start), min(stop, self.length)
        self.file.seek(start)
        return np.frombuffer(self.file.read(max(0, stop - start)), np.uint8)

    def backslashes_before(self, at: int) -> int:
        """How many backslashes end just before a place."""
        count, step = 0, 64
        while at - count > 0:
            back = self.bytes(at - count - step, at - count)
            other = np.flatnonzero(back != _BACKSLASH)
            if len(other):
                return count + len(back) - 1 - int(other[-1])
            count += len(back)
            step *= 4
        return count


def _quotes(data: np.ndarray, lead: int) -> np.ndarray:
    """Places of the quotes that begin or end strings; ``lead`` backslashes come before the data."""
    found = np.flatnonzero(data == _QUOTE)
    if not len(found):
        return found
    plain = np.where(data != _BACKSLASH, np.arange(len(data)), -1)
    last = np.maximum.accumulate(plain)
    before = np.where(found > 0, last[found - 1], -1)
    run = found - 1 - before + np.where(before < 0, lead, 0)
    return found[run % 2 == 0]


class Scan:
    """Brackets and commas outside of strings, with the depth after each bracket."""

    def __init__(self, data: np.ndarray, lead: int, in_string: bool, depth: int):
        self.data, self.quotes = data, _quotes(data, lead)
        marks = np.flatnonzero((_SIGN[data] != 0) | (data == _COMMA))
        outside = (np.searchsorted(self.quotes, marks) + in_string) % 2 == 0
        marks = marks[outside]
        sign = _SIGN[data[marks]].astype(np.int64)
        after = depth + np.cumsum(sign)
        self.at, self.sign, self.depth = marks, sign, after
        self.in_string = (len(self.quotes) + in_string) % 2 == 1
        self.end_depth = int(after[-1]) if len(after) else depth


def _format_of(reader: Reader) -> str:
    """The format by the keys of the first object; read as far as needed."""
    size = 1 << 16
    while True:
        head = reader.bytes(0, size)
        scan = Scan(head, 0, False, 0)
        keys = set()
        strings = scan.quotes[: len(scan.quotes) // 2 * 2].reshape(-1, 2)
        opened = np.flatnonzero((scan.sign == 1) & (scan.depth == 2) & (head[scan.at] == ord("{")))
        closed = np.flatnonzero((scan.sign == -1) & (scan.depth == 1))
        if not head.tobytes().lstrip().startswith(b"["):
            return "unknown"
        end = int(scan.at[closed[0]]) if len(closed) else len(head)
        if len(opened):
            brackets = scan.sign != 0
            places, depths = scan.at[brackets], scan.depth[brackets]
            for a, b in strings[(strings[:, 0] > scan.at[opened[0]]) & (strings[:, 1] < end)].tolist():
                here = depths[np.searchsorted(places, a) - 1]
                if here == 2 and head[b + 1:b + 65].tobytes().lstrip(_SPACES)[:1] == b":":
                    keys.add(head[a + 1:b].tobytes())
        for kind, wanted in (("claude", {b"chat_messages"}), ("chatgpt", {b"mapping"}), ("slack", {b"text", b"ts"})):
            if wanted <= keys:
                return kind
        if len(closed) or size >= reader.length:
            return "unknown"
        size *= 4


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range its quotes, and its change of depth if it begins outside and inside of a string; at a file's start its format."""
    for batch in batches:
        out = []
        for path, start, stop, length in zip(*[c.to_pylist() for c in batch.columns]):
            try:
                reader = Reader(path)
                data = reader.bytes(start, stop)
                quotes = _quotes(data, reader.backslashes_before(start))
                marks = np.flatnonzero(_SIGN[data])
                inside = np.searchsorted(quotes, marks) % 2
                sign = _SIGN[data[marks]].astype(np.int64)
                out.append((path, start, stop, len(quotes), int(sign[inside == 0].sum()), int(sign[inside == 1].sum()), _format_of(reader) if start == 0 else None, None))
            except OSError as error:
                out.append((path, start, stop, 0, 0, 0, "unreadable" if start == 0 else None, f"{type(error).__name__}: {str(error).splitlines()[0]}"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()])] if out else [pa.array([], t) for t in [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]],
            names=["path", "start", "stop", "quotes", "outside", "inside", "format", "error"])


_CUT = "path string, start long, format string, key string, convo long, message long, text string, opens boolean, commas1 long, commas3 long, after long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages that begin in a range, then a row of the range itself (text null) with its commas at depths 1 and 3, those at depth 3
    after its last opening to that depth (``after``), and the key of that.

    ``convo`` and ``message`` count commas since the range's start; ``opens`` says whether ``message`` and ``key`` are complete in it.
    """
    out, held = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            reader = Reader(row["path"])
            start = row["start"]
            scan = Scan(reader.bytes(start, row["stop"]), reader.backslashes_before(start), row["in_string"], row["depth"])
            data, level = scan.data, _MESSAGE_DEPTH[row["format"]]
            comma = scan.sign == 0
            commas1, commas3 = scan.at[comma & (scan.depth == 1)], scan.at[comma & (scan.depth == 3)]
            opens3 = scan.at[(scan.sign == 1) & (scan.depth == 3)]
            begins = scan.at[(scan.sign == 1) & (scan.depth == level) & (data[scan.at] == ord("{"))]
            ends = scan.at[(scan.sign == -1) & (scan.depth == level - 1)]
            for at in begins.tolist():
                k = np.searchsorted(ends, at)
                raw = data[at:ends[k] + 1].tobytes() if k < len(ends) else _to_its_end(reader, data[at:], start + len(data), scan, level)
                here = opens3[:np.searchsorted(opens3, at)]
                key, opened = (_key_before(reader, start + int(here[-1])), True) if len(here) else (None, False)
                since = np.searchsorted(commas3, at) - (np.searchsorted(commas3, here[-1]) if opened else 0)
                out.append((row["path"], start, row["format"], key, int(np.searchsorted(commas1, at)), int(since), raw.decode("utf-8", "replace"), opened, None, None, None))
                held += len(raw)
                if len(out) >= 1000 or held > _BATCH_BYTES:
                    yield _rows(out)
                    out, held = [], 0
            last = int(opens3[-1]) if len(opens3) else None
            out.append((row["path"], start, row["format"], None if last is None else _key_before(reader, start + last), None, None, None, last is not None,
                        len(commas1), len(commas3), len(commas3) if last is None else len(commas3) - int(np.searchsorted(commas3, last))))
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in _CUT.split(", ")])


def _to_its_end(reader: Reader, begun: np.ndarray, at: int, scan: Scan, level: int) -> bytes:
    """A message that goes on behind its range."""
    parts, in_string, depth = [begun.tobytes()], scan.in_string, scan.end_depth
    while at < reader.length:
        data = reader.bytes(at, at + (1 << 16))
        more = Scan(data, reader.backslashes_before(at), in_string, depth)
        ends = more.at[(more.sign == -1) & (more.depth == level - 1)]
        if len(ends):
            return b"".join([*parts, data[: ends[0] + 1].tobytes()])
        parts.append(data.tobytes())
        at, in_string, depth = at + len(data), more.in_string, more.end_depth
    return b"".join(parts)


def _key_before(reader: Reader, at: int) -> str | None:
    """The key whose value begins at a place; keys of more than 1000 bytes are none of ours."""
    text = reader.bytes(at - 1100, at).tobytes().rstrip(_SPACES)
    if not text.endswith(b":"):
        return None
    text = text[:-1].rstrip(_SPACES)
    return text[:-1].rpartition(b'"')[2].decode("utf-8", "replace") if text.endswith(b'"') else None


def split_exports(spark: SparkSession, path: str, since=None, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Messages of all JSON exports below ``path``, as ``parse_exports`` gives them, and the files that gave none: (path, state).

    ``state`` is ``unknown`` for a file of no known format, or what its reading failed of.  Messages that aren't valid JSON are left out
    alone; one whose quotes or brackets don't match spoils the rest of its file.
    """
    listed = select_files(list_files(spark, path, SKIP_DIRS), since).where((suffix(F.col("path")) == ".json") & F.col("error").isNull())
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = listed.select("path", "length", F.explode(starts).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("stop"), "length")
    counted = materialise(spread(ranges, "path", "start").mapInArrow(
        _count, "path string, start long, stop long, quotes long, outside long, inside long, format string, error string"))

    file = Window.partitionBy("path").orderBy("start")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    parity = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    placed = counted.withColumn("in_string", parity).withColumn("change", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    placed = placed.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0))).withColumn(
        "format", F.first("format").over(file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    known = placed.where(F.col("format").isin(*_MESSAGE_DEPTH)).select("path", "start", "stop", "in_string", "depth", "format")
    cut = materialise(spread(known, "path", "start").mapInArrow(_cut, _CUT))

    # What comes into each range from those before it: commas so far, and since the last opening of a list or map of messages.
    spans = cut.where("text is null")
    so_far = spans.withColumn("commas_before", F.coalesce(F.sum("commas1").over(before), F.lit(0))).withColumn("total", F.coalesce(F.sum("commas3").over(before), F.lit(0)))
    so_far = so_far.withColumn("base", F.when(F.col("opens"), F.col("total") + F.col("commas3") - F.col("after")))
    incoming = so_far.select("path", "start", "commas_before", (F.col("total") - F.last("base", True).over(before)).alias("carried"),
                             F.last(F.when(F.col("opens"), F.coalesce("key", F.lit(""))), True).over(before).alias("carried_key"))
    met = cut.where("text is not null").join(incoming, ["path", "start"])
    key = F.when(F.col("opens"), F.col("key")).otherwise(F.col("carried_key"))
    wanted = F.create_map(*[F.lit(x) for pair in _KEY.items() for x in pair])[F.col("format")]
    own = met.where((F.col("format") == "slack") | (key == wanted))
    element = F.col("convo") + F.col("commas_before")
    message = F.col("message") + F.when(F.col("opens"), F.lit(0)).otherwise(F.coalesce("carried", F.lit(0)))
    parsed = F.lit(None)
    for name, (head, tail) in _WRAPPED.items():
        parsed = F.when(F.col("format") == name, PARSERS[name](F.concat(F.lit(head), "text", F.lit(tail)))).otherwise(parsed)
    slack = F.col("format") == "slack"
    rows = own.select(
        "path", "format", F.when(slack, F.lit(0)).otherwise(element).cast("int").alias("convo_idx"), F.when(slack, element).otherwise(message).cast("int").alias("msg_idx"),
        F.inline(F.transform(parsed, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"), m["ts"].alias("ts")))))
    state = placed.where((F.col("start") == 0) & ~F.col("format").isin(*_MESSAGE_DEPTH)).select("path", F.coalesce("error", "format").alias("state"))
    return rows.where(F.col("text") != ""), state
