"""Shorthand expressions against results written by hand, and properties that hold for every text."""

import pytest
from pyspark.sql import functions as F

from contract import DATA
from memlake.functions import shorthand as sh

COMPRESSED = {
    "": "",
    "   ": "",
    "Rain falls because clouds gather": "Rain falls ∵ clouds gather",
    "BECAUSE of it": "∵ of it",
    "not equal, not equal to": "≠, ≠",          # the longer phrase goes first
    "greater than or equal 5": "≥ 5",
    "approximately ten": "≈ ten",
    "results in leaks": "→ leaks",
    "caused by rust": "← rust",
    "leadſ to x": "→ x",                          # long s is an s when case is ignored
    "sand for knot tied": "s& f| k¬tied",         # rules act inside words
    "bathe often": "baoften",
    "Lena is a pilot": "Lena =pilot",
    "sky is blue": "sky:blue",
    "they were late": "they<late",
    "it will be sunny": "it>sunny",
    "he has had luck": "he+had luck",             # no blank is left in front of "had"
    "cats do not swim": "cats do ¬swim",          # "not " acts before " do not "
    "tea without milk": "tea w/o milk",
    "go with me": "go w/me",
    "assigned to Pia": "@Pia",
    "works on pumps": "w|ks on pumps",            # "or" acts before "works on "
    "critical path": "★★ path",
    "important": "imp|tant",
    "high priority": "high pri|ity",
    "incomplete work": "✗w|k",
    "deprecated": "⚠️deprecated",
    "authentication server": "auth server",
    "authorization": "auth|ization",
    "database, environment": "db, env",
    "machine learning pull request": "ML PR",
    "a  b\t\tc": "a b c",
    "p\n\n\n\n\nq": "p\n\nq",
    "$1 \\ $0": "$1 \\ $0",
}
COMPRESSED_CODE = {
    "def area(w: float, h: float = 1.0) -> float:": "fn:area(w: float,h: float)->float",
    "async def pull(url):": "async_fn:pull(url)",
    "def run(*jobs, **opts):\n    return 1": "fn:run(jobs,opts)\n return 1",
    "undef q():": "unfn:q()",
    "def f() -> int | None:": "fn:f()->int | None",
    "def broken(": "def broken(",
    "plain line": "plain line",
}
COMPRESSED_DIFFS = {
    "+alpha\n-beta": "CHANGE{} add:alpha rm:beta",
    "+1\n+2\n+3\n+4\n+5\n+6": "CHANGE{} add:1|2|3|4|5",
    "-x \n-  y": "CHANGE{} rm:x|y",
    "+\nnext": "CHANGE{} add:next",
    "plain": "plain",
}
EXPANDED = {
    "CHANGE:m.py add:a|b rm:c": "Changes to m.py:\n  + a\n  + b\n  - c",
    "CHANGE add:x": "Changes to file:\n  + x",
    "CHANGE:": "Changes to file:",
    "fn:f(a)": "def f(a) are",                    # the colon of the header is a symbol too
    "fn:f(a,b)->int x": "def f(a,b) - will be  int are  x",
    "async_fn:g()": "async def g() are",
    "db down": "database down",
    "a & b": "a and b",
    "x ∵ y": "x because y",
    "p → q": "p works on  q",                     # the last of the words that share the arrow
    "sky:blue": "sky are blue",
    "text [★★★]": "text [criticalimportant]",
    "  padded  ": "padded",
}
ARGUMENTS = {"user: str, n: int = 3": "user: str,n: int", "": "", " *rest ,\n**more": "rest,more", "p,,q": "p,q"}


def check(spark, expected, expression):
    df = spark.createDataFrame(list(expected.items()), "t string, expected string")
    rows = df.select("t", "expected", expression(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == expected


def test_compress(spark):
    check(spark, COMPRESSED, sh.compress)


def test_compress_code(spark):
    check(spark, COMPRESSED_CODE, lambda t: sh.compress(t, is_code=True))


def test_compress_flag_column(spark):
    mixed = {"def sky(x):": "fn:sky(x)", "def sky(xy):": "def sky(xy):"}
    check(spark, mixed, lambda t: sh.compress(t, is_code=F.length(t) < 12))


@pytest.mark.parametrize("name", ["", "a.py"])
def test_diff(spark, name):
    expected = {text: short.format(name and ":" + name) for text, short in COMPRESSED_DIFFS.items()}
    check(spark, expected, lambda t: sh.compress(t, is_diff=True, diff_filename=name))


def test_decompress(spark):
    check(spark, EXPANDED, sh.decompress)


def test_compact_args(spark):
    check(spark, ARGUMENTS, sh.compact_args)


@pytest.mark.parametrize("weight,stars", [(-3, "★"), (2, "★★"), (5, "★★★★★"), (99, "★★★★★")])
def test_confidence_is_clamped(spark, weight, stars):
    check(spark, {"note": f"note [{stars}]"}, lambda t: sh.annotate_confidence(t, weight))


def test_ratio(spark):
    df = spark.createDataFrame([("abcdef", "ab"), ("abc", "")], "o string, c string")
    assert [r[0] for r in df.select(sh.ratio(F.col("o"), F.col("c"))).collect()] == [3.0, 1.0]


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(sh.compress(F.col("t")), sh.decompress(F.col("t"))).first() == (None, None)


@pytest.mark.parametrize("table,column", [("documents", "text"), ("conversations", "text"), ("pages", "html")])
def test_properties_of_whole_tables(spark, table, column):
    """Short forms are tidy and free of the words, however these are written; expansion leaves no unambiguous symbol."""
    text = F.col(column)
    df = spark.read.parquet(str(DATA / "sf0.001" / f"{table}.parquet")).select(
        text, sh.compress(text).alias("c"), sh.compress(F.upper(text)).alias("u"))
    for row in df.withColumn("d", sh.decompress(F.col("c"))).collect():
        if row[0] is None:
            assert row.c is None and row.d is None
            continue
        assert "  " not in row.c and "\n\n\n" not in row.c and row.c == row.c.strip()
        for short in (row.c, row.u):
            assert not any(word in short.lower() for word in ("because", "therefore", "and", "database", "not equal"))
        assert not any(symbol in row.d for symbol in "∵∴≠≈≥≤∞&")
