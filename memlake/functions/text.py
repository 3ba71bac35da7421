"""String helpers whose results match Python's ``str`` and ``re`` on the same input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Every character Python's str.strip() removes.  F.trim alone removes blanks only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Python's \s written as a Java character class (used with the (?U) flag).
SPACE_CLASS = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def replace_each(text: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` by ``rewrite(match)``, as re.sub does with a function."""
    def rebuild(t: Column) -> Column:
        between = F.split(t, pattern, -1)
        matches = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), rewrite)
        return F.array_join(
            F.zip_with(between, matches, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), ""
        )

    return let(text, rebuild)


def join_present(separator: str, *parts: Column) -> Column:
    """Join the parts that are not NULL."""
    return F.concat_ws(separator, *parts)


def fixed_point(value: Column, digits: int) -> Column:
    """``value`` (below 2 in size) with ``digits`` decimals, rounded on its exact binary value as Python's ``%.nf`` does.

    Spark's own formatting rounds the shortest decimal text instead, which differs when that text ends in a 5.
    """
    scale, unit = 10 ** digits, 2 ** 62

    def render(x: Column) -> Column:
        scaled = (F.abs(x) * F.lit(float(unit))).cast("bigint").cast("decimal(20,0)") * F.lit(scale).cast("decimal(8,0)")

        def rounded(n: Column) -> Column:
            whole = F.floor(n / F.lit(unit).cast("decimal(20,0)")).cast("bigint")
            rest = n - whole.cast("decimal(20,0)") * F.lit(unit).cast("decimal(20,0)")
            half = F.lit(unit // 2).cast("decimal(20,0)")
            up = (rest > half) | ((rest == half) & (whole % 2 == 1))
            return F.format_string(
                f"%s%d.%0{digits}d", F.when(x < 0, F.lit("-")).otherwise(F.lit("")),
                F.floor((whole + up.cast("bigint")) / scale), (whole + up.cast("bigint")) % scale,
            )

        return let(scaled, rounded)

    return let(value, render)
