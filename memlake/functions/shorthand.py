"""The text shorthand as column expressions.

``compress`` rewrites common words to symbols, ``decompress`` expands them again.  The rules overlap ("and" also acts inside
words, several words share a symbol), so expansion does not restore every text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from memlake.functions.text import SPACE_CLASS, let, replace_each, strip

# Word and symbol, applied in exactly this order, ignoring case.
SYMBOLS = (
    ("therefore", "∴"), ("because", "∵"), ("implies", "→"), ("leads to", "→"), ("results in", "→"),
    ("caused by", "←"), ("not equal to", "≠"), ("not equal", "≠"), ("greater than or equal", "≥"),
    ("less than or equal", "≤"), ("approximately", "≈"), ("infinity", "∞"), ("and", "&"), ("or", "|"), ("not ", "¬"),
    ("the ", ""), ("The ", ""), ("is a ", "="), (" is ", ":"), (" are ", ":"), (" was ", "<"), (" were ", "<"),
    (" will be ", ">"), (" has ", "+"), (" have ", "+"), (" had ", "+"), (" does not ", "¬"), (" do not ", "¬"),
    (" did not ", "¬"), ("with ", "w/"), ("without ", "w/o "), ("regarding ", "re:"), ("related to ", "~"),
    ("assigned to ", "@"), ("responsible for ", "owns:"), ("works on ", "→"), ("works at ", "@"),
    ("started on ", "from:"), ("ended on ", "to:"), ("completed ", "✓"), ("incomplete ", "✗"), ("important", "★"),
    ("critical", "★★"), ("high priority", "!!!"), ("low priority", "↓"), ("deprecated", "⚠️deprecated"),
    ("breaking change", "💥"), ("database", "db"), ("authentication", "auth"), ("authorization", "authz"),
    ("configuration", "cfg"), ("environment", "env"), ("repository", "repo"), ("pull request", "PR"),
    ("continuous integration", "CI"), ("continuous deployment", "CD"), ("application programming interface", "API"),
    ("user interface", "UI"), ("command line interface", "CLI"), ("machine learning", "ML"),
    ("artificial intelligence", "AI"),
)

# Letters outside ASCII that a case-insensitive match of ASCII letters also accepts.
_CASE_VARIANTS = "İıſK"

_S = SPACE_CLASS

# A function header and its short form.  Groups: name, arguments, return type.
_HEADER = rf"def{_S}+(\w+){_S}*\(([^)]*)\){_S}*(?:->{_S}*([\w\[\], |None]+))?{_S}*:"
FUNCTION_HEADER = "(?U)" + _HEADER
ASYNC_FUNCTION_HEADER = f"(?U)async{_S}+" + _HEADER
SHORT_HEADER = rf"(?U)(async_)?fn:(\w+)\(([^)]*)\)(?:->([^\s\x1c-\x1f]+))?"

# Added and removed lines of a diff, the short diff, and how many lines of each kind it names.
DIFF_ADDED = rf"(?Umd)^\+{_S}*(.+)$"
DIFF_REMOVED = rf"(?Umd)^-{_S}*(.+)$"
SHORT_DIFF = rf"(?U)^CHANGE:?([^\s\x1c-\x1f]+)?{_S}*(add:[^\s\x1c-\x1f]+)?{_S}*(rm:[^\s\x1c-\x1f]+)?"
DIFF_LINES = 5


def compress(
    text: Column, is_code: Column | bool = False, is_diff: Column | bool = False,
    diff_filename: Column | str = "", confidence: Column | int | None = None,
) -> Column:
    """Shorthand of ``text``.  Flags may be columns; a diff is only summarised, code headers are shortened first."""
    plain = text
    if not _never(is_code):
        plain = F.when(_flag(is_code), compress_headers(text)).otherwise(text)
    short = _tidy(_apply_symbols(plain))
    if confidence is not None:
        short = annotate_confidence(short, confidence)
    if not _never(is_diff):
        short = F.when(_flag(is_diff), compress_diff(text, diff_filename)).otherwise(short)
    return short


def _never(flag) -> bool:
    return flag is False


def _flag(flag) -> Column:
    return flag if isinstance(flag, Column) else F.lit(flag)


def _apply_symbols(text: Column) -> Column:
    """All symbol rules in order, in one pass of ``aggregate`` over a constant rule array.

    Most rules do not occur in most texts.  A lower-cased copy travels along, and a rule's regular expression only runs when
    its word is in that copy.  For ASCII words "the lower-cased text contains it" and "it matches ignoring case" are the same
    unless the text has one of ``_CASE_VARIANTS``; then every rule runs.
    """
    rules = F.array(*[
        F.struct(
            F.lit(word.lower()).alias("word"), F.lit(rf"(?iu)\Q{word}\E").alias("pattern"),
            F.lit(symbol).alias("symbol"), F.lit(symbol.lower()).alias("low_symbol"),
        )
        for word, symbol in SYMBOLS
    ])

    def run(t: Column) -> Column:
        odd = F.lit(False)
        for letter in _CASE_VARIANTS:
            odd = odd | F.contains(t, F.lit(letter))
        start = F.struct(t.alias("text"), F.lower(t).alias("low"), odd.alias("odd"))

        def step(state: Column, rule: Column) -> Column:
            changed = F.struct(
                F.regexp_replace(state["text"], rule["pattern"], rule["symbol"]).alias("text"),
                F.replace(state["low"], rule["word"], rule["low_symbol"]).alias("low"),
                state["odd"].alias("odd"),
            )
            return F.when(state["odd"] | F.contains(state["low"], rule["word"]), changed).otherwise(state)

        return F.aggregate(rules, start, step, lambda state: state["text"])

    return let(text, run)


def _tidy(text: Column) -> Column:
    """Runs of blanks to one blank, three or more line breaks to two, ends stripped."""
    def blanks(t: Column) -> Column:
        doubled = F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t"))
        return F.when(doubled, F.regexp_replace(t, r"[ \t]{2,}", " ")).otherwise(t)

    def breaks(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)

    return strip(let(let(text, blanks), breaks))


def compress_headers(text: Column) -> Column:
    """Python function headers to ``fn:name(args)->ret`` and ``async_fn:...`` (async ones first)."""
    def shorten(pattern: str, prefix: str):
        def rewrite(match: Column) -> Column:
            returns = F.regexp_extract(match, pattern, 3)
            arrow = F.when(returns == "", F.lit("")).otherwise(F.concat(F.lit("->"), strip(returns)))
            return F.concat(
                F.lit(prefix), F.regexp_extract(match, pattern, 1), F.lit("("),
                compact_args(F.regexp_extract(match, pattern, 2)), F.lit(")"), arrow,
            )
        return rewrite

    def with_headers(t: Column) -> Column:
        first = replace_each(t, ASYNC_FUNCTION_HEADER, shorten(ASYNC_FUNCTION_HEADER, "async_fn:"))
        both = replace_each(first, FUNCTION_HEADER, shorten(FUNCTION_HEADER, "fn:"))
        return F.when(F.contains(t, F.lit("def")), both).otherwise(t)

    return let(text, with_headers)


def compact_args(args: Column) -> Column:
    """Argument list without defaults, leading stars and blanks around commas."""
    def one(arg: Column) -> Column:
        bare = F.regexp_replace(strip(arg), rf"(?U){_S}*={_S}*[^,]+", "")
        return strip(F.regexp_replace(bare, r"^\*{1,2}", ""))

    return F.array_join(F.filter(F.transform(F.split(args, ","), one), lambda a: a != ""), ",")


def compress_diff(text: Column, filename: Column | str = "") -> Column:
    """``CHANGE:file add:a|b rm:c`` from the first changed lines; text without changed lines stays as it is."""
    name = filename if isinstance(filename, Column) else F.lit(filename)

    def lines(pattern: str, mark: str) -> Column:
        found = F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), 1, DIFF_LINES)
        return F.when(F.size(found) > 0, F.concat(F.lit(mark), F.array_join(F.transform(found, strip), "|")))

    added, removed = lines(DIFF_ADDED, "add:"), lines(DIFF_REMOVED, "rm:")
    head = F.when(name == "", F.lit("CHANGE")).otherwise(F.concat(F.lit("CHANGE:"), name))
    return F.when(added.isNull() & removed.isNull(), text).otherwise(F.concat_ws(" ", head, added, removed))


def annotate_confidence(text: Column, weight: Column | int) -> Column:
    """Append one to five stars."""
    stars = F.greatest(F.lit(1), F.least(F.lit(5), weight if isinstance(weight, Column) else F.lit(weight)))
    return F.concat(text, F.lit(" ["), F.repeat(F.lit("★"), stars), F.lit("]"))


def decompress(text: Column) -> Column:
    """Expand shorthand: diffs, function headers, then symbols in reverse order (case-sensitive)."""
    rules = F.array(*[
        F.struct(F.lit(symbol).alias("symbol"), F.lit(word).alias("word"))
        for word, symbol in reversed(SYMBOLS) if symbol
    ])

    def without_stars(t: Column) -> Column:
        bare = F.regexp_replace(t, rf"(?U){_S}*\[★+\](?=\n?\z)", "")
        return F.when(F.contains(t, F.lit("[★")), bare).otherwise(t)

    def expand(t: Column) -> Column:
        words = F.aggregate(
            rules, expand_headers(t), lambda done, rule: F.replace(done, rule["symbol"], rule["word"])
        )
        is_diff = F.startswith(t, F.lit("CHANGE:")) | F.startswith(t, F.lit("CHANGE "))
        return F.when(is_diff, expand_diff(t)).otherwise(strip(let(words, without_stars)))

    return let(text, expand)


def expand_diff(text: Column) -> Column:
    def lines(group: int, mark: str, bullet: str) -> Column:
        listed = F.split(F.replace(F.regexp_extract(text, SHORT_DIFF, group), F.lit(mark), F.lit("")), r"\|", -1)
        return F.transform(F.filter(listed, lambda item: item != ""), lambda item: F.concat(F.lit(bullet), item))

    name = F.coalesce(F.nullif(F.regexp_extract(text, SHORT_DIFF, 1), F.lit("")), F.lit("file"))
    head = F.array(F.concat(F.lit("Changes to "), name, F.lit(":")))
    return F.array_join(F.concat(head, lines(2, "add:", "  + "), lines(3, "rm:", "  - ")), "\n")


def expand_headers(text: Column) -> Column:
    """``fn:name(args)->ret`` and ``async_fn:...`` back to Python headers."""
    def rewrite(match: Column) -> Column:
        start = F.when(F.startswith(match, F.lit("async_")), F.lit("async def ")).otherwise(F.lit("def "))
        returns = F.regexp_extract(match, SHORT_HEADER, 4)
        arrow = F.when(returns == "", F.lit("")).otherwise(F.concat(F.lit(" -> "), returns))
        return F.concat(
            start, F.regexp_extract(match, SHORT_HEADER, 2), F.lit("("),
            F.regexp_extract(match, SHORT_HEADER, 3), F.lit(")"), arrow, F.lit(":"),
        )

    return let(text, lambda t: F.when(F.contains(t, F.lit("fn:")), replace_each(t, SHORT_HEADER, rewrite)).otherwise(t))


def ratio(original: Column, compressed: Column) -> Column:
    """Characters before over characters after; 1.0 when nothing is left."""
    return F.when(F.length(compressed) == 0, F.lit(1.0)).otherwise(F.length(original) / F.length(compressed))
