"""Claims in free text checked against stored assignments, and the resolution of conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memlake.functions.text import strip
from memlake.functions.times import as_time
from memlake.operators import triples as kg
from memlake.session import materialise

# The two sentence patterns, with the verb each one reports.  Group 1 is the person, group 2 the task.
CLAIM_PATTERNS = {
    "finished": r"(?iU)(\w+)\s+(?:finished|completed|closed|resolved|shipped)\s+(?:the\s+)?([a-z0-9_\-\s]+)",
    "owns": r"(?iU)(\w+)\s+(?:is\s+)?(?:assigned\s+to|owns?|working\s+on)\s+(?:the\s+)?([a-z0-9_\-\s]+)",
}

# A word that every claim of the pattern has: most texts have none and never meet the pattern itself.
CLAIM_WORDS = {"finished": "(?iu)finished|completed|closed|resolved|shipped", "owns": "(?iu)assigned|own|working"}

# Marks shown before a conflict's label.
LABEL_MARKS = {"tenure": "🔴", "assignment": "🟡", "date": "🟠"}
OTHER_MARK = "⚪"

# Text pieces of up to this length are the join keys of the containment search; texts are cut block by block.
_PIECE = 16
_BLOCK = 1024

# A piece is cut only if a key begins with the same ``_START`` characters; so many bits tell.
_START = 6
_STARTS = 1 << 14


def extract_claims(texts: DataFrame, text: str = "text") -> DataFrame:
    """Every claim in the text: ``person``, ``verb``, ``task`` and its position among the claims of that pattern."""
    claims = None
    for verb, pattern in CLAIM_PATTERNS.items():
        found = (
            texts.where(F.rlike(F.col(text), F.lit(CLAIM_WORDS[verb])))
            .select("*", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("claim_no", "_m"))
            .withColumn("person", strip(F.regexp_extract("_m", pattern, 1)))
            .withColumn("verb", F.lit(verb))
            .withColumn("task", strip(F.regexp_extract("_m", pattern, 2)))
            .drop("_m")
        )
        claims = found if claims is None else claims.unionByName(found)
    return claims.where(F.col("task") != "")


def containment_pairs(containers: DataFrame, parts: DataFrame) -> DataFrame:
    """All (container, part) with ``part`` a substring of ``container``.  Inputs are distinct texts named so."""
    found = candidates(containers.select("container"), parts.select("part"), "container", "part")
    whole = containers.select(text_id("container").alias("_container"), "container")
    return found.join(whole, "_container").where(F.contains("container", "part")).select("container", "part")


def text_id(text: str | Column) -> Column:
    """A text's 64-bit hash, by which it travels through joins; texts that share one are told apart when they are compared."""
    return F.xxhash64(text)


def candidates(containers: DataFrame, parts: DataFrame, container: str, part: str) -> DataFrame:
    """The rows of ``parts``, each with the id (``_container``) of every text that may hold its text, once: all that do, and few others.

    ``container`` and ``part`` name the text columns.  Containers are cut into their pieces of the lengths that parts have, up to
    ``_PIECE`` characters; a piece travels with the id of its text only, as a hash.  A part no longer than that equals one of these
    pieces.  For a longer part, one of its own pieces is the join key: the one found least often; a part with a piece no container has
    is in none of them.  Only pieces that begin as some key does are cut at all: a bit for each of ``_STARTS`` hashes of a length and
    a beginning tells which.  Other columns of ``parts`` are carried along, so that no pair of ids has to find its rows again.  The caller
    compares the texts, as different ones may share a hash.  Empty and NULL texts are in no pair.
    """
    parts = parts.where(F.length(part) > 0)
    ids = parts.select(text_id(part).alias("id"), F.col(part).alias("text"))
    long = ids.where(F.length("text") > _PIECE).distinct()
    lengths = parts.agg(F.collect_set(F.least(F.length(part), F.lit(_PIECE)))).scalar()  # at most _PIECE numbers
    short = ids.where(F.length("text") <= _PIECE).select(_start(F.col("text"), F.length("text")).alias("start"))
    inner = long.select(F.explode(F.transform(_places(F.length("text"), F.lit(_PIECE)), lambda i: _start(F.substring("text", i, F.lit(_PIECE)), F.lit(_PIECE)))).alias("start"))
    pieces = _pieces(containers.select(text_id(container).alias("id"), F.col(container).alias("text")), lengths, _bits(short.unionByName(inner)))

    frequency = pieces.where(F.col("chars") == _PIECE).groupBy("piece").agg(F.count("*").alias("n"))
    own = long.select("id", F.explode(F.array_distinct(F.transform(_places(F.length("text"), F.lit(_PIECE)), lambda i: F.xxhash64(F.substring("text", i, F.lit(_PIECE)))))).alias("piece"))
    rarest = (
        own.join(frequency, "piece", "left")
        .groupBy("id").agg(F.min(F.struct("n", "piece")).alias("k"), F.count_if(F.col("n").isNull()).alias("missing"))
        .where(F.col("missing") == 0)
        .select(F.col("id").alias("_part_id"), F.col("k.piece").alias("_piece"))
    )
    keyed = parts.where(F.length(part) <= _PIECE).withColumn("_piece", F.xxhash64(part)).unionByName(
        parts.where(F.length(part) > _PIECE).withColumn("_part_id", text_id(part)).join(rarest, "_part_id").select(*parts.columns, "_piece"))
    return keyed.join(pieces.select(F.col("piece").alias("_piece"), F.col("id").alias("_container")), "_piece").drop("_piece")


def _start(piece: Column, chars: Column) -> Column:
    """Which of the ``_STARTS`` bits stands for a piece of this length with this beginning."""
    return F.pmod(F.xxhash64(chars.cast("int"), F.substring(piece, F.lit(1), F.lit(_START))), F.lit(_STARTS))


def _bits(starts: DataFrame) -> Column:
    """One array of ``_STARTS`` bits, 64 a number, in which those of ``start`` are set."""
    words = starts.groupBy(F.floor(F.col("start") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("start") % 64).cast("int"))).alias("bits"))
    found = words.agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("found"))
    every = F.transform(F.sequence(F.lit(0), F.lit(_STARTS // 64 - 1)), lambda i: F.coalesce(F.col("found")[i], F.lit(0).cast("long")))
    return found.select(every).scalar()


def _places(length: Column, chars: Column) -> Column:
    """Where pieces of this length begin, in texts that are as long or longer."""
    return F.sequence(F.lit(1), length - chars + 1)


def _pieces(texts: DataFrame, lengths: Column, bits: Column) -> DataFrame:
    """(id, chars, piece): all substrings with one of the given lengths and a beginning in ``bits``, as 64-bit hashes, distinct for each id."""
    named = texts.where(F.length("text") > 0).groupBy("id").agg(F.collect_set("text").alias("texts"))  # one text, but for equal hashes
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(_BLOCK))
    blocks = named.select("id", F.size("texts").alias("n_texts"), F.explode("texts").alias("text")).select(
        "id", ((F.col("n_texts") == 1) & (F.length("text") <= _BLOCK)).alias("alone"),
        F.explode(F.transform(starts, lambda i: F.substring("text", i, F.lit(_BLOCK + _PIECE - 1)))).alias("block"),
    )
    sized = blocks.withColumn("bits", bits).select("id", "alone", "block", "bits", F.explode(lengths).alias("n")).where(F.length("block") >= F.col("n"))
    begins = lambda i: _start(F.substring("block", i, F.col("n")), F.col("n"))
    known = lambda i: F.getbit(F.col("bits")[F.floor(begins(i) / 64).cast("int")], (begins(i) % 64).cast("int")) == 1
    places = F.filter(_places(F.least(F.length("block"), F.lit(_BLOCK - 1) + F.col("n")), F.col("n")), known)
    cut = F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.substring("block", i, F.col("n")))))
    found = sized.select("id", "alone", F.col("n").alias("chars"), F.explode(cut).alias("piece"))
    return found.where("alone").drop("alone").unionByName(found.where("not alone").drop("alone").distinct())


def text_conflicts(texts: DataFrame, stored: DataFrame, as_of, text: str = "text") -> DataFrame:
    """Claims that name another person than an active ``assigned_to`` triple about the same task.

    Task and object match when one contains the other, ignoring case.  The texts are read once: their claims are written to
    the shared folder and the text itself is not carried on.  Each different task and object is cut into pieces once; the rows of the
    shorter text go through the search as they are, so a pair is shuffled once, to the rows of the longer one.
    """
    claims = materialise(extract_claims(texts, text).drop(text))
    assigned = kg.active(stored.where(F.col("predicate") == "assigned_to"), as_of)
    said = claims.withColumn("_task", F.lower("task"))
    known = assigned.select(F.lower("object").alias("_object"), *[F.col(c).alias(f"_stored_{c}") for c in stored.columns])
    in_task = candidates(said, known, "_task", "_object").join(said.withColumn("_container", text_id("_task")), "_container").where(
        F.contains("_task", "_object"))
    in_object = candidates(known, said, "_object", "_task").join(known.withColumn("_container", text_id("_object")), "_container").where(
        F.contains("_object", "_task") & (F.col("_object") != F.col("_task")))
    other = F.lower("_stored_subject") != F.lower("person")
    found = in_task.where(other).unionByName(in_object.where(other))
    return found.select(
        *claims.columns,
        F.struct(*[F.col(f"_stored_{c}").alias(c) for c in stored.columns]).alias("stored"),
        F.lit("assignment").alias("type"),
        F.concat(F.lit("Attribution conflict on '"), F.col("_stored_object"), F.lit("'")).alias("description"),
        F.concat(F.lit('"'), "person", F.lit(" "), "verb", F.lit(" "), "task", F.lit('"')).alias("incoming_text"),
    )


def tenure_headers(stored: DataFrame, as_of) -> DataFrame:
    """One row per tenure conflict with its newest triple as ``stored``."""
    found = kg.tenure_conflicts(stored, as_of).select("subject", "predicate", "n_active", "stored_id")
    return _with_stored(found, stored).select(F.lit("tenure").alias("type"), "subject", "predicate", "n_active", "stored")


def tenure_conflict_rows(stored: DataFrame, as_of, whole: bool = False) -> DataFrame:
    """Tenure conflicts described as ``S P — o1 vs o2`` (newest first), with the newest triple.

    Very large conflicts come in several rows (``piece``), each describing its share of the objects, unless ``whole`` is set.
    """
    return _with_stored(kg.tenure_lists(stored, as_of, whole=whole), stored).select(
        F.lit("tenure").alias("type"),
        F.concat("subject", F.lit(" "), "predicate", F.lit(" — "), "objects").alias("description"),
        "subject", "predicate", "piece", "stored",
    )


def _with_stored(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Add the triple named by ``stored_id`` as one column."""
    whole = stored.select(F.col("id").alias("stored_id"), F.struct(*stored.columns).alias("stored"))
    return found.join(whole, "stored_id")


def quoted_entity(text: Column) -> Column:
    """The first text in double quotes, or NULL."""
    return F.nullif(F.regexp_extract(text, '"([^"]+)"', 1), F.lit(""))


def label(kind: Column, description: Column) -> Column:
    mark = F.lit(OTHER_MARK)
    for name, symbol in LABEL_MARKS.items():
        mark = F.when(kind == name, F.lit(symbol)).otherwise(mark)
    return F.concat(mark, F.lit(" ["), F.upper(kind), F.lit("] "), description)


def detail_text(subject: Column, predicate: Column, obj: Column, valid_from: Column, incoming: Column,
                location: Column, description: Column) -> Column:
    """Readable lines about a conflict; the description when there is nothing else to show."""
    since = F.when(F.nullif(valid_from, F.lit("")).isNotNull(), F.concat(F.lit(" (from "), valid_from, F.lit(")")))
    stored = F.concat(F.lit("  Stored:  "), F.concat_ws(" ", subject, predicate, obj), F.coalesce(since, F.lit("")))
    lines = F.concat_ws(
        "\n",
        F.when(subject.isNotNull(), stored),
        F.when(F.nullif(incoming, F.lit("")).isNotNull(), F.concat(F.lit("  New:     "), incoming)),
        F.when(F.nullif(location, F.lit("")).isNotNull(), F.concat(F.lit("  Location: "), location)),
    )
    return F.coalesce(F.nullif(lines, F.lit("")), description)


# ---- resolution -----------------------------------------------------------------------------------------------------

def resolve(conflicts: DataFrame, stored: DataFrame, as_of, policy: str = "keep") -> tuple[DataFrame, DataFrame]:
    """Resolve all conflicts by one policy; returns (triples, one-row ``resolved`` count).

    ``keep`` changes nothing and counts every conflict; ``update`` ends the stored triple of each; ``skip`` counts none.
    """
    if policy == "update":
        ended = conflicts.where(F.col("stored.id").isNotNull())
        endings = ended.select(F.col("stored.subject"), F.col("stored.predicate"), F.col("stored.object"),
                               as_time(as_of).alias("ended"))
        return kg.invalidate(stored, endings).drop("changed"), ended.agg(F.count("*").alias("resolved"))
    if policy == "keep":
        return stored, conflicts.agg(F.count("*").alias("resolved"))
    if policy == "skip":
        return stored, conflicts.agg(F.lit(0).cast("long").alias("resolved"))
    raise ValueError(f"unknown policy {policy!r}: use keep, update or skip")


def apply_decisions(decisions: DataFrame, stored: DataFrame, as_of) -> DataFrame:
    """Apply one decision per conflict: ``action`` and the triple's subject, predicate, object and ``new_object``.

    ``update`` ends the stored triple at ``as_of`` and adds the replacement from then on; every other action changes nothing.
    """
    updates = decisions.where(F.col("action") == "update")
    endings = updates.select(*kg.SPO, as_time(as_of).alias("ended"))
    replacements = updates.select(
        "subject", "predicate",
        F.coalesce(F.nullif("new_object", F.lit("")), F.lit("unknown")).alias("object"),
        as_time(as_of).alias("valid_from"),
        F.lit("conflict_resolver").alias("source"),
    )
    return kg.add(kg.invalidate(stored, endings).drop("changed"), replacements)
