"""Personal data: every detected entity is replaced by a keyed surrogate of its own kind and form.

DataFrame operations only.  Entities are e-mail addresses, IPv4 addresses, phone numbers, card numbers, names after a title, and
the surnames of these wherever else they stand in the same text.

Equal entities get equal surrogates in the whole table, also where they are written differently (phone numbers by their digits,
addresses without regard to case, a surname after different titles); different entities get different ones.  Surrogates are drawn by
a keyed hash in rounds: of entities that draw the same candidate the first in order keeps it, a candidate that is an entity of the
table itself is never given, and the others draw again: longer names, or numbers and addresses of the same length, of which those left after ``ROUNDS`` rounds get a 256-bit tag.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.registry import query, table
from memlake.session import materialise

ROUNDS = 4
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Sir", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Señorita", "Doña", "Lady", "Госпожа", "Κυρία"]
#: Titles that don't tell the gender; given names after them get names of neither.
NEUTRAL = ["Dr", "Dra", "Prof", "Professor", "Professorin", "Doctor", "Docteur", "Maître", "Rev", "Доктор", "Профессор", "Δρ", "Καθηγητής"]
_TITLES = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=lambda t: (-len(t), t)))
#: Lengths are bounded and quantifiers possessive, so that no text makes the search slow; only an address's labels are given back, as what
#: follows it may be a full stop.
_DATE = r"[0-9]{2}[./-][0-9]{2}[./-](?:1[5-9]|2[01])[0-9]{2}(?![0-9])"
_CARD = r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}"
#: With area code in brackets, with country code, with a trunk zero, and without one in groups of 3-3-4, 3-3-3 or 2-3-2-2; 15 digits at most.
_PHONES = [
    r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    r"(?<![0-9])\(0[0-9]{1,5}\)(?:[ ./-]?[0-9]){4,10}(?![0-9])",
    r"\+[0-9](?:(?:[ ./-]|[ .-]?\(|\)[ ./-]?)?[0-9]){6,14}(?![0-9])",
    rf"(?<![0-9]|[0-9][.,/-])(?!{_DATE}|(?:{_CARD})(?![0-9]))(?=0[0-9]{{1,5}}[ ./-][0-9])0(?:[ ./-]?[0-9]){{6,14}}(?![0-9])",
    r"(?<![0-9]|[0-9][.,/-])(?:1[ .-])?[2-9][0-9]{2}(?:[ .-][0-9]{3}[ .-][0-9]{4}|-[0-9]{3}-[0-9]{3})(?![0-9])",
    r"(?<![0-9]|[0-9][.,/-])[1-9][0-9]{1,2}[ .-][0-9]{3}[ .-][0-9]{2}[ .-][0-9]{2}(?![0-9])",
]
#: A possessive "'s" is no part of a name.
_END = r"(?!\p{L}|['-](?!s(?!\p{L}))\p{L})"
#: A title is no name, as in "Prof. Dr. Meier", where the name begins after the last one.
_WORD = rf"(?!(?:{_TITLES})(?!\p{{L}}))" + r"\p{Lu}(?:\p{L}|['-](?!s(?!\p{L}))(?=\p{L})){1,39}+"
_PARTICLES = "(?:(?:von|van|vom|zu|zur|de|der|den|del|della|da|di|du|dos|la|le|el|al|bin|ten|ter) ){0,3}+"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,7}\.[A-Za-z]{2,24}+(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": "|".join(_PHONES),
    "card": rf"(?<![0-9])(?:{_CARD})(?![0-9])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLES})\.?(?: {_PARTICLES}{_WORD}| \p{{Lu}}\.(?= (?:\p{{Lu}}\. ){{0,3}}+{_PARTICLES}{_WORD})){{1,6}}+",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Cheap necessary sign of an entity: most texts go no further.
SIGN = rf"@|[0-9]|(?<!\p{{L}})(?:{_TITLES})[. ]"


def _kind(mention: Column) -> Column:
    return (F.when(F.instr(mention, "@") > 0, "email").when(mention.rlike(r"\p{L}"), "name")
            .when(mention.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip").when(mention.rlike(f"^(?:{_CARD})$"), "card").otherwise("phone"))


def _entity_pattern(text: Column) -> Column:
    """ENTITY, and the surnames that follow a title somewhere in the text, also where they have none."""
    names = F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0))
    surnames = F.array_distinct(F.transform(names, lambda n: F.element_at(F.split(n, " "), -1)))
    untitled = F.concat(F.lit(rf"{ENTITY}|(?<!\p{{L}})(?:"), F.array_join(surnames, "|"), F.lit(f"){_END}"))
    return F.when(text.rlike(PATTERNS["name"]), untitled).otherwise(F.lit(ENTITY))


def _name_words(mention: Column) -> Column:
    """The words after a title; a mention of one word is a surname without title."""
    words = F.split(mention, " ")
    return F.when(F.size(words) > 1, F.slice(words, F.lit(2), F.size(words))).otherwise(words)


def _is_particle(word: Column) -> Column:
    return word.rlike(r"^\p{Ll}")


def _parts(mention: Column, kind: Column) -> Column:
    """The entities in a mention, each (kind, canonical text): names have given names, of the title's gender, and a surname last."""
    words = F.split(mention, " ")
    title = F.regexp_replace(F.element_at(words, 1), r"\.$", "")
    gender = F.when(title.isin(FEMALE), "given_f").when(title.isin(NEUTRAL), "given_n").otherwise("given_m")

    def entity(kind_column: Column, text: Column) -> Column:
        return F.struct(kind_column.alias("kind"), text.alias("entity"))

    own = F.filter(_name_words(mention), lambda w: ~_is_particle(w))
    name = F.transform(own, lambda w, i: entity(F.when(i == F.size(own) - 1, "surname").otherwise(gender), F.lower(w)))
    digits = F.regexp_replace(mention, "[^0-9]", "")
    plain = F.when(kind.isin("phone", "card"), digits).otherwise(F.lower(mention))
    return F.when(kind == "name", name).otherwise(F.array(entity(kind, plain)))


def _drawn(key: str, attempt: Column, kind: Column, entity: Column) -> Column:
    """64 hexadecimal digits that only the key's owner can make."""
    inner = F.sha2(F.concat_ws("\u001f", F.lit(key), attempt.cast("string"), kind, entity), 256)
    return F.sha2(F.concat(F.lit(key), inner), 256)


def _stream(drawn: Column, i: Column) -> Column:
    """The ``i``-th number (0 to 255) from the hash; after 32 numbers the hash goes on with another one."""
    block = F.when(i < 32, drawn).otherwise(F.sha2(F.concat(drawn, F.floor(i / 32).cast("string")), 256))
    return F.conv(F.substr(block, (i % 32 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _same_form(text: Column, drawn: Column) -> Column:
    """``text`` with each lower-case ASCII letter and digit drawn anew; everything else stays."""
    chars = F.split(text, "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("^[a-z]$"), F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), _stream(drawn, i) % 26 + 1, F.lit(1)))
                                    .when(c.rlike("^[0-9]$"), (_stream(drawn, i) % 10).cast("string")).otherwise(c)), "")


_SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo"],
    "cyrillic": ["ба", "де", "фи", "го", "ха", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "ве", "ви", "зо"],
    "greek": ["βα", "δε", "φι", "γο", "χα", "κε", "λι", "μο", "να", "πε", "ρι", "σο", "τα", "βε", "θι", "ζο"],
}
_ENDINGS = {  # script: given name of a man, of a woman, of either, surname
    "latin": ("n", "a", "i", "r"), "cyrillic": ("н", "на", "и", "ров"), "greek": ("ς", "α", "ι", "ου"),
}


def _name(kind: Column, entity: Column, drawn: Column, attempt: int) -> Column:
    """A name in the same script, its ending by gender, its length near the entity's; longer with each attempt, so names never run out."""
    script = F.when(entity.rlike(r"\p{IsCyrillic}"), "cyrillic").when(entity.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    syllables = F.greatest(F.lit(2), F.least(F.lit(10), F.floor(F.length(entity) / 2).cast("int"))) + attempt
    out = None
    for name in _SYLLABLES:
        listed = F.array(*map(F.lit, _SYLLABLES[name]))
        stem = F.array_join(F.transform(F.sequence(F.lit(0), syllables - 1), lambda i: F.element_at(listed, _stream(drawn, i) % 16 + 1)), "")
        man, woman, either, family = _ENDINGS[name]
        full = F.concat(stem, F.when(kind == "given_m", man).when(kind == "given_f", woman).when(kind == "given_n", either).otherwise(family))
        out = F.when(script == name, full) if out is None else out.when(script == name, full)
    return out


def candidate(kind: Column, entity: Column, drawn: Column, attempt: int = 0) -> Column:
    """A surrogate of the same kind: an address at a reserved top-level domain, an IPv4 address of the reserved class E, digits with
    the country code or issuer digit and (for cards that have it) a right check digit, or a name."""
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    site = F.regexp_replace(domain, r"\.[^.]*$", "")
    email = F.concat(_same_form(F.concat(local, F.lit("@"), site), drawn), F.lit(".example"))
    octet = [_stream(drawn, F.lit(k)) for k in range(4)]
    ip = F.concat_ws(".", (240 + octet[0] % 15).cast("string"), *[o.cast("string") for o in octet[1:]])
    phone = F.concat(F.substr(entity, F.lit(1), F.lit(1)), F.substr(_same_form(entity, drawn), F.lit(2)))
    body = F.substr(phone, F.lit(1), F.length(entity) - 1)
    check = ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")
    card = F.concat(body, F.when(_luhn(entity) == 0, check).otherwise(F.substr(phone, F.length(entity), F.lit(1))))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card).otherwise(_name(kind, entity, drawn, attempt))


def _luhn(digits: Column) -> Column:
    """The check sum (0: right) of a number whose last digit is its check digit."""
    chars = F.reverse(F.split(digits, ""))
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def assign_surrogates(entities: DataFrame, key: str, *, make=candidate, rounds: int = ROUNDS) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity); no surrogate is given twice in a kind, or is an entity of that kind.

    Names are drawn until all have one.  Of the other kinds, which keep their length, what has none after ``rounds`` rounds gets a tag.
    """
    left = entities
    done: DataFrame | None = None
    named = F.col("kind").isin(*_NAMES)
    tags: DataFrame | None = None
    for attempt in count():
        if attempt == rounds:
            tag = F.concat(F.lit("["), F.col("kind"), F.lit("-"), _drawn(key, F.lit(-1), F.col("kind"), F.col("entity")), F.lit("]"))
            tags = left.where(~named).select("kind", "entity", tag.alias("surrogate"))
            left = left.where(named)
            if left.isEmpty():
                return done.unionByName(tags)
        drawn = left.withColumn("drawn", _drawn(key, F.lit(attempt), F.col("kind"), F.col("entity")))
        tried = drawn.select("kind", "entity", make(F.col("kind"), F.col("entity"), F.col("drawn"), attempt).alias("surrogate"))
        winners = tried.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        taken = entities.select("kind", F.col("entity").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate"))
        won = materialise(winners.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "entity", "surrogate"))
        done = won if done is None else done.unionByName(won)
        left = materialise(left.join(won, ["kind", "entity"], "left_anti"))
        if left.isEmpty():
            return done if tags is None else done.unionByName(tags)


_NAMES = ("given_m", "given_f", "given_n", "surname")


def _rendered(mention: Column, kind: Column, found: Column) -> Column:
    """A mention written with its entities' surrogates: digits in the mention's own spacing, names after their own title."""
    first = F.element_at(found, 1)
    # The n-th digit of the mention becomes the n-th of the surrogate.
    with_digits = F.aggregate(F.split(mention, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
                              lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a["out"], F.substr(first, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at")))
                              .otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))), lambda a: a["out"])
    # The n-th word of a name becomes the n-th surrogate, an initial its initial; titles and particles stay.
    def written(w: Column, at: Column) -> Column:
        new = F.initcap(F.element_at(found, at))
        return F.when(w.endswith("."), F.concat(F.substr(new, F.lit(1), F.lit(1)), F.lit("."))).otherwise(new)

    words = F.split(mention, " ")
    titled = F.when(F.size(words) > 1, F.slice(words, 1, 1)).otherwise(F.array().cast("array<string>"))
    names = F.aggregate(_name_words(mention), F.struct(titled.alias("out"), F.lit(1).alias("at")),
                        lambda a, w: F.when(_is_particle(w), F.struct(F.concat(a["out"], F.array(w)).alias("out"), a["at"].alias("at")))
                        .otherwise(F.struct(F.concat(a["out"], F.array(written(w, a["at"]))).alias("out"), (a["at"] + 1).alias("at"))), lambda a: F.array_join(a["out"], " "))
    return F.when(kind == "name", names).when(kind.isin("phone", "card") & ~first.startswith("["), with_digits).otherwise(first)


def surrogate_table(docs: DataFrame, key: str, *, text: str = "text", **options) -> DataFrame:
    """(mention, kind, replacement) for every distinct mention in ``docs``."""
    mentions = docs.where(F.col(text).rlike(SIGN)).select(F.explode(F.regexp_extract_all(F.col(text), _entity_pattern(F.col(text)), F.lit(0))).alias("mention"))
    distinct = materialise(mentions.distinct().withColumn("kind", _kind(F.col("mention"))))
    parts = distinct.select("mention", F.posexplode(_parts(F.col("mention"), F.col("kind"))).alias("at", "part")).select("mention", "at", "part.kind", "part.entity")
    assigned = assign_surrogates(materialise(parts.select("kind", "entity").distinct()), key, **options)
    found = parts.join(assigned, ["kind", "entity"]).groupBy("mention").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"]).alias("found"))
    return materialise(distinct.join(found, "mention").select("mention", "kind", _rendered(F.col("mention"), F.col("kind"), F.col("found")).alias("replacement")))


def replace_personal_data(docs: DataFrame, key: str, *, text: str = "text", **options) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced, and ``entities``: for each kind how many mentions were (a map).

    Texts without an entity are passed on as they are; the others are taken apart at their mentions, joined with the surrogates by
    mention, and put together again, so only they are shuffled.  A null text stays null; repeated rows are replaced alike; texts of any
    length are read whole; all other columns stay, except one called ``entities``; an empty table gives no rows.
    """
    docs = docs.drop("entities")
    columns = docs.columns
    table_of = surrogate_table(docs.select(text), key, text=text, **options)
    # The caller's columns stay inside one struct, where their names can't clash.
    docs = docs.select(F.struct("*").alias("_whole"), F.col(text).alias("_text"))
    text, name = "_text", text
    found = F.when(F.col(text).rlike(SIGN), F.regexp_extract_all(F.col(text), _entity_pattern(F.col(text)), F.lit(0))).otherwise(F.array().cast("array<string>"))
    marked = docs.withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
    empty = F.create_map().cast("map<string,long>")
    plain = marked.where(F.size("_found") == 0).select("_whole.*", empty.alias("entities"))
    others = [F.col("_whole").getField(c).alias(c) for c in columns if c != name]
    pieces = (marked.where(F.size("_found") > 0)
              .select(F.monotonically_increasing_id().alias("_row"), F.struct(*others).alias("_rest") if others else F.lit(True).alias("_rest"),
                      F.split(F.col(text), _entity_pattern(F.col(text)), -1).alias("_between"), "_found"))
    # One row for each mention; what follows it in the text goes with it, and the first carries the start and the other columns.
    start = F.col("_at") == 0
    rows = pieces.select("_row", "_rest", "_between", F.posexplode("_found").alias("_at", "mention")).select(
        "_row", F.when(start, F.col("_rest")).alias("_rest"), F.when(start, F.element_at("_between", 1)).otherwise("").alias("_before"),
        F.element_at("_between", F.col("_at") + 2).alias("_after"), "mention", "_at")
    written = rows.join(table_of, "mention").groupBy("_row").agg(
        F.first("_rest", ignorenulls=True).alias("_rest"),
        F.sort_array(F.collect_list(F.struct("_at", F.concat("_before", "replacement", "_after").alias("s"), "kind"))).alias("_parts"))
    kinds = F.transform(F.array(*[F.lit(k) for k in PATTERNS]), lambda k: F.struct(k, F.size(F.filter("_parts", lambda p: p["kind"] == k)).cast("long")))
    counts = F.map_filter(F.map_from_entries(kinds), lambda k, n: n > 0)
    whole = F.array_join(F.transform("_parts", lambda p: p["s"]), "")
    rebuilt = written.select("_rest", whole.alias("_new"), counts.alias("_counts"))
    rebuilt = rebuilt.select(*[(F.col("_new") if c == name else F.col("_rest").getField(c)).alias(f"_c{i}") for i, c in enumerate(columns)], "_counts").toDF(*columns, "entities")
    return plain.unionByName(rebuilt)


@query("op8_surrogates")
def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text")
    done = replace_personal_data(docs, spark.conf.get("spark.memlake.surrogateKey", "memlake"))
    return done.select("doc_id", *[F.coalesce(F.element_at("entities", k), F.lit(0)).cast("long").alias(f"n_{k}") for k in PATTERNS], "text")
