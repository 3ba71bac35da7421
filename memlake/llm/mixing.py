"""Mixing sources to target weights: a token budget shared out over a tree of domains, languages and sources.

DataFrame operations only.  Weights are whole numbers and all shares are whole tokens, so the same input gives the same mixture on
any cluster.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm.registry import query, table
from memlake.session import materialise

#: Production tree and weights; names that aren't listed weigh 1.
WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2, "d3": 2, "d4": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {}}
MAX_EPOCHS = 4
SEED = 11


def word_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _named(column: Column) -> Column:
    """A level's value as a key that is never null: null is told apart from every text."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def _weight(name: str, weights: Mapping[str, int]) -> Column:
    pairs = [F.lit(x) for key, w in sorted(weights.items()) for x in (f"={key}", int(w))]
    listed = F.create_map(*pairs)[F.col(name)] if pairs else F.lit(None).cast("int")
    return F.coalesce(listed, F.lit(1)).cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Shares each parent's ``budget`` among its children by ``weight``; none gets more than its ``capacity``.

    What a child cannot take goes to its siblings by their weights, again until all are full or the budget is spent.  With children
    ordered by capacity for weight, the full ones come first; the others get ``weight * rest // weights of the others``.  Rounding
    down leaves at most a token for each child unspent.  Children of weight 0 get nothing.
    """
    wide = "decimal(38,0)"
    order = [(F.col("capacity") / F.col("weight")).asc_nulls_last(), F.col(name)]
    upto = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    from_here = Window.partitionBy(*parent).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    ranked = nodes.where("weight > 0").select(
        "*", (F.col("budget") - F.coalesce(F.sum("capacity").over(upto), F.lit(0))).alias("rest"),
        F.sum("weight").over(from_here).alias("others"), F.row_number().over(Window.partitionBy(*parent).orderBy(*order)).alias("place"))
    full = F.col("capacity").cast(wide) * F.col("others") <= F.col("weight").cast(wide) * F.col("rest")
    whole = Window.partitionBy(*parent)
    first_open = F.min(F.when(~full, F.col("place"))).over(whole)
    at = ranked.withColumn("first_open", first_open)
    is_first = F.col("place") == F.col("first_open")
    at = at.withColumn("open_rest", F.max(F.when(is_first, F.col("rest"))).over(whole)).withColumn("open_weights", F.max(F.when(is_first, F.col("others"))).over(whole))
    exact = F.expr("cast(cast(weight as decimal(19,0)) * cast(greatest(open_rest, 0L) as decimal(19,0)) as decimal(38,0)) div cast(open_weights as decimal(19,0))")
    share = F.when(F.col("first_open").isNull() | (F.col("place") < F.col("first_open")), F.col("capacity")).otherwise(exact.cast("long"))
    return at.withColumn("share", share).drop("rest", "others", "place", "first_open", "open_rest", "open_weights")


def leaf_quotas(leaves: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """``leaves`` (the levels and ``available`` tokens) with ``quota``: budgets go down the tree level by level.

    A node's capacity is ``max_epochs`` times the tokens below it.  As every node spends its budget among its own children first, a
    shortage is made good by siblings, and reaches the next level only where all siblings are full.
    """
    capped = leaves.withColumn("capacity", F.col("available") * max_epochs)
    total = capped.agg(F.sum("available").alias("available"), F.sum("capacity").alias("capacity"))
    above = total.select(F.least(budget.cast("long"), F.col("capacity")).alias("budget"))  # one row
    for k, name in enumerate(levels):
        parent, path = levels[:k], levels[:k + 1]
        children = capped.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(name, weights.get(name, {})))
        children = children.join(above, parent) if parent else children.join(above)
        above = share_out(children, parent, name).select(*path, F.col("share").alias("budget"))
    return leaves.join(above.withColumnRenamed("budget", "quota"), levels, "left").withColumn("quota", F.coalesce("quota", F.lit(0)))


def seeded_order(seed: int, epoch: Column, doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text, F.lit(""))).cast("binary"))


def choose(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]] = WEIGHTS, *, budget_share: float = 1.0,
           max_epochs: int = MAX_EPOCHS, seed: int = SEED, tokens: Column | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``mix_tokens``, ``mix_copies``, how often each row is taken whole, and ``mix_part``, the tokens of a further copy that is cut.

    The budget is ``budget_share`` of all tokens.  A leaf with quota ``q`` and ``a`` tokens gives ``q // a`` whole epochs, then the
    first ``q % a`` tokens of the next epoch, in the order of a seeded hash; the document in which they end is taken in part, so the
    tokens given are the quota.  Equal rows (of one hash) share what is left for them, so at most a token for each of them is not given.

    The prefix is found without sorting a leaf: tokens are added up by 4096 ranges of the hash, and only the range in which the quota
    ends is ordered, by leaf.  Rows without tokens (null or empty text) belong to the prefix if their hash does.  A null level is a branch
    of its own; a null id hashes as "-"; very long texts count whole; names may clash with anything but mix_tokens, mix_copies and
    mix_part; an empty table gives no rows.
    """
    names = [f"_level{k}" for k in range(len(levels))]
    counted = word_tokens(text) if tokens is None else tokens.cast("long")
    level_columns = [_named(c).alias(n) for n, c in zip(names, levels.values())]
    by_name = {n: weights.get(level, {}) for n, level in zip(names, levels)}
    narrow = materialise(docs.select(*level_columns, counted.alias("tokens"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"),
                                     F.col(id_column).alias("id")))
    leaves = narrow.groupBy(*names).agg(F.sum("tokens").alias("available"))
    all_tokens = narrow.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    quotas = leaf_quotas(leaves, names, by_name, F.lit(int(all_tokens * budget_share)), max_epochs)
    full = F.when(F.col("available") > 0, F.floor(F.col("quota") / F.col("available"))).otherwise(0).cast("long")
    # A leaf is one row; Spark broadcasts this table where its size on disk allows it.
    plan = materialise(quotas.withColumn("epochs", full).withColumn("left", F.col("quota") - F.col("epochs") * F.col("available")))
    hashed = narrow.join(plan.select(*names, "epochs", "left"), names).withColumn("hash", seeded_order(seed, F.col("epochs"), F.col("id"), F.col("digest")))
    ranges = hashed.groupBy(*names, "left", F.substring("hash", 1, 3).alias("range")).agg(F.sum("tokens").alias("tokens"))
    before = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    # The range in which the quota ends: the first one that doesn't fit whole; without one the whole epoch would fit.
    edge = ranges.where(F.col("before") + F.col("tokens") > F.col("left")).groupBy(*names).agg(
        F.min("range").alias("range"), F.min_by("before", "range").alias("before"))
    ends = hashed.withColumn("range", F.substring("hash", 1, 3)).join(edge, [*names, "range"]).groupBy(*names, "range", "before", "left", "hash").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    upto = Window.partitionBy(*names).orderBy("hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ends.withColumn("total", F.col("before") + F.sum("tokens").over(upto))
    last = totals.where(F.col("total") <= F.col("left")).groupBy(*names).agg(F.max("hash").alias("cut"))
    # The document in which the quota ends, and how much of it is wanted.
    share = F.floor((F.col("left") - F.col("total") + F.col("tokens")) / F.col("rows"))
    crossed = totals.where(F.col("total") > F.col("left")).groupBy(*names).agg(F.min_by(F.struct("hash", share.alias("part")), "hash").alias("next"))
    cuts = materialise(plan.select(*names, "epochs", "left").join(edge.select(*names, "range"), names, "left").join(last, names, "left").join(crossed, names, "left")
                       .withColumn("cut", F.when(F.col("range").isNull(), F.lit("g")).otherwise(F.coalesce("cut", "range"))).select(
                           *names, "epochs", "left", "cut", F.col("next.hash").alias("next"), F.col("next.part").alias("part")))
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    # The caller's columns stay inside one struct, where their names can't clash.
    keyed = docs.select(F.struct("*").alias("row"), *level_columns, counted.alias("tokens"), F.col(id_column).alias("id"), digest.alias("digest"))
    taken = keyed.join(cuts, names, "left").withColumn("hash", seeded_order(seed, F.col("epochs"), F.col("id"), F.col("digest")))
    copies = F.col("epochs") + ((F.col("left") > 0) & (F.col("hash") <= F.col("cut"))).cast("long")
    part = F.when((F.col("left") > 0) & (F.col("hash") == F.col("next")), F.col("part")).otherwise(F.lit(0))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("tokens").alias("mix_tokens"), copies.alias("mix_copies"),
                        part.cast("long").alias("mix_part"))


def first_words(text: str, n: Column) -> Column:
    """The beginning of a text with its first ``n`` words."""
    return F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]] = WEIGHTS, **options) -> DataFrame:
    """The mixture: the columns of ``docs``, each row as often as ``choose`` takes it, and cut copies behind; n_chars follows the text.

    Tokens are words here.  Null and empty texts, repeated rows, ties, very long texts and an empty table as in ``choose``; columns of
    ``docs`` may have any names but mix_tokens, mix_copies and mix_part.
    """
    chosen = choose(docs, levels, weights, **options).where("mix_copies > 0 OR mix_part > 0")
    name = options.get("text", "text")
    whole = F.array_repeat(F.lit(0).cast("long"), F.col("mix_copies").cast("int"))
    cuts = F.explode(F.concat(whole, F.when(F.col("mix_part") > 0, F.array("mix_part")).otherwise(F.array().cast("array<long>"))))
    packed = chosen.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), cuts.alias("cut"))
    cut_text = F.when(F.col("cut") > 0, first_words(f"row.{name}", F.col("cut"))).otherwise(F.col("row").getField(name))
    packed = packed.withColumn("new_text", cut_text)
    columns = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == name:
            value = F.col("new_text")
        elif c == "n_chars":
            value = F.when(F.col("cut") > 0, F.length("new_text").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return packed.select(*columns)


def production_levels() -> dict[str, Column]:
    """Domains are the sources by their number modulo 5; a source without number has none."""
    domain = F.concat(F.lit("d"), (F.regexp_extract("source", "[0-9]+", 0).try_cast("int") % 5).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def _tree_sql(k: int) -> str:
    """Sharing out at one level of the tree, as in share_out."""
    path = ["domain", "lang", "source"][:k + 1]
    parent, name = path[:-1], path[-1]
    weights = " ".join(f"WHEN '={key}' THEN {w}" for key, w in WEIGHTS[name].items())
    weight = f"CASE {name} {weights} ELSE 1 END" if weights else "1"
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    joined = f"JOIN b{k - 1} USING ({', '.join(parent)})" if parent else ", b"
    columns = ", ".join(path)
    return f"""
c{k} AS (SELECT {columns}, CAST(capacity AS HUGEINT) AS capacity, CAST({weight} AS HUGEINT) AS weight, CAST(budget AS HUGEINT) AS budget
        FROM (SELECT {columns}, sum(available * {MAX_EPOCHS}) AS capacity FROM leaves GROUP BY {columns}) {joined}),
r{k} AS (SELECT *, budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
               sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others, row_number() OVER w AS place
        FROM c{k} WINDOW w AS ({by} ORDER BY capacity / weight, {name})),
o{k} AS (SELECT *, min(CASE WHEN capacity * others > weight * rest THEN place END) OVER ({by}) AS first_open FROM r{k}),
q{k} AS (SELECT *, max(CASE WHEN place = first_open THEN rest END) OVER ({by}) AS open_rest,
               max(CASE WHEN place = first_open THEN others END) OVER ({by}) AS open_weights FROM o{k}),
b{k} AS (SELECT {columns}, CASE WHEN first_open IS NULL OR place < first_open THEN capacity ELSE weight * greatest(open_rest, 0) // open_weights END AS budget
        FROM q{k})"""


_ORACLE = rf"""
WITH n AS (
  SELECT doc_id, coalesce('=d' || CAST(TRY_CAST(nullif(regexp_extract(source, '[0-9]+'), '') AS INTEGER) % 5 AS VARCHAR), '-') AS domain,
         coalesce('=' || lang, '-') AS lang, coalesce('=' || source, '-') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS tokens, md5(coalesce(text, '')) AS digest
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS available FROM n GROUP BY ALL),
b AS (SELECT least(sum(available), sum(available) * {MAX_EPOCHS}) AS budget FROM leaves),
{_tree_sql(0)},{_tree_sql(1)},{_tree_sql(2)},
p AS (SELECT domain, lang, source, available, CASE WHEN available > 0 THEN budget // available ELSE 0 END AS epochs, budget AS quota
      FROM leaves JOIN b2 USING (domain, lang, source)),
h AS (SELECT n.*, epochs, quota - epochs * available AS rest,
             md5('{SEED}:' || CAST(epochs AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || digest) AS hash
      FROM n JOIN p USING (domain, lang, source)),
t AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total,
        sum(tokens) OVER (PARTITION BY domain, lang, source, hash) AS alike, count(*) OVER (PARTITION BY domain, lang, source, hash) AS n FROM h)
SELECT doc_id, nullif(substr(domain, 2), '') AS domain, nullif(substr(lang, 2), '') AS lang, nullif(substr(source, 2), '') AS source, tokens AS n_tokens,
       CAST(epochs + CASE WHEN rest > 0 AND total <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies,
       CAST(CASE WHEN rest > 0 AND total > rest AND total - alike < rest THEN (rest - total + alike) // n ELSE 0 END AS BIGINT) AS part_tokens
FROM t
"""


@query("op4_mixing", _ORACLE)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = production_levels()
    chosen = choose(table(spark, sf_dir), levels, WEIGHTS)
    return chosen.select("doc_id", levels["domain"].alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"),
                         F.col("mix_part").alias("part_tokens"))
