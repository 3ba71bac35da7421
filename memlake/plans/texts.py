"""Shorthand queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import shorthand as sh
from memlake.functions import vectors as vx
from memlake.operators.summaries import ratio_stats
from memlake.plans import fixtures as fx
from memlake.plans.oracles import compressed, decompressed, stripped
from memlake.plans.registry import query


def _measured(key: str, text: str, table: str) -> str:
    return f"""SELECT {key}, md5(c) AS digest, round(CASE WHEN length(c) = 0 THEN 1.0 ELSE length({text}) / length(c) END, 6) AS ratio
FROM (SELECT *, {compressed(text)} AS c FROM {table})"""


def _compress(df, key: str, text: str):
    done = df.select(key, text, sh.compress(F.col(text)).alias("c"))
    return done.select(key, F.md5("c").alias("digest"), F.round(sh.ratio(F.col(text), F.col("c")), 6).alias("ratio"))


@query("es_compress_documents", _measured("doc_id", "text", "documents"))
def es_compress_documents(spark, sf_dir):
    return _compress(fx.documents(spark, sf_dir), "doc_id", "text")


@query("es_compress_pages", _measured("page_id", "html", "pages"))
def es_compress_pages(spark, sf_dir):
    return _compress(fx.pages(spark, sf_dir), "page_id", "html")


@query("es_ratio_stats", f"""
SELECT lang AS class, round(avg(r), 2) AS mean, round(min(r), 2) AS min, round(max(r), 2) AS max, count(*) AS n
FROM (SELECT lang, CASE WHEN length(c) = 0 THEN 1.0 ELSE length(text) / length(c) END AS r
  FROM (SELECT lang, text, {compressed('text')} AS c FROM documents)) GROUP BY lang""")
def es_ratio_stats(spark, sf_dir):
    docs = fx.documents(spark, sf_dir).select("lang", "text", sh.compress(F.col("text")).alias("c"))
    return ratio_stats(docs, "lang", F.col("text"), F.col("c"))


# Each document under a function header, every second one async; the SQL states the short header directly.
_BODY = r"concat(chr(10), '  pass', chr(10), text)"


@query("es_code_signature", f"""
SELECT doc_id, md5({compressed(f"concat(CASE WHEN doc_id % 2 = 0 THEN 'async_fn:' ELSE 'fn:' END, 'f', doc_id, '(a: int,b: str,rest)->bool', {_BODY})")}) AS digest
FROM documents""")
def es_code_signature(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    start = F.when(F.col("doc_id") % 2 == 0, F.lit("async  def f")).otherwise(F.lit("def f"))
    code = F.concat(start, F.col("doc_id").cast("string"),
                    F.lit("(a: int = 1,\n    b: str='x' , **rest) -> bool :\n  pass\n"), F.col("text"))
    return docs.select("doc_id", F.md5(sh.compress(code, is_code=True)).alias("digest"))


@query("es_code_expand", """
SELECT doc_id, concat(CASE WHEN doc_id % 2 = 0 THEN 'async def ' ELSE 'def ' END, 'f', doc_id, '(a: int,b)',
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' -> bool' END, ':', chr(10), text) AS code FROM documents""")
def es_code_expand(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    start = F.when(F.col("doc_id") % 2 == 0, F.lit("async_fn:f")).otherwise(F.lit("fn:f"))
    arrow = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.lit("->bool"))
    short = F.concat(start, F.col("doc_id").cast("string"), F.lit("(a: int,b)"), arrow, F.lit("\n"), F.col("text"))
    return docs.select("doc_id", sh.expand_headers(short).alias("code"))


def _diff_part(mark: str, label: str) -> str:
    lines = rf"regexp_extract_all(d, '(?m)^\{mark}\s*(.+)$', 1)"
    return (f"CASE WHEN len({lines}) > 0 THEN concat(' {label}:', array_to_string(list_transform({lines}[1:5], "
            f"lambda x: {stripped('x')}), '|')) ELSE '' END")


@query("es_diff", f"""
SELECT conv_id, turn, concat('CHANGE:', role, '.md', {_diff_part('+', 'add')}, {_diff_part('-', 'rm')}) AS short
FROM (SELECT *, concat('- ', role, chr(10), '+ ', replace(text, chr(10), chr(10) || '+ ')) AS d FROM conversations)""")
def es_diff(spark, sf_dir):
    turns = fx.turns(spark, sf_dir)
    diff = F.concat(F.lit("- "), "role", F.lit("\n+ "), F.replace("text", F.lit("\n"), F.lit("\n+ ")))
    return turns.select(
        "conv_id", "turn",
        sh.compress(diff, is_diff=True, diff_filename=F.concat("role", F.lit(".md"))).alias("short"),
    )


@query("es_diff_expand", """
SELECT doc_id, concat('Changes to ', source, '.md:', chr(10), '  + a', doc_id, chr(10), '  + ', lang, chr(10), '  - z', n_chars) AS text
FROM documents""")
def es_diff_expand(spark, sf_dir):
    docs = fx.documents(spark, sf_dir)
    short = F.concat(F.lit("CHANGE:"), "source", F.lit(".md add:a"), F.col("doc_id").cast("string"), F.lit("|"), "lang",
                     F.lit(" rm:z"), F.col("n_chars").cast("string"))
    return docs.select("doc_id", sh.decompress(short).alias("text"))


@query("es_decompress", f"""
SELECT conv_id, turn, {decompressed('c')} AS text FROM (SELECT conv_id, turn, {compressed('text')} AS c FROM conversations)""")
def es_decompress(spark, sf_dir):
    turns = fx.turns(spark, sf_dir)
    return turns.select("conv_id", "turn", sh.decompress(sh.compress(F.col("text"))).alias("text"))


@query("es_confidence", f"""
SELECT conv_id, turn, concat({compressed('text')}, ' [', repeat('★', cast(greatest(1, least(5, turn)) AS int)), ']') AS text
FROM conversations""")
def es_confidence(spark, sf_dir):
    turns = fx.turns(spark, sf_dir)
    short = sh.compress(F.col("text"), confidence=F.col("turn").cast("int"))
    return turns.select("conv_id", "turn", short.alias("text"))


_BYTES = "list_transform(range(0, 32), lambda i: cast(('0x' || substr(sha256(text), cast(i * 2 + 1 AS int), 2)) AS int))"


@query("stub_embedding", f"""
SELECT doc_id, round(list_sum(list_transform(b, lambda x: x / 255.0)) * 12
    / (sqrt(12 * list_sum(list_transform(b, lambda x: (x / 255.0) * (x / 255.0)))) + 1e-9), 6) AS total,
  round(b[1] / 255.0 / (sqrt(12 * list_sum(list_transform(b, lambda x: (x / 255.0) * (x / 255.0)))) + 1e-9), 6) AS first_value,
  round(b[32] / (sqrt(list_sum(list_transform(b, lambda x: x * x))) + 1e-9), 6) AS padded_value, 384 AS dim
FROM (SELECT doc_id, {_BYTES} AS b FROM documents)""")
def stub_embedding(spark, sf_dir):
    docs = fx.documents(spark, sf_dir).select(
        "doc_id", vx.digest_embedding(F.col("text")).alias("e"), vx.digest_embedding_padded(F.col("text")).alias("p")
    )
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    return docs.select(
        "doc_id", F.round(total, 6).alias("total"), F.round(F.col("e")[0], 6).alias("first_value"),
        F.round(F.col("p")[31], 6).alias("padded_value"), F.size("p").alias("dim"),
    )
