"""Quality rules: rules for documents, their failures added up by host, and host verdicts joined back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.registry import query, table
from memlake.llm.rescan import check_of, placed, without
from memlake.llm.words import Words, bounded, mix, raw_texts, slices, small
from memlake.llm.worker import forget_large
from memlake.session import materialise

WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def _duplicate_lines(raw: bytes) -> int:
    if b"\n" not in raw:
        return 0
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _repeated(words: Words) -> np.ndarray:
    """Words in windows that their text holds twice or more, for each text."""
    first, value = words.windows(WINDOW)
    key = mix(value + mix(words.doc[first].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words.id) + 1, np.int64)
    np.add.at(step, first[twice], 1)
    np.add.at(step, first[twice] + WINDOW, -1)
    return words.per_doc(np.cumsum(step[:-1]) > 0)


def measure(raws: list[bytes]) -> np.ndarray:
    """The MEASURES of each text, a row for each."""
    out = np.zeros((len(raws), len(MEASURES)), np.int64)
    for lo, hi in slices(raws):
        words = Words(raws[lo:hi])
        ends = words.doc_end
        part = out[lo:hi]
        part[:, 0] = words.per_doc()
        for column, mask in ((1, ~words.space & ~_CONTINUES[words.buffer]), (2, _SYMBOL[words.buffer])):
            total = np.concatenate([[0], np.cumsum(mask)])
            part[:, column] = total[ends] - total[np.concatenate([[0], ends[:-1]])]
        part[:, 3] = [_duplicate_lines(r) for r in raws[lo:hi]]
        part[:, 4] = _repeated(words)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_large()
    for batch in small(batches):
        at = batch.schema.get_field_index("_measured")
        values = measure(raw_texts(batch.column(at)))
        columns = [c for i, c in enumerate(batch.columns) if i != at] + [pa.array(values[:, k]) for k in range(len(MEASURES))]
        names = [n for i, n in enumerate(batch.schema.names) if i != at] + MEASURES
        yield pa.RecordBatch.from_arrays(columns, names=names)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def soft_failed() -> Column:
    """Rules that alone do not reject a document: many symbols, many repeated lines, odd word lengths."""
    return ((10 * F.col("n_symbols") > F.col("n_words")) | (20 * F.col("n_dup_lines") > F.col("n_words"))
            | (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")))


def measure_documents(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the MEASURES of every whole text."""
    rows = bounded(docs).select(*keep, F.col(text).alias("_measured"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return rows.mapInArrow(_measured, f"{kept}, " + ", ".join(f"{m} long" for m in MEASURES))


def host_verdicts(measured: DataFrame, *, host: str = "host", reject_rate: float = 0.5, suspect_rate: float = 0.2,
                  suspect_factor: float = 2.0) -> DataFrame:
    """One row for each host: its documents, failures, shrunk failure rate and verdict (good, suspect or bad).

    A document fails if it fails the base rules or a soft one.  The prior of a host's rate is a beta distribution fitted to all
    hosts by their moments: mean ``m`` (failures of all documents) and the variance between hosts beyond what counting alone gives.
    The shrunk rate is the posterior mean; a small host stays near ``m``.
    """
    per_host = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("docs"), F.sum((base_failed() | soft_failed()).cast("long")).alias("failures"))
    prior = per_host.agg(
        F.sum("docs").alias("all_docs"), F.sum("failures").alias("all_failures"), F.count("*").alias("hosts"),
        F.sum(F.col("failures") * F.col("failures") / F.col("docs")).alias("squares"))
    mean = F.col("all_failures") / F.col("all_docs")
    noise = mean * (1 - mean)
    spread = F.greatest(F.col("squares") / F.col("all_docs") - mean * mean - F.col("hosts") * noise / F.col("all_docs"), F.lit(1e-9))
    prior = prior.select(mean.alias("mean_rate"), F.greatest(F.lit(1.0), F.least(F.lit(1e6), noise / spread - 1)).alias("strength"))
    shrunk = (F.col("failures") + F.col("mean_rate") * F.col("strength")) / (F.col("docs") + F.col("strength"))
    rated = per_host.join(prior).withColumn("host_rate", shrunk)  # the prior is one row
    verdict = F.when(F.col("host_rate") > reject_rate, "bad").when(
        (F.col("host_rate") > suspect_rate) & (F.col("host_rate") > suspect_factor * F.col("mean_rate")), "suspect").otherwise("good")
    return rated.select("host", "docs", "failures", "host_rate", verdict.alias("host_verdict"))


def assess(docs: DataFrame, *, host: str = "source", keep: list[str] | None = None, text: str = "text", **rates: float) -> DataFrame:
    """Every row of ``docs``: the columns ``keep`` (default doc_id), the MEASURES, base_failed, host_rate, host_verdict and kept.

    Documents that fail the base rules are rejected; so are all of a bad host, and those of a suspect host that fail a soft rule.

    A null or empty text has no words and fails; a document without host has no host verdict and is judged by the base rules; repeated
    rows count and are judged each; very long texts are read whole; columns of ``docs`` that are not kept may have any name; an empty
    table gives no rows.  The measures are written once to the shared folder, since hosts and documents both read them.
    """
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(F.col(host).cast("string").alias("_host"), F.col(text).alias("_text"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)])
    measured = materialise(measure_documents(rows, ["_host", *[f"_k{i}" for i in range(len(keep))]], "_text"))
    hosts = host_verdicts(measured, host="_host", **rates)
    joined = measured.join(hosts, F.col("_host") == F.col("host"), "left")
    verdict = F.coalesce(F.col("host_verdict"), F.lit("good"))
    kept = ~base_failed() & (verdict != "bad") & ~((verdict == "suspect") & soft_failed())
    return joined.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], *MEASURES, base_failed().alias("base_failed"),
                         "host_rate", "host_verdict", kept.alias("kept"))


def drop_rejected(docs: DataFrame, *, host: str = "source", text: str = "text", **rates: float) -> DataFrame:
    """``docs`` without the rows that ``assess`` rejects.  ``docs`` is read twice and must give the same rows both times, as files do;
    other rows are noticed by a hash and end the job."""
    rows = placed(docs.select(F.col(host).alias("host"), F.col(text).alias("text"), check_of([host, text]).alias("check")))
    judged = assess(rows, host="host", keep=["uid", "check"], text="text", **rates)
    return without(docs, judged.where(~F.col("kept")), [host, text])


_ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, s) >= 2),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, unnest(range(0, 8)) AS k FROM r) GROUP BY rid),
m AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN c USING (rid)),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         10 * n_symbols > n_words OR 20 * n_dup_lines > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS soft_failed
  FROM m),
h AS (SELECT source, count(*) AS docs, CAST(sum(CASE WHEN base_failed OR soft_failed THEN 1 ELSE 0 END) AS DOUBLE) AS failures
      FROM f WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT sum(docs) AS n, sum(failures) / sum(docs) AS m, count(*) AS hosts, sum(failures * failures / docs) AS squares FROM h),
p AS (SELECT m, greatest(1.0, least(1e6, m * (1 - m) / greatest(squares / n - m * m - hosts * (m * (1 - m)) / n, 1e-9) - 1)) AS s FROM a),
v AS (SELECT source, (failures + m * s) / (docs + s) AS rate, m FROM h, p)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rate > 0.5, false) AND NOT (soft_failed AND coalesce(rate > 0.2 AND rate > 2 * m, false)) AS kept
FROM f LEFT JOIN v ON f.source = v.source
"""


@query("op6_quality", _ORACLE)
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir)).select("doc_id", *MEASURES, "base_failed", "kept")
