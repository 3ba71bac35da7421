"""Language identification: each document as a mixture of languages, fitted by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.registry import query, table
from memlake.llm.worker import kept
from memlake.llm.words import bounded, mix, small

UNDETERMINED = "und"
BITS = 18
SMOOTHING = 0.1
PENALTY = 2.0  # for each language beyond the first, times the log of the number of letters
SLICE_CHARS = 1 << 20
ITERATIONS = 50
#: Languages of a model: its size on the driver and in each task is 4 * 2**BITS bytes for each, 134 MB for all.
MAX_LANGS = 128


def _letters() -> np.ndarray:
    return kept("letters", lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of the trigram around each letter; everything else is a space, and texts are apart."""
    lowered = [(t or "").lower() for t in texts]
    joined = "  ".join(["", *lowered, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    shown = np.where(letter, points, 32).astype(np.uint64)
    at = np.flatnonzero(letter)
    value = shown[at - 1] | shown[at] << np.uint64(21) | shown[at + 1] << np.uint64(42)
    ends = np.cumsum([len(t) + 2 for t in lowered]) + 2
    return (mix(value) >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(ends, at, side="right")


def _text_slices(texts: list) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "") + 2
        if size and size + n > SLICE_CHARS:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(counts[seen])],
                                             names=["lang", "bucket", "n"])
        held.clear()

    for batch in small(batches):
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for lo, hi in _text_slices(texts):
            bucket, doc = trigrams(texts[lo:hi])
            names, number = np.unique(np.array(langs[lo:hi], object).astype(str), return_inverse=True)
            for k, lang in enumerate(names.tolist()):
                counts = np.bincount(bucket[number[doc] == k], minlength=1 << BITS)
                held[lang] = held[lang] + counts if lang in held else counts
            if len(held) > 32:
                yield from flush()
    yield from flush()


class Model:
    """Log probabilities of trigram buckets by language; at most 2**BITS numbers for each."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.log_p = np.zeros((1 << BITS, len(self.langs)), np.float32)
        for k, lang in enumerate(self.langs):
            dense = np.full(1 << BITS, SMOOTHING)
            dense[counts[lang][0]] += counts[lang][1]
            self.log_p[:, k] = np.log(dense / dense.sum())


def mixture(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions that fit the counts ``n`` best under the columns of ``p``, and the log-likelihood, by expectation-maximisation."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(ITERATIONS):
        joint = p * share
        total = joint.sum(1)
        new = (joint / total[:, None] * n[:, None]).sum(0) / n.sum()
        if np.abs(new - share).max() < 1e-6:
            break
        share = new
    return share, float((n * np.log((p * share).sum(1))).sum())


def select_languages(log_p: np.ndarray, n: np.ndarray, penalty: float) -> tuple[list[int], np.ndarray]:
    """Languages of one text and their proportions: the best one, then the best further one as long as the penalised likelihood rises."""
    p = np.exp((log_p - log_p.max(1, keepdims=True)).astype(np.float64))
    chosen = [int((n @ log_p).argmax())]
    share, value = np.ones(1), float(n @ np.log(p[:, chosen[0]]))
    while len(chosen) < p.shape[1]:
        now = (p[:, chosen] * share).sum(1)
        tries = []
        for k in range(p.shape[1]):
            # The likelihood is concave along the added share, so this slope bounds what the language can add.
            if k not in chosen and float(n @ (p[:, k] / now)) - n.sum() > penalty:
                new_share, new_value = mixture(p[:, [*chosen, k]], n)
                tries.append((new_value, k, new_share))
        if not tries or max(tries, key=lambda t: t[0])[0] - value <= penalty:
            break
        value, k, share = max(tries, key=lambda t: t[0])
        chosen.append(k)
    return chosen, share


def identify(texts: list[str | None], model: Model, penalty: float = PENALTY) -> tuple[list[str], np.ndarray, list[list[str]], list[list[float]]]:
    """Language, score, all languages and their proportions of each text."""
    langs = model.langs
    pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    sets: list[list[str]] = [[] for _ in texts]
    shares: list[list[float]] = [[] for _ in texts]
    if not langs:
        return pred, score, sets, shares
    for lo, hi in _text_slices(texts):
        bucket, doc = trigrams(texts[lo:hi])
        if not len(doc):
            continue
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        log_p = model.log_p[bucket]
        size = np.diff(np.concatenate([first, [len(doc)]]))
        total = np.add.reduceat(log_p, first, axis=0, dtype=np.float64)
        best = total.argmax(1)
        own = log_p[np.arange(len(doc)), np.repeat(best, size)]
        slope = np.add.reduceat(np.exp(np.minimum(log_p - own[:, None], 60)), first, axis=0, dtype=np.float64) - size[:, None]
        slope[np.arange(len(first)), best] = 0
        odds = np.exp(total - total.max(1, keepdims=True))
        sure = 1 / odds.sum(1)
        limit = penalty * np.log(size + 1)
        for j, (a, n) in enumerate(zip(first.tolist(), size.tolist())):
            i = lo + int(doc[a])
            chosen, share = [int(best[j])], np.ones(1)
            if slope[j].max() > limit[j]:
                own_buckets, counts = np.unique(bucket[a:a + n], return_counts=True)
                chosen, share = select_languages(model.log_p[own_buckets], counts.astype(np.float64), float(limit[j]))
            top = int(share.argmax())
            pred[i] = langs[chosen[top]]
            score[i] = float(share[top]) * (float(sure[j]) if len(chosen) == 1 else 1.0)
            order = np.argsort(-share, kind="stable").tolist()
            sets[i], shares[i] = [langs[chosen[k]] for k in order], [float(share[k]) for k in order]
    return pred, np.clip(score, 0, 1), sets, shares


def train(labelled: DataFrame, max_langs: int = MAX_LANGS) -> Model:
    """A model of all whole texts of ``labelled`` (text, lang); rows without text or lang teach nothing.

    Counts are added up by Spark; what reaches the driver is at most 2**BITS numbers for each language.  A model has ``max_langs`` languages
    at most: with more values of lang than that, those of the most rows (ties: the name that sorts first), and rows of others teach nothing.
    """
    names = labelled.where(F.col("lang").isNotNull()).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("rows"))
    known = [r["lang"] for r in names.orderBy(F.col("rows").desc(), "lang").limit(max_langs).collect()]
    labelled = labelled.where(F.col("lang").cast("string").isin(known)) if known else labelled.where(F.lit(False))
    rows = bounded(labelled).where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    summed = rows.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toArrow().to_pandas()
    return Model({lang: (part["bucket"].to_numpy(), part["n"].to_numpy()) for lang, part in found.groupby("lang")})


def predict(docs: DataFrame, model: Model, *, keep: list[str] | None = None, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """The columns ``keep`` (default doc_id), lang_pred, score, and ``languages``: all languages found with their proportions.

    A null text and one without a letter are ``und`` with score 0, and so is every text if nothing was learned; ties go to the
    language whose name sorts first; repeated rows get equal answers; very long texts are read whole; other columns are not looked at.
    The score is the proportion of the language, for a single language its posterior probability.
    """
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_p))
    rows = bounded(docs).select(*keep, F.col(text).alias("_read"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    found_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Model({})
        learned.langs, learned.log_p = shared.value
        for batch in small(batches):
            at = batch.schema.get_field_index("_read")
            pred, score, sets, shares = identify(batch.column(at).to_pylist(), learned, penalty)
            found = [[{"lang": a, "share": b} for a, b in zip(*x)] for x in zip(sets, shares)]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score), pa.array(found, found_type)],
                                             names=[*names, "lang_pred", "score", "languages"])

    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def held_out(remainder: int = 0):
    """Whether crc32 of the doc_id as text leaves ``remainder`` when divided by 5; no doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == remainder


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    model = train(docs.where(~held_out()))
    found = predict(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
