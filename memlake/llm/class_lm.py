"""Class-based n-gram scoring: words are put into classes by exchange, and a text is scored by class transitions and word emissions.

    log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(word | class)

Tokens are the lower-cased (A-Z) words of a text and one end; the end also stands before the first word.  Words with at least
``MIN_SHARE`` of the training tokens, of which there can be no more than ``1 / MIN_SHARE``, are clustered; all rarer ones form one further
class, the tail, in which each word has its own count.  The list of clustered words is therefore small however large the corpus is;
the counts of the tail stay in a table that is joined.

Exchange: in each round every clustered word is tried in every class against the class bigram counts of the round before, and the
better half of the improving moves is made.  Word bigrams are counted once, in parts, and each round adds them up by class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.language import held_out
from memlake.llm.registry import query, table
from memlake.llm.words import Words, bounded, raw_texts, slices, small
from memlake.session import materialise

MIN_SHARE = 5e-6
CLASSES = 32
ROUNDS = 8
SMOOTHING = 10.0
FLUSH_TOKENS = 2_000_000
CHUNK = 256


def _lowered(column: pa.Array) -> list[bytes]:
    return [r.lower() for r in raw_texts(column)]  # bytes.lower changes A-Z only


def _added(ids: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, number = np.unique(np.concatenate(ids), return_inverse=True)
    return keys, np.bincount(number, weights=np.concatenate(weights), minlength=len(keys)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bool, list[np.ndarray]] = {True: [], False: []}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for train, parts in held.items():
            if parts:
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                counts = pa.array(counts.astype(np.int64))
                zero = pa.array(np.zeros(len(keys), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), counts if train else zero, counts], names=["wid", "n_train", "n_all"])
                parts.clear()

    for batch in small(batches):
        raws, train = _lowered(batch.column("text")), batch.column("train").to_numpy(zero_copy_only=False)
        for lo, hi in slices(raws):
            words = Words(raws[lo:hi])
            chosen = train[lo:hi][words.doc].astype(bool)
            held[True].append(words.id[chosen])
            held[False].append(words.id[~chosen])
            size += len(words.id)
            if size > FLUSH_TOKENS:
                yield from flush()
                size = 0
    yield from flush()


class Frequent:
    """The clustered words: sorted ids and their training counts.  Index ``len`` is the tail, ``len + 1`` the end."""

    def __init__(self, wid: np.ndarray, n_train: np.ndarray):
        self.wid, self.n_train = wid, n_train
        self.tail, self.end = len(wid), len(wid) + 1

    def index(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.wid):
            return np.full(len(ids), self.tail)
        at = np.minimum(np.searchsorted(self.wid, ids), len(self.wid) - 1)
        return np.where(self.wid[at] == ids, at, self.tail)


def _chain(words: Words, index: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, word before and word of every token, ends last in each text."""
    counts = words.per_doc()
    doc = np.repeat(np.arange(words.n_docs), counts + 1)
    last = np.cumsum(counts + 1) - 1
    now = np.empty(len(doc), np.int64)
    is_end = np.zeros(len(doc), bool)
    is_end[last] = True
    now[is_end] = end
    now[~is_end] = index
    before = np.concatenate([[end], now[:-1]]) if len(now) else now
    return doc, before, now  # the token before a text's first is the end of the text before it


def _bigram_counter(wid: np.ndarray, n_train: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(wid, n_train)
        width = frequent.end + 1
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = _added(held, counts)
            yield pa.RecordBatch.from_arrays([pa.array((keys // width).astype(np.int32)), pa.array((keys % width).astype(np.int32)), pa.array(n)], names=["left", "right", "n"])
            held.clear()
            counts.clear()

        for batch in small(batches):
            raws = _lowered(batch.column("text"))
            for lo, hi in slices(raws):
                words = Words(raws[lo:hi])
                _, before, now = _chain(words, frequent.index(words.id), frequent.end)
                keys, n = np.unique(before * width + now, return_counts=True)
                held.append(keys)
                counts.append(n)
                size += len(keys)
                if size > FLUSH_TOKENS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _class_vectors(classes: np.ndarray, contexts: int):
    """Partial counts of each index with the classes after and before it, and with itself, in chunks of words."""
    words, width = len(classes), 2 * contexts + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(words * width, np.int64)
        for batch in batches:
            left, right, n = (batch.column(k).to_numpy() for k in range(3))
            np.add.at(total, left.astype(np.int64) * width + classes[right], n)
            np.add.at(total, right.astype(np.int64) * width + contexts + classes[left], n)
            same = left == right
            np.add.at(total, left[same].astype(np.int64) * width + 2 * contexts, n[same])
        total = total.reshape(words, width)
        for chunk in range(0, words, CHUNK):
            part = total[chunk:chunk + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk // CHUNK], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "counts"])

    return run


def _add_chunks(contexts: int):
    width = 2 * contexts + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, None
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(raw, np.int64)
                if chunk != current:
                    if total is not None:
                        yield _out(current, total)
                    current, total = chunk, values.copy()
                else:
                    total += values
        if total is not None:
            yield _out(current, total)

    def _out(chunk: int, total: np.ndarray) -> pa.RecordBatch:
        rows = total.reshape(-1, width)
        return pa.RecordBatch.from_pydict({"word": np.arange(len(rows)) + chunk * CHUNK, "counts": list(rows)},
                                          schema=pa.schema([("word", pa.int64()), ("counts", pa.list_(pa.int64()))]))

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def best_move(table_of: np.ndarray, counts: np.ndarray, now: int, classes: int) -> tuple[int, float]:
    """The class that raises the class bigram likelihood most if a word moves there, and by how much.

    The likelihood is the sum of ``n log n`` over class pairs less those over the classes' row and column sums.  ``counts`` are the
    word's counts with each class after it, before it, and with itself.
    """
    contexts = len(table_of)
    after, before, own = counts[:contexts].astype(float), counts[contexts:2 * contexts].astype(float), float(counts[-1])
    after, before = after.copy(), before.copy()
    after[now] -= own  # the word itself apart
    before[now] -= own
    base = table_of.astype(float).copy()
    base[now, :] -= after
    base[:, now] -= before
    base[now, now] -= own
    # Sums of rows and columns with the word's neighbours, which stay in their classes; only the word's own part goes with it.
    rows, columns = base.sum(1) + before, base.sum(0) + after
    # Placed into class b: row b gains `after`, column b gains `before`, and the cell (b, b) also the word with itself.
    b = np.arange(classes)
    row_new, column_new = base[:classes] + after[None, :], base[:, :classes].T + before[None, :]
    gain = (_xlogx(row_new) - _xlogx(base[:classes])).sum(1) + (_xlogx(column_new) - _xlogx(base[:, :classes].T)).sum(1)
    cell = base[b, b]
    gain += _xlogx(cell + after[b] + before[b] + own) - _xlogx(cell + after[b]) - _xlogx(cell + before[b]) + _xlogx(cell)
    moved_after, moved_before = after.sum() + own, before.sum() + own
    gain -= _xlogx(rows[b] + moved_after) - _xlogx(rows[b]) + _xlogx(columns[b] + moved_before) - _xlogx(columns[b])
    best = int(gain.argmax())
    return best, float(gain[best] - gain[now])


def _movers(table_of: np.ndarray, assigned: np.ndarray, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_numpy()
            found = [best_move(table_of, c.values.to_numpy(), int(assigned[w]), classes) if assigned[w] < classes else (int(assigned[w]), 0.0)
                     for w, c in zip(words.tolist(), batch.column("counts"))]
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64())],
                                             names=["word", "to", "gain"])

    return run


def _class_table(vectors: DataFrame, assigned: np.ndarray, contexts: int) -> np.ndarray:
    """Class bigram counts, ``contexts`` squared numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((contexts, contexts), np.int64)
        for batch in batches:
            after = batch.column("counts").flatten().to_numpy().reshape(batch.num_rows, -1)[:, :contexts]
            np.add.at(total, assigned[batch.column("word").to_numpy()], after)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], names=["cell", "n"])

    out = np.zeros(contexts * contexts, np.int64)
    for row in vectors.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return out.reshape(contexts, contexts)


def likelihood(table_of: np.ndarray) -> float:
    """The part of the class bigram log-likelihood that depends on the classes."""
    return float(_xlogx(table_of.astype(float)).sum() - _xlogx(table_of.sum(0).astype(float)).sum() - _xlogx(table_of.sum(1).astype(float)).sum())


def exchange(bigrams: DataFrame, frequent: Frequent, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each index (words, tail, end) and the class bigram counts.  ``bigrams`` (left, right, n) may hold a pair several times.

    Words start in the classes in turn, the most frequent first.  A round that does not raise the likelihood is taken back and the next
    one makes fewer moves.  Each round reads the bigrams once; a task sums ``words x classes`` numbers at most.
    """
    contexts = classes + 2
    assigned = np.empty(frequent.end + 1, np.int64)
    assigned[np.lexsort((frequent.wid, -frequent.n_train))] = np.arange(frequent.tail) % classes
    assigned[frequent.tail], assigned[frequent.end] = classes, classes + 1
    tasks = max(1, bigrams.sparkSession.sparkContext.defaultParallelism)
    best: tuple | None = None
    part = 0.5
    for turn in range(rounds + 1):
        partial = bigrams.coalesce(tasks).mapInArrow(_class_vectors(assigned, contexts), "chunk int, counts binary")
        vectors = materialise(partial.repartition(tasks, "chunk").sortWithinPartitions("chunk").mapInArrow(_add_chunks(contexts), "word long, counts array<long>"))
        table_of = _class_table(vectors, assigned, contexts)
        if best is None or likelihood(table_of) > likelihood(best[1]):
            best = assigned, table_of, vectors
        else:
            part /= 4
        if turn == rounds:
            break
        moves = best[2].mapInArrow(_movers(best[1], best[0], classes), "word long, to int, gain double").where("gain > 1e-9").toArrow()
        if not moves.num_rows:
            break
        word, to, gain = (moves.column(k).to_numpy() for k in range(3))
        order = np.lexsort((word, -gain))[:max(1, int(len(word) * part))]
        assigned = best[0].copy()
        assigned[word[order]] = to[order]
    return best[0], best[1]


def _scorer(wid: np.ndarray, n_train: np.ndarray, hot_wid: np.ndarray, hot_train: np.ndarray, assigned: np.ndarray, transition: np.ndarray, emission: np.ndarray, end_count: int):
    """Per text what the clustered words, the end and the hot tail words give, and its other tail words with their counts in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, hot = Frequent(wid, n_train), Frequent(hot_wid, hot_train)
        hot_base = np.log10(hot_train + 0.5)
        seen = np.concatenate([n_train, [0, end_count]])
        base = np.log10(seen + 0.5)
        base[frequent.tail] = 0.0
        for batch in small(batches):
            raws = _lowered(batch.column("text"))
            for lo, hi in slices(raws):
                words = Words(raws[lo:hi])
                index = frequent.index(words.id)
                doc, before, now = _chain(words, index, frequent.end)
                n = hi - lo
                total = np.bincount(doc, minlength=n)
                model = np.bincount(doc, transition[assigned[before], assigned[now]] + emission[now], n)
                in_tail = np.bincount(doc, assigned[now] == assigned[frequent.tail], n).astype(np.int64)
                rare = index == frequent.tail
                place = hot.index(words.id[rare])
                is_hot = place < hot.tail
                hot_doc, place = words.doc[rare][is_hot], place[is_hot]
                hot_part = np.bincount(hot_doc, hot_base[place], n)
                known = np.bincount(doc, seen[now] > 0, n) + np.bincount(hot_doc, hot_train[place] > 0, n)
                keys, first, many = _pairs(words.doc[rare][~is_hot], words.id[rare][~is_hot])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=n))]).astype(np.int32)
                part = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), part.column("doc_id"), part.column("held_out"), pa.array(total.astype(np.int64)),
                     pa.array(known.astype(np.int64)), pa.array(np.bincount(doc, base[now], n) + hot_part), pa.array(model + hot_part), pa.array(in_tail),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(first.view(np.int64))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(many))],
                    names=["uid", "doc_id", "held_out", "n_tokens", "known", "base", "model", "in_tail", "wids", "ns"])

    return run


def _pairs(doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, word) with counts, in order of the texts."""
    order = np.lexsort((ids, doc))
    doc, ids = doc[order], ids[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (ids[1:] != ids[:-1])
    at = np.flatnonzero(new)
    return doc[at], ids[at], np.diff(np.concatenate([at, [len(doc)]])).astype(np.int64)


def score(docs: DataFrame, held: Column, *, min_share: float = MIN_SHARE, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out (the condition ``held``), n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the whole texts of all rows that are not held out, repeated ones as often as they come.  ``base_score`` is a
    smoothed unigram model of the same tokens; both are log10 probabilities, of the whole text and its end.

    A null or empty text is its end alone; words that training lacks are emitted by the tail as one more word that was never seen;
    without training rows all scores are those of the smoothing alone; other columns are not looked at; an empty table gives no rows.
    """
    rows = bounded(docs).select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held, F.lit(False)).alias("held_out"))
    counted = rows.select("text", (~F.col("held_out")).alias("train")).mapInArrow(_count_words, "wid long, n_train long, n_all long")
    vocabulary = materialise(counted.groupBy("wid").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all")))
    ends = rows.agg(F.sum((~F.col("held_out")).cast("long")).alias("train"), F.count("*").alias("docs")).first()
    sums = vocabulary.agg(F.sum("n_train").alias("train"), F.sum("n_all").alias("words"), F.sum((F.col("n_train") > 0).cast("long")).alias("types")).first()
    train_docs = ends["train"] or 0
    train_tokens = (sums["train"] or 0) + train_docs
    types = (sums["types"] or 0) + (train_docs > 0)
    # What is learned depends on training texts only.
    clustered = (F.col("n_train") > 0) & (F.col("n_train") >= min_share * train_tokens)
    # Tail words that are frequent in all texts would be hot keys of the join below, so their counts go to the scorer.
    hot_tail = ~clustered & (F.col("n_all") >= min_share * ((sums["words"] or 0) + ends["docs"]))

    def sorted_words(which: Column) -> Frequent:
        listed = vocabulary.where(which).toArrow()  # 1 / min_share words at most
        wid, n_train = listed.column("wid").to_numpy().view(np.uint64), listed.column("n_train").to_numpy()
        order = np.argsort(wid)
        return Frequent(wid[order], n_train[order])

    frequent, hot = sorted_words(clustered), sorted_words(hot_tail)

    bigrams = materialise(rows.where(~F.col("held_out")).select("text").mapInArrow(_bigram_counter(frequent.wid, frequent.n_train), "left int, right int, n long"))
    assigned, table_of = exchange(bigrams, frequent, classes, rounds)

    contexts = classes + 2
    by_class = table_of.sum(0).astype(float)
    prior = (by_class + 1) / (by_class.sum() + contexts)
    transition = np.log10((table_of + SMOOTHING * prior[None, :]) / (table_of.sum(1, keepdims=True) + SMOOTHING))
    tail_tokens = train_tokens - train_docs - int(frequent.n_train.sum())
    tail_types = types - (train_docs > 0) - frequent.tail
    of_class = np.bincount(assigned[:frequent.tail], frequent.n_train, contexts)
    emission = np.zeros(frequent.end + 1)
    emission[:frequent.tail] = np.log10(frequent.n_train / of_class[assigned[:frequent.tail]])
    tail_scale = float(np.log10(tail_tokens + 0.5 * (tail_types + 1)))
    base_scale = float(np.log10(train_tokens + 0.5 * (types + 1)))

    parts = materialise(rows.mapInArrow(_scorer(frequent.wid, frequent.n_train, hot.wid, hot.n_train, assigned, transition, emission, train_docs),
                                        "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, in_tail long, wids array<long>, ns array<long>"))
    rare = parts.select("uid", F.explode(F.arrays_zip("wids", "ns")).alias("w")).select("uid", F.col("w.wids").alias("wid"), F.col("w.ns").alias("n"))
    known = vocabulary.where(~clustered & ~hot_tail & (F.col("n_train") > 0)).select("wid", "n_train")
    # None of these words has more than min_share of the tokens, so no key of this join is hot.
    met = rare.join(known, "wid", "left").withColumn("c", F.coalesce("n_train", F.lit(0)))
    tails = met.groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("tail"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    zero = F.lit(0.0)
    return parts.join(tails, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail", zero) - F.col("n_tokens") * F.lit(base_scale)).alias("base_score"),
        (F.col("model") + F.coalesce("tail", zero) - F.col("in_tail") * F.lit(tail_scale)).alias("score"))


@query("op5_class_lm")
def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir), held_out(1))
