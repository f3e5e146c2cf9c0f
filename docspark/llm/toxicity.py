"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in NumPy.

A word is the mean of the vectors of its character n-grams, so an unseen misspelling shares most of
them with the word it hides. Texts are scored by their worst window of a few words, since one insult in a
long text vanishes in the mean of the whole; training starts on whole-text means and goes on with each
text's best window. The training sample is bounded; every row is scored, on Spark, from a model of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut

#: Bytes that end a word besides white space.
ENDS = b'.,;:!?"()[]{}|<>&/\\'

_INSIDE = ~K.SPACE
_INSIDE[list(ENDS)] = False


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    width: int = 8
    shortest: int = 3
    longest: int = 5
    window: int = 4
    per_class: int = 900
    most_chars: int = 20_000
    mean_rounds: int = 6
    window_rounds: int = 150
    mean_gain: float = 20.0
    drop: float = 0.4
    rate: float = 0.05
    decay: float = 1e-3
    seed: int = 7


@dataclass
class Model:
    settings: Settings
    embedding: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def subword_scores(self) -> np.ndarray:
        """Each bucket's part of the logit: a mean of embeddings times a vector is a mean of scalars."""
        return self.embedding @ (self.output[:, 1] - self.output[:, 0])


def word_spans(block: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, each text's first word."""
    data = K.LOWER[block.data]
    starts, ends = K.spans(_INSIDE[data], block.ptr)
    return data, starts, ends, np.searchsorted(starts, block.ptr)


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of ``<word>`` and of the whole, and how many each word has."""
    sizes = ends - starts + 2
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    text = np.empty(ptr[-1], np.uint8)
    inner = K.ragged(ends - starts)
    text[np.repeat(ptr[:-1] + 1, ends - starts) + inner] = data[np.repeat(starts, ends - starts) + inner]
    text[ptr[:-1]], text[ptr[1:] - 1] = 60, 62
    sums = K.prefix(text)
    found, owners = [K.hashes(sums, ptr[:-1], ptr[1:])], [np.arange(len(starts))]
    for n in range(s.shortest, s.longest + 1):
        counts = np.maximum(0, sizes - n + 1)
        counts[sizes == n] = 0  # that is the whole word
        owner = np.repeat(np.arange(len(starts)), counts)
        at = ptr[owner] + K.ragged(counts)
        found.append(K.hashes(sums, at, at + n))
        owners.append(owner)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(found)[order] % np.uint64(s.buckets)).astype(np.int64), np.bincount(owner, minlength=len(starts))


def distinct_words(block: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, starts, ends, first = word_spans(block)
    _, at, which = np.unique(K.hashes(K.prefix(data), starts, ends), return_index=True, return_inverse=True)
    return data, starts[at], ends[at], which.reshape(-1), first


class Windows:
    """All windows of ``size`` words of each text (one shorter window in a shorter text)."""

    def __init__(self, first: np.ndarray, size: int) -> None:
        n = np.diff(first)
        self.n_texts, self.sizes = len(n), np.minimum(n, size)
        counts = np.where(n > 0, n - self.sizes + 1, 0)
        self.owner = np.repeat(np.arange(len(n)), counts)
        self.at = first[:-1][self.owner] + K.ragged(counts)
        self.size = self.sizes[self.owner]
        self.has = np.flatnonzero(counts)
        self.begin = (np.cumsum(counts) - counts)[self.has]

    def best(self, score: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest mean over each text's windows (0 without words) and, if asked, that window's first word."""
        best = np.zeros(self.n_texts)
        if not len(self.has):
            return best, np.zeros(0, np.int64)
        total = np.concatenate([[0.0], np.cumsum(score, dtype=np.float64)])
        means = (total[self.at + self.size] - total[self.at]) / self.size
        best[self.has] = np.maximum.reduceat(means, self.begin)
        if not where:
            return best, None
        hits = np.flatnonzero(means == best[self.owner])
        _, first = np.unique(self.owner[hits], return_index=True)
        return best, self.at[hits[first]]


def train(texts: list[str], toxic: np.ndarray, s: Settings) -> Model:
    """Joint training of embeddings and softmax by full-batch Adam; classes weigh the same.

    Part of the n-grams is left out at random in each round, so that no word hangs on a few of them.
    """
    rng = np.random.default_rng(s.seed)
    block = next(K.blocks(pa.array([*texts, "x"], pa.large_string()), 1 << 62))
    data, ws, we, which, first = distinct_words(block)
    first = first[: len(texts) + 1]
    which = which[: first[-1]]
    bucket, per_word = subwords(data, ws, we, s)
    begin = np.cumsum(per_word) - per_word
    E, W, b = rng.normal(0, 0.1, (s.buckets, s.width)), rng.normal(0, 0.5, (s.width, 2)), np.zeros(2)
    params = [E, W, b]
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
    balance = np.where(toxic == 1, 0.5 / (toxic == 1).sum(), 0.5 / (toxic == 0).sum())
    windows, n = Windows(first, s.window), np.diff(first)
    sums = lambda values, index, size: np.stack([np.bincount(index, values[:, j], size) for j in range(values.shape[1])], axis=1)
    for t in range(1, s.mean_rounds + s.window_rounds + 1):
        if t <= s.mean_rounds:
            doc, word, size = np.repeat(np.arange(len(texts)), n), which, n
        else:
            part = E @ (W[:, 1] - W[:, 0])
            scores = np.add.reduceat(part[bucket], begin) / per_word
            _, at = windows.best(scores[which], where=True)
            size = windows.sizes
            doc = np.repeat(windows.has, size[windows.has])
            word = which[np.repeat(at, size[windows.has]) + K.ragged(size[windows.has])]
        used, word = np.unique(word, return_inverse=True)
        entry = np.repeat(begin[used], per_word[used]) + K.ragged(per_word[used])
        owner = np.repeat(np.arange(len(used)), per_word[used])
        keep = rng.random(len(entry)) >= s.drop
        entry, owner = bucket[entry[keep]], owner[keep]
        left = np.maximum(1, np.bincount(owner, minlength=len(used)))[:, None]
        vectors = sums(E[entry], owner, len(used)) / left
        share = (1.0 / np.maximum(1, size))[:, None] * (s.mean_gain if t <= s.mean_rounds else 1.0)
        pooled = sums(vectors[word], doc, len(texts)) * share
        logits = pooled @ W + b
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(texts)), toxic] -= 1
        p *= balance[:, None]
        g_words = sums(((p @ W.T) * share)[doc], word, len(used)) / left
        grads = [sums(g_words[owner], entry, s.buckets) + s.decay * E / len(texts), pooled.T @ p + s.decay * W, p.sum(0)]
        for x, g, (m, v) in zip(params, grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(s, E.astype(np.float32), W.astype(np.float32), b.astype(np.float32))


def training_sample(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[list[str], np.ndarray]:
    """At most ``per_class`` texts of each class with at most ``most_chars`` code points, no text twice.

    ``labels``: ``doc_id, toxic``; an id labelled both ways counts as toxic; null labels don't count. The
    sample is the rows of smallest hash, so reruns agree.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic"))
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    # Chosen by numbers alone; the few chosen rows (their count is bounded) then fetch their texts in a scan.
    rows = hashed.filter(F.length("text").between(1, s.most_chars)).select("doc_id", "h").join(marks, F.col("doc_id") == F.col("__id"))
    rows = rows.groupBy("toxic", "h").agg(F.min("doc_id").alias("id")).select("toxic", F.col("h").alias("k"), "id")
    chosen = cut(rows.filter("toxic = 0").orderBy("k").limit(s.per_class).union(rows.filter("toxic = 1").orderBy("k").limit(s.per_class)))
    found = hashed.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("h") == F.col("k")))
    # Repeated rows of a chosen id and text meet before the driver gets one of each.
    found = found.groupBy("toxic", "k").agg(F.min("text").alias("text")).collect()
    found = sorted(((r.toxic, r.k), r.text) for r in found)
    texts, toxic = [text for _, text in found], [mark for (mark, _), _ in found]
    return texts, np.array(toxic, np.int64)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted`` of every row; null and empty texts get the score of no words."""
    s, part_of_logit, bias = model.settings, model.subword_scores(), float(model.bias[1] - model.bias[0])

    def run(batches):
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                data, ws, we, which, first = distinct_words(block)
                bucket, per_word = subwords(data, ws, we, s)
                word_scores = np.bincount(np.repeat(np.arange(len(ws)), per_word), part_of_logit[bucket], len(ws)) / np.maximum(1, per_word)
                logit, _ = Windows(first, s.window).best(word_scores[which])
                p = 1 / (1 + np.exp(-(logit + bias)))
                ids = batch.slice(block.row, len(block)).column("doc_id")
                yield pa.RecordBatch.from_arrays([ids, pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def detect(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, threshold: float = 0.7, folds: int = 3, held_out: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id, text``; others unread).

    Labels of the fold ``held_out`` (crc32 of the id as text, modulo ``folds``) are never learned from.
    Without labels of both classes every score is 0.5.
    """
    settings = settings or Settings()
    fold = lambda c: F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    texts, toxic = training_sample(docs, labels.filter(fold("doc_id") != held_out), settings)
    if len(set(toxic.tolist())) < 2:
        model = Model(settings, np.zeros((settings.buckets, settings.width), np.float32), np.zeros((settings.width, 2), np.float32), np.zeros(2, np.float32))
    else:
        model = train(texts, toxic, settings)
    out = score(docs, model, threshold)
    return out.select("doc_id", (fold("doc_id") == held_out).alias("held_out"), "score", "predicted")
