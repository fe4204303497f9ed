"""Toxicity by a bag of subword embeddings, averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams and of itself, a document the mean of
its words; a linear softmax over that mean gives the two classes. Vectors and softmax are trained
jointly in numpy on a bounded sample of labelled rows. n-grams are hashed into a fixed table, so an
unseen misspelling still has the vectors of the n-grams that it shares with words seen.
For scoring, each vector is folded into the one number that the softmax takes from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, byte_table, chunks, flat, give_back, held_out, mapped, mix, points

WORD = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Subword lengths in characters, the boundaries of the word among them; 0 stands for the whole word.
SIZES = (0, 3, 5)
#: Odd numbers that spread the characters of a subword, from a fixed seed.
_MIXERS = np.random.default_rng(20240607).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Subwords in fewer sample documents keep a zero vector.
LEAST_DOCS = 3
BUCKET_BITS = 17
DIMENSION = 8
#: Words without a vector that each document has besides its own, so that one word of a short text does not decide.
PAD = 20
EPOCHS = 12
BATCH = 64
RATE = 1.0
#: Labelled rows that the classifier is fitted on, for each class.
TRAIN_ROWS = 2500
#: Bytes of a text that it may be fitted on: the driver holds the sample, so longer texts are not in it.
TRAIN_BYTES = 64 << 10
CUT = 0.7
#: Sample bytes whose subwords the driver counts at once.
FIT_BYTES = 256 << 10
#: Taken from the log odds, as the classes weigh the same in training and clean texts are more in use.
CAUTION = 0.5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
U64 = np.uint64


def bag(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, weight) of each subword; the weights of a document add up to n / (n + PAD) for n words."""
    n = len(offsets) - 1
    chars, at = points(buf)
    first = np.searchsorted(at, offsets)
    # a boundary before each text and after the last; characters of no word are boundaries too
    wide = np.zeros(len(chars) + n + 1, dtype=np.uint64)
    inside = WORD[buf[at]]
    place = np.arange(len(chars)) + np.repeat(np.arange(1, n + 1), np.diff(first))
    wide[place[inside]] = np.where((chars >= 65) & (chars <= 90), chars + np.uint32(32), chars)[inside]
    inner = wide != 0
    edge = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1
    if len(edge) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    word_of = np.cumsum(np.concatenate(([0], (inner[1:] & ~inner[:-1]).astype(np.int32)))) - 1
    outer = np.concatenate((np.zeros(1, np.int32), np.cumsum(~inner, dtype=np.int32)))
    words, buckets = [], []
    for size in SIZES:
        if size == 0:  # the word itself: its characters with their places in it
            own = np.flatnonzero(inner)
            spread = mix(wide[own] * _MIXERS[0] + (own - edge[word_of[own]]).astype(U64) * _MIXERS[1])
            words.append(np.arange(len(edge)))
            buckets.append(mix(np.add.reduceat(spread, np.searchsorted(own, edge))) >> U64(64 - BUCKET_BITS))
            continue
        k = len(wide) - size + 1
        if k <= 0:
            continue
        good = np.flatnonzero(outer[size - 1 : size - 1 + k] == outer[1 : 1 + k])
        value = np.full(len(good), U64(size))
        for j in range(size):
            value += wide[good + j] * _MIXERS[j]
        words.append(word_of[good + 1])
        buckets.append(mix(value) >> U64(64 - BUCKET_BITS))
    word = np.concatenate(words)
    counts = np.bincount(word, minlength=len(edge))
    doc_of = np.searchsorted(first + np.arange(n + 1), edge, side="right") - 1
    total = np.bincount(doc_of, minlength=n) + PAD
    weight = (1.0 / np.maximum(counts, 1) / total[doc_of])[word]
    return doc_of[word], np.concatenate(buckets).astype(np.int64), weight


class Model:
    """Embeddings and softmax, and the fold of both that scoring uses."""

    def __init__(self, fold: np.ndarray, bias: float) -> None:
        self.fold, self.bias = fold, bias

    def logits(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, bucket, weight = bag(buf, offsets)
        return np.bincount(doc, weights=weight * self.fold[bucket], minlength=len(offsets) - 1) + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        buf, offsets = flat(texts)
        out = [np.zeros(0)]
        for a, b in chunks(offsets):
            out.append(self.logits(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        return 1.0 / (1.0 + np.exp(-np.clip(np.concatenate(out), -50, 50)))


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """Fits by Adagrad; without rows of both labels the score is the share of label 1, or 0 without rows."""
    y = np.array(labels, dtype=np.int64)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 50.0 if share else -50.0)
    buf, offsets = flat(pa.array(texts, pa.string()))
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in chunks(offsets, FIT_BYTES):
        doc, bucket, weight = bag(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        key, back = np.unique((doc << BUCKET_BITS) | bucket, return_inverse=True)
        value = np.bincount(back, weights=weight)
        bounds = np.searchsorted(key >> BUCKET_BITS, np.arange(b - a + 1))
        bucket = (key & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
        rows += [(bucket[i:j], value[i:j].astype(np.float32)) for i, j in zip(bounds, bounds[1:])]
    seen = np.zeros(1 << BUCKET_BITS, np.int32)
    for bucket, _ in rows:
        seen[bucket] += 1
    rows = [(bucket[keep], value[keep]) for bucket, value in rows for keep in (seen[bucket] >= LEAST_DOCS,)]
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSION)).astype(np.float32)
    softmax = rng.normal(0, 0.5, (DIMENSION, 2)).astype(np.float32)
    sum_v, sum_s, sum_b = np.full(1 << BUCKET_BITS, 1e-6, np.float32), np.full_like(softmax, 1e-3), np.full(2, 1e-3, np.float32)
    filled = np.array([k for k, (b, _) in enumerate(rows) if len(b)])
    share = (len(y) / 2.0 / np.bincount(y, minlength=2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    for _ in range(min(10 * EPOCHS, max(EPOCHS, EPOCHS * 3000 // len(y)))):
        order = rng.permutation(filled)
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            index = np.concatenate([rows[k][0] for k in own])
            value = np.concatenate([rows[k][1] for k in own])
            sizes = np.array([len(rows[k][0]) for k in own])
            begin = np.cumsum(sizes) - sizes
            means = np.add.reduceat(vectors[index] * value[:, None], begin)
            z = means @ softmax + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1.0
            p *= share[y[own]][:, None]
            down = p @ softmax.T
            grad = np.repeat(down, sizes, axis=0) * value[:, None]
            touched, back = np.unique(index, return_inverse=True)
            full = np.stack([np.bincount(back, weights=grad[:, d]) for d in range(DIMENSION)], axis=1).astype(np.float32)
            sum_v[touched] += (full**2).mean(1)
            vectors[touched] -= RATE * full / np.sqrt(sum_v[touched])[:, None]
            g = means.T @ p / len(own)
            sum_s += g**2
            softmax -= 0.1 * RATE * g / np.sqrt(sum_s)
            g = p.mean(0)
            sum_b += g**2
            bias -= 0.1 * RATE * g / np.sqrt(sum_b)
    vectors[seen < LEAST_DOCS] = 0
    side = softmax[:, 1] - softmax[:, 0]
    return Model((vectors @ side).astype(np.float32), float(bias[1] - bias[0]) - CAUTION)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Trains on labelled rows that are not held out, at most about `rows` of each class, chosen by a hash of doc_id, of at most TRAIN_BYTES each.

    Null labels and labels of held-out or unknown documents are not used; a document labelled twice counts twice.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id")))
    picked = bounded_sample(known, ["toxic"], "doc_id", rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")
    got = sorted(texts.toLocalIterator(), key=lambda r: (r["doc_id"], r["text"] or "", r["toxic"]))
    model = train([r["text"] for r in got], [r["toxic"] for r in got])
    del got
    give_back()
    return model


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = CUT) -> DataFrame:
    """A score from 0 to 1 for each whole text, and whether it reaches the threshold.

    Null and empty texts, and texts without words, get the score of no evidence. Every row comes
    out once, whatever its doc_id; a null doc_id is not held out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = spark.sparkContext.broadcast(fit(docs, labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(model.value.scores(batch.column(1)), pa.float64())], names=["doc_id", "held_out", "score"])

    flagged = docs.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "text", "held_out")
    scored = mapped(flagged, run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = CUT) -> DataFrame:
    """The documents, with all their columns, whose score is under the threshold."""
    model = spark.sparkContext.broadcast(fit(docs, labels, rows))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.value.scores(batch.column(at)) < threshold))

    return mapped(docs, run, docs.schema)
