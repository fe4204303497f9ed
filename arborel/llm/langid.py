"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams of a language, most frequent first; ties go by the
n-gram's code. A document's own list is compared with each: an n-gram counts the distance between
its two ranks, or the length of a profile where the profile has none. The least sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, chunks, flat, held_out, mapped

#: n-grams of 1 to 3 characters, and the ranks that are compared.
LONGEST = 3
PROFILE = 400
#: Rows of each language that the profiles are learnt from.
TRAIN_ROWS = 2000
PART_BYTES = 1 << 20
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_classes: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Symbol of each code point below 65536: 0 for what is no letter, else its lower case."""
    if not _classes:
        table = np.zeros(1 << 16, dtype=np.uint16)
        for c in range(1 << 16):
            x = chr(c)
            if x.isalpha():
                table[c] = ord(x.lower()[0]) & 0xFFFF
        _classes.append(table)
    return _classes[0]


#: The symbol of a gap inside an n-gram, so that no shorter n-gram has the same code.
GAP = np.uint64(1)


def symbols(text: str) -> np.ndarray:
    """Letters in lower case as 16-bit symbols, and one 0 for each run of other characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) and points.max() > 0xFFFF:
        high = points > 0xFFFF
        low = letter_table()[np.where(high, 0, points)]
        wide = {int(c): (ord(chr(c).lower()[0]) * 40503 >> 3 & 0xFFFF) | 1 if chr(c).isalpha() else 0 for c in np.unique(points[high])}
        low[high] = [wide[int(c)] for c in points[high]]
        points = low
    else:
        points = letter_table()[points]
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    return points[keep]


def ranked(texts: list[str | None], most: int = PROFILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, rank) of the most frequent n-grams of each text, rank from 0; none without letters."""
    parts = [symbols(t) if t else np.zeros(0, np.uint16) for t in texts]
    sizes = np.array([len(p) + 2 for p in parts])
    flatted = np.zeros(int(sizes.sum()) + LONGEST, dtype=np.uint64)
    begin = np.cumsum(sizes) - sizes
    for b, p in zip(begin.tolist(), parts):
        flatted[b + 1 : b + 1 + len(p)] = p
    n = int(sizes.sum())
    owner = np.repeat(np.arange(len(parts), dtype=np.uint64), sizes)
    keys = []
    for size in range(1, LONGEST + 1):
        code = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            code = code << np.uint64(16) | np.maximum(flatted[j : j + n], GAP)
        inside = flatted[size - 1 : size - 1 + n] if size <= 2 else flatted[1 : 1 + n]
        good = inside != 0
        if size == 2:
            good |= flatted[:n] != 0
        keys.append(owner[good] << np.uint64(48) | code[good])
    return _top(np.concatenate(keys), len(parts), most)


def _top(keys: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    if len(keys) == 0:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    doc = (keys >> np.uint64(48)).astype(np.int64)
    order = np.argsort((doc << 40) - counts, kind="stable")
    doc = doc[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, np.arange(n))[doc]
    keep = rank < most
    return doc[keep], keys[order][keep] & np.uint64((1 << 48) - 1), rank[keep]


class Profiles:
    """The n-grams of all languages, and for each language the rank of each, or `most` where it has none."""

    def __init__(self, counts: dict[str, dict[int, int]], most: int = PROFILE) -> None:
        self.languages = sorted(counts)
        self.most = most
        tops = [sorted(counts[k], key=lambda g: (-counts[k][g], g))[:most] for k in self.languages]
        self.grams = np.array(sorted({g for top in tops for g in top}), dtype=np.uint64)
        self.ranks = np.full((len(self.languages), len(self.grams) + 1), -1, dtype=np.int64)
        for k, top in enumerate(tops):
            self.ranks[k, np.searchsorted(self.grams, np.array(top, dtype=np.uint64))] = np.arange(len(top))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The nearest language of each text and how far the next one lies behind, from 0 to 1."""
        doc, gram, rank = ranked(texts, self.most)
        n, total = len(texts), np.bincount(doc, minlength=len(texts))
        if not self.languages or len(self.grams) == 0:
            return ["und"] * n, np.zeros(n)
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        sums = np.empty((len(self.languages), n))
        for k in range(len(self.languages)):
            own = self.ranks[k, at]
            sums[k] = np.bincount(doc, weights=np.where(own < 0, self.most, np.abs(own - rank)), minlength=n)
        best = sums.argmin(0)
        least = sums[best, np.arange(n)]
        sums[best, np.arange(n)] = np.inf
        second = sums.min(0) if len(self.languages) > 1 else np.maximum(total * self.most, 1).astype(float)
        score = np.where(total > 0, (second - least) / np.maximum(second, 1e-9), 0.0)
        return [self.languages[k] if t else "und" for k, t in zip(best.tolist(), total.tolist())], np.clip(score, 0.0, 1.0)


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, most: int = PROFILE) -> Profiles:
    """Profiles of each language from at most about `rows` of its texts that are not held out, chosen by a hash of doc_id."""
    train = docs.where("lang is not null").where(~held_out(F.col("doc_id"))).withColumn("pick", F.coalesce(F.col("doc_id"), F.lit(0)))
    sample = bounded_sample(train.select("pick", "lang"), ["lang"], "pick", rows).select("pick", "lang").distinct()
    picked = train.join(F.broadcast(sample), ["pick", "lang"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for x, t in zip(langs, texts) if x == lang]
                sums: dict[int, int] = {}
                for at in range(0, len(own), 200):
                    joined = " ".join(t for t in own[at : at + 200] if t)
                    flat_ = np.concatenate(([0], symbols(joined), [0])).astype(np.uint64)
                    for size in range(1, LONGEST + 1):
                        n = len(flat_) - size + 1
                        if n <= 0:
                            continue
                        code = np.zeros(n, dtype=np.uint64)
                        for j in range(size):
                            code = code << np.uint64(16) | np.maximum(flat_[j : j + n], GAP)
                        good = flat_[:n] != 0 if size == 1 else (flat_[:n] != 0) | (flat_[1 : 1 + n] != 0) if size == 2 else flat_[1 : 1 + n] != 0
                        for g, c in zip(*(x.tolist() for x in np.unique(code[good], return_counts=True))):
                            sums[g] = sums.get(g, 0) + c
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sums), pa.string()), pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = mapped(picked, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most)
    counts: dict[str, dict[int, int]] = {}
    for row in top.toLocalIterator():
        counts.setdefault(row["lang"], {})[row["gram"]] = row["n"]
    return Profiles(counts, most)


def language_id(spark: SparkSession, docs: DataFrame, rows: int = TRAIN_ROWS, most: int = PROFILE) -> DataFrame:
    """The nearest language profile of each whole text, with its margin as the score.

    `und` and score 0 where the text is null, empty or has no letter, and everywhere if there is no
    row to learn from. Rows with null lang are not learnt from; every row comes out once. A null
    doc_id is not held out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = spark.sparkContext.broadcast(fit(docs, rows, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = flat(batch.column(1))
            langs: list[str] = []
            scores = [np.zeros(0)]
            for a, b in chunks(offsets, PART_BYTES):
                for c in range(a, b, 60_000):
                    got, score = model.value.predict(batch.column(1).slice(c, min(b, c + 60_000) - c).to_pylist())
                    langs += got
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(np.concatenate(scores), pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    flagged = docs.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "text", "held_out")
    return mapped(flagged, run, SCHEMA)
