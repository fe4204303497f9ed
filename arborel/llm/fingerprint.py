"""Document fingerprints by improbable features in chained Bloom filters.

Each window of WINDOW bytes has an entropy; windows of an entropy that running text seldom has rank
first. In each stretch of STRETCH windows the first of the best rank gets a vote, and windows with
VOTES or more are the features; a text that has none by this rule is told by its windows of most
votes, or without any vote by those of most entropy. Features go in order into Bloom filters of a fixed size, a new one after
FEATURES. Two fingerprints are compared filter by filter: shared bits, less those that chance gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RollingHash, chunks, cut, flat, mapped, mix

WINDOW = 64
STRETCH = 64
VOTES = 16
FEATURES = 160
FILTER_BYTES = 256
HASHES = 5
#: Mean and deviation of the bits of entropy of windows of running text; windows under LEAST are no features.
USUAL, SPREAD, LEAST = 4.2, 0.35, 1.0
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
U64 = np.uint64
_GAIN = np.array([0.0] + [c * np.log2(c) for c in range(1, WINDOW + 1)])
_STEP = np.append(0.0, np.diff(_GAIN))
_GRAIN = 1000
_GRID = np.arange(int(np.log2(WINDOW) * _GRAIN) + 2) / _GRAIN
_RANK = np.where(_GRID < LEAST, 1 << 20, np.rint(1000 * np.exp(-(((_GRID - USUAL) / SPREAD) ** 2) / 2))).astype(np.int64)
#: Bytes before an edit within which features can change, and bytes before those that their votes see.
REACH, SIGHT = WINDOW + 2 * STRETCH, STRETCH
#: The place of a feature that a text has only because there is no other: it says nothing of a part of the text.
NOWHERE = np.iinfo(np.int64).max


def entropies(buf: np.ndarray) -> np.ndarray:
    """Bits of entropy of each window of the buffer, by its start."""
    n = len(buf)
    kind = np.int32 if 256 * (n + 2 * WINDOW) < 1 << 31 else np.int64
    order = np.argsort(buf, kind="stable").astype(kind)
    keys = np.full(n + 2 * WINDOW, np.iinfo(kind).min, dtype=kind)
    keys[n + WINDOW :] = np.iinfo(kind).max
    own = keys[WINDOW : n + WINDOW]
    own[:] = buf[order]
    own *= n + 2 * WINDOW
    own += order
    # occurrences of a byte before and after it in the windows that it ends and begins, by halving steps
    back, ahead = np.arange(WINDOW, n + WINDOW, dtype=kind), np.arange(WINDOW, n + WINDOW, dtype=kind)
    low, high = own - (WINDOW - 1), own + (WINDOW - 1)
    step = WINDOW // 2
    while step:
        back -= (keys.take(back - step) >= low) * kind(step)
        ahead += (keys.take(ahead + step) <= high) * kind(step)
        step //= 2
    slot = np.arange(WINDOW, n + WINDOW, dtype=kind)
    before, after = slot - back, ahead - slot
    into, out = np.empty(n), np.empty(n)
    into[order] = _STEP[before + 1]
    out[order] = _STEP[after + 1]
    into[WINDOW:] -= out[: n - WINDOW]
    return np.log2(WINDOW) - np.cumsum(into)[WINDOW - 1 :] / WINDOW


def features(buf: np.ndarray, offsets: np.ndarray, fill: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in it and hash of each feature, in order. A text shorter than a window is a feature as a whole, an empty one has none.

    fill: texts of a window or more that have no feature get their best windows, at the place NOWHERE.
    """
    sizes = np.diff(offsets)
    docs, hashes, places = [], [], []
    filled = np.zeros(len(sizes), dtype=bool)
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    roll = RollingHash(buf)
    if len(short):
        docs.append(short)
        places.append(offsets[short])
        hashes.append(mix(roll.slices(offsets[short], offsets[short + 1])))
    if len(buf) >= WINDOW:
        bits = entropies(buf)
        rank = _RANK[(np.maximum(bits, 0.0) * _GRAIN + 0.5).astype(np.int64)]
        key = (rank << 40) | np.arange(len(rank))
        have = 1
        while have < STRETCH:
            step = min(have, STRETCH - have)
            key = np.minimum(key[:-step], key[step:]) if len(key) > step else key[:0]
            have += step
        starts = np.maximum(sizes - WINDOW - STRETCH + 2, 0)
        doc = np.repeat(np.arange(len(sizes)), starts)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(offsets[:-1], starts)
        best = key[at] if len(at) else np.zeros(0, np.int64)
        best = best[best >> 40 < 1 << 20] & ((1 << 40) - 1)
        votes = np.bincount(best, minlength=len(rank))
        won = np.flatnonzero(votes >= VOTES)
        # texts with fewer windows than a stretch: their best window
        few = np.flatnonzero((sizes >= WINDOW) & (starts == 0))
        extra = [offsets[k] + int(np.argmin(rank[offsets[k] : offsets[k + 1] - WINDOW + 1])) for k in few.tolist()]
        extra = [x for x in extra if rank[x] < 1 << 20]
        won = np.sort(np.concatenate((won, np.array(extra, dtype=np.int64))))
        if fill:
            filled = sizes >= WINDOW
            filled[np.searchsorted(offsets, won, side="right") - 1] = False
            more = []
            for k in np.flatnonzero(filled).tolist():
                own = slice(offsets[k], offsets[k + 1] - WINDOW + 1)
                worth = votes[own] if votes[own].any() else np.rint(bits[own] * _GRAIN)
                more.append(offsets[k] + np.flatnonzero(worth == worth.max()))
            won = np.sort(np.concatenate((won, *more)))
        docs.append(np.searchsorted(offsets, won, side="right") - 1)
        places.append(won)
        hashes.append(mix(roll.slices(won, won + WINDOW)))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    doc, place, value = np.concatenate(docs), np.concatenate(places), np.concatenate(hashes)
    order = np.argsort(place, kind="stable")
    doc = doc[order]
    return doc, np.where(filled[doc], NOWHERE, place[order] - offsets[doc]), value[order]


def chained(own: np.ndarray) -> np.ndarray:
    """The Bloom filters of one text's features, one row of bytes each; a feature counts where it is first."""
    if len(own) > 1:
        _, first = np.unique(own, return_index=True)
        own = own[np.sort(first)]
    chain = -(-len(own) // FEATURES)
    bits = np.zeros(chain * FILTER_BYTES * 8, dtype=np.uint8)
    base = np.arange(len(own)) // FEATURES * (FILTER_BYTES * 8)
    for h in range(HASHES):
        bits[base + ((own >> U64(11 * h)) & U64(FILTER_BYTES * 8 - 1)).astype(np.int64)] = 1
    return np.packbits(bits).reshape(chain, FILTER_BYTES)


def text_of(chain: np.ndarray) -> str:
    return ".".join(row.tobytes().hex() for row in chain)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: each filter of the shorter chain by its best counterpart; 1 for equal chains, empty ones included."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if len(a) == 0 or len(b) == 0:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    p, q = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    best = np.empty(len(a))
    back = np.zeros(len(b))
    size = FILTER_BYTES * 8
    for i in range(len(a)):
        shared = np.bitwise_count(a[i] & b).sum(1, dtype=np.int64)
        chance, most = p[i] * q / size, np.minimum(p[i], q)
        score = np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0.0, 1.0)
        best[i] = score.max()
        back = np.maximum(back, score)
    return float(best.mean() if len(a) < len(b) else (best.mean() + back.mean()) / 2)


def _features(texts: list[bytes], fill: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the features of each text."""
    buf, offsets = flat(pa.array(texts, pa.binary()))
    out = []
    for a, b in chunks(offsets, 1 << 20):
        doc, place, value = features(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], fill)
        bounds = np.searchsorted(doc, np.arange(b - a + 1)).tolist()
        out += [(place[i:j], value[i:j]) for i, j in zip(bounds, bounds[1:])]
    return out


def _edited(texts: list[bytes], edited: list[bytes], same: list[int], own: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The features of edited texts, of which so many first bytes are the same: only those near the edit and after it are made."""
    begin = [max(0, s - REACH - SIGHT) if min(len(t), len(e)) > 2 * (REACH + SIGHT) else 0 for t, e, s in zip(texts, edited, same)]
    made = _features([e[b:] for e, b in zip(edited, begin)], fill=False)
    out = []
    for b, (place, value), (first, kept) in zip(begin, made, own):
        if b:
            value = np.concatenate((kept[first < b + SIGHT], value[place >= SIGHT]))
        out.append(value)
    # only a whole text tells that it has no feature
    without = [k for k, value in enumerate(out) if len(value) == 0]
    for k, (_, value) in zip(without, _features([edited[k] for k in without])):
        out[k] = value
    return out


def _results(texts: list[str], nexts: list[str], own: list | None = None, after: list | None = None) -> list[list]:
    """n_chars and the results of texts that are followed by others."""
    edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, nexts)]
    raw, raw_edited = [t.encode() for t in texts], [t.encode() for t in edited]
    same = [len(r) - len(t[len(t) - len(t) // 4 :].encode()) for r, t in zip(raw, texts)]
    found = own if own is not None else _features(raw)
    own = [chained(v) for _, v in found]
    after = [chained(v) for _, v in (after if after is not None else _features([t.encode() for t in nexts]))]
    changed = [chained(v) for v in _edited(raw, raw_edited, same, found)]
    return [
        [len(t) for t in texts],
        [hashlib.sha256(e).hexdigest() for e in raw_edited],
        [text_of(c) for c in own],
        [text_of(c) for c in changed],
        [likeness(a, c) for a, c in zip(own, changed)],
        [likeness(a, b) for a, b in zip(own, after)],
    ]


def _record(kinds: list[int], parts: list[int], ids: list, results: list[list] | None, texts: list | None) -> pa.RecordBatch:
    n = len(kinds)
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = [pa.array(c, t) for c, t in zip(results or [[None] * n] * 6, types)]
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int8()), pa.array(parts, pa.int32()), pa.array(ids, pa.int64()), *columns, pa.array(texts or [None] * n, pa.string())],
        names=["kind", "part", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text"],
    )


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its text edited with the next document's, and how near both are.

    Documents follow each other by doc_id, nulls first, rows of one doc_id by a hash of the text, then the text;
    the last is followed by the first, a single one by itself. Null text is empty: its fingerprint
    is '' and its likeness to another empty one 1. Equal rows come out as often as they come in.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = docs.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: a result; 1: the first and 2 the last row of a partition, with their texts."""
        last = None
        part = 0
        for batch in batches:
            _, offsets = flat(batch.column(1))
            for a, b in chunks(offsets, 1 << 20):
                ids, texts = batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()
                part = batch.column(2)[a].as_py()
                made = _features([t.encode() for t in texts])
                if last is None:
                    yield _record([1], [part], [ids[0]], None, [texts[0]])
                else:
                    ids, texts, made = [last[0], *ids], [last[1], *texts], [last[2], *made]
                if len(ids) > 1:
                    got = _results(texts[:-1], texts[1:], made[:-1], made[1:])
                    yield _record([0] * (len(ids) - 1), [part] * (len(ids) - 1), ids[:-1], got, None)
                last = ids[-1], texts[-1], made[-1]
        if last is not None:
            yield _record([2], [part], [last[0]], None, [last[1]])

    told = cut(spark, mapped(ordered, run, f"kind byte, part int, {SCHEMA}, text string"))
    firsts = told.where("kind = 1").select("part", F.col("text").alias("after"))
    parts = sorted(r["part"] for r in firsts.select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "last int, part int")
    ends = told.where("kind = 2").select("doc_id", "text", F.col("part").alias("last")).join(F.broadcast(follows), "last").join(firsts, "part").select("doc_id", "text", "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _results(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield _record([0] * batch.num_rows, [0] * batch.num_rows, batch.column(0).to_pylist(), got, None).select(["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return told.where("kind = 0").select(*names).unionByName(mapped(ends, close, SCHEMA))
