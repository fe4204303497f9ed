"""Exact removal of long repeated substrings by a sampled suffix array.

The difference-cover algorithm orders sampled suffixes by the names of their first symbols and
merges the remaining suffixes by what stands before the next sampled one. At one record for each
sampled byte (two of three) its sorts move over ten times the input, so the cover here is chosen by
content: of each string of LENGTH bytes the sampled suffix is the one whose first GRAM bytes have
the least hash. Equal strings have it at the same offset, which is what the cover is for, and about
one suffix in 150 is sampled. Names are 64-bit hashes of the bytes named, as any order of
names serves to bring equal ones together:

1. sampled suffixes are named by their first GRAM bytes, with the run of string starts that each
   one serves, and by all bytes of that run;
2. names met once are dropped; runs whose full name is met again are repeated as a whole;
3. where only the short name is met again, the remaining suffixes are merged: each start of the run
   is named by the LENGTH bytes from it, and equal names that stand side by side are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RollingHash, chunks, cut, flat, mapped, mix, release

LENGTH = 400
GRAM = 100
#: Members of a group of equal short names that one task merges; larger groups are merged by a shuffle of the names.
GROUP = 8192
FLUSH_BYTES = 4 << 20
U64 = np.uint64
#: Bits of a place in a text; the others of a word are of the name that chooses it.
PLACE = U64(32)


def sampled(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Document, place, short name, run name, and least and most distance of string starts, of each sampled suffix."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, U64, U64, np.int64, np.int64))
    n = len(buf)
    if n < length:
        return empty
    roll = RollingHash(buf)
    names = mix(roll.windows(gram))
    # the rule must not depend on the chunk: by the upper half of the name, then the place
    least = (names >> PLACE << PLACE) | np.arange(len(names), dtype=U64)
    want, have = length - gram + 1, 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = (least & ((U64(1) << PLACE) - U64(1))).astype(np.int64)
    sizes = np.diff(offsets)
    starts_in = np.maximum(sizes - length + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), starts_in)
    if len(doc) == 0:
        return empty
    start = np.arange(len(doc)) - np.repeat(np.cumsum(starts_in) - starts_in, starts_in) + np.repeat(offsets[:-1], starts_in)
    at = at[start]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    at, doc, low, high = at[first], doc[first], start[first], start[last]
    run = roll.slices(low, high + length)
    run = mix(run ^ mix((at - low).astype(U64) * U64(2 * length) + (at - high).astype(U64)))
    return doc, at - offsets[doc], names[at], run, at - high, at - low


def _samples(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            buf, offsets = flat(batch.column(1))
            for a, b in chunks(offsets):
                doc, pos, name, whole, low, high = sampled(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(keys[a + doc]), pa.array(pos, pa.int32()), pa.array(low, pa.int16()), pa.array(high, pa.int16())],
                    names=["name", "run", "key", "pos", "low", "high"],
                )

    return mapped(docs.select("key", "text"), run, "name long, run long, key long, pos int, low short, high short")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of each wanted run, from the texts, and how many runs its group has."""
    listed = wanted.groupBy("key").agg(F.collect_list(F.struct("name", "pos", "low", "high", "met", "runs")).alias("at"))
    joined = docs.join(listed, "key").select("key", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat(batch.column(1))
            rows = [[], [], [], [], [], []]
            for k, (key, found) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                for x in found:
                    start = x["pos"] - x["high"]
                    i = int(offsets[k]) + start
                    for col, v in zip(rows, (x["name"], key, start, x["met"], buf[i : i + x["high"] - x["low"] + length].tobytes(), x["runs"])):
                        col.append(v)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=["name", "key", "start", "met", "bytes", "runs"])

    return mapped(joined, run, "name long, key long, start int, met long, bytes binary, runs long")


def _names(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The member, the offset in it, and the name of each string of this length."""
    buf, offsets = flat(pa.array(parts, pa.binary()))
    names = mix(RollingHash(buf).windows(length))
    counts = np.diff(offsets) - length + 1
    member = np.repeat(np.arange(len(parts)), counts)
    shift = np.arange(len(member)) - np.repeat(np.cumsum(counts) - counts, counts)
    return member, shift, names[offsets[:-1][member] + shift]


def _merge_local(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated spans of groups that one task holds: (key, start, end)."""

    def solve(names, keys, starts, met, parts):
        member, shift, name = _names(parts, length)
        order = np.argsort(name)
        sorted_ = name[order]
        same = np.zeros(len(name) + 1, dtype=bool)
        np.equal(sorted_[1:], sorted_[:-1], out=same[1:-1])
        twice = np.zeros(len(name), dtype=bool)
        twice[order] = same[1:] | same[:-1]
        twice &= np.array(met)[member] == 1
        edge = np.diff(np.concatenate(([0], twice.astype(np.int8), [0])))
        other = np.zeros(len(twice) + 1, dtype=bool)
        other[1:-1] = twice[1:] & twice[:-1] & (member[1:] != member[:-1])
        first, last = np.flatnonzero((edge == 1) | other), np.flatnonzero((edge == -1) | other) - 1
        begin = np.array(starts)[member[first]]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(keys, dtype=np.int64)[member[first]]), pa.array(begin + shift[first], pa.int32()), pa.array(begin + shift[last] + length, pa.int32())], names=["key", "start", "end"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > FLUSH_BYTES and row[0] != held[0][-1]:
                    yield solve(*held)
                    held, size = [[], [], [], [], []], 0
                for col, v in zip(held, row):
                    col.append(v)
                size += len(row[4])
        if held[0]:
            yield solve(*held)

    return mapped(contexts.repartition("name").sortWithinPartitions("name"), run, "key long, start int, end int")


def _merge_wide(contexts: DataFrame, length: int) -> DataFrame:
    """The same for groups of any size: the names of all strings are counted by a shuffle that adds up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                member, shift, name = _names(part.column(4).to_pylist(), length)
                start = part.column(2).to_numpy()[member] + shift
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(part.column(1).to_numpy()[member]), pa.array(start, pa.int32()), pa.array(part.column(3).to_numpy()[member])], names=["name", "key", "start", "met"]
                )

    strings = mapped(contexts, run, "name long, key long, start int, met long")
    again = strings.groupBy("name").agg(F.sum("met").alias("times")).where("times > 1").select("name")
    return strings.where("met = 1").join(again, "name").select("key", "start", (F.col("start") + length).alias("end"))


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(key, start, end): spans of bytes under strings of this length that also start elsewhere. docs: (key, text)."""
    samples = _samples(docs, length, gram)
    # what is joined with samples is cut first: then both sides are plain shuffles, and a name that many samples have is split
    again = cut(spark, samples.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name"))
    suspects = cut(spark, samples.join(again, "name"))
    runs = cut(spark, suspects.groupBy("name", "run").agg(F.count("*").alias("met"), F.min(F.struct("key", "pos", "low", "high")).alias("one")))
    groups = cut(spark, runs.groupBy("name").agg(F.count("*").alias("runs"), F.min("met").alias("least")).where("runs > 1 and least = 1").select("name", "runs"))
    whole = suspects.join(runs.where("met > 1").select("name", "run"), ["name", "run"]).select("key", (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + length).alias("end"))
    wanted = cut(spark, runs.join(groups, "name").select("name", "runs", "met", "one.*"))
    # the texts move once for all groups
    contexts = cut(spark, _contexts(docs, wanted, length))
    release(spark)
    spans = whole.union(_merge_local(contexts.where(F.col("runs") <= group).drop("runs"), length))
    wide = contexts.where(F.col("runs") > group).drop("runs")
    if not wide.isEmpty():
        spans = spans.union(_merge_wide(wide, length))
    return spans


def suffix_dedup(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Sizes, removed bytes and digest of the kept bytes of each document.

    All copies of a repeated string lose it, the first included; rows that are equal as a whole are
    each other's copies. Null text is empty: nothing is removed and the digest is of no bytes. A
    null doc_id is kept as such. Documents of under `length` bytes are never touched.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(spark, docs, length, gram, group)
    listed = cut(spark, spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    del spans
    release(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat(batch.column(1))
            removed, many, digests = [], [], []
            for k, spans in enumerate(batch.column(2).to_pylist()):
                own = buf[offsets[k] : offsets[k + 1]]
                end, out, kept = 0, [], hashlib.sha256()
                for x in sorted((x["start"], x["end"]) for x in spans or ()):
                    if out and x[0] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], x[1])
                    else:
                        out.append([*x])
                for a, b in out:
                    kept.update(own[end:a])
                    end = b
                kept.update(own[end:])
                removed.append(sum(b - a for a, b in out))
                many.append(len(out))
                digests.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(many, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    joined = docs.join(listed, "key", "left").select("doc_id", "text", "spans")
    return mapped(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
