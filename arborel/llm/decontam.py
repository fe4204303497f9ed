"""Benchmark decontamination by an FM-index over each shard of the training documents.

A task gathers its documents into shards of word symbols, sorts their suffixes, and keeps the
Burrows-Wheeler transform in a wavelet matrix with sampled suffix positions. A shard is indexed
once, over its own vocabulary. The windows of the benchmark items lie in blocks of bounded size in
the shared folder; a task holds one block at a time and searches all its windows backwards at once;
the rows found are walked to sampled positions, and the spans of words found are merged. Words that
a bitmap of fixed size tells to be in no item are breakers: no phrase crosses them, so suffixes need
no order beyond them. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, RollingHash, byte_table, chunks, cut, flat, mapped, mix, shared_dir, store, words

WORD = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
WINDOW = 10
SAMPLE = 16
#: Text bytes of a shard, unless one document alone is longer; and of benchmark text in one block.
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
#: Bits of the bitmap of the items' words.
BITMAP_BITS = 22
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of texts laid end to end, A-Z lower-cased."""
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for a, b in chunks(offsets):
        base, part = int(offsets[a]), buf[offsets[a] : offsets[b]]
        starts, ends = words(part, offsets[a : b + 1] - base, WORD)
        found.append((starts + base, ends + base, mix(RollingHash(LOWER[part]).slices(starts, ends))))
    return tuple(np.concatenate(x) for x in zip(*found))


class Phrases:
    """The distinct windows of a block of items, over the block's own vocabulary."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        buf, offsets = flat(pa.array([t for _, t in items], pa.binary()))
        starts, _, hashes = word_hashes(buf, offsets)
        self.names = [name for name, _ in items]
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        ids = ids + 1
        first = np.searchsorted(starts, offsets)
        rows: dict[tuple[int, ...], set[int]] = {}
        for k in range(len(items)):
            own = ids[first[k] : first[k + 1]].tolist()
            for i in range(max(len(own) - window + 1, min(len(own), 1))):
                rows.setdefault(tuple(own[i : i + window]), set()).add(k)
        self.lengths = np.array([len(r) for r in rows], dtype=np.int64)
        self.symbols = np.zeros((len(rows), window), dtype=np.int64)
        for k, r in enumerate(rows):
            self.symbols[k, : len(r)] = r
        self.item_counts = np.array([len(v) for v in rows.values()], dtype=np.int64)
        self.item_starts = np.concatenate(([0], np.cumsum(self.item_counts)))
        self.items = np.array([i for v in rows.values() for i in sorted(v)], dtype=np.int64)

    def in_symbols_of(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The phrases whose words all are in another vocabulary, and their symbols there, from 1."""
        if len(vocabulary) == 0 or len(self.lengths) == 0:
            return np.zeros(0, np.int64), np.zeros((0, self.symbols.shape[1]), np.int64)
        at = np.minimum(np.searchsorted(vocabulary, self.vocabulary), len(vocabulary) - 1)
        there = np.concatenate(([0], np.where(vocabulary[at] == self.vocabulary, at + 1, 0)))
        symbols = there[self.symbols]
        which = np.flatnonzero(((symbols > 0) == (self.symbols > 0)).all(1))
        return which, symbols[which]

    def cells(self) -> np.ndarray:
        """The bitmap of the words."""
        bits = np.zeros(1 << BITMAP_BITS, dtype=bool)
        bits[(self.vocabulary >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True
        return np.packbits(bits)


class Blocks:
    """The names of the blocks of phrases in a shared folder, and the bitmap of all their words. A worker holds one block."""

    _held: dict[str, Phrases] = {}

    def __init__(self, folder: str, names: list[str], cells: np.ndarray) -> None:
        self.folder, self.names, self.cells = folder, names, cells

    def possible(self, hashes: np.ndarray) -> np.ndarray:
        """Whether words may be in an item."""
        at = (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
        return (self.cells[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    def __iter__(self) -> Iterator[Phrases]:
        for name in self.names:
            if name not in Blocks._held:
                fs, path = store(self.folder)
                with fs.open_input_file(f"{path}/{name}") as file:
                    found = pickle.loads(file.read())
                Blocks._held.clear()
                Blocks._held[name] = found
            yield Blocks._held[name]


def suffix_order(sym: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order; symbol 0 is a breaker, each unlike all others, ordered by place.

    The last symbol must be 0. Prefix doubling; each round sorts only what is still tied.
    """
    n = len(sym)
    bits = max(1, n.bit_length())
    low = (1 << bits) - 1
    packed = 3 * bits <= 63
    zero, rest = np.flatnonzero(sym == 0), np.flatnonzero(sym)
    rank = np.empty(n, dtype=np.int64)
    rank[zero] = np.arange(len(zero))
    order = np.empty(n, dtype=np.int64)
    order[: len(zero)] = zero
    if len(rest) == 0:
        return order
    key = np.sort((sym[rest] << bits) | rest)
    tied = key & low
    group = key >> bits
    base = len(zero)

    def settle(tied: np.ndarray, new: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """new: True where a group of equals begins; slots: places in the order. Gives what is still tied."""
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(new)))
        rank[tied] = np.repeat(slots[begins], sizes)
        order[slots] = tied
        left = np.repeat(sizes > 1, sizes)
        return tied[left], slots[left]

    new = np.ones(len(tied), dtype=bool)
    np.not_equal(group[1:], group[:-1], out=new[1:])
    tied, slots = settle(tied, new, np.arange(base, n))
    h = 1
    while len(tied):
        first, second = rank[tied], rank[tied + h]
        if packed:
            at = np.arange(len(tied))
            key = np.sort((first << (2 * bits)) | (second << bits) | at)
            by = key & low
        else:
            by = np.lexsort((second, first))
        tied, first, second = tied[by], first[by], second[by]
        new = np.ones(len(tied), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        tied, slots = settle(tied, new, slots)
        h *= 2
    return order


class WaveletMatrix:
    """Rank of any symbol before any place, one bit plane for each bit of the symbols."""

    def __init__(self, sym: np.ndarray, most: int) -> None:
        self.n, self.bits = len(sym), max(1, int(most).bit_length())
        self.planes: list[tuple[np.ndarray, int]] = []
        sym = sym.astype(np.int32)
        for b in range(self.bits - 1, -1, -1):
            bit = ((sym >> b) & 1).astype(bool)
            ones = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.planes.append((ones, self.n - int(ones[-1])))
            sym = np.concatenate((sym[~bit], sym[bit]))

    def ranks(self, symbols: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each place, for one or more sets of places."""
        at = [np.zeros(len(symbols), dtype=np.int64), *places]
        for b, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.planes):
            one = ((symbols >> b) & 1).astype(bool)
            for k, x in enumerate(at):
                r = ones[x].astype(np.int64)
                at[k] = np.where(one, zeros + r, x - r)
        return [x - at[0] for x in at[1:]]


class FMIndex:
    """Backward search and location of phrases in one shard of word symbols."""

    def __init__(self, sym: np.ndarray, most: int) -> None:
        order = suffix_order(sym)
        self.before = np.where(order > 0, sym[order - 1], 0)
        self.first = np.searchsorted(sym[order], np.arange(most + 2))
        self.planes = WaveletMatrix(self.before, most)
        sampled = (order % SAMPLE == 0) | (self.before == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.sample = order[sampled]

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase."""
        k = len(lengths)
        low, high = np.zeros(k, dtype=np.int64), np.full(k, self.planes.n, dtype=np.int64)
        for step in range(1, symbols.shape[1] + 1):
            live = np.flatnonzero((lengths >= step) & (low < high))
            if len(live) == 0:
                break
            c = symbols[live, lengths[live] - step]
            a, b = self.planes.ranks(c, low[live], high[live])
            low[live], high[live] = self.first[c] + a, self.first[c] + b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes by their rows: steps back to a sampled one. A breaker is never crossed."""
        rows = rows.copy()
        steps = np.zeros(len(rows), dtype=np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            at = rows[live]
            c = self.before[at]
            rows[live] = self.first[c] + self.planes.ranks(c, at)[0]
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.sample[self.sample_rank[rows]] + steps


def shard_hits(buf: np.ndarray, offsets: np.ndarray, blocks: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, set[tuple[int, str]]]:
    """Word starts, ends, their documents, which are hit, and the (document, item) pairs of one shard."""
    starts, ends, hashes = word_hashes(buf, offsets)
    # a document may be empty, and then shares its offset with the next
    doc = np.searchsorted(offsets, starts, side="right") - 1
    n = len(starts)
    hit = np.zeros(n + 1, dtype=np.int64)
    pairs: set[tuple[int, str]] = set()
    good = np.flatnonzero(blocks.possible(hashes))
    if len(good) == 0:
        return starts, ends, doc, hit[:-1].astype(bool), pairs
    vocabulary, ids = np.unique(hashes[good], return_inverse=True)
    # a breaker between documents and after the last
    step = np.concatenate(([0], np.cumsum(1 + (doc[1:] != doc[:-1])))) if n > 1 else np.zeros(1, np.int64)
    sym = np.zeros(int(step[-1]) + 2, dtype=np.int64)
    sym[step[good]] = ids + 1
    word_at = np.zeros(len(sym), dtype=np.int64)
    word_at[step] = np.arange(n)
    index = FMIndex(sym, len(vocabulary))
    for phrases in blocks:
        chosen, symbols = phrases.in_symbols_of(vocabulary)
        if len(chosen) == 0:
            continue
        low, high = index.search(symbols, phrases.lengths[chosen])
        count = np.maximum(high - low, 0)
        own = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + low[own]
        which = chosen[own]
        at = word_at[index.locate(rows)]
        np.add.at(hit, at, 1)
        np.subtract.at(hit, at + phrases.lengths[which], 1)
        many = phrases.item_counts[which]
        items = phrases.items[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(phrases.item_starts[which], many)]
        found = np.unique(np.repeat(doc[at], many) * len(phrases.names) + items)
        pairs |= {(int(x) // len(phrases.names), phrases.names[int(x) % len(phrases.names)]) for x in found}
    return starts, ends, doc, np.cumsum(hit[:-1]) > 0, pairs


def phrase_blocks(spark: SparkSession, benchmark: DataFrame, window: int):
    """Writes the items' windows as blocks to the shared folder, and broadcasts their names and the bitmap of their words.

    A block is written under a name of its own by the task that makes it; blocks of failed tasks are not in use.
    """
    folder = f"{shared_dir(spark)}/phrases-{uuid.uuid4().hex}"

    def written(items: list[tuple[str, bytes]]) -> pa.RecordBatch:
        phrases, name = Phrases(items, window), f"block-{uuid.uuid4().hex}"
        fs, path = store(folder)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{name}") as out:
            out.write(pickle.dumps(phrases))
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([phrases.cells().tobytes()])], names=["name", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = [], 0
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                own.append((item or "", text.encode()))
                size += len(own[-1][1])
                if size >= BLOCK_BYTES:
                    yield written(own)
                    own, size = [], 0
        if own:
            yield written(own)

    rows = benchmark.select(benchmark["item_id"].cast("string").alias("item"), benchmark["text"].cast("string").alias("text")).where("text is not null")
    cells, names = np.zeros(1 << BITMAP_BITS - 3, np.uint8), []
    for row in cut(spark, mapped(rows, run, "name string, cells binary")).toLocalIterator():  # one row for each block
        names.append(row["name"])
        cells |= np.frombuffer(bytes(row["cells"]), np.uint8)
    return spark.sparkContext.broadcast(Blocks(folder, sorted(names), cells))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words hit by benchmark windows, for each document.

    A null or empty text has no words and no hit. Items without words, or with null text, have no
    windows. Items repeated, or with equal ids, count once in n_items; a null item_id counts as ''.
    Rows come out as often as they come in, whatever their doc_id.
    """
    blocks = phrase_blocks(spark, benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = blocks.value
        for batch in batches:
            buf, offsets = flat(batch.column(1))
            for a, b in chunks(offsets, SHARD_BYTES):
                part = offsets[a : b + 1] - offsets[a]
                _, _, doc, hit, pairs = shard_hits(buf[offsets[a] : offsets[b]], part, own)
                n_words = np.bincount(doc, minlength=b - a)
                n_hit = np.bincount(doc[hit], minlength=b - a)
                items: list[set[str]] = [set() for _ in range(b - a)]
                for d, name in pairs:
                    items[d].add(name)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array([len(x) for x in items], pa.int64()),
                        pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()),
                        pa.array(n_hit > 0, pa.bool_()),
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), run, SCHEMA)


def without_spans(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with the merged spans of words hit cut out of their texts; other columns as they come.

    A span runs from the first to the last word of a run of words hit. Texts without hits,
    null and empty texts stay as they are; n_chars, where there is such a column, follows the text.
    """
    blocks = phrase_blocks(spark, benchmark, window)
    at = docs.columns.index("text")
    sized = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = blocks.value
        for batch in batches:
            buf, offsets = flat(batch.column(at))
            texts = batch.column(at).to_pylist()
            changed = set()
            for a, b in chunks(offsets, SHARD_BYTES):
                base = offsets[a]
                starts, ends, doc, hit, _ = shard_hits(buf[base : offsets[b]], offsets[a : b + 1] - base, own)
                if not hit.any():
                    continue
                edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
                split = np.zeros(len(hit) + 1, dtype=bool)
                split[1:-1] = hit[1:] & hit[:-1] & (doc[1:] != doc[:-1])
                first = np.flatnonzero((edge == 1) | split)
                last = np.flatnonzero((edge == -1) | split) - 1
                for i, j in sorted(zip(first.tolist(), last.tolist()), reverse=True):
                    k = a + int(doc[i])
                    raw = texts[k].encode() if k not in changed else texts[k]
                    changed.add(k)
                    texts[k] = raw[: starts[i] + base - offsets[k]] + raw[ends[j] + base - offsets[k] :]
            columns = list(batch.columns)
            texts = [t.decode() if isinstance(t, bytes) else t for t in texts]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if sized is not None:
                sizes = batch.column(sized).to_pylist()
                columns[sized] = pa.array([len(texts[k]) if k in changed else sizes[k] for k in range(len(texts))], batch.schema.field(sized).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return mapped(docs, run, docs.schema)
