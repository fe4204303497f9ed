"""Exact Jaccard self-join of word-shingle sets in the metric space of the Jaccard distance.

The distance 1 - |x & y| / |x | y| is a metric. Pivots create regions, and the triangle inequality
says which documents a region must also hold:

* Most documents of a corpus are at distance 1 from each other, where document pivots tell nothing
  apart. So the first pivots are the single shingles {s}: the regions of x are those of the shingles
  that it has, taken in one global order, rarer first. If d(x, y) <= t, then |y - x| <= t |y|, so y
  goes to the first floor(t |y|) + 1 of its regions and still meets every x within t. That window is
  exact for any global order; shingles that one task or all together find often go to the end of it,
  so that the regions left do not grow with the number of tasks. Where two sets meet
  first they share nothing that comes earlier, so what follows there must be enough for both.
* Regions of at most LEAF classes are joined directly. In a larger one each document is measured
  against a document pivot, and links to it join components; a region of one component is done.
* What is left is joined again, region by region: some pivots, the Voronoi cells of these, and in
  each cell also the documents from outside whose distances differ by no more than the window of 2t.
  Cells are split in turn; those of few pairs, and those that no pivot splits, are joined directly,
  where a mark of each set (the parities of its elements' counts in cells) rules most pairs out.

Equal sets are one class throughout. Pairs that no mark rules out are checked by exact set
operations over whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LOWER, RollingHash, broadcast_if_small, byte_table, chunks, cut, flat, mapped, mix, release, unlike, words

WORD = byte_table((0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF))
SHINGLE = 5
#: Similarity as a fraction, so that the comparison is exact.
SIMILAR = (75, 100)
LEAF = 3
#: Pivots that split a region again, pairs of a region that are joined directly, and rounds after which all are.
PIVOTS, DIRECT, LEVELS = 4, 1 << 16, 4
#: Bits of the least mark of a set; a larger set has a bit for each element.
MARK_BITS = 512
CELL_BITS = 21
#: Parts of the table of cells that are added up over all tasks.
BLOCKS = 16
#: Bits of the bitmap of documents whose sets are wanted, and the tasks that make it.
REP_BITS, REP_TASKS = 24, 8
#: Classes that a task remembers having told, before it forgets them all.
SEEN = 200_000
#: Pairs whose sets may be sent at once in any case; of more, at most one for two classes, so that a round sends no more than all sets.
AT_ONCE = 100_000
#: Sets of more elements are compared by whole hashes, others by 40 bits of them.
WIDE = 4096
U64 = np.uint64


def shingles(buf: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts end to end, and n + 1 bounds."""
    n = len(offsets) - 1
    starts, ends = words(buf, offsets, WORD)
    h = mix(RollingHash(LOWER[buf]).slices(starts, ends))
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    full = np.maximum(counts - size + 1, 0)
    if len(h) >= size:
        rolled = np.zeros(len(h) - size + 1, dtype=U64)
        for j in range(size):
            rolled = mix(rolled ^ h[j : len(h) - size + 1 + j])
    else:
        rolled = np.zeros(0, dtype=U64)
    doc = np.repeat(np.arange(n), full)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full) + np.repeat(first[:-1], full)
    values = rolled[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = []
        for k in short.tolist():
            x = np.full(1, U64(counts[k]))
            for w in h[first[k] : first[k + 1]]:
                x = mix(x ^ w)
            own.append(x[0])
        doc = np.concatenate((doc, short))
        values = np.concatenate((values, np.array(own, dtype=U64)))
    order = np.lexsort((values, doc)) if n > 1 else np.argsort(values)
    doc, values = doc[order], values[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    doc, values = doc[keep], values[keep]
    return values, np.searchsorted(doc, np.arange(n + 1))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 63-bit hash for each set, of all its elements; 0 for the empty set."""
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(values))))
    more = np.concatenate((np.zeros(1, U64), np.cumsum(mix(values ^ U64(0x5851F42D4C957F2D)) * U64(0x9E3779B97F4A7C15))))
    a, b = sums[bounds[1:]] - sums[bounds[:-1]], more[bounds[1:]] - more[bounds[:-1]]
    out = mix(a ^ mix(b)) >> U64(1)
    return np.where(np.diff(bounds) > 0, np.maximum(out, 1), 0).astype(np.int64)


def allowance(n: Column | np.ndarray, similar: tuple[int, int]):
    """Elements that a set of n may miss from a similar one: floor(n * (1 - t))."""
    return n - -(-(n * similar[0]) // similar[1])


def mark(values: np.ndarray) -> bytes:
    """A set's mark: for each cell of its elements whether their number is odd. The cells of a mark of half the bits are pairs of cells."""
    bits = max(MARK_BITS, 1 << max(len(values) - 1, 0).bit_length())
    return np.packbits((np.bincount((values & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(data: np.ndarray, size: int) -> np.ndarray:
    """The mark of this many bytes that the same set has."""
    while len(data) > size:
        data = data[: len(data) // 2] ^ data[len(data) // 2 :]
    return data


def apart(p: bytes, q: bytes) -> int:
    """Elements that two sets at least do not share, by their marks."""
    u, v = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
    size = min(len(u), len(v))
    return int(np.bitwise_count(folded(u, size) ^ folded(v, size)).sum())


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: a document's size, class and mark; kind 1: a cell of shingles that its task met often; kind 2: a block of all cells' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, dtype=np.int32)
        total = 0
        for batch in batches:
            buf, offsets = flat(batch.column(1))
            for a, b in chunks(offsets):
                values, bounds = shingles(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                cells += np.bincount((values >> U64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS).astype(np.int32)
                total += len(values)
                k = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(k, np.int8)),
                        batch.column(0).slice(a, k),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(signatures(values, bounds), pa.int64()),
                        pa.array([mark(values[i:j]) for i, j in zip(bounds, bounds[1:])], pa.binary()),
                    ],
                    names=["kind", "doc_id", "n", "sig", "mark"],
                )
        mean = total / len(cells)
        often = np.flatnonzero(cells > 3 + mean + 5 * mean**0.5)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(often), np.int8)), pa.array(often, pa.int64()), pa.array(cells[often], pa.int64()), pa.array(np.zeros(len(often), np.int64)), pa.array([b""] * len(often), pa.binary())],
            names=["kind", "doc_id", "n", "sig", "mark"],
        )
        if total:
            # a count that does not fit is of a cell that is told above, unless the task is so large that most are
            parts = np.minimum(cells, 65535).astype("<u2").reshape(BLOCKS, -1)
            none = pa.array(np.zeros(BLOCKS, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(BLOCKS, 2, np.int8)), pa.array(np.arange(BLOCKS)), none, none, pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())],
                names=["kind", "doc_id", "n", "sig", "mark"],
            )

    return mapped(docs, run, "kind byte, doc_id long, n long, sig long, mark binary")


def _regions(docs: DataFrame, levels, size: int, similar: tuple[int, int]) -> DataFrame:
    """Each class in the regions of its window: (key, sig, n, place), place counted along the global order.

    A task tells each class once, so that copies are gathered before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, dtype=np.uint8)
        seen: set[int] = set()
        for batch in batches:
            buf, offsets = flat(batch.column(0))
            for a, b in chunks(offsets):
                values, bounds = shingles(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                if len(values) == 0:
                    continue
                sig = signatures(values, bounds)
                n = np.diff(bounds)
                fresh = np.zeros(len(n), dtype=bool)
                for k, x in enumerate(sig.tolist()):
                    if x and x not in seen:
                        seen.add(x)
                        fresh[k] = True
                if len(seen) > SEEN:
                    seen.clear()
                doc = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((mix(values), level[(values >> U64(64 - CELL_BITS)).astype(np.int64)], doc))
                place = np.arange(len(values)) - bounds[doc]
                keep = (place <= allowance(n, similar)[doc]) & fresh[doc]
                doc, place, key = doc[keep], place[keep], values[order][keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(sig[doc]), pa.array(n[doc], pa.int32()), pa.array(place, pa.int32())],
                    names=["key", "sig", "n", "place"],
                )

    return mapped(docs.select("text"), run, "key long, sig long, n int, place int")


def _enough(both: np.ndarray, n: np.ndarray, m: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Whether sets of sizes n and m with this many shared elements are similar."""
    return both * similar[1] >= similar[0] * (n + m - both)


def _pairs_of_regions(regions: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Candidate pairs of regions, and the members of the larger ones: (kind, key, a, b).

    kind 0: a pair (key, a) of a region of at most LEAF classes, or of a larger one and its pivot, its
    class of least name; pairs are those that sizes and places allow, and a task tells one about
    once. kind 1: a class a of a larger region, b its size and place. Rows come sorted by region, and
    a task holds a batch and LEAF members. Regions of the same members that lie in one batch
    are named by these, and so become one, whose places are the least of theirs: the bounds only widen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.zeros(0, np.int64)] * 4
        held, key_now, pivot, last_sig = none, None, None, None
        told: set[int] = set()

        def pairs(a, b, na, nb, pa_, pb):
            ok = (a != b) & _enough(np.minimum(na - pa_, nb - pb), na, nb, similar)
            a, b = np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])
            new = np.zeros(len(a), dtype=bool)
            for k, x in enumerate(mix(a.view(U64) ^ mix(b.view(U64))).tolist()):
                if x not in told:
                    told.add(x)
                    new[k] = True
            if len(told) > SEEN:
                told.clear()
            none = np.zeros(int(new.sum()), np.int64)
            return [none, a[new], b[new], none]

        def small(key, sig, n, place):
            """All pairs of groups of equal key, by distance within the group."""
            out = []
            for d in range(1, LEAF):
                i = np.flatnonzero(key[d:] == key[:-d])
                if len(i) == 0:
                    break
                out.append(pairs(sig[i], sig[i + d], n[i], n[i + d], place[i], place[i + d]))
            return out

        def large(key, sig, n, place):
            return [[np.ones(len(sig), np.int64), np.full(len(sig), key), sig, n << 32 | place], pairs(sig, np.full(len(sig), pivot[0]), n, np.full(len(sig), pivot[1]), place, pivot[2])]

        def batch_of(parts):
            cols = [np.concatenate([p[k] for p in parts]) for k in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int8)), *(pa.array(c.astype(np.int64)) for c in cols[1:])], names=["kind", "key", "a", "b"])

        for batch in batches:
            cols = [np.concatenate((h, batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64))) for k, h in enumerate(held)]
            once = np.ones(len(cols[0]), dtype=bool)
            once[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            cols = [c[once] for c in cols]
            out = []
            if len(cols[0]) and cols[0][0] == key_now:
                stop = int(np.searchsorted(cols[0] != key_now, True))
                first = 1 if cols[1][0] == last_sig else 0  # a class that ended the batch before
                last_sig = int(cols[1][stop - 1])
                out += large(key_now, *(c[first:stop] for c in cols[1:]))
                cols = [c[stop:] for c in cols]
            key, held = cols[0], none
            if len(key):
                key_now = None
                begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                sizes = np.diff(np.append(begins, len(key)))
                last = int(begins[-1])
                rest = [c[last:] for c in cols]
                group = np.repeat(sizes, sizes)
                s = (np.arange(len(key)) < last) & (group > 1) & (group <= LEAF)
                if s.any():
                    out += small(*(c[s] for c in cols))
                for g in np.flatnonzero((sizes > LEAF) & (begins < last)).tolist():
                    i, j = int(begins[g]), int(begins[g] + sizes[g])
                    pivot = [c[i] for c in cols[1:]]
                    name = mix(mix(cols[1][i:j].view(U64)).sum(keepdims=True) ^ U64(j - i)).view(np.int64)[0]
                    out += large(name, *(c[i:j] for c in cols[1:]))
                if len(rest[0]) > LEAF:
                    key_now, pivot, last_sig = int(rest[0][0]), [c[0] for c in rest[1:]], int(rest[1][-1])
                    out += large(key_now, *rest[1:])
                else:
                    held = rest
            if out:
                yield batch_of(out)
        if len(held[0]) > 1:
            yield batch_of(small(*held))

    ordered = regions.repartition("key").sortWithinPartitions("key", "sig")
    return mapped(ordered, run, "kind byte, key long, a long, b long").groupBy("kind", "key", "a").agg(F.min("b").alias("b"))


def pack(values: np.ndarray) -> bytes:
    """The bytes of each hash that are kept, 5 or in large sets 8, then the upper bytes of the sorted hashes."""
    size = 8 if len(values) > WIDE else 5
    return bytes([size]) + values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack(data: bytes, size: int) -> np.ndarray:
    """The upper bytes of the hashes, as many as asked for and kept at most."""
    kept = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(-1, data[0])
    wide = np.zeros((len(kept), 8), dtype=np.uint8)
    wide[:, 8 - size :] = kept[:, :size]
    return wide.view(">u8").ravel().astype(U64)


def shared(p: bytes, q: bytes) -> tuple[int, int, int]:
    """The sizes of two packed sets, and their shared elements."""
    size = min(p[0], q[0])
    u, v = unpack(p, size), unpack(q, size)
    at = np.searchsorted(v, u)
    at[at == len(v)] = 0
    return len(u), len(v), int((v[at] == u).sum()) if len(v) else 0


def _measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds the sizes and the shared elements of both sets of each pair."""
    left = sets.select(F.col("sig").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("sig").alias("b"), F.col("set").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            told = np.array([shared(p, q) for p, q in zip(x, y)], dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in told.T.copy())], names=["a", "b", "n", "m", "both"])

    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return mapped(joined, run, "a long, b long, n long, m long, both long")


def _cell(doc_ids: np.ndarray) -> np.ndarray:
    return (mix(doc_ids.view(U64) ^ U64(0x2545F4914F6CDD1D)) >> U64(64 - REP_BITS)).astype(np.int64)


def _marked(spark: SparkSession, reps: DataFrame):
    """Broadcasts a bitmap of fixed size of the doc_ids of reps; null is the first cell of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((1 << REP_BITS) + 8, dtype=bool)
        for batch in batches:
            ids = batch.column(0)
            bits[1 << REP_BITS] |= ids.null_count > 0
            bits[_cell(ids.drop_null().to_numpy().astype(np.int64))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros((1 << REP_BITS) // 8 + 1, dtype=np.uint8)
    for row in mapped(reps.select("doc_id").coalesce(REP_TASKS), run, "bits binary").toLocalIterator():  # one row for each task
        out |= np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return spark.sparkContext.broadcast(out.tobytes())


def _sets(docs: DataFrame, wanted, size: int) -> DataFrame:
    """The sorted sets of the documents that a bitmap of doc_ids names: few others come along, and no text is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted.value, dtype=np.uint8)).astype(bool)
        for batch in batches:
            ids = batch.column(0)
            there = bits[_cell(ids.fill_null(0).to_numpy().astype(np.int64))]
            if ids.null_count:
                there = np.where(ids.is_null().to_numpy(zero_copy_only=False), bits[1 << REP_BITS], there)
            buf, offsets = flat(batch.column(1).filter(pa.array(there)))
            for a, b in chunks(offsets):
                values, bounds = shingles(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                data = [pack(values[i:j]) for i, j in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(signatures(values, bounds)), pa.array(data, pa.binary())], names=["sig", "set"])

    # sets of classes that no pair names, or told twice, do no harm to the links
    return mapped(docs.select("doc_id", "text"), run, "sig long, set binary")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(v, root): the least node reachable from each linked node. links: (a, b) with a < b.

    Star contraction: every node points to the least of its neighbours, in turns over its larger and
    its smaller ones, until all that is left are stars; the steps are about the logarithm of the
    longest chain.
    """
    edges = cut(spark, links.select("a", "b").distinct())
    while True:
        # a star forest: no node is both above and below another, or below two
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
        knots = ends.groupBy("v").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("up + down > 1")
        if knots.agg(F.count("*")).first()[0] == 0:
            return edges.select(F.col("b").alias("v"), F.col("a").alias("root")).union(edges.select("a", "a")).distinct()
        both = edges.select(F.col("b").alias("v"), F.col("a").alias("w")).union(edges.select("a", "b"))
        least = both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m"))
        # large star: larger neighbours of v point to the least of v's neighbourhood
        large = both.join(least, "v").where("w > v").select(F.col("m").alias("a"), F.col("w").alias("b")).distinct()
        # small star: v and its smaller neighbours point to the least of them
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y")
        edges = cut(spark, small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())


def _often(blocks: DataFrame) -> DataFrame:
    """(doc_id, n): the cells that all tasks together met often, beyond what cells are met on the average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(zlib.decompress(data.as_py()), dtype="<u2")
                sums[block] = sums[block] + own if block in sums else own.astype(np.int64)
        for block, counts in sums.items():
            # the median, as a few very frequent shingles would lift the mean
            usual = float(np.median(counts))
            often = np.flatnonzero(counts > 3 + usual + 5 * usual**0.5)
            yield pa.RecordBatch.from_arrays([pa.array(often + block * len(counts), pa.int64()), pa.array((counts[often] - usual).astype(np.int64))], names=["doc_id", "n"])

    return mapped(blocks.select("doc_id", "mark").repartition(BLOCKS, "doc_id"), run, "doc_id long, n long")


def _levels(spark: SparkSession, scanned: DataFrame):
    """Broadcasts a table of fixed size: how often the shingles of each cell are met, as a logarithm."""
    table = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    told = scanned.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).union(_often(scanned.where("kind = 2")))
    counted = told.groupBy("doc_id").agg(F.max("n").alias("n")).select("doc_id", F.least(F.lit(63), F.ceil(F.log2("n"))).cast("int").alias("level"))
    for row in counted.toLocalIterator():
        table[row["doc_id"]] = row["level"]
    return spark.sparkContext.broadcast(table.tobytes())


class Links:
    """The links found between classes, and the components that these make.

    reps: (sig, doc_id, size, mark), one document of each class.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, reps: DataFrame, size: int, similar: tuple[int, int]) -> None:
        self.spark, self.docs, self.reps, self.size, self.similar = spark, docs, reps, size, similar
        self.roots = spark.createDataFrame([], "v long, root long")
        self.most = max(AT_ONCE, reps.count() // 2)

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the marks do not rule out."""
        named = [self.reps.select(F.col("sig").alias(c), F.col("size").alias(f"{c}_n"), F.col("mark").alias(f"{c}_mark")) for c in "ab"]
        similar = self.similar

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                away = np.array([apart(p, q) for p, q in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], dtype=np.int64)
                n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                ok = pa.array(_enough((n + m - away) // 2, n, m, similar))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(ok)

        joined = pairs.select("a", "b").join(named[0], "a").join(named[1], "b").select("a", "b", "a_n", "b_n", "a_mark", "b_mark")
        return mapped(joined, run, "a long, b long")

    def measured(self, pairs: DataFrame) -> DataFrame:
        """(a, b, n, m, both) of each pair, by the whole sets, in rounds of a bounded number of pairs. The pairs are cut."""
        rounds = max(1, -(-pairs.count() // self.most))
        out = []
        for k in range(rounds):
            # what came before goes first, as a set is sent for each pair
            release(self.spark)
            part = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k)
            named = part.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
            wanted = _marked(self.spark, self.reps.select("sig", "doc_id").join(named, "sig"))
            # the sets are made where they are sent: files of them would be as large as the shuffle
            out.append(cut(self.spark, _measure(part, _sets(self.docs, wanted, self.size)).distinct()))
            del part, named, wanted
        release(self.spark)
        return reduce(DataFrame.union, out)

    def rooted(self, df: DataFrame, sig: str, as_: str) -> DataFrame:
        """Adds the component of a class."""
        return df.join(self.roots.select(F.col("v").alias(sig), F.col("root").alias(as_)), sig, "left").withColumn(as_, F.coalesce(as_, sig))

    def add(self, measured: DataFrame) -> None:
        """Joins the components of the pairs that are similar: the components so far are nodes of a smaller graph."""
        linked = measured.where(F.col("both") * self.similar[1] >= (F.col("n") + F.col("m") - F.col("both")) * self.similar[0]).select("a", "b")
        between = self.rooted(self.rooted(linked, "a", "x"), "b", "y").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        above = components(self.spark, between).withColumnRenamed("root", "top")
        old = self.roots.join(above.withColumnRenamed("v", "root"), "root", "left").select("v", F.coalesce("top", "root").alias("root"))
        self.roots = cut(self.spark, old.union(above).distinct())

    def check(self, pairs: DataFrame) -> None:
        """Links what is similar of these pairs."""
        left = cut(self.spark, pairs)
        if not left.isEmpty():
            self.add(self.measured(left))


def _open(members: DataFrame, links: Links) -> DataFrame:
    """The members of regions that hold more than one component and a class at home, with what their joining takes.

    members: (key, sig, n, place, home). Adds comp, whether that is not the region's largest one,
    and work, the pairs of classes of others with all.
    """
    members = links.rooted(members.select("key", "sig", "n", "place", "home"), "sig", "comp")
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("c"), F.max("home").alias("home"))
    whole = sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("c"), F.count("*").alias("comps"), F.max("home").alias("home"))
    whole = whole.where("comps > 1 and home").select("key", "main", ((F.col("c") - F.col("most")) * F.col("c")).alias("work"))
    return cut(members.sparkSession, members.join(whole, "key").withColumn("other", F.col("comp") != F.col("main")).drop("main"))


def _direct(members: DataFrame, links: Links, nearest: bool) -> DataFrame:
    """Pairs (a, b) of regions that sizes, places and marks allow, of different components and with one class at home.

    The members outside of a region's largest component come first and are held; these and the others
    pass by them. A task tells about a pair once. nearest: of the pairs of a held class with one
    component only the one whose marks differ least, as one link makes the others needless; a row
    (key, null) names a region with others.
    """
    similar = links.similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        left: set[int] = set()
        key_now, held = None, []

        def fold_of(marks):
            return np.array([folded(np.frombuffer(m, np.uint8), MARK_BITS // 8) for m in marks]).reshape(len(marks), -1).view(np.uint64)

        def meet(x, y):
            """x: one held member; y: columns of some members, with their folds."""
            ok = (y[4] != x[4]) & (y[5] | x[5])
            ok &= _enough(np.minimum(y[2] - y[3], x[2] - x[3]), y[2], x[2], similar)
            i = np.flatnonzero(ok)
            away = np.bitwise_count(y[7][i] ^ x[7]).sum(1, dtype=np.int64)
            for k in i[_enough((y[2][i] + x[2] - away) // 2, y[2][i], x[2], similar)].tolist():
                pair = int(x[1]), int(y[1][k])
                if pair in told:
                    continue
                told.add(pair)
                away = apart(x[6], y[6][k])
                if not _enough((int(y[2][k]) + int(x[2]) - away) // 2, int(y[2][k]), int(x[2]), similar):
                    continue
                at, own = (pair[0], int(y[4][k])) if nearest else pair, (away, pair[1], int(key_now))
                if at in best:
                    left.add(max(best[at], own)[2])
                    own = min(best[at], own)
                best[at] = own

        def found():
            a, b = np.array([x for x, _ in best], dtype=np.int64), np.array([y for _, y, _ in best.values()], dtype=np.int64)
            rows = [pa.array([*np.minimum(a, b).tolist(), *left], pa.int64()), pa.array([*np.maximum(a, b).tolist(), *[None] * len(left)], pa.int64())]
            for x in (best, told, left):
                x.clear()
            return pa.RecordBatch.from_arrays(rows, names=["a", "b"])

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)] + [np.array(batch.column(6).to_pylist(), dtype=object)]
            cols.append(fold_of(cols[6]))
            other = batch.column(7).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1).tolist(), batch.num_rows]
            for i, j in zip(bounds, bounds[1:]):
                if cols[0][i] != key_now:
                    key_now, held = cols[0][i], []
                part = [c[i:j] for c in cols]
                for x in held:
                    meet(x, part)
                for k in np.flatnonzero(other[i:j]).tolist():
                    x = [c[k] for c in part]
                    # the members that this batch holds after it; those before are held or were met with it
                    meet(x, [c[k + 1 :] for c in part])
                    held.append(x)
            if len(told) > SEEN:
                yield found()
        if best:
            yield found()

    marked = members.join(links.reps.select("sig", "mark"), "sig").select("key", "sig", "n", "place", "comp", "home", "mark", "other")
    ordered = marked.repartition("key").sortWithinPartitions("key", F.desc("other"))
    return mapped(ordered, run, "a long, b long").distinct()


def _join_open(members: DataFrame, links: Links) -> None:
    """Links the classes of open regions: by the nearest pairs first, then by the others where their regions are open still."""
    near = cut(links.spark, _direct(members, links, True))
    links.check(near.where("b is not null"))
    left = _open(members.join(near.where("b is null").select(F.col("a").alias("key")), "key", "left_semi"), links)
    if not left.isEmpty():
        links.check(_direct(left, links, False))


def _cells(members: DataFrame, links: Links, level: int) -> tuple[DataFrame, DataFrame]:
    """Splits regions into Voronoi cells: the members of these, and those of regions that the pivots do not split.

    A home member goes to the cell of its nearest pivot, and everyone to the cells whose window holds
    them: with d(x, y) <= t and x nearest to p, d(y, p) <= d(y, q) + 2t for each pivot q. Pivots are
    the classes of least hash, so that regions of nearly the same members share them; their own
    pairs are measured here, and they leave.
    """
    window = 2.0 - 2.0 * links.similar[0] / links.similar[1] + 1e-9
    hashed = F.struct(F.xxhash64("sig", F.lit(level)).alias("hash"), "sig")
    least = members.groupBy("key").agg(F.min(hashed).alias("p0"), F.count("*").alias("total"))
    for k in range(1, PIVOTS):
        # one more pivot a turn: no array of members is ever gathered
        more = members.join(least.select("key", F.col(f"p{k - 1}.hash").alias("after")), "key").where(hashed["hash"] > F.col("after"))
        least = least.join(more.groupBy("key").agg(F.min(hashed).alias(f"p{k}")), "key", "left")
    chosen = F.array(*[f"p{k}.sig" for k in range(PIVOTS)])
    pivots = cut(links.spark, least.select("key", "total", F.explode(chosen).alias("pivot")).where("pivot is not null"))
    met = members.join(pivots, "key").where("sig <> pivot")
    measured = links.measured(cut(links.spark, met.select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b")).distinct()))
    links.add(measured)
    far = measured.select("a", "b", (F.lit(1.0) - F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("d"))
    far = far.union(far.select("b", "a", "d")).toDF("sig", "pivot", "d")
    told = met.join(far, ["sig", "pivot"]).join(pivots.select("key", F.col("pivot").alias("sig")), ["key", "sig"], "left_anti")
    nearest = told.groupBy("key", "sig").agg(F.min(F.struct("d", "pivot")).alias("near"))
    told = told.join(nearest, ["key", "sig"]).where(F.col("d") <= F.col("near.d") + window)
    told = cut(links.spark, told.withColumn("home", F.col("home") & (F.col("pivot") == F.col("near.pivot"))).drop("d", "near"))
    work = told.groupBy("key", "pivot", "total").agg(F.count("*").alias("c"), F.sum(F.col("home").cast("long")).alias("h"))
    work = work.groupBy("key", "total").agg(F.sum(F.col("c").cast("double") * F.col("h")).alias("work"))
    split = work.where(F.col("work") < 0.5 * F.col("total") * F.col("total")).select("key")
    cells = told.join(split, "key").withColumn("key", F.xxhash64("key", "pivot")).drop("pivot", "total")
    return cells, members.join(split, "key", "left_anti").join(pivots.select("key", F.col("pivot").alias("sig")), ["key", "sig"], "left_anti")


def _join_regions(members: DataFrame, links: Links) -> None:
    """Joins the larger regions again. members: (key, sig, n, place)."""
    members = _open(members.withColumn("home", F.lit(True)), links)
    for level in range(LEVELS + 1):
        if members.isEmpty():
            return
        easy, hard = members.where(F.col("work") <= DIRECT), members.where(F.col("work") > DIRECT)
        if level == LEVELS or hard.isEmpty():
            return _join_open(members, links)
        cells, whole = _cells(hard, links, level)
        _join_open(easy.unionByName(whole), links)
        members = _open(cells, links)


def linked_classes(spark: SparkSession, docs: DataFrame, size: int, similar: tuple[int, int]) -> DataFrame:
    """doc_id, n, sig, root and component of each document: its class, the class that its component is told by, and the least doc_id in it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = cut(spark, _scan(docs, size))
    rows = scanned.where("kind = 0").select("doc_id", "n", "sig")
    met = cut(spark, _pairs_of_regions(_regions(docs, _levels(spark, scanned), size, similar), similar))
    release(spark)
    classes = scanned.where("kind = 0 and n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("size"), F.max("mark").alias("mark"))
    links = Links(spark, docs, cut(spark, classes), size, similar)
    links.check(links.possible(met.where("kind = 0").select(F.col("key").alias("a"), F.col("a").alias("b"))))
    place = F.col("b").bitwiseAND(0xFFFFFFFF).alias("place")
    _join_regions(met.where("kind = 1").select("key", F.col("a").alias("sig"), F.shiftright("b", 32).alias("n"), place), links)
    roots, least = links.roots, links.reps.select("sig", F.col("doc_id").alias("least"))
    reached = roots.join(least, roots["v"] == least["sig"]).groupBy("root").agg(F.min("least").alias("reached"))
    reached = roots.join(reached, "root").select(F.col("v").alias("sig"), "reached", "root")
    told = least.join(reached, "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"), F.coalesce(F.least("least", "reached"), "least", "reached").alias("component"))
    out = rows.join(told, "sig", "left")
    return out.select("doc_id", "n", "sig", F.coalesce("root", "sig").alias("root"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component"))


def jaccard_components(spark: SparkSession, docs: DataFrame, size: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """n_shingles and component_id (smallest doc_id reachable by links) of each document.

    Null, empty and blank texts have no shingles and link with nothing, equal ones included. A null
    doc_id names nothing: its component_id is the smallest id that its text reaches, or null.
    Repeated rows are separate rows of one component. Similarity is a fraction, compared exactly.
    """
    return linked_classes(spark, docs, size, similar).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(spark: SparkSession, docs: DataFrame, size: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The documents, with all their columns, that name their component, and those without shingles.

    Of rows of one component that share the naming doc_id the one whose text hashes least stays.
    """
    rep, sig, root, full, least, again, place = (unlike(docs.columns, f"its_{x}") for x in ("doc", "sig", "root", "full", "least", "again", "place"))
    found = linked_classes(spark, docs, size, similar).select(F.col("doc_id").alias(rep), F.col("sig").alias(sig), F.col("root").alias(root), (F.col("n") > 0).alias(full), F.col("component").alias(least))
    keep = cut(spark, found.where(~F.col(full) | F.col(rep).eqNullSafe(F.col(least))).drop(least).distinct())
    at, names, own = docs.columns.index("text"), [*docs.columns, again], unlike([*docs.columns, again], "own_sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat(batch.column(at))
            found = [np.zeros(0, np.int64)]
            for a, b in chunks(offsets):
                found.append(signatures(*shingles(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found))], names=names)

    # texts move once, at every size
    signed = mapped(docs, run, StructType([*docs.schema.fields, StructField(again, LongType())])).withColumnRenamed(again, own)
    rows = signed.join(keep.hint("shuffle_hash"), signed["doc_id"].eqNullSafe(keep[rep]) & (signed[own] == keep[sig]))
    # rows of one component that share the naming doc_id: all but one go
    doubled = keep.where(full).groupBy(rep, root).agg(F.count("*")).select(rep, root)
    times = docs.groupBy("doc_id").agg(F.count("*").alias(place)).where(F.col(place) > 1).select(F.col("doc_id").alias(least))
    more = cut(spark, doubled.join(times, doubled[rep].eqNullSafe(times[least]), "left_semi").select(F.col(rep).alias(least), F.col(root).alias(again)).distinct())
    if more.isEmpty():
        return rows.select(*docs.columns)
    marked = rows.join(broadcast_if_small(more, more.count()), rows[rep].eqNullSafe(more[least]) & (rows[root] == more[again]), "left")
    by = Window.partitionBy(rep, root).orderBy(F.xxhash64("text"), "text")
    once = marked.where(F.col(again).isNotNull()).withColumn(place, F.row_number().over(by)).where(F.col(place) == 1)
    return marked.where(F.col(again).isNull()).select(*docs.columns).unionByName(once.select(*docs.columns))
