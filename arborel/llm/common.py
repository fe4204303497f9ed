"""Helpers shared by the corpus operators: flat text buffers, vector hashes, scratch space."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes whose mixed values are the terms of a polynomial hash.
GRAM = 8
#: Bytes handled at once by the vector code, unless one text alone is longer.
CHUNK_BYTES = 1 << 20
_powers: dict[int, np.ndarray] = {}


def held_out(doc_id: Column) -> Column:
    """True for rows kept from training: crc32 of doc_id as text, modulo 3, is 1; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; those for usual chunks are kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n + 1:
        have = np.full(max(n + 1, CHUNK_BYTES + (1 << 16)), base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= CHUNK_BYTES + (1 << 16):
            _powers[base] = have
    return have


class RollingHash:
    """Polynomial hashes modulo 2**64 of any slices of one buffer.

    The terms are not bytes but mixed values of the GRAM bytes from each place. A polynomial over
    plain bytes gives equal hashes to words that mirror each other at powers of two, such as the
    Thue-Morse word and its complement; here the terms of such words do not cancel. A slice of fewer
    bytes is told by these and their number, without collisions.
    """

    def __init__(self, buf: np.ndarray) -> None:
        n = len(buf)
        wide = np.concatenate((buf, np.zeros(2 * GRAM, np.uint8)))
        self.grams = np.empty(n + 1, dtype=U64)
        for k in range(min(GRAM, n + 1)):
            count = (n - k) // GRAM + 1
            self.grams[k::GRAM] = wide[k : k + count * GRAM].view("<u8")
        terms = self.grams[:n] * U64(0xFF51AFD7ED558CCD)
        terms ^= terms >> U64(32)
        terms *= U64(0xC4CEB9FE1A85EC53)
        terms ^= terms >> U64(29)
        terms *= powers(_BASE, n)[:n]
        self.prefix = np.zeros(n + 1, dtype=U64)
        np.cumsum(terms, out=self.prefix[1:])
        self.inverse = powers(_INVERSE, n)

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = ends - starts
        out = (self.prefix[np.maximum(ends - GRAM + 1, 0)] - self.prefix[starts]) * self.inverse[starts]
        few = np.flatnonzero(sizes < GRAM)
        if len(few):
            size = sizes[few].astype(U64)
            out[few] = (self.grams[starts[few]] & ((U64(1) << (U64(8) * size)) - U64(1))) | (size << U64(56))
        return out

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all slices of this size, by their start."""
        n = max(len(self.prefix) - size, 0)
        if size < GRAM:
            return self.slices(np.arange(n), np.arange(n) + size)
        out = self.prefix[size - GRAM + 1 : size - GRAM + 1 + n] - self.prefix[:n]
        out *= self.inverse[:n]
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that order and low bits look random."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and n + 1 offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return buf, (offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64))


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes together; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = to


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes that the table of 256 marks; no run crosses texts."""
    inside = table[buf]
    before = np.zeros(len(buf) + 1, dtype=bool)
    before[1:] = inside
    before[offsets[:-1]] = False
    after = np.zeros(len(buf) + 1, dtype=bool)
    after[:-1] = inside
    after[offsets[1:]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends


#: Lower-cases A-Z and leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Marks the byte values of these inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


def unlike(columns: list[str], name: str) -> str:
    """A name for one more column that none of these has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the place of each one's first byte."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[at].astype(np.uint32)
    if len(at) == len(buf):
        return lead, at
    wide = np.concatenate((buf, np.zeros(3, np.uint8))).astype(np.uint32)
    size = np.diff(np.append(at, len(buf)))
    out = np.where(size == 1, lead, lead & (0xFF >> (size + 1)).astype(np.uint32))
    for k in range(1, 4):
        out = np.where(size > k, (out << 6) | (wide[at + k] & 0x3F), out)
    return out, at


#: Bytes of the Arrow batches that workers get, as texts and sets of any size come in them; a single larger row makes a larger batch.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow, once the workers can import this package, in batches bound by bytes. A smaller bound of the session stays."""
    spark = df.sparkSession
    ship(spark)
    told = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(BATCH).lower())
    if told is None or not 0 < int(told[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[told[2]] <= BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))

    def whole(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: its worker goes on for other tasks, and other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, from spark.checkpoint.dir. Where that is unset, a session on one machine makes one of its own."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    told = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not told:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        told = tempfile.mkdtemp(prefix="arborel-")
    sc.setCheckpointDir(told)
    return sc._jsc.sc().getCheckpointDir().get()


def store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder and its path there."""
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cuts the lineage through reliable files in the shared folder; Spark removes them once unreferenced."""
    shared_dir(spark)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more, before the next large step."""
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """Hints a broadcast when the counted rows fit a fixed bound; else the join shuffles."""
    return F.broadcast(df) if rows <= most else df


def crc32_text(value: int) -> int:
    return zlib.crc32(str(value).encode())


def bounded_sample(df: DataFrame, by: list[str], key: str, bound: int) -> DataFrame:
    """About `bound` rows of each class, by a hash of the key; the class sizes come from one count over all rows."""
    counts = cut(df.sparkSession, df.groupBy(*by).count())
    picked = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000))
    joined = df.join(broadcast_if_small(counts, counts.count()), by)
    return joined.where(picked < F.lit(1_000_000.0) * F.least(F.lit(1.0), F.lit(float(bound)) / F.col("count"))).drop("count")
