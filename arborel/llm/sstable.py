"""Token ids in sorted-string-table shards.

A shard holds documents by ascending key: blocks of prefix-compressed entries, an index with the
last key of each block, a Bloom filter over the keys, and a footer of fixed size, all little-endian:

    block:  entries, then the offset of each restart (4 bytes) and their number (4 bytes), deflated
    entry:  shared and unshared key bytes and value bytes (varints), the unshared key bytes, the value
    index:  for each block: key length (2), last key, offset (8), size (4), first document's place (8)
    filter: the bits, with their number and that of the hashes before them (4 + 1)
    footer: offsets of index and filter (8 + 8), documents, ids (8 + 8), crc32 of index and filter (4), magic (8)

A key is a byte 0 or 1 for a null or other doc_id, the doc_id with its sign flipped (8, big-endian)
and the number of the row among those of that doc_id in the shard (4, big-endian). A value is a byte
2 or 4 and ids of that many bytes each.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, flat, mapped, shared_dir, store
from .pieces import PieceTable

MAGIC = b"ARBSST1\n"
FOOTER = struct.Struct("<QQQQI8s")
BLOCK_BYTES = 64 << 10
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Bytes of text that are encoded at once, unless one text alone is longer.
PART_BYTES = 1 << 20
#: Pieces that the tokenizer gets at once.
TOGETHER = 5000
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
_coders: dict[str, Coder] = {}


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def key_of(doc_id: int | None, row: int = 0) -> bytes:
    head = b"\0" + bytes(8) if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")
    return head + row.to_bytes(4, "big")


def doc_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:9], "big") - (1 << 63) if key[0] else None


def bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    h = hashlib.blake2b(key[:9], digest_size=16).digest()
    a, b = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little") | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, out) -> None:
        self.out, self.at = out, 0
        self.entries, self.restarts, self.count, self.last = bytearray(), [], 0, b""
        self.index = bytearray()
        self.heads: list[bytes] = []
        self.docs = self.ids = self.block_start = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.count % RESTART == 0:
            self.restarts.append(len(self.entries))
        else:
            shared = len(os.path.commonprefix([key, self.last]))
        width = 2 if len(ids) == 0 or int(ids.max()) < 1 << 16 else 4
        value = bytes([width]) + ids.astype(f"<u{width}").tobytes()
        self.entries += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.count += 1
        self.last = key
        if not self.heads or self.heads[-1][:9] != key[:9]:
            self.heads.append(key)
        self.docs += 1
        self.ids += len(ids)
        if len(self.entries) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.count:
            return
        raw = bytes(self.entries) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        data = zlib.compress(raw, 1)
        self.index += struct.pack("<H", len(self.last)) + self.last + struct.pack("<QIQ", self.at, len(data), self.block_start)
        self.out.write(data)
        self.at += len(data)
        self.entries, self.restarts, self.count, self.block_start = bytearray(), [], 0, self.docs

    def close(self) -> None:
        self.flush()
        bits = max(64, BLOOM_BITS * len(self.heads))
        marks = np.zeros(-(-bits // 8) * 8, dtype=np.uint8)
        for key in self.heads:
            marks[bloom_places(key, bits, BLOOM_HASHES)] = 1
        bloom = struct.pack("<IB", bits, BLOOM_HASHES) + np.packbits(marks, bitorder="little").tobytes()
        tail = bytes(self.index) + bloom
        self.out.write(tail + FOOTER.pack(self.at, self.at + len(self.index), self.docs, self.ids, zlib.crc32(tail), MAGIC))


class Reader:
    """Reads one shard from a seekable file: all entries in order, or one document by binary search."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - FOOTER.size)
        index_at, bloom_at, self.docs, self.ids, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        file.seek(index_at)
        tail = file.read(size - FOOTER.size - index_at)
        if magic != MAGIC or zlib.crc32(tail) != crc:
            raise ValueError("not a whole shard")
        index, bloom = tail[: bloom_at - index_at], tail[bloom_at - index_at :]
        self.bits, self.hashes = struct.unpack_from("<IB", bloom)
        self.bloom = bloom[5:]
        self.lasts: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        at = 0
        while at < len(index):
            n = struct.unpack_from("<H", index, at)[0]
            self.lasts.append(index[at + 2 : at + 2 + n])
            offset, size, _ = struct.unpack_from("<QIQ", index, at + 2 + n)
            self.places.append((offset, size))
            at += 2 + n + 20

    def block(self, k: int) -> tuple[bytes, list[int]]:
        offset, size = self.places[k]
        self.file.seek(offset)
        raw = zlib.decompress(self.file.read(size))
        n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        return raw[: len(raw) - 4 * (n + 1)], list(struct.unpack_from(f"<{n}I", raw, len(raw) - 4 * (n + 1)))

    @staticmethod
    def walk(data: bytes, at: int = 0) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < len(data):
            shared, at = read_varint(data, at)
            fresh, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + fresh]
            at += fresh
            yield key, np.frombuffer(data, dtype=f"<u{data[at]}", count=(size - 1) // data[at], offset=at + 1)
            at += size

    def entries(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.places)):
            yield from self.walk(self.block(k)[0])

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all rows of a document, by Bloom filter, block index and restarts."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, self.bits, self.hashes)):
            return []
        low, high = 0, len(self.lasts)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.lasts[mid] < key else (low, mid)
        out: list[np.ndarray] = []
        for k in range(low, len(self.lasts)):
            data, restarts = self.block(k)
            a, b = 0, len(restarts) - 1
            while a < b:
                mid = (a + b + 1) // 2
                a, b = (mid, b) if next(self.walk(data, restarts[mid]))[0] <= key else (a, mid - 1)
            for found, ids in self.walk(data, restarts[a]):
                if found[:9] == key[:9]:
                    out.append(ids)
                elif found > key:
                    return out
        return out


class Coder:
    """The ids that the tokenizers library gives to texts, by way of the table of pieces.

    Pieces that begin with a space and end without are encoded as one text, as the pattern begins a
    match at each such space; the bytes of the tokens tell which are whose.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each core has a worker of its own
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        # byte-level tokens have a character for each byte; added ones stand for themselves
        sizes = {k: len(token) for token, k in self.own.get_vocab(with_added_tokens=False).items()}
        sizes |= {k: len(token.content.encode()) for k, token in self.own.get_added_tokens_decoder().items()}
        self.sizes = np.zeros(max(sizes) + 1, dtype=np.int64)
        self.sizes[list(sizes)] = list(sizes.values())
        self.table = PieceTable(self.encode)

    def together(self, pieces: list[str]) -> list[bytes] | None:
        """The ids of pieces encoded as one text, or None where tokens do not end where pieces do."""
        ids = np.array(self.own.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.concatenate(([0], np.cumsum(self.sizes[ids])))
        want = np.concatenate(([0], np.cumsum([len(p.encode()) for p in pieces])))
        at = np.searchsorted(ends, want)
        if ends[-1] != want[-1] or (ends[at] != want).any():
            return None
        return [ids[i:j].tobytes() for i, j in zip(at, at[1:])]

    def apart(self, pieces: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.own.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        plain = [k for k, p in enumerate(pieces) if p[0] == " " and not p[1:2].isspace() and not p[-1].isspace()]
        rest = set(range(len(pieces))).difference(plain)
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            found = self.together([pieces[k] for k in some])
            if found is None:
                rest.update(some)
            else:
                for k, x in zip(some, found):
                    out[k] = x
        listed = sorted(rest)
        for at in range(0, len(listed), TOGETHER):
            some = listed[at : at + TOGETHER]
            for k, x in zip(some, self.apart([pieces[k] for k in some])):
                out[k] = x
        return out


def coder(path: str) -> PieceTable:
    """The tokenizer of a worker behind a table of pieces."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path].table


def write_shards(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 0) -> DataFrame:
    """Writes the shards of a corpus; gives (part, name, docs, ids) of each, one row for a partition.

    Rows go by doc_id, nulls first, and those of one doc_id by a hash of their text, then the text. A task writes
    under a name of its own and then renames, so a repeated task leaves one whole shard in use.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = docs.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own, part, name, last, row = coder(tokenizer), None, 0, "", None, 0
        for batch in batches:
            if batch.num_rows and own is None:
                part = batch.column(2)[0].as_py()
                name = f"shard-{part:06d}-{uuid.uuid4().hex}.sst"
                fs, path = store(folder)
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}.tmp")
                own = Writer(out)
            buf, offsets = flat(batch.column(1))
            for a, b in chunks(offsets, PART_BYTES):
                ids, bounds = table.encode(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for k, doc_id in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    row = row + 1 if own.docs and doc_id == last else 0
                    last = doc_id
                    one = ids[bounds[k] : bounds[k + 1]]
                    own.add(key_of(doc_id, row), one if end_id is None else np.append(one, np.uint32(end_id)))
        if own is not None:
            own.close()
            out.close()
            fs.move(f"{path}/{name}.tmp", f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([own.docs], pa.int64()), pa.array([own.ids], pa.int64())], names=["part", "name", "docs", "ids"])

    return cut(spark, mapped(ordered, run, "part int, name string, docs long, ids long"))


def read_shards(spark: SparkSession, shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all documents in the shards, a shard at a time, block by block."""
    listed = shards.orderBy("part").collect()  # one row for each file
    starts = np.concatenate(([0], np.cumsum([r["ids"] for r in listed]))).tolist()
    files = spark.createDataFrame([(r["name"], s) for r, s in zip(listed, starts)], "name string, start long")
    if listed:
        files = files.repartition(max(1, len(listed)), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = store(folder)
                with fs.open_input_file(f"{path}/{name}") as file:
                    rows: list[tuple] = []
                    for key, ids in Reader(file).entries():
                        rows.append((doc_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _table(rows)
                            rows = []
                    yield _table(rows)

    return mapped(files, run, SCHEMA)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_shards(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes all documents as shards to a shared folder and reads them back.

    Null text is empty: the end id alone. Null and repeated doc_ids keep all their rows. Without a
    folder the shards go to a new one in the cluster's shared scratch folder.
    """
    folder = folder or f"{shared_dir(spark)}/sst-{uuid.uuid4().hex}"
    return read_shards(spark, write_shards(spark, docs, tokenizer, folder, end_id), folder)
