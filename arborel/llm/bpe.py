"""Byte-level BPE by a hierarchical-bitmap rank queue.

A merge rank has a bucket of positions in linked lists of symbols. A three-level bitmap marks the
buckets with entries, find-first-set gives the next rank, and entries whose pair has changed since
they were queued are skipped. Within a pre-token only the leftmost entry of the lowest rank is
merged at a time, also where a merge makes a pair of a lower rank: the order that the public
rank-file encoders define. The short pre-tokens of a batch share one queue, whose buckets are
arrays; a long one has a queue of its own, whose buckets are heaps, and takes n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks, flat, mapped
from .pieces import PieceTable

BYTES = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bytes that a worker's pre-tokens and their ids take, about, before it forgets them all; and of the objects about one.
CACHE_BYTES = 32 << 20
ENTRY_BYTES = 200
#: Bytes of a pre-token that shares its queue with others.
SHORT = 48
FEW = 24
#: Bytes of text that are encoded at once, unless one text alone is longer.
PART_BYTES = 1 << 20


class RankBits:
    """The ranks in use, under a bitmap of three levels of 64-bit words."""

    def __init__(self, ranks: int) -> None:
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def add(self, rank: int) -> None:
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def first(self) -> int:
        """The lowest rank; some must be in use."""
        t = (self.top & -self.top).bit_length() - 1
        m = (t << 6) | ((self.mid[t] & -self.mid[t]).bit_length() - 1)
        return (m << 6) | ((self.low[m] & -self.low[m]).bit_length() - 1)

    def remove(self, rank: int) -> None:
        m, t = rank >> 6, rank >> 12
        self.low[m] &= ~(1 << (rank & 63))
        if not self.low[m]:
            self.mid[t] &= ~(1 << (m & 63))
            if not self.mid[t]:
                self.top &= ~(1 << t)


class SharedQueue:
    """Buckets of positions as arrays, for many pre-tokens at once."""

    def __init__(self, ranks: int) -> None:
        self.bits = RankBits(ranks)
        self.buckets: dict[int, list[np.ndarray]] = {}

    def add(self, rank: int, positions: np.ndarray) -> None:
        have = self.buckets.get(rank)
        if have is not None:
            have.append(positions)
            return
        self.buckets[rank] = [positions]
        self.bits.add(rank)

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Queues the positions by their ranks; ranks below 0 have no merge."""
        keep = ranks >= 0
        ranks, positions = ranks[keep], positions[keep]
        if len(ranks) == 0:
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(ranks)]
        for rank, a, b in zip(ranks[bounds[:-1]].tolist(), bounds, bounds[1:]):
            self.add(rank, positions[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank with entries, and these, or None."""
        if not self.bits.top:
            return None
        rank = self.bits.first()
        self.bits.remove(rank)
        found = self.buckets.pop(rank)
        return rank, found[0] if len(found) == 1 else np.concatenate(found)


class LongQueue:
    """Buckets of positions as heaps, for one long pre-token."""

    def __init__(self, ranks: int) -> None:
        self.bits = RankBits(ranks)
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        have = self.buckets.get(rank)
        if have is not None:
            heappush(have, position)
            return
        self.buckets[rank] = [position]
        self.bits.add(rank)

    def pop(self) -> tuple[int, int] | None:
        """The leftmost position of the lowest rank, or None."""
        if not self.bits.top:
            return None
        rank = self.bits.first()
        have = self.buckets[rank]
        position = heappop(have)
        if not have:
            del self.buckets[rank]
            self.bits.remove(rank)
        return rank, position


class ByteBPE:
    """Encodes and decodes by the ranks of a rank file (base64 token and rank on each line)."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    self.pairs[left * self.size + right] = rank
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.values = np.append(np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int64), -1)
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)
        self.token_sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.table = PieceTable(self.encode_pieces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        if len(key) <= FEW:
            get = self.pairs.get
            return np.array([get(k, -1) for k in key.tolist()], dtype=np.int64)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def merge_together(self, pretokens: list[bytes]) -> list[bytes]:
        """The ids of each of some pre-tokens, as little-endian unsigned 32-bit integers; all share one queue."""
        lengths = np.array([len(p) for p in pretokens], dtype=np.int64)
        n = int(lengths.sum())
        if n == 0:
            return [b"" for _ in pretokens]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        sym = self.bytes[np.frombuffer(b"".join(pretokens), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pretokens)), lengths)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        full = lengths > 0
        after[ends[full] - 1] = -1
        before[starts[full]] = -1
        live = np.ones(n, dtype=bool)
        pair = np.full(n, -1, dtype=np.int64)
        left = np.flatnonzero(after >= 0)
        pair[left] = self._ranks(sym[left], sym[left + 1])
        queue = SharedQueue(self.size)
        queue.push(pair[left], left)
        while (got := queue.pop()) is not None:
            rank, at = got
            at = at[pair[at] == rank]
            if len(at) == 0:
                continue
            if len(at) > 1:
                at = np.unique(at)
                own = owner[at]
                first = np.ones(len(at), dtype=bool)
                np.not_equal(own[1:], own[:-1], out=first[1:])
                if not first.all():
                    queue.add(rank, at[~first])
                    at = at[first]
            gone = after[at]
            then = after[gone]
            sym[at] = rank
            live[gone] = False
            pair[gone] = -1
            after[at] = then
            pair[at] = -1
            has = then >= 0
            a, then = at[has], then[has]
            before[then] = a
            right = self._ranks(sym[a], sym[then])
            pair[a] = right
            prior = before[at]
            b = prior[prior >= 0]
            new = self._ranks(sym[b], sym[at[prior >= 0]])
            pair[b] = new
            queue.push(np.concatenate((right, new)), np.concatenate((a, b)))
        kept = np.flatnonzero(live)
        bounds = [0, *(4 * np.cumsum(np.bincount(owner[kept], minlength=len(pretokens)))).tolist()]
        data = sym[kept].astype("<u4").tobytes()
        return [data[i:j] for i, j in zip(bounds, bounds[1:])]

    def merge_alone(self, pretoken: bytes) -> bytes:
        """The same for one pre-token of any length."""
        queue, rank_of, size = LongQueue(self.size), self.pairs.get, self.size
        sym = self.bytes[np.frombuffer(pretoken, dtype=np.uint8)].tolist()
        n = len(sym)
        pair = [rank_of(a * size + b, -1) for a, b in zip(sym, sym[1:])] + [-1]
        for at, rank in enumerate(pair):
            if rank >= 0:
                queue.push(rank, at)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (got := queue.pop()) is not None:
            rank, at = got
            if pair[at] != rank:
                continue  # stale
            gone = after[at]
            then = after[gone]
            sym[at], sym[gone], pair[gone], pair[at], after[at] = rank, -1, -1, -1, then
            if then < n:
                before[then] = at
                pair[at] = rank_of(rank * size + sym[then], -1)
                if pair[at] >= 0:
                    queue.push(pair[at], at)
            prior = before[at]
            if prior >= 0:
                pair[prior] = rank_of(sym[prior] * size + rank, -1)
                if pair[prior] >= 0:
                    queue.push(pair[prior], prior)
        return np.array([s for s in sym if s >= 0], dtype="<u4").tobytes()

    def _learn(self, pretokens: set[str]) -> None:
        """Encodes what is not remembered. What one call asks for is held in any case."""
        if self.held > CACHE_BYTES:
            self.forget()
        new = [p for p in pretokens if p not in self.known]
        raw = [p.encode() for p in new]
        ids = [None if (whole := self.ranks.get(r)) is None else whole.to_bytes(4, "little") for r in raw]
        short = [k for k, r in enumerate(raw) if ids[k] is None and len(r) <= SHORT]
        for k, x in zip(short, self.merge_together([raw[k] for k in short])):
            ids[k] = x
        ids = [self.merge_alone(r) if x is None else x for r, x in zip(raw, ids)]
        self.known.update(zip(new, ids))
        self.held += sum(map(len, raw)) + sum(map(len, ids)) + ENTRY_BYTES * len(new)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each text, its matches of the pattern encoded one by one, as little-endian unsigned 32-bit integers."""
        matches = [self.pattern.findall(p) for p in pieces]
        self._learn({m for found in matches for m in found})
        known = self.known
        return [b"".join([known[m] for m in found]) for found in matches]

    def decode_flat(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of many ids."""
        counts = self.token_sizes[ids]
        total = np.cumsum(counts)
        return self.token_bytes[np.arange(int(total[-1]) if len(ids) else 0) + np.repeat(self.token_starts[ids] - (total - counts), counts)]


_loaded: dict[tuple[str, str], ByteBPE] = {}


def load(path: str, pattern: str) -> ByteBPE:
    """One encoder for each worker and file."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def byte_bpe(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Token counts, digests of the ids and of the decoded bytes, for each document.

    ranks: the place of a rank file, the same on all workers. Null text is empty: no tokens, and
    the digest of no bytes. Any doc_id, null or repeated, is returned as often as it comes in; other
    columns are not read. What is remembered of earlier texts is found by comparing all its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(ranks, pattern)
        for batch in batches:
            buf, offsets = flat(batch.column(1))
            for a, b in chunks(offsets, PART_BYTES):
                ids, bounds = coder.table.encode(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                raw = ids.astype("<u4", copy=False).tobytes()
                decoded = coder.decode_flat(ids).tobytes()
                ends = np.concatenate(([0], np.cumsum(coder.token_sizes[ids])))[bounds].tolist()
                cut = (4 * bounds).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(cut, cut[1:])], pa.string()),
                        pa.array([hashlib.sha256(decoded[i:j]).hexdigest() for i, j in zip(ends, ends[1:])], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), run, BYTES)
