"""Encoding of whole texts through a table of pieces met before.

The byte-level patterns in use start a match at each single space between two characters that are
no white space, and at punctuation after an ASCII letter or digit; no special token holds a space
or the punctuation that is looked for. The text between such places can thus be encoded alone. Pieces are found by vector code and looked up by a hash; then all their bytes are
compared with those of the piece found, so the hash decides nothing. The coder behind the table
sees each distinct piece once until the table is full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import RollingHash, byte_table, mix

#: Bytes that the table of a worker takes before it starts again; and of the numbers about one piece.
TABLE_BYTES = 48 << 20
ENTRY_BYTES = 40
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_ALNUM = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?()[]{}\"/=&")] = True


def _wide_space(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether bytes a b c begin with a white-space character beyond ASCII, or might."""
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    e2 = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8B) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & ((c == 0x9F) | (c == 0xA0))))
    return two | e2 | ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | (a == 0xEF)


def cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all pieces: the texts that are not empty, and the places that always start a match."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(buf == 32)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    at = at[(at > 0) & (at < n - 1)]
    at = at[~first[at] & ~first[at + 1] & ~_SPACE[buf[at - 1]] & ~_SPACE[buf[at + 1]]]
    odd = np.flatnonzero((buf[at - 1] >= 0x80) | (buf[at + 1] >= 0x80))
    if len(odd):
        pad = np.concatenate((np.zeros(3, np.uint8), buf, np.zeros(3, np.uint8)))
        i = at[odd] + 3
        bad = _wide_space(pad[i + 1], pad[i + 2], pad[i + 3])
        bad |= _wide_space(pad[i - 3], pad[i - 2], pad[i - 1])
        bad |= (pad[i - 2] == 0xC2) & ((pad[i - 1] == 0x85) | (pad[i - 1] == 0xA0))
        keep = np.ones(len(at), dtype=bool)
        keep[odd[bad]] = False
        at = at[keep]
    begins = first[:n]
    begins[1:] |= _ALNUM[buf[:-1]] & _MARK[buf[1:]]
    begins[at] = True
    return np.flatnonzero(begins)


class PieceTable:
    """Ids of pieces, by their bytes. coder: gives the ids of each of some pieces, as 32-bit integers."""

    def __init__(self, coder: Callable[[list[str]], list[bytes]]) -> None:
        self.coder = coder
        self.clear()

    def clear(self) -> None:
        self.names = np.zeros(0, dtype=np.uint64)
        self.where = np.zeros((4, 0), dtype=np.int64)  # start and number of ids, start and number of bytes
        self.pool = np.zeros(0, dtype=np.uint32)
        self.raw = np.zeros(0, dtype=np.uint8)

    def held(self) -> int:
        return ENTRY_BYTES * len(self.names) + self.pool.nbytes + self.raw.nbytes

    def _add(self, names: np.ndarray, pieces: list[bytes]) -> None:
        ids = self.coder([p.decode() for p in pieces])
        counts, sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64), np.array([len(p) for p in pieces], dtype=np.int64)
        own = np.stack((len(self.pool) + np.cumsum(counts) - counts, counts, len(self.raw) + np.cumsum(sizes) - sizes, sizes))
        self.pool = np.concatenate((self.pool, np.frombuffer(b"".join(ids), dtype="<u4")))
        self.raw = np.concatenate((self.raw, np.frombuffer(b"".join(pieces), dtype=np.uint8)))
        at = np.searchsorted(self.names, names)
        self.names, self.where = np.insert(self.names, at, names), np.insert(self.where, at, own, axis=1)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and n + 1 bounds of the texts in them."""
        begin = cuts(buf, offsets)
        if len(begin) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        end = np.append(begin[1:], len(buf))
        hashes = mix(RollingHash(buf).slices(begin, end))
        names, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if self.held() > TABLE_BYTES:
            self.clear()
        known = np.isin(names, self.names, assume_unique=True)
        if not known.all():
            new = np.flatnonzero(~known)
            data = buf.tobytes()
            self._add(names[new], [data[i:j] for i, j in zip(begin[where[new]].tolist(), end[where[new]].tolist())])
        starts, counts, raw, sizes = self.where[:, np.searchsorted(self.names, names)[back]]
        pool, odd = self.pool, np.flatnonzero(sizes != end - begin)
        # the pieces tile the buffer, so its bytes are compared as they lie
        at = np.minimum(np.arange(len(buf)) + np.repeat(raw - begin, end - begin), len(self.raw) - 1)
        unlike = np.flatnonzero(self.raw[at] != buf)
        if len(odd) or len(unlike):  # pieces of one hash: those that the table does not hold are encoded apart
            odd = np.union1d(odd, np.searchsorted(begin, unlike, side="right") - 1)
            data = buf.tobytes()
            apart = self.coder([data[i:j].decode() for i, j in zip(begin[odd].tolist(), end[odd].tolist())])
            counts[odd] = [len(x) // 4 for x in apart]
            starts[odd] = len(pool) + np.cumsum(counts[odd]) - counts[odd]
            pool = np.concatenate((pool, np.frombuffer(b"".join(apart), dtype="<u4")))
        total = np.cumsum(counts)
        ids = pool[np.arange(int(total[-1])) + np.repeat(starts - (total - counts), counts)]
        bounds = np.concatenate(([0], total))[np.searchsorted(begin, offsets)]
        return ids, bounds
