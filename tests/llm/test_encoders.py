"""Byte BPE against tiktoken, and shards against the tokenizers library, with exact round trips."""

import base64
import hashlib
import io
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from arborel.llm import bpe, pieces, sstable
from arborel.llm.common import flat
from tokenizers import Tokenizer

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "", "a", " a", "  a b\n\n c 's don't 123abc  ", "aaaa" * 300, "x" * 3000 + " \t y", "日本 語テキスト　全角 é̀ 🎉🎉", None, "hello world\n", "  ", "\n", " lead",
    "a  b", "x　 y z   q", "é à è la", "a\x1c b \x1f c", "tab\t x  y \n z", "one one one", "one one one",
]


def plain_ranks():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, "no id", "clash"), (3, "again", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_byte_bpe(docs):
    plain = plain_ranks()
    want = []
    for row in docs.collect():
        raw = np.array(plain.encode_ordinary(row["text"] or ""), dtype="<u4").tobytes()
        want.append((row["doc_id"], len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256((row["text"] or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.byte_bpe(docs, RANKS, P.PATTERN).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_rank_queue_order():
    queue = bpe.SharedQueue(50_000)
    queue.push(np.array([40_000, 7, 7, -1, 5000]), np.arange(5))
    assert [(r, p.tolist()) for r, p in (queue.pop(), queue.pop(), queue.pop())] == [(7, [1, 2]), (5000, [4]), (40_000, [0])]
    assert queue.pop() is None
    queue = bpe.LongQueue(50_000)
    for position, rank in enumerate([40_000, 7, 5000]):
        queue.push(rank, position)
    queue.push(7, 0)
    assert [queue.pop() for _ in range(5)] == [(7, 0), (7, 1), (5000, 2), (40_000, 0), None]
    assert not queue.bits.top and not any(queue.bits.low) and not any(queue.bits.mid) and not queue.buckets


def ids_of(table, texts):
    ids, bounds = table.encode(*flat(pa.array(texts, pa.string())))
    return [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:])]


def both_tables():
    """Each table with the plain encoder that it must equal."""
    own, plain = Tokenizer.from_file(P.path("byte_bpe_50k.json")), plain_ranks()
    yield sstable.Coder(P.path("byte_bpe_50k.json")).table, lambda t: own.encode(t, add_special_tokens=False).ids
    yield bpe.ByteBPE(RANKS, P.PATTERN).table, plain.encode_ordinary


def test_words_that_mirror_each_other():
    """The Thue-Morse word and its complement, which polynomial hashes of bytes cannot tell apart."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(1024))
    texts = [word, word.translate(str.maketrans("ab", "ba")), f"x {word}"]
    for table, plain in both_tables():
        assert ids_of(table, texts) == [plain(t) for t in texts]


@pytest.mark.parametrize("hashes", [1, 2, 50])
def test_pieces_of_equal_hashes(monkeypatch, hashes):
    """Pieces are told by their bytes: the ids are right whatever the hash gives."""
    monkeypatch.setattr(pieces, "mix", lambda x: x % np.uint64(hashes))
    for table, plain in both_tables():
        for _ in range(2):
            assert ids_of(table, TEXTS) == [plain(t or "") for t in TEXTS]


def test_any_texts():
    """Spaces of all kinds, contractions, special tokens and letters of many scripts, through both tables."""
    rng = random.Random(6)
    texts = ["".join(rng.choice(alphabet) for _ in range(300)) for alphabet in ("ab  é1.,\n", "日本語の　x ", "don't we'll 12  ", "a\x1c\x85 \u2003b", "🎉 é̀ x") for _ in range(8)]
    texts += ["a <|endoftext|> b", "x<|endoftext|>y", "<|endoftext|>"]
    for table, plain in both_tables():
        assert ids_of(table, texts) == [plain(t) for t in texts]


def test_long_pretokens_take_few_steps():
    """A quadratic queue would take minutes on these."""
    coder, plain = bpe.ByteBPE(RANKS, P.PATTERN), plain_ranks()
    rng = random.Random(5)
    for text in ("a" * 1_000_000, "".join(rng.choice("abcde") for _ in range(200_000))):
        began = time.perf_counter()
        got = ids_of(coder.table, [text])
        assert time.perf_counter() - began < 30
        assert got == [plain.encode_ordinary(text)]


def test_long_and_short_queues_agree():
    coder, rng = bpe.ByteBPE(RANKS, P.PATTERN), random.Random(8)
    pretokens = ["".join(rng.choice("abn日é") for _ in range(rng.randint(1, 90))).encode() for _ in range(300)]
    assert coder.merge_together(pretokens) == [coder.merge_alone(p) for p in pretokens]


def test_memory_is_bound_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 5000)
    monkeypatch.setattr(pieces, "TABLE_BYTES", 5000)
    coder, plain = bpe.ByteBPE(RANKS, P.PATTERN), plain_ranks()
    for k in range(0, 400, 10):
        text = " ".join(f"w{k + i}xyz" for i in range(10))
        assert ids_of(coder.table, [text]) == [plain.encode_ordinary(text)]
        assert coder.held < 10_000 and coder.table.held() < 10_000


def test_empty_table(docs):
    assert bpe.byte_bpe(docs.limit(0), RANKS, P.PATTERN).count() == 0
    assert sstable.token_shards(docs.sparkSession, docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_shards(spark, docs):
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    got = sorted((tuple(r) for r in sstable.token_shards(spark, docs, P.path("byte_bpe_50k.json")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [r["doc_id"] for r in rows]
    start = 0
    crcs = {}
    for r in rows:
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        crcs.setdefault(r["doc_id"], set()).add((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    for doc_id, at, n, crc in got:
        assert at == start and (n, crc) in crcs[doc_id]
        start += n


def test_lookup_in_one_shard():
    file = io.BytesIO()
    own = sstable.Writer(file)
    docs = [None, None, -5, 0, *range(10, 4000, 3)]
    seen = {}
    for d in docs:
        row = seen[d] = seen.get(d, -1) + 1
        own.add(sstable.key_of(d, row), np.arange((d or 1) % 50 + 1, dtype=np.uint32) * (70_000 if d == 0 else 1))
    own.close()
    reader = sstable.Reader(file)
    assert len(reader.places) > 1
    for d in docs:
        found = reader.get(d)
        assert len(found) == seen[d] + 1 and len(found[0]) == (d or 1) % 50 + 1
    assert reader.get(11) == [] and reader.get(10**9) == []
    file.getbuffer()[-sstable.FOOTER.size - 3] ^= 1
    with pytest.raises(ValueError):
        sstable.Reader(file)
