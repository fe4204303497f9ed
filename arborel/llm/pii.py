"""Personal data by patterns, and terms that reveal it by information-theoretic sanitisation.

The patterns give the protected entities. A term near an entity reveals it as far as the corpus
binds the two: with document counts n and N documents, PMI(t, e) = log2(N n(t, e) / (n(t) n(e))) of
the information IC(e) = log2(N / n(e)) that the entity holds. A term with PMI >= ALPHA * IC, met
with the entity in at least SUPPORT different texts, is generalised where it stands near it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, chunks, cut, flat, mapped, unlike
from .decontam import word_hashes

KINDS = ("email", "ip", "card", "phone", "term")
ALPHA = 0.8
SUPPORT = 3
#: Words on either side of an entity that count as near.
NEAR = 5
LEAST_LETTERS = 3
BITMAP_BITS = 20
#: Counts of terms that a task holds before it adds them up.
HELD_TERMS = 500_000
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
#: A match can only begin where a run of digits begins and takes whole runs, so no run is tried more than once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
SCHEMA = (
    "doc_id long, key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string,"
    " near array<struct<entity:long,term:long,start:int,end:int>>"
)
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each @ is tried once, with the longest local part that no earlier match holds."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches that pass their checks, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def entity_id(kind: int, value: str) -> int:
    plain = value.lower() if kind < 2 else NOT_DIGIT.sub("", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


def near_terms(text: str, spans: list[tuple[int, int, int]], near: int) -> list[dict]:
    """The words within so many words of each entity that no entity covers."""
    raw = text.encode("utf-8", "surrogatepass")
    buf = np.frombuffer(raw, dtype=np.uint8)
    starts, ends, hashes = word_hashes(buf, np.array([0, len(buf)]))
    chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    begin, stop = chars[starts], chars[ends]
    covered = np.zeros(len(starts), dtype=bool)
    for a, _, b in spans:
        covered[np.searchsorted(stop, a, side="right") : np.searchsorted(begin, b)] = True
    usable = ~covered & (stop - begin >= LEAST_LETTERS)
    out = []
    for a, k, b in spans:
        i, j = int(np.searchsorted(stop, a, side="right")), int(np.searchsorted(begin, b))
        entity = entity_id(k, text[a:b])
        for w in (*range(max(0, i - near), i), *range(j, min(len(starts), j + near))):
            if usable[w]:
                out.append({"entity": entity, "term": int(hashes[w].view(np.int64)), "start": int(begin[w]), "end": int(stop[w])})
    return out


def _scan(docs: DataFrame, near: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column(2).to_pylist()
                counts = np.zeros((4, len(texts)), dtype=np.int64)
                base, digests, terms = [], [], []
                for i, text in enumerate(texts):
                    spans = base_spans(text) if text else []
                    for _, k, _ in spans:
                        counts[k, i] += 1
                    base.append(joined(spans))
                    digests.append(hashlib.sha256(base[-1].encode()).hexdigest())
                    terms.append(near_terms(text, spans, near) if spans else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c) for c in counts), pa.array(digests, pa.string()), pa.array(base, pa.string()), pa.array(terms, pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])))],
                    names=["doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "near"],
                )

    return mapped(docs.select("doc_id", "key", "text"), run, SCHEMA)


def _document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_t): documents with each term, over all documents. A broadcast bitmap of fixed size thins the words first."""
    bits = np.zeros(1 << BITMAP_BITS, dtype=bool)
    for row in terms.select(F.shiftrightunsigned("term", 64 - BITMAP_BITS).alias("cell")).distinct().toLocalIterator():
        bits[row["cell"]] = True
    bitmap = docs.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bitmap.value, dtype=np.uint8)).astype(bool)
        terms, counts, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            """What the task has counted so far, each term once."""
            term, back = np.unique(np.concatenate(terms), return_inverse=True)
            return term, np.bincount(back, weights=np.concatenate(counts), minlength=len(term)).astype(np.int64)

        def told(term: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], names=["term", "n"])

        for batch in batches:
            buf, offsets = flat(batch.column(0))
            for a, b in chunks(offsets):
                own = offsets[a : b + 1] - offsets[a]
                starts, _, hashes = word_hashes(buf[offsets[a] : offsets[b]], own)
                keep = wanted[(hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)]
                hashes, doc = hashes[keep], np.searchsorted(own, starts[keep], side="right") - 1
                order = np.lexsort((doc, hashes))
                hashes, doc = hashes[order], doc[order]
                if len(hashes) == 0:
                    continue
                first = np.ones(len(hashes), dtype=bool)
                first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
                term, n = np.unique(hashes[first], return_counts=True)
                terms.append(term)
                counts.append(n)
                held += len(term)
                if held > HELD_TERMS:
                    term, n = summed()
                    if len(term) > HELD_TERMS // 2:
                        yield told(term, n)
                        term, n = term[:0], n[:0]
                    terms, counts, held = [term], [n], len(term)
        yield told(*summed())

    return mapped(docs.select("text"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def _revealing(spark: SparkSession, docs: DataFrame, scanned: DataFrame, alpha: float, support: int) -> DataFrame:
    """(key, terms): places of the terms to generalise, in each text that has some."""
    met = scanned.select("key", F.explode("near").alias("x")).select("key", "x.*")
    total = float(max(scanned.count(), 1))
    pairs = met.select("key", "entity", "term").groupBy("entity", "term", "key").agg(F.lit(1).alias("one")).groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support)
    pairs = cut(spark, pairs)
    n_e = met.select("key", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    weighed = pairs.join(_document_counts(docs, pairs), "term").join(n_e, "entity")
    information = F.log2(F.lit(total) / F.col("n_e"))
    pmi = F.log2(F.lit(total) * F.col("n_te") / (F.greatest("n_t", "n_te") * F.col("n_e")))
    strong = cut(spark, weighed.where((information > 0) & (pmi >= alpha * information)).select("entity", "term"))
    found = met.join(broadcast_if_small(strong, strong.count()), ["entity", "term"])
    return found.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("terms"))


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", _key())


def find_pii(spark: SparkSession, docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, near: int = NEAR) -> DataFrame:
    """Counts and digest of the pattern matches, and all spans with the revealing terms, for each document.

    Spans are in code points, the end exclusive. Null and empty texts have none: zero counts, the
    digest of '' and spans ''. Rows come out as often as they come in; equal texts under equal ids
    count once as evidence.
    """
    docs = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    scanned = cut(spark, _scan(docs, near))
    terms = cut(spark, _revealing(spark, docs, scanned, alpha, support))
    out = scanned.drop("near").join(broadcast_if_small(terms, terms.count()), "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for base, found in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist()):
                own = [(int(a), KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in base.split(",") if x)]
                own += [(x["start"], 4, x["end"]) for x in found or ()]
                spans.append(joined(sorted(own)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(spans, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    out = out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "terms")
    return mapped(out, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def sanitise(spark: SparkSession, docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, near: int = NEAR) -> DataFrame:
    """The documents with each span replaced by its kind in brackets, such as [EMAIL]; other columns stay, n_chars follows the text.

    Overlapping matches are replaced together, named after the first. Null and empty texts stay as they are.
    """
    key, found = unlike(docs.columns, "key"), unlike(docs.columns, "terms")
    plain = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    terms = cut(spark, _revealing(spark, plain, cut(spark, _scan(plain, near)), alpha, support)).select(F.col("key").alias(key), F.col("terms").alias(found))
    wide = docs.withColumn(key, _key()).join(broadcast_if_small(terms, terms.count()), key, "left").select(*docs.columns, found)
    at, names = docs.columns.index("text"), docs.columns
    sized = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = batch.column(at).to_pylist(), set()
            for i, (text, found) in enumerate(zip(texts, batch.column(batch.num_columns - 1).to_pylist())):
                spans = sorted([*(base_spans(text) if text else ()), *((x["start"], 4, x["end"]) for x in found or ())])
                if not spans:
                    continue
                parts, done = [], 0
                for a, k, b in spans:
                    if a >= done:
                        parts += [text[done:a], f"[{KINDS[k].upper()}]"]
                    done = max(done, b)
                texts[i] = "".join(parts) + text[done:]
                changed.add(i)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if sized is not None:
                sizes = batch.column(sized).to_pylist()
                columns[sized] = pa.array([len(texts[i]) if i in changed else sizes[i] for i in range(len(texts))], batch.schema.field(sized).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return mapped(wide, run, docs.schema)
