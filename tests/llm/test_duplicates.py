"""Decontamination, Jaccard join and suffix dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from arborel.llm import decontam, jaccard, suffix_dedup

rng = random.Random(11)
WORDS = [f"w{k}" for k in range(60)]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [text(rng.randint(1, 60)) for _ in range(40)]
    out = list(base)
    for t in base[:20]:  # near copies of all degrees
        w = t.split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w))
    hot = text(50).split()
    for k in range(30):  # one large group of near copies, and copies
        own = list(hot)
        own[rng.randrange(50)] = f"z{k}"
        out.append(" ".join(own))
    out += [out[0]] * 5 + ["", "  \n", None, "A", "a", "One two", "one TWO"]
    return [(None if k == 7 else 5 if k == 9 else k, t) for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")


def brute_components(rows):
    def sets(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    s = [sets(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s[i]), least.get(find(i)) if s[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("leaf", "direct", "pivots"), [(2, 1 << 16, 4), (8, 1 << 16, 4), (2, 0, 2)])
def test_jaccard(spark, docs, rows, leaf, direct, pivots, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "DIRECT", direct)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    got = sorted((tuple(r) for r in jaccard.jaccard_components(spark, docs).collect()), key=repr)
    assert got == brute_components(rows)


def test_jaccard_longer_pivots(spark):
    """Near copies whose regions have longer texts as pivots, so that no distance of theirs is known."""
    own = random.Random(23)
    groups = []
    for g in range(12):
        passage = [f"w{own.randrange(60)}" for _ in range(44)]
        group = [" ".join(passage[:-1] + [f"end{g}x{k}"]) for k in range(2)]
        group += [" ".join(passage + [f"w{own.randrange(60)}" for _ in range(60)]) for _ in range(8)]
        groups.append(group)
    # members of a group lie apart, so that no task finds their shingles often
    rows = list(enumerate(group[k] for k in range(10) for group in groups))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.jaccard_components(spark, docs).collect()), key=repr)
    assert got == brute_components(rows)
    assert sum(c != d for d, _, c in got) == 12


def test_marks_never_exceed_the_difference():
    """A mark tells at most the elements that two sets do not share, whatever their sizes."""
    own = np.random.default_rng(6)
    sets = [np.unique(own.integers(0, 4000, k).astype(np.uint64)) for k in (0, 1, 5, 300, 600, 3000, 9000)]
    sets.append(sets[3][:-7])
    for p in sets:
        for q in sets:
            assert jaccard.apart(jaccard.mark(p), jaccard.mark(q)) <= len(np.setxor1d(p, q))
    assert jaccard.apart(jaccard.mark(sets[3]), jaccard.mark(sets[-1])) > 0


def test_cells_split_far_groups(spark, monkeypatch):
    """One shingle in all texts, which are else of three far groups: the region goes into cells, and no link is lost."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(jaccard, "PIVOTS", 6)
    own = random.Random(31)
    rows = []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(200)]
        for _ in range(25):
            other = list(base)
            for _ in range(own.randint(2, 5)):
                other[own.randrange(200)] = f"x{own.randrange(10**6)}"
            rows.append((len(rows), "one two three four five " + " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scanned = jaccard.cut(spark, jaccard._scan(docs, 5)).where("kind = 0")
    reps = jaccard.cut(spark, scanned.select("sig", "doc_id", F.col("n").alias("size"), "mark"))
    links = jaccard.Links(spark, docs, reps, 5, jaccard.SIMILAR)
    members = reps.select(F.lit(1).cast("long").alias("key"), "sig", F.col("size").alias("n"), F.lit(0).cast("long").alias("place"))
    cells, whole = jaccard._cells(jaccard._open(members.withColumn("home", F.lit(True)), links), links, 0)
    assert cells.select("key").distinct().count() > 1 and whole.isEmpty()
    monkeypatch.setattr(jaccard, "DIRECT", 100)
    monkeypatch.setattr(jaccard, "LEVELS", 2)
    jaccard._join_regions(members, links)
    root = {r["v"]: r["root"] for r in links.roots.collect()}
    of = {r["doc_id"]: root.get(r["sig"], r["sig"]) for r in reps.collect()}
    want = {}
    for d, _, c in brute_components(rows):
        want.setdefault(c, set()).add(d)
    got = {}
    for d, c in of.items():
        got.setdefault(c, set()).add(d)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_large_sets_by_whole_hashes():
    """Elements that agree in 40 bits are not shared by sets large enough for that to happen."""
    own = np.random.default_rng(5)
    large = np.unique(own.integers(0, 1 << 63, 20_000, dtype=np.uint64) << np.uint64(1))
    other = large.copy()
    other[:100] ^= np.uint64(1)
    assert jaccard.shared(jaccard.pack(large), jaccard.pack(other)) == (len(large), len(large), len(large) - 100)
    small = large[::10]
    assert jaccard.shared(jaccard.pack(small), jaccard.pack(small[:500])) == (len(small), 500, 500)
    assert jaccard.shared(jaccard.pack(large), jaccard.pack(small)) == (len(large), len(small), len(small))


def test_one_of_each(spark, docs, rows):
    kept = jaccard.one_of_each(spark, docs)
    assert kept.columns == docs.columns
    want = {(d, c) for d, n, c in brute_components(rows) if n and d == c}
    got = [r for r in kept.collect() if (r["text"] or "").strip()]
    assert {r["doc_id"] for r in got} == {d for d, _ in want}
    assert sum(1 for r in kept.collect() if not (r["text"] or "").strip()) == 3
    texts = {d: t for d, t in rows if d not in (None, 5)}
    assert all(r["text"] == texts[r["doc_id"]] for r in got if r["doc_id"] in texts)
    assert len([r for r in got if r["doc_id"] == 5]) == len({(d, t) for d, t in rows if d == 5} & {(5, r["text"]) for r in got})


def test_jaccard_empty(spark, docs):
    assert jaccard.jaccard_components(spark, docs.limit(0)).count() == 0


def brute_hits(rows, items):
    found = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = {}
    for name, t in items:
        w = found(lower(t))
        for k in range(max(len(w) - 9, min(len(w), 1))):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(name)
    out = []
    for d, t in rows:
        w, hit, names = found(lower(t)), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    names |= windows[tuple(w[k : k + size])]
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_decontamination(spark, docs, rows, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    items = [("1", rows[0][1]), ("2", " ".join(rows[3][1].split()[:12]).upper()), ("3", "w1 w2"), ("4", ""), ("5", None), ("1", rows[0][1]), ("6", "é w3!")]
    bench = spark.createDataFrame(items, "item_id string, text string").coalesce(1)
    assert (len(decontam.phrase_blocks(spark, bench, 10).value.names) > 3) == (block == 40)
    got = sorted((tuple(r) for r in decontam.decontaminate(spark, docs, bench).collect()), key=repr)
    assert got == brute_hits(rows, [(n, t or "") for n, t in items])
    cleaned = decontam.without_spans(spark, docs, bench)
    assert cleaned.count() == docs.count() and cleaned.columns == docs.columns
    clean = {d for d, _, n, *_ in got if not n}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in cleaned.collect():
        if r["doc_id"] in clean and r["doc_id"] not in (None, 5):
            assert r["text"] == texts[r["doc_id"]]
    assert decontam.decontaminate(spark, docs, bench.limit(0)).where("contaminated").count() == 0


def brute_removed(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for (d, _), b in zip(rows, raw):
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if covered[i] and (i == 0 or not covered[i - 1]))
        out.append((d, len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [8192, 2])
def test_suffix_dedup(spark, docs, rows, group):
    more = [(900, "ab" * 200), (900, "ab" * 200), (901, "x" * 39), (902, "y" * 300), (903, "q" * 20 + rows[2][1] + "r" * 30)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted((tuple(r) for r in suffix_dedup.suffix_dedup(spark, table, 40, 12, group).collect()), key=repr)
    assert got == brute_removed(rows + more, 40)


def test_suffix_dedup_with_production_sizes(spark):
    """Passages about the length looked for, within and across texts, of bytes of all kinds, and texts of one period."""
    own = random.Random(17)
    prose = lambda n: "".join(own.choice("abcdefgh é日 ") for _ in range(n))
    cut_to = lambda t, n: t.encode()[:n].decode("utf-8", "ignore")
    base = [prose(900) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(base)]
    for size in (398, 399, 400, 401, 402, 650):
        rows.append((len(rows), prose(150) + cut_to(base[size % 6][30:], size) + prose(200)))
    rows.append((len(rows), base[0] + base[1][:500] + base[0][100:]))  # the same text again within one
    rows += [(100, "ab" * 700), (101, "x" * 399), (102, "y" * 401), (103, "abcab" * 120 + "z" + "abcab" * 120), (104, base[2]), (104, base[2]), (None, base[3] + "!"), (105, ""), (106, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.suffix_dedup(spark, docs).collect()), key=repr)
    want = brute_removed(rows, 400)
    assert got == want
    assert sum(r[2] > 0 for r in want) > 10


def test_suffix_dedup_does_not_depend_on_the_chunk(spark):
    """A passage in a text of some MB is met again in a short one."""
    own = random.Random(19)
    passage, filler = "".join(own.choice("abcdef ") for _ in range(700)), "".join(chr(97 + own.randrange(26)) for _ in range(2_500_000))
    rows = [(1, filler[:1_700_000] + passage + filler[1_700_000:]), (2, "start " + passage + " end")]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.suffix_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (700, 1), 2: (700, 1)}


def test_suffix_dedup_empty(spark, docs):
    assert suffix_dedup.suffix_dedup(spark, docs.limit(0)).count() == 0


def test_often_over_many_tasks(spark):
    """A passage that each task meets a few times, and all together often, goes to the end of the order: no region holds all its documents."""
    own = random.Random(47)
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(k, " ".join(f"d{k}x{i}" for i in range(80)) + " " + passage) for k in range(120)]
    own.shuffle(rows)
    rows.append((120, rows[0][1] + " more"))
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 100), "doc_id long, text string")
    scanned = jaccard.cut(spark, jaccard._scan(docs, 5))
    assert scanned.where("kind = 1").isEmpty()  # no task alone tells it
    regions = jaccard._regions(docs, jaccard._levels(spark, scanned), 5, jaccard.SIMILAR)
    assert regions.groupBy("key").count().agg({"count": "max"}).first()[0] <= 3
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark, docs).collect()}
    least = min(120, rows[0][0])
    assert got == {d: least if d in (120, rows[0][0]) else d for d, _ in rows}


def test_pairs_in_rounds(spark, docs, rows, monkeypatch):
    """Sets are sent for a bounded number of pairs at a time, and no link is lost."""
    sent, measure = [], jaccard._measure
    monkeypatch.setattr(jaccard, "AT_ONCE", 1)
    monkeypatch.setattr(jaccard, "_measure", lambda pairs, sets: sent.append(pairs.count()) or measure(pairs, sets))
    got = sorted((tuple(r) for r in jaccard.jaccard_components(spark, docs).collect()), key=repr)
    assert got == brute_components(rows)
    assert len(sent) > 1 and max(sent) <= len(rows)
