"""Classifiers by held-out accuracy; fingerprints, personal data and URLs against plain versions."""

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from arborel.llm import fingerprint, langid, pii, toxicity, urls
from arborel.llm.common import flat
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_more_languages_than_ten_thousand(spark):
    rows = spark.range(16_000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    want = {f"l{k}" for k in range(16_000) if zlib.crc32(str(k).encode()) % 3 != 1}
    assert len(want) > 10_000 and set(langid.fit(rows).languages) == want


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


ODD = [(10_001, None, None), (10_002, "", "en"), (10_003, "12 34 !!", "en"), (None, "no id here", "en")]


def odd(spark):
    return spark.createDataFrame([(d, t, lang, "x") for d, t, lang in ODD], "doc_id long, text string, lang string, score string")


def test_language(spark, table):
    some = table.where("doc_id < 1500").select("doc_id", "text", "lang").withColumn("score", F.lit("x")).unionByName(odd(spark))
    got = langid.language_id(spark, some, rows=200).collect()
    assert len(got) == some.count()
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[d]["lang_pred"] for d in (10_001, 10_002, 10_003)] == ["und"] * 3
    langs = {r["doc_id"]: r["lang"] for r in some.collect()}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held if r["doc_id"] < 10_000) / len(held) > 0.98
    assert langid.language_id(spark, some.limit(0)).count() == 0


def test_rank_profiles_by_plain_counting():
    text = "abab ab c"
    doc, gram, rank = langid.ranked([text])
    plain = {}
    padded = " abab ab c "
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            inner = g if n == 1 else g[1] if n == 3 else g.strip()
            if inner.strip():
                code = 0
                for ch in g:
                    code = code << 16 | (1 if ch == " " else ord(ch))
                plain[code] = plain.get(code, 0) + 1
    want = sorted(plain, key=lambda g: (-plain[g], g))
    assert [g for g, _ in sorted(zip(gram.tolist(), rank.tolist()), key=lambda x: x[1])] == want


def plain_subwords(text):
    """(subword, its weight) by the docstring: words of letters and digits, their 3- and 5-grams with boundaries, and the words themselves."""
    found = re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = []
    for w in found:
        grams = [("", w)] + [(size, f" {w} "[i : i + size]) for size in (3, 5) for i in range(len(w) + 3 - size)]
        out += [(g, 1 / len(grams) / (len(found) + toxicity.PAD)) for g in grams]
    return out


def test_subwords_by_plain_counting():
    """Each text has as many subwords, of the same weights, as plain slicing gives; equal ones fall into one bucket, and a misspelling shares some."""
    texts = ["An idiot, aN Idiot!", "é日本 x 42", "", None, "supercalifragilistic", "a-b_c", "id1ot idiot"]
    doc, bucket, weight = toxicity.bag(*flat(pa.array(texts, pa.string())))
    names = {}
    for k, t in enumerate(texts):
        plain = plain_subwords(t)
        mine = sorted(zip(weight[doc == k].round(12).tolist(), bucket[doc == k].tolist()))
        assert [w for w, _ in mine] == sorted(round(w, 12) for _, w in plain)
        by_gram, by_bucket = {}, {}
        for g, w in plain:
            by_gram[g] = by_gram.get(g, 0) + w
        for w, b in mine:
            by_bucket[b] = by_bucket.get(b, 0) + w
        assert sorted(by_gram.values()) == pytest.approx(sorted(by_bucket.values()))
        names[k] = set(by_bucket)
    assert names[0] & names[6]


def test_scores_by_a_plain_forward_pass():
    """The score is the softmax of the mean of the subwords' vectors; folding these into one number changes nothing."""
    own = random.Random(12)
    texts = [" ".join(own.choice(("bad", "worse", "nice", "good", "day", "night")) for _ in range(own.randint(3, 30))) for _ in range(80)]
    labels = [int("bad" in t.split()) for t in texts]
    model = toxicity.train(texts, labels)
    for t, score in zip(texts, model.scores(pa.array(texts, pa.string()))):
        doc, bucket, weight = toxicity.bag(*flat(pa.array([t], pa.string())))
        z = sum(float(model.fold[b]) * w for b, w in zip(bucket.tolist(), weight.tolist())) + model.bias
        assert score == pytest.approx(1 / (1 + math.exp(-z)))
    assert model.scores(pa.array([None, ""], pa.string())) == pytest.approx([1 / (1 + math.exp(-model.bias))] * 2)


def plain_grams(text):
    """1- to 3-grams of letters and of single gaps, those that hold a letter, or for 3 one in the middle."""
    line = " " + re.sub(r"[^\w]|[\d_]", " ", (text or "").lower())
    line = re.sub(" +", " ", line + " ")
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if (g[1] if n == 3 else g).strip():
                counts[g] = counts.get(g, 0) + 1
    code = lambda g: sum((1 if c == " " else ord(c)) << 16 * k for k, c in enumerate(reversed(g)))
    return sorted(counts, key=lambda g: (-counts[g], code(g))), counts


def test_language_by_plain_profiles(spark):
    """Profiles, distances, predictions and scores by dictionaries."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 260 and n_chars < 6000").collect()]
    rows += [(9001, "", "en"), (9002, None, "en"), (9003, "12 ... 3", "en"), (9004, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    most, totals = 400, {}
    for d, t, lang in rows:
        if lang is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            totals.setdefault(lang, []).append(t or "")
    profiles = {}
    for lang, texts in totals.items():
        counts = {}
        for t in texts:
            for g, c in plain_grams(t)[1].items():
                counts[g] = counts.get(g, 0) + c
        code = lambda g: sum((1 if c == " " else ord(c)) << 16 * k for k, c in enumerate(reversed(g)))
        profiles[lang] = {g: k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:most])}
    got = {r["doc_id"]: r for r in langid.language_id(spark, docs).collect()}
    for d, t, _ in rows:
        own = plain_grams(t)[0][:most]
        if not own:
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
            continue
        far = sorted((sum(abs(k - p[g]) if g in p else most for k, g in enumerate(own)), lang) for lang, p in profiles.items())
        assert got[d]["lang_pred"] == far[0][1], d
        assert got[d]["score"] == pytest.approx((far[1][0] - far[0][0]) / max(far[1][0], 1e-9))


def test_toxicity(spark, table):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    some = table.select("doc_id", "text").withColumn("lang", F.lit(None).cast("string")).withColumn("score", F.lit("x")).unionByName(odd(spark))
    got = {r["doc_id"]: r for r in toxicity.toxicity(spark, some, labels).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    held = [(r["toxic"], got[r["doc_id"]]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    bad, good = [g["score"] for t, g in held if t], [g["score"] for t, g in held if not t]
    assert sum(b > g for b in bad for g in good) / (len(bad) * len(good)) > 0.85
    assert sum(g >= 0.7 for g in good) / len(good) < 0.05
    none = toxicity.toxicity(spark, odd(spark), labels.limit(0))
    assert {r["predicted"] for r in none.collect()} == {0}
    assert toxicity.toxicity(spark, some.limit(0), labels).count() == 0
    kept = toxicity.keep_clean(spark, some, labels)
    assert kept.columns == some.columns and kept.count() == sum(r["predicted"] == 0 for r in toxicity.toxicity(spark, some, labels).collect())


def test_fingerprints(spark, table):
    rows = [(r["doc_id"], r["text"]) for r in table.where("doc_id < 60").select("doc_id", "text").collect()]
    rows += [(1000, None), (1001, ""), (1002, "short"), (1003, "short"), (None, "first"), (1004, "a" * 500), (1005, "é" * 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark, docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, changed, following = (fingerprint.chained(v) for _, v in fingerprint._features([t.encode(), edited.encode(), after.encode()]))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint.text_of(own), fingerprint.text_of(changed))
        assert r["near_edited"] == pytest.approx(fingerprint.likeness(own, changed)) and r["near_next"] == pytest.approx(fingerprint.likeness(own, following))
    assert got[1002]["near_next"] == 1.0 and got[1000]["near_next"] == 1.0
    assert fingerprint.fingerprints(spark, docs.limit(0)).count() == 0
    assert fingerprint.fingerprints(spark, docs.where("doc_id = 3")).first()["near_next"] == 1.0


def test_fingerprints_of_short_and_even_texts(spark):
    own = random.Random(6)
    prose = lambda size: " ".join("".join(own.choice("etaoinshrdlu") for _ in range(own.randint(2, 8))) for _ in range(size))[:size]
    rows = list(enumerate(prose(size) for size in range(100, 201)))
    even = ["a" * 150, "b" * 150, "a" * 99 + "c" + "a" * 99, "a" * 99 + "d" + "a" * 99, "abcdefgh" * 200, "hijklmno" * 200, "x" * 3000, prose(3000), "y" * 3000, "é" * 2000]
    rows += [(1000 + k, t) for k, t in enumerate(even)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark, docs).collect()}
    assert len(got) == len(rows)
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        r = got[d]
        assert r["fingerprint"] and r["edited_fingerprint"]
        assert r["near_next"] < 0.5, (d, len(t))  # one feature of 5 bits meets some of a full filter by chance
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert r["edited_fingerprint"] == fingerprint.text_of(fingerprint.chained(fingerprint._features([edited.encode()])[0][1]))
    assert len({r["fingerprint"] for r in got.values()}) == len(rows)
    assert any(got[d]["near_edited"] < 1.0 for d in range(27, 42))


def plain_features(raw):
    """Places of the features of a text of many windows, by counting each window and each stretch."""
    rank = {}
    for i in range(len(raw) - 63):
        counts = {}
        for b in raw[i : i + 64]:
            counts[b] = counts.get(b, 0) + 1
        e = int((6 - sum(c * math.log2(c) for c in counts.values()) / 64) * 1000 + 0.5) / 1000
        rank[i] = 1 << 20 if e < 1 else round(1000 * math.exp(-(((e - 4.2) / 0.35) ** 2) / 2))
    votes = {}
    for s in range(len(raw) - 126):
        best = min(range(s, s + 64), key=lambda i: (rank[i], i))
        if rank[best] < 1 << 20:
            votes[best] = votes.get(best, 0) + 1
    return sorted(i for i, n in votes.items() if n >= 16)


def plain_likeness(a, b):
    """Shared bits of each filter of the shorter chain with its best counterpart, less those of chance."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    score = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            chance, most = x.bit_count() * y.bit_count() / 2048, min(x.bit_count(), y.bit_count())
            score[i, j] = min(max(((x & y).bit_count() - chance) / max(most - chance, 1e-9), 0.0), 1.0)
    best = sum(max(score[i, j] for j in range(len(b))) for i in range(len(a))) / len(a)
    back = sum(max(score[i, j] for i in range(len(a))) for j in range(len(b))) / len(b)
    return best if len(a) < len(b) else (best + back) / 2


def test_fingerprints_by_plain_counting():
    own = random.Random(9)
    words = ["".join(own.choice("etaoinshrdluñé") for _ in range(own.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(own.choice(words) for _ in range(n)) + tail for n, tail in ((60, ""), (90, " 12345-6789 @@ {x: [1, 2]}"), (150, " AAAA BBBB"), (40, "\n\n---\n"))]
    texts.append(texts[1][:300] + texts[2][:200])
    chains = []
    for t in texts:
        raw = t.encode()
        doc, place, value = fingerprint.features(*flat(pa.array([raw], pa.binary())))
        assert place.tolist() == plain_features(raw)
        ints = []
        seen = list(dict.fromkeys(value.tolist()))
        for at in range(0, len(seen), fingerprint.FEATURES):
            bits = 0
            for h in seen[at : at + fingerprint.FEATURES]:
                for k in range(5):
                    bits |= 1 << 2047 - (h >> 11 * k & 2047)
            ints.append(bits)
        chain = fingerprint.chained(value)
        assert [int(x, 16) for x in fingerprint.text_of(chain).split(".")] == ints
        chains.append((chain, ints))
    for a, x in chains:
        for b, y in chains:
            assert fingerprint.likeness(a, b) == pytest.approx(plain_likeness(x, y))
    assert fingerprint.likeness(chains[1][0], chains[4][0]) > 0.3 > fingerprint.likeness(chains[0][0], chains[3][0])


def plain_spans(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15])


def test_base_spans(table):
    texts = [r["text"] for r in table.where("doc_id < 1500").collect()]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab1.@+- ()29") for _ in range(60)) for _ in range(2000)]
    texts += ["é a.b@x.com", "a@b.c@d.e@f.g", "1.2.3.4.5", "+1 (389) 555-5010 4111 1111 1111 1111", "0000001.2.3.4"]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_revealing_terms(spark):
    rng = random.Random(4)
    filler = [f"word{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(k, f"{text(8)} {'zanzibar' if k < 6 else text(1)} ann@corp.example {text(8)}" if k < 12 else text(20)) for k in range(200)] + [(500, None), (501, ""), (None, "b@c.de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_email", F.lit("clash"))
    got = {r["doc_id"]: r for r in pii.find_pii(spark, docs).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        base = plain_spans(t or "")
        assert got[d]["n_email"] == sum(k == 0 for _, k, _ in base)
        assert got[d]["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
    for k in range(12):
        terms = re.findall(r"term:(\d+):(\d+)", got[k]["spans"])
        words = [rows[k][1][int(a) : int(b)] for a, b in terms]
        assert words == (["zanzibar"] if k < 6 else [])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark, docs.drop("n_email")).collect()}
    assert "[EMAIL]" in clean[0] and "[TERM]" in clean[0] and "zanzibar" not in clean[0] and clean[500] is None
    assert pii.find_pii(spark, docs.limit(0)).count() == 0


def test_terms_by_plain_counting(spark):
    """Spans of terms by dictionaries of texts: PMI against the information of the entity, and the support."""
    own = random.Random(21)
    filler = [f"word{k}" for k in range(60)]
    people = [(f"p{k}@x.example", f"Village{k}", f"job{k % 3}") for k in range(8)]
    rows = []
    for k in range(400):
        words = [own.choice(filler) for _ in range(own.randint(4, 25))]
        if k % 3 == 0:
            mail, home, job = people[own.randrange(8)]
            at = own.randrange(len(words))
            words[at:at] = [own.choice((home, "Town")), mail, own.choice((job, "x"))]
        rows.append((k, " ".join(words)))
    rows += [(5, rows[6][1]), (900, None), (901, "")]
    found = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
    lower = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    near, n_t = [], {}
    for d, t in rows:
        t = t or ""
        words, base = list(found.finditer(t)), plain_spans(t)
        for w in {lower(m[0]) for m in words}:
            n_t[w] = n_t.get(w, 0) + 1
        free = [m for m in words if not any(m.end() > a and m.start() < b for a, _, b in base)]
        for a, k, b in base:
            before, after = [m for m in words if m.end() <= a][-pii.NEAR :], [m for m in words if m.start() >= b][: pii.NEAR]
            near += [((d, t), (k, t[a:b].lower()), m) for m in (*before, *after) if m in free and len(m[0]) >= pii.LEAST_LETTERS]
    n_te, n_e = {}, {}
    for key, e, m in near:
        n_te.setdefault((e, lower(m[0])), set()).add(key)
        n_e.setdefault(e, set()).add(key)
    strong = set()
    for (e, w), texts in n_te.items():
        information = math.log2(len(rows) / len(n_e[e]))
        pmi = math.log2(len(rows) * len(texts) / (max(n_t[w], len(texts)) * len(n_e[e])))
        if len(texts) >= pii.SUPPORT and information > 0 and pmi >= pii.ALPHA * information:
            strong.add((e, w))
    want = {}
    for key, e, m in near:
        if (e, lower(m[0])) in strong:
            want.setdefault(key, set()).add((m.start(), 4, m.end()))
    got = pii.find_pii(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["spans"]) for r in got) == sorted((d, pii.joined(sorted([*plain_spans(t or ""), *want.get((d, t or ""), ())]))) for d, t in rows)
    assert len(want) > 20 and any(w.startswith("village") for _, w in strong) and not any(w == "town" for _, w in strong)


def plain_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(d + p), d + p, v) for d, p, v in urls.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_urls(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    link = '<a href="http://{}/x">y</a>'
    rows += [
        (900, None, None), (901, "nothing", ""), (902, "HTTP://EXAMPLE.com/en/7#a", link.format("good.test")), (903, "x://good.test/a", None), (904, "x://com/en/", link.format("com")),
        (905, "x://bad.test/", link.format("spam.example.net")), (906, "x://spam.example.net/de/8/", ""), (907, "x://", ""), (909, "http://a.test/", '<a href="//b.test/x"><A HREF=https://C.test>'), (910, "http://m.sub.a.test", ""), (908, "a://b://c/d?e", ""),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in urls.filter_urls(spark, pages).collect()}
    assert len(got) == len(rows)
    for page, url, _ in rows:
        host, path, rule, verdict = plain_rule(url)
        r = got[page]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
        assert verdict is None or r["verdict"] == verdict
    links = {(r["src"], r["dst"]) for r in urls.host_edges(pages.drop("host").withColumn("host", urls.host_of(F.col("url")))).collect()}
    assert {("a.test", "b.test"), ("a.test", "c.test"), ("m.sub.a.test", "sub.a.test"), ("a.test", "m.sub.a.test")} <= links
    assert got[903]["verdict"] == "allow" and got[905]["verdict"] == "block" and got[900]["verdict"] == "allow"
    assert urls.filter_urls(spark, pages.limit(0)).count() == 0


def test_spread_by_matrix(spark):
    """The ranks of a small graph by plain iteration."""
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("c", "a", 1.0), ("d", "c", 1.0)]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.spread(spark, spark.createDataFrame(edges, "src string, dst string, w double"), spark.createDataFrame([("a", 3.0, 0.0), ("c", 1.0, 2.0)], "host string, allowed double, blocked double")).collect()}

    def plain(links, seeds):
        out = {s: sum(w for a, _, w in links if a == s) for s, _, _ in links}
        start = {h: n / sum(seeds.values()) * (1 - urls.DAMPING) for h, n in seeds.items()}
        rank = dict(start)
        for _ in range(urls.STEPS):
            after = dict(start)
            for s, d, w in links:
                after[d] = after.get(d, 0.0) + rank.get(s, 0.0) * w / out[s] * urls.DAMPING
            rank = after
        return rank

    trust, distrust = plain(edges, {"a": 3.0, "c": 1.0}), plain([(b, a, w) for a, b, w in edges], {"c": 2.0})
    for host in "abcd":
        assert got.get(host, (0, 0)) == pytest.approx((trust.get(host, 0), distrust.get(host, 0)), abs=urls.TOLERANCE)
