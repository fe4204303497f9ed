"""Very long texts, rows that repeat, ties and clashing columns, through every operator."""

import hashlib
import random
import zlib

import pytest
import public_tokenizers as P
from arborel.llm import bpe, decontam, fingerprint, jaccard, langid, pii, sstable, suffix_dedup, toxicity, urls
from pyspark.sql import functions as F

rng = random.Random(41)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
PROSE = " ".join(rng.choice(VOCABULARY) for _ in range(200_000))
LEAK = "these ten words are a benchmark passage that must be found"
LONG = {
    1: PROSE,  # over a million bytes
    2: PROSE[:700_000] + " " + LEAK + " " + PROSE[700_000:],  # a near copy of it
    3: "7" * 1_000_000 + ". mail me: ann@corp.example",
    4: "q" * 600_000,
    5: "+1 " + "4" * 300_000,
    6: " ".join(["word"] * 150_000),
    7: "short text",
    8: "short text",
}


@pytest.fixture(scope="module")
def docs(spark):
    names = ("key", "sig", "n", "comp", "__id", "held_out", "score", "part", "tie", "base", "terms", "spans", "run", "name")
    rows = [*LONG.items(), (8, "short text"), (None, None), (9, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).select("*", *[F.lit("clash").alias(n) for n in names]).repartition(4)


def rows_of(df):
    out = df.collect()
    assert sorted((r["doc_id"] for r in out), key=repr) == sorted([*LONG, 8, None, 9], key=repr)
    return {r["doc_id"]: r for r in out}


def test_scores(spark, docs):
    labels = spark.createDataFrame([(7, 0, 1), (6, 0, 0), (1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in rows_of(toxicity.toxicity(spark, docs, labels)).values())
    got = rows_of(langid.language_id(spark, docs))
    assert got[3]["lang_pred"] == "en" and got[9]["lang_pred"] == got[None]["lang_pred"] == "und"


def test_encoders(spark, docs):
    got = rows_of(bpe.byte_bpe(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))
    for d, t in LONG.items():
        assert got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    shards = rows_of(sstable.token_shards(spark, docs, P.path("byte_bpe_50k.json")))
    assert shards[4]["n_tokens"] > 1 and shards[9]["n_tokens"] == 1
    assert shards[9]["ids_crc32"] == zlib.crc32(bytes(4))


def test_duplicates(spark, docs):
    got = rows_of(jaccard.jaccard_components(spark, docs))
    assert got[1]["component_id"] == got[2]["component_id"] == 1 and got[1]["n_shingles"] > 190_000
    assert got[7]["component_id"] == got[8]["component_id"] == 7 and got[6]["n_shingles"] == 1 and got[6]["component_id"] == 6
    removed = rows_of(suffix_dedup.suffix_dedup(spark, docs))
    assert removed[1]["n_removed"] == removed[1]["n_bytes"] == len(PROSE)
    assert len(LEAK) <= removed[2]["n_bytes"] - removed[2]["n_removed"] <= len(LEAK) + 2  # spaces may match on either side
    assert removed[4]["n_removed"] == 600_000 and removed[7]["n_removed"] == 0


def test_benchmark(spark, docs):
    bench = spark.createDataFrame([(1, LEAK)], "item_id long, text string")
    got = rows_of(decontam.decontaminate(spark, docs, bench))
    assert {d for d, r in got.items() if r["contaminated"]} == {2} and got[2]["n_hit"] == len(LEAK.split())
    cleaned = {r["doc_id"]: r["text"] for r in decontam.without_spans(spark, docs, bench).collect()}
    assert LEAK not in cleaned[2] and cleaned[1] == PROSE


def test_personal_data(spark, docs):
    got = rows_of(pii.find_pii(spark, docs))
    assert got[3]["n_email"] == 1 and got[3]["n_card"] == 0 and got[5]["n_phone"] == 0
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark, docs).collect()}
    assert clean[3].endswith("[EMAIL]") and clean[6] == LONG[6] and clean[None] is None
    assert pii.sanitise(spark, docs).columns == docs.columns


def test_fingerprints(spark, docs):
    got = rows_of(fingerprint.fingerprints(spark, docs))
    assert got[1]["near_next"] > 0.9 and got[7]["near_next"] == 1.0 and got[7]["fingerprint"] == got[8]["fingerprint"]
    assert got[4]["fingerprint"] and got[9]["fingerprint"] == ""


def test_urls(spark):
    long = "http://a.example.com/" + "x/" * 400_000
    rows = [(1, long, "<a href='http://b.test/'>" * 20_000), (1, long, None), (2, None, None), (3, "http://" + "h" * 300_000, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("x")).withColumn("verdict", F.lit("x"))
    got = urls.filter_urls(spark, pages).collect()
    assert len(got) == 4 and {len(r["path"]) for r in got} == {800_001, 0}
    assert {r["verdict"] for r in got} <= {"allow", "block"}

