"""The pipeline's rows against a plain run of its stages, and the guard of the driver entry."""

import base64
import hashlib
import re
import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from arborel.llm import pii, toxicity

from .test_duplicates import brute_components, lower
from .test_scores import plain_spans

SF = "/root/testdata/sf0.01"
FOUND = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150")
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]
    lead = "Cat sat. " + bench[0] + " Last words here."
    rows += [(900, rows[3][1], "en", "s", 1), (901, rows[4][1] + " more", "en", "s", 1), (902, None, None, "s", None), (903, "", "en", "s", 0), (904, lead, "en", "s", len(lead)), (905, "write to ann@corp.example now", "en", "s", 29)]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


def without(text, windows):
    """The text without the runs of words that benchmark windows hit."""
    words = list(FOUND.finditer(lower(text)))
    hit = set()
    for size in {len(w) for w in windows}:
        for k in range(len(words) - size + 1):
            if tuple(m[0] for m in words[k : k + size]) in windows:
                hit |= set(range(k, k + size))
    out, at, k = "", 0, 0
    while k < len(words):
        if k in hit:
            end = k
            while end + 1 in hit:
                end += 1
            out += text[at : words[k].start()]
            at, k = words[end].end(), end
        k += 1
    return out + text[at:]


def test_same_as_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(spark, docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if not scores[r["doc_id"]]]
    keep = {d for d, n, c in brute_components(rows) if not n or d == c}
    rows = [(d, t) for d, t in rows if d in keep]
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = FOUND.findall(lower(r["text"]))
        windows |= {tuple(w[k : k + 10]) for k in range(max(len(w) - 9, min(len(w), 1)))}
    rows = [(d, without(t, windows) if t else t) for d, t in rows]
    assert dict(rows)[904].startswith("Cat sat. ") and dict(rows)[904].endswith(" Last words here.") and len(dict(rows)[904]) < 60
    terms = {r["doc_id"]: [(int(a), 4, int(b)) for a, b in re.findall(r"term:(\d+):(\d+)", r["spans"])] for r in pii.find_pii(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in rows:
        text, done = "", 0
        for a, k, b in sorted(plain_spans(t or "") + terms[d]):
            if a >= done:
                text += (t or "")[done:a] + f"[{pii.KINDS[k].upper()}]"
            done = max(done, b)
        text += (t or "")[done:]
        ids = np.array(plain.encode_ordinary(text), dtype="<u4").tobytes()
        want.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(want)


def test_empty_and_extra_columns(spark, folder, tmp_path):
    """No documents give no rows; columns named as inner ones, and null ids and texts, go through all stages."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        for at in ("none", "more"):
            spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{at}/{name}.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    names = ("key", "terms", "__id", "__sig", "__key", "held_out", "score", "n_tokens", "component", "sig", "spans", "root")
    few = docs.where("doc_id < 40 or doc_id >= 900").unionByName(spark.createDataFrame([(None, "a text without an id", "en", "s", 20), (None, None, "en", "s", None)], docs.schema))
    few.selectExpr("*", *[f"doc_id AS `{n}`" for n in names]).write.parquet(f"{tmp_path}/more/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/more")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    few.write.parquet(f"{tmp_path}/plain/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/plain/{name}.parquet")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, corpus_pipeline.run(spark, f"{tmp_path}/plain").collect()))


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard join", "decontamination", "pii", "byte bpe"]


def test_entry_without_the_subpackage(tmp_path):
    """The driver entry imports, and has its other queries, where the corpus folders are gone; a broken import in them is not hidden."""
    home = Path(corpus_pipeline.__file__).parent
    shutil.copytree(home / "arborel", tmp_path / "arborel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(home / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith(('op', 'pipeline')) for n in e.queries()), len(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=tmp_path)
    n, corpus, sql = got.stdout.split()[-3:]
    assert int(n) > 150 and corpus == "False" and int(sql) > 150
    (tmp_path / "arborel/llm").mkdir()
    (tmp_path / "arborel/llm/__init__.py").write_text("")
    (tmp_path / "arborel/llm/queries.py").write_text("import not_there")
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, cwd=tmp_path, check=False).returncode != 0
