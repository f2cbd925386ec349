"""Every stage of the pipeline against the brute-force rule on its own input."""

import base64
import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from test_text_operators import brute_components, brute_pii

import corpus_pipeline
from pricegrid.llm import decontaminate
from pricegrid.llm.pii import KINDS, outermost


@pytest.fixture(scope="module")
def kept(spark, small, tmp_path_factory):
    """The documents before each stage and after the last, as plain rows."""
    folder = tmp_path_factory.mktemp("stages")
    extra = spark.createDataFrame(
        [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "123 456 !!", "en", "s", 10), (9004, "mail me at jo.do@mail.example.com and 10.0.0.1 the with of and", None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(extra)
    docs.write.parquet(f"{folder}/start")
    docs = spark.read.parquet(f"{folder}/start")
    out = {"start": docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, small)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == columns
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect()
    return out


def test_languages(kept):
    before, after = {r["doc_id"]: r for r in kept["start"]}, {r["doc_id"] for r in kept["language_id"]}
    lettered = {i for i, r in before.items() if r["text"] and re.search(r"[^\W\d_]", r["text"])}
    assert after <= lettered and len(after) >= 0.98 * len(lettered) and 9004 in after


def test_near_duplicates(kept):
    rows = [(r["doc_id"], r["text"]) for r in kept["language_id"]]
    assert sorted(r["doc_id"] for r in kept["jaccard_join"]) == sorted(d for d, n, c in brute_components(rows) if n == 0 or d == c)


def test_benchmark(kept, spark, small):
    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    after = {r["doc_id"] for r in kept["decontamination"]}
    leaked = {r["doc_id"] for r in kept["jaccard_join"] if any(i in decontaminate.normalise(r["text"]) for i in items)}
    assert leaked and not leaked & after
    assert len(kept["jaccard_join"]) - len(after) <= len(leaked) + 1


def test_personal_data(kept):
    before = {r["doc_id"]: r["text"] for r in kept["decontamination"]}
    assert len(kept["pii"]) == len(before)
    for r in kept["pii"]:
        want = before[r["doc_id"]]
        for k, s, e in outermost(brute_pii(want))[::-1]:
            want = f"{want[:s]}[{KINDS[k].upper()}]{want[e:]}"
        assert r["text"] == want and r["n_chars"] in (None, len(want))


def test_tokens(kept):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    bpe = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in kept["pii"]}
    assert {(r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in kept["bpe"]} == {
        (i, len(ids := bpe.encode_ordinary(t)), tuple(ids), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()
    }


def test_run_and_registration(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "pii", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None
