"""Spelling variants against brute force: every edit position, runs of equal letters, frequent beginnings, odd rows."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricegrid.llm import variants

SCHEMA = "doc_id long, text string, word string, n string, id string, run string, length string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    count = collections.Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    forms, nears = {}, {}
    for w, n in words.items():
        around = [x for x in words if near(w, x)]
        nears[w] = len(around)
        best = min(around, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, nears[w], words.get(forms[w])))
    return sorted(out, key=repr)


def got(df, **how):
    return sorted((tuple(r) for r in variants.spelling_variants(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "w", "n", "i", "r", "l") for d, t in docs], SCHEMA)


def test_as_by_brute_force(spark):
    rng = random.Random(8)
    stems = ["".join(rng.choices("abcé", k=rng.randrange(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "aaabaaa", "ÿÿÿÿÿÿ", "ÿÿÿÿÿÿÿ", "ÀÉÎÕÜß", "x×÷yzz"]
    words = []
    for k, stem in enumerate(stems):
        words += [stem.upper() if k % 3 == 0 else stem] * rng.choice([5, 30, 200])
        for _ in range(6):
            i = rng.randrange(len(stem))
            other = rng.choice([stem[:i] + rng.choice("abcdé") + stem[i + 1 :], stem[:i] + stem[i + 1 :], stem[:i] + rng.choice("abc") + stem[i:]])
            words += [other] * rng.choice([1, 5, 6, 30])
    rng.shuffle(words)
    docs = [(i, rng.choice([" ", "-", "1", "\n"]).join(words[i * 50 : i * 50 + 50])) for i in range(len(words) // 50 + 1)]
    want = brute(docs)
    assert got(frame(spark, docs)) == want
    assert any(r[1] and r[2] != r[1] for r in want) and sum(r[4] > 3 for r in want) > 20


def test_heavy_keys_are_split_and_blocks_do_not_matter(spark):
    rng = random.Random(9)
    words = sorted({"prefix" + "".join(rng.choices("abc", k=rng.randrange(4, 7))) for _ in range(400)} | {"".join(rng.choices("abc", k=5)) + "suffixes" for _ in range(200)})
    n = {w: rng.randrange(5, 100) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    for how in ({}, {"block_bytes": 500, "key_bytes": 200}, {"block_bytes": 1 << 20, "key_bytes": 1}):
        rows = variants.near_words(df, **how).groupBy("word").agg(F.sum("n_near").alias("k"), F.min(F.struct(-F.col("best_n"), "best"))["best"].alias("best")).collect()
        around = {w: [x for x in words if near(w, x)] for w in words}
        assert {r["word"]: (r["k"], r["best"]) for r in rows} == {w: (len(a), min(a, key=lambda x: (-n[x], x))) for w, a in around.items() if a}


def test_odd_rows(spark):
    long = "abcdef" * 3_000
    docs = [(1, None), (2, ""), (3, "12 34 !"), (None, "orphan orphan orphan orphan orphan"), (4, "orphan orphen"), (4, "orphan orphen"), (5, " ".join([long, long + "g"] * 5)), (6, "orphen " * 3), (7, "Straße STRASSE ÉCOLE école ecole " * 6), (8, "日本語" * 9)]
    assert got(frame(spark, docs)) == brute(docs)
    assert got(frame(spark, [])) == []


@pytest.mark.parametrize("m", [1, 2, 7, 64, 1000])
def test_ranges_are_those_of_a_plain_search(m):
    rng = np.random.default_rng(m)
    values = rng.permutation(m)
    tree = variants.WaveletTree(values)
    a, c = rng.integers(0, m + 1, 50), rng.integers(0, m + 1, 50)
    b, d = np.minimum(m, a + rng.integers(0, m + 1, 50)), np.minimum(m, c + rng.integers(0, m + 1, 50))
    q, v = tree.report(a, b, c, d)
    want = [(k, int(x)) for k in range(50) for x in values[a[k] : b[k]] if c[k] <= x < d[k]]
    assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == sorted(want)
