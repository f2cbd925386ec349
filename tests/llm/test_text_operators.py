"""Each text operator against brute force, and its defined results for odd inputs."""

import base64
import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from pricegrid.llm import common, decontaminate, jaccard, language, pii, quality, secrets, shards, tokens, toxicity, vectors

ODD = [(1, None, None, "x"), (2, "", "en", "x"), (3, "  \n\t ", "en", "x"), (4, "12345 !!", None, None), (5, "the same text again and again", "en", "y"), (5, "the same text again and again", "en", "y"),
       (None, "an orphan with naïve 🎉 letters", "en", "z"), (7, "x" * 50_000, "en", "x"), (8, "word " * 20_000, "en", None)]
#: clashing names on purpose
SCHEMA = "doc_id long, text string, lang string, source string, score string, row string, id string, base string, words string, n int, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "s", "r", "i", "b", "w", 3, 4) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


# language


def test_language_of_held_out_texts(spark, docs):
    known = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    net = language.train_language_model(docs.filter(known))
    out = language.identify_language(docs.filter(~known), net, keep=["lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_of_odd_rows(odd, none):
    net = language.train_language_model(odd)
    out = language.identify_language(odd, net).collect()
    assert len(out) == len(ODD)
    assert {r["doc_id"]: r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3, 4)} == {i: "und" for i in (1, 2, 3, 4)}
    assert language.identify_language(none, net).count() == 0
    empty = language.train_language_model(none)
    assert {r["lang_pred"] for r in language.identify_language(odd, empty).collect()} == {"und"}
    kept = language.keep_identified(odd, net, min_score=0.0)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {5, None, 7, 8}


def plain_probabilities(net, window):
    """The network of one window, filter by filter and place by place."""
    pooled = []
    for w in language.WIDTHS:
        for f in range(net.filters[w].shape[2]):
            sums = [
                net.biases[w][f] + sum(float(net.embedding[window[i + j], d]) * float(net.filters[w][j, d, f]) for j in range(w) for d in range(net.embedding.shape[1]))
                for i in range(len(window) - w + 1)
            ]
            pooled.append(max(0.0, max(sums)))
    z = [net.out_bias[c] + sum(p * float(net.out[k, c]) for k, p in enumerate(pooled)) for c in range(len(net.labels))]
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def test_windows_are_scored_as_by_plain_convolution():
    net = language.ByteConvNet.fresh(["a", "b", "c"], 3, 4, 1)
    rng = np.random.default_rng(2)
    for w in language.WIDTHS:
        net.biases[w] += rng.normal(0, 0.3, 4).astype(np.float32)
    windows = rng.integers(0, 256, (3, language.WINDOW), dtype=np.uint8)
    assert np.allclose(net.scorer().probabilities(windows, group=2), [plain_probabilities(net, w) for w in windows], atol=1e-4)


def test_gradients_are_those_of_finite_differences():
    net = language.ByteConvNet.fresh(["a", "b", "c"], 2, 3, 5)
    for name in ("embedding", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters = {w: f.astype(np.float64) for w, f in net.filters.items()}
    net.biases = {w: f.astype(np.float64) for w, f in net.biases.items()}
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 20, (6, language.WINDOW), dtype=np.uint8), rng.integers(0, 3, 6)
    for p, g in zip(net.parameters(), net.loss_gradients(x, y)[1], strict=True):
        for at in rng.choice(p.size, min(10, p.size), replace=False):
            old = p.flat[at]
            loss = []
            for step in (1e-6, -1e-6):
                p.flat[at] = old + step
                loss.append(net.loss_gradients(x, y)[0])
            p.flat[at] = old
            assert abs((loss[0] - loss[1]) / 2e-6 - g.flat[at]) < 1e-4


def test_shares_do_not_vanish_at_any_size(spark):
    df = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    for n in (10**6, 10**9, 10**12):
        assert F.lit(400 / n) is not None
        assert spark.sql(f"SELECT {400 / n} * {common._HASHES} AS least").first()["least"] > 1
    assert 900 < df.filter(common.below_share(F.col("h"), 0.005)).count() < 1100


def test_no_label_is_lost_to_a_frequent_text(spark):
    rows = [("the same text for every row of a label", "a")] * 3000 + [(f"noch ein anderer text {i}", "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "text string, lang string")
    x, names = language.sample_windows(df, "text", "lang", 50, 2, 64)
    assert set(names) == {"a", "b"} and len(names) < 50 * 3 * 3
    assert set(language.sample_windows(df, "text", "lang", 50, 2, 1)[1]) <= {"a", "b"}


def test_labelled_sample_is_bounded_where_ids_repeat(spark):
    rows = [(1, f"text {i}") for i in range(4000)] + [(i, f"other {i}") for i in range(2, 400)]
    labels = [(1, 1)] * 5 + [(i, i % 2) for i in range(2, 400)]
    sample, counts = common.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, y int"), "doc_id", "text", "y", 100)
    got = collections.Counter(r["y"] for r in sample.collect())
    assert counts == {0: 199, 1: 200} and 50 < got[0] < 160 and 50 < got[1] < 250


# personal data

PII_TEXTS = ["write a.b+c@mail.example.com, or a@b or @x.y 1.2.3.4 and 1.2.3.256 1.2.3.4.5", "card 4111 1111 1111 1111 x 4111111111111112 +1 (555) 123-4567.", "+12 +1-2-3-4-5-6-7-8-9-0", "", None, "a@b.c.d@e.f 0.0.0.0.0.0.0.0",
             "9" * 5000 + "@" * 300, "+" * 300 + "1 " * 400, "é1@é.é à@b.cd"]


def brute_pii(t):
    t = t or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(x):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(x))) % 10 == 0

    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]
    return out


def test_base_spans():
    rnd = random.Random(3)
    texts = PII_TEXTS + ["".join(rnd.choice("ab1.@+- ()") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t or "") == brute_pii(t), t


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"text{i} please contact user{i}@mail.example.com today ok") for i in range(20)] + [(300, "word please contact joe.at.home99 today ok"), (301, "no such context joe.at.home99")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for few in (100_000, 0):
        got = {r["doc_id"]: [tuple(s) for s in r["added"]] for r in pii.find_personal_data(df, few=few).collect()}
        assert got.pop(300) == [(0, 20, 33)]
        assert not any(got.values())


def test_patterns_reached_through_found_instances_only(spark):
    rows = [(i, f"text{i} please contact user{i}@mail.example.com today ok") for i in range(40)]
    rows += [(100 + i, f"word please contact joe.home{i + 10} today ok") for i in range(12)] + [(200 + i, f"member id joe.home{i + 10} tonight ok") for i in range(12)]
    rows += [(300, "member id zed.home77 tonight ok"), (301, "other place zed.home77 here ok")]
    got = {r["doc_id"]: [tuple(s) for s in r["added"]] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[300] == [(0, 10, 20)] and not got[301]
    assert all(got[100 + i] == [(0, 20, 30)] and got[200 + i] == [(0, 10, 20)] for i in range(12))


def test_unseen_identifiers_are_found_and_clean_tokens_left(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    rows, planted = [], {}
    for i in range(600):
        before, after = " ".join(word() for _ in range(20)), " ".join(word() for _ in range(20))
        value = f"u{rnd.randrange(10**6)}@mail.example.com" if i % 10 else f"{word()}.{rnd.randrange(10**6)}"
        lead = ("reach me at", '{"user":"x","mail":"')[i % 2]
        text = f"{before} {lead} {value} soon {after}" if i % 2 == 0 else f'{before}{lead}{value}","k":"v"}} {after}'
        if i % 10 == 0:
            planted[i] = (text.index(value), text.index(value) + len(value))
        rows.append((i, text + f" item {rnd.randrange(10**6)}"))
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["added"]] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), min_confidence=0.8).collect()}
    found = sum(planted[i] in got[i] for i in planted)
    assert found == len(planted) and sum(map(len, got.values())) == found


def test_long_texts_take_linear_time():
    began = time.time()
    text = "a@b.cd x12345 " * 10_000
    assert len(pii.instances(text)) == 20_000
    pii.instances("a" * 1_000_000 + " 1 " + "b1" * 500_000)
    for t in ("a" * 1_000_000, "1" * 1_000_000, "a1" * 500_000):
        assert len(toxicity.fold(t)) == len(t)
    index = decontaminate.PieceIndex(decontaminate.segments(1, "ab " * 60, 160, 0.08))
    index.find("ab " * 5_000)
    assert time.time() - began < 30


def test_personal_data_of_odd_rows(odd, none):
    out = pii.find_personal_data(odd).collect()
    assert len(out) == len(ODD) and all(not r["base"] for r in out)
    assert pii.find_personal_data(none).count() == 0
    masked = pii.mask_personal_data(odd)
    assert masked.columns == odd.columns and masked.exceptAll(odd).count() == 0


def test_masking(spark):
    clash = spark.createDataFrame([("mail a@b.cd", 1, 2)], "text string, base int, added int")
    assert [tuple(r) for r in pii.mask_personal_data(clash).collect()] == [("mail [EMAIL]", 1, 2)] == [tuple(r) for r in pii.mask_personal_data(clash, few=-1).collect()]
    df = spark.createDataFrame([(1, "mail a@b.cd from 1.2.3.4!"), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in pii.mask_personal_data(df).orderBy("doc_id").collect()] == ["mail [EMAIL] from [IP]!", None]


# shingle sets


def sets_of(texts, words=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    return out


def brute_components(rows):
    sets = sets_of([t for _, t in rows])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies(seed):
    """Chains and stars of copies near the threshold, exact copies, shared passages and short texts."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage, rows = [rnd.choice(vocabulary) for _ in range(60)], []
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((3, 5, 9, 40, 80)))] + (passage if rnd.random() < 0.4 else [])
        for _ in range(rnd.choice((1, 1, 2, 8))):
            copy = list(base)
            for _ in range(rnd.choice((0, 0, 1, 2, 3))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append(" ".join(copy).title() if rnd.random() < 0.2 else "\t".join(copy))
            if rnd.random() < 0.5:
                base = copy
    rows += ["", None, "one", "one", "one two", "One  two\n"]
    rnd.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [2])
def test_components(spark, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jaccard.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == sorted(brute_components(rows))


def test_components_of_a_large_group(spark):
    """Copies of one text, each with changes of its own: many pairs in the same lists, some of them links."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(rnd.randint(1, 4)):
            copy[rnd.randrange(90)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(brute_components(rows))
    for rounds in (6,):
        got = sorted(map(tuple, jaccard.jaccard_components(df, star_rounds=rounds, most_rounds=max(1, rounds)).select("doc_id", "n_shingles", "component_id").collect()))
        assert got == want


def test_sets_of_one_fingerprint_are_told_apart(spark, monkeypatch):
    plain = jaccard._set_hashes
    monkeypatch.setattr(jaccard, "_set_hashes", lambda h, o, salt: plain(h, o, salt) % np.uint64(5) if salt == 1 else plain(h, o, salt))
    rows = near_copies(7)
    got = sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == sorted(brute_components(rows))


def test_words_that_sums_of_letters_confuse_are_told_apart(spark):
    """Thue-Morse words and their complements have the same sum of letter times power, modulo 2 ** 64, for every factor."""
    bits = [bin(i).count("1") % 2 for i in range(1 << 12)]
    for n in (8, 32, 64, 72, 1 << 10, 1 << 12):
        one, two = ("".join("ab"[b ^ flip] for b in bits[:n]) for flip in (0, 1))
        rows = [(1, one), (2, two), (3, f"w x {one} y z"), (4, f"w x {two} y z"), (5, one.upper()), (6, one + "\0"), (7, one[:-1])]
        got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()} if n == 1 << 10 else None
        sets, offsets = jaccard.shingle_sets(*common.utf8_buffers(pa.array([t for _, t in rows])), 5)
        assert got is None or got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 6, 7: 7}
        assert len(set(sets.tolist())) == 6 and offsets.tolist() == list(range(8))


def test_one_of_each_group_stays(spark):
    rows = near_copies(4)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    left = jaccard.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert left.exceptAll(jaccard.drop_near_duplicates(df, few=0)).count() == 0
    want = sorted(d for d, n, c in brute_components(rows) if n == 0 or d == c)
    assert sorted(r["doc_id"] for r in left.collect()) == want


def test_one_of_each_group_stays_where_ids_repeat(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in ("a", "b", "c"))
    rows = [(1, one), (1, two), (2, one), (3, two + " b60"), (None, three), (None, three + " c60")]
    left = jaccard.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left if r["doc_id"]) == [(1, one), (1, two)]
    assert len(left) == 3


def test_sets_of_odd_rows(odd, none):
    out = jaccard.jaccard_components(odd).collect()
    assert len(out) == len(ODD)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] in (1, 2, 3)} == {(i, 0, i) for i in (1, 2, 3)}
    assert jaccard.jaccard_components(none).count() == 0
    left = jaccard.drop_near_duplicates(odd)
    assert left.columns == odd.columns and left.count() == len(ODD) - 1
    assert jaccard.drop_near_duplicates(none).count() == 0


# quality


def test_quality(spark, small, docs):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality.train_quality(docs, labels)
    out = quality.score_quality(docs, model, F.col("source"), F.col("lang")).join(labels, "doc_id").collect()
    assert sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in out) >= 0.95 * len(out)


def test_sites_shrink(spark):
    rows = [(i, "text", "big", "a") for i in range(50)] + [(100, "text", "tiny", "b"), (101, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    out = quality.score_quality(df, None, F.col("host"), F.col("path")).collect()
    assert len(out) == 52 and all(abs(r["site_score"] - 0.5) < 1e-9 and abs(r["score"] - 0.5) < 1e-9 for r in out)


def test_site_posteriors_are_those_of_a_plain_loop(spark):
    rnd = random.Random(8)
    docs = [(i, " ".join(rnd.choice(["ab", "Cde", "12", "f"]) for _ in range(rnd.randint(1, 30))), rnd.choice("xxxyz"), rnd.choice("pq")) for i in range(200)]
    rng = np.random.default_rng(1)
    b = rng.normal(0, 0.5, 1 + 3 * quality.N_FEATURES)
    out = {r["doc_id"]: r for r in quality.score_quality(spark.createDataFrame(docs, "doc_id long, text string, host string, path string"), b, F.col("host"), F.col("path")).collect()}
    p = {}
    for i, t, _, _ in docs:
        f = quality.features(t)
        z = b[0] + sum(c * v for c, v in zip(b[1:], [*f, *(v * v for v in f), *(math.log(v + 0.01) for v in f)], strict=True))
        p[i] = 1 / (1 + math.exp(-max(-30, min(30, z))))
    mean = sum(p.values()) / len(p)

    def pseudo(groups):
        """groups: (n, s, parent's mean)."""
        groups = [g for g in groups if g[0] > 1]
        between, noise, scale = sum(n * (s / n - m) ** 2 for n, s, m in groups), sum(m * (1 - m) for _, _, m in groups), sum(n * m * (1 - m) for n, _, m in groups)
        return min(1e4, max(1.0, 1 / max(1e-4, (between - noise) / max(1e-12, scale - noise)) - 1))

    hosts, paths = {}, {}
    for i, _, h, q in docs:
        for d, key in ((hosts, h), (paths, (h, q))):
            n, s = d.get(key, (0, 0.0))
            d[key] = (n + 1, s + p[i])
    mh = pseudo([(n, s, mean) for n, s in hosts.values()])
    rate = {h: (s + mh * mean) / (n + mh) for h, (n, s) in hosts.items()}
    mp = pseudo([(n, s, rate[k[0]]) for k, (n, s) in paths.items()])
    for i, _, h, q in docs:
        n, s = paths[h, q]
        site = (s - p[i] + mp * rate[h]) / (n - 1 + mp)
        odds = p[i] / (1 - p[i]) * site / (1 - site)
        assert abs(out[i]["text_score"] - p[i]) < 1e-9 and abs(out[i]["site_score"] - site) < 1e-9 and abs(out[i]["score"] - odds / (1 + odds)) < 1e-9


def test_quality_of_odd_rows(odd, none):
    assert quality.score_quality(odd, None, F.col("source"), F.col("lang")).count() == len(ODD)
    assert quality.score_quality(none, None, F.col("source"), F.col("lang")).count() == 0
    assert quality.train_quality(none, none.select("doc_id", F.lit(1).alias("quality"))) is None


# toxicity


def test_folding():
    assert toxicity.fold("1d10t M0R0N ídïot trаsh$$$ 5tupid 12345") == "idiot moron idiot trash$$$ stupid 12345"
    assert len(toxicity.fold("ﬁ İ ß 🎉")) == len("ﬁ İ ß 🎉")


def test_hits_are_those_of_a_naive_search():
    rnd = random.Random(12)
    model = toxicity.ToxicityModel({"abc": 1.0, "ab": 0.5, "bca": 2.0, "c": 0.1}, ["ab ca", "abc b", "c c"])
    matcher = model.matcher()
    for _ in range(2000):
        t = "".join(rnd.choice("abc  .") for _ in range(rnd.randint(0, 30)))
        starts = [i for i in range(len(t)) if t[i].isalpha() and not (i and t[i - 1].isalpha())]
        want = []
        for i in starts:
            fits = [(w, s) for s, w in model.stems.items() if t.startswith(s, i)]
            covered = any(
                a <= i < a + len(e) and t.startswith(e, a) and (a + len(e) == len(t) or not t[a + len(e)].isalpha()) and not (a and t[a - 1].isalpha())
                for e in model.exceptions for a in range(len(t))
            )
            if fits and not covered:
                w, s = max(fits)
                want.append((i, i + len(s), w))
        assert matcher.hits(t) == want, t


def test_folding_is_that_of_a_plain_rule():
    rnd = random.Random(13)
    for _ in range(3000):
        t = "".join(rnd.choice("ab13$@29 .x") for _ in range(rnd.randint(0, 25)))

        def plain(m):
            w = m.group()
            if not re.search(r"[a-z][013457@$8]|[013457@$8][a-z]", w):
                return w
            inner = w.rstrip("$@")
            return w if 3 * sum(c.isalpha() for c in w) < len(inner) else "".join(toxicity.STANDINS.get(c, c) for c in inner) + w[len(inner) :]

        assert toxicity.fold(t) == re.sub(r"[a-z0-9@$]+", plain, t), t


def test_toxicity(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(400):
        w, bad = [rnd.choice(words) for _ in range(40)], i % 2
        for _ in range(4 * bad):
            w[rnd.randrange(40)] = rnd.choice(["vile", "nasty"])
        if not bad and i % 4 == 0:
            w[rnd.randrange(39)] = "nasty habit"
        rows.append((i, " ".join(w)))
        labels.append((i, bad))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train_toxicity(d, y)
    out = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(d, model).collect()}
    assert all((out[i] >= 0.5) == bool(bad) for i, bad in labels)
    tried = spark.createDataFrame([(1, "w1 v1le w2 n4sty " + "w3 " * 20), (2, None), (3, "")], "doc_id long, text string")
    assert [r["score"] >= 0.5 for r in toxicity.score_toxicity(tried, model).orderBy("doc_id").collect()] == [True, False, False]


def test_toxicity_of_odd_rows(odd, none):
    model = toxicity.train_toxicity(none, none.select("doc_id", F.lit(1).alias("toxic")))
    assert {r["score"] for r in toxicity.score_toxicity(odd, model).collect()} == {0.0}
    assert toxicity.score_toxicity(none, model).count() == 0


# secrets


def brute_secrets(t):
    t = t or ""
    a = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 16]
    return sorted(out)


def test_secrets(spark):
    rnd = random.Random(2)
    bits = ["token", "PassWord", "api_key", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123456789XY", "deadbeef0123456789", "x.y-z", "é🎉", "AKIAAKIA", "abc"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))) for i in range(1500)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["ord"], s["end"]) for s in r["base"]] for r in secrets.find_secrets(df).collect()}
    for i, t in rows:
        assert got[i] == brute_secrets(t), t


def test_entropy(spark):
    def entropy(s, w):
        w = min(w, len(s))
        return max(-sum(c / w * math.log2(c / w) for c in collections.Counter(s[i : i + w]).values()) for i in range(len(s) - w + 1))

    rnd = random.Random(4)
    values = ["".join(rnd.choice("abc123XYZ+/") for _ in range(rnd.randint(20, 60))) for _ in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", secrets.best_window_entropy(F.col("v"), 20).alias("e")).collect():
        assert abs(r["e"] - entropy(r["v"], 20)) < 1e-9
    found = spark.createDataFrame([(1, "key ghp_x9Kq2LmZ7vTr4WnB8sYc3D here"), (2, "see zzexample9Kq2LmZ7vTr4WnB8sY"), (3, "aaaaaaaaaaaaaaaaaaaa1111111111111111")], "doc_id long, text string")
    assert {r["doc_id"]: len(r["added"]) for r in secrets.find_secrets(found).collect()} == {1: 1, 2: 0, 3: 0}


def test_random_keys_are_found_and_usual_words_left(spark):
    rnd = random.Random(14)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = ["".join(rnd.choice(s) for _ in range(n)) for s, n in ((letters + "0123456789", 32), (letters + "0123456789+/", 40), ("0123456789ABCDEF", 40), (letters, 48)) for _ in range(25)]
    clean = ["/usr/local/share/python-packages", "Some-Very-Long-Page-Title-2024", "123e4567-e89b-12d3-a456-426614174000", "InternationalizationManagerFactory", "2024-01-01T00-00-00+00-00", "sha256-9Kq2LmZ7vTr4WnB8sYc3D1pQ",
             "ZZZZZZZZYYYYYYYYXXXXXXXX12", "antidisestablishmentarianism", "YourExampleKey9Kq2LmZ7vTr4W", "the_quick_brown_fox_jumps_over"]
    rows = [(i, f"run {k} now") for i, k in enumerate(keys)] + [(1000 + i, f"see {c} there") for i, c in enumerate(clean)]
    got = {r["doc_id"]: len(r["added"]) + len(r["base"]) for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(len(keys))) >= 0.97 * len(keys)
    assert not any(got[1000 + i] for i in range(len(clean)))


def test_many_secrets_in_a_text(spark):
    t = "token=abcdefghijkl1 " * 20_000
    r = secrets.find_secrets(spark.createDataFrame([(1, t)], "doc_id long, text string")).collect()[0]
    assert [(s["start"], s["end"]) for s in r["base"]] == [(20 * i, 20 * i + 19) for i in range(20_000)]


def test_secrets_of_odd_rows(odd, none):
    out = secrets.find_secrets(odd).collect()
    assert len(out) == len(ODD) and not any(r["base"] or r["added"] for r in out)
    assert secrets.find_secrets(none).count() == 0


# decontamination


def semiglobal(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        last, row = row, [i + 1]
        for j, d in enumerate(t):
            row.append(min(last[j] + (c != d), last[j + 1] + 1, row[j] + 1))
    return min(row)


def test_bit_parallel_distance():
    rnd = random.Random(6)
    for _ in range(400):
        p, t = ("".join(rnd.choice("abc") for _ in range(rnd.randint(1, n))) for n in (12, 30))
        s = decontaminate.Segment(0, p, len(p))
        assert decontaminate.best_distance(s.masks(), len(p), t, len(p))[0] == semiglobal(p, t)


def test_benchmark_hits(spark):
    rnd = random.Random(7)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    items = [(i, text(30)) for i in range(6)] + [(6, None), (7, "!!"), (8, "abc")]
    rows = []
    for i in range(60):
        body, planted = text(50), None
        if i % 3 == 0:
            planted = list(items[i % 6][1].upper())
            for _ in range(i % 5):
                planted[rnd.randrange(len(planted))] = rnd.choice(("x", "", "yy"))
            body = f"{body}\n%%% {''.join(planted)}; {text(20)}"
        rows.append((i, body))
    rows += [(100, None), (101, ""), (102, "xabcx"), (103, "x abc x")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.benchmark_hits(d, b, slice_bytes=200).collect()}
    want = set()
    for i, t in rows:
        for k, item in items:
            for s in decontaminate.segments(k, item, 160, 0.08):
                n = decontaminate.normalise(t or "")
                near = s.budget and semiglobal(s.text, n) <= s.budget
                if n and (near or (not s.budget and f" {s.text} " in f" {n} ")):
                    want.add((i, k))
    assert got == want and len(want) >= 20
    left = decontaminate.drop_contaminated(d, b, slice_bytes=200)
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_benchmark_odd(spark, odd, none):
    b = spark.createDataFrame([(1, "the same text again"), (None, "x"), (2, None)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.benchmark_hits(odd, b).collect()} == {5}
    assert decontaminate.benchmark_hits(none, b).count() == 0
    assert decontaminate.benchmark_hits(odd, b.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(odd, b).count() == len(ODD) - 2


# tokens


def test_tokens(spark, docs, odd, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    bpe = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mixed = docs.select("doc_id", "text").limit(60).unionByName(odd.select("doc_id", "text")).unionByName(
        spark.createDataFrame([(900, "日本語 тест ²³ 'll don't\x1c\x85 a​b"), (901, "\r\n\r\n  x  ")], "doc_id long, text string")
    )
    rows = mixed.collect()
    got = collections.Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in tokens.encode_decode(spark.createDataFrame(rows, mixed.schema), path, public_tokenizers.PATTERN, chunk_bytes=20_000).collect())
    assert got == collections.Counter((r["doc_id"], tuple(bpe.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in rows)
    assert tokens.encode_decode(none, path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("most", [1, 10, 64, 1000])
def test_chunks_are_cut_by_bytes(most):
    rnd = random.Random(most)
    texts = ["é" * rnd.randrange(40) if rnd.random() < 0.9 else None for _ in range(300)] + ["x" * 500, "", "y"]
    batches = [pa.RecordBatch.from_pydict({"id": list(range(i, min(i + 70, len(texts)))), "text": pa.array(texts[i : i + 70], pa.string())}) for i in range(0, len(texts), 70)]
    size = lambda part: sum(len((t or "").encode()) for t in part)
    chunks = [c.column(1).to_pylist() for c in tokens._chunks(iter(batches), most)]
    assert [t for c in chunks for t in c] == texts
    assert all(size(c) <= most or sum(bool(t) for t in c) == 1 for c in chunks)
    assert all(size(a) + size(b[:1]) > most for a, b in zip(chunks, chunks[1:], strict=False))


def test_every_label_is_learned(spark):
    """A hundred labels share the sample; each has some texts."""
    rows = [(i * 10 + k, f"{chr(0x4E00 + i)}{chr(97 + i % 26)} " * (20 + k), f"l{i:03}") for i in range(100) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    x, names = language.sample_windows(df, "text", "lang", 400, 2, 400)
    assert len(set(names)) == 100 and len(x) <= 100 * 10 * 3


def test_merges():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = tokens.read_ranks(path)
    bpe = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(15)
    words = ["".join(rnd.choice("abcdehéü日 1x") for _ in range(rnd.randint(1, 60))).encode() for _ in range(1500)] + [b"x" * 5000, bytes(rnd.randrange(256) for _ in range(3000))]
    for w in words:
        assert tokens.merge(w, ranks) == bpe._encode_single_piece(w)
        assert w in ranks or tokens._merge_long(w, ranks) == tokens.merge(w, ranks)


def test_tokens_without_an_answer(spark, docs, monkeypatch):
    """Should the source change its order between two readings, chunks merge their words themselves."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    few = spark.createDataFrame(docs.select("doc_id", "text").limit(40).collect(), "doc_id long, text string")
    rows = lambda: sorted((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in tokens.encode_decode(few, path, public_tokenizers.PATTERN).collect())
    want = rows()
    monkeypatch.setattr(tokens, "_name_of", lambda chunk: random.getrandbits(62))
    assert rows() == want


def test_tokens_by_exploded_positions(spark, docs):
    """The same method with a row for each pre-token: exploded with positions, distinct words merged, joined back,
    reassembled by position, decoded by a join with the token-byte table."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = tokens.read_ranks(path)
    split = F.udf(tokens.splitter(public_tokenizers.PATTERN), "array<string>")
    merged = F.udf(lambda w: tokens.merge(w.encode(), ranks), "array<int>")
    few = docs.select("doc_id", "text").limit(30)
    words = few.select("doc_id", F.posexplode(split(F.coalesce("text", F.lit(""))))).toDF("doc_id", "pos", "word")
    ids = words.select("word").distinct().withColumn("ids", merged("word"))
    table = spark.createDataFrame([(bytearray(k), v) for k, v in ranks.items()], "bytes binary, id int")
    flat = words.join(ids, "word").select("doc_id", "pos", F.posexplode("ids")).toDF("doc_id", "pos", "sub", "id").join(table, "id")
    whole = flat.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sub", "id", "bytes"))).alias("x"))
    want = sorted((r["doc_id"], tuple(x["id"] for x in r["x"]), b"".join(bytes(x["bytes"]) for x in r["x"])) for r in whole.collect())
    got = sorted((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in tokens.encode_decode(few.filter("length(text) > 0"), path, public_tokenizers.PATTERN).collect())
    assert got == want


# vectors


def test_bounds_cut_where_vectors_cluster():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 64))
    v = centres[rng.integers(0, 40, 4096)] + 0.15 * rng.normal(size=(4096, 64))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    index = vectors.GroupIndex.unpack(vectors.GroupIndex.build(np.arange(4096), v).pack())
    q = np.arange(0, 4096, 50)
    found, scored = vectors.search_group(index, q, v[q], np.full(len(q), np.iinfo(np.int64).min), 5)
    assert scored < 0.3 * len(q) * len(index.top)
    for i, at in enumerate(q[:20]):
        scores = v @ v[at]
        scores[at] = np.iinfo(np.int64).min
        assert [s for j, _, s in found if j == i] == sorted(scores.tolist(), reverse=True)[:5]


def test_groups_out_of_reach_are_never_met(spark):
    """Two far clusters: the batch of one never meets the groups of the other; a batch without a floor meets all."""
    rng = np.random.default_rng(2)
    rows = [(p, g, ub, [int(x) for x in (1000 if p else -1000) + rng.integers(-50, 50, 6)]) for ub, (p, g) in enumerate([(0, 0), (0, 1), (1, 2), (1, 3)]) for _ in range(20)]
    df = spark.createDataFrame(rows, "p int, g int, ub int, v array<long>")
    for floor, want in ((5_000_000, {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (2, 3), (3, 2), (3, 3)}), (np.iinfo(np.int64).min, {(b, g) for b in range(4) for g in range(4)})):
        floored = df.select("ub", F.lit(0).alias("b"), "v", F.lit(int(floor)).alias("floor"))
        assert {(r.ub, r.g) for r in vectors.meetings(df.select("p", "g", "v"), floored, 2).collect()} == want


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 330)]
    rows += [(350, [0.5] * 8), (350, [0.5] * 8), (400, None), (450, [0.1, None]), (451, [float("nan")] * 8), (452, [float("inf")] * 8), (None, [9.0] * 8), (453, []), (454, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.Counter(map(tuple, vectors.exact_top_k(df, F.col("vec_id") % 50 == 0, group_rows=30, batch_rows=3, pivots=4).collect()))
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = collections.Counter()
    for at, (q, v) in enumerate(usable):
        if q % 50 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for k, (i, w) in enumerate(usable) if k != at)[:5]
            want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(ranked))
    assert got == want
    assert vectors.exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert vectors.exact_top_k(df.filter("vec_id in (50, 51)"), F.col("vec_id") % 50 == 0).count() == 1


# shards


def test_shards(spark, docs, odd, none):
    out = sorted(map(tuple, shards.shard_by_bytes(docs).collect()), key=lambda r: r[0])
    size = sum(r[1] for r in out)
    for k in range(8):
        own = [r for r in out if r[3] == k]
        assert sorted(r[4] for r in own) == list(range(len(own)))
        assert abs(sum(r[1] for r in own) - size / 8) <= max(size / 64, max(r[1] for r in out))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r[1] == len(text[r[0]].encode()) + 1 and r[2] == zlib.crc32(text[r[0]].encode()) for r in out)
    groups = collections.defaultdict(set)
    for r in out:
        groups[text[r[0]]].add(r[3])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) < len(out)
    hot = spark.createDataFrame([(i, "copy" if i % 3 == 0 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    counts = collections.Counter(r["shard"] for r in shards.shard_by_bytes(hot, 8).collect())
    assert len(counts) == 8
    rows = shards.shard_by_bytes(odd, 3).collect()
    assert len(rows) == len(ODD) and {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert shards.shard_by_bytes(none).count() == 0


def test_hashes_do_not_depend_on_blocks():
    data = ["a b c d e f", "", "x", "a b c d e f g " * 50]
    raw = "".join(data).encode()
    offsets = np.cumsum([0, *(len(d.encode()) for d in data)])
    hashes, at = jaccard.shingle_sets(np.frombuffer(raw, np.uint8), offsets, 5)
    for i, d in enumerate(data):
        alone, _ = jaccard.shingle_sets(np.frombuffer(d.encode(), np.uint8), np.array([0, len(d.encode())]), 5)
        assert hashes[at[i] : at[i + 1]].tolist() == alone.tolist()
    assert hashlib.sha256(hashes.tobytes()).hexdigest() == hashlib.sha256(np.array(hashes).tobytes()).hexdigest()
