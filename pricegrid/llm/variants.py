"""Spelling variants by two-dimensional range reporting on wavelet trees.

Words are near if they differ by exactly one inserted, deleted or replaced code point. Of all words of one length, take the
forward order and the order of the reversed words: the words that begin with w[:i] are an interval of the first, those that end
with a suffix of w one of the second, and the points in both intervals are exactly the words that differ from w at
position i. A wavelet tree over the permutation between the two orders reports these points. Replacements ask among
words of equal length, insertions among those one longer (where the inserted letter follows an equal one, only the first of its
places counts), so every near pair is reported once, and deletions are the same pairs read the other way round.

An edit leaves one half of a word as it is, so words meet in keys: the length asked for, a range of edit positions, and what
lies outside this range. Keys are dealt over blocks of bounded size by a hash, each block builds its trees and answers its own
words. A key with too many letters is split: halving its range of positions adds to what lies outside, and a range of
one position leaves at most one word for each letter. No word ever meets all words of a frequent beginning.

Words and their counts come from one aggregate over the runs of letters; only words travel afterwards, and of near words each
block sends on a word's number of near ones and the best of them.

Defined results: a null text has no runs; a null id stands for an empty one in the hash; repeated rows count again; a run is as
long as the text has it. Ties go to the smallest word in code-point order. Frequencies rise at least ``ratio`` times from a word
to its form, so following forms always ends. An empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release

LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str, text_col: str, least_letters: int, least_count: int, one_in: int) -> DataFrame:
    """word, n: the runs of letters in lower case (A-Z alone); where ``one_in`` divides h = crc32("<id>:<run>"), without the letter at h % length."""
    runs = docs.select(
        F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("id"),
        # a run that is too short can't become a word; greedy matches from a run's start are whole runs
        F.explode(F.regexp_extract_all(text_col, F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))).alias("run"),
    )
    ascii_only = F.octet_length("run") == F.length("run")
    lowered = runs.select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))
    hashed = lowered.withColumn("h", F.crc32(F.concat("id", "run").cast("binary")))
    at = F.expr("cast(h % length(run) as int)")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.expr("substring(run, cast(h % length(run) as int) + 2)"))
    word = F.when(F.col("h") % one_in == 0, short).otherwise(F.col("run"))
    kept = hashed.select(word.alias("word")).filter(F.length("word") >= least_letters)
    return kept.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


class WaveletTree:
    """A permutation of 0 .. m-1 by the bits of its values from the highest: for each level, how many zeros stand before each place."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = max(1, int(len(values) - 1).bit_length()) if len(values) else 0
        self.zeros: list[np.ndarray] = []
        for bit in range(self.levels - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            values = np.concatenate([values[zero], values[~zero]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values from c to d - 1 at places from a to b - 1, of many queries at a time.

        A node lives on while it holds a place of the query's and its values meet the query's range, so the work follows the reports.
        """
        q, left, right, value = np.arange(len(a)), a, b, np.zeros(len(a), np.int64)
        for k, before in enumerate(self.zeros):
            bit, ones = self.levels - 1 - k, before[-1]
            zl, zr = before[left], before[right]
            q, value = np.concatenate([q, q]), np.concatenate([value, value | (1 << bit)])
            left, right = np.concatenate([zl, ones + left - zl]), np.concatenate([zr, ones + right - zr])
            live = (left < right) & (value < d[q]) & (value + (1 << bit) > c[q])
            q, value, left, right = q[live], value[live], left[live], right[live]
        return q, value


_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[192:256] = np.arange(27, 91)


def _codes(words: list[str], length: int) -> np.ndarray:
    return _CODE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)].reshape(len(words), length)


def _order(m: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(m).view(f"S{m.shape[1]}").ravel().argsort(kind="stable")


def narrowing(ordered: np.ndarray, queries: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For lengths 0, 1, ...: the queries whose first letters begin ``least`` rows or more, and the interval of these rows.

    Rows that begin alike stand together and are ordered by the next letter, so the next interval is a binary search on
    (begin of the present one, next letter); ends when no query is left.
    """
    m, depth = len(ordered), queries.shape[1]
    who = np.arange(len(queries))
    left, right = np.zeros(len(who), np.int64), np.full(len(who), m, np.int64)
    begin, place = np.zeros(m, np.int64), np.arange(m)
    for i in range(depth + 1):
        ok = right - left >= least[who]
        who, left, right = who[ok], left[ok], right[ok]
        yield who, left, right
        if not len(who) or i == depth:
            return
        keys = begin * 128 + ordered[:, i]
        wanted = left * 128 + queries[who, i]
        left, right = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        new = np.ones(m, bool)
        new[1:] = keys[1:] != keys[:-1]
        begin = np.maximum.accumulate(np.where(new, place, 0))


def near_pairs(same: list[str], shorter: list[str], length: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): words a near words b. b counts in ``same`` (words of ``length``); a too if less than its size, else a - its size counts in
    ``shorter`` (words of one letter less). Edits at positions from ``low`` to ``high`` - 1 of the longer word only."""
    none = np.zeros(0, np.int64)
    if not same:
        return none, none
    x = _codes(same, length)
    short = _codes(shorter, length - 1)
    forward, backward = _order(x), _order(x[:, ::-1])
    rank = np.empty(len(x), np.int64)
    rank[backward] = np.arange(len(x))
    tree = WaveletTree(rank[forward])
    # queries: the words themselves, whose intervals hold them, and the shorter ones; a column of zeros pads the latter at the unused end
    least = np.concatenate([np.full(len(x), 2), np.full(len(short), 1)])
    pad = np.zeros((len(short), 1), np.uint8)
    heads = np.concatenate([x, np.concatenate([short, pad], 1)])
    tails = np.concatenate([x[:, ::-1], np.concatenate([short[:, ::-1], pad], 1)])
    front = {}
    for i, found in enumerate(narrowing(x[forward], heads[:, : length - 1], least)):
        if i >= high:
            break
        if i >= low:
            front[i] = found
    out_a, out_b = [], []

    def flush(held: list[tuple[np.ndarray, ...]]) -> None:
        who, i, a, b, c, d = (np.concatenate(v) for v in zip(*held, strict=True))
        q, value = tree.report(a, b, c, d)
        one, two = who[q], backward[value]
        fresh = np.ones(len(one), bool)
        is_short = one >= len(x)
        fresh[~is_short] = one[~is_short] != two[~is_short]
        at = i[q]
        check = is_short & (at > 0)
        fresh[check] = x[two[check], at[check]] != short[one[check] - len(x), at[check] - 1]
        out_a.append(one[fresh])
        out_b.append(two[fresh])

    held, size = [], 0
    for s, (who, c, d) in enumerate(narrowing(x[backward][:, ::-1], tails[:, : length - 1], least)):
        i = length - 1 - s  # what stands behind the position has s letters
        if i < low:
            break
        if i not in front:
            continue
        both, p, q = np.intersect1d(front[i][0], who, assume_unique=True, return_indices=True)
        if len(both):
            held.append((both, np.full(len(both), i), front[i][1][p], front[i][2][p], c[q], d[q]))
            size += len(both)
        if size >= 200_000:
            flush(held)
            held, size = [], 0
    if held:
        flush(held)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _answer(part: pa.Table) -> pa.Table:
    """A block's words with how many near ones it found for each, and the best of them."""
    words, n = part.column("word").to_pylist(), part.column("n").to_numpy()
    length, shorter, low, high = (part.column(c).to_numpy(zero_copy_only=False) for c in ("length", "shorter", "low", "high"))
    group = np.lexsort((shorter, high, low, length))
    edges = np.flatnonzero(np.any([c[group][1:] != c[group][:-1] for c in (length, low, high)], axis=0)) + 1
    ones, twos = [], []
    for rows in np.split(group, edges):
        same, other = rows[~shorter[rows]], rows[shorter[rows]]
        a, b = near_pairs([words[r] for r in same], [words[r] for r in other], int(length[rows[0]]), int(low[rows[0]]), int(high[rows[0]]))
        every = np.concatenate([same, other])
        back = a >= len(same)  # a shorter word and the longer one are near each other; equal lengths report both ways themselves
        ones += [every[a], same[b[back]]]
        twos += [same[b], every[a[back]]]
    one, two = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (ones, twos))
    names, which = np.unique(np.array(words, object), return_inverse=True)
    one_word, two_word = which[one], which[two]
    order = np.lexsort((two_word, -n[two], one_word))
    one, two, one_word = one[order], two[order], one_word[order]
    first = np.flatnonzero(np.concatenate([[True], one_word[1:] != one_word[:-1]])) if len(one) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(one)))
    out = pa.table({"word": pa.array([words[r] for r in one[first]], pa.string()), "n_near": pa.array(many.astype(np.int64)), "best_n": pa.array(n[two[first]].astype(np.int64)), "best": pa.array([words[r] for r in two[first]], pa.string())})
    release()
    return out


def _keyed(rows: DataFrame) -> DataFrame:
    """With the key: length, range of positions and what lies outside; a shorter word lacks the letter at an edit."""
    behind = F.expr("substring(word, high + 1 - cast(shorter as int))")
    return rows.withColumn("key", F.xxhash64("length", "low", "high", F.expr("substring(word, 1, low)"), behind))


def _halves(low: Column, high: Column) -> Column:
    middle = F.floor((low + high) / 2).cast("int")
    return F.explode(F.array(F.struct(low.alias("low"), middle.alias("high")), F.struct(middle.alias("low"), high.alias("high"))))


def near_words(words: DataFrame, block_bytes: int = 4 << 20, key_bytes: int = 1 << 20) -> DataFrame:
    """``words`` (word, n) -> word, n_near, best_n, best: the near words' number, and the most frequent of them (ties: the smallest).

    A word stands in several rows, one for each block that found some; they add up.
    """
    roles = F.explode(F.array(F.lit(False), F.lit(True)))
    asked = words.select("word", "n", roles.alias("shorter")).withColumn("length", F.length("word") + F.col("shorter").cast("int"))
    halves = asked.withColumn("r", _halves(F.lit(0), F.col("length"))).select("word", "n", "shorter", "length", "r.low", "r.high")
    done, open_ = None, _keyed(halves)
    while True:
        heavy = cut(open_.filter("high - low > 1").groupBy("key").agg(F.sum(F.length("word")).alias("bytes")).filter(F.col("bytes") > key_bytes).select("key"))
        if heavy.isEmpty():
            break
        light = open_.join(heavy, "key", "left_anti")
        done = light if done is None else done.unionByName(light)
        split = open_.join(heavy, "key", "left_semi").drop("key").withColumn("r", _halves(F.col("low"), F.col("high"))).drop("low", "high").select("*", "r.low", "r.high").drop("r")
        open_ = cut(_keyed(split))
    every = open_ if done is None else done.unionByName(open_)
    total = words.agg(F.sum(F.octet_length("word")).alias("bytes")).first()["bytes"] or 0
    blocks = int(total * 4 // block_bytes) + 1
    block = F.pmod("key", F.lit(blocks)).alias("block")
    dealt = every.select(block, "word", "n", "length", "shorter", "low", "high")
    return dealt.groupBy("block").applyInArrow(lambda part: _answer(part), "word string, n_near long, best_n long, best string")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form: as long as some root has a form itself, every root is replaced by that one's root."""
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = cut(state.select("word", "root").join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if state.filter("moved").isEmpty():
            return state.select("word", "root")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 6, least_count: int = 5, ratio: int = 5, one_in: int = 199
) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of ``docs``."""
    words = cut(word_counts(docs, id_col, text_col, least_letters, least_count, one_in))
    none = lambda t: F.lit(None).cast(t)
    rows = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none("long").alias("best_n"), none("string").alias("best"))
    found = near_words(words).select("word", none("long").alias("n"), "n_near", "best_n", "best")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    told = rows.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    takes = -F.col("b.less") >= ratio * F.col("n")
    formed = cut(told.select("word", "n", "n_near", F.when(takes, F.col("b.best")).alias("form"), F.when(takes, -F.col("b.less")).alias("form_n")))
    roots = _roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
