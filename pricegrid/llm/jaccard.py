"""Exact n-gram Jaccard join by set-relation skipping, and its components.

A document's set is its distinct word shingles. Equal sets are one set from the start. An index list holds the
sets in whose prefix a shingle stands; two sets that link share a shingle of their prefixes whatever the order
of the shingles, so long as it is the same for all sets. The order is by hash, with frequent shingles last:
that keeps lists short, and no choice of frequent shingles changes the result.

* Skipping in the index: lists are cut into blocks by size. From a set's position in a list, and from how many of the
  shingles before it no other component has, follows the largest size a partner may have, so the set goes to the
  blocks up to that size and to no other; the blocks beyond are skipped before any rows meet.
* Skipping of answers: each list has a leader, first the set with fewest shingles before, and sets are compared with
  the leaders they share most lists with. What links with a leader is in the leader's component, which answers all
  pairs within it; lists that lie in one component are skipped as a whole. Rounds of leaders go on while lists
  hold many pairs of sets in different components. Pairs that remain and were compared with the same leader get
  their answer from the leader's: the overlaps with it bound theirs from both sides, and often one bound decides.
  Of the others, first the best pairs of each two components are compared, which answers for all pairs of the two
  where one links, and then every pair of components that are still apart.

Sets are told apart by 128 bits: where two different sets have the same 64-bit fingerprint, a second one goes
into both. Shingles are 64-bit hashes. Texts are read three or four times and never shuffled; what travels are
packed prefixes (about a quarter of the hashes), lists that two sets or more share, and the full hash sets of
compared sets.

Defined results: a null or empty text, or one without words, has an empty set, size 0, and is linked with
nothing: its component is its own id. A text of fewer words than a shingle has one shingle, the whole
sequence. A null id takes part; the smallest id of a component ignores nulls and is null if there is no other.
Repeated rows are linked. An empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, numbered, release, tidy, utf8_buffers

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_PLACE = _BYTE[:64] * _STEP | _U(1)  # a factor for each place in a shingle
_LONG = 64
_BLOCK = 1 << 20  # bytes of text that are hashed at a time


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(raw: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each word: eight bytes at a time go into the state, which is mixed in between, so no word's letters can make up for
    each other as in a sum. Words of more than _LONG bytes, of which texts have few, are hashed one by one."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    state = _mix(length.astype(_U) * _STEP + _BYTE[0])
    at = np.flatnonzero(length <= _LONG)
    for k in range(0, _LONG, 8):
        at = at[length[at] > k]
        if not len(at):
            break
        left = np.minimum(length[at] - k, 8)
        piece = eight[starts[at] + k] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * left.astype(_U)))
        state[at] = _mix((state[at] ^ _mix(piece + _BYTE[1])) * _STEP + _BYTE[2])
    for i in np.flatnonzero(length > _LONG):
        state[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : starts[i] + length[i]].tobytes(), digest_size=8).digest(), "little")
    return state


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' distinct shingles, ascending within each text, and their offsets by text."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, _U), np.zeros(n + 1, np.int64)
    letter = ~_SPACE[raw]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(raw)]
    first[edges] = letter[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(n + 1, np.int64)
    last = letter.copy()
    last[:-1] &= ~letter[1:] | first[1:]
    word = _word_hashes(_LOWER[raw], starts, np.flatnonzero(last) + 1 - starts)

    first_word = np.searchsorted(starts, offsets)  # of each text, and the number of words
    count = np.diff(first_word)
    kinds = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    ends = np.cumsum(kinds)
    out = np.zeros(int(ends[-1]), _U)
    at = np.repeat(first_word[:-1] - (ends - kinds), kinds) + np.arange(len(out))
    full = np.repeat(count >= words, kinds)
    for j in range(words):
        out[full] += _mix(word[at[full] + j] + _U(j)) * _PLACE[j]
    for k in range(1, words):  # texts of k words: the whole sequence
        here = np.flatnonzero(count == k)
        if len(here):
            total = np.full(len(here), _U(k), _U)
            for j in range(k):
                total = _mix(total * _STEP + word[first_word[here] + j])
            out[(ends - kinds)[here]] = total
    out = _mix(out)
    begin = ends - kinds
    for a, b in zip(begin.tolist(), ends.tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[kinds > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], ends])]


def _set_hashes(hashes: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_mix(hashes * _STEP + _U(salt)))])
    return _mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(_U))


def _fingerprints(hashes: np.ndarray, offsets: np.ndarray, twins: np.ndarray) -> np.ndarray:
    """A hash of each set, as int64; sets whose hash is one of ``twins``, shared by different sets, get another."""
    fp = _set_hashes(hashes, offsets, 1)
    if len(twins):
        again = np.isin(fp.view(np.int64), twins)
        fp[again] = _mix(fp[again] ^ _set_hashes(hashes, offsets, 2)[again])
    return fp.view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, shingle hashes, offsets) of successive rows with about _BLOCK bytes of text in column ``text``."""
    for b in batches:
        raw, offsets = utf8_buffers(b.column(b.schema.get_field_index("text")))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _BLOCK, "right")) - 1)
            j = min(j, b.num_rows)
            yield b.slice(i, j - i), *shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
            i = j


@dataclass(frozen=True)
class Threshold:
    """Links when ``den`` * intersection >= ``num`` * union; whole numbers keep the test exact."""

    num: int = 75
    den: int = 100

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Length of the prefix of a set of size n: all but as many as every overlap surely exceeds."""
        return n - -(-self.num * n // self.den) + 1


def _heads(docs: DataFrame, words: int, twins: np.ndarray, local: int = 4) -> DataFrame:
    """Two kinds of rows. kind 0: id, size, fingerprint and check (a second fingerprint) of each document's set.
    kind 1: shingles (fp) that occur ``local`` times or more in a few million of a task's shingles, with that number (n)."""
    kind_of_id = docs.schema["id"].dataType.simpleString()
    names = ["id", "kind", "n", "fp", "check"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow_id = None
        held: list[np.ndarray] = []

        def frequent() -> pa.RecordBatch:
            every = np.concatenate(held)
            every.sort()
            at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            n = np.diff(np.append(at, len(every)))
            some = n >= local
            k = int(some.sum())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(k, arrow_id), pa.array(np.ones(k, np.int32)), pa.array(n[some].astype(np.int64)), pa.array(every[at[some]].view(np.int64)), pa.array(np.zeros(k, np.int64))],
                names=names,
            )

        for rows, hashes, offsets in _blocks(batches, words):
            arrow_id = rows.column(0).type
            k = rows.num_rows
            check = _set_hashes(hashes, offsets, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.zeros(k, np.int32)), pa.array(np.diff(offsets)), pa.array(_fingerprints(hashes, offsets, twins)), pa.array(check)],
                names=names,
            )
            held.append(hashes)
            if sum(map(len, held)) >= 1_000_000:
                yield frequent()
                held = []
        if held:
            yield frequent()

    return docs.mapInArrow(tidy(run), f"id {kind_of_id}, kind int, n long, fp long, check long")


def _index_lists(docs: DataFrame, words: int, limit: Threshold, hot: np.ndarray, twins: np.ndarray, buckets: int) -> DataFrame:
    """h, fp, n, pos: the entries of all index lists that two sets share, or whose shingle is frequent."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h, fp, n, pos, is_hot = (np.concatenate(c) for c in zip(*held, strict=True))
            # entries of a frequent shingle are dealt by set, those of any other by shingle
            bucket = np.where(is_hot, buckets + (fp.view(_U) % _U(buckets)).astype(np.int64), (h % _U(buckets)).astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(2 * buckets + 1))
            for k in range(2 * buckets):
                part = order[edges[k] : edges[k + 1]]
                if len(part):
                    sets, which = np.unique(fp[part], return_inverse=True)
                    size = np.zeros(len(sets), np.int32)
                    size[which] = n[part]
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array([k], pa.int32()), "h": [h[part].tobytes()], "pos": [pos[part].astype(np.int32).tobytes()],
                        "which": [which.astype(np.int32).tobytes()], "sets": [sets.tobytes()], "sizes": [size.tobytes()],
                    })

        for _, hashes, offsets in _blocks(batches, words):
            n = np.diff(offsets)
            if not len(hashes):
                continue
            fp = _fingerprints(hashes, offsets, twins)
            _, once = np.unique(fp, return_index=True)
            keep = np.zeros(len(n), bool)
            keep[once] = True
            size = np.repeat(n, n)
            spot = np.minimum(np.searchsorted(hot, hashes), max(0, len(hot) - 1))
            is_hot = hot[spot] == hashes if len(hot) else np.zeros(len(hashes), bool)
            # position in the order: the frequent ones after the others, by hash within both
            plain = np.cumsum(~is_hot)
            before = np.concatenate([[0], plain])[offsets[:-1]]
            n_plain = np.concatenate([[0], plain])[offsets[1:]] - before
            nth = np.arange(len(hashes)) - np.repeat(offsets[:-1], n)
            rank = plain - np.repeat(before, n)  # of plain ones so far, this one included
            pos = np.where(is_hot, np.repeat(n_plain, n) + nth - rank, rank - 1)
            pick = (pos < limit.prefix(size)) & np.repeat(keep, n)
            held.append((hashes[pick], np.repeat(fp, n)[pick], size[pick].astype(np.int32), pos[pick], is_hot[pick]))
            if sum(len(x[0]) for x in held) >= 500_000:
                yield from flush()
                held = []
        yield from flush()

    def lists(group: pa.Table) -> pa.Table:
        h, fp, n, pos = [], [], [], []
        for r in range(group.num_rows):
            raw = {c: group.column(c)[r].as_py() for c in ("h", "pos", "which", "sets", "sizes")}
            which = np.frombuffer(raw["which"], np.int32)
            h.append(np.frombuffer(raw["h"], _U))
            pos.append(np.frombuffer(raw["pos"], np.int32))
            fp.append(np.frombuffer(raw["sets"], np.int64)[which])
            n.append(np.frombuffer(raw["sizes"], np.int32)[which])
        h, fp, n, pos = (np.concatenate(x) for x in (h, fp, n, pos))
        order = np.lexsort((fp, h))
        h, fp, n, pos = h[order], fp[order], n[order], pos[order]
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (fp[1:] == fp[:-1])])
        h, fp, n, pos = h[~same], fp[~same], n[~same], pos[~same]
        if int(group.column("bucket")[0].as_py()) < buckets:
            again = h[1:] == h[:-1]
            shared = np.concatenate([again, [False]]) | np.concatenate([[False], again])
            h, fp, n, pos = h[shared], fp[shared], n[shared], pos[shared]
        release()
        return pa.table({"h": h.view(np.int64), "fp": fp, "n": n, "pos": pos})

    packed = docs.select("text").mapInArrow(tidy(pack), "bucket int, h binary, pos binary, which binary, sets binary, sizes binary")
    return packed.repartition(2 * buckets, "bucket").groupBy("bucket").applyInArrow(lists, "h long, fp long, n int, pos int")


def _bitmap(hashed: DataFrame, most_bits: int = 1 << 28) -> np.ndarray:
    """A bitmap (uint8) of the hashes in column ``h``: 16 bits or more for each, ``most_bits`` (32 MB) in all.

    It may say yes to other hashes as well. Beyond its largest size it says so more often: more rows travel, and
    the joins behind it still pick the right ones.
    """
    bits = 1 << 20
    n = hashed.count()
    while bits < min(16 * n, most_bits):
        bits *= 2
    at = hashed.select((F.pmod("h", F.lit(bits)) + 1).alias("at"))
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("flags"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():
        out[(r["chunk"] - 1) * 4096 : r["chunk"] * 4096] = np.frombuffer(r["flags"], np.uint8)
    return out


def _marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which int64 hashes the bitmap has."""
    bit = np.mod(hashes, np.int64(len(bitmap) * 8))
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _compared(pairs: DataFrame, docs: DataFrame, own: DataFrame, words: int, twins: np.ndarray) -> DataFrame:
    """a, b, n_a, n_b, shared: the pairs of sets with their sizes and the size of their intersection.

    One document for each needed set is read again; a bitmap of their ids' hashes spares the others' shingles.
    """
    needed = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    one = own.join(needed, "fp", "left_semi").groupBy("fp").agg(F.min("id").alias("id"))
    bitmap = _bitmap(cut(one.select(F.xxhash64("id").alias("h"))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = pa.array(_marked(bitmap, b.column(0).to_numpy()))
            for _, hashes, offsets in _blocks(iter([b.filter(wanted)]), words):
                fp = _fingerprints(hashes, offsets, twins)
                _, once = np.unique(fp, return_index=True)
                full = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))
                pick = pa.array([i for i in once if offsets[i + 1] > offsets[i]], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(fp).take(pick), full.take(pick)], names=["fp", "hashes"])

    every = docs.select(F.xxhash64("id").alias("h"), "text").mapInArrow(tidy(sets), "fp long, hashes array<long>")
    full = every.join(needed, "fp", "left_semi").groupBy("fp").agg(F.first("hashes").alias("hashes"))
    left = pairs.select("a", "b").join(full.select(F.col("fp").alias("a"), F.col("hashes").alias("set_a")), "a")
    both = left.join(full.select(F.col("fp").alias("b"), F.col("hashes").alias("set_b")), "b")
    sizes = [F.size("set_a").cast("long").alias("n_a"), F.size("set_b").cast("long").alias("n_b")]
    return both.select("a", "b", *sizes, F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("shared"))


def _links(compared: DataFrame, limit: Threshold) -> DataFrame:
    return compared.filter(F.col("shared") * limit.den >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * limit.num)


def connected(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of the graph of links (a, b), by alternating stars."""
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        near = edges.unionByName(turned)
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    limit: Threshold = Threshold(),
    star_rounds: int = 2,
    most_rounds: int = 12,
) -> DataFrame:
    """``docs`` -> id, n_shingles long, component_id, fingerprint long (of the set), root long; one row for each input row.

    ``root`` tells components apart also where ids repeat or are null: the fingerprint of one of the component's sets.
    After ``star_rounds`` rounds of leaders, further ones (``most_rounds`` in all) follow while lists hold many pairs
    and a round takes a quarter of them away; how many there are changes the work, not the result.
    """
    return _components(docs, id_col, text_col, words, limit, star_rounds, most_rounds)[0]


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, limit: Threshold, star_rounds: int = 2, most_rounds: int = 12) -> tuple[DataFrame, np.ndarray]:
    """What ``jaccard_components`` returns, and the fingerprints that different sets share."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    twins = np.zeros(0, np.int64)
    heads = cut(_heads(rows, words, twins))
    own = heads.filter("kind = 0").select("id", "n", "fp", "check")
    # different sets of one fingerprint: a few among ten thousand million
    alike = own.groupBy("fp").agg(F.min("check").alias("x"), F.max("check").alias("y")).filter("x < y").select("fp").collect()
    if alike:
        twins = np.array([r["fp"] for r in alike], np.int64)
        heads = cut(_heads(rows, words, twins))
        own = heads.filter("kind = 0").select("id", "n", "fp", "check")
    total = own.agg(F.sum("n").alias("n")).first()["n"] or 0
    # at most total / least = 2**20 shingles can be that frequent
    least = max(64, total >> 20)
    frequent = heads.filter("kind = 1").groupBy("fp").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("fp")
    hot = np.sort(np.array([r["fp"] for r in frequent.collect()], np.int64).view(_U))
    lists = cut(_index_lists(rows, words, limit, hot, twins, max(1, math.ceil(total / 4 / 1_000_000))))

    roots, compared, before, turn = None, None, math.inf, 0
    while True:
        board = cut(_leaders(_placed(lists, roots), turn))
        cost = board.agg(F.sum("entries").alias("entries"), F.sum("pairs").alias("pairs")).first()
        if not cost["entries"]:  # each list lies in one component: all is answered
            return _labelled(own, roots, id_col), twins
        if turn >= most_rounds or turn >= star_rounds and (cost["pairs"] <= 16 * cost["entries"] or cost["pairs"] > 0.75 * before):
            break
        before = cost["pairs"]
        pairs = cut(_with_leaders(_placed(lists, roots), board, compared, limit))
        found = cut(_compared(pairs, rows, own, words, twins))
        roots = _merged(roots, _links(found, limit))
        compared = found if compared is None else cut(compared.unionByName(found))
        turn += 1

    anchored = _anchored(_placed(lists, roots).join(board.select("h"), "h", "left_semi"), compared)
    left = cut(_remaining_pairs(anchored, limit))
    # of each two components the pairs that are sure to link or share most first, one of each of eight classes by
    # hash: where one links, that answers all their pairs
    low, high = F.least("comp_a", "comp_b").alias("low"), F.greatest("comp_a", "comp_b").alias("high")
    best = cut(left.groupBy(low, high, F.pmod(F.xxhash64("a", "b"), F.lit(8)).alias("class")).agg(F.max(F.struct("sure", "k", "a", "b")).alias("best")))
    asked = cut(best.filter("not best.sure").select("best.a", "best.b"))
    answered = cut(best.filter("best.sure").select("best.a", "best.b").unionByName(_links(_compared(asked, rows, own, words, twins), limit).select("a", "b")))
    ends = answered.join(best.select("best.a", "best.b", "low", "high"), ["a", "b"]).select(F.col("low").alias("a"), F.col("high").alias("b"))
    top = connected(ends)
    two = best.select("low", "high").join(top.select(F.col("node").alias("low"), F.col("root").alias("x")), "low", "left").join(
        top.select(F.col("node").alias("high"), F.col("root").alias("y")), "high", "left"
    )
    apart = two.filter(F.coalesce("x", "low") != F.coalesce("y", "high")).select("low", "high").distinct()
    rest = cut(left.filter("not sure").select("a", "b", low, high).join(apart, ["low", "high"], "left_semi").select("a", "b"))
    roots = _merged(roots, answered)
    roots = _merged(roots, _links(_compared(rest, rows, own, words, twins), limit))
    return _labelled(own, roots, id_col), twins


def _labelled(own: DataFrame, roots: DataFrame | None, id_col: str) -> DataFrame:
    """Every row of ``own`` with its component, found set by set before it is joined to rows; no join has an aggregate
    of the same key below it, so that a component or a set with a third of all rows can be split."""
    sets = own.filter("n > 0").groupBy("fp").agg(F.min("id").alias("first"))
    if roots is not None:  # a root has no row of its own among the nodes
        sets = sets.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        sets = cut(sets)
        ids = cut(sets.groupBy("root").agg(F.min("first").alias("component_id")))
        of_set = cut(sets.join(ids, "root").select("fp", "root", "component_id"))
    else:
        of_set = cut(sets.select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id")))
    linked = own.filter("n > 0").join(of_set, "fp").select("id", "n", "component_id", "fp", "root")
    alone = own.filter("n = 0").select("id", "n", F.col("id").alias("component_id"), "fp", F.col("fp").alias("root"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("fp").alias("fingerprint"), "root")


def _placed(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The lists' entries with the component of each set."""
    if roots is None:
        return lists.withColumn("comp", F.col("fp"))
    known = lists.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return known.withColumn("comp", F.coalesce("root", "fp")).drop("root")


def _leaders(placed: DataFrame, turn: int) -> DataFrame:
    """h, lead (a, n_a, comp_a), entries, pairs: for each list that lies in several components its leader, and how many
    pairs of its entries lie in different components.

    At first the leader is the set with fewest shingles before this one: among copies with changes of their own, whose
    rare shingles stand first, the one that was changed least. Later turns try others, by a hash.
    """
    first = F.col("pos") if turn == 0 else F.lit(0)
    lead = F.min(F.struct(first.alias("before"), F.xxhash64("fp", F.lit(turn)).alias("r"), F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a")))
    by_comp = placed.groupBy("h", "comp").agg(F.count("*").alias("k"), lead.alias("lead"))
    n = F.sum("k")
    board = by_comp.groupBy("h").agg(F.count("*").alias("comps"), n.alias("entries"), ((n * n - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"), F.min("lead").alias("lead"))
    return board.filter("comps > 1").select("h", "lead.a", "lead.n_a", "lead.comp_a", "entries", "pairs")


def _with_leaders(placed: DataFrame, board: DataFrame, compared: DataFrame | None, limit: Threshold, near: int = 2) -> DataFrame:
    """a, b: the ``near`` leaders in other components that a set shares most lists with and was not compared with; those
    of a twentieth of its shingles at least, else the last turns see to it."""
    met = placed.join(board, "h").filter("comp <> comp_a")
    met = met.filter((F.least("n", "n_a") * limit.den) >= F.greatest("n", "n_a") * limit.num)
    found = met.groupBy(F.col("fp").alias("b"), "a").agg(F.count("*").alias("k"), F.first("n").alias("n")).filter(F.col("k") * 20 >= F.col("n"))
    if compared is not None:
        found = found.join(compared.select("a", "b"), ["a", "b"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("k"), "a"))  # no more rows than a set has lists
    return found.withColumn("nth", nth).filter(F.col("nth") <= near).select("a", "b")


def _anchored(placed: DataFrame, compared: DataFrame | None) -> DataFrame:
    """Adds lead, n_lead and held: the leader that a set was compared with and shares most with, its size, the overlap."""
    if compared is None:
        return placed.select("*", *[F.lit(None).cast("long").alias(c) for c in ("lead", "n_lead", "held")])
    most = compared.groupBy(F.col("b").alias("fp")).agg(F.max(F.struct("shared", "a", "n_a")).alias("m"))
    return placed.join(most.select("fp", F.col("m.a").alias("lead"), F.col("m.n_a").alias("n_lead"), F.col("m.shared").alias("held")), "fp", "left")


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, root after more links between sets."""
    if roots is None:
        return connected(links)
    a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    found = connected(between)
    moved = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    moved = moved.select("node", F.coalesce("top", "root").alias("root"))
    return cut(moved.unionByName(found.join(moved.select("node"), "node", "left_anti")))


def _ceil(value: Column, by: int) -> Column:
    return F.call_function("div", value + (by - 1), F.lit(by))


def _remaining_pairs(entries: DataFrame, limit: Threshold, blocks: int = 3) -> DataFrame:
    """a, b, comp_a, comp_b, k, sure: all pairs of sets in different components that share enough of their prefixes to
    link; ``sure`` where the overlaps with a common leader already say that they do.

    Two sets that link share ``need`` shingles at least, so behind the first m + 1 that they share, need - m - 1 more
    must follow in both: these stand no later than n - need + m. Shingles whose list lies in one component are dead for
    pairs of two; as none of the first m + 1 is dead, no more than n - need dead ones stand before any of them. As need
    grows with the partner's size, both bound that size. Lists are cut into blocks by the logarithm of the size,
    ``blocks`` for each step of den / num; the smaller set of a pair goes to the blocks from its own to that of its
    bound, the larger one to its own, there to sets of smaller blocks alone if its bound says so, and blocks beyond
    the bound are skipped. A pair must meet m + 1 times. A larger m reads more entries and leaves fewer pairs; it is
    as large as the prefixes allow, a twentieth of the set at most.
    """
    num, den = limit.num, limit.den
    div = lambda value, by: F.call_function("div", value, F.lit(by))

    def block(size: Column) -> Column:
        return F.floor(F.log(size.cast("double")) / (math.log(den / num) / blocks) + 1e-9).cast("int")

    n, pos = F.col("n").cast("long"), F.col("pos").cast("long")
    alive = F.row_number().over(Window.partitionBy("fp").orderBy("pos")) - 1  # no more rows than a set has lists
    rows = entries.select("h", "fp", n.alias("n"), pos.alias("pos"), "comp", "lead", "n_lead", "held", (pos - alive).alias("dead"))
    n, pos, dead = F.col("n"), F.col("pos"), F.col("dead")

    def largest(shared: Column) -> Column:
        """The largest partner with which a set of size n may need no more than ``shared``."""
        return div(shared * (num + den), num) - n

    rows = rows.withColumn("most", F.least(largest(n - pos + div(n, 20)), largest(n - dead)))
    width = F.least(div(n * den, num), F.col("most"))
    small = rows.filter(width >= n).select(
        "h", F.explode(F.sequence(block(n), block(width))).alias("block"), block(n).alias("home"),
        *[F.col(c).alias(f"{c}_a") for c in ("n", "pos", "dead", "comp", "lead", "held")], F.col("fp").alias("a"), "n_lead",
    ).withColumn("own", F.col("block") == F.col("home")).drop("home")
    within = F.when(block(F.greatest(F.least(F.col("most"), n), F.lit(1))) == block(n), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    large = rows.withColumn("most", largest(n - dead)).select(
        "h", block(n).alias("block"), F.explode(within).alias("own"), *[F.col(c).alias(f"{c}_b") for c in ("n", "pos", "dead", "comp", "lead", "held")], F.col("fp").alias("b")
    )

    need = _ceil((F.col("n_a") + F.col("n_b")) * num, num + den)
    m = F.least(div(F.col("n_a"), 20), need - _ceil(F.col("n_b") * num, den))
    same_lead = F.coalesce(F.col("lead_a") == F.col("lead_b"), F.lit(False))
    bound = F.least("held_a", "held_b") + F.least(F.col("n_a") - F.col("held_a"), F.col("n_b") - F.col("held_b"))
    fits = (
        (F.col("comp_a") != F.col("comp_b"))
        & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
        & (F.col("n_a") * den >= F.col("n_b") * num)
        & (F.col("pos_a") <= F.col("n_a") - need + m)
        & (F.col("pos_b") <= F.col("n_b") - need + m)
        & (F.col("dead_a") <= F.col("n_a") - need)
        & (F.col("dead_b") <= F.col("n_b") - need)
        & (~same_lead | (bound >= need))
    )
    met = small.join(large, (small["h"] == large["h"]) & (small["block"] == large["block"]) & (small["own"] == large["own"]) & fits)
    sure = F.coalesce(same_lead & (F.col("held_a") + F.col("held_b") - F.col("n_lead") >= need), F.lit(False))
    counted = met.groupBy("a", "b").agg(F.count("*").alias("k"), *[F.first(c).alias(c) for c in ("n_a", "n_b", "comp_a", "comp_b")], F.first(sure).alias("sure"))
    return counted.filter(F.col("k") > m).select("a", "b", "comp_a", "comp_b", "k", "sure")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, limit: Threshold = Threshold(), few: int = 1 << 20) -> DataFrame:
    """``docs`` without all but one document of each component, the one with the smallest id; columns as they were.

    Rows without words are not alike and all stay. Null ids come last; of rows with the same id and set one stays.
    Where an id occurs with texts of several components, each component keeps one of its own.

    Most rows are judged by their id. Ids with something to drop, and ids that occur more than once, are the only
    ones to look at: up to ``few`` of them are broadcast (some MB), so that no text is shuffled but those of repeated
    ids; more meet the documents in a join.
    """
    parts, twins = _components(docs, id_col, text_col, words, limit)
    found = cut(parts.select(F.col(id_col).alias("id"), "n_shingles", F.col("fingerprint").alias("fp"), "root"))
    worded = found.filter("n_shingles > 0")
    first = F.struct(F.col("id").isNull().alias("null"), "id", "fp")
    # components, not their ids: several can have the same component_id where ids repeat, or a null one
    keep = cut(worded.groupBy("root").agg(F.min(first).alias("first")).select("first.id", "first.fp"))
    uses = found.select("id", F.lit(1).alias("rows"), F.lit(0).alias("kept")).unionByName(keep.select("id", F.lit(0).alias("rows"), F.lit(1).alias("kept")))
    uses = uses.unionByName(found.filter("n_shingles = 0").select("id", F.lit(0).alias("rows"), F.lit(1).alias("kept")))
    odd = cut(uses.filter("id is not null").groupBy("id").agg(F.sum("rows").alias("rows"), F.sum("kept").alias("kept")).filter("rows > 1 or kept = 0").select("id", (F.col("rows") > 1).alias("repeated")))
    rows, names = numbered(docs)
    at = F.col(f"c{names.index(id_col)}")

    def against(ids: DataFrame, how: str) -> DataFrame:
        ids = ids.select(F.col("id").alias("odd_id"))
        return rows.join(F.broadcast(ids) if n_odd <= few else ids, at == F.col("odd_id"), how)  # the size is checked

    n_odd = odd.count()
    plain = against(odd, "left_anti").filter(at.isNotNull())
    again = against(odd.filter("repeated"), "left_semi").unionByName(rows.filter(at.isNull()))
    text_at = names.index(text_col)

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, hashes, offsets in _blocks(iter([b.append_column("text", b.column(text_at))]), words):
                fp = _fingerprints(hashes, offsets, twins)
                columns = [part.column(i) for i in range(b.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(fp), pa.array(np.diff(offsets) > 0)], names=[*b.schema.names, "fp", "worded"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    marked = again.mapInArrow(tidy(fingerprint), f"{ddl}, fp long, worded boolean")
    keep = keep.select(F.col("id").alias("keep_id"), F.col("fp").alias("keep_fp"))
    kept = marked.filter("worded").join(keep, at.eqNullSafe(F.col("keep_id")) & (F.col("fp") == F.col("keep_fp")), "left_semi")
    one = kept.groupBy(at.alias("id"), "fp").agg(F.first(F.struct(*rows.columns)).alias("row")).select("row.*")
    out = plain.unionByName(one).unionByName(marked.filter("not worded").select(*rows.columns))
    return out.toDF(*names)
