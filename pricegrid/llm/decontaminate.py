"""Benchmark decontamination by pigeonhole edit matching.

Test items and texts are normalised (lower case, runs of anything but letters and digits become one space).
A long item is matched in segments of near-equal length, so that a partial leak is found too. A segment of n
characters may occur with floor(error_rate * n) = e edits. It is split into e + 1 pieces: in any such
occurrence one piece at least is intact. One Aho-Corasick automaton finds all pieces of all segments in a
text; each hit fixes a window of the text, in which Myers' bit-parallel algorithm computes the least edit
distance of the segment to any substring. A segment with an error budget may match inside words; the distance
decides.

The benchmark is small beside the documents: its items go through the driver in slices of about ``slice_bytes`` (4 MB,
some 40 MB of automaton in a task), one pass over the texts for each slice. What a task holds doesn't grow with the
benchmark; what the driver holds and the number of passes do. Texts are never shuffled.

Defined results: null and empty texts hold nothing; null items and items without letter or digit match
nothing; items too short for an error must occur exactly, as whole words; repeated documents and repeated
items are reported each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, tidy

_WORDS = re.compile(r"[^\W_]+")
_ASCII = "".join(chr(i).lower() if chr(i).isalnum() else " " for i in range(128))


def normalise(text: str) -> str:
    if text.isascii():  # the same by a table
        return " ".join(text.translate(_ASCII).split())
    return " ".join(_WORDS.findall(text.lower()))


@dataclass(frozen=True)
class Segment:
    item: int
    text: str
    budget: int

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): budget + 1 pieces that cover the segment."""
        n, k = len(self.text), self.budget + 1
        edges = [i * n // k for i in range(k + 1)]
        return [(a, self.text[a:b]) for a, b in zip(edges, edges[1:], strict=False)]

    def masks(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, c in enumerate(self.text):
            out[c] = out.get(c, 0) | 1 << i
        return out


def segments(item: int, text: str | None, longest: int, error_rate: float) -> list[Segment]:
    text = normalise(text or "")
    if not text:
        return []
    count = -(-len(text) // longest)
    edges = [0] + [e if e > 0 else i * len(text) // count for i in range(1, count) for e in [text.rfind(" ", 0, i * len(text) // count + 1)]] + [len(text)]
    parts = [text[a:b].strip() for a, b in zip(edges, edges[1:], strict=False)]
    return [Segment(item, p, int(error_rate * len(p))) for p in parts if p]


def best_distance(masks: dict[str, int], n: int, window: str, budget: int) -> tuple[int, int] | None:
    """(distance, end in the window) of the best occurrence within the budget (Myers 1999), or None."""
    ones, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = ones, 0, n
    best, end = budget + 1, 0
    for j, c in enumerate(window):
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = (((x & plus) + plus) ^ plus) | x
        hp = minus | (~(d0 | plus) & ones)
        hn = plus & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & ones
        hn = (hn << 1) & ones
        plus = hn | (~(d0 | hp) & ones)
        minus = hp & d0
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= budget else None


class PieceIndex:
    """The automaton over the pieces of a slice of segments."""

    def __init__(self, parts: list[Segment]):
        import ahocorasick

        self.parts, self.masks = parts, [s.masks() for s in parts]
        self.auto = ahocorasick.Automaton()
        uses: dict[str, list[tuple[int, int]]] = {}
        for i, s in enumerate(parts):
            for offset, piece in s.pieces():
                uses.setdefault(piece, []).append((i, offset))
        for piece, where in uses.items():
            self.auto.add_word(piece, (len(piece), where))
        if uses:
            self.auto.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """item -> (least distance, start of the first best match) in a normalised text."""
        found: dict[int, tuple[int, int]] = {}
        # the place verified in each block of half a budget of a segment's diagonals; there is one at most
        seen: dict[int, int] = {}
        every = len(self.parts)
        if not len(self.auto) or not text:
            return found
        for last, (length, where) in self.auto.iter(text):
            start = last + 1 - length
            for i, offset in where:
                s = self.parts[i]
                if s.item in found and not found[s.item][0]:
                    continue  # nothing is nearer
                at, slack = start - offset, s.budget
                near = slack // 2
                block = at // (near + 1) * every + i
                if block in seen or abs(at - seen.get(block - every, -10**9)) <= near or abs(at - seen.get(block + every, -10**9)) <= near:
                    continue
                seen[block] = at
                # half the budget more on each side, as hits on near diagonals are not verified again
                low, high = max(0, at - slack - slack // 2), at + len(s.text) + slack + slack // 2
                if slack == 0:
                    whole = text.startswith(s.text, at) if at >= 0 else False
                    edges = (at == 0 or text[at - 1] == " ") and (at + len(s.text) == len(text) or text[at + len(s.text) : at + len(s.text) + 1] == " ")
                    hit = (0, len(s.text)) if whole and edges else None
                    low = max(0, at)
                else:
                    hit = best_distance(self.masks[i], len(s.text), text[low:high], s.budget)
                if hit is not None and (s.item not in found or hit[0] < found[s.item][0]):
                    found[s.item] = (hit[0], max(0, low + hit[1] - len(s.text)))
        return found


def _slices(benchmark: DataFrame, item_col: str, text_col: str, slice_bytes: int) -> tuple[DataFrame, int]:
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    return items, int(total // slice_bytes) + 1


def _slice(items: DataFrame, k: int, of: int, longest: int, error_rate: float) -> tuple[list, list[Segment]]:
    """The items of slice k, about slice_bytes of text, and their segments (an item is its position in the list)."""
    own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(of)) == k).collect()
    return [r["item"] for r in own], [s for i, r in enumerate(own) for s in segments(i, r["text"], longest, error_rate)]


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    error_rate: float = 0.08,
    longest: int = 160,
    slice_bytes: int = 4 << 20,
) -> DataFrame:
    """-> id, item, distance int, match_start long: one row for each document and item that it holds.

    ``match_start`` counts characters of the normalised text.
    """
    items, slices = _slices(benchmark, item_col, item_text_col, slice_bytes)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema.fields, *items.schema.fields]}

    def search(k: int) -> DataFrame:
        names, parts = _slice(items, k, slices, longest, error_rate)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = PieceIndex(parts)
            for b in batches:
                at, item, distance, start = [], [], [], []
                for i, part in texts(b, "text"):
                    for j, t in enumerate(part):
                        for which, (d, s) in sorted(index.find(normalise(t)).items()):
                            at.append(i + j)
                            item.append(names[which])
                            distance.append(d)
                            start.append(s)
                if at:
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(at, pa.int64())), pa.array(item), pa.array(distance, pa.int32()), pa.array(start, pa.int64())],
                        names=["id", "item", "distance", "match_start"],
                    )

        return rows.mapInArrow(tidy(run), f"id {kinds['id']}, item {kinds['item']}, distance int, match_start long")

    out = search(0)
    for k in range(1, slices):
        out = out.unionByName(search(k))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "distance", "match_start")


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    error_rate: float = 0.08,
    longest: int = 160,
    slice_bytes: int = 4 << 20,
) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; columns as they were.

    A row is judged where it is read: nothing is joined, and equal or null ids do no harm.
    """
    items, slices = _slices(benchmark, item_col, item_text_col, slice_bytes)
    out = docs
    for k in range(slices):
        _, parts = _slice(items, k, slices, longest, error_rate)

        def run(batches: Iterator[pa.RecordBatch], parts: list[Segment] = parts) -> Iterator[pa.RecordBatch]:
            index = PieceIndex(parts)
            for b in batches:
                clean = [not index.find(normalise(t)) for _, part in texts(b, text_col) for t in part]
                yield b.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(tidy(run), docs.schema)
    return out
