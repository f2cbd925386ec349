"""Personal data by bootstrapped contextual extraction.

Fixed forms (email, ip, card, phone) give the seed entities. Tokens end at white space and at structural signs
(quotes, commas, brackets, & and =), so text without blanks has tokens too. Every identifier-like token (it holds
a digit or an at sign) is an instance, every pair of tokens before or token on both sides of it a lexical pattern;
tokens of any length count, long ones by their digest. Spark keeps the bipartite graph of patterns and instances with the number of their meetings. Patterns and instances
score each other for a few rounds: a pattern's confidence in a kind is the share of its meetings that fall on
instances trusted to be of that kind, an instance's trust the confidence of its best pattern; seeds keep trust
1. Patterns with enough different instances and enough confidence then mark the other tokens in their context
as unseen identifiers of the kind. Base spans always stay; added spans never overlap them.

Texts are read twice and never shuffled: once for the instances with their contexts (rows of a few dozen
bytes, summed by the graph's edges before anything is joined), once for the spans. Confident patterns meet the
instances in a join on the pattern.

Defined results: a null text counts as empty and has no spans; repeated rows give repeated results; with no
seeds or no confident pattern nothing is added; an empty table gives an empty one; only the id and text
columns are read. Places count code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, texts, tidy

KINDS = ("email", "ip", "card", "phone")

# The forms. A run of digits is entered at its start only, as a leftmost match must be.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# What ends a token besides white space, and what is no part of an identifier at its ends.
_ENDS = r"\s\"'`,;<>|(){}\[\]&="
_EDGE = "\"'`.,;:!?()[]{}<>|#%&*$"
_TOKEN = re.compile(f"[^{_ENDS}]+")
# Entered at a token's start alone and without a way back, so time is linear in the text.
_MARKED = re.compile(f"(?<![^{_ENDS}])[^{_ENDS}0-9@]*+[0-9@][^{_ENDS}]*+")


def luhn(digits: str) -> bool:
    twice = "0246813579"
    return sum(int(d if i % 2 == 0 else twice[int(d)]) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and then start."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m.group().split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdecimal() for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _key(token: str) -> str:
    """The token itself, or a digest of a long one."""
    return token if len(token) <= 64 else "#" + hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _apart(tokens: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The tokens (by start, none meets another) that meet none of the spans; one sweep over both."""
    out, reach, k, spans = [], 0, 0, sorted(spans)
    for s, e in tokens:
        while k < len(spans) and spans[k][0] < e:
            reach, k = max(reach, spans[k][1]), k + 1
        if reach <= s:
            out.append((s, e))
    return out


def instances(text: str) -> list[tuple[int, int, int, list[str]]]:
    """(kind number or -1, start, end, lexical patterns): base spans, and the other identifier-like tokens without their
    edge signs. The patterns of a place: the two tokens before it, and the tokens on both sides; lower case, digits as 0."""
    base = base_spans(text)
    marked = [m.span() for m in _MARKED.finditer(text)]
    if not marked and not base:
        return []
    trimmed = []
    for a, b in marked:
        token = text[a:b]
        start, end = a + len(token) - len(token.lstrip(_EDGE)), a + len(token.rstrip(_EDGE))
        if end - start >= 5:
            trimmed.append((start, end))
    found = [*base, *((-1, s, e) for s, e in _apart(trimmed, [(s, e) for _, s, e in base]))]
    if not found:
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts, ends = [t[0] for t in tokens], [t[1] for t in tokens]

    def word(i: int) -> str:
        return _key(re.sub("[0-9]", "0", text[starts[i] : ends[i]].lower())) if 0 <= i < len(tokens) else ""

    out = []
    for k, s, e in found:
        before, after = bisect_right(ends, s) - 1, word(bisect_left(starts, e))
        one, two = word(before) if before >= 0 else "", word(before - 1) if before >= 1 else ""
        out.append((k, s, e, [p for p, ok in ((f"{two} {one} _", two and one), (f"{one} _ {after}", one and after)) if ok]))
    return out


def _collect_instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("value", pa.string()), ("kind", pa.int32()), ("pattern", pa.string())])
    for b in batches:
        rows: list[tuple[str, int, str]] = []
        for _, part in texts(b, "text"):
            for t in part:
                rows += [(_key(t[s:e]), k, p) for k, s, e, patterns in instances(t) for p in patterns]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def learn_patterns(docs: DataFrame, text_col: str = "text", rounds: int = 3, min_instances: int = 5, min_confidence: float = 0.9) -> DataFrame:
    """pattern, kind, confidence: the patterns to trust, scored over the graph of all documents."""
    rows = docs.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    edges = cut(
        rows.mapInArrow(tidy(_collect_instances), "value string, kind int, pattern string").groupBy("pattern", "value", "kind").agg(F.count("*").alias("n"))
    )
    # a pattern with too few instances never counts; one that no seed meets may get confidence in a later round
    alive = edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("all")).filter(F.col("instances") >= min_instances)
    graph = cut(edges.join(alive.select("pattern", "all"), "pattern"))
    trust = graph.select("value", "kind").distinct().filter("kind >= 0").withColumn("trust", F.lit(1.0))
    scored = None
    for _ in range(rounds):
        held = graph.select("pattern", "value", "n", "all").join(trust.select("value", F.col("kind").alias("k"), "trust"), "value")
        scored = cut(
            held.groupBy("pattern", "k").agg(F.sum(F.col("n") * F.col("trust")).alias("held"), F.first("all").alias("all"))
            .select("pattern", F.col("k").alias("kind"), (F.col("held") / F.col("all")).alias("confidence"))
            .filter(F.col("confidence") >= min_confidence / 2)
        )
        seeds = graph.filter("kind >= 0").select("value", "kind", F.lit(1.0).alias("trust"))
        reached = graph.filter("kind < 0").select("value", "pattern").join(scored, "pattern").select("value", "kind", F.col("confidence").alias("trust"))
        trust = seeds.unionByName(reached).groupBy("value", "kind").agg(F.max("trust").alias("trust"))
    return scored.filter(F.col("confidence") >= min_confidence)


def outermost(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping spans merged into one of the first one's kind, by start."""
    out: list[tuple[int, int, int]] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if out and s < out[-1][2]:
            out[-1] = (*out[-1][:2], max(e, out[-1][2]))
        else:
            out.append((k, s, e))
    return out


_SPAN = "struct<kind:int,start:int,end:int>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_TOKEN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("patterns", pa.list_(pa.string()))]))
Spans = list[tuple[int, int, int]]
Known = dict[str, list[tuple[float, int]]]


def _as_rows(spans: Spans) -> list[dict]:
    return [{"kind": k, "start": s, "end": e} for k, s, e in spans]


def _ddl(df: DataFrame) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]


def _known(patterns: DataFrame, few: int) -> Known | None:
    """Confidence and kind by pattern, or None where more than ``few`` patterns would have to go along with the tasks."""
    if patterns.count() > few:
        return None
    known: Known = {}
    for r in patterns.collect():
        known.setdefault(r["pattern"], []).append((r["confidence"], -r["kind"]))
    return known


def spans_of(text: str, known: Known) -> tuple[Spans, Spans]:
    """Base spans, and those that the known patterns add; the pattern of most confidence gives the kind."""
    base, added = [], []
    for k, s, e, patterns in instances(text):
        if k >= 0:
            base.append((k, s, e))
        elif best := max((c for p in patterns for c in known.get(p, ())), default=None):
            added.append((-best[1], s, e))
    return base, sorted(added)


def _joined(rows: DataFrame, patterns: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with base and added spans (columns base and added), where tokens meet the patterns in a join."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, asked = [], []
            for _, part in texts(b, text_col):
                for t in part:
                    found = instances(t)
                    base.append(_as_rows([x[:3] for x in found if x[0] >= 0]))
                    asked.append([{"start": s, "end": e, "patterns": ps} for k, s, e, ps in found if k < 0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base, _SPAN_TYPE), pa.array(asked, _TOKEN_TYPE)], names=[*b.schema.names, "base", "asked"])

    token = "struct<start:int,end:int,patterns:array<string>>"
    found = rows.mapInArrow(tidy(tokens), ", ".join([*_ddl(rows), f"base array<{_SPAN}>, asked array<{token}>"]))
    found = cut(found.withColumn("row", F.monotonically_increasing_id()))
    asked = found.select("row", F.explode("asked").alias("t")).select("row", "t.start", "t.end", F.explode("t.patterns").alias("pattern"))
    added = (
        asked.join(patterns, "pattern").groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("more"))
    )
    more = F.coalesce("more", F.array().cast(f"array<{_SPAN}>"))
    return found.join(added, "row", "left").select(*rows.columns, "base", more.alias("added"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = 100_000, **learning) -> DataFrame:
    """``docs`` -> id, base and added: arrays of struct(kind int, start int, end int); one row for each input row.

    Up to ``few`` patterns (some MB) go along with the tasks; more meet the tokens in a join. ``learning`` goes to
    ``learn_patterns``.
    """
    rows = docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("c1"))
    patterns = learn_patterns(rows, "c1", **learning)
    known = _known(patterns, few)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans_of(t, known) for _, part in texts(b, "c1") for t in part]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([_as_rows(x[i]) for x in found], _SPAN_TYPE) for i in (0, 1))], names=["c0", "base", "added"])

    if known is None:
        out = _joined(rows, patterns, "c1").drop("c1")
    else:
        out = rows.mapInArrow(tidy(spans), ", ".join([_ddl(rows)[0], f"base array<{_SPAN}>, added array<{_SPAN}>"]))
    return out.withColumnRenamed("c0", id_col) if id_col not in ("base", "added") else out.toDF(id_col, "base", "added")


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_personal_data(docs: DataFrame, text_col: str = "text", few: int = 100_000, **learning) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; rows and other columns as they were.

    A null text stays null. With up to ``few`` patterns spans are found and masked in one pass over the texts.
    """
    rows, names = numbered(docs)
    at, columns = names.index(text_col), rows.columns
    patterns = learn_patterns(rows, f"c{at}", **learning)
    known = _known(patterns, few)

    def masked(text: str | None, spans: Spans) -> str | None:
        for k, s, e in outermost(spans)[::-1] if text else ():
            text = f"{text[:s]}[{KINDS[k].upper()}]{text[e:]}"
        return text

    def replaced(b: pa.RecordBatch, out: list[str | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out, b.schema.field(i).type) if i == at else b.column(i) for i in range(len(names))], names=columns)

    def find_and_mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 256):
                b = big.slice(i, 256)
                yield replaced(b, [masked(t, sum(spans_of(t or "", known), [])) for t in b.column(at).to_pylist()])

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = [[(x["kind"], x["start"], x["end"]) for x in [*p, *q]] for p, q in zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True)]
            yield replaced(b, [masked(t, g) for t, g in zip(b.column(at).to_pylist(), groups, strict=True)])

    if known is None:
        return _joined(rows, patterns, f"c{at}").mapInArrow(tidy(mask), rows.schema).toDF(*names)
    return rows.mapInArrow(tidy(find_and_mask), rows.schema).toDF(*names)
