"""Secret scans in DataFrame functions alone: fixed forms, and sliding-window entropy for the rest.

Fixed forms (assignments to password-like names, access keys, long hexadecimal runs) come from regular
expressions; a match's place follows from the lengths of the pieces between the matches. Every other long
run of key characters is a candidate: its character class (hexadecimal, letters and digits, letters of both cases)
sets a window and a least Shannon entropy, and one pass over the characters keeps the counts of the window, packed
five bits each into whole numbers, and the sum of k log2 k up to date as one character enters and one leaves; the
work for a character doesn't depend on window or alphabet. A candidate whose best window reaches the entropy is a
secret, unless an allow-list pattern fits it or a fixed form already covers part of it.

Everything runs in the executors' JVMs within one scan, without shuffle. Places count code points, the end
exclusive. Defined results: a null text counts as empty and has no spans; repeated rows give repeated
results; an empty table gives an empty one; only the id and text columns are read, and names of extra
columns can't clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
_FIRST, _CODES = ord("+"), ord("z") - ord("+") + 1
_PACKED = 12  # counts in a whole number, five bits each
_WORDS = -(-_CODES // _PACKED)


@dataclass(frozen=True)
class CharacterClass:
    """Runs that ``pattern`` fits wholly, the window (31 characters at most), and the least entropy in bits a character."""

    pattern: str
    window: int
    bits: float


CLASSES = (
    CharacterClass(r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 20, 3.0),
    CharacterClass(r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]+$", 20, 3.6),
    CharacterClass(r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z+/_=-]+$", 24, 4.1),
)
# Runs that look random but are published or made up: names that say so, alphabets and runs, digests and identifiers
# of known form, paths and words joined by signs.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|lorem",
    r"(?i)abcdefgh|01234567|12345678|qwertyui",
    r"(.)\1{7}",
    r"(?i)^(sha(1|224|256|384|512)-|md5-|data-|utm_|urn-)",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^/?(?:[a-z0-9_-]{2,}+/)++[a-z0-9_-]*+$",
    r"^[A-Za-z]++(?:[-_/][A-Za-z]++)++(?:[-_/]?[0-9]{1,4})?$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T",
    r"^(iVBORw0KGgo|R0lGOD|/9j/4|UEsDB|JVBERi0)",
)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, pattern: str, order: int, group: int = 0) -> Column:
    """array<struct<start, ord, end, value>> of the matches; the value is that of ``group``.

    Places are running sums. An array that grows by one element is copied, so sums run over blocks of about the
    square root of the number of matches, and then within each: n ** 1.5 steps for n matches, not n * n.
    """
    piece = "array<struct<start:int,ord:int,end:int,value:string>>"

    def located(p: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(p))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size).cast("int")), lambda k: F.slice(p, k * size + 1, size))
        return _once(blocks, summed)

    def summed(blocks: Column) -> Column:
        lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["n"]))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(lengths, begin, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
        return F.flatten(F.zip_with(blocks, before, within))

    def within(block: Column, before: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            one = F.struct(start.alias("start"), F.lit(order).alias("ord"), (start + x["n"]).alias("end"), x["v"].alias("value"))
            return F.struct((start + x["n"]).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

        return F.aggregate(block, F.struct(before.alias("at"), F.array().cast(piece).alias("out")), step, lambda s: s["out"])

    def pieces(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        matched = F.transform(found, lambda m: F.struct(F.length(m).alias("n"), (F.regexp_extract(m, pattern, group) if group else m).alias("v")))
        return F.zip_with(matched, F.slice(gaps, F.lit(1), F.size(found)), lambda m, gap: F.struct(gap.alias("gap"), m["n"].alias("n"), m["v"].alias("v")))

    spans = _once(_once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pieces), located)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(piece))


def _mixed(value: Column) -> Column:
    """Letters with digits, or letters of both cases."""
    digit, lower, upper = (value.rlike(p) for p in ("[0-9]", "[a-z]", "[A-Z]"))
    return (digit & (lower | upper)) | (lower & upper)


def best_window_entropy(value: Column, window: int) -> Column:
    """The largest Shannon entropy of any ``window`` successive characters (of all, if there are fewer)."""
    table = F.array(*[F.lit(k * math.log2(k) if k > 1 else 0.0) for k in range(window + 2)])
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c) - _FIRST)
    codes = F.filter(codes, lambda c: (c >= 0) & (c < _CODES))
    powers = F.array(*[F.lit(1 << 5 * k).cast("long") for k in range(_PACKED)])

    def word(code: Column) -> Column:
        return F.call_function("div", code, F.lit(_PACKED)).cast("int")

    def unit(code: Column) -> Column:
        """One, at the place of the code's count."""
        return F.get(powers, code % _PACKED)

    def held(state: Column, code: Column) -> Column:
        """The count of a code in the window."""
        packed = F.lit(0).cast("long")
        for k in range(_WORDS):
            packed = F.when(word(code) == k, state[f"n{k}"]).otherwise(packed)
        return (F.call_function("div", packed, unit(code)) % 32).cast("int")

    def step(state: Column, item: Column) -> Column:
        new, old = item["new"], item["old"]
        gone = old >= 0
        lost = F.when(gone, held(state, old)).otherwise(0)
        had = held(state, new) - (new == old).cast("int")
        total = state["sum"] + F.when(gone, F.get(table, lost - 1) - F.get(table, lost)).otherwise(F.lit(0.0))
        total = total + F.get(table, had + 1) - F.get(table, had)
        counts = [
            (state[f"n{k}"] + F.when(word(new) == k, unit(new)).otherwise(0) - F.when(gone & (word(old) == k), unit(old)).otherwise(0)).alias(f"n{k}")
            for k in range(_WORDS)
        ]
        entropy = F.when(item["full"], F.log2(item["w"]) - total / item["w"]).otherwise(F.lit(0.0))
        return F.struct(*counts, total.alias("sum"), F.greatest(state["best"], entropy).alias("best"))

    def items(v: Column) -> Column:
        c, w = v["codes"], v["w"]
        old = lambda i: F.when(i >= w, F.get(c, i - w)).otherwise(F.lit(-1))
        return F.transform(c, lambda x, i: F.struct(x.alias("new"), old(i).alias("old"), (i >= w - 1).alias("full"), w.cast("double").alias("w")))

    begin = F.struct(*[F.lit(0).cast("long").alias(f"n{k}") for k in range(_WORDS)], F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    sized = _once(codes, lambda c: F.struct(c.alias("codes"), F.least(F.lit(window), F.size(c)).alias("w")))
    return F.aggregate(_once(sized, items), begin, step, lambda s: s["best"])


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    classes: tuple[CharacterClass, ...] = CLASSES,
    allowed: tuple[str, ...] = ALLOWED,
    min_assigned: int = 12,
) -> DataFrame:
    """``docs`` -> id, base and added: arrays of struct(start int, ord int, end int, value string).

    ``base`` holds the fixed forms (ord 0 assign, 1 access, 2 hex), ``added`` the runs found by entropy (ord 3).
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.select(
        F.col(id_col),
        F.filter(_spans(text, ASSIGN, 0, group=2), lambda s: F.length(s["value"]) >= min_assigned).alias("assign"),
        _spans(text, ACCESS, 1).alias("access"),
        _spans(text, HEX, 2).alias("hex"),
        F.filter(_spans(text, CANDIDATE, 3), lambda s: _mixed(s["value"])).alias("candidates"),
    )
    based = found.select(F.col(id_col), F.array_sort(F.concat("assign", "access", "hex")).alias("base"), "candidates")

    def suspicious(s: Column) -> Column:
        high = F.lit(False)
        for c in reversed(classes):
            high = F.when(s["value"].rlike(c.pattern), best_window_entropy(s["value"], c.window) >= c.bits).otherwise(high)
        fine = F.lit(False)
        for pattern in allowed:
            fine = fine | s["value"].rlike(pattern)
        covered = F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.when(covered | fine, F.lit(False)).otherwise(high)

    added = F.when(F.size("candidates") > 0, F.filter("candidates", suspicious)).otherwise(F.col("candidates"))
    return based.select(F.col(id_col), "base", added.alias("added"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
