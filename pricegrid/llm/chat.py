"""Chat formatting with typed content parts.

A turn is a role and an ordered array of parts: text, image, audio or document. A visitor has one method for each
type; ``flatten`` lets it visit the parts in their order and puts together the turn's text, in which every attachment
is a placeholder, and the attachments' records: their place in the turn, type, reference, and the number of tokens
that the placeholder expands to. ``format_turns`` wraps each turn in the template's marks and tells which code points
are under the loss mask. A turn is formatted from its own row alone, so no conversation is ever gathered and nothing
is shuffled; a conversation is the concatenation of its turns' pieces in their order. ``parse`` reads pieces back.

Control strings of the template never come from content: in texts, references and roles a backslash goes before each of
them and before each backslash. So an unescaped mark is always the template's own, and removing one backslash before
any character gives back what was written.

Defined results: a null text, reference or role counts as empty, null parts as none; a part of an unknown type is an
attachment of type ``other`` that expands to no tokens; sizes that are null or below zero count as zero. Rows of equal turn
are ordered by role and then formatted text, null turns come first, rows of a null conversation id form one conversation, and
repeated rows are repeated turns. An empty table gives an empty one; extra columns are ignored by ``read_back``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

PART = "struct<type:string,text:string,ref:string,width:long,height:long,millis:long,pages:long>"
TYPES = ("text", "image", "audio", "document")


@dataclass(frozen=True)
class Template:
    """Marks of a turn and of a placeholder; ``opens`` are the starts of everything that content must not write."""

    begin: str = "### "
    after_role: str = ":\n"
    end: str = "</turn>\n"
    slot: str = "<|"
    slot_end: str = "|>"
    opens: tuple[str, ...] = ("### ", "</turn>", "<|")
    trained_role: str = "assistant"

    def escape(self, text: Column, more: tuple[str, ...] = ()) -> Column:
        marks = "|".join(["\\\\", *(re.escape(o) for o in (*self.opens, *more))])
        return F.regexp_replace(F.coalesce(text, F.lit("")), f"({marks})", "\\\\$1")

    def escape_role(self, role: Column) -> Column:
        """Roles end at the first unescaped colon with line end, so these are escaped as well."""
        return F.regexp_replace(F.coalesce(role, F.lit("")), "([\\\\:#<\n])", "\\\\$1")


@dataclass(frozen=True)
class Rates:
    """Tokens that an attachment expands to."""

    patch: int = 28  # pixels of an image patch's side, a token each
    audio_per_second: int = 25
    document_page: int = 256


class Visitor:
    """One method for each type of part; each returns the tokens of its placeholder, text parts none."""

    def __init__(self, rates: Rates) -> None:
        self.rates = rates

    @staticmethod
    def _size(part: Column, field: str) -> Column:
        return F.greatest(F.coalesce(part[field], F.lit(0)), F.lit(0)).cast("long")

    def image(self, part: Column) -> Column:
        across, down = (F.ceil(self._size(part, f) / self.rates.patch).cast("long") for f in ("width", "height"))
        return across * down

    def audio(self, part: Column) -> Column:
        return F.ceil(self._size(part, "millis") * self.rates.audio_per_second / 1000).cast("long")

    def document(self, part: Column) -> Column:
        return self._size(part, "pages") * self.rates.document_page

    def tokens(self, part: Column) -> Column:
        kind = part["type"]
        return F.when(kind == "image", self.image(part)).when(kind == "audio", self.audio(part)).when(kind == "document", self.document(part)).otherwise(F.lit(0).cast("long"))


def text_parts(text: Column) -> Column:
    """The parts of a turn that is one plain text."""
    empty = {"ref": "string", "width": "long", "height": "long", "millis": "long", "pages": "long"}
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in empty.items()]))


def flatten(parts: Column, template: Template = Template(), visitor: Visitor | None = None) -> tuple[Column, Column]:
    """(text with placeholders, array of attachments) of an array of parts, in the parts' order.

    A placeholder is <|type:k:reference|>, k counting the turn's attachments from 1. The number of attachments before a
    part is that of the array's front, so that all parts are visited independently.
    """
    visitor = visitor or Visitor(Rates())
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    is_text = lambda p: F.coalesce(p["type"] == "text", F.lit(False))
    typed = lambda p: F.when(p["type"].isin(*TYPES), p["type"]).otherwise(F.lit("other"))
    # attachments before each part, as running totals over the array
    attached = F.filter(parts, lambda p: ~is_text(p))
    numbered = F.transform(
        attached,
        lambda p, k: F.struct(
            (k + 1).cast("int").alias("k"), typed(p).alias("type"), F.coalesce(p["ref"], F.lit("")).alias("ref"), F.coalesce(visitor.tokens(p), F.lit(0)).cast("long").alias("tokens")
        ),
    )
    slots = F.transform(numbered, lambda a: F.concat(F.lit(template.slot), a["type"], F.lit(":"), a["k"].cast("string"), F.lit(":"), template.escape(a["ref"], more=(template.slot_end,)), F.lit(template.slot_end)))
    start = F.struct(F.lit(0).alias("k"), F.array().cast("array<string>").alias("out"))

    def visit(state: Column, p: Column) -> Column:
        piece = F.when(is_text(p), template.escape(p["text"])).otherwise(F.get(slots, state["k"]))
        return F.struct((state["k"] + F.when(is_text(p), 0).otherwise(1)).alias("k"), F.concat(state["out"], F.array(piece)).alias("out"))

    # a turn of one text, the usual one, needs no walk
    one = F.when(F.size(parts) == 1, F.when(is_text(F.get(parts, F.lit(0))), template.escape(F.get(parts, F.lit(0))["text"])))
    return F.coalesce(one, F.concat_ws("", F.aggregate(parts, start, visit)["out"])), numbered


def format_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", template: Template = Template()) -> DataFrame:
    """conv, turn, role, piece, loss_start and loss_chars (code points within the piece), attachments, expanded_tokens."""
    body, attachments = flatten(F.col(parts), template)
    head = F.concat(F.lit(template.begin), template.escape_role(F.col(role)), F.lit(template.after_role))
    trained = F.coalesce(F.col(role) == template.trained_role, F.lit(False))
    made = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), head.alias("head"), body.alias("body"), attachments.alias("attachments"), trained.alias("trained"))
    return made.select(
        "conv", "turn", "role",
        F.concat("head", "body", F.lit(template.end)).alias("piece"),
        F.length("head").cast("long").alias("loss_start"),
        F.when(F.col("trained"), F.length("body")).otherwise(0).cast("long").alias("loss_chars"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@dataclass(frozen=True)
class Turn:
    """What was read back: role, the parts as (type, text or reference), their plain texts put together, and the body's span."""

    role: str
    parts: tuple[tuple[str, str], ...]
    text: str
    start: int
    end: int


class Parser:
    """Reads formatted turns back by the template's marks alone."""

    def __init__(self, template: Template = Template()) -> None:
        def plain(*marks: str) -> str:
            """Text up to the first unescaped mark; only a mark's first character is looked at twice."""
            first = "".join(sorted({re.escape(m[0]) for m in marks}))
            return rf"(?:[^\\{first}]++|\\.|(?!{'|'.join(map(re.escape, marks))})[{first}])*+"

        self.head = re.compile(re.escape(template.begin) + r"((?:\\.|[^\\:])*+)" + re.escape(template.after_role), re.S)
        self.text = re.compile(plain(*template.opens), re.S)
        self.slot = re.compile(re.escape(template.slot) + r"([a-z]+):([0-9]+):(" + plain(template.slot_end) + ")" + re.escape(template.slot_end), re.S)
        self.end = template.end

    def turns(self, formatted: str) -> Iterator[Turn]:
        at = 0
        while at < len(formatted):
            head = self.head.match(formatted, at)
            if head is None:
                raise ValueError(f"no turn begins at code point {at}")
            start = at = head.end()
            parts: list[tuple[str, str]] = []
            while not formatted.startswith(self.end, at):
                if slot := self.slot.match(formatted, at):
                    parts.append((slot[1], unescape(slot[3])))
                    at = slot.end()
                    continue
                run = self.text.match(formatted, at)
                if run is None or run.end() == at:
                    raise ValueError(f"neither text nor mark at code point {at}")
                parts.append(("text", unescape(run[0])))
                at = run.end()
            yield Turn(unescape(head[1]), tuple(parts), "".join(t for k, t in parts if k == "text"), start, at)
            at += len(self.end)


def read_back(formatted: DataFrame, template: Template = Template(), partitions: int | None = None) -> DataFrame:
    """Digests by conversation, from the pieces and the loss mask alone: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a whole conversation is one stream: pieces are sorted within partitions by conversation and place and
    walked through with one running digest, so memory holds a turn at a time however long a conversation is.
    """
    conv = formatted.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, now, opened = Parser(template), None, False
        turns = loss = None
        count = lost = chars = 0

        def done(kind: pa.DataType) -> pa.RecordBatch:
            values = [now, count, turns.hexdigest(), lost, loss.hexdigest(), chars]
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for i in range(batch.num_rows):
                name, piece, start, length = (batch.column(c)[i].as_py() for c in range(4))
                if not opened or name != now:
                    if opened:
                        yield done(kind)
                    now, opened, turns, loss, count, lost, chars = name, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for turn in parser.turns(piece):
                    turns.update(f"{turn.role}\n{turn.text}\n".encode("utf-8", "surrogatepass"))
                    count += 1
                under = unescape(piece[start : start + length])
                loss.update(under.encode("utf-8", "surrogatepass"))
                lost, chars = lost + len(under), chars + len(piece)
        if opened:
            yield done(kind)

    columns = [F.col(c) for c in ("conv", "piece", "loss_start", "loss_chars")]
    dealt = formatted.repartition(partitions, "conv") if partitions else formatted.repartition("conv")
    ordered = dealt.sortWithinPartitions("conv", "turn", "role", "piece").select(*columns)
    return ordered.mapInArrow(tidy(run), f"conv {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
