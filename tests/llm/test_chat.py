"""Chat formatting: exact round trips of texts, parts and roles, and digests by conversation."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pricegrid.llm import chat

MARKS = ["\\", "### ", "###", "</turn>", "</turn>\n", "<|", "|>", "<|image:1:x|>", "### Assistant:\n", "\n", ":", "#", "<", "ok", "é🎉", "\\### ", "\\\\<|"]
TURNS = "conv_id long, turn long, role string, text string, parts string, piece string, head string, body string"


def digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def test_random_texts_and_roles_come_back(spark):
    rng = random.Random(5)
    made = ["".join(rng.choices(MARKS, k=rng.randrange(9))) for _ in range(600)]
    rows = [(i // 6, i % 6, rng.choice(["assistant", "user", "a:b\n### ", "", None]), t) for i, t in enumerate(made)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_turns(df.withColumn("parts", chat.text_parts(F.col("text")))).collect()
    parser, by_key = chat.Parser(), {(c, t): (r, x) for c, t, r, x in rows}
    assert len(out) == len(rows)
    whole = {}
    for r in sorted(out, key=lambda r: (r["conv"], r["turn"])):
        (turn,) = parser.turns(r["piece"])
        role, text = by_key[r["conv"], r["turn"]]
        assert (turn.role, turn.text) == (role or "", text)
        assert r["piece"][r["loss_start"] : r["loss_start"] + r["loss_chars"]] == (r["piece"][turn.start : turn.end] if role == "assistant" else "")
        whole.setdefault(r["conv"], []).append(r["piece"])
    for c, pieces in whole.items():  # a conversation reads back as one text too
        assert [(t.role, t.text) for t in parser.turns("".join(pieces))] == [(by_key[c, k][0] or "", by_key[c, k][1]) for k in range(len(pieces))]


def test_typed_parts(spark):
    text = lambda t: ("text", t, None, None, None, None, None)
    parts = [text("see <|image:9:no|> "), ("image", None, "s3://a|>b", 100, 57, None, None), text(" and "), ("audio", None, "b.wav", None, None, 1500, None),
             ("document", None, None, None, None, None, 3), ("hologram", "x", "h", 5, 5, 5, 5), text(None), (None, None, "n", None, None, None, None), ("image", None, "neg", -5, 10, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "assistant", [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    one, two, three = chat.format_turns(df).orderBy("turn").collect()
    (turn,) = chat.Parser().turns(one["piece"])
    assert turn.parts == (("text", "see <|image:9:no|> "), ("image", "s3://a|>b"), ("text", " and "), ("audio", "b.wav"), ("document", ""), ("other", "h"), ("other", "n"), ("image", "neg"))
    assert [(a["k"], a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [
        (1, "image", "s3://a|>b", 4 * 3), (2, "audio", "b.wav", 38), (3, "document", "", 768), (4, "other", "h", 0), (5, "other", "n", 0), (6, "image", "neg", 0)]
    assert one["expanded_tokens"] == 12 + 38 + 768
    assert two["piece"] == three["piece"] == "### assistant:\n</turn>\n" and two["attachments"] == []


def test_digests_of_odd_rows(spark):
    long = "long </turn> " * 50_000
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (None, 0, "assistant", "x"), (None, None, "assistant", "first"), (2, 5, "assistant", "same"), (2, 5, "assistant", "same"),
            (2, 5, None, "no role"), (3, 0, "assistant", long), (4, 0, "system", ""), (5, 0, "assistant", "\\### Assistant: </turn> ok")]
    df = spark.createDataFrame([(*r, "p", "q", "h", "b") for r in rows], TURNS).withColumn("parts", chat.text_parts(F.col("text")))
    got = {r["conv"]: r.asDict() for r in chat.read_back(chat.format_turns(df)).collect()}
    want = {1: rows[:2], None: [rows[3], rows[2]], 2: [rows[6], rows[4], rows[5]], 3: [rows[7]], 4: [rows[8]], 5: [rows[9]]}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        said = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == digest((r, t) for _, _, r, t in turns)
        assert got[c]["loss_chars"] == len(said) and got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[3]["formatted_chars"] == len("### assistant:\n</turn>\n") + len(long) + 50_000
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_a_broken_text_is_refused():
    for broken in ("no turn", "### user:\nnever ends", "### user:\n### </turn>\n", "### user:\na</turn>"):
        with pytest.raises(ValueError):
            list(chat.Parser().turns(broken))


def test_a_long_conversation_is_walked_through(spark):
    rows = spark.range(30_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    (out,) = chat.read_back(chat.format_turns(rows.withColumn("parts", chat.text_parts(F.col("text"))))).collect()
    assert out["turns_sha256"] == digest((("user", "assistant")[i % 2], f"t{i}") for i in range(30_000))
