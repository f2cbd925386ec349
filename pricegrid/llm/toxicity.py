"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, accents off, look-alike letters of other scripts and digits or signs that
stand for letters inside a word mapped to the Latin letter. The lexicon holds word stems (matched at the start
of a word) and whole words with log-odds weights; exception phrases cover a lexicon hit that they contain. A
document's evidence is the summed weight of its hits, its density the evidence over its number of words, and a
logistic curve over both gives the score.

Lexicon, exceptions and curve are learned from labelled rows, at most ``per_class`` documents of each label
(a bounded sample, by a hash of the id); the lexicon has ``lexicon_size`` stems at most and as many exceptions.
Scoring reads every text in full, in time linear in its length.

Defined results: null and empty texts have no evidence and get the score of an empty text; with no labelled
row of both kinds every score is 0; repeated rows are scored one by one; extra columns are ignored unless
named in ``keep``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fit_logistic, labelled_sample, texts, tidy

# Letters that look like Latin ones, and digits or signs that stand for letters inside words.
HOMOGLYPHS = dict(zip("авеикмнорстухіјѕԁɡαβεικνορτυχ", "abeukmhopctyxijsdgabeiknoptux", strict=True))
STANDINS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_WORD = re.compile(r"[^\W\d_]+")


class _Folding(dict):
    """A translation table that finds the base letter of a character when it is first met."""

    def __missing__(self, code: int) -> int:
        low = chr(code).lower()
        base = unicodedata.normalize("NFKD", low)[:1] or low
        base = HOMOGLYPHS.get(base, base).lower()
        self[code] = ord(base) if len(base) == 1 else code
        return self[code]


_FOLDING = _Folding()
# A run of letters, digits and signs with a stand-in; possessive and entered at its start alone, so time is linear.
_RUN = re.compile(r"(?<![a-z0-9@$])[a-z269]*+[013457@$8][a-z0-9@$]*+")
_BESIDE = re.compile(r"[a-z][013457@$8]|[013457@$8][a-z]")


def fold(text: str) -> str:
    """The folded text; it has as many characters as ``text``."""
    text = text.translate(_FOLDING)

    def plain(m: re.Match) -> str:
        word = m.group()
        if not _BESIDE.search(word):
            return word
        letters = sum(c.isalpha() for c in word)
        inner = word.rstrip("$@")  # a trailing sign is no letter
        if letters * 3 < len(inner):
            return word  # mostly digits: an identifier, no word
        return "".join(STANDINS.get(c, c) for c in inner) + word[len(inner) :]

    return _RUN.sub(plain, text)


@dataclass
class ToxicityModel:
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: np.ndarray | None = None

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """The automaton of a model."""

    def __init__(self, model: ToxicityModel):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for stem, weight in model.stems.items():
            self.auto.add_word(stem, (0, len(stem), weight))
        for phrase in model.exceptions:
            if phrase not in self.auto:
                self.auto.add_word(phrase, (1, len(phrase), 0.0))
        if len(self.auto):
            self.auto.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight): the heaviest entry for each word start, without those an exception covers."""
        if not len(self.auto):
            return []
        found: dict[int, tuple[int, float]] = {}
        covered: list[tuple[int, int]] = []
        for last, (is_exception, length, weight) in self.auto.iter(folded):
            start = last + 1 - length
            if start and folded[start - 1].isalpha():
                continue
            if is_exception:
                if last + 1 == len(folded) or not folded[last + 1].isalpha():
                    covered.append((start, last + 1))
            elif start not in found or weight > found[start][1]:
                found[start] = (last + 1, weight)
        out, covered, reach, k = [], sorted(covered), 0, 0
        for s, (e, w) in sorted(found.items()):
            while k < len(covered) and covered[k][0] <= s:
                reach, k = max(reach, covered[k][1]), k + 1
            if s >= reach:
                out.append((s, e, w))
        return out

    def features(self, text: str) -> tuple[tuple[float, float, float], int]:
        """(evidence, density, log of the number of words), and the number of hits."""
        folded = fold(text)
        found = self.hits(folded)
        evidence = sum(w for _, _, w in found)
        words = folded.count(" ") + folded.count("\n") + 1
        return (evidence, 10 * evidence / (words + 10), float(np.log1p(words))), len(found)


def _design(rows: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(rows)), np.log1p(rows[:, 0]), np.log1p(rows[:, 1]), rows[:, 2] / 5])


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = 2500,
    lexicon_size: int = 500,
    min_docs: int = 5,
    min_z: float = 6.0,
) -> ToxicityModel:
    """Learn a model from ``labels`` (id, label 0/1) and their texts."""
    sample, true = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return ToxicityModel()

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with each stem and word, by label, summed within the task."""
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            ys = b.column(1).to_pylist()
            for i, part in texts(b, "text"):
                for k, t in enumerate(part):
                    own = set()
                    for w in set(_WORD.findall(fold(t))):
                        own.update(w[:n] for n in range(3, min(len(w), 12) + 1))
                        own.add(w)
                    seen[ys[i + k]].update(own)
        names = list(seen[0].keys() | seen[1].keys())
        for i in range(0, len(names), 20_000):
            part = names[i : i + 20_000]
            yield pa.RecordBatch.from_pydict(
                {"unit": part, "toxic": [seen[1][u] for u in part], "clean": [seen[0][u] for u in part]},
                pa.schema([("unit", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]),
            )

    n1, n0 = size[1], size[0]
    counted = sample.mapInArrow(tidy(units), "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    pooled = (F.col("a") + F.col("b")) / (n1 + n0)
    z = (F.col("a") / n1 - F.col("b") / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
    best = (
        counted.filter(F.col("a") >= min_docs).withColumn("z", z).filter(F.col("z") >= min_z)
        .orderBy(F.desc("z"), F.desc(F.length("unit")), "unit").limit(20 * lexicon_size).collect()
    )
    model = ToxicityModel()
    for r in best:
        u = r["unit"]
        if len(model.stems) < lexicon_size and not any(u.startswith(s) or s.startswith(u) for s in model.stems):
            model.stems[u] = float(np.log((r["a"] + 0.5) / (n1 + 1)) - np.log((r["b"] + 0.5) / (n0 + 1)))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two-word phrases around hits, by label, once a document."""
        m, seen = model.matcher(), (Counter(), Counter())
        for b in batches:
            ys = b.column(1).to_pylist()
            for i, part in texts(b, "text"):
                for k, t in enumerate(part):
                    folded, own = fold(t), set()
                    hits = m.hits(folded)
                    words = [w.span() for w in _WORD.finditer(folded)] if hits else []
                    first = {w[0]: j for j, w in enumerate(words)}
                    for s, e, _ in hits:
                        j = first.get(s)
                        if j is None:
                            continue
                        e = words[j][1]
                        if j and folded[words[j - 1][1] : s] == " ":
                            own.add(folded[words[j - 1][0] : e])
                        if j + 1 < len(words) and folded[e : words[j + 1][0]] == " ":
                            own.add(folded[s : words[j + 1][1]])
                    seen[ys[i + k]].update(own)
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict(
            {"unit": names, "toxic": [seen[1][u] for u in names], "clean": [seen[0][u] for u in names]},
            pa.schema([("unit", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]),
        )

    excused = (
        sample.mapInArrow(tidy(phrases), "unit string, toxic long, clean long").groupBy("unit")
        .agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
        .filter((F.col("b") >= min_docs) & (F.col("a") * n0 * 4 <= F.col("b") * n1))
        .orderBy(F.desc("b"), "unit").limit(lexicon_size).collect()
    )
    model.exceptions = [r["unit"] for r in excused]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.matcher()
        for b in batches:
            rows = [m.features(t)[0] for _, part in texts(b, "text") for t in part]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c, pa.float64()) for c in cols)], names=["y", "e", "d", "w"])

    rows = np.array([tuple(r) for r in sample.mapInArrow(tidy(features), "y int, e double, d double, w double").collect()], np.float64)
    y, x = rows[:, 0], _design(rows[:, 1:])
    model.coefficients = fit_logistic(x, y)
    # the sample balances the labels; move the intercept to the labels' true odds
    model.coefficients[0] += np.log(true[1] / true[0]) - np.log(n1 / n0)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """``docs`` -> id, kept columns, evidence double, n_hits long, score double; one row for each input row."""
    picked = docs.select(F.col(id_col), *(keep or []), F.col(text_col).alias("__text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.matcher()
        for b in batches:
            at = b.schema.get_field_index("__text")
            rows, hits = [], []
            for _, part in texts(b, "__text"):
                for t in part:
                    values, n = m.features(t)
                    rows.append(values)
                    hits.append(n)
            f = np.array(rows, np.float64).reshape(-1, 3)
            p = np.zeros(len(f)) if model.coefficients is None else 1 / (1 + np.exp(-np.clip(_design(f) @ model.coefficients, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(b.num_columns) if k != at), pa.array(f[:, 0]), pa.array(hits, pa.int64()), pa.array(p)],
                names=[*(n for n in b.schema.names if n != "__text"), "evidence", "n_hits", "score"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields if f.name != "__text"]
    return picked.mapInArrow(tidy(score), ", ".join([*fields, "evidence double, n_hits long, score double"]))
