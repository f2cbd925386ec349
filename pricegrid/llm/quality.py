"""Quality by hierarchical empirical Bayes: a text classifier's evidence on top of its site's posterior.

A logistic classifier over whole-text statistics gives each document a probability. Grouped aggregation sums
the probabilities by host and by path; a host's rate is shrunk towards the global rate, a path's towards its
host's, each by a pseudo-count that the method of moments finds from the spread between groups, so sparse
sites lean on their parents. A document's score joins the classifier's log likelihood ratio with the log odds
of its path, computed without the document itself.

``documents`` has no URL, so the query takes ``source`` as host and ``lang`` as the path below it: the two columns that
say where a document comes from.

Only small rows (id, host, path, probability) are grouped and joined, never texts; partial sums before the
shuffle and adaptive splitting of the join cover a host that holds a third of all rows.

The classifier is fitted on at most ``per_class`` labelled documents of each class (a bounded sample, by a
hash of the id). Defined results: null and empty texts are scored as empty; a null host or path is a group
of its own; with no labelled row of both kinds the classifier says 0.5; repeated rows count as rows; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fit_logistic, labelled_sample, texts, tidy

_LETTERS, _UPPER, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"[A-ZÄÖÜÀ-ÖØ-Þ]+"), re.compile(r"[0-9]+")
_SPACE = re.compile(r"\s+")
N_FEATURES = 9


def features(text: str) -> list[float]:
    """Whole-text statistics, all about 0 to 1."""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * N_FEATURES
    count = Counter(words)
    lines = [x for x in text.split("\n") if x]
    letters = sum(map(len, _LETTERS.findall(text)))
    blank = sum(map(len, _SPACE.findall(text)))
    return [
        letters / chars,
        sum(map(len, _UPPER.findall(text))) / max(1, letters),
        sum(map(len, _DIGITS.findall(text))) / chars,
        (chars - letters - blank) / chars,
        len(count) / n,
        max(count.values()) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, chars / n / 20),
        min(1.0, float(np.log1p(n)) / 10),
    ]


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.array([features(t) for _, part in texts(batch, column) for t in part], np.float64).reshape(-1, N_FEATURES)


def _basis(f: np.ndarray) -> np.ndarray:
    """Intercept, the statistics, and their squares and logarithms, for curved responses."""
    return np.hstack([np.ones((len(f), 1)), f, f * f, np.log(f + 0.01)])


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2500) -> np.ndarray | None:
    """Coefficients of the classifier, or None without labelled rows of both kinds."""
    sample, _ = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(_matrix(b, "text").tolist(), pa.list_(pa.float64()))], names=["y", "f"])

    rows = sample.mapInArrow(tidy(run), "y int, f array<double>").collect()
    y = np.array([r["y"] for r in rows], np.float64)
    if len(set(y)) < 2:
        return None
    return fit_logistic(_basis(np.array([r["f"] for r in rows])), y, ridge=0.1)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _pseudo_count(groups: DataFrame, mean: Column) -> float:
    """Beta-binomial pseudo-count by the method of moments over groups (n, s) around their parents' ``mean``."""
    spread = mean * (1 - mean)
    r = groups.filter("n > 1").agg(
        F.sum(F.col("n") * (F.pow(F.col("s") / F.col("n") - mean, 2))).alias("between"),
        F.sum(spread).alias("noise"),
        F.sum(F.col("n") * spread).alias("scale"),
        F.count("*").alias("groups"),
    ).first()
    if not r["groups"] or not r["scale"]:
        return 20.0
    share = max(1e-4, (r["between"] - r["noise"]) / max(1e-12, r["scale"] - r["noise"]))
    return float(min(10_000.0, max(1.0, 1 / share - 1)))


def score_quality(
    docs: DataFrame,
    coefficients: np.ndarray | None,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` -> id, text_score, site_score, score (doubles 0 to 1); one row for each input row."""
    rows = docs.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = _matrix(b, "text")
            p = np.full(len(f), 0.5) if coefficients is None else 1 / (1 + np.exp(-np.clip(_basis(f) @ coefficients, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(p)], names=["id", "host", "path", "p"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    scored = cut(rows.mapInArrow(tidy(run), f"id {kinds['id']}, host {kinds['host']}, path {kinds['path']}, p double"))
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = (whole["s"] or 0.0) / max(1, whole["n"] or 0) if whole["n"] else 0.5

    m_host = _pseudo_count(hosts, F.lit(mean))
    rates = hosts.select(F.col("host").alias("h"), ((F.col("s") + m_host * mean) / (F.col("n") + m_host)).alias("host_rate"))
    sites = paths.join(rates, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    m_path = _pseudo_count(sites, F.col("host_rate"))

    site = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "s", "host_rate")
    joined = scored.join(site, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    rate = (F.col("s") - F.col("p") + m_path * F.col("host_rate")) / (F.col("n") - 1 + m_path)
    rate = F.least(F.greatest(rate, F.lit(0.0)), F.lit(1.0))
    # the classifier was fitted on balanced labels: its log odds are the likelihood ratio
    score = 1 / (1 + F.exp(-(_logit(F.col("p")) + _logit(rate) - _logit(F.lit(0.5)))))
    return joined.select(F.col("id").alias(id_col), F.col("p").alias("text_score"), rate.alias("site_score"), score.alias("score"))
