"""Language identification by a byte convolutional network.

The network looks at fixed-length windows of UTF-8 bytes: byte embeddings, one bank of filters for each
width, rectifier, max pooling over the window, softmax over the languages. It is trained in numpy on a
bounded sample of labelled windows and applied to every window of every text, in batches. A document's
class probabilities are the means over its windows, weighted by the bytes in each.

Defined results: a null text, an empty text and a text without any letter give ``und`` with score 0; with
no labelled row at all, every text does. Repeated rows are scored one by one; ties go to the language that
sorts first. Only id, text and label columns are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import below_share, numbered, texts, tidy, utf8_buffers

WINDOW = 256
WIDTHS = (2, 3, 4)
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _WORDLIKE.finditer(text))


@dataclass
class ByteConvNet:
    """Embedding (256, d); for each width w a filter bank (w, d, f) and bias (f); output layer."""

    labels: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(labels: list[str], dim: int, per_width: int, seed: int) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        return ByteConvNet(
            labels,
            rng.normal(0, 0.5, (256, dim)).astype(np.float32),
            {w: rng.normal(0, (2 / (w * dim)) ** 0.5, (w, dim, per_width)).astype(np.float32) for w in WIDTHS},
            {w: np.zeros(per_width, np.float32) for w in WIDTHS},
            rng.normal(0, 0.2, (per_width * len(WIDTHS), len(labels))).astype(np.float32),
            np.zeros(len(labels), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters.values(), *self.biases.values(), self.out, self.out_bias]

    def loss_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Cross entropy of windows x (n, WINDOW) with classes y, and gradients in the order of parameters()."""
        n, dim = len(x), self.embedding.shape[1]
        e = self.embedding[x]
        pooled, at = [], {}
        for w in WIDTHS:
            flat = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2)
            z = flat.reshape(n, -1, w * dim) @ self.filters[w].reshape(w * dim, -1) + self.biases[w]
            at[w] = z.argmax(1)
            pooled.append(np.take_along_axis(z, at[w][:, None, :], 1)[:, 0, :])
        raw = np.concatenate(pooled, 1)
        h = np.maximum(raw, 0)
        p = softmax(h @ self.out + self.out_bias)
        loss = -np.log(np.maximum(p[np.arange(n), y], 1e-9)).mean()
        p[np.arange(n), y] -= 1
        p /= n
        dh = (p @ self.out.T) * (raw > 0)
        d_emb = np.zeros_like(self.embedding)
        d_filters, d_biases = [], []
        for k, w in enumerate(WIDTHS):
            per = self.filters[w].shape[2]
            g = dh[:, k * per : (k + 1) * per]
            where = at[w][:, :, None] + np.arange(w)
            chars = x[np.arange(n)[:, None, None], where]
            d_filters.append(np.einsum("nf,nfwd->wdf", g, self.embedding[chars], optimize=True).astype(np.float32))
            d_biases.append(g.sum(0))
            back = np.einsum("nf,wdf->nfwd", g, self.filters[w], optimize=True)
            np.add.at(d_emb, chars.ravel(), back.reshape(-1, dim))
        return loss, [d_emb, *d_filters, *d_biases, h.T @ p, p.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int, rate: float = 0.01, batch: int = 128) -> None:
        """Adam over shuffled batches, with a rate that falls to a tenth."""
        rng, params = np.random.default_rng(seed), self.parameters()
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        steps = max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                t += 1
                step = rate * (1 - 0.9 * t / steps)
                for k, g in enumerate(self.loss_gradients(x[rows], y[rows])[1]):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    params[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)

    def scorer(self) -> WindowScorer:
        return WindowScorer(self)


class WindowScorer:
    """Applies a trained network: convolutions become sums of looked-up rows, one for each byte pair or byte."""

    def __init__(self, net: ByteConvNet):
        self.net = net
        tap = {(w, j): net.embedding @ net.filters[w][j] for w in WIDTHS for j in range(w)}
        self.pairs, self.single = {}, {}
        for w in WIDTHS:
            for j in range(0, w - 1, 2):
                self.pairs[w, j] = (tap[w, j][:, None, :] + tap[w, j + 1][None, :, :]).reshape(65536, -1)
            if w % 2:
                self.single[w] = tap[w, w - 1]

    def probabilities(self, windows: np.ndarray, group: int = 96) -> np.ndarray:
        """Class probabilities (n, classes) of windows (n, WINDOW)."""
        net, out = self.net, []
        for i in range(0, len(windows), group):
            x = windows[i : i + group]
            pair = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
            pooled = []
            for w in WIDTHS:
                n = WINDOW - w + 1
                z = self.pairs[w, 0][pair[:, :n]]
                for j in range(2, w - 1, 2):
                    z += self.pairs[w, j][pair[:, j : j + n]]
                if w % 2:
                    z += self.single[w][x[:, w - 1 :]]
                pooled.append(np.maximum(z.max(1) + net.biases[w], 0))
            out.append(softmax(np.concatenate(pooled, 1) @ net.out + net.out_bias))
        return np.concatenate(out) if out else np.zeros((0, len(net.labels)), np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cut_windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts (zero-padded at a text's end), the row of each, and its number of bytes."""
    length = np.diff(offsets)
    count = -(-length // WINDOW)
    row = np.repeat(np.arange(len(length)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(WINDOW, length[row] - nth * WINDOW)
    where = (offsets[:-1][row] + nth * WINDOW)[:, None] + np.arange(WINDOW)
    windows = np.where(np.arange(WINDOW) < size[:, None], raw[np.minimum(where, max(0, len(raw) - 1))] if len(raw) else 0, 0)
    return windows.astype(np.uint8), row, size


def sample_windows(labelled: DataFrame, text_col: str, label_col: str, per_label: int, per_doc: int, most_texts: int) -> tuple[np.ndarray, list[str]]:
    """About per_label different texts of each label, per_doc windows of each, spread over the whole text.

    Which texts are taken depends on a hash of them alone; each label's share follows from its number of different
    texts, so no label is lost, whatever its size and however often a text repeats. Many labels share ``most_texts``, each
    with eight texts at least. This is the only sampling; it keeps what reaches the driver under about
    max(most_texts, 8 x labels) x (per_doc + 1) windows of 256 bytes.
    """
    hashed = F.xxhash64(F.col(text_col))
    sizes = labelled.groupBy(label_col).agg(F.count("*").alias("n"), F.approx_count_distinct(hashed, 0.02).alias("texts"))
    counts = {r[label_col]: max(1, r["texts"]) for r in sizes.collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), []
    per_label = min(per_label, max(8, most_texts // len(counts)))
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, per_label / n)))])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = utf8_buffers(b.column(1))
            names = b.column(0).to_pylist()
            got: tuple[list[bytes], list[str]] = ([], [])
            for i in range(b.num_rows):
                text = raw[offsets[i] : offsets[i + 1]]
                starts = np.unique(np.linspace(0, max(0, len(text) - WINDOW), per_doc).astype(int))
                for s in starts:
                    got[0].append(text[s : s + WINDOW].tobytes().ljust(WINDOW, b"\0"))
                    got[1].append(names[i])
                short = text[: min(len(text), 16 + 7 * (len(text) % 16))]  # short texts must be told too
                got[0].append(short.tobytes().ljust(WINDOW, b"\0"))
                got[1].append(names[i])
            yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.binary()), pa.array(got[1], pa.string())], names=["w", "label"])

    rows = (
        labelled.filter(below_share(hashed, F.coalesce(share[F.col(label_col)], F.lit(0.0))))
        .select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))
        .mapInArrow(tidy(take), "w binary, label string")
        .distinct()
        .collect()
    )
    rows.sort(key=lambda r: (r["label"], bytes(r["w"])))
    return np.frombuffer(b"".join(bytes(r["w"]) for r in rows), np.uint8).reshape(-1, WINDOW), [r["label"] for r in rows]


def train_language_model(
    labelled: DataFrame,
    text_col: str = "text",
    label_col: str = "lang",
    per_label: int = 400,
    per_doc: int = 6,
    dim: int = 8,
    per_width: int = 16,
    epochs: int = 6,
    seed: int = 7,
    most_texts: int = 25_600,
) -> ByteConvNet:
    """Fit the network on about ``per_label`` different texts of each label, ``most_texts`` of all together (bounded sample)."""
    labelled = labelled.select(text_col, F.col(label_col).cast("string").alias(label_col)).filter(F.col(label_col).isNotNull() & (F.length(text_col) > 0))
    x, names = sample_windows(labelled, text_col, label_col, per_label, per_doc, most_texts)
    labels = sorted(set(names))
    net = ByteConvNet.fresh(labels, dim, per_width, seed)
    if len(labels) > 1:
        net.train(x, np.searchsorted(labels, names), epochs, seed)
    return net


def identify_language(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """``docs`` -> id, kept columns, lang_pred string, score double; one row for each input row, whole texts."""
    picked = docs.select(F.col(id_col), *(keep or []), F.col(text_col).alias("__text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = net.scorer() if net.labels else None
        for big in batches:
            for start in range(0, big.num_rows, 512):
                b = big.slice(start, 512)
                at = b.schema.get_field_index("__text")
                raw, offsets = utf8_buffers(b.column(at))
                lettered = np.array([has_letter(t) for _, part in texts(b, "__text") for t in part], bool)
                total = np.zeros((b.num_rows, max(1, len(net.labels))))
                weight = np.zeros(b.num_rows)
                for i, j in _blocks(offsets, 1 << 19):
                    windows, row, size = cut_windows(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    if scorer is not None and len(windows):
                        np.add.at(total, row + i, scorer.probabilities(windows) * size[:, None])
                        np.add.at(weight, row + i, size)
                p = total / np.maximum(weight, 1)[:, None]
                best = p.argmax(1)
                known = lettered & (weight > 0)
                pred = [net.labels[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                value = np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k) for k in range(b.num_columns) if k != at), pa.array(pred, pa.string()), pa.array(value, pa.float64())],
                    names=[*(n for n in b.schema.names if n != "__text"), "lang_pred", "score"],
                )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields if f.name != "__text"]
    return picked.mapInArrow(tidy(score), ", ".join([*fields, "lang_pred string", "score double"]))


def _blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes (a longer text is a range of its own)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def keep_identified(docs: DataFrame, net: ByteConvNet, text_col: str = "text", min_score: float = 0.4) -> DataFrame:
    """``docs`` without the rows whose language isn't known (``und``) or whose best language has a lower score; columns as they were."""
    rows, names = numbered(docs)
    row = rows.select(F.lit(0).alias("id"), F.col(f"c{names.index(text_col)}").alias("text"), *rows.columns)
    scored = identify_language(row, net, "id", "text", keep=rows.columns)
    kept = scored.filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return kept.select(*rows.columns).toDF(*names)
