"""Language identification by a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import draw, id_text, table
from ledgerlens.llm.toxicity import id_remainder

#: Bytes of a window, filter widths, filters of each width, size of a byte's vector.
WINDOW, WIDTHS, FILTERS, DIM = 128, (2, 3, 4, 5), 8, 8
#: At most this many rows are learnt from, those with the least hash of id, and this many windows of each, drawn from its whole text.
TRAIN_ROWS, TRAIN_WINDOWS = 2000, 8
#: Windows that go through the network at a time.
BATCH = 256
_WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is of one of Unicode's categories of letters (L*): not a fraction, a superscript or a Roman numeral."""
    return any(m[0].isalpha() for m in _WORD.finditer(text))


def windows(data: bytes) -> np.ndarray:
    """Every byte in windows of WINDOW bytes, which overlap by what the widest filter needs; the last is filled up with zeros."""
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    b = np.zeros((n - 1) * step + WINDOW, np.uint8)
    b[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(b, WINDOW)[::step]


@dataclass
class Network:
    names: list[str]
    emb: np.ndarray  # 256 x DIM; row 0, the filling, is zero
    kernel: np.ndarray  # (widest x DIM) x all filters; narrow filters are zero beyond their width
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def columns(self, w: np.ndarray) -> np.ndarray:
        """(windows x positions) x (widest x DIM): the vectors of the bytes from each position."""
        x = self.emb[w]
        p = w.shape[1] - max(WIDTHS) + 1
        return np.concatenate([x[:, k : k + p] for k in range(max(WIDTHS))], 2)

    def pooled(self, w: np.ndarray) -> np.ndarray:
        x = self.columns(w)
        return np.maximum((x.reshape(-1, x.shape[2]) @ self.kernel).reshape(len(w), x.shape[1], -1).max(1) + self.shift, 0)

    def logits(self, w: np.ndarray) -> np.ndarray:
        return self.pooled(w) @ self.out + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language with the highest mean logit over all windows of each text, and its share of the softmax."""
        total, count = np.zeros((len(texts), len(self.names))), np.zeros(len(texts))
        held, who, n = [], [], 0

        def work() -> None:
            w, i = np.concatenate(held), np.concatenate(who)
            for s in range(0, len(w), BATCH):
                z, at = self.logits(w[s : s + BATCH]), i[s : s + BATCH]
                np.add.at(total, at, z)
                np.add.at(count, at, 1)

        known = [t is not None and has_letter(t) for t in texts]
        if self.names:
            for i, text in enumerate(texts):
                if not known[i]:
                    continue
                all_ = windows(text.encode("utf-8", "surrogatepass"))
                for s in range(0, len(all_), 8192):
                    held.append(all_[s : s + 8192])
                    who.append(np.full(len(held[-1]), i))
                    n += len(held[-1])
                    if n >= 8192:
                        work()
                        held, who, n = [], [], 0
            if held:
                work()
        langs, scores = [], []
        for i in range(len(texts)):
            if not known[i] or not self.names:
                langs.append("und")
                scores.append(0.0)
                continue
            z = total[i] / count[i]
            p = np.exp(z - z.max())
            langs.append(self.names[int(z.argmax())])
            scores.append(float(p.max() / p.sum()))
        return langs, scores


def gradients(net: Network, b: np.ndarray, t: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the mean weighted cross-entropy of windows b with labels t, by the network's emb, kernel, shift, out and bias."""
    x = net.columns(b)
    pre = (x.reshape(-1, x.shape[2]) @ net.kernel).reshape(len(b), x.shape[1], -1)
    best = pre.argmax(1)  # window x filter
    top = np.take_along_axis(pre, best[:, None], 1)[:, 0] + net.shift
    act = np.maximum(top, 0)
    z = act @ net.out + net.bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(b)), t] -= 1
    p *= weight[t][:, None] / len(b)
    back = (p @ net.out.T) * (top > 0)
    patch = x[np.arange(len(b))[:, None], best]  # window x filter x (wide x DIM)
    g_kernel = np.einsum("bfk,bf->kf", patch, back) * live_weights()
    g_patch = back[:, :, None] * net.kernel.T[None]
    g_emb = np.zeros_like(net.emb)
    for k in range(max(WIDTHS)):
        np.add.at(g_emb, b[np.arange(len(b))[:, None], best + k], g_patch[:, :, k * DIM : (k + 1) * DIM])
    g_emb[0] = 0
    return g_emb, g_kernel, back.sum(0), act.T @ p, p.sum(0)


def live_weights() -> np.ndarray:
    """1 for the kernel's weights within each filter's width, 0 beyond."""
    live = np.zeros((max(WIDTHS), DIM, FILTERS * len(WIDTHS)), np.float32)
    for j, width in enumerate(WIDTHS):
        live[:width, :, j * FILTERS : (j + 1) * FILTERS] = 1
    return live.reshape(-1, live.shape[2])


def train(texts: list[str], langs: list[str], epochs: int = 6, rate: float = 0.01, seed: int = 3, max_windows: int = TRAIN_WINDOWS) -> Network:
    """Adam on cross-entropy over at most max_windows windows of each text, drawn from all; a window carries its text's label."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    w, y = [], []
    for text, lang in zip(texts, langs, strict=True):
        if not has_letter(text):
            continue
        own = windows(text.encode("utf-8", "surrogatepass"))
        own = own[np.sort(rng.permutation(len(own))[:max_windows])]
        w.append(own)
        y += [names.index(lang)] * len(own)
    wide, filters = max(WIDTHS), FILTERS * len(WIDTHS)
    live = live_weights()
    net = Network(names, rng.normal(0, 0.5, (256, DIM)).astype(np.float32), rng.normal(0, 0.2, (wide * DIM, filters)).astype(np.float32) * live, np.zeros(filters, np.float32), rng.normal(0, 0.2, (filters, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    net.emb[0] = 0
    if not w or len(names) < 2:
        return net
    w, y = np.concatenate(w), np.array(y)
    weight = (len(y) / len(names) / np.maximum(1, np.bincount(y, minlength=len(names)))).astype(np.float32)
    params = [net.emb, net.kernel, net.shift, net.out, net.bias]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(w))
        for s in range(0, len(w), 128):
            at = order[s : s + 128]
            grads = gradients(net, w[at], y[at], weight)
            step += 1
            for param, grad, (m, v) in zip(params, grads, state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad**2 - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, may_learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = TRAIN_ROWS, max_windows: int = TRAIN_WINDOWS) -> Network:
    """Train on at most max_rows rows with id, text and language (common.draw) and max_windows windows of each, whatever the size of docs."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null and doc_id is not null")
    rows = rows if may_learn is None else rows.where(may_learn)
    got = draw(rows, max_rows).toPandas()
    return train(got["text"].tolist(), got["lang"].tolist(), max_windows=max_windows)


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score.

    All windows of the whole text count. Null texts and texts without a letter
    (has_letter) are `und` with score 0, as is everything if nothing could be learnt. Null ids and
    repeated rows are rows like others; other columns are not read.
    """
    told = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [], []
            for i in range(0, b.num_rows, 200):
                own = told.value.predict(b.column("text").slice(i, 200).to_pylist())
                langs += own[0]
                scores += own[1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from rows that aren't held out, predicted for every row."""
    net = fit(docs, id_remainder(F.col("doc_id"), 4) != 2)
    return predict(docs, net).select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
