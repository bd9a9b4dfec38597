"""Toxicity by a linear softmax over averaged subword embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import id_text, table

#: Bytes of the character n-grams of a word with its borders, and buckets that they are hashed into.
GRAMS, BUCKETS = (3, 4, 5, 6), 1 << 18
#: The dependence of a gram's presence on the label (chi-square) at which the gram has half its weight in a text's mean.
CHI2 = 30
#: How many times as likely a toxic text is to have a gram as another text, where the gram has half its weight.
LIFT = 4
#: How fast weights fall below these two.
STEEP = 3
#: The weight of neutral grams that every text's mean has besides its own, so that one gram is weak evidence and a word's many are strong.
PAD = 10
#: At most this many labelled rows are learnt from, those with the least hash of id.
TRAIN_ROWS = 4000
#: Bytes of text that a task works on at a time.
SLICE = 1 << 18
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 32 and not 0x7F <= c < 0x80 else 32 for c in range(256))
_PUNCTUATION = bytes(32 if c < 128 and not (48 <= c <= 57 or 97 <= c <= 122) else c for c in range(256))


def grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position) of each n-gram of folded bytes that lies in one word with its borders."""
    b = np.frombuffer(b" " + data + b" ", np.uint8)
    blank = b == 32
    # how far the word that a position stands in, or the border before it, still goes: to the next blank
    ends = np.flatnonzero(blank)
    at = np.arange(len(b))
    after = np.append(ends, len(b))[np.searchsorted(ends, at, "right")]
    out, where = [], []
    wide = b.astype(np.uint64)
    for n in GRAMS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        ok = np.flatnonzero(at[:m] + n - 1 <= after[:m])
        h = np.full(len(ok), n, np.uint64)
        for k in range(n):
            h = (h ^ wide[ok + k]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        out.append((h & np.uint64(BUCKETS - 1)).astype(np.int64))
        where.append(ok)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(where)


def fold(text: str) -> bytes:
    """A-Z lower-cased, ASCII punctuation and controls as blanks."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).translate(_PUNCTUATION)


@dataclass
class Model:
    """weight: of each bucket in a text's mean; value: its embedding times the output's weights; bias: the output's."""

    weight: np.ndarray
    value: np.ndarray
    bias: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """The weighted mean value over all grams of each whole text and PAD of neutral ones, plus the bias; texts are laid end to end in slices of bounded length."""
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        share = self.weight * self.value
        held: list[tuple[int, bytes]] = []
        size = 0

        def work() -> None:
            begins = np.cumsum([0, *(len(t) + 1 for _, t in held)])[:-1]
            who = np.array([i for i, _ in held])
            g, at = grams(b" ".join(t for _, t in held))
            doc = who[np.searchsorted(begins, at, "right") - 1]
            np.add(total, np.bincount(doc, share[g], len(texts)), out=total)
            np.add(count, np.bincount(doc, self.weight[g], len(texts)), out=count)

        for i, text in enumerate(texts):
            data = fold(text)
            while data is not None:
                part, data = _cut(data)
                held.append((i, part))
                size += len(part)
                if size >= SLICE:
                    work()
                    held, size = [], 0
        if held:
            work()
        return total / (count + PAD) + self.bias


def _cut(data: bytes) -> tuple[bytes, bytes | None]:
    """At a blank, if there is one, after SLICE bytes."""
    if len(data) <= SLICE:
        return data, None
    end = data.find(b" ", SLICE)
    return (data, None) if end < 0 else (data[:end], data[end + 1 :])


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole text's grams, from slices of bounded length."""
    data, parts = fold(text), []
    while data is not None:
        part, data = _cut(data)
        parts.append(np.unique(grams(part)[0], return_counts=True))
    if len(parts) == 1:
        return parts[0]
    g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return g, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def gram_weights(present: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A weight above 0 for every gram; present: how many of the n texts of each label have it, a row for each label.

    Close to 1 for grams that mark toxic texts, surely and much more often than
    others; almost 0 for those as common in both, which would drown the few
    telling words of a long text.
    """
    df, rate = present.sum(0), n[1] / n.sum()
    spread = df * rate * (1 - rate) * (1 - df / n.sum())
    chi2 = (present[1] - df * rate) ** 2 / np.maximum(spread, 1e-9)
    lift = (present[1] + 0.1) * (n[0] + 0.2) / ((present[0] + 0.1) * (n[1] + 0.2))
    return 1 / ((1 + (CHI2 / np.maximum(chi2, 1e-2)) ** STEEP) * (1 + (LIFT / np.maximum(lift, 1e-2)) ** STEEP))


def gradients(emb: np.ndarray, out: np.ndarray, bias: np.ndarray, doc: np.ndarray, gram: np.ndarray, share: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the mean cross-entropy by emb, out and bias; (doc, gram, share): how much of each text's mean each gram is."""
    n, k = len(truth), len(emb)
    mean = np.stack([np.bincount(doc, share * emb[gram, j], n) for j in range(emb.shape[1])], 1)
    z = mean @ out + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    d = (p - truth) / n
    back = d @ out.T
    return np.stack([np.bincount(gram, share * back[doc, j], k) for j in range(emb.shape[1])], 1), mean.T @ d, d.sum(0)


def train(texts: list[str], toxic: list[int], dim: int = 8, epochs: int = 16, batch: int = 256, rate: float = 0.1, seed: int = 1) -> Model:
    """Embeddings and softmax jointly, over the texts' weighted means of the embeddings of all their grams.

    Every gram is in the mean, by its weight (gram_weights); those that are less than a
    millionth of a text's mean aren't held for it while training. Each step takes a
    batch of texts and moves each number by its gradient over the root of
    the sum of its squared gradients. A misspelling or an unseen ending shares
    most of its grams, and so vectors, with the word.
    """
    y, n = np.array(toxic, int), len(texts)
    if len(set(toxic)) < 2:  # nothing to tell apart: the rate of what there is
        share = float(np.clip(y.mean(), 0.01, 0.99)) if n else 0.5
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    present = np.zeros((2, BUCKETS))
    for t, label in zip(texts, y, strict=True):
        present[label, _bag(t)[0]] += 1
    weight = gram_weights(present, np.bincount(y, minlength=2))
    bags = []
    for t in texts:
        g, c = _bag(t)
        share = weight[g] * c / (weight[g] @ c + PAD)
        live = share > 1e-6  # the rest moves a mean by less than rounding does here
        bags.append((g[live].astype(np.int32), share[live].astype(np.float32)))
    rng = np.random.default_rng(seed)
    params = (rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32), rng.normal(0, 0.5, (dim, 2)), np.zeros(2))
    squares = [np.full_like(p, 1e-6) for p in params]
    truth = np.eye(2)[y]
    for _ in range(epochs):
        order = rng.permutation(n)
        for s in range(0, n, batch):
            at = order[s : s + batch]
            doc = np.repeat(np.arange(len(at)), [len(bags[i][0]) for i in at])
            gram, share = (np.concatenate([bags[i][k] for i in at]) for k in (0, 1))
            own, place = np.unique(gram, return_inverse=True)
            grads = gradients(params[0][own], params[1], params[2], doc, place, share, truth[at])
            for param, square, grad, rows in zip(params, squares, grads, (own, slice(None), slice(None)), strict=True):
                square[rows] += grad**2
                param[rows] -= rate * grad / np.sqrt(square[rows])
    emb, out, bias = params
    return Model(weight, emb @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_rows: int = TRAIN_ROWS) -> Model:
    """Train on whole texts of at most max_rows labelled ids, those with the least hash, whatever the size of docs.

    An id that repeats in labels is toxic if any of its rows is; one that repeats in docs gives the text with the least hash.
    """
    told = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    told = told if may_learn is None else told.where(may_learn)
    # the ids are drawn before any text is read
    told = told.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    met = id_text(docs, id_col, text_col).join(F.broadcast(told), F.col("doc_id") == F.col("_id"))
    rows = met.groupBy("doc_id", "_toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).toPandas().sort_values("doc_id")
    return train(rows["text"].tolist(), rows["_toxic"].astype(int).tolist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and score, the softmax's share for label 1.

    Every gram of the whole text counts. Texts without any (null, empty) get the
    score of the bias. Null ids and repeated rows are rows like others; other
    columns are not read.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.concatenate([told.value.logits(b.column("text").slice(i, 500).to_pylist()) for i in range(0, b.num_rows, 500)]) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def id_remainder(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; of a null id that of the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from labelled rows that aren't held out, scored for every row."""
    model = fit(docs, labels, id_remainder(F.col("_id"), 3) != 1)
    return score(docs, model).select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold; the model has learnt from all labels."""
    model = fit(docs, labels, None, id_col, text_col, max_rows)
    told = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def logit(texts):
        import pandas as pd

        return pd.Series(told.value.logits(["" if t is None else t for t in texts]))

    return docs.where(1 / (1 + F.exp(-logit(docs[text_col].cast("string")))) < threshold)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
