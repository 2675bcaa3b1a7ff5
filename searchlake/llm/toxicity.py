"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams (three to five code points of the lower-cased text, word
borders as spaces). Each is present or absent; its value is its log-count ratio between
the classes, and a logistic regression weighs the values. Features are those with the
most significant ratios, so that long clean texts don't gather noise.

Training reads a bounded sample: the TRAIN_ROWS distinct labelled rows (id and text) with the
smallest hashes, whole texts; counting and feature extraction run on the executors, and the
driver receives at most FEATURES weights and the sample's feature lists. Scoring reads
every text whole. Labels, lang, source and doc_id are never inputs of a score.

Cases: null text counts as empty and gets the model's bias; repeated labels of a document
count as toxic if one says so; null labels and ids are left out of training; without both
classes in the sample all scores are the sample's share of toxic rows (0 if none). Rows with
one text have one score, ties included. Very long texts are read whole, in memory of a few
numbers per code point. Extra columns aren't read, whatever their names; drop_toxic keeps
them; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlake.llm.common import Scratch, sample_rows

ORDERS, BITS = (3, 4, 5), 20
TRAIN_ROWS, FEATURES, MIN_ROWS, MIN_Z = 12_000, 4096, 4, 4.0
THRESHOLD = 0.7


def held_out(id_col: str) -> Column:
    """Rows that training leaves out: a third, by a checksum of the id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def hashed(text: str) -> list[np.ndarray]:
    """Hashed n-grams at every position, one array per order."""
    points = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], points * np.uint32(0x9E3779B1)
    for order in range(2, max(ORDERS) + 1):
        if len(points) < order:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + points[order - 1 :] * np.uint32(0x9E3779B1)
        if order in ORDERS:
            out.append(((h ^ (h >> np.uint32(16))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
    return out


def features(text: str) -> np.ndarray:
    found = hashed(text)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


class Model:
    """bias + sum of the weights of the features that a text holds."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float):
        self.bias = bias
        self.ids, self.weights = ids.astype(np.int64), weights.astype(np.float64)
        self.chosen = np.zeros(1 << BITS, bool)
        self.chosen[self.ids] = True
        self.weight = np.zeros(1 << BITS, np.float64)
        self.weight[self.ids] = self.weights

    def __reduce__(self):
        return Model, (self.ids, self.weights, self.bias)

    def score(self, text: str) -> float:
        hits = [h[self.chosen[h]] for h in hashed(text)]
        total = self.bias + (float(self.weight[np.unique(np.concatenate(hits))].sum()) if hits else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -500, 500))))


def logistic(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, l2: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights on features scaled by r, and the bias, by accelerated gradient descent."""
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    at = np.concatenate(rows) if rows else np.empty(0, np.int64)
    value = r[at]
    n, w, b = len(rows), np.zeros(len(r)), float(np.log(y.mean() / (1 - y.mean())))
    size = np.bincount(owner, value * value, minlength=n)
    direction = np.ones(len(r) + 1)
    for _ in range(15):  # the largest curvature, by power iteration
        direction /= np.linalg.norm(direction)
        z = np.bincount(owner, value * direction[at], minlength=n) + direction[-1]
        direction = np.append(np.bincount(at, value * z[owner], minlength=len(r)), z.sum())
    rate = 1.0 / (0.3 * float(np.linalg.norm(direction)) + l2)
    vw, vb, last = w, b, (w, b)
    for step in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(np.bincount(owner, value * vw[at], minlength=n) + vb, -500, 500)))
        error = p - y
        gw = np.bincount(at, value * error[owner], minlength=len(r)) + l2 * vw
        w, b = vw - rate * gw, vb - rate * error.sum()
        beta = step / (step + 3)
        vw, vb = w + beta * (w - last[0]), b + beta * (b - last[1])
        last = (w, b)
    return w, b


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled rows of docs; the caller leaves held-out rows out of labels."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    texts = Scratch(docs.sparkSession, "toxicity").write(sample_rows(docs, id_col, text_col, rows, known=known).select("__text", "__y"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 1 << BITS), np.int32)
        seen = [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found[int(y > 0), features(text.as_py())] += 1
                seen[int(y > 0)] += 1
        some = np.flatnonzero(found.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(found[0, some], seen[0]).astype(np.int64)), pa.array(np.append(found[1, some], seen[1]).astype(np.int64))], names=["f", "n0", "n1"])

    counts = texts.mapInArrow(count, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(f"f < 0 or n0 + n1 >= {MIN_ROWS}")
    counts = counts.toArrow()  # at most 2**BITS rows
    f, n0, n1 = (counts.column(c).to_numpy() for c in ("f", "n0", "n1"))
    if not (f < 0).any() or not n1[f < 0][0] or not n0[f < 0][0]:
        share = 1.0 if len(f) and n1[f < 0].sum() else 0.0
        return Model(np.empty(0, np.int64), np.empty(0), 500.0 if share else -500.0)
    all0, all1 = int(n0[f < 0][0]), int(n1[f < 0][0])
    own = f >= 0
    f, p, q = f[own], (n1[own] + 1.0) / (all1 + 2.0), (n0[own] + 1.0) / (all0 + 2.0)
    ratio = np.log(p / q)
    z = ratio / np.sqrt(1 / (n1[own] + 1.0) + 1 / (n0[own] + 1.0))
    best = np.lexsort((f, -np.abs(z)))[:FEATURES]
    best = np.sort(best[np.abs(z[best]) >= MIN_Z])
    ids, r = f[best], ratio[best]
    place = np.full(1 << BITS, -1, np.int32)
    place[ids] = np.arange(len(ids))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for text in batch.column(0):
                at = place[features(text.as_py())]
                lists.append(at[at >= 0].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.binary())], names=["y", "x"])

    sample = texts.mapInArrow(extract, "y int, x binary").toArrow()
    x = [np.frombuffer(v, np.int32).astype(np.int64) for v in sample.column("x").to_pylist()]
    y = (sample.column("y").to_numpy() > 0).astype(float)
    order = sorted(range(len(x)), key=lambda i: (y[i], x[i].tobytes()))  # whatever order the rows came in
    w, b = logistic([x[i] for i in order], y[order], r)
    return Model(ids, w * r, b)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold; rows are judged where they are read."""

    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return docs.where(F.pandas_udf(scores, "double")(F.coalesce(F.col(text_col), F.lit(""))) < threshold)
