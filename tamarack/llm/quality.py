"""Operator 1: a quality classifier from naive Bayes support vectors.

Features are indicators of hashed byte n-grams. Each is scaled by its class log-count ratio, and a linear hinge-loss model is fitted to
the scaled indicators by dual coordinate descent; its weights are then pulled towards their mean magnitude, as naive Bayes
would have them. Margins of held-back folds give the sigmoid that turns a margin into a probability.
The fit takes a bounded number of labelled rows (a parameter) in one task; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, ORDERS, ROWS = 18, (2, 3, 4), 6000
C, SMOOTHING, BETA, EPOCHS, SEED = 1.0, 1.0, 0.25, 20, 7
THRESHOLD = 0.3


def features(text: str, bits: int = BITS, orders: tuple = ORDERS) -> np.ndarray:
    """The sorted hashed n-grams that the whole text has."""
    b = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
    seen = np.zeros(1 << bits, bool)
    h = np.zeros(len(b), np.uint32)
    for n in range(1, max(orders) + 1):
        if len(b) < n:
            break
        h = (h[: len(b) - n + 1] * np.uint32(0x01000193)) ^ b[n - 1 :] * np.uint32(0x9E3779B1)
        if n in orders:
            mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B) + np.uint32(n)
            seen[mixed >> np.uint32(32 - bits)] = True
    return np.flatnonzero(seen).astype(np.int32)


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """min 1/2 |w|^2 + C sum max(0, 1 - y w x), by coordinate descent on the dual; the last weight is the bias."""
    w, alpha, rng = np.zeros(size + 1), np.zeros(len(rows)), np.random.default_rng(SEED)
    norm = np.array([v @ v + 1.0 for v in values])
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            grad = y[i] * (values[i] @ w[rows[i]] + w[size]) - 1
            new = min(max(alpha[i] - grad / norm[i], 0.0), C)
            if step := new - alpha[i]:
                w[rows[i]] += step * y[i] * values[i]
                w[size] += step * y[i]
                alpha[i], moved = new, max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def weigh(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Weights of the plain indicators, and the bias; a document's margin is their sum over its features, divided by the norm."""
    p, q = np.full(size, SMOOTHING), np.full(size, SMOOTHING)
    for r, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[r] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    values = [scaled(ratio, r) for r in rows]
    w = descend(rows, values, y, size)
    mean = np.abs(w[:size]).mean()
    return np.concatenate([ratio, (1 - BETA) * mean + BETA * w[:size], w[size:]])


def scaled(ratio: np.ndarray, r: np.ndarray) -> np.ndarray:
    v = ratio[r]
    return v / (np.sqrt(v @ v) or 1.0)


def margin(model: np.ndarray, r: np.ndarray) -> float:
    size = len(model) // 2
    return float(scaled(model[:size], r) @ model[size + r]) + model[2 * size]


def sigmoid_of(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))), with smoothed targets, by Newton's method."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, ab = np.stack([margins, np.ones_like(margins)], 1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        grad, hess = x.T @ (p - t), (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        ab -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(ab[0], 1e-6)), float(ab[1])


def fit(texts: list[str], labels: list[int], bits: int = BITS) -> np.ndarray:
    """Model: ratios, weights, bias, and the sigmoid's a and b. With rows of one class or none, scores are that class's smoothed share."""
    y = np.where(np.array(labels, float) > 0, 1.0, -1.0)
    size = 1 << bits
    if not len(y) or (y == y[0]).all():
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return np.concatenate([np.zeros(2 * size + 1), [1.0, np.log(share / (1 - share))]])
    rows = [features(t, bits) for t in texts]
    out = np.zeros(len(y))
    for k in range(2):
        own = np.arange(len(y)) % 2 == k
        if len(set(y[~own])) == 2:
            model = weigh([rows[i] for i in np.flatnonzero(~own)], y[~own], size)
            out[own] = [margin(model, rows[i]) for i in np.flatnonzero(own)]
    return np.concatenate([weigh(rows, y, size), sigmoid_of(out, y)])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that no label is learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def trained(docs: DataFrame, labels: DataFrame, rows: int = ROWS, bits: int = BITS) -> np.ndarray:
    """Fits on the `rows` labelled ids of least hash that are not held out. Labels that are null, or whose ids are null or contradict each
    other, teach nothing. Of rows with one id, the least text teaches, so that reruns agree. The rows' texts meet in one task; their number is
    the bound."""
    known = labels.select(F.col("doc_id").cast("long").alias("id_"), F.col("quality").cast("int").alias("label_")).dropna().filter(~held_out(F.col("id_")))
    known = known.groupBy("id_").agg(F.min("label_").alias("label_"), F.max("label_").alias("high_")).filter("label_ = high_").drop("high_")
    picked = known.orderBy(F.xxhash64("id_"), "id_").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id_"), F.coalesce("text", F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(picked), "id_").groupBy("id_", "label_").agg(F.min("text").alias("text"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id_")
        return pd.DataFrame({"model": [fit(list(b["text"]), list(b["label_"]), bits).tobytes()]})

    got = sample.groupBy(F.lit(0).alias("all")).applyInPandas(run, "model binary").collect()  # one row of a fixed size
    return np.frombuffer(got[0][0]) if got else fit([], [], bits)


def scored(docs: DataFrame, labels: DataFrame, rows: int = ROWS, threshold: float = THRESHOLD, bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, from the whole text and nothing else; with keep, those columns of docs,
    then score and predicted. Null and empty texts get the score of a text without features. Repeated rows get equal scores."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, rows, bits))

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model.value
        a, b = m[-2:]
        for s in texts:
            z = np.array([margin(m[:-2], features(t, bits)) for t in s])
            yield pd.Series(1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))), dtype=float)

    rated = F.pandas_udf(score, "double")
    score_of = docs.withColumn("score_", rated(F.coalesce(F.col("text"), F.lit(""))))
    first = [F.col(f"`{c}`") for c in keep] if keep is not None else [F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out")]
    return score_of.select(*first, F.col("score_").alias("score"), (F.col("score_") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier predicts as of quality, with docs' columns. Null and empty texts are predicted as a text without
    features is; null ids and repeated rows stay or go by their texts alone; an empty table gives an empty table."""
    marked = docs.withColumn("row_", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return scored(marked, labels, keep=["row_"], **options).filter("predicted = 1").select("row_.*")
