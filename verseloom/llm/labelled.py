"""Bounded samples of labelled texts, which the two classifiers train on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.llm.shared import crc_mod, materialize


def training_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled rows outside the held-out fold, taken in the order of a hash of the id.

    The ids of the sample are broadcast: their number is bounded by ``most``. Equal texts are one row, with the
    label of most of theirs (1 where they tie), so the sample is the same each time.
    """
    chosen = labels.where((crc_mod("doc_id", folds) != fold) & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("text", "label", F.md5("text").alias("key"))
    one = sample.groupBy("key").agg(F.first("text").alias("text"), (F.avg("label") >= 0.5).cast("int").alias("label"))
    return materialize(one.select("text", "label"), f"train-{label}").repartition(8, F.xxhash64("text"))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (the bias last) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / max(1, len(y)) + l2 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / max(1, len(y)) + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w
