"""Quality classifier: attention-based multiple-instance learning (operator 3).

A document is a bag of passages of PASSAGE words. One hidden layer encodes each passage from what it says,
the mean of learnt vectors of its hashed words, and from its shape (case, signs, separators, repetition,
word lengths). Gated attention, softmax of w . (tanh(V h) * sigmoid(U h)), learnt from document labels
alone, weighs the passages, and a logistic layer scores the weighted representation.

Null and empty texts are one empty passage. Every passage of a text counts, in training too, whatever its
length; training takes a bounded sample of rows: SAMPLE of them, fewer where they have over PASSAGES
passages together. Repeated rows have equal scores; an empty table gives an empty result, and one without
labels the score 0.5. The score is a new column that replaces one of its name; other extra columns pass
through.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verseloom.llm.labelled import training_texts
from verseloom.llm.shared import map_arrow, rows
from verseloom.llm.word_hash import token_hashes

#: Words of a passage; labelled rows to train on, and their passages, at most.
PASSAGE, SAMPLE, PASSAGES = 64, 8_000, 150_000
HELD_FOLDS, HELD_FOLD = 5, 0
THRESHOLD = 0.3
HIDDEN, GATE, BATCH = 24, 12, 128
#: Passes over the sample, and steps, at least.
EPOCHS, STEPS = 12, 600
#: Shape features of a passage, and vectors that its hashed words share.
FEATURES, BUCKETS = 16, 1024
_KIND = bytearray(b"o" * 256)
for _chars, _k in ((range(65, 91), "U"), (range(97, 123), "L"), (range(48, 58), "D"), (b"!?", "!"), (b"#$%&*@^~=+<>", "$"), (b"|", "|"), (b".,;:", "."), (b" \n\t", " "), (range(0xC0, 0xDF), "U"), (range(0xDF, 0x100), "L")):
    for _c in _chars:
        _KIND[_c] = ord(_k)
_KIND = bytes(_KIND)


def passage_features(words: list[str]) -> list[float]:
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    joined = " ".join(words)
    kinds = joined.encode("latin-1", "replace").translate(_KIND)
    size = len(kinds)
    upper, lower = kinds.count(b"U"), kinds.count(b"L")
    letters = upper + lower + 1
    distinct = len(set(words))
    body = size - n + 1
    return [
        upper / letters,
        letters / size,
        kinds.count(b"!") / n,
        kinds.count(b"$") / n,
        kinds.count(b"|") / n,
        kinds.count(b"D") / size,
        kinds.count(b".") / n,
        distinct / n,
        distinct / 64,
        body / n / 10,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        n / PASSAGE,
        float(n < 8),
        max(map(len, words)) / 30,
        kinds.count(b"o") / size,
        kinds.count(b" U") / n,
    ]


class Bags(NamedTuple):
    """Passages of several texts in a row: shapes, word buckets, first words of the passages, first passages of the texts."""

    shapes: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    firsts: np.ndarray


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shapes of all passages of a text, and the buckets of its words."""
    words = text.split()
    starts = range(0, max(1, len(words)), PASSAGE)
    shapes = np.array([passage_features(words[k : k + PASSAGE]) for k in starts], np.float32)
    return shapes, (token_hashes(words) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.uint16)


def joined(bags: list[tuple[np.ndarray, np.ndarray]]) -> Bags:
    starts, firsts, at, upto = [], [], 0, 0
    for shapes, words in bags:
        firsts.append(at)
        starts.append(upto + PASSAGE * np.arange(len(shapes)))
        at, upto = at + len(shapes), upto + len(words)
    return Bags(np.concatenate([s for s, _ in bags]), np.concatenate([w for _, w in bags]), np.concatenate(starts), np.array(firsts))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionMil:
    """The network, its gradient and its Adam training."""

    NAMES = ("w1", "words", "b1", "v", "u", "w", "out", "bias")

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.p = params

    @classmethod
    def fresh(cls, mean: np.ndarray, std: np.ndarray, prior: float) -> AttentionMil:
        rng = np.random.default_rng(7)
        make = lambda *s: rng.normal(0, 1 / np.sqrt(s[-1]), s)
        return cls(
            {"mean": mean, "std": std, "w1": make(HIDDEN, len(mean)), "words": 0.1 * make(BUCKETS, HIDDEN), "b1": np.zeros(HIDDEN), "v": make(GATE, HIDDEN), "u": make(GATE, HIDDEN), "w": make(GATE), "out": make(HIDDEN), "bias": np.array([prior])}
        )

    def said(self, bags: Bags) -> tuple[np.ndarray, np.ndarray]:
        """Mean vector of each passage's words, and their number (1 at least)."""
        sizes = np.diff(np.append(bags.starts, len(bags.words)))
        out = np.zeros((len(sizes), HIDDEN))
        if len(bags.words):
            filled = np.flatnonzero(sizes)
            out[filled] = np.add.reduceat(self.p["words"][bags.words], bags.starts[filled], axis=0)
        sizes = np.maximum(sizes, 1)
        return out / sizes[:, None], sizes

    def forward(self, bags: Bags) -> tuple:
        p, first = self.p, bags.firsts
        x = (bags.shapes - p["mean"]) / p["std"]
        h = np.maximum(x @ p["w1"].T + self.said(bags)[0] + p["b1"], 0)
        tv, su = np.tanh(h @ p["v"].T), _sigmoid(h @ p["u"].T)
        e = (tv * su) @ p["w"]
        sizes = np.diff(np.append(first, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        a = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return x, h, tv, su, a, z, sizes, _sigmoid(z @ p["out"] + p["bias"][0])

    def gradient(self, bags: Bags, y: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, bags.firsts
        x, h, tv, su, a, z, sizes, s = self.forward(bags)
        d = (s - y) / len(y)
        dz = np.repeat(d[:, None] * p["out"], sizes, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), sizes))
        dg = de[:, None] * p["w"]
        dv, du = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
        dh = (a[:, None] * dz + dv @ p["v"] + du @ p["u"]) * (h > 0)
        n = np.diff(np.append(bags.starts, len(bags.words)))
        passage = np.repeat(np.arange(len(n)), n)
        counts = np.bincount(passage * BUCKETS + bags.words, minlength=len(n) * BUCKETS).reshape(len(n), BUCKETS).astype(np.float32)
        words = counts.T @ (dh / np.maximum(n, 1)[:, None]).astype(np.float32)
        return {"w1": dh.T @ x, "words": words, "b1": dh.sum(0), "v": dv.T @ h, "u": du.T @ h, "w": (tv * su).T @ de, "out": z.T @ d, "bias": np.array([d.sum()])}

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        rng = np.random.default_rng(11)
        m, v = ({k: np.zeros_like(self.p[k]) for k in self.NAMES} for _ in range(2))
        t, epochs = 0, max(EPOCHS, -(-STEPS // -(-len(bags) // BATCH)))
        for epoch in range(epochs):
            rate = 0.01 * 0.5 ** (4 * epoch // epochs)
            order = rng.permutation(len(bags))
            for lo in range(0, len(order), BATCH):
                g = self.gradient(joined([bags[k] for k in order[lo : lo + BATCH]]), y[order[lo : lo + BATCH]])
                t += 1
                for k in self.NAMES:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    step = m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                    self.p[k] = self.p[k] - rate * (step + 1e-3 * self.p[k])

    def scores(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return self.forward(joined(bags))[-1]

    def dumps(self) -> str:
        return json.dumps({k: v.tolist() for k, v in self.p.items()})


@functools.lru_cache(maxsize=4)
def loads(text: str) -> AttentionMil:
    return AttentionMil({k: np.array(v) for k, v in json.loads(text).items()})


def train(docs: DataFrame, labels: DataFrame, folds: int = HELD_FOLDS, fold_out: int = HELD_FOLD, most: int = SAMPLE) -> AttentionMil:
    sample = training_texts(docs, labels, "quality", folds, fold_out, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, label in rows(batches):
            bags = [bag(t) for t in texts]
            order = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(order, pa.binary()), *(pa.array([b[k].tobytes() for b in bags], pa.binary()) for k in range(2))], ["label", "name", "shapes", "words"])

    # sorted, so that training repeats; whole rows until they have PASSAGES passages
    made = map_arrow(sample, run, "label int, name binary, shapes binary, words binary")
    size = F.octet_length("shapes") / (4 * FEATURES)
    upto = F.sum(size).over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    data = made.withColumn("upto", upto).where(F.col("upto") <= PASSAGES).orderBy("name").collect()  # SAMPLE rows of PASSAGES passages at most
    bags = [(np.frombuffer(r.shapes, np.float32).reshape(-1, FEATURES), np.frombuffer(r.words, np.uint16)) for r in data]
    y = np.array([r.label for r in data], np.float64)
    if not len(y):
        model = AttentionMil.fresh(np.zeros(FEATURES), np.full(FEATURES, 1e30), 0.0)
        model.p["words"] *= 0
        return model
    flat, rate = np.concatenate([s for s, _ in bags]).astype(np.float64), np.clip(y.mean(), 0.01, 0.99)
    model = AttentionMil.fresh(flat.mean(0), flat.std(0) + 0.05, float(np.log(rate / (1 - rate))))
    model.fit(bags, y)
    return model


def with_score(docs: DataFrame, model: AttentionMil, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the quality of each whole text."""
    packed = docs.sparkSession.sparkContext.broadcast(model.dumps())  # as large as the network
    plain = docs.drop(score_col)
    at = plain.columns.index(text_col)
    names = [*plain.columns, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loads(packed.value)
        for batch in batches:
            scores: list[np.ndarray] = []
            for lo in range(0, batch.num_rows, 128):
                scores.append(model.scores([bag(t.as_py() or "") for t in batch.column(at).slice(lo, 128)]))
            flat = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flat, pa.float64())], names)

    return map_arrow(plain, run, T.StructType([*plain.schema.fields, T.StructField(score_col, T.DoubleType())]))
