"""Document fingerprints by consistent weighted sampling (operator 1).

A document's terms are its words (folded case), weighted by the characters they cover (count times
length), so short function words don't make strangers alike. SAMPLES gamma-based samples a document,
16 bits each, are its fingerprint; the share of equal samples estimates the generalised Jaccard
similarity of the weighted words. A text without words is one term, a blank or null text none. Each
sample of each term has its own draws, so the standard error is that of SAMPLES coin throws at any length.

Neighbours in descending doc_id come from one range shuffle: quantiles of the ids are the first ids of
the partitions, and the row that opens a partition is also sent to the one before, so no task waits
for another and no window spans the table. Null ids come last, rows that repeat an id go by text,
exact repeats are interchangeable. Texts are read whole, whatever their length; an empty table gives
an empty result. Only the two columns named are read, so extra columns don't clash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.llm.icws import Sampler, named, term_hash
from verseloom.llm.shared import map_arrow, rows, shuffle_partitions
from verseloom.llm.word_hash import hashed_words

SAMPLES = 128
#: Slots for the samples of (word, count) pairs that a worker has met: 1 KB each.
SLOTS = 32_768


class Fingerprinter:
    """Keeps samples of (word, count) pairs in directly mapped slots, so most of a text costs look-ups and a minimum."""

    def __init__(self, k: int = SAMPLES) -> None:
        self.sampler = Sampler(k)
        self.rows = np.empty((SLOTS, k), np.uint64)
        self.keys = np.zeros(SLOTS, np.uint64)

    def _least(self, terms: np.ndarray, counts: np.ndarray, ln_weight: np.ndarray) -> np.ndarray:
        key = (terms ^ counts.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.intp)
        known = self.keys[slot] == key
        least = [self.rows.take(slot[known], axis=0).min(axis=0)] if known.any() else []
        new = np.flatnonzero(~known)
        for k in range(0, len(new), 256):
            part = new[k : k + 256]
            made = self.sampler.samples(terms[part], ln_weight[part])
            least.append(made.min(axis=0))
            own, first = np.unique(slot[part], return_index=True)
            self.rows[own], self.keys[own] = made[first], key[part][first]
        return functools.reduce(np.minimum, least)

    def signature(self, text: str) -> np.ndarray:
        """uint16 sample names; zeros for a blank text."""
        h, lengths = hashed_words(text)
        if not len(h):
            blank = text.strip()
            if not blank:
                return np.zeros(self.sampler.k, np.uint16)
            h, lengths = np.array([term_hash(blank)], np.uint64), np.ones(1)
        terms, first, counts = np.unique(h, return_index=True, return_counts=True)
        ln_weight = np.log(counts * lengths[first])
        parts = [self._least(terms[k : k + 4096], counts[k : k + 4096], ln_weight[k : k + 4096]) for k in range(0, len(terms), 4096)]
        return np.maximum(named(functools.reduce(np.minimum, parts)).astype(np.uint16), 1)


@functools.cache
def worker() -> Fingerprinter:
    return Fingerprinter()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many first code points of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness to the edited and the next one."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = shuffle_partitions(spark)
    cuts = source.agg(F.expr(f"percentile_approx(doc_id, array({', '.join(f'{k / n!r}D' for k in range(n + 1))}), 20000)").alias("q"), F.max("doc_id").alias("top"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    # the first ids of the partitions, in descending order; ids that are null form a last one
    starts = sorted({*(cuts["q"] or []), *([] if cuts["top"] is None else [cuts["top"]])}, reverse=True)
    parts = len(starts) + bool(cuts["nulls"])
    down = -np.array(starts, np.int64)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        empty = ids.isna().to_numpy()
        value = -ids.fillna(0).astype("int64").to_numpy()
        own = np.where(empty, len(down), np.searchsorted(down, value, "right") - 1)
        opens = (~empty & (down[np.minimum(own, len(down) - 1)] == value)) if len(down) else np.zeros(len(ids), bool)
        opens |= empty & True
        return pd.Series([[p, (p - 1) % parts + parts] if o else [p] for p, o in zip(own.tolist(), opens.tolist())])

    # a place of ``parts`` and more: the row only closes the partition before its own
    dealt = source.withColumn("place", F.explode(places("doc_id"))).withColumn("after", (F.col("place") >= parts).cast("int")).withColumn("place", F.col("place") % parts)
    dealt = dealt.repartitionById(max(1, parts), F.col("place")).sortWithinPartitions("place", "after", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        maker = worker()
        last: tuple | None = None
        for ids, texts, place, after in rows(batches, 256):
            out: list[tuple] = []
            for i, text, p, closes in zip(ids, texts, place, after):
                if last is not None and last[0] != p:
                    last = None
                if last is None and closes:
                    continue  # the partition is closed already
                own = maker.signature(text)
                if last is not None:
                    _, ident, before, mark = last
                    changed = edited(before, text)
                    other = maker.signature(changed)
                    out.append((ident, len(before), hashlib.sha256(changed.encode()).hexdigest(), mark.tobytes().hex(), other.tobytes().hex(), likeness(mark, other), likeness(mark, own)))
                last = None if closes else (p, i, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(kinds), kinds)], names)

    return map_arrow(dealt.select("doc_id", "text", "place", "after"), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
