"""Toxicity by a weighted lexicon matched with Aho-Corasick (operator 7).

Texts are folded first: case, compatibility forms and accents, homoglyphs of other scripts, digits and
signs written for letters, and i and l (which share the digit 1). The lexicon has whole words of any
length and word beginnings of STEMS letters (a longer word has these too) with weights learnt from
labelled rows: the log ratio of their rates in toxic and in other texts. Every term and every exception
that passes the test of evidence is in it; only the labelled rows are bounded. At each word the longest entry counts; hits inside an exception phrase (given, or learnt as a
context that only clean texts have) don't. The sum, alone and normalised by the text's length, goes
through a logistic function.

Null and empty texts get the score of a text without hits. Texts are read whole, whatever their length.
Rows are scored one by one, so ties and repeated rows have equal scores; an empty table, or one without
labels, gives the prior. The score is a new column that replaces one of its name; other extra columns
pass through.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verseloom.llm.labelled import logistic, training_texts
from verseloom.llm.shared import map_arrow, rows

#: Labelled rows to train on at most; letters of the shortest and longest beginnings.
SAMPLE, STEMS = 12_000, (4, 9)
#: Root of the likelihood ratio statistic that a term must pass: many terms are tried.
LEAST_Z = 4.2
#: Toxic texts that a term needs, its least log ratio, and clean texts that an exception needs.
TEXTS, LEAST_RATIO, CLEAN = 3, 1.2, 4
HELD_FOLDS, HELD_FOLD = 4, 2
THRESHOLD = 0.3
#: Letters of other scripts that look like Latin ones, and the Latin ones. Fixed values.
HOMOGLYPHS = str.maketrans(
    "авгеёзіїјкмнорѕстухһԁԛԝѵпьαβγεηικνορτυχωσıɑɡɩʟᴏøłđð",
    "abreeeiijkmhopsctyxhdqwvnbabyenikvoptuxwoiagilooldd",
)
#: Digits and signs written for letters. Fixed values.
LEET = str.maketrans("0123456789@$!|", "oizeasgtbgasii")
#: Combining marks and signs without width, which go; signs that may be letters; what parts words.
_MARKS = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff]+")
_LEET = re.compile(r"[0-9@$!|]+(?=[a-z])|(?<=[a-z])[0-9]+")
_BREAKS = re.compile(r"[\W_]+")
#: Phrases in which an entry is harmless.
PHRASES = ("clown fish", "trash can", "trash bin", "class clown")


def fold(text: str) -> str:
    """Words of a text in folded form, each between blanks."""
    text = text.casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        if not text.isascii():
            text = text.translate(HOMOGLYPHS)
    text = _LEET.sub(lambda m: m[0].translate(LEET), text)
    return f" {_BREAKS.sub(' ', text).strip()} ".replace("l", "i")


class Lexicon:
    """entries: folded word with a blank before it, and after it if whole, to weight; exceptions: folded phrases."""

    def __init__(self, entries: dict[str, float], exceptions: list[str], weights: list[float]) -> None:
        self.entries, self.exceptions, self.weights = entries, exceptions, weights
        self.machine = ahocorasick.Automaton()
        for e, w in entries.items():
            self.machine.add_word(e, (len(e), w))
        for e in exceptions:
            if e not in entries:
                self.machine.add_word(e, (len(e), None))
        if len(self.machine):
            self.machine.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float, int]]:
        """First place, length and weight of the longest entry at each distinct word, and how often, outside of exceptions."""
        best: dict[int, tuple[int, float]] = {}
        covered: list[tuple[int, int]] = []
        for end, (n, w) in self.machine.iter(folded) if len(self.machine) else ():
            start = end - n + 1
            if w is None:
                covered.append((start, end))
            elif start not in best or n > best[start][0]:
                best[start] = (n, w)
        if covered:
            covered.sort()
            firsts = [a for a, _ in covered]
            reach = list(itertools.accumulate((b for _, b in covered), max))
            best = {k: v for k, v in best.items() if not (j := bisect.bisect_right(firsts, k)) or reach[j - 1] <= k}
        words: dict[str, list] = {}
        for k, (n, w) in best.items():
            words.setdefault(folded[k : folded.find(" ", k + 1)], [k, n, w, 0])[3] += 1
        return [tuple(x) for x in words.values()]

    @staticmethod
    def features(hits: list[tuple[int, int, float, int]], n_words: int) -> list[float]:
        total = sum(w for _, _, w, _ in hits)
        often = sum(w * n for _, _, w, n in hits)
        return [np.log1p(total), total / (n_words + 20) * 10, np.log1p(len(hits)), max((w for _, _, w, _ in hits), default=0.0), total / np.sqrt(n_words + 20), np.log1p(often), often / (n_words + 20)]

    def score(self, text: str) -> float:
        folded = fold(text)
        x = self.features(self.hits(folded), folded.count(" ") - 1)
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights[:-1], x) + self.weights[-1], -30, 30))))

    def dumps(self) -> str:
        return json.dumps([self.entries, self.exceptions, self.weights])


@functools.lru_cache(maxsize=4)
def loads(text: str) -> Lexicon:
    return Lexicon(*json.loads(text))


def _parts(word: str) -> list[str]:
    return [f" {word} ", *(f" {word[:k]}" for k in range(STEMS[0], min(STEMS[1] + 1, len(word))))]


def count_terms(sample: DataFrame) -> DataFrame:
    """(term, toxic_docs, toxic, clean): texts and distinct words for each word and word beginning, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(counts.items())
            for lo in range(0, len(items), 50_000):
                part = items[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), *(pa.array([v[j] for _, v in part], pa.int64()) for j in range(3))], ["term", "toxic_docs", "toxic", "clean"])
            counts.clear()

        for texts, labels in rows(batches):
            for text, label in zip(texts, labels):
                here: Counter[str] = Counter()
                for w in set(fold(text).split()):  # each word once a text, so repeated lines weigh no more
                    here.update(_parts(w))
                for p, n in here.items():
                    entry = counts.setdefault(p, [0, 0, 0])
                    if label:
                        entry[0] += 1
                        entry[1] += n
                    else:
                        entry[2] += n
            if len(counts) > 500_000:
                yield from flush()
        yield from flush()

    part = map_arrow(sample, run, "term string, toxic_docs long, toxic long, clean long")
    return part.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("toxic_docs", "toxic", "clean")))


def evident(terms: DataFrame) -> DataFrame:
    """(term, ratio, toxic): the terms that are clearly more frequent in toxic texts, by a likelihood ratio test."""
    words = terms.where("term like '% '").agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("tw"), F.coalesce(F.sum("clean"), F.lit(0)).alias("cw"))
    both = terms.where(F.col("toxic_docs") >= TEXTS).crossJoin(F.broadcast(words))  # one row of totals
    expected = (F.col("toxic") + F.col("clean")) * F.col("tw") / F.greatest(F.lit(1), F.col("tw") + F.col("cw"))
    both = both.withColumn("expected", expected).withColumn("ratio", F.log((F.col("toxic") + 0.5) / (F.col("tw") + 1)) - F.log((F.col("clean") + 0.5) / (F.col("cw") + 1)))
    other = F.greatest(F.col("toxic") + F.col("clean") - F.col("expected"), F.lit(1e-9))
    evidence = 2 * (F.col("toxic") * F.log(F.col("toxic") / F.col("expected")) + F.col("clean") * F.log(F.greatest("clean", F.lit(1)) / other))
    return both.where((F.col("ratio") > LEAST_RATIO) & (evidence > LEAST_Z**2)).select("term", "ratio", "toxic")


def choose(counted: list[tuple[str, float, int]]) -> dict[str, float]:
    """Weights of evident terms (term, ratio, occurrences); a beginning that one longer entry explains goes."""
    found = {term: (ratio, t) for term, ratio, t in counted}
    most: dict[str, int] = {}  # occurrences of the longest entries under each beginning
    for term, (_, t) in found.items():
        word = term.strip()
        for k in range(STEMS[0], min(STEMS[1] + 1, len(word) + (term[-1] == " "))):
            most[" " + word[:k]] = max(most.get(" " + word[:k], 0), t)
    kept = {e: w for e, (w, t) in found.items() if e[-1] == " " or most.get(e, 0) < 0.9 * t}
    return dict(sorted(kept.items(), key=lambda x: (-x[1], x[0])))


def train(docs: DataFrame, labels: DataFrame, folds: int = HELD_FOLDS, fold_out: int = HELD_FOLD, most: int = SAMPLE) -> Lexicon:
    sample = training_texts(docs, labels, "toxic", folds, fold_out, most)
    entries = choose([tuple(r) for r in evident(count_terms(sample)).collect()])  # terms of the bounded sample that pass
    given = [f" {' '.join(fold(p).split())} " for p in PHRASES]
    first = Lexicon(entries, given, [0.0] * 8).dumps()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = loads(first)
        for texts, label in rows(batches):
            xs, contexts = [], []
            for text in texts:
                folded = fold(text)
                hits = lexicon.hits(folded)
                xs.append([float(v) for v in Lexicon.features(hits, folded.count(" ") - 1)])
                near = set()
                for at, *_ in hits:
                    stop = folded.find(" ", at + 1)
                    after, before = folded.find(" ", stop + 1), folded.rfind(" ", 0, at)
                    near |= {folded[at : after + 1]} if after > 0 else set()
                    near |= {folded[before : stop + 1]} if before >= 0 and at > 0 else set()
                contexts.append(sorted(near))
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(xs, pa.list_(pa.float64())), pa.array(contexts, pa.list_(pa.string()))], ["label", "x", "contexts"])

    seen = map_arrow(sample, run, "label int, x array<double>, contexts array<string>").persist()
    data = seen.select("label", "x").collect()  # a row of the bounded sample each
    context = seen.select("label", F.explode("contexts").alias("c")).groupBy("c").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n"))
    learnt = [r.c for r in context.where((F.col("toxic") == 0) & (F.col("n") >= CLEAN)).orderBy("c").collect()]
    seen.unpersist()
    y = np.array([r.label for r in data], np.float64)
    weights = logistic(np.array([r.x for r in data]).reshape(-1, 7), y) if len(y) else np.zeros(8)
    return Lexicon(entries, given + learnt, weights.tolist())


def with_score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the toxicity of each whole text."""
    model = docs.sparkSession.sparkContext.broadcast(lexicon.dumps())  # as large as the lexicon
    plain = docs.drop(score_col)
    at = plain.columns.index(text_col)
    names = [*plain.columns, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = loads(model.value)
        for batch in batches:
            scores = [lexicon.score(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names)

    return map_arrow(plain, run, T.StructType([*plain.schema.fields, T.StructField(score_col, T.DoubleType())]))
