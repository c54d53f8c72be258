"""Monotone alignment of expected tokens with heard words."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.config import FUZZY, SKIP_LYRIC, SKIP_WORD
from verseloom.functions import text as X
from verseloom.operators import sequence as W
from verseloom.operators.similarity import token_likeness
from verseloom.runtime import map_groups

_MATCH, _LYRIC, _WORD = 1, 2, 3


def align(tokens: list[str], heard: list[str]) -> list[int | None]:
    """For each token the place of the word it matches: order-preserving, most score, then most matches.

    A row of states (score, matches, tie) is kept, and one byte a cell to trace back. Of equal states a
    match wins over a skipped token, and that over a skipped word.
    """
    m = len(heard)
    known: dict[tuple[str, str], float] = {}
    row: list[tuple[float, int, int]] = [(SKIP_WORD * 0.0, 0, 0)]
    back = [bytearray(m + 1)]
    for j in range(m):
        s, n, t = row[j]
        row.append((s + SKIP_WORD, n, t - 1))
        back[0][j + 1] = _WORD
    for a in tokens:
        trace = bytearray(m + 1)
        s, n, t = row[0]
        fresh = [(s + SKIP_LYRIC, n, t - 1)]
        trace[0] = _LYRIC
        for j, b in enumerate(heard):
            s, n, t = row[j + 1]
            best, how = (s + SKIP_LYRIC, n, t - 1), _LYRIC
            if (like := known.get((a, b))) is None:
                like = known[a, b] = token_likeness(a, b)
            if like >= FUZZY:
                s, n, t = row[j]
                if (hit := (s + 2.0 + like + (like == 1.0), n + 1, t + 2)) >= best:
                    best, how = hit, _MATCH
            s, n, t = fresh[j]
            if (skip := (s + SKIP_WORD, n, t - 1)) > best:
                best, how = skip, _WORD
            fresh.append(best)
            trace[j + 1] = how
        row = fresh
        back.append(trace)
    out: list[int | None] = [None] * len(tokens)
    i, j = len(tokens), m
    while i or j:
        how = back[i][j]
        if how == _MATCH:
            i, j = i - 1, j - 1
            out[i] = j
        elif how == _LYRIC:
            i -= 1
        else:
            j -= 1
    return out


def aligned_tokens(tokens: DataFrame, heard: DataFrame, key: str) -> DataFrame:
    """(key, token_index, word_idx): the match of every token, null where there is none.

    ``tokens``: (key, token_index, normalized); ``heard``: (key, word_idx, text), ignorable words left out here.
    """
    a = tokens.select(key, F.lit(0).alias("side"), F.col("token_index").cast("long").alias("pos"), F.col("normalized").alias("form"))
    b = heard.where(~X.ignorable("text")).select(key, F.lit(1).alias("side"), F.col("word_idx").cast("long").alias("pos"), X.token_form("text").alias("form"))

    def run(song: object, rows: dict[str, list]) -> Iterator[tuple]:
        n, pos, forms = rows["side"].count(0), rows["pos"], rows["form"]
        for at, k in zip(pos, align(forms[:n], forms[n:])):
            yield song, at, None if k is None else pos[n + k]

    kind = dict(tokens.dtypes)[key]
    return map_groups(a.unionByName(b), key, ["side", "pos"], run, f"{key} {kind}, token_index long, word_idx long")


def coverage(matches: DataFrame, tokens: DataFrame, heard: DataFrame, key: str) -> DataFrame:
    """Alignable, matched and skipped counts of each key, and coverage (0 where nothing can be aligned)."""
    t = tokens.withColumn("can", F.col("normalized") != "").groupBy(key).agg(F.count_if("can").alias("alignable"))
    m = matches.groupBy(key).agg(F.count("word_idx").alias("matched"))
    h = heard.groupBy(key).agg(F.count_if(X.ignorable("text")).alias("skipped"), F.count(F.lit(1)).alias("heard"))
    out = t.join(m, key, "left").join(h, key, "left").fillna(0, ["matched", "skipped", "heard"])
    return out.withColumn("coverage", F.when(F.col("alignable") == 0, 0.0).otherwise(F.col("matched") / F.col("alignable")))


def _span_texts(words: DataFrame, key: str, index: str, name: str, limit: int = 5) -> DataFrame:
    """(key, name): texts of the first ``limit`` runs of consecutive indexes, in order."""
    runs = W.consecutive(words.select(key, F.col(index).cast("long").alias(index), "text"), [key], index)
    items = F.array_sort(F.collect_list(F.struct(index, "text")))
    joined = runs.groupBy(key, "span").agg(F.min(index).alias("first"), F.array_join(F.transform(items, lambda x: x["text"]), " ").alias("words"))
    spans = F.array_sort(F.collect_list(F.struct("first", "words")))
    return joined.groupBy(key).agg(F.slice(F.transform(spans, lambda x: x["words"]), 1, limit).alias(name))


def unmatched_spans(matches: DataFrame, tokens: DataFrame, heard: DataFrame, key: str) -> DataFrame:
    """(key, lyric_spans, word_spans): texts of the first runs of tokens and of heard words without a match, for every key of ``tokens``.

    Tokens without letters and ignorable words can't match and belong to no run; they part the runs beside them.
    """
    lost = tokens.where("normalized <> ''").join(matches.where("word_idx is null").select(key, "token_index"), [key, "token_index"], "left_semi")
    extra = heard.where(~X.ignorable("text")).join(matches.where("word_idx is not null").select(key, "word_idx"), [key, "word_idx"], "left_anti")
    none = F.array().cast("array<string>")
    out = tokens.select(key).distinct().join(_span_texts(lost, key, "token_index", "lyric_spans"), key, "left").join(_span_texts(extra, key, "word_idx", "word_spans"), key, "left")
    return out.select(key, F.coalesce("lyric_spans", none).alias("lyric_spans"), F.coalesce("word_spans", none).alias("word_spans"))
