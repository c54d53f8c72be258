"""Operators over ordered rows: gaps and islands, run lengths, neighbours, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseloom.config import FRAME_SECONDS, Layout
from verseloom.functions import text as X


def adjacent(rows: DataFrame, keys: list[str], order: list[str], value: str = "start") -> DataFrame:
    """Adds the difference to the row before, null at the first."""
    return rows.withColumn("step", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def overlaps(rows: DataFrame, keys: list[str], slack: float = 0.05) -> DataFrame:
    """By key, rows that begin before the end of the row before them, less ``slack``."""
    w = Window.partitionBy(*keys).orderBy("start", "end", "idx")
    return rows.withColumn("over", F.coalesce(F.col("start") < F.lag("end").over(w) - slack, F.lit(False))).groupBy(*keys).agg(F.count_if("over").alias("overlaps"), F.count(F.lit(1)).alias("n"))


def consecutive(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Adds ``span``: one number for each run of consecutive indexes."""
    return rows.withColumn("span", F.col(index) - F.row_number().over(Window.partitionBy(*keys).orderBy(index)))


#: Indexes of a bucket: runs are found within buckets first, so a key of many rows is no single task.
BUCKET = 100_000


def consecutive_spans(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """(keys, first, last, n) of each run of consecutive indexes: runs within buckets of indexes, joined where they meet at a border."""
    bucket = F.floor(F.col(index) / BUCKET)
    within = consecutive(rows.select(*keys, index, bucket.alias("bucket")), [*keys, "bucket"], index)
    pieces = within.groupBy(*keys, "bucket", "span").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("n"))
    # a run that begins a bucket goes on from one that ends the bucket before; inner runs are whole
    begins, ends = F.col("first") == F.col("bucket") * BUCKET, F.col("last") == (F.col("bucket") + 1) * BUCKET - 1
    whole = pieces.where(~(begins | ends)).select(*keys, "first", "last", "n")
    w = Window.partitionBy(*keys).orderBy("first")
    at_border = pieces.where(begins | ends).withColumn("fresh", F.coalesce(F.col("first") != F.lag("last").over(w) + 1, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(w))
    return whole.unionByName(at_border.groupBy(*keys, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("run"))


def first_spans(spans: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` spans of each key with their rank; tasks rank their own first, so a key moves ``k`` rows a task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("first"))
    return spans.withColumn("rank", rank).where(F.col("rank") <= k)


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, run, value, first, last, n): runs of equal values; any other value between parts equal ones."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(True)).cast("int")
    numbered = rows.withColumn("pos", F.row_number().over(w) - 1).withColumn("changed", changed).withColumn("run", F.sum("changed").over(w))
    return numbered.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"))


def collapsed_path(frames: DataFrame, keys: list[str], blank: int = 0) -> DataFrame:
    """Token spans of a frame path: runs are found first and blanks dropped then, so a blank parts equal tokens."""
    return runs(frames, keys, ["frame"], "token").where(F.col("token") != blank)


def collapsed_slides(slides: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive slides with equal lines become one with ``(Nx)``; a slide with its own aux text never merges."""
    w = Window.partitionBy(*keys).orderBy("slide_idx")
    form = F.transform("lines", X.bare_word)
    named = slides.withColumn("form", form).withColumn("own", F.coalesce("aux_text", F.lit("")) != "")
    fresh = F.coalesce((F.col("form") != F.lag("form").over(w)) | F.col("own") | F.lag("own").over(w), F.lit(True))
    numbered = named.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(w))
    merged = numbered.groupBy(*keys, "run").agg(F.min_by("lines", "slide_idx").alias("lines"), F.min("start_seconds").alias("start_seconds"), F.max_by("end_seconds", "slide_idx").alias("end_seconds"), F.min_by("aux_text", "slide_idx").alias("aux"), F.count(F.lit(1)).alias("n"), F.min("slide_idx").alias("slide_idx"))
    return merged.withColumn("aux_text", F.when(F.col("n") > 1, F.format_string("(%dx)", "n")).otherwise(F.coalesce("aux", F.lit("")))).drop("aux", "run")


def _run_cost() -> Column:
    return F.when(F.col("n_tokens") <= 2, 0.0).otherwise(F.col("repeats") * 8.0 + F.greatest(F.col("longest") - 2, F.lit(0)) * 20.0)


def run_penalty(tokens: DataFrame, keys: list[str], order: list[str], value: str = "form") -> DataFrame:
    """8 for each adjacent repeat and 20 for each step of the longest run past two; nothing up to two tokens."""
    by_run = runs(tokens, keys, order, value).groupBy(*keys).agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") - 1).alias("repeats"), F.max("n").alias("longest"))
    return by_run.withColumn("penalty", _run_cost())


def variety_penalty(n: Column, forms: Column, pairs: Column, distinct_pairs: Column) -> Column:
    """18 times the share of repeated tokens plus 8 for each repeated pair of neighbours; nothing up to two tokens."""
    return F.when(n <= 2, 0.0).otherwise((1 - forms / n) * 18.0 + (pairs - distinct_pairs) * 8.0)


def repetition(tokens: DataFrame, keys: list[str], order: list[str], value: str = "form") -> DataFrame:
    """Both repetition penalties of each key: one sort, then sums by pair of neighbours, by form and by key on one partitioning."""
    w = Window.partitionBy(*keys).orderBy(*order)
    c = F.col
    placed = tokens.select(*keys, *order, value, F.lead(value).over(w).alias("next"), F.coalesce(c(value) != F.lag(value).over(w), F.lit(True)).alias("fresh"), F.row_number().over(w).alias("place"))
    placed = placed.withColumn("length", c("place") - F.max(F.when(c("fresh"), c("place"))).over(w) + 1)
    pairs = placed.groupBy(*keys, value, "next").agg(F.count(F.lit(1)).alias("n"), F.count_if(~c("fresh")).alias("repeats"), F.max("length").alias("longest"))
    forms = pairs.groupBy(*keys, value).agg(F.sum("n").alias("n"), F.sum("repeats").alias("repeats"), F.max("longest").alias("longest"), F.count("next").alias("distinct_pairs"), F.coalesce(F.sum(F.when(c("next").isNotNull(), c("n"))), F.lit(0)).alias("pairs"))
    by = forms.groupBy(*keys).agg(F.sum("n").alias("n_tokens"), F.sum("repeats").alias("repeats"), F.max("longest").cast("long").alias("longest"), F.count(F.lit(1)).alias("forms"), F.sum("distinct_pairs").alias("distinct_pairs"), F.sum("pairs").alias("pairs"))
    return by.select(*keys, "n_tokens", "repeats", "longest", _run_cost().alias("penalty"), variety_penalty(c("n_tokens"), c("forms"), c("pairs"), c("distinct_pairs")).alias("variety"))


def neighbours(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds the last value before and the first after each row, nulls skipped."""
    # both frames grow from their first row: one that shrinks towards the last row would be read anew for every row
    w, back = (Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1) for by in (order, [F.desc_nulls_last(c) for c in order]))
    return rows.withColumn("before", F.last(value, True).over(w)).withColumn("after", F.last(value, True).over(back))


def interpolated(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Fills runs of rows without times between their neighbours: equal slots, each used to 70 % within 0.02 to 0.4 s.

    ``start`` and ``end`` may be null together. Before the first known row the run ends at its start, after
    the last it begins at its end; slots outside of both keep 0.5 s.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    known = neighbours(neighbours(rows, keys, order, "end").withColumnRenamed("before", "from").drop("after"), keys, order, "start").withColumnRenamed("after", "to").drop("before")
    known = known.withColumn("missing", F.col("start").isNull()).withColumn("fresh", F.coalesce(F.col("missing") != F.lag("missing").over(w), F.lit(True)).cast("int"))
    known = known.withColumn("run", F.sum("fresh").over(w))
    by_run = Window.partitionBy(*keys, "run")
    n, k = F.count(F.lit(1)).over(by_run), F.row_number().over(by_run.orderBy(*order))
    out = known.withColumn("n", n).withColumn("k", k)
    lo = F.coalesce("from", F.greatest(F.lit(0.0), F.col("to") - (F.col("n") + 1) * 0.5), F.lit(0.0))
    hi = F.greatest(F.coalesce("to", lo + (F.col("n") + 1) * 0.5), lo)
    out = out.withColumn("slot", (hi - lo) / (F.col("n") + 1)).withColumn("at", lo + F.col("slot") * F.col("k"))
    length = F.least(F.lit(0.4), F.greatest(F.lit(0.02), F.col("slot") * 0.7))
    return out.withColumn("end", F.when(F.col("missing"), F.col("at") + length).otherwise(F.col("end"))).withColumn("start", F.when(F.col("missing"), F.col("at")).otherwise(F.col("start"))).drop("from", "to", "fresh", "run", "n", "k", "slot", "at")


def boundaries(words: DataFrame, keys: list[str], cfg: Layout = Layout()) -> DataFrame:
    """Boundaries after each word: section and line changes (both hints present), final punctuation, pauses, strong ones."""
    w = Window.partitionBy(*keys).orderBy("word_idx")
    gap = F.lead("start").over(w) - F.col("end")
    section = F.coalesce(F.lead("section_index").over(w) != F.col("section_index"), F.lit(False))
    line = section | F.coalesce(F.lead("line_index").over(w) != F.col("line_index"), F.lit(False))
    out = words.select("*", section.alias("section_after"), line.alias("line_after"), F.coalesce(F.rtrim("text").rlike("[.!?]$"), F.lit(False)).alias("terminal"), F.coalesce(gap >= cfg.pause, F.lit(False)).alias("pause_after"))
    return out.withColumn("strong_after", F.col("section_after") | F.coalesce(gap >= cfg.strong_pause, F.lit(False)))


def first_strong(words: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the index of the first strong boundary at or after each word."""
    w = Window.partitionBy(*keys).orderBy(F.desc("word_idx")).rowsBetween(Window.unboundedPreceding, 0)
    return words.withColumn("strong_idx", F.min(F.when(F.col("strong_after"), F.col("word_idx"))).over(w))


def soft_boundaries(words: DataFrame, keys: list[str], target: int = 28, least: int = 5) -> DataFrame:
    """Adds ``soft_after``: a comma, semicolon or colon that ends a run of ``least`` words or ``target`` characters since the last boundary.

    The run resets at its own result; line boundaries, stops and pauses reset it too and part the fold.
    """
    w = Window.partitionBy(*keys).orderBy("word_idx")
    resets = F.coalesce(F.lag(F.col("line_after") | F.col("terminal") | F.col("pause_after")).over(w), F.lit(False)).cast("int")
    cut = words.withColumn("resets", resets).withColumn("run", F.sum("resets").over(w))
    items = F.array_sort(F.collect_list(F.struct("word_idx", F.length("text").alias("chars"), (F.rtrim("text").rlike("[,;:]$") & ~F.col("line_after") & ~F.col("terminal") & ~F.col("pause_after")).alias("comma"))))

    def step(s: Column, x: Column) -> Column:
        n, chars = s["n"] + 1, s["chars"] + x["chars"] + F.when(s["n"] > 0, 1).otherwise(0)
        hit = x["comma"] & ((n >= least) | (chars >= target))
        return F.struct(F.when(hit, 0).otherwise(n).alias("n"), F.when(hit, 0).otherwise(chars).alias("chars"), F.when(hit, F.concat(s["hits"], F.array(x["word_idx"]))).otherwise(s["hits"]).alias("hits"))

    index = dict(words.dtypes)["word_idx"]
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.array().cast(f"array<{index}>").alias("hits"))
    marks = cut.groupBy(*keys, "run").agg(items.alias("items")).select(*keys, F.explode(F.aggregate("items", zero, step, lambda s: s["hits"])).alias("word_idx"), F.lit(True).alias("soft_after"))
    return words.join(marks, [*keys, "word_idx"], "left").withColumn("soft_after", F.coalesce("soft_after", F.lit(False)))


def word_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds of each aligned word from its frames; the last frame counts in full."""
    by_word = spans.groupBy(*keys, "word_idx").agg(F.min("start_frame").alias("a"), F.max("end_frame").alias("b"))
    return by_word.select(*keys, "word_idx", (F.col("a") * FRAME_SECONDS).alias("start"), ((F.col("b") + 1) * FRAME_SECONDS).alias("end"))


def refined_words(words: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Words with their spans' times; words without spans are clamped between the previous end and the next aligned start.

    Aligned starts that go back raise. The previous end runs through words without spans as a running
    maximum of their clamped ends, from the aligned word before them on. ``word_source`` stays where there is one.
    """
    timed = word_spans(spans, keys).withColumnsRenamed({"start": "a", "end": "b"})
    joined = words.join(timed, [*keys, "word_idx"], "left")
    known = neighbours(joined, keys, ["word_idx"], "b").withColumnRenamed("before", "floor").drop("after")
    known = neighbours(known, keys, ["word_idx"], "a").withColumnsRenamed({"after": "ceiling", "before": "last_a"})
    back = F.col("a") < F.col("last_a")
    known = known.withColumn("a", F.when(back, F.raise_error(F.lit("aligned spans are not monotonic")).cast("double")).otherwise(F.col("a")))
    lo, hi = F.coalesce("floor", F.lit(0.0)), F.coalesce("ceiling", F.lit(float("inf")))
    w = Window.partitionBy(*keys).orderBy("word_idx")
    fresh = F.col("a").isNotNull() | F.coalesce(F.lag("a").over(w).isNotNull(), F.lit(True))
    run = known.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(w))
    r = Window.partitionBy(*keys, "run").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)
    out = run.withColumn("clamped", F.least(F.greatest("end", "start", lo), hi)).withColumn("reached", F.greatest(F.coalesce(F.max("clamped").over(r), lo), lo))
    start = F.least(F.greatest("start", F.col("reached")), hi)
    own = F.col("word_source") if "word_source" in words.columns else F.lit("whisper")
    return out.select(*keys, "word_idx", "text", F.coalesce("a", start).alias("start"), F.coalesce("b", F.greatest(F.col("clamped"), start)).alias("end"), F.when(F.col("a").isNull(), own).otherwise(F.lit("mms_align")).alias("word_source"))


def phonemes(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Span rows as phonemes with seconds and the word that they belong to."""
    return spans.select(*keys, F.col("text").alias("symbol"), (F.col("start_frame") * FRAME_SECONDS).alias("start"), ((F.col("end_frame") + 1) * FRAME_SECONDS).alias("end"), F.col("word_idx").alias("parent_word_idx"), F.lit("mms_align").alias("phoneme_source"))


def attached(spans: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Positional join of spans with flattened target tokens (word_idx, pos, token); a mismatch raises."""
    ws, wt = Window.partitionBy(*keys).orderBy("start_frame"), Window.partitionBy(*keys).orderBy("word_idx", "pos")
    a = spans.withColumn("k", F.row_number().over(ws))
    b = targets.select(*keys, "word_idx", F.col("token").alias("want"), F.row_number().over(wt).alias("k"))
    both = a.join(b, [*keys, "k"], "full_outer")
    return both.where(F.assert_true(F.coalesce(F.col("token") == F.col("want"), F.lit(False)), "spans don't match their targets").isNull()).drop("want", "k")
