"""From texts to ordered, timed words, and from words to phrases and lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseloom.config import WEAK_START, Segmentation
from verseloom.functions import text as X


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line) of all lines; null texts have none."""
    return docs.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line"))


def lyric_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens with dense line, section and token indexes; a blank line after content opens a section."""
    w = Window.partitionBy(key).orderBy("line_no")
    lines = text_lines(docs, key, text).withColumn("line", X.squeeze("line"))
    content = (F.col("line") != "").cast("int")
    opens = (F.col("filled") == 1) & (F.lag("filled").over(w) == 0) & (F.sum("filled").over(w.rowsBetween(Window.unboundedPreceding, -1)) > 0)
    dense = lines.withColumn("filled", content).withColumn("opens", F.coalesce(opens, F.lit(False)).cast("int"))
    dense = dense.withColumn("section_index", F.sum("opens").over(w)).withColumn("line_index", F.sum("filled").over(w) - 1).where("filled = 1")
    tokens = dense.select(key, "line_index", "section_index", F.posexplode(X.words("line")).alias("pos", "text"))
    index = F.row_number().over(Window.partitionBy(key).orderBy("line_index", "pos")) - 1
    return tokens.select(key, index.alias("token_index"), "text", X.token_form("text").alias("normalized"), "line_index", "section_index")


def timed_words(docs: DataFrame, key: str = "doc_id", text: str = "text", step: float = 0.5, length: float = 0.4) -> DataFrame:
    """Words with letters, at a fixed step."""
    words = docs.select(key, F.posexplode(F.filter(X.words(text), lambda w: w.rlike(r"[\p{L}\p{N}]"))).alias("word_idx", "text"))
    start = F.col("word_idx") * step
    return words.select(key, "word_idx", "text", start.alias("start"), (start + length).alias("end"))


def retimed_words(docs: DataFrame, duration: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words spread evenly over a duration."""
    tokens = docs.select(key, duration.alias("duration"), X.words(text).alias("tokens"))
    step = F.col("duration") / F.size("tokens")
    return tokens.select(key, step.alias("step"), F.posexplode("tokens").alias("word_idx", "text")).select(key, "word_idx", "text", (F.col("step") * F.col("word_idx")).alias("start"), (F.col("step") * (F.col("word_idx") + 1)).alias("end"))


def validated(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the invariants of a word (text, start not below 0, end not before start, parent not below 0), and the others."""
    parent = F.col("parent_word_idx") >= 0 if "parent_word_idx" in words.columns else F.lit(True)
    good = F.coalesce((F.trim("text") != "") & (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & F.coalesce(parent, F.lit(True)), F.lit(False))
    return words.where(good), words.where(~good)


def candidate_words(words: DataFrame, keys: list[str], source: str) -> DataFrame:
    """A transcript as a candidate: words with letters only, tagged with ``source``, numbered by (start, end) and, of equals, as they came.

    ``duration`` is the last end, the declared one, or a second, whichever is most. ``words``: (keys, word_idx, text, start, end[, duration]).
    """
    declared = F.col("duration") if "duration" in words.columns else F.lit(0.0)
    w, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("start", "end", "word_idx")
    kept = validated(words)[0].where(X.has_letter("text")).withColumn("duration", F.greatest(F.max("end").over(w), F.coalesce(F.max(declared).over(w), F.lit(0.0)), F.lit(1.0)))
    return kept.withColumn("word_idx", F.row_number().over(order) - 1).select(*keys, "word_idx", "text", "start", "end", F.lit(source).alias("source"), "duration")


def line_words(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, section_index, line_index, pos, text, start, end): the aligned words of every lyric line, or its text's words at a fixed step.

    ``lines``: (keys, section_index, line_index, line_type, text, section_start, words array<struct<text, start, end>>).
    A line with fewer aligned words than its text has counts as not aligned; it begins with its first aligned
    word, or with its section. Other kinds of lines, and empty ones, have no words.
    """
    text = X.archive_value("text")
    clean = lines.withColumn("text", text).where((F.col("line_type") == "lyric") & (F.col("text") != "")).withColumn("parts", X.words("text"))
    aligned = (F.size("words") > 0) & (F.size("words") >= F.size("parts"))
    begins = F.coalesce(F.get(F.col("words"), F.lit(0))["start"], F.col("section_start"), F.lit(0.0))
    spread = F.transform("parts", lambda x, k: F.struct(x.alias("text"), (begins + k * 0.5).alias("start"), (begins + k * 0.5 + 0.4).alias("end")))
    own = F.filter(F.transform("words", lambda x: F.struct(X.archive_value(x["text"]).alias("text"), x["start"].alias("start"), F.coalesce(x["end"], x["start"]).alias("end"))), lambda x: x["text"] != "")
    return clean.select(*keys, "section_index", "line_index", F.posexplode(F.when(F.coalesce(aligned, F.lit(False)), own).otherwise(spread)).alias("pos", "w")).select(*keys, "section_index", "line_index", "pos", "w.*")


def alignment_targets(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word_idx, targets): letters of every word as numbers; words without any are left out but keep their index. A key with none raises."""
    made = words.select(*keys, "word_idx", X.ascii_letters("text").alias("letters"))
    made = made.withColumn("some", F.max(F.col("letters") != "").over(Window.partitionBy(*keys)))
    checked = made.where(F.assert_true("some", F.lit("no word can be aligned")).isNull()).where("letters <> ''")
    return checked.select(*keys, "word_idx", F.transform(F.split("letters", ""), lambda c: F.ascii(c) - 96).alias("targets"))


def islands(words: DataFrame, keys: list[str], hard: Column, order: list[str]) -> DataFrame:
    """Adds ``island``: it grows where ``hard`` (which may use lag through ``prev_*`` columns) is true."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = words.withColumn("prev_end", F.lag("end").over(w)).withColumn("prev_text", F.lag("text").over(w))
    return out.withColumn("island", F.sum(F.coalesce(hard, F.lit(False)).cast("int")).over(w)).drop("prev_end", "prev_text")


def phrases(words: DataFrame, keys: list[str], cfg: Segmentation = Segmentation()) -> DataFrame:
    """Words with ``island`` and ``part`` of their phrase: cut at pauses, after punctuation, and at the caps of span and words."""
    hard = (F.col("start") - F.col("prev_end") >= cfg.pause) | X.ends_with("prev_text", r".,;:!?")
    cut_words = islands(words, keys, hard, ["start", "end", "word_idx"])
    # caps depend on the group so far and need a fold; hard breaks reset it, so each island is folded by itself
    items = F.array_sort(F.collect_list(F.struct("start", "end", "word_idx", "text")))
    grouped = cut_words.groupBy(*keys, "island").agg(items.alias("items"))
    state = {"n": F.lit(0), "first": F.lit(0.0), "end": F.lit(0.0)}

    def step(s: Column, x: Column) -> tuple[Column, dict[str, Column]]:
        new = (s["n"] == 0) | (s["end"] - s["first"] >= cfg.span) | (s["n"] >= cfg.phrase_words)
        return new, {"n": F.when(new, 1).otherwise(s["n"] + 1), "first": F.when(new, x["start"]).otherwise(s["first"]), "end": x["end"]}

    return _parted(grouped, keys, state, step)


def _parted(grouped: DataFrame, keys: list[str], state: dict[str, Column], step: Callable[[Column, Column], tuple[Column, dict[str, Column]]]) -> DataFrame:
    """Words of ``items`` with the ``part`` that they are in: ``step`` says of each whether it begins one.

    The fold keeps the places of the beginnings alone, so a step copies nothing; parts are slices between them.
    """

    def counted(s: Column, x: Column) -> Column:
        new, after = step(s, x)
        begins = F.when(new, F.concat(s["begins"], F.array(s["at"]))).otherwise(s["begins"])
        return F.struct(*(c.alias(k) for k, c in after.items()), (s["at"] + 1).alias("at"), begins.alias("begins"))

    zero = F.struct(*(c.alias(k) for k, c in state.items()), F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))
    begun = grouped.withColumn("begins", F.aggregate("items", zero, counted, lambda s: s["begins"]))
    ends = F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(F.size("items")))
    sliced = begun.select(*keys, "island", "items", F.posexplode(F.arrays_zip(F.col("begins").alias("a"), ends.alias("b"))).alias("part", "x"))
    sliced = sliced.select(*keys, "island", "part", F.explode(F.slice("items", F.col("x.a") + 1, F.col("x.b") - F.col("x.a"))).alias("x"))
    return sliced.select(*keys, "island", "x.word_idx", "x.text", "x.start", "x.end", "part")


def lines(words: DataFrame, keys: list[str], cfg: Segmentation = Segmentation()) -> DataFrame:
    """Words with ``island`` and ``part`` of their line; soft punctuation and capitals cut only lines that are long enough."""
    hard = (F.col("start") - F.col("prev_end") >= cfg.pause) | X.ends_with("prev_text", ".!?")
    cut_words = islands(words, keys, hard, ["start", "end", "word_idx"])
    soft = F.rtrim("text").rlike("[,;:]$")
    upper = X.starts_upper("text") & ~F.lower(F.trim("text")).isin(*WEAK_START)
    items = F.array_sort(F.collect_list(F.struct("start", "end", "word_idx", "text", soft.alias("soft"), upper.alias("upper"))))
    grouped = cut_words.groupBy(*keys, "island").agg(items.alias("items"))
    state = {"n": F.lit(0), "first": F.lit(0.0), "end": F.lit(0.0), "soft": F.lit(False), "chars": F.lit(-1)}

    def step(s: Column, x: Column) -> tuple[Column, dict[str, Column]]:
        span = s["end"] - s["first"]
        enough = (s["n"] >= 3) | (s["chars"] >= 12) | (span >= 2.0)
        new = (s["n"] == 0) | (s["soft"] & (s["n"] >= cfg.soft_line_words)) | (x["upper"] & enough) | (span >= cfg.span) | (s["n"] >= cfg.line_words)
        chars = F.length(x["text"])
        return new, {"n": F.when(new, 1).otherwise(s["n"] + 1), "first": F.when(new, x["start"]).otherwise(s["first"]), "end": x["end"], "soft": x["soft"], "chars": F.when(new, chars).otherwise(s["chars"] + 1 + chars)}

    return _parted(grouped, keys, state, step)


def gathered(parts: DataFrame, keys: list[str]) -> DataFrame:
    """A row a phrase or line: bounds, text, normal form and number of words."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"]), " ")
    out = parts.groupBy(*keys, "island", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), texts.alias("text"), F.count(F.lit(1)).alias("n_words"))
    return out.withColumn("normalized", X.phrase_form("text"))


def deduplicated_words(words: DataFrame, keys: list[str], window: float = 0.25, form: Callable[[str], Column] = X.token_form, extra: Sequence[str] = ()) -> DataFrame:
    """Drops a word equal to the last kept one within ``window`` seconds of its start; runs of equal words are folded by themselves. ``extra`` columns stay."""
    w = Window.partitionBy(*keys).orderBy("start", "end", "word_idx")
    formed = words.withColumn("form", form("text"))
    # a different word always is kept and becomes the last one, so a fold may begin at each change
    runs = formed.withColumn("run", F.sum(F.coalesce(F.col("form") != F.lag("form").over(w), F.lit(True)).cast("int")).over(w))
    items = F.array_sort(F.collect_list(F.struct("start", "end", "word_idx", "text", *extra)))
    begun = F.aggregate(
        "items",
        F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("kept")),
        lambda s, x: F.when(s["last"].isNotNull() & (F.abs(x["start"] - s["last"]) < window), F.struct(s["last"].alias("last"), (s["at"] + 1).alias("at"), s["kept"].alias("kept"))).otherwise(
            F.struct(x["start"].alias("last"), (s["at"] + 1).alias("at"), F.concat(s["kept"], F.array(s["at"])).alias("kept"))
        ),
        lambda s: s["kept"],
    )
    grouped = runs.withColumn("word_idx", F.col("word_idx").cast("long")).groupBy(*keys, "run").agg(items.alias("items")).withColumn("kept", begun)
    return grouped.select(*keys, F.inline(F.transform("kept", lambda k: F.get("items", k))))


def document(tokens: DataFrame, key: str) -> DataFrame:
    """(key, sections): words nested in lines and sections, each with its first start and last end. ``flattened`` undoes it.

    ``tokens``: (key, section_index, line_index, word_idx, text, start, end).
    """
    word = F.struct("word_idx", "text", "start", "end")
    lines = tokens.groupBy(key, "section_index", "line_index").agg(F.array_sort(F.collect_list(word)).alias("words"), F.min("start").alias("start"), F.max("end").alias("end"))
    text = F.array_join(F.transform("words", lambda w: w["text"]), " ")
    line = F.struct("line_index", F.lit("lyric").alias("line_type"), text.alias("text"), "start", "end", "words")
    sections = lines.groupBy(key, "section_index").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.min("start").alias("start"), F.max("end").alias("end"))
    return sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section_index", "start", "end", "lines"))).alias("sections"))


def flattened(documents: DataFrame, key: str) -> DataFrame:
    """The lines of nested documents, as ``line_words`` takes them."""
    sections = documents.select(key, F.explode("sections").alias("s")).select(key, "s.section_index", F.col("s.start").alias("section_start"), F.explode("s.lines").alias("l"))
    return sections.select(key, "section_index", "section_start", "l.line_index", "l.line_type", "l.text", "l.words")
