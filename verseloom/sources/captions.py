"""WebVTT text to cues, with rolling overlaps removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verseloom.functions import text as X
from verseloom.functions.timecode import parse_caption_time


def cue_rows(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cue, start, end, text): a row a cue; text runs from the time line to a blank one, cleaned of tags."""
    w = Window.partitionBy(key).orderBy("pos")
    lines = files.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    is_time = F.col("line").contains("-->")
    numbered = lines.withColumn("time", is_time).withColumn("cue", F.sum(is_time.cast("int")).over(w)).where("cue > 0")
    c = Window.partitionBy(key, "cue").orderBy("pos")
    open_ = F.sum((F.col("line") == "").cast("int")).over(c) == 0
    body = numbered.withColumn("open", open_).where("open")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("time"), F.struct("pos", "line")))), lambda x: x["line"]), " ")
    cues = body.groupBy(key, "cue").agg(F.max(F.when(F.col("time"), F.col("line"))).alias("range"), texts.alias("raw"))
    at = F.split("range", "-->")
    end = F.regexp_extract(F.trim(at[1]), r"^(\S+)", 1)
    return cues.select(key, "cue", parse_caption_time(at[0]).alias("start"), parse_caption_time(end).alias("end"), X.caption_text("raw").alias("text")).where("text <> ''")


def without_overlap(cues: DataFrame, key: str) -> DataFrame:
    """Cues without the words that repeat the end of the cue before; cues that nothing is left of go."""
    w = Window.partitionBy(key).orderBy("cue")
    tokens = cues.withColumn("words", F.split("text", " ")).withColumn("form", F.transform("words", X.phrase_form)).withColumn("before", F.lag("form").over(w))
    n = F.when(F.col("before").isNull(), 0).otherwise(X.caption_overlap(F.col("before"), F.col("form")))
    left = F.array_join(F.slice("words", n + 1, F.greatest(F.size("words") - n, F.lit(0))), " ")
    return tokens.select(key, "cue", "start", "end", left.alias("text")).where("text <> ''")


def plain_text(files: DataFrame, key: str, text: str) -> DataFrame:
    """Lines without headers, numbers and times, each once in a row, joined."""
    w = Window.partitionBy(key).orderBy("pos")
    lines = files.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line")).withColumn("line", X.caption_text("line"))
    kept = lines.where((F.col("line") != "") & ~F.col("line").rlike(r"^(WEBVTT|Kind:|Language:)") & ~F.col("line").rlike(r"^\d+$") & ~F.col("line").contains("-->"))
    fresh = kept.withColumn("fresh", F.coalesce(F.col("line") != F.lag("line").over(w), F.lit(True))).where("fresh")
    return fresh.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("text"))
