"""An extension: pause-cut phrases over a stream of words, late words bounded by a watermark.

A session window merges rows that are exactly one gap apart; the batch operator cuts there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_phrases(events: DataFrame, key: str, ts: str, text: str, pause: str = "600 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(key, start, end, n_words, text): a row a session; words in the order of their times."""
    words = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(text).alias("w"))))
    grouped = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, pause).alias("s")).agg(words.alias("words"), F.count(F.lit(1)).alias("n_words"))
    return grouped.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_words", F.array_join(F.transform("words", lambda x: x["w"]), " ").alias("text"))


def windowed_quality(events: DataFrame, ts: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and mean value of each window, closed by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size)).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
