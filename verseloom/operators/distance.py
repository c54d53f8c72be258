"""Word edit distance and vocabulary overlap, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code point of the first word of a pair; one pair may hold this many distinct words.
FIRST, MOST = 0x4E00, 20_000


def word_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two word arrays: words become single characters, so the built-in one applies.

    Beyond ``MOST`` distinct words in a pair characters run out; such pairs give null and go to ``exact_word_distance``.
    """
    table = F.array_distinct(F.concat(a, b))
    numbered = F.map_from_arrays(table, F.transform(table, lambda x, i: F.lpad(F.hex((i + FIRST).cast("long")), 4, "0")))
    text = lambda w: F.decode(F.unhex(F.array_join(F.transform(w, lambda x: F.element_at(numbered, x)), "")), "UTF-16BE")
    return F.when(F.size(table) == 0, 0).when(F.size(table) <= MOST, F.levenshtein(text(a), text(b)))


def exact_word_distance(a: Column, b: Column) -> Column:
    """The same by a fold that keeps one row of the table, for any vocabulary."""
    first = F.sequence(F.lit(0), F.size(b))

    def row(prev: Column, x: Column) -> Column:
        zero = F.array(prev[0] + 1)

        def cell(acc: Column, j: Column) -> Column:
            best = F.least(acc[F.size(acc) - 1] + 1, prev[j] + 1, prev[j - 1] + F.when(b[j - 1] == x, 0).otherwise(1))
            return F.concat(acc, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), zero, cell)

    return F.when(F.size(b) == 0, F.size(a)).otherwise(F.element_at(F.aggregate(a, first, row), -1))


def reference_metrics(pairs: DataFrame) -> DataFrame:
    """Adds edits, word error rate, likeness, and vocabulary recall and precision to (ref array, out array)."""
    edits = F.coalesce(word_distance(F.col("ref"), F.col("out")), exact_word_distance(F.col("ref"), F.col("out")))
    shared = F.size(F.array_intersect("ref", "out"))
    part = lambda of: F.when(F.size(F.array_distinct(of)) == 0, 0.0).otherwise(shared / F.size(F.array_distinct(of)))
    rate = F.when(F.size("ref") == 0, 1.0).otherwise(F.col("edits") / F.size("ref"))
    return pairs.withColumn("edits", edits).withColumn("wer", rate).withColumn("similarity", F.greatest(F.lit(0.0), 1 - F.col("wer"))).withColumn("recall", part(F.col("ref"))).withColumn("precision", part(F.col("out")))
