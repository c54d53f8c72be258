"""Joins: last-wins metadata, prioritised picks, fallbacks, interval joins bounded by buckets, availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseloom.functions.scores import overlap_ratio


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, with ``seen`` the place of its first one; one aggregation."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row"), F.min(order).alias("seen")).select(key, "row.*", "seen")


def priority_pick(files: DataFrame, key: str, path: str, patterns: list[str]) -> DataFrame:
    """The first path by the earliest pattern that it matches; paths that match none don't count."""
    rank = F.coalesce(*(F.when(F.col(path).rlike(p), k) for k, p in enumerate(patterns)))
    found = files.withColumn("rank", rank).where("rank is not null")
    return found.groupBy(key).agg(F.min(F.struct("rank", path)).alias("best")).select(key, f"best.{path}", "best.rank")


def fallback_lookup(rows: DataFrame, table: DataFrame, first: str, second: str, name: str, value: str) -> DataFrame:
    """Value by the first name, else by the second, else null."""
    t = table.select(F.col(name).alias("n"), F.col(value).alias("v"))
    one = rows.join(t.withColumnsRenamed({"n": first, "v": "v1"}), first, "left")
    return one.join(t.withColumnsRenamed({"n": second, "v": "v2"}), second, "left").withColumn(value, F.coalesce("v1", "v2")).drop("v1", "v2")


def missing_sources(present: DataFrame, expected: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """Expected (keys, source) rows that are not there."""
    return expected.join(present, [*keys, "source"], "left_anti").withColumn("reason", F.lit(reason))


def interval_pairs(items: DataFrame, key: str, reach: float, condition: Column | None = None) -> DataFrame:
    """Pairs of items of a key from different sources whose bounds come within ``reach``, in one direction.

    Both sides are bucketed by the reach; an item goes to each bucket that it touches, and a pair is made
    only in the bucket where the later of the two begins, so the join is an equi-join without repeats.
    """
    width = reach * 4
    cell = lambda x: F.floor(x / width).cast("long")
    a = items.select(key, *(F.col(c).alias(f"a_{c}") for c in ("idx", "source", "start", "end")))
    b = items.select(key, *(F.col(c).alias(f"b_{c}") for c in ("idx", "source", "start", "end")))
    a = a.withColumn("cell", F.explode(F.sequence(cell(F.col("a_start") - reach), cell(F.col("a_end") + reach))))
    b = b.withColumn("cell", F.explode(F.sequence(cell(F.col("b_start")), cell(F.col("b_end")))))
    near = (F.col("a_source") < F.col("b_source")) & (F.col("b_start") <= F.col("a_end") + reach) & (F.col("b_end") >= F.col("a_start") - reach)
    once = F.col("cell") == F.greatest(cell(F.col("a_start") - reach), cell(F.col("b_start")))
    pairs = a.join(b, [key, "cell"]).where(near & once).drop("cell")
    return pairs if condition is None else pairs.where(condition)


def overlap_pairs(items: DataFrame, key: str, reach: float) -> DataFrame:
    pairs = interval_pairs(items, key, reach)
    return pairs.withColumn("overlap", overlap_ratio(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")))


def ranked(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
