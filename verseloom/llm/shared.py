"""What the operators of this subpackage share: the shared folder, code shipping, skew-safe fan-in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseloom.runtime import fresh_path, materialize, remove, send_code, shuffle_partitions, stored

__all__ = ["compare_to_hubs", "crc_mod", "first_of_each", "fresh_path", "join_counted", "map_arrow", "materialize", "remove", "rows", "shuffle_partitions", "stored", "unused", "words_of"]


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    send_code(df.sparkSession)
    return df.mapInArrow(fn, schema)


def rows(batches: Iterator[pa.RecordBatch], step: int = 512) -> Iterator[list[list]]:
    """Columns as Python lists, at most ``step`` rows at once, so memory doesn't follow the batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield [c.to_pylist() for c in part.columns]


def crc_mod(col: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; null where the id is null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_of_each(df: DataFrame, *keys: Column) -> DataFrame:
    """One row for each value of ``keys``; the rows of a value are interchangeable."""
    once = unused(df, "__once")
    return df.withColumn(once, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))).where(F.col(once) == 1).drop(once)


#: A key with more than this part of all rows is hot; there are at most as many hot keys.
HOT = 2_000


def join_counted(rows_: DataFrame, counted: DataFrame, on: str, total: int, how: str = "inner") -> DataFrame:
    """Joins rows to ``counted``: a row a key, whose ``n`` is at least the key's number of rows.

    The hot keys, fewer than HOT by their definition, are broadcast, so their rows stay where they are; by the
    shuffle each key moves a small part of the rows only. ``n`` sums to ``total`` at most (its callers see to it).
    """
    is_hot = F.col("n") * HOT > F.lit(total)
    hot = F.broadcast(counted.where(is_hot))
    cold = rows_.join(F.broadcast(counted.where(is_hot).select(on)), on, "left_anti")
    return rows_.join(hot, on).unionByName(cold.join(counted.where(~is_hot), on, how))


HUB_ROWS = 256


def compare_to_hubs(links: DataFrame, payload: DataFrame, same: Callable[[object, object], float]) -> DataFrame:
    """Applies ``same(hub payload, member payload)`` to every link and returns (id, hub, likeness).

    ``links`` (id, hub) are narrow and distinct; ``payload`` (id, body) holds the large values, equal ones for equal ids.
    A hub with many members is dealt over ceil(members / HUB_ROWS) salted groups, each of which gets
    one copy of the hub's payload: no task gets more of a hub's members than fit, and the copies grow
    with the links, not with their square.
    """
    spark = links.sparkSession
    counts = links.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).select("hub", F.ceil(F.col("n") / HUB_ROWS).cast("long").alias("salts"))
    members = links.join(counts, "hub").select("id", "hub", F.pmod(F.xxhash64("id"), "salts").alias("salt"), F.lit(1).alias("role"))
    hubs = counts.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = members.unionByName(hubs)
    # one payload an id: rows that repeat id and text would else multiply; all of it on one partitioning by id
    needed = payload.join(wanted.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    dealt = wanted.join(needed, "id").select("hub", "salt", "role", "id", "body")
    dealt = dealt.repartition(shuffle_partitions(spark), "hub", "salt").sortWithinPartitions("hub", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_key, hub_body = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                hub, salt, role, body = (part.column(c).to_pylist() for c in ("hub", "salt", "role", "body"))
                at, likeness = [], []
                for k, (h, s, r, b) in enumerate(zip(hub, salt, role, body)):
                    if r == 0:
                        hub_key, hub_body = (h, s), b
                    elif (h, s) == hub_key:
                        at.append(k)
                        likeness.append(float(same(hub_body, b)))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(at, pa.int64())) for c in ("id", "hub")), pa.array(likeness, pa.float64())], ["id", "hub", "likeness"])

    kinds = dict(links.dtypes)
    return map_arrow(dealt, run, f"id {kinds['id']}, hub {kinds['hub']}, likeness double")


def words_of(text: str) -> list[str]:
    return re.findall(r"\w+", text.casefold())
