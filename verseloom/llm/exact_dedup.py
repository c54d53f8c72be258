r"""Exact deduplication by a log-structured merge index (operator 5).

Write path: every task puts (digest, smallest row, count) into a memtable; a full memtable is flushed as a
run, sorted by digest and cut into shards by it, a stored segment with a Bloom filter for each shard.
Compaction takes a shard's segments in order and merges FAN of one level into one of the next, as a
log-structured tree does: a digest that no other segment's filter may hold passes straight through; only
the others enter the merge, which keeps the smallest identifier and adds the counts. ``probe`` looks a few
digests up in stored segments, filters first.

Rows look the repeated digests up: one that the index has once needs none. Hot digests, fewer than HOT of
``shared`` by their share of all rows, are broadcast, so a digest of a third of all rows moves no rows.
Every hit (a row that shares its digest with the row that stays) is verified byte by byte against that
row's text; hits whose bytes differ leave the group and are decided anew by the next digest.

Texts are equal when identical after replacing each ``[\x20\x09-\x0D]+`` by one space. Null texts count
as empty and are equal to each other; the smallest doc_id of a group stays, null ids count as larger
than any; rows that repeat both id and text are copies, one of which stays. A row is its id and a hash of
its text. Long texts are read whole. An empty table gives an empty result. Only the two columns named are
read, so extra columns don't clash.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseloom.llm.shared import compare_to_hubs, first_of_each, join_counted, map_arrow, materialize, rows, shuffle_partitions, unused

#: Digests that a memtable holds before it is flushed; segments of a level that are merged into one of the next.
MEMTABLE, FAN = 65_536, 8
#: Filter bits a digest, and probes.
FILTER_BITS, PROBES = 10, 5
#: Bytes of a digest.
WIDE = 32
SEGMENT = "shard int, entries binary, bloom binary, n long, merged long"
_ENTRY = np.dtype([("digest", f"S{WIDE}"), ("none", "u1"), ("id", "<i8"), ("row", "<i8"), ("mark", "<i8"), ("n", "<i8")])


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


#: Digests of normalised texts, WIDE bytes each; the next one decides about texts that the one before confounds.
DIGESTS: tuple[Callable[[Column], Column], ...] = (lambda t: F.unhex(F.sha2(t, 256)), lambda t: F.unhex(F.substring(F.sha2(t, 512), 1, 2 * WIDE)))


def _words(digests: np.ndarray) -> np.ndarray:
    return np.frombuffer(digests.astype(f"S{WIDE}").tobytes(), "<u4").reshape(-1, WIDE // 4)[:, :PROBES]


def filter_of(digests: np.ndarray) -> bytes:
    """Bloom filter of digests, whose bytes are random enough to serve as probes."""
    bits = np.zeros(max(64, FILTER_BITS * len(digests) // 8 * 8), bool)
    bits[_words(digests) % len(bits)] = True
    return np.packbits(bits).tobytes()


def may_hold(bloom: bytes, digests: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(bloom, np.uint8)).astype(bool)
    return bits[_words(digests) % len(bits)].all(axis=1)


class Segment(NamedTuple):
    """Entries of a run in a shard, sorted by digest; their filter; entries that merges read to make them."""

    entries: np.ndarray
    bloom: bytes
    merged: int


def _combined(entries: np.ndarray) -> np.ndarray:
    """One entry a digest, sorted: the smallest row and the sum of the counts. The stable sort merges runs."""
    entries = entries[np.lexsort((entries["row"], entries["id"], entries["none"]))] if len(entries) > 1 else entries
    entries = entries[np.argsort(entries["digest"], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], entries["digest"][1:] != entries["digest"][:-1]])) if len(entries) else np.zeros(0, np.int64)
    out = entries[first].copy()
    if len(first):
        out["n"] = np.add.reduceat(entries["n"], first)
    return out


def merge(segments: list[Segment]) -> Segment:
    """One segment of several: entries that no other filter may hold pass through, the others are merged."""
    if len(segments) == 1:
        return segments[0]
    through, shared = [], []
    for k, s in enumerate(segments):
        partner = np.zeros(len(s.entries), bool)
        for other in (x for j, x in enumerate(segments) if j != k):
            alone = np.flatnonzero(~partner)
            partner[alone] = may_hold(other.bloom, s.entries["digest"][alone])
        through.append(s.entries[~partner])
        shared.append(s.entries[partner])
    read = sum(map(len, shared))
    entries = np.concatenate([*through, _combined(np.concatenate(shared))])
    entries = entries[np.argsort(entries["digest"], kind="stable")]
    return Segment(entries, filter_of(entries["digest"]), read + sum(s.merged for s in segments))


def _batch(segments: list[tuple[int, Segment]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    cols = list(zip(*((shard, s.entries.tobytes(), s.bloom, len(s.entries), s.merged) for shard, s in segments))) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["shard", "entries", "bloom", "n", "merged"])


def sorted_runs(keyed: DataFrame, memtable: int = MEMTABLE) -> DataFrame:
    """Segments of the runs that the tasks flush, from (digest, doc_id, row, mark). Shards are equal ranges of the digests' first bytes."""
    shards = shuffle_partitions(keyed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            entries = np.array([(d, *e) for d, e in held.items()], _ENTRY)
            entries = entries[np.argsort(entries["digest"], kind="stable")]
            shard = np.frombuffer(entries["digest"].tobytes(), ">u4").reshape(-1, WIDE // 4)[:, 0].astype(np.int64) * shards >> 32
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            for k in range(shards):
                if cuts[k] < cuts[k + 1]:
                    part = entries[cuts[k] : cuts[k + 1]]
                    yield _batch([(k, Segment(part, filter_of(part["digest"]), 0))])
            held.clear()

        for digests, ids, numbers, marks in rows(batches, 4096):
            for d, i, row, mark in zip(digests, ids, numbers, marks):
                new = [i is None, i or 0, row, mark]
                if (entry := held.get(d)) is None:
                    held[d] = [*new, 1]
                else:
                    entry[:4] = min(entry[:4], new)
                    entry[4] += 1
            if len(held) >= memtable:
                yield from flush()
        if held:
            yield from flush()

    return map_arrow(keyed.select("digest", "doc_id", "row", "mark"), run, SEGMENT)


def _segment(entries: bytes, bloom: bytes, merged: int) -> Segment:
    return Segment(np.frombuffer(entries, _ENTRY), bloom, merged)


def compacted(runs: DataFrame, fan: int = FAN) -> DataFrame:
    """One segment a shard. A digest has one entry a run, so none weighs more than the number of runs."""
    dealt = runs.repartition(shuffle_partitions(runs.sparkSession), "shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, levels = None, []

        def whole() -> pa.RecordBatch:
            return _batch([(now, merge([s for level in levels for s in level]))])

        for shard, entries, bloom, _, merged in rows(batches, 64):
            for k, e, b, m in zip(shard, entries, bloom, merged):
                if k != now:
                    if now is not None:
                        yield whole()
                    now, levels = k, [[]]
                levels[0].append(_segment(e, b, m))
                for at, level in enumerate(levels):
                    if len(level) < fan:
                        break
                    if at + 1 == len(levels):
                        levels.append([])
                    levels[at + 1].append(merge(level))
                    level.clear()
        if now is not None:
            yield whole()

    return map_arrow(dealt, run, SEGMENT)


_FOUND = "digest binary, least_id long, least_row long, least_mark long, n long"


def _found(entries: np.ndarray) -> pa.RecordBatch:
    raw = entries["digest"].tobytes()
    digests = [raw[k : k + WIDE] for k in range(0, len(raw), WIDE)]
    ids = pa.array(entries["id"].copy(), pa.int64(), mask=entries["none"].astype(bool))
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), ids, *(pa.array(entries[c].copy()) for c in ("row", "mark", "n"))], ["digest", "least_id", "least_row", "least_mark", "n"])


def repeated(index: DataFrame) -> DataFrame:
    """(digest, least_id, least_row, least_mark, n) of the digests that several rows have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, entries, *_ in rows(batches, 1):
            for e in entries:
                yield _found((found := np.frombuffer(e, _ENTRY))[found["n"] > 1])

    return map_arrow(index, run, _FOUND)


def probe(segments: DataFrame, digests: list[bytes]) -> DataFrame:
    """(digest, least_id, least_row, least_mark, n) of a few digests, straight from stored segments: filters first, then a bisection."""
    asked = np.array(sorted(digests), f"S{WIDE}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, entries, bloom, *_ in rows(batches, 16):
            for e, b in zip(entries, bloom):
                maybe = asked[may_hold(b, asked)]
                if len(maybe):
                    found = np.frombuffer(e, _ENTRY)
                    at = np.minimum(np.searchsorted(found["digest"], maybe), len(found) - 1)
                    yield _found(found[at[found["digest"][at] == maybe]])

    hits = map_arrow(segments, run, _FOUND)
    least = F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "least_row", "least_mark"))
    return hits.groupBy("digest").agg(least.alias("x"), F.sum("n").alias("n")).select("digest", "x.least_id", "x.least_row", "x.least_mark", "n")


@functools.lru_cache(maxsize=4)
def _plain(text: str | None) -> str:
    return re.sub("[\x20\x09-\x0D]+", " ", text or "")


def mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _key(ident: str, its_mark: str) -> Column:
    return F.concat_ws(":", F.coalesce(F.col(ident).cast("string"), F.lit("-")), F.col(its_mark).cast("string"))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: tuple[Callable[[Column], Column], ...] = DIGESTS) -> DataFrame:
    """(doc_id, mark, keep_id, group_size, kept, text_sha256) for every row; ``mark`` hashes the text, with the id it names a row."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", mark(F.col("text")))
    plain = source.select("doc_id", "mark", normalized(F.col("text")).alias("plain"))
    keyed = materialize(plain.select("doc_id", "mark", digests[0](F.col("plain")).alias("digest"), F.unhex(F.sha2("plain", 256)).alias("sha256"), F.monotonically_increasing_id().alias("row")), "lsm-keys")
    runs = materialize(sorted_runs(keyed), "lsm-runs")
    index = materialize(compacted(runs), "lsm-index")
    again = materialize(repeated(index), "lsm-repeated")
    found = materialize(join_counted(keyed, again, "digest", keyed.count(), "left"), "lsm-found")

    # byte verification of hits: each against the row that stays
    hits = found.where("n > 1 and row != least_row").select(_key("doc_id", "mark").alias("id"), _key("least_id", "least_mark").alias("hub")).where("id != hub").distinct()
    bodies = source.select(_key("doc_id", "mark").alias("id"), F.col("text").alias("body"))
    differ = materialize(compare_to_hubs(hits, bodies, lambda a, b: _plain(a) == _plain(b)).where("likeness < 1").select("id").distinct(), "lsm-differ")
    if differ.limit(1).count():
        return _parted(source, found, differ, digests[1:])
    return _answer(found)


def _answer(found: DataFrame) -> DataFrame:
    single = F.col("n").isNull()
    return found.select(
        "doc_id",
        "mark",
        F.when(single, F.col("doc_id")).otherwise(F.col("least_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("least_row"))).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def _parted(source: DataFrame, found: DataFrame, differ: DataFrame, digests: tuple) -> DataFrame:
    """The decision where hits have other bytes than the row that stays: they leave, and the next digest decides about them."""
    keyed = found.withColumn("id", _key("doc_id", "mark"))
    gone = keyed.join(differ, "id", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
    stay = keyed.join(differ, "id", "left_anti").drop("id").join(gone, "digest", "left").withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0))).drop("gone")
    rest = source.withColumn("id", _key("doc_id", "mark")).join(differ, "id", "left_semi")
    return _answer(stay).unionByName(decide(materialize(rest.select("doc_id", "text"), "lsm-rest"), digests=digests or DIGESTS))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row for each kept (id, text).

    Only rows that repeat both id and text are sorted with their texts to take one of them; the others are filtered.
    """
    by_row = decide(docs, id_col, text_col).groupBy("doc_id", "mark").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    stay = materialize(by_row.where("kept").select("doc_id", "mark", "n"), "lsm-kept")
    a, b = unused(docs, "__id"), unused(docs, "__mark")
    keyed = docs.withColumn(a, F.col(id_col).cast("long")).withColumn(b, mark(F.col(text_col)))

    def left(which: DataFrame) -> DataFrame:
        return keyed.join(which, F.col(a).eqNullSafe(which["doc_id"]) & (F.col(b) == which["mark"]), "left_semi")

    out, many = left(stay.where("n = 1")), stay.where("n > 1")
    if many.limit(1).count():
        out = out.unionByName(first_of_each(left(many), F.col(a), F.col(b)))
    return out.select(*docs.columns)
