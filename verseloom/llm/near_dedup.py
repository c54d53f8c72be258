"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles (operator 8).

1. One pass makes each text's word key (equal words: one class at once, copies are not compared any
   further) and deals the distinct texts into parts of PART words. A second counts each part's shingles, by
   ranges of their hashes; the counts of a range meet in one task, which adds them up and answers each part
   with the document frequencies of its own shingles, in their order. So every shingle of SHINGLE words weighs
   tf * idf, idf = 1 + ln(N / df), with its exact frequency among all N documents, copies included; nothing is
   hashed into buckets, rounded, or held in a table that every task would have to read.
2. Texts meet their part's answers, are signed by BANDS * ROWS samples, hashed into bands, and keep their weights.
3. In each band bucket every text is linked to the bucket's least text; of these links each text tries
   one. Links are verified by exact weighted Jaccard on the whole texts and joined into components.
4. In buckets of several components, texts outside the largest one are compared with all others in blocks:
   first by signatures alone, then, where a pair agrees in half of its samples or more (a pair of
   similarity 0.8 falls below with a probability under 1e-11), by exact weighted Jaccard on the whole texts,
   by falling agreement, unless the two have been joined by then. A component of many texts is thus sent
   once for each block of the others, not for each of its own, and no bucket has a cap.

Each text gets the class of its component, named by the smallest doc_id; the row of the smallest doc_id
stays (of rows that repeat it, one). ``n_links`` counts the verified links of a row's text that made its
class. Null texts count as empty; texts without words are alike only if equal; texts of fewer than SHINGLE
words are one shingle. Texts are read whole. An empty table gives an empty result. Only the two columns
named are read, so extra columns don't clash.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseloom.llm.icws import Sampler
from verseloom.llm.shared import compare_to_hubs, first_of_each, join_counted, map_arrow, materialize, remove, rows, shuffle_partitions, stored, unused
from verseloom.llm.word_hash import word_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 5
#: Share of documents below which shingles weigh alike: none, every frequency counts.
FREQUENT = 0.0
#: Words of a part: texts whose frequencies are asked for together.
PART = 1 << 19
#: Ranges of hashes a shuffle partition, so that a task adds up fewer counts at once.
RANGES = 2
#: Texts of a block when signatures are compared, and when whole texts are; bytes of texts of a block.
SIGNATURE_BLOCK, TEXT_BLOCK, BLOCK_BYTES = 4096, 512, 64 << 20
#: Least share of equal samples at which a pair is verified: 7.5 standard errors below the threshold.
MAYBE = 0.5
#: Copies of a text that a task signs once: keys that it remembers.
REMEMBERED = 200_000


def shingles(h: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of word hashes, sorted, and how often each occurs."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = min(size, len(h))
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : len(h) - size + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    out.sort()
    fresh = np.flatnonzero(np.concatenate([[True], out[1:] != out[:-1]]))
    return out[fresh], np.diff(np.append(fresh, len(out)))


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return (1 + np.log(1 / np.clip(df / max(1, n_docs), FREQUENT, 1))).astype(np.float32)


class Idf(NamedTuple):
    """Shingles and their idf."""

    terms: np.ndarray
    values: np.ndarray


def word_key(text: str, h: np.ndarray) -> bytes:
    """Equal for texts of equal words; for texts without words, for equal texts."""
    return hashlib.md5(h.tobytes() if len(h) else b"\0" + text.encode("utf-8", "surrogatepass")).digest()


def pack_body(terms: np.ndarray, weight: np.ndarray) -> bytes:
    """32-bit names, sorted, and 32-bit weights."""
    return (terms >> np.uint64(32)).astype("<u4").tobytes() + weight.astype("<f4").tobytes()


@functools.lru_cache(maxsize=2 * TEXT_BLOCK)
def _body(packed: bytes) -> tuple[np.ndarray, np.ndarray, float]:
    """Names, weights and their sum."""
    n = len(packed) // 8
    w = np.frombuffer(packed, "<f4", n, 4 * n).astype(np.float64)
    return np.frombuffer(packed, "<u4", n), w, float(w.sum())


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Of two bodies."""
    (ta, wa, sa), (tb, wb, sb) = _body(a), _body(b)
    if not len(ta) or not len(tb):
        return 0.0
    at = np.searchsorted(tb, ta)
    at[at == len(tb)] = 0
    same = tb[at] == ta
    shared = float(np.minimum(wa[same], wb[at[same]]).sum())
    return shared / (sa + sb - shared)


def _digest(text: Column) -> Column:
    """128 bits of a text; a row is its id and this."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def keys_and_frequencies(source: DataFrame) -> DataFrame:
    """A row (doc_id, digest, row, key) for each text; and (part, place, key, copies, text) for each distinct text with words of a part, whose frequencies are asked for together. ``row`` numbers all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "digest", "row", "key", "part", "place", "copies", "text"]
        task = TaskContext.get().partitionId()
        row, part, words = task << 33, task << 24, 0
        held: dict[bytes, list] = {}

        def texts() -> pa.RecordBatch:
            n = len(held)
            cols = [pa.array(list(held), pa.binary()), pa.array([part] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([c for c, _ in held.values()], pa.int64()), pa.array([t for _, t in held.values()], pa.string())]
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), *cols], names)

        for doc, digests, every in rows(batches):
            keys = []
            for text in every:
                h = word_hashes(text)
                keys.append(key := word_key(text, h))
                if key in held:
                    held[key][0] += 1
                elif len(h):
                    held[key] = [1, text]
                    words += len(h)
                if words >= PART:
                    yield texts()
                    held.clear()
                    part, words = part + 1, 0
            n = len(doc)
            cols = [pa.array(doc, pa.int64()), pa.array(digests, pa.binary()), pa.array(np.arange(row, row + n)), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.string())], names)
            row += n
        if held:
            yield texts()

    return map_arrow(source.select("doc_id", _digest(F.col("text")).alias("digest"), "text"), run, "doc_id long, digest binary, row long, key binary, part long, place long, copies long, text string")


def counted_parts(counted: DataFrame) -> DataFrame:
    """(part, first, shard, terms, counts): the sorted shingles of a part in each range of hashes, and how many of its documents have them.

    Where a reader cuts a part in two, each piece is counted by itself; ``first`` is the place of its first text.
    """
    shards = RANGES * shuffle_partitions(counted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece(part: int, first: int, found: list[np.ndarray], copies: list[int]) -> pa.RecordBatch:
            terms, where = np.unique(np.concatenate(found), return_inverse=True)
            counts = np.bincount(where, np.repeat(copies, [len(x) for x in found]), len(terms)).astype("<i8")
            cuts = np.searchsorted(_shard(terms, shards), np.arange(shards + 1))
            own = [k for k in range(shards) if cuts[k] < cuts[k + 1]]
            packed = [[v[cuts[k] : cuts[k + 1]].tobytes() for k in own] for v in (terms, counts)]
            cols = [pa.array([part] * len(own), pa.int64()), pa.array([first] * len(own), pa.int64()), pa.array(own, pa.int32()), pa.array(packed[0], pa.binary()), pa.array([zlib.compress(x, 1) for x in packed[1]], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "first", "shard", "terms", "counts"])

        now, found, copies = None, [], []
        for parts, places, many, texts in rows(batches, 256):
            for part, place, n, text in zip(parts, places, many, texts):
                if now is None or part != now[0]:
                    if now is not None:
                        yield piece(*now, found, copies)
                    now, found, copies = (part, place), [], []
                found.append(shingles(word_hashes(text))[0])
                copies.append(n)
        if now is not None:
            yield piece(*now, found, copies)

    return map_arrow(counted.where("part is not null").select("part", "place", "copies", "text"), run, "part long, first long, shard int, terms binary, counts binary")


def _shard(terms: np.ndarray, shards: int) -> np.ndarray:
    """The range of hashes that a shingle is in: ``shards`` equal ones, in order."""
    return ((terms >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).view(np.int64)


def _added_up(pieces: DataFrame, made, schema: str) -> DataFrame:  # noqa: ANN001
    """``made(shard, parts, firsts, terms, sizes, where, df)`` gives a batch of each range: its distinct shingles, their frequencies, and where the pieces' shingles, one piece after the other, are among them."""
    spread = pieces.repartition(shuffle_partitions(pieces.sparkSession), "shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def total(shard: int, held: list[tuple]) -> pa.RecordBatch:
            found = [np.frombuffer(t, np.uint64) for _, _, t, _ in held]
            terms, where = np.unique(np.concatenate(found), return_inverse=True)
            counts = np.concatenate([np.frombuffer(zlib.decompress(c), "<i8") for *_, c in held])
            df = np.bincount(where, counts, len(terms)).astype(np.int64)
            return made(shard, [h[0] for h in held], [h[1] for h in held], terms, [len(x) for x in found], where, df)

        now, held = None, []
        for parts, firsts, shards, terms, counts in rows(batches, 64):
            for part, first, shard, t, c in zip(parts, firsts, shards, terms, counts):
                if shard != now:
                    if held:
                        yield total(now, held)
                    now, held = shard, []
                held.append((part, first, t, c))
        if held:
            yield total(now, held)

    return map_arrow(spread, run, schema)


def answers(pieces: DataFrame) -> DataFrame:
    """(part, first, shard, df): the document frequencies of a piece's shingles in a range, in their order."""

    def made(shard: int, parts: list[int], firsts: list[int], terms: np.ndarray, sizes: list[int], where: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        each = np.split(df[where].astype("<i8"), np.cumsum(sizes)[:-1])
        cols = [pa.array(parts, pa.int64()), pa.array(firsts, pa.int64()), pa.array([shard] * len(parts), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in each], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["part", "first", "shard", "df"])

    return _added_up(pieces, made, "part long, first long, shard int, df binary")


def frequencies(pieces: DataFrame) -> DataFrame:
    """(term, df): exact document frequencies of all shingles, a row each."""

    def made(shard: int, parts: list[int], firsts: list[int], terms: np.ndarray, sizes: list[int], where: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df)], ["term", "df"])

    return _added_up(pieces, made, "term long, df long")


def idf_table(source: DataFrame, counted: DataFrame, n_docs: int) -> Idf:
    """The idf of all shingles of a small corpus, to look at; ``signatures`` takes them part by part."""
    found = frequencies(counted_parts(counted)).where(F.col("df") >= FREQUENT * n_docs).toArrow()
    return Idf(found.column("term").to_numpy().view(np.uint64), idf(found.column("df").to_numpy(), n_docs))


def signatures(counted: DataFrame, answered: DataFrame, n_docs: int) -> DataFrame:
    """(key, bands array<long>, sig binary, body binary, size, total) of every text with words; copies that a task meets again are left out."""
    none = lambda kind: F.lit(None).cast(kind)
    asked = answered.select("part", F.lit(0).alias("kind"), F.col("first").alias("at"), "shard", "df", none("binary").alias("key"), none("string").alias("text"))
    texts = counted.where("part is not null").select("part", F.lit(1).alias("kind"), F.col("place").alias("at"), none("int").alias("shard"), none("binary").alias("df"), "key", "text")
    dealt = asked.unionByName(texts).repartition(shuffle_partitions(counted.sparkSession), "part").sortWithinPartitions("part", "kind", "at", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler()
        seen: set[bytes] = set()

        def signed(df: list[bytes], texts: list[tuple[bytes, str]]) -> Iterator[pa.RecordBatch]:
            found = [shingles(word_hashes(t)) for _, t in texts]
            every, where = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
            weight = idf(np.concatenate([np.frombuffer(zlib.decompress(x), "<i8") for x in df]), n_docs)
            if len(weight) != len(every):
                raise RuntimeError("a part of the texts has other shingles than were counted")
            each = np.split(weight[where], np.cumsum([len(t) for t, _ in found])[:-1])
            fresh = []
            for k, (key, _) in enumerate(texts):
                if key not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    fresh.append(k)
            for lo in range(0, len(fresh), 64):
                some = fresh[lo : lo + 64]
                bags = [(found[k][0], found[k][1].astype(np.float32) * each[k]) for k in some]
                sigs = sampler.signatures((t, np.log(w)) for t, w in bags)
                cols = (
                    pa.array([texts[k][0] for k in some], pa.binary()),
                    pa.array([_bands(s) for s in sigs], pa.list_(pa.int64())),
                    pa.array([s.tobytes() for s in sigs], pa.binary()),
                    pa.array([pack_body(t, w) for t, w in bags], pa.binary()),
                    pa.array([len(t) for t, _ in bags], pa.int64()),
                    pa.array([float(w.astype(np.float64).sum()) for _, w in bags], pa.float64()),
                )
                yield pa.RecordBatch.from_arrays(list(cols), ["key", "bands", "sig", "body", "size", "total"])

        def whole(pieces: dict[int, list[bytes]], texts: list[tuple[int, bytes, str]]) -> Iterator[pa.RecordBatch]:
            firsts = sorted(pieces)
            cuts = [bisect_right([at for at, *_ in texts], first - 1) for first in firsts] + [len(texts)]
            for first, a, b in zip(firsts, cuts, cuts[1:]):
                yield from signed(pieces[first], [x[1:] for x in texts[a:b]])

        now, pieces, texts = None, {}, []
        for cols in rows(batches, 256):
            for part, kind, at, _, df, key, text in zip(*cols):
                if part != now:
                    if texts:
                        yield from whole(pieces, texts)
                    now, pieces, texts = part, {}, []
                if kind == 0:
                    pieces.setdefault(at, []).append(df)
                else:
                    texts.append((at, key, text))
        if texts:
            yield from whole(pieces, texts)

    return map_arrow(dealt, run, "key binary, bands array<long>, sig binary, body binary, size long, total double")


@functools.cache
def _sampler() -> Sampler:
    return Sampler(BANDS * ROWS)


def _bands(sig: np.ndarray) -> list[int]:
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for col in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        h = (h ^ col) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h.view(np.int64).tolist()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every node of ``edges`` (a, b): comp is the least id reached.

    Least labels of neighbours, then of labels themselves (so paths halve), until nothing changes; each
    round is a table in the shared folder.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        stepped = labels.join(near, "id").select("id", F.least("comp", "m").alias("next"), "comp")
        jump = labels.select(F.col("id").alias("next"), F.col("comp").alias("far"))
        moved = materialize(stepped.join(jump, "next").select("id", F.least("next", "far").alias("comp"), (F.least("next", "far") != F.col("comp")).alias("moved")), "labels")
        labels = moved.select("id", "comp")
        if moved.where("moved").limit(1).count() == 0:
            return labels


def _blocks(members: DataFrame, texts: int, n_members: int) -> DataFrame:
    """Members of buckets with several components, dealt into pairs of blocks: (bucket, i, j, side, id, comp).

    Side 0 has the members outside the bucket's largest component, in blocks i; side 1 all members, in blocks j.
    Blocks have ``texts`` members or BLOCK_BYTES of weights on average at most.
    """
    per = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    sizes = per.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "comp", "size")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    blocks = lambda n, size: F.ceil(F.greatest(n / texts, size * 8 / BLOCK_BYTES)).cast("int")
    sizes = sizes.select("bucket", "n", F.col("top.comp").alias("main"), blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("left"), blocks(F.col("n"), F.col("size")).alias("right"))
    joined = join_counted(members, materialize(sizes, "near-sizes"), "bucket", n_members)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    first = joined.where("comp != main").select("bucket", own(F.col("left")).alias("i"), every(F.col("right")).alias("j"), F.lit(0).alias("side"), "id", "comp")
    second = joined.select("bucket", every(F.col("left")).alias("i"), own(F.col("right")).alias("j"), F.lit(1).alias("side"), "id", "comp")
    return first.unionByName(second)


def _pairs(key: tuple, left: list[tuple], right: list[tuple], threshold: float) -> Iterator[tuple[float, int, int]]:
    """Agreement and places of the pairs of different components that may reach the threshold, in the first band that they share.

    Rows are (id, comp, total, sig, ...). Sums of weights whose ratio is below the threshold rule a pair out.
    """
    sa, sb = (np.frombuffer(b"".join(g[3] for g in side), np.uint32).reshape(len(side), -1) for side in (left, right))
    band = _bands(sa[0]).index(key[0])
    id_b, comp_b, total_b = (np.array([g[k] for g in right]) for k in range(3))
    outside = {g[1] for g in left}
    both = np.array([c in outside for c in comp_b.tolist()])  # these are on both sides
    for k, (ident, comp, total, *_) in enumerate(left):
        ok = (comp_b != comp) & ~(both & (id_b < ident)) & (np.minimum(total_b, total) >= threshold * 0.9999 * np.maximum(total_b, total))
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        equal = sa[k] == sb[at]
        share = equal.mean(1)
        maybe = np.flatnonzero(share >= MAYBE)
        if len(maybe):
            first = equal[maybe].reshape(len(maybe), BANDS, ROWS).all(2).argmax(1) == band
            for m in maybe[first].tolist():
                yield float(share[m]), k, int(at[m])


def _grouped(dealt: DataFrame, fn, schema: str) -> DataFrame:  # noqa: ANN001
    """``fn(key, left rows, right rows)`` yields pairs of longs, for each (bucket, i, j)."""
    cols = [c for c in dealt.columns if c not in ("bucket", "i", "j", "side")]
    spread = dealt.select("bucket", "i", "j", "side", *cols).repartition(shuffle_partitions(dealt.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def out() -> pa.RecordBatch:
            found = list(fn(key, *sides)) if all(sides) else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names)

        for part in rows(batches, 256):
            for row in zip(*part):
                if row[:3] != key:
                    if key is not None:
                        yield out()
                    key, sides = row[:3], ([], [])
                sides[row[3]].append(row[4:])
        if key is not None:
            yield out()

    return map_arrow(spread, run, schema)


def cross_links(members: DataFrame, signed: DataFrame, threshold: float, n_members: int) -> DataFrame:
    """(a, b): verified links that join different components of a bucket. ``members``: (bucket, id, comp, size)."""

    def survivors(key: tuple, left: list[tuple], right: list[tuple]) -> Iterator[tuple[int, int]]:
        kept = set()
        for _, k, m in _pairs(key, left, right, threshold):
            kept |= {left[k][0], right[m][0]}
        return ((key[0], i) for i in sorted(kept))

    dealt = _blocks(members, SIGNATURE_BLOCK, n_members).join(signed.select("id", "total", "sig"), "id")
    left = materialize(_grouped(dealt.select("bucket", "i", "j", "side", "id", "comp", "total", "sig"), survivors, "bucket long, id long").distinct(), "near-survivors")

    def links(key: tuple, left: list[tuple], right: list[tuple]) -> Iterator[tuple[int, int]]:
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while joined.get(c, c) != c:
                joined[c] = c = joined.get(joined[c], joined[c])
            return c

        for _, k, m in sorted(_pairs(key, left, right, threshold), reverse=True):
            p, q = root(left[k][1]), root(right[m][1])
            if p != q and weighted_jaccard(left[k][4], right[m][4]) >= threshold:
                joined[p] = q
                yield left[k][0], right[m][0]

    again = materialize(members.join(left, ["bucket", "id"]), "near-candidates")
    dealt = _blocks(again, TEXT_BLOCK, n_members).join(signed.select("id", "total", "sig", "body"), "id")
    return _grouped(dealt.select("bucket", "i", "j", "side", "id", "comp", "total", "sig", "body"), links, "a long, b long")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, digest, comp, class_id, class_size, n_links, kept) for every row: comp names the class, class_id is its smallest doc_id, one row a class is kept."""
    spark = docs.sparkSession
    source = _source(docs, id_col, text_col)
    counted, texts_at = stored(keys_and_frequencies(source), "near-texts")
    keyed = materialize(counted.where("part is null").select("doc_id", "digest", "row", "key"), "near-keys")
    n_docs = keyed.count()
    answered, answers_at = stored(answers(counted_parts(counted)), "near-answers")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    firsts = materialize(keyed.groupBy("key").agg(F.min("row").alias("id"), least.alias("least"), F.count(F.lit(1)).alias("n")), "near-firsts")
    ids = firsts.select("key", "id")
    made = materialize(signatures(counted, answered, n_docs), "near-made")
    remove(spark, texts_at, answers_at)

    banded = materialize(made.select("key", "bands", "size").join(ids, "key").select("id", "size", F.explode("bands").alias("bucket")).dropDuplicates(["id", "bucket"]), "near-bands")
    leaders = materialize(banded.groupBy("bucket").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"), "near-buckets")
    n_banded = n_docs * BANDS
    shared = materialize(join_counted(banded, leaders, "bucket", n_banded).select("bucket", "id", "size", "leader"), "near-shared")
    involved = shared.select("id").distinct().join(ids, "id")
    signed = materialize(made.drop("bands", "size").join(involved, "key").drop("key").dropDuplicates(["id"]), "near-signed")

    first_links = shared.where("id != leader").groupBy("id").agg(F.min("leader").alias("hub"))
    likened = compare_to_hubs(first_links, signed.select("id", "body"), weighted_jaccard)
    verified = materialize(likened.where(F.col("likeness") >= threshold).select(F.col("id").alias("a"), F.col("hub").alias("b")), "near-links")
    comps = components(verified)
    members = materialize(shared.select("bucket", "id", "size").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "near-members")
    crossed = cross_links(members, signed, threshold, n_banded)
    edges = materialize(verified.unionByName(crossed).distinct(), "near-all-links")
    comps = components(edges)
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))

    named = firsts.join(comps, "id", "left").join(ends, "id", "left").select("key", F.coalesce("comp", "id").alias("comp"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "least", "n")
    named = materialize(named, "near-classed")
    classes = named.groupBy("comp").agg(F.min("least").alias("first"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("n"))
    n_texts = firsts.count()
    found = join_counted(named.select("key", "comp", "n_links", F.col("n").alias("copies")), materialize(classes, "near-classes"), "comp", n_texts)
    found = materialize(found.select("key", "comp", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("first_row"), "class_size", "n_links", F.col("copies").alias("n")), "near-result")
    return join_counted(keyed, found, "key", n_docs).select("doc_id", "digest", "comp", "class_id", "class_size", "n_links", (F.col("row") == F.col("first_row")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, the smallest doc_id's, with all its columns."""
    stay = materialize(classify(docs, id_col, text_col).where("kept").select("doc_id", "digest"), "near-kept")
    a, b = unused(docs, "__id"), unused(docs, "__digest")
    keyed = docs.withColumn(a, F.col(id_col).cast("long")).withColumn(b, _digest(F.col(text_col)))
    left = keyed.join(stay, F.col(a).eqNullSafe(stay["doc_id"]) & (F.col(b) == stay["digest"]), "left_semi")
    return first_of_each(left, F.col(a), F.col(b)).select(*docs.columns)
