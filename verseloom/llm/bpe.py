"""Byte-level BPE by a pair occurrence index, and decoding (operator 9).

A chunk of a partition (bounded by characters and distinct words) is split into words by the
tokenizer's pattern; its distinct words lie one after the other in one symbol array. The index maps
each adjacent pair, known by its merge rank, to all its positions. Active ranks leave a heap in
ascending order; a rank is applied at all its positions at once, and the pairs that arise left and
right join the lists of their own ranks, which are always later ones, since a merge only uses symbols
that earlier merges made. Documents then take their words' ids from the table.

Null texts count as empty (no ids). Texts of any length are read whole; a single long word is a long
run of symbols. Equal rows give equal results; an empty table gives an empty result. Only the two
columns named are read, so extra columns don't clash.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.llm.shared import map_arrow

#: A chunk ends at the document that passes this; a worker forgets its words after a chunk with more.
CHUNK_CHARS, CHUNK_WORDS = 12_000_000, 600_000
#: White space of the tokenizer's pattern. Fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _class(kind: str, end: int) -> str:
    """Ranges of all code points below ``end`` of a general category's first letter, for a character class."""
    out, first = [], None
    for c in range(end + 1):
        inside = c < end and unicodedata.category(chr(c))[0] == kind
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}" + (f"-\\U{c - 1:08x}" if c - 1 > first else ""))
            first = None
    return "".join(out)


@functools.cache
def word_pattern(end: int = sys.maxunicode + 1) -> re.Pattern:
    """The tokenizer's pattern for texts of code points below ``end``; small classes match faster."""
    letters, numbers = _class("L", end), _class("N", end)
    return re.compile(f" ?[{letters}]+| ?[{numbers}]+|'(?:[stmd]|re|ve|ll)| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


@functools.cache
def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """Merge table, byte strings and special tokens of a byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, k in vocab.items():
            self.bytes_of[k] = bytes(symbols[c] for c in token)
        for token, k in self.special.items():
            self.bytes_of[k] = token.encode()
        self.byte_id = np.zeros(256, np.int32)
        for c, b in symbols.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = np.array([[vocab[a], vocab[b]] for a, b in pairs], np.int64).T
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.pairs = list(zip(left.tolist(), right.tolist()))
        keys = left << 20 | right
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.n = len(pairs)
        self.decimal = [str(k).encode() for k in range(len(self.bytes_of))]
        self.leads = np.array([sum(b & 0xC0 != 0x80 for b in x) for x in self.bytes_of], np.int64)
        self.inner = np.array([bool(x) and x[0] & 0xC0 == 0x80 for x in self.bytes_of])
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, n where there is none (a negative symbol is a border)."""
        key = left.astype(np.int64) << 20 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), self.n - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.order[at], self.n)

    def words(self, text: str) -> list:
        """Words of a text; a special token is its id as an int."""
        try:
            text.encode("latin-1")
            find = word_pattern(256).findall
        except UnicodeEncodeError:
            find = word_pattern().findall
        if self.split is None or not self.split.search(text):
            return find(text)
        out: list = []
        for k, part in enumerate(self.split.split(text)):
            out += [self.special[part]] if k % 2 else find(part)
        return out

    def merge(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words in a row, and where each word begins among them (one more at the end)."""
        raw = [w.encode("utf-8", "surrogatepass") if isinstance(w, str) else b"" for w in words]
        joined = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes + 1) - 1  # a border after each word
        sym = self.byte_id[joined]
        sym[ends] = -1
        for k, w in enumerate(words):
            if not isinstance(w, str):
                sym[ends[k]] = -2 - w
        size = len(sym)
        after, before = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
        # the index: positions by rank, as one array in rank order, and lists of those that arise later
        rank = self.ranks(sym[:-1], sym[1:]) if size > 1 else np.zeros(0, np.int64)
        at = np.flatnonzero(rank < self.n)
        at = at[np.argsort(rank[at], kind="stable")]
        active, first = np.unique(rank[at], return_index=True)
        lists: dict[int, list[np.ndarray]] = {r: [x] for r, x in zip(active.tolist(), np.split(at.astype(np.int32), first[1:]))}
        heap = active.tolist()
        while heap:
            r = heapq.heappop(heap)
            found = lists.pop(r)
            pos = found[0] if len(found) == 1 else np.sort(np.concatenate(found))
            a, b = self.pairs[r]
            nxt = after[pos]
            ok = (sym[pos] == a) & (sym[nxt] == b)
            pos, nxt = pos[ok], nxt[ok]
            if a == b and len(pos) > 1:  # in a run of one symbol, every second position from its left
                run = np.flatnonzero(np.concatenate([[True], nxt[:-1] != pos[1:]]))
                place = np.arange(len(pos)) - np.repeat(run, np.diff(np.append(run, len(pos))))
                pos, nxt = pos[place % 2 == 0], nxt[place % 2 == 0]
            if not len(pos):
                continue
            new = self.made[r]
            far = after[nxt]
            sym[pos], sym[nxt] = new, -1_000_000
            after[pos] = far
            before[far] = pos
            prev = before[pos]
            has = prev >= 0
            left_at, lefts = prev[has], sym[prev[has]]
            where = np.concatenate([left_at, pos])
            ranks = self.ranks(np.concatenate([lefts, sym[pos]]), np.concatenate([sym[pos[has]], sym[far]]))
            good = ranks < self.n
            if good.any():
                where, ranks = where[good], ranks[good]
                if len(ranks) < 24:
                    by: dict[int, list[int]] = {}
                    for k, p in zip(ranks.tolist(), where.tolist()):
                        by.setdefault(k, []).append(p)
                    parts = [(k, np.unique(np.array(v, np.int32))) for k, v in by.items()]
                else:
                    order = np.lexsort((where, ranks))
                    ranks, where = ranks[order], where[order]
                    once = np.concatenate([[True], (ranks[1:] != ranks[:-1]) | (where[1:] != where[:-1])])
                    ranks, where = ranks[once], where[once]
                    cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                    parts = list(zip(ranks[np.concatenate([[0], cut])].tolist(), np.split(where, cut)))
                for k, v in parts:
                    if k in lists:
                        lists[k].append(v)
                    else:
                        lists[k] = [v]
                        heapq.heappush(heap, k)
        # what is left between borders; a special token's id stands in its border
        live = sym != -1_000_000
        border = np.zeros(size, bool)
        border[ends] = True
        special = border & (sym <= -2)
        keep = live & (~border | special)
        ids = np.where(special, -2 - sym, sym)[keep].astype(np.int32)
        upto = np.cumsum(keep)
        return ids, np.concatenate([[0], upto[ends]])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.cache
def load(path: str) -> Bpe:
    return Bpe(path)


class Words(dict):
    """Numbers words as they come and keeps their ids, over the chunks and partitions of a worker."""

    def __init__(self, bpe: Bpe) -> None:
        super().__init__()
        self.bpe = bpe
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, word: object) -> int:
        self[word] = k = len(self)
        return k

    def merge(self) -> None:
        """Merges the words that are new since the last time."""
        if new := list(itertools.islice(self, len(self.start) - 1, None)):
            ids, start = self.bpe.merge(new)
            self.flat, self.start = np.concatenate([self.flat, ids]), np.concatenate([self.start, self.start[-1] + start[1:]])

    def forget(self) -> None:
        self.clear()
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)


@functools.cache
def worker_words(path: str) -> Words:
    return Words(load(path))


def encoded(batches: Iterator[pa.RecordBatch], path: str, text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches (cut where a chunk ends), the ids of their texts in a row, and where each text begins among them."""
    bpe, table = load(path), worker_words(path)
    if len(table) >= CHUNK_WORDS:
        table.forget()
    pending: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
    chars = 0

    def flush() -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        nonlocal chars
        table.merge()
        sizes = np.diff(table.start)
        for batch, docs in pending:
            # a slice of documents at a time, so the arrays of positions stay small
            for lo in range(0, len(docs), 256):
                part = docs[lo : lo + 256]
                which = np.concatenate(part)
                n = sizes[which]
                upto = np.cumsum(n)
                total = int(upto[-1]) if len(upto) else 0
                at = np.arange(total) + np.repeat(table.start[which] - (upto - n), n)
                begins = np.concatenate([[0], upto])[np.cumsum([0, *map(len, part)])]
                yield batch.slice(lo, len(part)), table.flat[at], begins
        pending.clear()
        chars = 0
        if len(table) >= CHUNK_WORDS:
            table.forget()

    for batch in batches:
        lo, docs = 0, []
        for text in batch.column(text_at):
            text = text.as_py() or ""
            words = bpe.words(text)
            docs.append(np.fromiter(map(table.__getitem__, words), np.int32, len(words)))
            chars += len(text)
            if chars >= CHUNK_CHARS:
                pending.append((batch.slice(lo, len(docs)), docs))
                lo, docs = lo + len(docs), []
                yield from flush()
        if docs:
            pending.append((batch.slice(lo, len(docs)), docs))
    if pending:
        yield from flush()


def encode_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch, ids, begins in encoded(batches, path, 1):
            lists = [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in lists], pa.string())], [id_col, "ids", "decoded"])

    return map_arrow(df.select(F.col(id_col), F.col(text_col)), run, f"{id_col} long, ids array<int>, decoded string")


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: number of tokens, digest of the ids, digest of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch, ids, begins in encoded(batches, path, 1):
            counts, digests, decoded = [], [], []
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
                own = ids[a:b].tolist()
                counts.append(len(own))
                digests.append(hashlib.sha256(b",".join(map(bpe.decimal.__getitem__, own))).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(df.select(F.col(id_col), F.col(text_col)), run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
