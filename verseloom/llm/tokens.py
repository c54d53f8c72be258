"""Token counts by offset-mapped attribution (operator 4), and a fast encoder for whole documents.

Each document is encoded once, as a whole. Every token's character span follows from the bytes of the
tokens before it; spans are joined to the document's sections by interval (both are sorted, so the join
is a binary search), and a token that crosses a border goes to one section by an explicit rule:

* ``start``: the section of its first character;
* ``end``: the section of its last character;
* ``most``: the section with most of its characters, the earlier of equals.

A token that holds part of a character counts as holding all of it, so each token has a span; counts of
a document's sections sum to its tokens. Sections are given by a splitter of texts into ends; the
default ends a section after each line feed, fields can be joined to one text with their ends.

Null texts count as empty: one empty section without tokens. Texts are encoded whole, whatever their
length. Repeated rows give equal rows; an empty table gives an empty result. Only the two columns
named are read, so extra columns don't clash.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.llm.bpe import Bpe, load
from verseloom.llm.shared import map_arrow, rows

#: The byte-level tokenizer's word pattern. Fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "end", "most")
#: Half of the least run of white space or of other characters that the library's backtracking pattern is spared.
HALF_RUN = 5_000


def _has_long_run(text: str) -> bool:
    """Whether an aligned window of HALF_RUN characters is all white space, or one word: every run of twice that fills one."""
    return any((part := text[k : k + HALF_RUN]).isspace() or len(part.split(None, 1)) == 1 for k in range(0, len(text) - HALF_RUN + 1, HALF_RUN))


class Encoder:
    """Ids of a vocabulary file by a library encoder; a special token's string gives its id.

    The library's pattern runs out of stack on a million blanks, so texts with long runs go through
    the encoder of ``bpe``, which gives the same ids.
    """

    def __init__(self, path: str) -> None:
        self.bpe: Bpe = load(path)
        special = set(self.bpe.special.values())
        ranks = {b: k for k, b in enumerate(self.bpe.bytes_of) if k not in special}
        self.library = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if _has_long_run(text):
            return self.bpe.merge(self.bpe.words(text))[0]
        if self.bpe.split is None or not self.bpe.split.search(text):
            return self.library.encode_to_numpy(text).astype(np.int32)
        parts = self.bpe.split.split(text)
        return np.concatenate([np.array([self.bpe.special[p]], np.int32) if k % 2 else self.library.encode_to_numpy(p).astype(np.int32) for k, p in enumerate(parts)])


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def spans(bpe: Bpe, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one-after character of each token."""
    upto = np.cumsum(bpe.leads[ids])
    return upto - bpe.leads[ids] - bpe.inner[ids], upto


def attribute(start: np.ndarray, end: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Section of each token; ``ends`` are the sections' ends, in order, the last one the text's."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    first = np.searchsorted(ends, start, "right")
    last = np.searchsorted(ends, np.maximum(end - 1, start), "right")
    if rule == "start":
        return np.minimum(first, len(ends) - 1)
    if rule == "end":
        return np.minimum(last, len(ends) - 1)
    found = first.copy()
    for k in np.flatnonzero(last > first):
        cuts = np.clip(np.concatenate([[start[k]], ends[first[k] : last[k]], [end[k]]]), start[k], end[k])
        found[k] = first[k] + int(np.diff(cuts).argmax())
    return np.minimum(found, len(ends) - 1)


def line_ends(text: str) -> list[int]:
    """Sections are lines with their line feeds."""
    ends = [m.end() for m in re.finditer("\n", text)]
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def section_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "start", sections: Callable[[str], list[int]] = line_ends) -> DataFrame:
    """(id, section, char_start, char_end, n_tokens, crossing): tokens of each section, and how many of them reach over its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for ids, texts in rows(batches, 256):
            cols: list[list] = [[] for _ in range(6)]
            for i, text in zip(ids, texts):
                text = text or ""
                ends = np.array(sections(text), np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                start, end = spans(code.bpe, code.ids(text))
                owner = attribute(start, end, ends, rule)
                counts = np.bincount(owner, minlength=len(ends))
                over = np.bincount(owner, weights=(start < begins[owner]) | (end > ends[owner]), minlength=len(ends)) if len(owner) else np.zeros(len(ends))
                for col, v in zip(cols, ([i] * len(ends), range(len(ends)), begins.tolist(), ends.tolist(), counts.tolist(), over.astype(int).tolist())):
                    col.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), *[pa.int64()] * 4))], [id_col, "section", "char_start", "char_end", "n_tokens", "crossing"])

    return map_arrow(df.select(F.col(id_col), F.col(text_col)), run, f"{id_col} long, section int, char_start long, char_end long, n_tokens long, crossing long")
