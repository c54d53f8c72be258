"""Hashes of all words of a text at once, which fingerprints and near-dedup share."""

from __future__ import annotations

import functools
import re

import numpy as np

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_ODD = re.compile(r"[^\x00-\x7f\w]+")
#: Factor of the words' polynomial hash, odd, and its inverse modulo 2**64.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full((2, n), 1, np.uint64)
    out[0, 1:], out[1, 1:] = _FACTOR, _INVERSE
    return tuple(np.cumprod(out, axis=1))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words (``\\w+`` of the folded text), in order, made for all words at once."""
    return hashed_words(text)[0]


def hashed_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, and the words' lengths in characters.

    A running sum of bytes times powers of an odd factor gives each word's polynomial as a difference,
    brought to the same place by the inverse power.
    """
    text = text.casefold()
    if len(text) > 1_000_000:  # in parts that white space separates, so the powers stay few
        words = text.split()
        parts = [_hashed(" ".join(words[k : k + 50_000])) for k in range(0, max(1, len(words)), 50_000)]
        return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])
    return _hashed(text)


def _hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    if not text.isascii():
        text = _ODD.sub(" ", text)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    edges = np.diff(np.concatenate([[False], _WORD[b], [False]]).view(np.int8))
    first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    h = _polynomials(b, first, end)
    inner = np.concatenate([[0], np.cumsum((b & 0xC0) == 0x80)])  # bytes that continue a character
    return h, end - first - (inner[end] - inner[first])


def _polynomials(b: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _powers(1 << max(16, len(b).bit_length()))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    h = (sums[end] - sums[first]) * down[first]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def token_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words given, which hold no blanks, in folded form."""
    parts = [np.zeros(0, np.uint64)]
    for k in range(0, len(words), 50_000):
        b = np.frombuffer(" ".join(words[k : k + 50_000]).casefold().encode("utf-8", "surrogatepass"), np.uint8)
        blanks = np.flatnonzero(b == 32)
        parts.append(_polynomials(b, np.concatenate([[0], blanks + 1]), np.append(blanks, len(b))))
    return np.concatenate(parts)
