"""Improved consistent weighted sampling: the kernel that fingerprints and near-dedup share.

For a term of weight S and each of k samples, with r, c ~ Gamma(2, 1) and b ~ U(0, 1) fixed by the term
and the sample: t = floor(ln S / r + b), ln a = ln c - r (t - b + 1). The term with the least a is the
sample, and two weighted sets agree in (term, t) with a probability equal to their generalised Jaccard
similarity.

Every draw is made anew from (term hash, sample) by a counter-like mix of 32 bits, so no two terms or
samples share draws, however many terms a set has; a gamma draw is minus the log of two uniform ones.
Arrays have a row a sample, so that all steps run along contiguous terms.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np
import xxhash

#: Terms that are drawn at once: the arrays of one step stay in a core's cache.
STEP = 384
_EXPONENT, _LESS = np.uint32(0x3F800000), np.float32(1 - 2**-24)
#: Odd factors of the mix, one for each of the five uniform draws.
_MIX = [np.uint32(x) for x in (0x7FEB352D, 0x846CA68B, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]


class Sampler:
    def __init__(self, k: int, seed: int = 20_240_229) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.k = k
        self.low, self.high = (rng.integers(0, 1 << 31, (k, 1), np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
        self.every = np.arange(k)

    @functools.cached_property
    def space(self) -> list[np.ndarray]:
        return [np.empty(self.k * STEP, np.uint32) for _ in range(2)] + [np.empty(self.k * STEP, np.float32) for _ in range(4)]

    def draws(self, terms: np.ndarray, ln_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln a and t, (k, terms) float32 each, of at most STEP terms; the arrays are used again by the next call."""
        n = len(terms)
        h, x, r, c, u, t = (a[: self.k * n].reshape(self.k, n) for a in self.space)
        np.multiply(terms.astype(np.uint32), self.low, out=h)
        np.multiply((terms >> np.uint64(32)).astype(np.uint32), self.high, out=x)
        h += x

        def uniform(k: int, out: np.ndarray) -> np.ndarray:
            np.right_shift(h, np.uint32(16), out=x)
            np.bitwise_xor(h, x, out=h)
            np.multiply(h, _MIX[k], out=h)
            np.right_shift(h, np.uint32(9), out=x)
            np.bitwise_or(x, _EXPONENT, out=x)  # a float of [1, 2)
            return np.subtract(x.view(np.float32), _LESS, out=out)

        uniform(0, r)
        r *= uniform(1, u)
        np.log(r, out=r)  # -r
        uniform(2, c)
        c *= uniform(3, u)
        np.log(c, out=c)
        np.negative(c, out=c)
        np.log(c, out=c)
        uniform(4, u)
        np.divide(-ln_weight.astype(np.float32), r, out=t)
        t += u
        np.floor(t, out=t)
        np.subtract(t, u, out=u)
        u += np.float32(1)
        u *= r
        c += u
        return c, t

    def samples(self, terms: np.ndarray, ln_weight: np.ndarray) -> np.ndarray:
        """(terms, k) uint64: bits that sort as ln a in the upper half, the name of (term, t) in the lower."""
        out = np.empty((len(terms), self.k), np.uint64)
        for lo in range(0, len(terms), STEP):
            part = terms[lo : lo + STEP]
            ln_a, t = self.draws(part, ln_weight[lo : lo + STEP])
            bits = ln_a.view(np.uint32)
            bits = bits ^ ((bits.view(np.int32) >> np.int32(31)).view(np.uint32) | np.uint32(1 << 31))
            packed = bits.astype(np.uint64)
            packed <<= np.uint64(32)
            packed |= _names(part, t)
            out[lo : lo + STEP] = packed.T
        return out

    def signatures(self, bags: Iterable[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """uint32 sample names of each weighted set (terms, ln weights); zeros for an empty one.

        Terms of several sets are drawn together, so small sets cost no more a term than large ones.
        """
        bags = list(bags)
        least = np.full((len(bags), self.k), np.inf, np.float32)
        names = np.zeros((len(bags), self.k), np.uint32)
        ends = np.cumsum([len(t) for t, _ in bags])
        if not len(ends) or not ends[-1]:
            return list(names)
        terms, weight = np.concatenate([t for t, _ in bags]), np.concatenate([w for _, w in bags])
        starts = ends - [len(t) for t, _ in bags]
        for lo in range(0, len(terms), STEP):
            part = terms[lo : lo + STEP]
            ln_a, t = self.draws(part, weight[lo : lo + STEP])
            for g in range(int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(starts, lo + len(part), "left"))):
                a, b = max(int(starts[g]) - lo, 0), min(int(ends[g]) - lo, len(part))
                if a >= b:
                    continue
                at = ln_a[:, a:b].argmin(axis=1) + a
                value = ln_a[self.every, at]
                better = value < least[g]
                least[g][better] = value[better]
                names[g][better] = np.maximum(_names(part[at], t[self.every, at]), np.uint32(1))[better]
        return list(names)


def _names(terms: np.ndarray, t: np.ndarray) -> np.ndarray:
    """32-bit names of pairs of a term and its t."""
    return (terms >> np.uint64(20)).astype(np.uint32) ^ t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)


def named(packed: np.ndarray) -> np.ndarray:
    """Names of the least samples; zero stands for an empty set only."""
    return np.maximum(packed.astype(np.uint32), 1)


@functools.lru_cache(maxsize=300_000)
def term_hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"))
