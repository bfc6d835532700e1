"""Words of many texts at once, as numpy arrays of 64-bit hashes.

A word is a maximal run of digits, ASCII letters (A-Z read as a-z) and
characters from U+0080 on, that is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of
the text with A-Z lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tarnlake.llm.shared import splitmix

_SALT = splitmix(np.arange(0x110000, dtype=np.uint64))
_IS_WORD = np.ones(0x110000, dtype=bool)
_IS_WORD[:0x30] = False
_IS_WORD[0x3A:0x61] = False
_IS_WORD[0x7B:0x80] = False
_LOWER = np.arange(0x110000, dtype=np.uint32)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_KEPT = 1 << 20  #: powers that are kept for the next batch
_pow = {_BASE: np.ones(1, dtype=np.uint64), _INVERSE: np.ones(1, dtype=np.uint64)}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_pow[base]) >= n:
        return _pow[base]
    steps = np.full(max(n, min(_KEPT, 2 * len(_pow[base]))), base, dtype=np.uint64)
    steps[0] = 1
    with np.errstate(over="ignore"):
        np.cumprod(steps, dtype=np.uint64, out=steps)
    if len(steps) <= _KEPT:
        _pow[base] = steps
    return steps


@dataclass
class Words:
    """Words of a batch: where they lie in ``codes`` and which belong to which text."""

    codes: np.ndarray  #: lower-cased code points of all texts, one separator after each
    starts: np.ndarray  #: of each word, in codes
    ends: np.ndarray
    bounds: np.ndarray  #: text i has the words bounds[i]:bounds[i + 1]
    hashes: np.ndarray
    sums: np.ndarray  #: of the code points before each place, salted, times powers of the base

    def prefix_hashes(self, length: int) -> np.ndarray:
        """Hashes of the first ``length`` characters (or all) of each word."""
        return _hash_spans(self.sums, self.starts, np.minimum(self.ends, self.starts + length))


def _sums(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.multiply(_SALT[codes], _powers(_BASE, len(codes))[: len(codes)], out=out[1:])
        np.cumsum(out, out=out)
    return out


def _hash_spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A span's code points times powers from its start on: modulo 2**64 the odd base has an inverse, which shifts the sums there."""
    with np.errstate(over="ignore"):
        return splitmix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))


def code_points(texts: list[str], sep: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by ``sep``; and where each text starts."""
    joined = sep.join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    return codes, np.concatenate([[0], np.cumsum(lengths)])


def split(texts: list[str]) -> Words:
    codes, offsets = code_points(texts)
    codes = _LOWER[codes]
    mask = np.zeros(len(codes) + 2, dtype=np.int8)
    mask[1:-1] = _IS_WORD[codes]
    edge = np.diff(mask)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = _sums(codes)
    return Words(codes, starts, ends, np.searchsorted(starts, offsets), _hash_spans(sums, starts, ends), sums)
