"""Words of many texts at once, as 64-bit fingerprints in flat arrays.

A word's fingerprint is a polynomial in its bytes, taken from running sums and
mixed, so that a batch costs a few passes over its bytes and no loop. Two given
different words have equal fingerprints with a chance of about 2^-64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 1 << 64)

_bytes = np.arange(256)
# Lower case for A-Z alone, bytewise; UTF-8 bytes of other characters stay.
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
# Everything but space and \t \n \v \f \r.
NOT_BLANK = ~np.isin(_bytes, [32, 9, 10, 11, 12, 13])
# Digits, lower-case a-z and every byte of a character beyond ASCII.
ALNUM = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


# Powers up to this one are kept.
_KEPT = 1 << 20


def _made_powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p)


@lru_cache(maxsize=8)
def _kept_powers(base: int) -> np.ndarray:
    return _made_powers(_KEPT, base)


def _powers(n: int, base: int) -> np.ndarray:
    return _kept_powers(base) if n <= _KEPT else _made_powers(n, base)


def fingerprints(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Of the byte ranges ``starts`` to ``ends`` of ``raw``."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(n, base)[:n], out=sums[1:])
    inverse = _INVERSE if base == _BASE else pow(base, -1, 1 << 64)
    return mix((sums[ends] - sums[starts]) * _powers(n, inverse)[starts])


def spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of maximal runs of ``inside`` bytes, never across two texts, and the first word of each text.

    -> starts, ends, at: words at[i] to at[i + 1] belong to text i.
    """
    member = inside[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], member[:-1])) if len(raw) else member
    after = np.concatenate((member[1:], [False])) if len(raw) else member
    starts = np.flatnonzero(member & (~before | edge[:-1]))
    ends = np.flatnonzero(member & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True):
    """Fingerprints of the words of texts, and the first word of each text."""
    if lower:
        raw = LOWER[raw]
    starts, ends, at = spans(raw, offsets, inside)
    return fingerprints(raw, starts, ends), at


def windows(w: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of every ``size`` words in a row, also of those across two texts."""
    if len(w) < size:
        return np.zeros(0, np.uint64)
    n = len(w) - size + 1
    h = w[:n].copy()
    for k in range(1, size):
        h *= _STEP
        h += w[k : k + n]
    return mix(h + np.uint64(size))


def whole(w: np.ndarray) -> int:
    """Fingerprint of a short sequence, equal to that of a window of the same words."""
    return int(windows(w, len(w))[0])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
