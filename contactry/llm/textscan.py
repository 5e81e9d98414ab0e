"""Vectorised scans of texts: hashes of k consecutive units, and anchors of windows.

A unit is a byte or a word, given as a 64-bit hash. The hash of k units is a difference of prefix sums of a
polynomial modulo 2^64, finished by a bijective mixer. An anchor of a window is the least k-unit hash in it:
equal windows have equal anchors, so windows that could match always meet under one key.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 16
#: Bits of a position in a block and the windows that reach beyond it.
_PLACE_BITS = 17
#: Windows in one segment at most: their verdicts fit the bits of a long.
RUN = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    out[1:] = base & (2**64 - 1)
    return np.multiply.accumulate(out)


_POW = _geometric(_BASE, _BLOCK + 512)
_INV = _geometric(pow(_BASE, -1, 2**64), _BLOCK + 512)
BYTE_HASH = mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))


def rolling(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive units; at most _BLOCK + 511 of them in one call."""
    n = len(units) - k + 1
    sums = np.zeros(len(units) + 1, _U)
    np.cumsum(units * _POW[: len(units)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * _INV[:n])


def rolling_all(units: np.ndarray, k: int) -> np.ndarray:
    """``rolling`` for any length."""
    n = len(units) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    return np.concatenate([rolling(units[b : min(b + _BLOCK, n) + k - 1], k) for b in range(0, n, _BLOCK)])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    done, m = 1, h
    while done * 2 <= w:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    if done < w:
        m = np.minimum(m[: len(m) - (w - done)], m[w - done :])
    return m


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the least value in every window of ``w`` values, by their high bits; of equal ones the leftmost.

    The low bits give way to the position, so one minimum tells both. In equal windows the same place is taken.
    """
    low = _U((1 << _PLACE_BITS) - 1)
    return (sliding_min((h & ~low) | np.arange(len(h), dtype=_U), w) & low).astype(np.int64)


def runs(units: np.ndarray, window: int, k: int, by_place: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split all windows into runs of neighbours with the same anchor: anchor, first window, number of windows.

    Each window is in exactly one run; a run has at most RUN windows. With ``by_place``, a run also ends where the
    anchor's leftmost place in the window changes: equal windows then never share a run, however short the period of the
    text. Works block by block in bounded memory.
    """
    total = len(units) - window + 1
    keys, firsts, counts = [], [], []
    for b in range(0, max(total, 0), _BLOCK):
        n = min(_BLOCK, total - b)
        hashes = rolling(units[b : b + n + window - 1], k)
        if by_place:
            place = sliding_argmin(hashes, window - k + 1)
            least = hashes[place]
        else:
            place = least = sliding_min(hashes, window - k + 1)
        at = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        size = np.diff(np.append(at, n))
        if size.max() > RUN:
            parts = -(-size // RUN)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            left = np.repeat(size, parts) - nth * RUN
            at, size = np.repeat(at, parts) + nth * RUN, np.minimum(left, RUN)
        keys.append(mix(least[at] + _U(0x632BE59BD9B4E019)))
        firsts.append(at + b)
        counts.append(size)
    if not keys:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(counts)


def byte_units(text: bytes) -> np.ndarray:
    return BYTE_HASH[np.frombuffer(text, np.uint8)]


def word_spans(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words joined by single spaces."""
    if not joined:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.append(gaps, len(joined))


def word_units(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of words joined by single spaces."""
    starts, ends = word_spans(joined)
    out = np.empty(len(starts), _U)
    codes = byte_units(joined)
    low = 0
    while low < len(starts):
        base = starts[low]
        high = int(np.searchsorted(ends, base + _BLOCK, "right"))
        if high <= low:  # a word longer than a block: fold its blocks
            value = 0
            for b in range(int(base), int(ends[low]), _BLOCK):
                part = codes[b : min(b + _BLOCK, int(ends[low]))]
                value = (value * _BASE + int(rolling(part, len(part))[0])) & (2**64 - 1)
            out[low] = value
            low += 1
            continue
        part = codes[base : ends[high - 1]]
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(part * _POW[: len(part)], out=sums[1:])
        s, e = starts[low:high] - base, ends[low:high] - base
        out[low:high] = mix((sums[e] - sums[s]) * _INV[s] + (e - s).astype(_U))
        low = high
    return out, starts, ends
