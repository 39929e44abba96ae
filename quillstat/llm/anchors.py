"""Content-defined anchors of all windows of a text, in numpy.

Every window of ``least`` bytes has one anchor: the leftmost of its ``GRAM``-byte
strings with the smallest hash.  The anchor depends on the window's bytes alone,
so equal windows have equal anchor strings at equal places.  Neighbouring
windows share an anchor most of the time; such a run of windows is one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

GRAM = 32
#: Bytes handled at a time; positions fit in POSITION_BITS.
CHUNK, POSITION_BITS = 1 << 20, 21
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


class Runs(NamedTuple):
    """Runs of windows with one anchor: text, first window, number of windows, anchor's place, hashes of anchor and run."""

    text: np.ndarray
    first: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    h: np.ndarray
    run: np.ndarray


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _POW:
        _POW.clear()
        _POW[n] = (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
    return _POW[n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


def _smallest(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring keys: running minima from both sides of fixed blocks."""
    n = len(key)
    pad = -n % width
    blocks = np.concatenate([key, np.full(pad, _MASK, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def _chunk_runs(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int):
    """Runs of the windows that lie inside one of the texts ``starts[i]:ends[i]`` of the bytes ``b``."""
    n = len(b)
    ups, downs = _tables(CHUNK + least)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * ups[:n], out=sums[1:])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * downs[:n - GRAM + 1])
    low = np.uint64((1 << POSITION_BITS) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    owner = (_smallest(key, least - GRAM + 1) & low).astype(np.int64)  # anchor of the window that starts here
    sizes = np.maximum(0, ends - starts - least + 1)
    text = np.repeat(np.arange(len(starts)), sizes)
    s = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    if not len(s):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    own = owner[s]
    cut = np.flatnonzero((own[1:] != own[:-1]) | (text[1:] != text[:-1])) + 1
    at = np.concatenate(([0], cut))
    count = np.diff(np.concatenate((at, [len(s)])))
    first, anchor = s[at], own[at]
    end = first + count - 1 + least
    run = mixed((sums[end] - sums[first]) * downs[first] + count.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return text[at], first, count, anchor, grams[anchor], run


def runs(data: np.ndarray, offsets: np.ndarray, least: int) -> Iterator[Runs]:
    """Runs of all texts ``data[offsets[i]:offsets[i + 1]]``, chunk by chunk; no window is left out or met twice."""
    i, count = 0, len(offsets) - 1
    while i < count:
        j = i
        while j < count and offsets[j + 1] - offsets[i] <= CHUNK:
            j += 1
        if j > i:
            base = offsets[i]
            b = data[base:offsets[j]]
            if len(b) >= least:
                t, f, n, a, h, r = _chunk_runs(b, offsets[i:j] - base, offsets[i + 1:j + 1] - base, least)
                yield Runs(t + i, f - (offsets[i:j] - base)[t], n, a - (offsets[i:j] - base)[t], h, r)
            i = j
            continue
        at = 0  # one text longer than a chunk
        length = int(offsets[i + 1] - offsets[i])
        while at + least <= length:
            b = data[offsets[i] + at:offsets[i] + min(length, at + CHUNK)]
            t, f, n, a, h, r = _chunk_runs(b, np.array([0]), np.array([len(b)]), least)
            yield Runs(t + i, f + at, n, a + at, h, r)
            at += CHUNK - least + 1
        i += 1
