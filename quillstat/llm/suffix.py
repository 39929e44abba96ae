"""Repeats inside groups of text segments: enhanced suffix array and common-prefix interval tree.

``repeat_groups`` takes segments and gives the maximal repeats of ``least`` bytes
or more among their window starts, each with its length and all occurrences.
Suffixes that share no ``least`` bytes with another are left out first, by a
fingerprint that is then checked byte by byte.  A class of equal ``least``-byte
prefixes in which every occurrence has the same byte before it lies inside the
class one byte further left, so only left-diverse classes are kept.  Their
suffixes are sorted, the common prefixes of neighbours are measured, and a
stack scan walks the tree of common-prefix intervals; an interval whose
occurrences can't all be extended to the left is a maximal repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from .anchors import _tables, mixed


class Repeat(NamedTuple):
    """``length`` bytes that start at each of ``places`` (segment, offset)."""

    length: int
    places: list[tuple[int, int]]


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the tree's intervals, for sorted suffixes whose neighbours share ``common[i]`` bytes."""
    stack = [(0, 0)]
    for i, c in enumerate([*common, 0]):
        first = i
        while stack[-1][0] > c:
            length, first = stack.pop()
            yield length, first, i
        if stack[-1][0] < c:
            stack.append((c, first))


def _windows(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, least: int):
    """Segment, offset, position and fingerprint of every window start."""
    seg = np.repeat(np.arange(len(starts)), counts)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(starts, counts) + offset
    ups, downs = _tables(1 << 22) if len(data) <= 1 << 22 else _tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * ups[:len(data)], out=sums[1:])
    return seg, offset, at, mixed((sums[at + least] - sums[at]) * downs[at])


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    out = np.ones(len(a), bool)
    span = np.arange(length)
    for i in range(0, len(a), 1 << 15):
        part = slice(i, i + (1 << 15))
        out[part] = (data[a[part, None] + span] == data[b[part, None] + span]).all(axis=1)
    return out


def _classes(data: np.ndarray, at: np.ndarray, print_: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Window indices in classes of equal bytes, and where each class starts; classes of one are left out."""
    order = np.argsort(print_, kind="stable")
    new = np.concatenate(([True], print_[order][1:] != print_[order][:-1])) if len(order) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    size = np.bincount(number) if len(order) else np.zeros(0, int)
    keep = size[number] > 1 if len(order) else np.zeros(0, bool)
    order, number = order[keep], number[keep]
    if not len(order):
        return order, np.zeros(0, np.int64)
    lead = np.searchsorted(number, number)
    equal = _same(data, at[order], at[order[lead]], least)
    if not equal.all():  # unequal bytes under one fingerprint: class by the bytes
        by = [bytes(data[p:p + least]) for p in at[order]]
        order = order[sorted(range(len(order)), key=by.__getitem__)]
        by.sort()
        number = np.cumsum([True] + [x != y for x, y in zip(by[1:], by)]) - 1
        keep = np.bincount(number)[number] > 1
        order, number = order[keep], number[keep]
    return order, np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(order) else np.zeros(0, np.int64)


def _common(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at ``a`` and ``b`` share, ``most`` at most."""
    out = np.zeros(len(a), np.int64)
    for i in range(0, len(a), 1 << 14):
        part = slice(i, i + (1 << 14))
        span = np.arange(int(most[part].max()) + 1)
        last = len(data) - 1
        unlike = data[np.minimum(a[part, None] + span, last)] != data[np.minimum(b[part, None] + span, last)]
        unlike |= span >= most[part, None]
        out[part] = unlike.argmax(axis=1)
    return out


def repeat_groups(segments: list[bytes], counts: list[int], least: int) -> Iterator[Repeat]:
    """Maximal repeats among the windows that start at the first ``counts[i]`` offsets of ``segments[i]``."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    starts = np.cumsum(sizes) - sizes
    seg, offset, at, print_ = _windows(data, starts, np.array(counts, np.int64), least)
    order, heads = _classes(data, at, print_, least)
    if not len(order):
        return
    before = np.where(offset[order] > 0, data[at[order] - 1].astype(np.int64), -1 - np.arange(len(order)))
    diverse = np.minimum.reduceat(before, heads) != np.maximum.reduceat(before, heads)
    size = np.diff(np.concatenate((heads, [len(order)])))
    left = (starts + sizes)[seg] - at  # bytes to the segment's end
    chosen: list[np.ndarray] = []
    buffer = data.tobytes()
    for head, n in zip(heads[diverse], size[diverse]):
        w = order[head:head + n]
        if n > 2:
            w = w[sorted(range(n), key=lambda i: buffer[at[w[i]]:at[w[i]] + left[w[i]]])]
        chosen.append(w)
    if not chosen:
        return
    flat = np.concatenate(chosen)
    common = _common(data, at[flat[:-1]], at[flat[1:]], np.minimum(left[flat[:-1]], left[flat[1:]])).tolist()
    seg_of, offset_of = seg[flat].tolist(), offset[flat].tolist()
    mark = np.where(offset[flat] > 0, data[at[flat] - 1].astype(np.int64), -1 - np.arange(len(flat))).tolist()
    i = 0
    for w in chosen:
        for length, a, b in intervals(common[i:i + len(w) - 1]):
            if length >= least and len(set(mark[i + a:i + b + 1])) > 1:
                yield Repeat(length, list(zip(seg_of[i + a:i + b + 1], offset_of[i + a:i + b + 1])))
        i += len(w)
