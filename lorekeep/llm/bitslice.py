"""Hamming distances of 64-bit fingerprints, bit-sliced.

Fingerprints are stored as 64 vertical bit planes.  One 64-bit word of a plane holds one bit of 64
fingerprints, so an exclusive-or and a ripple of carry-save counters update 64 distances at a time.
Lanes whose counter passes the radius are dead, and words with no live lane are abandoned.
"""

from __future__ import annotations

import numpy as np

CHECK_EVERY = 5
"""Planes between two looks for words that can be abandoned."""


def planes(values: np.ndarray) -> np.ndarray:
    """(64, words) of uint64; bit ``i % 64`` of word ``i // 64`` in plane ``k`` is bit ``k`` of value ``i``."""
    words = (len(values) + 63) // 64 + 1
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def mask_words(flags: np.ndarray, words: int) -> np.ndarray:
    padded = np.zeros(words * 64, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8")


def _shifted(plane: np.ndarray, at: np.ndarray, by: int) -> np.ndarray:
    whole, rest = divmod(by, 64)
    last = len(plane) - 1
    low = plane[np.minimum(at + whole, last)]
    if not rest:
        return low
    return (low >> np.uint64(rest)) | (plane[np.minimum(at + whole + 1, last)] << np.uint64(64 - rest))


def near(left: np.ndarray, other, alive: np.ndarray, radius: int, order) -> np.ndarray:
    """Positions of the live lanes of ``left`` within ``radius`` of what ``other(plane, words)`` gives.

    ``order`` lists the planes to compare; planes known to be equal may be left out.
    """
    at = np.flatnonzero(alive)
    alive = alive[at]
    width = (radius + 1).bit_length()
    counters = [np.zeros(len(at), np.uint64) for _ in range(width)]
    for step, plane in enumerate(order):
        if not len(at):
            break
        carry = (left[plane][at] ^ other(plane, at)) & alive
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        past = alive.copy()
        for k in range(width):
            past &= counters[k] if (radius + 1) >> k & 1 else ~counters[k]
        alive = alive & ~past
        if step % CHECK_EVERY == CHECK_EVERY - 1:
            live = np.flatnonzero(alive)
            if len(live) < len(at):
                at, alive, counters = at[live], alive[live], [c[live] for c in counters]
    if not len(at):
        return np.empty(0, np.int64)
    lanes = np.unpackbits(alive.view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
    word, bit = np.nonzero(lanes)
    return np.sort(at[word] * 64 + bit)


def fold(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the groups of each pair: every label becomes the smallest position of its group."""
    while len(i):
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def link_buckets(values: np.ndarray, bucket: np.ndarray, radius: int, order) -> np.ndarray:
    """Group label of each value: values of one bucket within ``radius``, directly or by a chain, share one.

    Values of a bucket are adjacent; each is compared with its 1st, 2nd, ... follower until no bucket is
    long enough.  Memory is proportional to the number of values.
    """
    labels = np.arange(len(values))
    rows = np.arange(len(values))
    shift = 1
    packed = None
    while True:
        same = bucket[rows[:-shift]] == bucket[rows[shift:]] if len(rows) > shift else np.empty(0, bool)
        if not same.any():
            return labels
        ends = np.zeros(len(rows), bool)
        ends[: len(same)] |= same
        ends[shift:] |= same
        if packed is None or ends.sum() * 2 < len(rows):
            keep = np.isin(bucket[rows], np.unique(bucket[rows[: len(same)][same]]))
            if packed is None or not keep.all():
                rows = rows[keep]
                packed = planes(values[rows])
                same = bucket[rows[:-shift]] == bucket[rows[shift:]]
        found = near(
            packed, lambda p, at: _shifted(packed[p], at, shift), mask_words(same, packed.shape[1]), radius, order
        )
        fold(labels, rows[found], rows[found + shift])
        shift += 1


def link_across(left: np.ndarray, right: np.ndarray, radius: int, order) -> list[tuple[int, int]]:
    """A pair ``(i, j)`` for each ``left[i]`` and each new group of ``right`` it reaches within ``radius``.

    Groups already joined are not reported again, so there are fewer pairs than values.
    """
    labels = np.arange(len(left) + len(right))
    packed = planes(right)
    everyone = mask_words(np.ones(len(right), bool), packed.shape[1])
    pairs = []
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for i, value in enumerate(left.tolist()):
        constant = [full if value >> p & 1 else np.uint64(0) for p in range(64)]
        found = near(packed, lambda p, at: constant[p], everyone, radius, order)
        if len(found):
            heads = labels[len(left) + found]
            _, first = np.unique(heads, return_index=True)
            new = first[heads[first] != labels[i]]
            pairs += [(i, int(found[k])) for k in new]
            fold(labels, np.full(len(new), i), len(left) + found[new])
    return pairs
