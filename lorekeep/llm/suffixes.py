"""Suffix array of one shard in numpy, and its common prefixes.

A shard is a list of byte segments.  Suffixes end with their segment, so nothing matches across two.
"""

from __future__ import annotations

import numpy as np

WORD = 8


class Shard:
    """The bytes of a shard, each position's distance to its segment's end, and 8-byte words at each position."""

    def __init__(self, segments: list[bytes]):
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        self.first = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(segments)), sizes)
        data = np.frombuffer(b"".join(segments), np.uint8)
        self.size = len(data)
        self.rest = (np.repeat(self.first + sizes, sizes) - np.arange(self.size)).astype(np.int32)
        padded = np.concatenate((data, np.zeros(WORD, np.uint8)))
        words = np.zeros(self.size, np.uint64)
        for k in range(WORD):  # big-endian, zero behind the segment's end
            byte = np.where(self.rest > k, padded[k : k + self.size], 0).astype(np.uint64)
            words |= byte << np.uint64(8 * (WORD - 1 - k))
        self.words = words


def suffix_order(shard: Shard, depth: int) -> np.ndarray:
    """All suffixes sorted by at least their first ``depth`` bytes, by Larsson-Sadakane refinement.

    The first sort is by 8 bytes.  Each round then doubles the sorted length: a suffix is ranked by its
    own rank and the rank of the suffix ``sorted length`` further on, and only groups that still hold
    several suffixes are touched.
    """
    order = np.argsort(shard.words)
    keys = shard.words[order]
    head = np.concatenate(([True], keys[1:] != keys[:-1]))
    slots = np.arange(shard.size)
    heads = np.maximum.accumulate(np.where(head, slots, 0))
    rank = np.empty(shard.size, np.int64)
    rank[order] = heads
    length = WORD
    open_slots = slots
    while length < depth:
        # slots of groups with more than one suffix
        group = rank[order[open_slots]]
        alone = np.ones(len(group), bool)
        alone[1:] &= group[1:] != group[:-1]
        alone[:-1] &= group[1:] != group[:-1]
        open_slots = open_slots[~alone]
        if not len(open_slots):
            break
        suffix = order[open_slots]
        further = np.minimum(suffix + length, shard.size - 1)
        second = np.where(shard.rest[suffix] > length, rank[further] + 1, 0)
        key = (rank[suffix].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[open_slots] = suffix
        head = np.concatenate(([True], key[1:] != key[:-1]))
        rank[suffix] = np.maximum.accumulate(np.where(head, open_slots, 0))
        length *= 2
    return order


def common_prefixes(shard: Shard, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix, at most ``limit``, of each suffix in ``order`` with the one before it (Kasai).

    ``order`` may list only the suffixes of interest.  Kasai's argument carries the common prefix, less
    one, from a position to the next one; here every segment is a lane of its own and all lanes advance
    together, comparing eight bytes at a time.
    """
    prefix = np.zeros(len(order), np.int32)
    if not len(order):
        return prefix
    slot = np.full(shard.size, -1, np.int64)
    slot[order] = np.arange(len(order))
    wanted = np.flatnonzero(slot >= 0)
    # lanes: maximal runs of consecutive wanted positions inside a segment
    start = np.concatenate(([True], (np.diff(wanted) > 1) | (np.diff(shard.owner[wanted]) > 0)))
    lane_first = wanted[start]
    lane_size = np.diff(np.concatenate((np.flatnonzero(start), [len(wanted)])))
    by_size = np.argsort(-lane_size)
    lane_first, lane_size = lane_first[by_size], lane_size[by_size]
    carried = np.zeros(len(lane_first), np.int64)
    step = 0
    lanes = len(lane_first)
    while lanes:
        lanes = int(np.searchsorted(-lane_size, -step, "left"))
        if not lanes:
            break
        here = lane_first[:lanes] + step
        before = order[np.maximum(slot[here] - 1, 0)]
        ok = slot[here] > 0
        most = np.where(ok, np.minimum(np.minimum(shard.rest[here], shard.rest[before]), limit), 0).astype(np.int64)
        length = np.minimum(carried[:lanes], most)
        going = np.flatnonzero(length < most)
        while len(going):
            at = length[going]
            differ = shard.words[here[going] + at] ^ shard.words[before[going] + at]
            same = differ == 0
            stop = np.flatnonzero(~same)
            if len(stop):
                # leading zero bytes of the difference
                d = differ[stop]
                zeros = np.zeros(len(stop), np.int64)
                for k in range(1, WORD):
                    zeros += d < (np.uint64(1) << np.uint64(8 * (WORD - k)))
                length[going[stop]] = at[stop] + zeros
            more = going[same]
            length[more] += WORD
            going = more[length[more] < most[more]]
        length = np.minimum(length, most)
        prefix[slot[here]] = length
        # the bound holds only if the neighbour's next position is listed too, and before this one's:
        # suffixes equal up to the sorted depth may stand in any order
        follows, onward = np.minimum(before + 1, shard.size - 1), np.minimum(here + 1, shard.size - 1)
        kept = ok & (slot[follows] >= 0) & (shard.rest[before] > 1) & (slot[follows] < slot[onward])
        carried[:lanes] = np.where(kept, np.maximum(length - 1, 0), 0)
        step += 1
    return prefix
