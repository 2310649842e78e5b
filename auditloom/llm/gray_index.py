"""Codes within a Hamming distance, by a hierarchy over their Gray order."""

from __future__ import annotations

import numpy as np

FANOUT = 8
FRONTIER = 1 << 20
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray sequence, where neighbours differ in one bit."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayIndex:
    """Codes in Gray order under nodes that hold what their members share.

    A node stores the bits all its codes agree on (``mask``) and their values
    (``pattern``). A parent's mask lies within its children's, so the differences
    to a query add up on the way down: a child counts only the bits it adds, and
    a whole group is dropped once the sum passes the radius.
    """

    def __init__(self, codes: np.ndarray, fanout: int = FANOUT):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes, self.fanout = codes[self.order], fanout
        patterns, masks = [self.codes], [np.full(len(codes), ONES)]
        while len(patterns[-1]) > fanout:
            at = np.arange(0, len(patterns[-1]), fanout)
            every = np.bitwise_and.reduceat(patterns[-1], at)
            some = np.bitwise_or.reduceat(patterns[-1], at)
            mask = np.bitwise_and.reduceat(masks[-1], at) & ~(every ^ some)
            masks.append(mask)
            patterns.append(every & mask)
        self.levels = list(zip(patterns, masks, strict=True))[::-1]

    def pairs(self, queries: np.ndarray, radius: int):
        """Yield ``(query numbers, places in Gray order)`` of all codes within ``radius``."""
        top = len(self.levels[0][0])
        step = max(1, FRONTIER // (top * self.fanout))
        for start in range(0, len(queries), step):
            part = queries[start:start + step]
            who, node = np.repeat(np.arange(len(part)), top), np.tile(np.arange(top), len(part))
            spent, seen = np.zeros(len(who), np.int64), np.zeros(len(who), np.uint64)
            for depth, (patterns, masks) in enumerate(self.levels):
                if depth:
                    who, spent, seen = (np.repeat(x, self.fanout) for x in (who, spent, seen))
                    node = (node[:, None] * self.fanout + np.arange(self.fanout)).reshape(-1)
                    real = node < len(patterns)
                    who, node, spent, seen = who[real], node[real], spent[real], seen[real]
                mask = masks[node]
                spent = spent + np.bitwise_count((part[who] ^ patterns[node]) & mask & ~seen)
                near = spent <= radius
                who, node, spent, seen = who[near], node[near], spent[near], mask[near]
            yield who + start, node


def least_linked(codes: np.ndarray, radius: int) -> np.ndarray:
    """For each code the number of the least code it reaches by steps within ``radius``."""
    index = GrayIndex(codes)
    label = np.arange(len(codes))
    links = []
    for who, place in index.pairs(codes, radius):
        other = index.order[place]
        keep = who < other
        links.append(np.stack((who[keep], other[keep])))
    links = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
    while True:
        low = np.minimum(label[links[0]], label[links[1]])
        fresh = label.copy()
        for side in links:
            np.minimum.at(fresh, label[side], low)
        fresh = fresh[fresh]
        while not np.array_equal(fresh, fresh[fresh]):
            fresh = fresh[fresh]
        if np.array_equal(fresh, label):
            return label
        label = fresh[label]
