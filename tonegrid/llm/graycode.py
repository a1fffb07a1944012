"""Pairs of fingerprints within a Hamming distance, by a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Children of a node.
FAN = 16
#: Fingerprints whose descent through the index is taken together.
QUERIES = 512


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """The rank, in the order of Gray codes, of each row of 64-bit words, most significant word first: the running parity of the bits."""
    out = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    odd = np.zeros(len(out), np.uint64)
    for word in range(out.shape[1]):
        out[:, word] ^= np.uint64(0) - odd  # a word after an odd number of ones is complemented
        odd = out[:, word] & np.uint64(1)
    return out


class GrayIndex:
    """Fingerprints sorted by Gray rank, so that neighbours differ in few bits. FAN neighbours share a node, which holds the bits that all
    of them have in common (a mask and a pattern), less those that the nodes above it already hold; and so on upwards, to a single root.

    On the way down, the differences between a query and the patterns add up; once they exceed the limit, the whole group below is left out.
    The entries at the bottom hold the bits that no node above has, so what arrives there has its exact distance.
    """

    def __init__(self, bits: np.ndarray):
        rank = gray_rank(bits)
        self.order = np.lexsort(rank.T[::-1])
        pattern, mask = bits[self.order], np.full_like(bits, ~np.uint64(0))
        self.bits = pattern
        levels = [(pattern, mask)]
        while len(pattern) > 1:
            starts = np.arange(0, len(pattern), FAN)
            first = np.repeat(pattern[starts], np.diff(np.append(starts, len(pattern))), axis=0)
            mask = ~np.bitwise_or.reduceat((pattern ^ first) | ~mask, starts, axis=0)
            pattern = pattern[starts]
            levels.append((pattern, mask))
        self.levels = []  # from the root down: the pattern, and the bits that are the node's own
        above = np.zeros_like(bits[:1])
        for depth, (pattern, mask) in enumerate(reversed(levels)):
            up = above if depth == 0 else np.repeat(above, FAN, axis=0)[: len(pattern)]
            self.levels.append((pattern, mask & ~up))
            above = mask
        self.visited = 0

    def pairs(self, limit: int, others: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The places of all pairs that differ in at most `limit` bits: of two entries, each pair once, or of one of `others` and an entry."""
        asked = self.bits if others is None else others
        width = [FAN**d for d in range(len(self.levels) - 1, -1, -1)]  # entries below a node of a level
        for at in range(0, len(asked), QUERIES):
            query = np.arange(at, min(at + QUERIES, len(asked)))
            node, sums = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
            for depth, (pattern, own) in enumerate(self.levels):
                if depth:
                    query, sums = np.repeat(query, FAN), np.repeat(sums, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    inside = node < len(pattern)
                    if others is None:  # only entries after the query
                        inside &= (node + 1) * width[depth] > query + 1
                    query, sums, node = query[inside], sums[inside], node[inside]
                self.visited += len(node)
                sums = sums + np.bitwise_count((asked[query] ^ pattern[node]) & own[node]).sum(axis=1, dtype=np.int64)
                near = sums <= limit
                query, sums, node = query[near], sums[near], node[near]
            if others is None:
                different = query != node
                yield self.order[query[different]], self.order[node[different]]
            else:
                yield query, self.order[node]
