"""A segment tree over remaining capacities: the tightest open bin in O(log capacity)."""

from __future__ import annotations

import numpy as np


class CapacityTree:
    """Leaf c says whether an open bin with c places left exists; a node, whether a leaf below does."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.width)

    def set(self, left: int, present: bool) -> None:
        """Mark whether bins with ``left`` places exist and update the path to the root."""
        node = self.width + left
        self.any[node] = present
        while node > 1:
            node >>= 1
            present = self.any[2 * node] or self.any[2 * node + 1]
            if self.any[node] == present:
                break
            self.any[node] = present

    def tightest(self, need: int) -> int:
        """The smallest capacity >= ``need`` with an open bin, or -1."""
        node = self.width + need
        if self.any[node]:
            return need
        while node > 1:
            if not node & 1 and self.any[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return -1


def pack_counts(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing of counts[n] pieces of each length n, all pieces of a length at once.

    Returns the runs of the packing as rows (length, first rank, bins, pieces
    per bin, first bin, offset): ranks first..first + bins * per - 1 of that
    length go to bins first_bin.., ``per`` neighbours to each bin, from
    ``offset`` on.  It is the packing that best-fit decreasing gives piece by
    piece (a bin that has just taken a piece and still has room for another is
    the tightest, so it takes the next one).  Work and output are bounded by
    the number of lengths and capacities, not by the number of pieces.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # places left -> runs (first bin, bins)
    runs: list[tuple[int, int, int, int, int, int]] = []
    next_bin = 0

    def put(left: int, first: int, n: int) -> None:
        if left > 0:
            open_bins.setdefault(left, []).append((first, n))
            tree.set(left, True)

    for length in range(capacity, 0, -1):
        todo, rank = int(counts[length]) if length < len(counts) else 0, 0
        while todo:
            left = tree.tightest(length)
            if left < 0:
                per = capacity // length
                left, first, n = capacity, next_bin, -(-todo // per)
                next_bin += n
            else:
                first, n = open_bins[left].pop()
                if not open_bins[left]:
                    tree.set(left, False)
                per = left // length
            used = min(n, todo // per)
            if used:
                runs.append((length, rank, used, per, first, capacity - left))
                put(left - per * length, first, used)
                rank += used * per
                todo -= used * per
            rest = todo if used < n and todo < per else 0
            if rest:
                runs.append((length, rank, 1, rest, first + used, capacity - left))
                put(left - rest * length, first + used, 1)
                rank += rest
                todo = 0
                used += 1
            if used < n:
                put(left, first + used, n - used)
    return np.array(runs, dtype=np.int64).reshape(-1, 6)


def place(runs: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces given by length and rank within the length."""
    if not len(runs):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    length_start = np.searchsorted(runs[:, 0], np.arange(runs[:, 0].max() + 2))
    span = np.int64(runs[:, 1].max() + (runs[:, 2] * runs[:, 3]).max() + 1)
    assert length_start[-1] == len(runs)
    if int(span) * int(runs[:, 0].max() + 1) < 1 << 62:
        at = np.searchsorted(runs[:, 0] * span + runs[:, 1], lengths * span + ranks, side="right") - 1
    else:
        at = np.array([length_start[n] + np.searchsorted(runs[length_start[n]:length_start[n + 1], 1], r, side="right") - 1
                       for n, r in zip(lengths, ranks)], dtype=np.int64)
    run = runs[at]
    within = ranks - run[:, 1]
    return run[:, 4] + within // run[:, 3], run[:, 5] + within % run[:, 3] * run[:, 0]
