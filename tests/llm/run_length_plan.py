"""Best fit over runs of equal lengths, in one process: a plain counterpart to hold the distributed packing against."""

from bisect import bisect_left

import numpy as np


class Plan:
    """Where each rank of each length goes: intervals sorted by (length, first rank)."""

    def __init__(self, steps: list[tuple[int, int, int, int]], sequences: int, supersteps: int) -> None:
        steps = sorted(steps)
        self.length, self.rank, self.sequence, self.offset = (np.array([s[k] for s in steps], dtype=np.int64) for k in range(4))
        self.sequences, self.supersteps = sequences, supersteps
        used, self.first = np.unique(self.length, return_index=True)
        self.at = {int(n): k for k, n in enumerate(used)}

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.at[length]
        a = self.first[k]
        b = self.first[k + 1] if k + 1 < self.first.size else self.length.size
        j = a + np.searchsorted(self.rank[a:b], rank, side="right") - 1
        return self.sequence[j] + rank - self.rank[j], self.offset[j]


def supersteps(counts: dict[int, int], capacity: int) -> Plan:
    """Match runs of equally long pieces with runs of equally large gaps until no piece is left.

    ``counts`` has the number of pieces of each length.  A gap run is (first sequence, sequences); its
    pieces go at offset ``capacity - gap``.
    """
    left = {n: c for n, c in counts.items() if c}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("piece lengths must be between 1 and the capacity")
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    steps: list[tuple[int, int, int, int]] = []
    opened = rounds = 0

    def put(n: int, gap: int, first: int, count: int, into: dict[int, list[tuple[int, int]]]) -> None:
        steps.append((n, rank[n], first, capacity - gap))
        rank[n] += count
        left[n] -= count
        if gap > n:
            into.setdefault(gap - n, []).append((first, count))

    while left:
        rounds += 1
        sizes = sorted(gaps)
        changed: dict[int, list[tuple[int, int]]] = {}
        orphans = []
        longest = max(left)
        active = [n for n in left if 100 * n >= 99 * longest]
        for n in sorted(active, reverse=True):  # by rank: the longest first
            k = bisect_left(sizes, n)
            if k == len(sizes):
                orphans.append(n)
                continue
            runs = gaps[sizes[k]]
            while runs and left[n]:
                first, count = runs.pop()
                take = min(count, left[n])
                put(n, sizes[k], first, take, changed)
                if take < count:
                    runs.append((first + take, count - take))
        # What no gap holds opens sequences: one for each piece over half the capacity, and for the
        # others as many as their ids fill, to the longest of them; the rest then see the new gaps.
        small = sum(n * left[n] for n in orphans if 2 * n <= capacity)
        quota = -(-small // capacity)
        for n in orphans:
            take = left[n] if 2 * n > capacity else min(left[n], quota)
            if 2 * n <= capacity:
                quota -= take
            if take:
                put(n, capacity, opened, take, changed)
                opened += take
        for gap, runs in changed.items():
            gaps.setdefault(gap, []).extend(runs)
        gaps = {g: r for g, r in gaps.items() if r}
        left = {n: c for n, c in left.items() if c}
    return Plan(steps, opened, rounds)
