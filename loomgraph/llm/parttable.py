"""An exact hash table from short byte strings to token ids, probed for a whole batch of texts at once.

Keys of up to 16 bytes are held as two integers and a tag (their length and kind), so equality is exact and
every step of a probe is one array operation.  Longer keys go to a function one by one.  The table holds
at most ``LIMIT`` keys; what is not in it is asked again, so the limit has no effect on results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LIMIT = 1_200_000
KEY_BYTES = 16
_EMPTY = 255
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class PartTable:
    """``find(part, kind)`` gives a part's ids; kinds are small integers below 8 that tell equal bytes apart."""

    def __init__(self, find: Callable[[bytes, int], bytes], item: np.dtype) -> None:
        self.find, self.item = find, item
        self.size, self.used = 0, 0
        self.ids = np.empty(1 << 16, dtype=item)
        self._allocate(16)

    def _allocate(self, bits: int) -> None:
        self.bits = bits
        n = 1 << bits
        self.low, self.high = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        self.tag = np.full(n, _EMPTY, dtype=np.uint8)
        self.start, self.count = np.zeros(n, dtype=np.uint32), np.zeros(n, dtype=np.uint8)

    def _slot(self, low: np.ndarray, high: np.ndarray, tag: np.ndarray) -> np.ndarray:
        h = (low * _A) ^ (high * _B) ^ (tag.astype(np.uint64) * _C)
        h ^= h >> np.uint64(32)
        h *= _A
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _probe(self, low: np.ndarray, high: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 if it is not there."""
        at = self._slot(low, high, tag)
        found = np.where((self.low[at] == low) & (self.high[at] == high) & (self.tag[at] == tag), at, -1)
        left = np.flatnonzero((found < 0) & (self.tag[at] != _EMPTY))
        at = at[left]
        while left.size:
            at = (at + 1) & ((1 << self.bits) - 1)
            tags = self.tag[at]
            same = (self.low[at] == low[left]) & (self.high[at] == high[left]) & (tags == tag[left])
            found[left[same]] = at[same]
            go = ~same & (tags != _EMPTY)
            left, at = left[go], at[go]
        return found

    def _insert(self, low: np.ndarray, high: np.ndarray, tag: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        """Add keys that are distinct and not there yet."""
        at, left = self._slot(low, high, tag), np.arange(low.size)
        while left.size:
            free = self.tag[at] == _EMPTY
            slots, first = np.unique(at[free], return_index=True)
            who = left[free][first]
            self.low[slots], self.high[slots], self.tag[slots], self.start[slots], self.count[slots] = low[who], high[who], tag[who], start[who], count[who]
            stay = np.ones(left.size, dtype=bool)
            stay[np.flatnonzero(free)[first]] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)
        self.size += low.size

    def _reserve(self, more: int) -> None:
        if self.used + more > self.ids.size:
            held = np.empty(max(2 * self.ids.size, self.used + more), dtype=self.item)
            held[: self.used] = self.ids[: self.used]
            self.ids = held

    def _room(self, more: int) -> None:
        bits = self.bits
        while (self.size + more) * 5 > 3 << bits:
            bits += 1
        if bits != self.bits:
            old = np.flatnonzero(self.tag != _EMPTY)
            rows = [x[old] for x in (self.low, self.high, self.tag, self.start, self.count)]
            self._allocate(bits)
            self.size = 0
            self._insert(*rows)

    def encode(self, data: bytes, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts data[start:end], one after another, and how many each part has."""
        padded = np.frombuffer(data + bytes(32), dtype=np.uint8)
        words = np.ndarray(shape=(padded.size - 7,), dtype="<u8", buffer=padded, strides=(1,))
        n = end - start
        short = n <= KEY_BYTES
        low = words[start] & _MASKS[np.minimum(n, 8)]
        high = words[start + 8 * (n > 8)] & _MASKS[np.clip(n - 8, 0, 8)]
        tag = (np.minimum(n, KEY_BYTES + 1) | (kind << 5)).astype(np.uint8)
        slot = self._probe(low, high, tag)
        slot[~short] = -1
        at, count = self.start[slot].astype(np.int64), self.count[slot].astype(np.int64)
        at[slot < 0] = count[slot < 0] = 0
        missed = np.flatnonzero(slot < 0)
        if missed.size:
            first: dict[tuple[bytes, int], int] = {}
            which = np.empty(missed.size, dtype=np.int64)
            found: list[bytes] = []
            for j, (a, b, k) in enumerate(zip(start[missed].tolist(), end[missed].tolist(), kind[missed].tolist(), strict=True)):
                key = (data[a:b], k)
                i = first.get(key)
                if i is None:
                    i = first[key] = len(found)
                    found.append(self.find(*key))
                which[j] = i
            sizes = np.array([len(x) for x in found], dtype=np.int64) // self.item.itemsize
            self._reserve(int(sizes.sum()))
            starts = self.used + np.cumsum(sizes) - sizes
            self.ids[self.used : self.used + int(sizes.sum())] = np.frombuffer(b"".join(found), dtype=self.item)
            at[missed], count[missed] = starts[which], sizes[which]
            # Keep them, unless the table is full or the key is long: then their ids are only borrowed space.
            one = missed[np.unique(which, return_index=True)[1]]
            fits = short[one] & (sizes < 256)
            if fits.all() and self.size + one.size <= LIMIT:
                keep = np.arange(one.size)
            else:
                keep = np.flatnonzero(fits) if self.size + int(fits.sum()) <= LIMIT else np.empty(0, dtype=np.int64)
            if keep.size:
                self._room(keep.size)
                self._insert(low[one[keep]], high[one[keep]], tag[one[keep]], starts[keep].astype(np.uint32), sizes[keep].astype(np.uint8))
                self.used += int(sizes.sum())
        total = int(count.sum())
        from_ = np.repeat(at - (np.cumsum(count) - count), count)
        from_ += np.arange(total)
        return self.ids[from_], count
