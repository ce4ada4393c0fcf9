"""A HAT-trie over word ids that counts phrases: hash containers that burst, under a shallow trie.

A phrase of up to three words is a path of word ids. Every leaf of the trie is a container, a hash
table that holds all phrases of a range of paths; paths share containers until one gets too full. It
then bursts at the border between two children of the deepest node that its paths have in common:
first between first words, and when it holds one first word alone, between second words, and so on.
Ids are packed into one number, so that a path's order is the number's order; the trie is kept as the
sorted list of the borders, and a sorted batch of phrases is cut at them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from airlock.llm.flat import mix

#: Bits of a word's id; id 0 ends a phrase of fewer words.
ID_BITS = 21
DEPTH = 3
_SHIFTS = tuple(ID_BITS * k for k in range(DEPTH - 1, -1, -1))
_ID = (1 << ID_BITS) - 1


def path(*ids: np.ndarray) -> np.ndarray:
    """One number for each phrase, in the order of its ids."""
    out = np.zeros(ids[0].size, np.uint64)
    for part, shift in zip(ids, _SHIFTS, strict=False):
        out |= part.astype(np.uint64) << np.uint64(shift)
    return out


def ids_of(paths: np.ndarray) -> list[np.ndarray]:
    return [((paths >> np.uint64(s)) & np.uint64(_ID)).astype(np.int64) for s in _SHIFTS]


class Table:
    """Open addressing from numbers other than 0 to a value each, for whole arrays at a time."""

    def __init__(self, bits: int = 8) -> None:
        self.keys, self.values, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), 0

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of the keys (no two alike) is, and which were not there before."""
        while 2 * (self.size + keys.size) > self.keys.size:
            old, counts = self.keys, self.values
            self.keys, self.values, self.size = np.zeros(2 * old.size, np.uint64), np.zeros(2 * old.size, np.int64), 0
            full = old != 0
            at, _ = self.slots(old[full])
            self.values[at] = counts[full]
        at = (mix(keys.copy()) & np.uint64(self.keys.size - 1)).astype(np.int64)
        new, todo = np.zeros(keys.size, bool), np.arange(keys.size)
        while todo.size:
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = keys[free]  # of several that want a slot the last gets it
            done = self.keys[at[todo]] == keys[todo]
            new[free[self.keys[at[free]] == keys[free]]] = True
            todo = todo[~done]
            at[todo] = (at[todo] + 1) & (self.keys.size - 1)
        self.size += int(new.sum())
        return at, new

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        at, _ = self.slots(keys)
        self.values[at] += counts

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order, and their values."""
        full = np.flatnonzero(self.keys)
        order = full[np.argsort(self.keys[full])]
        return self.keys[order], self.values[order]


class HatTrie:
    def __init__(self, burst: int = 1 << 16) -> None:
        self.burst = burst
        self.borders, self.containers = np.zeros(1, np.uint64), [Table()]

    def __len__(self) -> int:
        return sum(t.size for t in self.containers)

    def add(self, paths: np.ndarray) -> None:
        """Counts one phrase for each path."""
        keys, counts = np.unique(paths, return_counts=True)
        cuts = np.append(np.searchsorted(keys, self.borders), keys.size)
        full = []
        for k, table in enumerate(self.containers):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                table.add(keys[a:b], counts[a:b])
                if table.size > self.burst:
                    full.append(k)
        for k in reversed(full):
            self._burst(k)

    def _burst(self, k: int) -> None:
        keys, values = self.containers[k].items()
        middle = keys.size // 2
        for shift in _SHIFTS:
            node = keys >> np.uint64(shift)
            if node[0] != node[-1]:
                # The border of two children that is nearest to the middle.
                after = int(np.searchsorted(node, node[middle], side="right"))
                before = int(np.searchsorted(node, node[middle]))
                at = before if before and (after == keys.size or middle - before <= after - middle) else after
                break
        parts = []
        for own, counts in ((keys[:at], values[:at]), (keys[at:], values[at:])):
            table = Table(max(8, int(2 * own.size).bit_length()))
            table.add(own, counts)
            parts.append(table)
        border = np.uint64(int(node[at]) << shift)
        self.containers[k : k + 1] = parts
        self.borders = np.insert(self.borders, k + 1, border)

    def spill(self, down_to: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes whole containers out, the largest first, until no more than so many phrases are left;
        gives each as a run in the order of paths."""
        left = len(self)
        for k in sorted(range(len(self.containers)), key=lambda k: -self.containers[k].size):
            if left <= down_to:
                break
            table = self.containers[k]
            left -= table.size
            self.containers[k] = Table()
            if table.size:
                yield table.items()
        if not left:
            self.borders, self.containers = np.zeros(1, np.uint64), [Table()]
