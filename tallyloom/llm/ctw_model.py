"""Context-tree weighting over bytes, as array operations on counted grams.

Each byte is eight binary decisions.  A decision's context at depth d is the d
bytes before it (and the bits of its own byte so far); its Krichevsky-Trofimov
estimate counts how often each bit followed there.  A node's weighted
probability is half its own block estimate and half the product of its
children's, so after training a node predicts a mixture of its estimate and of
what the deeper contexts predict, with the posterior weight of each.  A context
that training never met predicts 1/2, and counts with its parent's weight.

A gram is ``depth`` context bytes and the byte that follows, as one number with
the nearest context byte highest and the coded byte lowest.  Sorted grams hold
every context of every depth as a run, so a range of grams holds whole subtrees
but for the contexts that its two ends cut through: its edges.  An edge's sums
are completed by those of other ranges before anything is predicted with it.
"""

from __future__ import annotations

import numpy as np

def grams_of(data: bytes, depth: int, before: int) -> np.ndarray:
    """The gram of every byte of ``data``, which begins after ``depth`` bytes ``before``."""
    padded = np.concatenate((np.full(depth, before, dtype=np.uint8), np.frombuffer(data, dtype=np.uint8)))
    n = len(data)
    out = padded[depth:].astype(np.uint64)
    for back in range(1, depth + 1):
        out |= padded[depth - back : depth - back + n].astype(np.uint64) << np.uint64(8 * (depth - back + 1))
    return out


_LOG_HALF = np.log(0.5)


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """log(Gamma(n + 1/2) / Gamma(1/2)) by Stirling's series, exact sums below 16."""
    small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(64) + 0.5))))
    x = n + 0.5
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) - 0.5 * np.log(np.pi)
    return np.where(n < 64, small[np.minimum(n, 63).astype(np.int64)], series)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 64)))))
    x = n + 1.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 64, small[np.minimum(n, 63).astype(np.int64)], series)


def block_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the KT probability of a sequence with so many zeros and ones."""
    return _lgamma_half(zeros) + _lgamma_half(ones) - _log_factorial(zeros + ones)


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def contexts_cut(cut: int, depth: int) -> dict[int, int]:
    """By depth, the context whose grams lie on both sides of a cut (grams from ``cut`` on are on the right side)."""
    return {d: cut >> 8 * (depth + 1 - d) for d in range(depth + 1) if cut % 256 ** (depth + 1 - d)}


def edges_of(ends: list[int], depth: int) -> dict[int, list[int]]:
    """By depth, the contexts that a range's ends cut through: two at most."""
    found: dict[int, set] = {d: set() for d in range(depth + 1)}
    for cut in ends:
        for d, context in contexts_cut(cut, depth).items():
            found[d].add(context)
    return {d: sorted(c) for d, c in found.items()}


def snapped(cuts: list[int]) -> list[int]:
    """The cuts moved down, not as far as the one before, to where they cut through the fewest contexts."""
    out, before = [], 0
    for cut in sorted(set(cuts)):
        if cut <= before:
            continue
        moved, size = cut, 256
        while (shorter := cut // size * size) > before:
            moved, size = shorter, size * 256
        out.append(moved)
        before = cut
    return out


class _Bit:
    """The nodes of one bit position over sorted grams: per depth, counts and weighted probabilities.

    A node's number is its context, the bit position and the bits so far: context << 11 | position << 8 | bits.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int, bit: int, edges: dict[int, list[int]]):
        coded = grams & np.uint64(255)
        context = grams >> np.uint64(8)
        prefix = coded >> np.uint64(8 - bit)
        self.depth = depth
        self.one = ((coded >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        # Leaves: (whole context, bits so far).  Grams are sorted, so these keys are too.
        leaf_key = (context << np.uint64(8)) | prefix
        starts = _runs(leaf_key)
        self.at = {depth: np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(grams)]))))}
        ones = np.add.reduceat(np.where(self.one, counts, 0), starts)
        zeros = np.add.reduceat(counts, starts) - ones
        self.zeros, self.ones, self.below, self.stop, self.edge, self.node = {depth: zeros}, {depth: ones}, {depth: np.zeros(len(ones))}, {depth: None}, {}, {}
        weighted = block_estimate(zeros, ones)
        key = leaf_key[starts]
        for d in range(depth, -1, -1):
            of = key >> np.uint64(8)
            edge = np.zeros(len(key), dtype=bool)
            for c in edges[d]:
                edge |= of == np.uint64(c)
            self.edge[d] = np.flatnonzero(edge)
            self.node[d] = ((of[edge] << np.uint64(11)) | np.uint64(bit << 8) | (key[edge] & np.uint64(255))).astype(np.int64)
            if not d:
                break
            # A shorter context keeps the bits so far; its children are not neighbours, so they are grouped by sorting.
            parent = (key >> np.uint64(16)) << np.uint64(8) | (key & np.uint64(255))
            order = np.argsort(parent, kind="stable")
            sorted_parent = parent[order]
            starts = _runs(sorted_parent)
            of_child = np.empty(len(key), dtype=np.int64)
            of_child[order] = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(key)]))))
            n = len(starts)
            zeros, ones = np.bincount(of_child, zeros, n), np.bincount(of_child, ones, n)
            # An edge's weighted probability is not known yet: its parent, an edge too, gets it with the other ranges' sums.
            below = np.bincount(of_child, np.where(edge, 0.0, weighted), n)
            own = block_estimate(zeros, ones)
            weighted = np.logaddexp(own, below) + _LOG_HALF
            self.zeros[d - 1], self.ones[d - 1], self.below[d - 1], self.stop[d - 1] = zeros, ones, below, own - below
            self.at[d - 1] = of_child[self.at[d]]
            key = sorted_parent[starts]

    def complete(self, known: dict[int, tuple[np.ndarray, ...]]) -> None:
        """Edges get the values of the whole tree; ``known`` has node (ascending), zeros, ones and stop by depth."""
        for d, at in self.edge.items():
            if len(at):
                node, zeros, ones, stop = known[d]
                place = np.searchsorted(node, self.node[d])
                self.zeros[d][at], self.ones[d][at] = zeros[place], ones[place]
                if d < self.depth:
                    self.stop[d][at] = stop[place]

    def predict(self) -> np.ndarray:
        """For each gram, the probability of its bit, all depths mixed."""
        p = None
        for d in range(self.depth, -1, -1):
            own = (np.where(self.one, self.ones[d][self.at[d]], self.zeros[d][self.at[d]]) + 0.5) / ((self.zeros[d] + self.ones[d]) + 1.0)[self.at[d]]
            if p is None:
                p = own
            else:
                weight = (1.0 / (1.0 + np.exp(-np.clip(self.stop[d], -500, 500))))[self.at[d]]
                p = weight * own + (1.0 - weight) * p
        return p


def edge_sums(grams: np.ndarray, counts: np.ndarray, depth: int, edges: dict[int, list[int]]) -> tuple[np.ndarray, ...]:
    """(depth, node, zeros, ones, below) of a range's edge nodes."""
    out = []
    for bit in range(8):
        b = _Bit(grams, counts, depth, bit, edges)
        for d, at in b.edge.items():
            out.append((np.full(len(at), d, dtype=np.int32), b.node[d], b.zeros[d][at], b.ones[d][at], b.below[d][at]))
    return tuple(np.concatenate(c) for c in zip(*out))


def weighed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, leaf: bool) -> tuple[np.ndarray, np.ndarray]:
    """(stop, weighted) of complete nodes: log odds of the own estimate, and log of the weighted probability."""
    own = block_estimate(zeros, ones)
    return (own * 0, own) if leaf else (own - below, np.logaddexp(own, below) + _LOG_HALF)


def log_probabilities(grams: np.ndarray, counts: np.ndarray, depth: int, edges: dict[int, list[int]], known: dict[int, tuple[np.ndarray, ...]]) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context, all depths mixed."""
    out = np.zeros(len(grams))
    for bit in range(8):
        b = _Bit(grams, counts, depth, bit, edges)
        b.complete(known)
        out += np.log10(b.predict())
    return out
