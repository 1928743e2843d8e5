"""Suffix arrays by induced sorting, and permuted common prefixes, of byte texts.

``suffix_array`` classifies suffixes, sorts the leftmost-smaller (LMS) substrings
by one induction, names them, sorts the string of names recursively where names
repeat, and induces the whole array from the sorted LMS suffixes.  The first
level works bucket by bucket in NumPy: a bucket's entries are complete when the
scan reaches it but for those that it induces into itself, which follow in waves
(one for each step of a run of equal bytes).  Deeper levels, a third of the size
or less but with many more symbols, induce in plain linear loops.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix counts as such."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    smaller = np.ones(n, dtype=bool)
    if len(differs):
        rises = text[differs] < text[differs + 1]
        # A suffix has the type of the next place where neighbours differ.
        lengths = np.diff(np.concatenate(([-1], differs)))
        smaller[: differs[-1] + 1] = np.repeat(rises, lengths)
    smaller[n - 1] = True
    if len(differs) == 0 or differs[-1] < n - 2:
        smaller[(differs[-1] + 1 if len(differs) else 0) : n - 1] = False
    return smaller


def _induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """The order of all suffixes that the order of ``lms`` (within each bucket) induces."""

    def scatter(entries: np.ndarray, into: list[list[np.ndarray]]) -> None:
        keys = text[entries]
        order = np.argsort(keys, kind="stable")
        entries, keys = entries[order], keys[order]
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for part in np.split(entries, cuts) if len(entries) else ():
            into[text[part[0]]].append(part)

    def waves(entries: list[np.ndarray], c: int, of_type: np.ndarray) -> np.ndarray:
        found = list(entries)
        frontier = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
        while len(frontier):
            before = frontier[frontier > 0] - 1
            frontier = before[(text[before] == c) & of_type[before]]
            if len(frontier):
                found.append(frontier)
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)

    larger = ~smaller
    seeds: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    scatter(lms, seeds)
    rising: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    upper = []
    for c in range(alphabet):
        whole = waves(rising[c], c, larger)
        upper.append(whole)
        scan = np.concatenate([whole, *seeds[c]])
        before = scan[scan > 0] - 1
        before = before[larger[before]]
        scatter(before[text[before] > c], rising)
        rising[c] = []
    falling: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    lower = [np.empty(0, dtype=np.int64)] * alphabet
    for c in range(alphabet - 1, -1, -1):
        whole = waves(falling[c], c, smaller)
        lower[c] = whole[::-1]
        scan = np.concatenate([whole, upper[c][::-1]])
        before = scan[scan > 0] - 1
        before = before[smaller[before]]
        scatter(before[text[before] < c], falling)
        falling[c] = []
    lower[0] = np.array([len(text) - 1])
    return np.concatenate([part for c in range(alphabet) for part in (upper[c], lower[c])])


def _codes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; zeros follow the text."""
    data = np.concatenate((text, np.zeros(8, dtype=np.uint8)))
    return np.ndarray(len(text), dtype="<u8", buffer=data, strides=(1,)).copy()


def _names(codes: np.ndarray, lms: np.ndarray, ordered: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """A number for each LMS substring, in the order of positions; equal substrings share one."""
    length = np.empty(n, dtype=np.int64)
    length[lms] = np.diff(np.concatenate((lms, [n - 1]))) + 1
    a, b = ordered[1:], ordered[:-1]
    size = length[a]
    same = size == length[b]
    active, step = np.flatnonzero(same), 0
    while len(active):
        left = size[active] - step
        mask = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.clip(left, 0, 7)).astype(np.uint64)) - np.uint64(1))
        equal = ((codes[a[active] + step] ^ codes[b[active] + step]) & mask) == 0
        same[active[~equal]] = False
        step += 8
        active = active[equal & (left > 8)]
    rank = np.concatenate(([0], np.cumsum(~same)))
    at = np.empty(n, dtype=np.int64)
    at[ordered] = rank
    return at[lms], int(rank[-1]) + 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of uint8 ``text``, whose last byte is a zero that occurs nowhere else."""
    n = len(text)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    smaller = _types(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    alphabet = int(text.max()) + 1
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    first = _induce(text, smaller, lms, alphabet)
    ordered = first[is_lms[first]]
    names, count = _names(_codes(text), lms, ordered, n)
    if count < len(lms):
        ordered = lms[sais(names, count)]
    return _induce(text, smaller, ordered, alphabet)


def sais(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix array of numbers below ``alphabet`` whose last one is their least and occurs once."""
    n = len(text)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    is_small = _types(text)
    lms = np.flatnonzero(is_small[1:] & ~is_small[:-1]) + 1
    sizes = np.bincount(text, minlength=alphabet)
    tails = np.cumsum(sizes)
    heads, ends = (tails - sizes).tolist(), tails.tolist()
    symbols = text.tolist()
    # Of each suffix: the symbol before it, if the suffix there is of the larger or the smaller kind; else -1.
    before = np.concatenate(([-1], text[:-1]))
    large = np.where(np.concatenate(([False], ~is_small[:-1])), before, -1).tolist()
    small = np.where(np.concatenate(([False], is_small[:-1])), before, -1).tolist()

    def induced(seeds: list[int]) -> list[int]:
        out = [0] * n  # zero has nothing before it, so empty places induce nothing
        at = ends[:]
        for i in reversed(seeds):
            c = symbols[i]
            at[c] -= 1
            out[at[c]] = i
        at = heads[:]
        for j in out:  # is written to while it is read, as the method wants
            c = large[j]
            if c >= 0:
                out[at[c]] = j - 1
                at[c] += 1
        at = ends[:]
        for j in reversed(out):
            c = small[j]
            if c >= 0:
                at[c] -= 1
                out[at[c]] = j - 1
        return out

    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    first = np.array(induced(lms.tolist()), dtype=np.int64)
    ordered = first[is_lms[first]]
    length = np.zeros(n, dtype=np.int64)
    length[lms] = np.diff(np.concatenate((lms, [n - 1]))) + 1
    a, b = ordered[1:], ordered[:-1]
    same = length[a] == length[b]
    active, step = np.flatnonzero(same), 0
    while len(active):
        equal = text[a[active] + step] == text[b[active] + step]
        same[active[~equal]] = False
        step += 1
        active = active[equal]
        active = active[length[a[active]] > step]
    rank = np.concatenate(([0], np.cumsum(~same)))
    if rank[-1] + 1 < len(lms):
        names = np.empty(n, dtype=np.int64)
        names[ordered] = rank
        ordered = lms[sais(names[lms], int(rank[-1]) + 1)]
    return np.array(induced(ordered.tolist()), dtype=np.int64)


def permuted_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each position, the common prefix (up to ``limit``) with the suffix before it in the array."""
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    codes = _codes(text)
    out = np.zeros(n, dtype=np.int64)
    active = np.flatnonzero(before >= 0)
    for step in range(0, limit, 8):
        a, b = active + step, before[active] + step
        inside = (a < n) & (b < n)  # the unique last byte ends every common prefix
        active, a, b = active[inside], a[inside], b[inside]
        differs = codes[a] ^ codes[b]
        equal = differs == 0
        low = differs[~equal]
        low &= np.uint64(0) - low
        out[active[~equal]] += np.log2(low.astype(np.float64)).astype(np.int64) >> 3
        active = active[equal]
        out[active] += 8
        if not len(active):
            break
    return np.minimum(out, limit)
