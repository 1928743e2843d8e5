"""The step of a task that aligns trusted rows with noisy ones: whole keys at a time, in NumPy.

Rows come dealt by their keys, trusted ones first, each side in reading order.  Small tables are multiplied out; of large
ones rows of equal content are compared once, and only rows meet that may match in a column.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyloom.functions.text import read_cells
from tallyloom.plans.verify import LOOK_ALIKES

#: Weights of a row's columns, and the scores of a number that agrees in value, nearly, or by look-alikes.
WEIGHTS = {"amount": 0.6, "rate": 0.25, "qty": 0.15}
SAME, NEAR, ALIKE = 1.0, 0.9, 0.7
#: An anchor's least score and most repeats, anchors needed, their share of the rows, slack in counts, the gate.
ANCHOR_SCORE, ANCHOR_REPEATS, ANCHORS, DENSITY, SLACK, GATE = 0.85, 3, 2, 0.1, 2, 0.70

#: Levels of a column's match: none, by look-alikes, nearly, the same; ``UNASKED`` where the trusted row has no value.
LEVELS, UNASKED = (0.0, ALIKE, NEAR, SAME), 4
METHODS = np.array(["failed", "count_order", "anchor"], object)
#: Rows that are taken together, pairs that are held at once, and pairs beyond which tables aren't multiplied out.
CHUNK, SLICE, LARGE = 1 << 16, 1 << 16, 1 << 16
#: Digits that an amount can have, and letters that may be read as digits.
DIGITS, MISREAD = 18, 2
_TENS = 10 ** np.arange(DIGITS + 1)
#: What a byte is read as: a digit's value, 10 for another letter, 11 for what isn't kept; and whether it is a letter.
_READ = np.full(256, 11, np.uint8)
_READ[[ord(c) for c in "0123456789"]] = range(10)
_READ[[b for b in range(128) if chr(b).isalpha()]] = 10
_READ[[ord(c) for c in LOOK_ALIKES]] = [int(d) for d in LOOK_ALIKES.values()]
_LETTER = (_READ < 11) & ~np.isin(np.arange(256), [ord(c) for c in "0123456789"])


def _millionths() -> np.ndarray:
    """The score of each choice of levels, rounded as Spark does."""
    out = []
    for levels in product(range(UNASKED + 1), repeat=len(WEIGHTS)):
        gained = possible = 0.0
        for weight, level in zip(WEIGHTS.values(), levels):
            gained += 0.0 if level == UNASKED else weight * LEVELS[level]
            possible += 0.0 if level == UNASKED else weight
        out.append(int(Decimal(repr(gained / possible)).quantize(Decimal("0.000001"), ROUND_HALF_UP).scaleb(6)) if possible else 0)
    return np.array(out, np.int64)


SCORES = _millionths()


def own_digits(hundredths: np.ndarray) -> np.ndarray:
    """The significant digits of amounts, zeros in front too, behind a 1: 3000.00 gives 13000, 12.50 gives 1125."""
    whole, rest = np.divmod(hundredths, 100)
    dropped = np.where(rest == 0, 2, np.where(rest % 10 == 0, 1, 0))
    return _TENS[np.maximum(np.searchsorted(_TENS, whole, "right"), 1) + 2 - dropped] + hundredths // _TENS[dropped]


def read_digits(raws: pa.Array) -> np.ndarray:
    """The digits of a task's whole batch of cells behind a 1; 0 for cells that have none, or more than an amount.

    Letters are read as digits where they are ``MISREAD`` or fewer and all look like some.
    """
    raws = pa.concat_arrays([raws.fill_null("")])
    ends = np.frombuffer(raws.buffers()[1], np.int32)[raws.offset : raws.offset + len(raws) + 1]
    data = np.frombuffer(raws.buffers()[2] or b"", np.uint8)[: ends[-1]]
    read = _READ[data]
    begins, letters, strange = (np.append(0, np.cumsum(x))[ends] for x in (read < 11, _LETTER[data], read == 10))
    sizes, digits = np.diff(begins), read[read < 11].astype(np.int64)
    fine = (sizes > 0) & (sizes <= DIGITS) & (np.diff(letters) <= MISREAD) & (np.diff(strange) == 0)
    out = fine.astype(np.int64)
    for k in range(int(sizes[fine].max(initial=0))):
        more = np.flatnonzero(fine & (sizes > k))
        out[more] = out[more] * 10 + digits[begins[more] + k]
    return out


def longest_rising(rows: list[tuple]) -> list[tuple]:
    """A longest run of rows, in their order, whose last values rise."""
    tails, at, before = [], [], []  # least last value and its row for each length; the row before each row
    for n, row in enumerate(rows):
        place = bisect_left(tails, row[-1])
        before.append(at[place - 1] if place else -1)
        tails[place : place + 1] = [row[-1]]
        at[place : place + 1] = [n]
    kept, n = [], at[-1]
    while n >= 0:
        kept.append(rows[n])
        n = before[n]
    return kept


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """True where a column differs from the row before; the first row does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, one range after another, and the range of each."""
    of = np.repeat(np.arange(len(starts)), sizes)
    return starts[of] + np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of], of


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of entries that have ``SLICE`` pairs together, or one of more."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield slice(at, end)
        at = end


class _Chunk:
    """The rows of whole keys: numbers and codes of digits by column, and the runs of rows of one key, side and part."""

    def __init__(self, table: pa.Table, width: int):
        codes = [c.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in table.columns[: width + 2]]
        self.table, self.width = table, width
        self.place, self.page = (table.column(width + k).to_numpy() for k in (2, 3))
        self.numbers, self.digits = [], []
        told = pa.array(table.column(width).to_numpy() == 0)
        for r in range(len(WEIGHTS)):
            value, hundredths, raw = (table.column(width + 4 + 3 * r + k).combine_chunks() for k in range(3))
            self.numbers.append(pc.if_else(told, value, read_cells(raw)[0]).to_numpy(zero_copy_only=False))
            # No digits of the one side are none of the other.
            own = np.where(hundredths.is_valid(), own_digits(hundredths.fill_null(0).to_numpy()), -1)
            self.digits.append(np.where(told, own, read_digits(raw)))
        # 1 % of a number, or of 1: the larger side's is how far the other may be off.
        self.reach = [0.01 * np.maximum(np.abs(x), 1.0) for x in self.numbers]
        self.empty = [bool((np.isnan(x) & told.to_numpy(zero_copy_only=False)).any()) for x in self.numbers]
        opens = changes(codes)
        self.start = np.flatnonzero(opens)
        self.size, self.run = np.diff(self.start, append=len(opens)), np.cumsum(opens) - 1
        self.side = table.column(width).to_numpy()[self.start]
        # All of a key's trusted rows lie together, and then its noisy ones.
        by_side = np.flatnonzero(changes(codes[: width + 1]))
        sizes, sides = np.diff(by_side, append=len(opens)), table.column(width).to_numpy()[by_side]
        keys = np.cumsum(changes(codes[:width])) - 1
        t, n = by_side[sides == 0], by_side[sides == 1]
        of = dict(zip(keys[n].tolist(), zip(n.tolist(), sizes[sides == 1].tolist())))
        held = np.array([of.get(k, (0, 0)) for k in keys[t].tolist()], np.int64).reshape(-1, 2)
        self.whole = (t, sizes[sides == 0], held[:, 0], held[:, 1])

    def levels(self, role: int, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        v, own, reach = self.numbers[role][t], self.digits[role][t], self.reach[role]
        off = np.abs(v - self.numbers[role][n])
        near = off <= np.maximum(reach[t], reach[n])
        out = (own == self.digits[role][n]).view(np.int8)
        for level, met in ((2, near), (3, off <= 1.0)):
            out = np.maximum(out, met.view(np.int8) * np.int8(level))
        if self.empty[role]:
            out[np.isnan(v)] = UNASKED
        return out

    def near(self, role: int, t: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of one key's rows that may match in a column; one can come twice."""
        v, own, p, alike = self.numbers[role][t], self.digits[role][t], self.numbers[role][n], self.digits[role][n]
        by_number, by_digits = np.argsort(p), np.argsort(alike)
        slack = 1.0 + 0.0102 * np.abs(v)
        for order, found, low, high in ((by_number, p, v - slack, v + slack), (by_digits, alike, own, own)):
            lo, hi = np.searchsorted(found[order], low, "left"), np.searchsorted(found[order], high, "right")
            sizes = np.where(np.isnan(v), 0, hi - lo)
            for s in _slices(sizes):
                at, of = _ranges(lo[s], sizes[s])
                yield t[s][of], n[order[at]]

    def kinds(self, rows: np.ndarray, roles: range) -> tuple[np.ndarray, np.ndarray]:
        """The first row of each content in the columns ``roles`` of each part, and each row's content."""
        content = np.stack([self.run[rows]] + [x for r in roles for x in ((self.numbers[r][rows] + 0.0).view(np.int64), self.digits[r][rows])], axis=1)
        _, first, of = np.unique(content, axis=0, return_index=True, return_inverse=True)
        return rows[first], of.reshape(-1)

    def score(self, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        amount, rate, qty = (self.levels(r, t, n) for r in range(3))
        return amount, SCORES[amount * np.int8(25) + rate * np.int8(5) + qty]

    def links(self) -> tuple[np.ndarray, ...]:
        """The trusted and noisy parts of a key that share a row whose amount matches, each as start and size of its rows."""
        found = []
        for _, t, n in self._meeting(*self.whole, range(1)):
            level = self.levels(0, t, n)
            met = (level > 0) & (level < UNASKED)
            found.append(np.unique(self.run[t[met]] * len(self.start) + self.run[n[met]]))
        t, n = np.divmod(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64), len(self.start))
        return self.start[t], self.size[t], self.start[n], self.size[n]

    def _meeting(self, ts, tl, ns, nl, roles: range) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(group, trusted row, noisy row) of all pairs that may match in one of the columns."""
        pairs = tl * nl
        small = np.flatnonzero((pairs > 0) & (pairs <= LARGE))
        for s in _slices(pairs[small]):
            g = small[s]
            t, of_t = _ranges(ts[g], tl[g])
            n, of = _ranges(ns[g][of_t], nl[g][of_t])
            yield g[of_t][of], t[of], n
        for g in np.flatnonzero(pairs > LARGE).tolist():
            t, _ = self.kinds(np.arange(ts[g], ts[g] + tl[g]), range(3) if len(roles) > 1 else roles)
            for r in roles:
                n, _ = self.kinds(np.arange(ns[g], ns[g] + nl[g]), range(r, 3) if len(roles) > 1 else roles)
                for a, b in self.near(r, t, n):
                    yield np.full(len(a), g), a, b

    def aligned(self, linked: bool, runs: bool) -> list[pa.Array]:
        """Each trusted row's place, or the runs of rows on one page."""
        ts, tl, ns, nl = self.links() if linked else self.whole
        t, g = _ranges(ts, tl)
        out = np.cumsum(tl) - tl
        best, held = np.zeros(len(t), np.int64), [np.zeros((4, 0), np.int64)]
        for of, a, b in self._meeting(ts, tl, ns, nl, range(3)):
            level, score = self.score(a, b)
            np.maximum.at(best, out[of] + a - ts[of], score)
            may = (level > 0) & (level < UNASKED) & (score >= round(ANCHOR_SCORE * 10**6))
            held.append(np.stack([of[may], a[may], b[may], score[may]]))
        for k in np.flatnonzero(tl * nl > LARGE).tolist():
            _, of = self.kinds(t[out[k] : out[k] + tl[k]], range(3))
            most = np.zeros(of.max() + 1, np.int64)
            np.maximum.at(most, of, best[out[k] : out[k] + tl[k]])
            best[out[k] : out[k] + tl[k]] = most[of]
        of, at, to = self._anchors(np.concatenate(held, axis=1))
        n_anchors = np.bincount(of, minlength=len(ts))
        by_count = (np.abs(tl - nl) <= SLACK) & (nl > 0)
        method = np.where((n_anchors >= ANCHORS) & (n_anchors / np.maximum(tl, 1) >= DENSITY), 2, by_count.astype(int))
        # Each row's last anchor and the next one; the table's ends stand for those that aren't there.
        here, place = out[of] + at - ts[of], np.arange(len(t))
        before, after, j_of = np.full(len(t), -1), np.full(len(t) + 1, len(t)), np.zeros(len(t), np.int64)
        before[here], after[here], j_of[here] = here, here, to - ns[of]
        before, after = np.maximum.accumulate(before), np.minimum.accumulate(after[::-1])[::-1][1:]
        i, first, last = self.place[t], before < out[g], after >= (out + tl)[g]
        from_i, from_j = np.where(first, -1, i[before]), np.where(first, -1, j_of[before])
        inner = np.minimum(after, len(t) - 1)
        to_i, to_j = np.where(last, tl[g], i[inner]), np.where(last, nl[g], j_of[inner])
        between = np.rint(from_j + (i - from_i) / (to_i - from_i).astype(float) * (to_j - from_j))
        in_order = np.rint(i * (nl[g] - 1) / np.maximum(tl[g] - 1, 1).astype(float))
        how, placed = method[g], method[g] > 0
        j = np.where(placed, np.clip(np.where(how == 2, between, in_order), 0, nl[g] - 1), 0).astype(np.int64)
        row = np.where(placed, ns[g] + j, 0)
        anchored, page, on_page = (before == place) & (how == 2), self.page[row], self._on_page()[row]
        if runs:
            kept = np.flatnonzero(placed)
            opens = np.flatnonzero(changes([g[kept], page[kept]])) if len(kept) else kept
            added = [np.add.reduceat(x[kept].astype(np.int64), opens) if len(kept) else kept for x in (placed, anchored, best)]
            at = kept[opens]
            groups = np.flatnonzero(changes([g[at]])) if len(at) else at
            nth = np.arange(len(at)) - np.repeat(groups, np.diff(groups, append=len(at))) + 1
            return [*self._keys(t[at], ns[g[at]], linked), *map(pa.array, (nth, page[at], i[at])), *map(pa.array, added), pa.array(METHODS[how[at]], pa.string()), *map(pa.array, (tl[g[at]], nl[g[at]], on_page[at]))]
        gone = ~placed
        j, page, on_page = (pa.array(x, mask=gone) for x in (j, page, on_page))
        return [*self._keys(t, ns[g], linked), pa.array(i), j, page, pa.array(anchored), pa.array(best), pa.array(METHODS[how], pa.string()), pa.array(tl[g]), pa.array(nl[g]), on_page]

    def _keys(self, t: np.ndarray, n: np.ndarray, linked: bool) -> list[pa.Array]:
        parts = [self.table.column(self.width + 1).take(pa.array(x)) for x in (t, n)] if linked else []
        return [*(self.table.column(k).take(pa.array(t)) for k in range(self.width)), *parts]

    def _anchors(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, trusted row, noisy row) of pairs that are best for both sides and rare, as far as both sides rise."""
        g, t, n, score = pairs
        both = np.zeros(len(g), np.int64)
        for mine, other in ((t, n), (n, t)):
            order = np.lexsort((other, -score, mine, g))
            if len(order):
                both[order[changes([g[order], mine[order]])]] += 1
        kept = np.flatnonzero((both == 2) & (self._repeats()[t] <= ANCHOR_REPEATS))
        kept = kept[np.lexsort((t[kept], g[kept]))]
        g, t, n = g[kept], t[kept], n[kept]
        turned = np.flatnonzero((g[1:] == g[:-1]) & (n[1:] <= n[:-1]))
        fine = np.ones(len(g), bool)
        for k in np.unique(g[turned]).tolist():
            lo, hi = np.searchsorted(g, (k, k + 1))
            fine[lo:hi] = False
            fine[[x[0] for x in longest_rising(list(zip(range(lo, hi), n[lo:hi].tolist())))]] = True
        return g[fine], t[fine], n[fine]

    def _same(self, *columns: np.ndarray) -> np.ndarray:
        """How many rows of each row's run are like it in the columns."""
        columns = (*columns, self.run)
        order = np.lexsort(columns)
        group = np.cumsum(changes([c[order] for c in columns])) - 1
        out = np.empty(len(order), np.int64)
        out[order] = np.bincount(group)[group]
        return out

    def _repeats(self) -> np.ndarray:
        return self._same(self.digits[0], self.numbers[0] < 0)

    def _on_page(self) -> np.ndarray:
        return self._same(self.page)


def steps(batches: Iterator[pa.RecordBatch], width: int, linked: bool, runs: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """What ``_Chunk.aligned`` gives for all keys of a task; the last key of what was read may go on."""
    held, rows, most = [], 0, CHUNK

    def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
        found = pa.table(_Chunk(table, width).aligned(linked, runs), names=names)
        yield from found.combine_chunks().to_batches(max_chunksize=CHUNK)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            codes = [c.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in table.columns[:width]]
            last = int(np.flatnonzero(changes(codes))[-1])
            if last:
                yield from told(table.slice(0, last).combine_chunks())
            held = table.slice(last).to_batches()
            rows -= last
            most = max(CHUNK, 2 * rows)
    if rows:
        yield from told(pa.Table.from_batches(held).combine_chunks())
