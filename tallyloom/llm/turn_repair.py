"""Repair of conversations by Wagner-Fischer alignment to an alternating grammar.

A conversation's role initials should read ``(s?(ua)+)?``: an optional system
turn, then user and assistant in turn.  For each length that such a string can
have there is one target, so a conversation's turns are aligned to each target
whose length the best cost so far still allows, nearest lengths first.  Kept rows
cost nothing, a change of role 2, a deletion 3, an inserted turn 2, and a
truncated row that stays 1.  Every cell of a table off the band that Ukkonen's
bound leaves (what deletions and insertions the cell's diagonal needs would cost
more than the best so far) is left out.  Tables are filled from the end, so the
audit, the edits' initials, is read forwards: of the cheapest ways the least
letter is taken at each step.  The least audit of all lengths of the least cost
is the result.

Where lengths and bands grow with the conversation this is cubic in its rows, so
a conversation of more than ``ALIGNED_ROWS`` rows is aligned to all targets at
once: the targets are the paths of a four-state automaton, and one pass keeps the
cheapest and least audit of each state.  Both give the same rows (tested).

Spark deals the rows by conversation and sorts them; a task reads its rows as a
stream.  Of the conversation that comes by it holds a mark, a digest (to see
repeats) and four costs a row, some 150 bytes; its texts wait in a file of the
task once they pass ``HELD_BYTES``.  The result's own digest, over the ordered
rows of a conversation, makes a conversation one task's work.

Defined results: a null role or text is one space; a null turn comes first; rows
of equal turn are ordered by role, then text, then copy.  A null id is a
conversation of its own.  A conversation of which no row is left has zeros, an
empty audit and the digest of nothing.  An empty table gives no rows; columns
besides the four named ones are left out.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import SPACES

#: Costs of the edits.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1

#: Rows up to which a conversation is aligned to one target length after the other.
ALIGNED_ROWS = 64

#: Marks of a row beside its initial: it must be deleted, it is truncated.
GOES, TRUNCATED = "x", "t"

#: Bytes of a conversation's texts that are held in memory.
HELD_BYTES = 32 << 20

ROLES = {"u": b"user", "a": b"assistant"}
INFINITE = 1 << 60


def target(length: int) -> str:
    """The grammar's string of a feasible length: odd ones begin with a system turn."""
    return "s" * (length % 2) + "ua" * (length // 2)


def feasible(length: int) -> bool:
    return length >= 0 and length != 1


def aligned(rows: tuple[str, ...], wanted: str, most: int) -> tuple[int, str] | None:
    """The least cost, not over ``most``, and the least audit of turning ``rows`` into ``wanted``.

    A row is its initial and a mark.  ``None`` where every way costs more.
    """
    m, n = len(rows), len(wanted)

    def off(i: int, j: int) -> bool:
        # Ukkonen: surplus rows before and after the cell are deletions, missing ones insertions.
        before, after = i - j, (m - i) - (n - j)
        need = (DELETE * before if before > 0 else -INSERT * before) + (DELETE * after if after > 0 else -INSERT * after)
        return need > most

    reach = most // min(DELETE, INSERT)
    table: list[dict[int, int]] = [{} for _ in range(m + 1)]
    for i in range(m, -1, -1):
        row, below = table[i], table[i + 1] if i < m else {}
        kept = CUT if i < m and rows[i][1] == TRUNCATED else 0
        for j in range(min(n, i + reach), max(-1, i - reach - 1), -1):
            if off(i, j):
                continue
            if i == m and j == n:
                row[j] = 0
                continue
            best = INFINITE
            if i < m:
                best = below.get(j, INFINITE) + DELETE
                if j < n and rows[i][1] != GOES:
                    if rows[i][0] == wanted[j]:
                        best = min(best, below.get(j + 1, INFINITE) + kept)
                    elif wanted[j] != "s":
                        best = min(best, below.get(j + 1, INFINITE) + REROLE + kept)
            if j < n and wanted[j] != "s":
                best = min(best, row.get(j + 1, INFINITE) + INSERT)
            if best <= most:
                row[j] = best
    if 0 not in table[0]:
        return None
    i = j = 0
    audit = []
    while i < m or j < n:
        left = table[i][j]
        if i < m and table[i + 1].get(j, INFINITE) + DELETE == left:
            audit.append("D")
            i += 1
        elif j < n and wanted[j] != "s" and table[i].get(j + 1, INFINITE) + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if rows[i][0] == wanted[j] else "R")
            i, j = i + 1, j + 1
    return table[0][0], "".join(audit)


@lru_cache(maxsize=1 << 16)
def by_lengths(rows: tuple[str, ...]) -> tuple[int, str]:
    """The cheapest and then least audit over all feasible target lengths."""
    m = len(rows)
    # Deleting all rows is always a way.
    best = (DELETE * m, "D" * m)
    for length in sorted(filter(feasible, range(m + best[0] // INSERT + 1)), key=lambda n: abs(n - m)):
        change = DELETE * (m - length) if length < m else INSERT * (length - m)
        if change <= best[0] and (found := aligned(rows, target(length), best[0])):
            best = min(best, found)
    return best


#: Next state by state and initial: nothing yet, after s, after u, after a.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)


def by_states(rows: tuple[str, ...]) -> tuple[int, str]:
    """The same result for any number of rows in one pass over the grammar's states."""
    m = len(rows)
    # Costs of what is left, four numbers a row, by state.
    table = array("q", bytes(32 * (m + 1)))

    def rest(i: int, q: int) -> int:
        return table[4 * i + q]

    def settled(cost: list[int]) -> list[int]:
        # Insertions lead from state to state without a row; two rounds reach every state that two of them can.
        for _ in range(2):
            for q in range(4):
                for c, to in STEPS[q].items():
                    if c != "s":
                        cost[q] = min(cost[q], cost[to] + INSERT)
        return cost

    below = settled([0 if q in ENDS else INFINITE for q in range(4)])
    table[4 * m :] = array("q", below)
    for i in range(m - 1, -1, -1):
        initial, mark = rows[i]
        cost = [c + DELETE for c in below]
        if mark != GOES:
            cut = CUT if mark == TRUNCATED else 0
            for q in range(4):
                for c, to in STEPS[q].items():
                    if c == initial:
                        cost[q] = min(cost[q], below[to] + cut)
                    elif c != "s":
                        cost[q] = min(cost[q], below[to] + cut + REROLE)
        below = settled(cost)
        table[4 * i : 4 * i + 4] = array("q", below)
    audit, i, q = [], 0, 0
    while i < m or rest(i, q):
        left = rest(i, q)
        if i < m and rest(i + 1, q) + DELETE == left:
            audit.append("D")
            i += 1
            continue
        ways = STEPS[q]
        inserted = next((to for c, to in ways.items() if c != "s" and rest(i, to) + INSERT == left), None)
        if inserted is not None:
            audit.append("I")
            q = inserted
            continue
        initial, mark = rows[i]
        cut = CUT if mark == TRUNCATED else 0
        if mark != GOES and initial in ways and rest(i + 1, ways[initial]) + cut == left:
            audit.append("K")
            q = ways[initial]
        else:
            audit.append("R")
            q = next(to for c, to in ways.items() if c not in ("s", initial) and rest(i + 1, to) + cut + REROLE == left)
        i += 1
    return rest(0, 0), "".join(audit)


def repair(rows: tuple[str, ...]) -> tuple[int, str]:
    """Cost and audit of a conversation's rows, each its initial (one character or none) and a mark."""
    return by_lengths(rows) if len(rows) <= ALIGNED_ROWS else by_states(rows)


def damaged(df: DataFrame) -> DataFrame:
    """The rows after the fixed damage: conv_id, turn, role, text, copy; dropped rows stay with a null copy."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    changed = df.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, F.array(F.lit(0), F.lit(1))).when(kind != 0, F.array(F.lit(0))).alias("copies"),
    )
    return changed.select("conv_id", "turn", "role", "text", F.explode_outer("copies").alias("copy"))


def marked(df: DataFrame) -> DataFrame:
    """Rows of ``damaged`` with ``blank`` and ``open_end``, whether the text's last character ends no sentence."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    return df.withColumn("blank", last == "").withColumn("open_end", ~last.isin("", ".", "!", "?"))


#: One object for each kind of row.
_ROWS: dict[tuple[str, str], tuple[str, str]] = {}


class _Conversation:
    """What is held of the conversation whose rows come by."""

    def __init__(self, conv_id: object):
        self.conv_id = conv_id
        self.rows: list[str] = []
        self.texts = tempfile.SpooledTemporaryFile(max_size=HELD_BYTES)
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, open_end: bool) -> None:
        initial, digest = role[:1], hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        repeated = digest in self.seen
        self.seen.add(digest)
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += open_end and not blank and not repeated
        if self.rows and self.rows[-1][0] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        row = (initial, GOES if blank or repeated else TRUNCATED if open_end else ".")
        self.rows.append(_ROWS.setdefault(row, row))
        if row[1] != GOES:
            for part in (role.encode(), text.encode()):
                self.texts.write(len(part).to_bytes(8, "little"))
                self.texts.write(part)

    def _part(self) -> bytes:
        return self.texts.read(int.from_bytes(self.texts.read(8), "little"))

    def result(self) -> tuple:
        cost, audit = repair(tuple(self.rows))
        digest, rows, between = hashlib.sha256(), iter(self.rows), b""
        wanted = iter(target(len(audit) - audit.count("D")))
        self.texts.seek(0)
        for edit in audit:
            role = text = b""
            if edit != "I" and next(rows)[1] != GOES:
                role, text = self._part(), self._part()
            if edit == "D":
                continue
            initial = next(wanted)
            digest.update(between + (role if edit == "K" else ROLES[initial]) + b":")
            digest.update(text)
            between = b"\n"
        self.texts.close()
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.hexdigest())


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``damaged`` (or like) rows: conv_id, counts of faults, cost, audit and repaired_sha256."""
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType(
        [
            T.StructField("conv_id", kind),
            *(T.StructField(c, T.LongType(), False) for c in COUNTS),
            T.StructField("audit", T.StringType(), False),
            T.StructField("repaired_sha256", T.StringType(), False),
        ]
    )
    dealt = marked(rows).select("conv_id", "turn", "role", "text", "copy", "blank", "open_end").repartition("conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(7))
            for conv_id, turn, role, text, copy, blank, open_end in zip(*columns):
                if held is None or conv_id != held.conv_id:
                    if held is not None:
                        out.append(held.result())
                    held = _Conversation(conv_id)
                if copy is not None:
                    held.add(turn, role, text, blank, open_end)
            if len(out) >= 4096:
                yield _batch(out, batch.schema.field(0).type, schema.names)
                out = []
        if held is not None:
            out.append(held.result())
            yield _batch(out, batch.schema.field(0).type, schema.names)

    return ordered.mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
