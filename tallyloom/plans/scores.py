"""How well a table of cells was read: values, places, rows, columns, header and shape, per table and for a corpus.

Cells are rows (doc, row, col, raw) of what was read and of the gold table; empty cells count nowhere.
"""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import parse_number
from tallyloom.sources.shared import put_together

#: Fixed value: the relative difference up to which two numbers are equal.
TOLERANCE = 0.005


def plain_text(raw: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " ")))


class _Pairs:
    """One-to-one pairs of two sides' values that come in one order: a value takes the least open one that it can reach."""

    def __init__(self, absolute: float, relative: float):
        self.absolute, self.relative = absolute, relative
        self.open, self.counts, self.matched = (deque(), deque()), [0, 0], 0

    def take(self, v: float, side: int) -> None:
        self.counts[side] += 1
        others = self.open[1 - side]
        while others and v - others[0] > max(self.absolute, self.relative * max(abs(v), abs(others[0]), 1.0)):
            others.popleft()
        if others:
            others.popleft()
            self.matched += 1
        else:
            self.open[side].append(v)


def paired_within(a: DataFrame, b: DataFrame, keys: list[str], value: str, absolute: float = 0.0, relative: float = 0.0) -> DataFrame:
    """(keys, n_a, n_b, matched): most one-to-one pairs of values that differ by the tolerance or less.

    The tolerance is ``absolute``, or ``relative`` times the larger size (1 at least) if that is more.  Both sides' values
    stream through a task in one order; a value takes the least open one of the other side that it can still reach, so
    only values that wait within a tolerance are held.  Nulls are left out.  Tolerances must grow no faster than values.
    """
    schema = T.StructType([*(a.schema[k] for k in keys), *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "matched"))])
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs = None, None
        for batch in batches:
            done = []
            for *key, v, side in zip(*lists_of(batch)):
                if key != now:
                    if now is not None:
                        done.append((*now, *pairs.counts, pairs.matched))
                    now, pairs = key, _Pairs(absolute, relative)
                pairs.take(v, side)
            yield _rows(done, batch.schema.types[:width], schema.names)
        if now is not None:
            yield _rows([(*now, *pairs.counts, pairs.matched)], batch.schema.types[:width], schema.names)

    def sided(df: DataFrame, side: int) -> DataFrame:
        return df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"), F.lit(side).alias("__side"))

    both = sided(a, 0).unionByName(sided(b, 1))
    return put_together(both, *keys).sortWithinPartitions(*keys, "__v", "__side").mapInArrow(run, schema)


def lists_of(batch: pa.RecordBatch) -> list[list]:
    """The columns as Python values; whole columns of numbers, truth values and texts go through NumPy, which is faster."""
    out = []
    for c in batch.columns:
        if pa.types.is_string(c.type):
            out.append(c.to_numpy(zero_copy_only=False).tolist())
        elif pa.types.is_integer(c.type) or pa.types.is_floating(c.type) or pa.types.is_boolean(c.type):
            held = c.fill_null(False if pa.types.is_boolean(c.type) else 0) if c.null_count else c
            values = held.to_numpy(zero_copy_only=False)
            if c.null_count:
                values = values.astype(object)
                values[c.is_null().to_numpy(zero_copy_only=False)] = None
            out.append(values.tolist())
        else:
            out.append(c.to_pylist())
    return out


def _rows(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    types = [*kinds, *[pa.int64()] * (len(names) - len(kinds))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


class _Table:
    """One table's cells, told in the order of their places, said before gold: counts of values, places and lines.

    Side 0 is what was read, 1 the gold table.  A cell's value and token are kept until its table ends.
    """

    def __init__(self):
        self.cells, self.heads, self.last_row, self.last_col = [0, 0], [0, 0], [-1, -1], [-1, -1]
        self.hits, self.head_hits, self.places = 0, 0, 0
        self.row, self.place, self.waiting = None, None, deque()
        self.texts, self.rows, self.numbers = (Counter(), Counter()), (Counter(), Counter()), []
        # Tokens of the row and of each column: rounded numbers, and texts.
        self.line, self.columns = ([], [], [], []), defaultdict(lambda: ([], [], [], []))

    def add(self, row, col, side: int, number, rounded, text) -> None:
        self.last_row[side], self.last_col[side] = max(self.last_row[side], row), max(self.last_col[side], col)
        if text == "":
            return
        if row != self.row:
            self._end_row()
            self.row = row
        if (row, col) != self.place:
            self.place = (row, col)
            self.waiting.clear()
        self.cells[side] += 1
        self.heads[side] += row == 0
        if side == 0:
            self.waiting.append((number, text))
            self.places += 1
        elif self.waiting:
            x, said = self.waiting.popleft()
            if said == text if x is None or number is None else abs(x - number) <= TOLERANCE * max(abs(x), abs(number), 1.0):
                self.hits += 1
                self.head_hits += row == 0
        else:
            self.places += 1
        if number is None:
            self.texts[side][text] += 1
            kind, token = side + 2, text
        else:
            self.numbers.append((number, side))
            kind, token = side, rounded
        self.line[kind].append(token)
        self.columns[col][kind].append(token)

    def _end_row(self) -> None:
        _note(self.line, self.rows)
        for tokens in self.line:
            tokens.clear()

    def counts(self) -> tuple:
        """In the order of ``COUNTS``."""
        self._end_row()
        cols = (Counter(), Counter())
        for tokens in self.columns.values():
            _note(tokens, cols)
        pairs = _Pairs(0.0, TOLERANCE)
        for v, side in sorted(self.numbers):
            pairs.take(v, side)
        matched = pairs.matched + sum((self.texts[0] & self.texts[1]).values())
        lines = [n for of in (self.rows, cols) for n in (of[1].total(), (of[0] & of[1]).total())]
        return (*self.cells, self.hits, self.places, *self.heads, self.head_hits, matched, *lines, *(n + 1 for n in (*self.last_row, *self.last_col)))


COUNTS = ("n_said", "n_gold", "hits", "places", "head_said", "head_gold", "head_hits", "matched", "row_lines", "row_hits", "col_lines", "col_hits", "rows_said", "rows_gold", "cols_said", "cols_gold")


def _note(tokens: tuple, into: tuple[Counter, Counter]) -> None:
    """Counts a line of each side by its values in any order."""
    for side in (0, 1):
        if tokens[side] or tokens[side + 2]:
            into[side][tuple(sorted(tokens[side])), tuple(sorted(tokens[side + 2]))] += 1


def table_counts(said: DataFrame, gold: DataFrame, doc: str) -> DataFrame:
    """(doc, ``COUNTS``): cells, hits by place, and matches of values as bags and of rows and columns in any order of their values.

    Both sides' cells are dealt by their table once and stream through a task in the order of their places; one table is
    held at a time.
    """
    schema = T.StructType([gold.schema[doc], *(T.StructField(n, T.LongType()) for n in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, kinds = None, None, None
        for batch in batches:
            kinds = batch.schema.types[:1]
            done = []
            for key, *cell in zip(*lists_of(batch)):
                if table is None or key != now:
                    if table is not None:
                        done.append((now, *table.counts()))
                    now, table = key, _Table()
                table.add(*cell)
            yield _rows(done, kinds, schema.names)
        if table is not None:
            yield _rows([(now, *table.counts())], kinds, schema.names)

    def sided(df: DataFrame, side: int) -> DataFrame:
        parsed = df.select(doc, F.col("row").cast("long"), F.col("col").cast("long"), F.lit(side).alias("__side"), parse_number(F.col("raw")).alias("__number"), "raw")
        text = F.when(F.col("__number").isNull(), plain_text(F.col("raw")))
        return parsed.select(doc, "row", "col", "__side", "__number", F.round("__number", 2).alias("__rounded"), text.alias("__text"))

    both = sided(said, 0).unionByName(sided(gold, 1))
    return put_together(both, doc).sortWithinPartitions(doc, "row", "col", "__side").mapInArrow(run, schema)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def table_scores(said: DataFrame, gold: DataFrame, doc: str = "doc") -> DataFrame:
    """One row a doc of the gold tables: all components of the score."""
    parts = table_counts(said, gold, doc).where("n_gold > 0").withColumns({f"{line}_accuracy": F.col(f"{line}_hits") / F.col(f"{line}_lines") for line in ("row", "col")})

    def share(n: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)

    precision, recall = share("matched", "n_said"), share("matched", "n_gold")
    p_precision, p_recall = share("hits", "n_said"), share("hits", "n_gold")
    d_rows, d_cols = F.abs(F.col("rows_said") - F.col("rows_gold")), F.abs(F.col("cols_said") - F.col("cols_gold"))
    return parts.select(
        doc, F.col("n_gold"), "n_said", precision.alias("content_precision"), recall.alias("content_recall"), _f1(precision, recall).alias("content_f1"), _f1(p_precision, p_recall).alias("positional_f1"),
        F.col("row_accuracy"), F.col("col_accuracy"), F.when(F.col("head_said") + F.col("head_gold") == 0, 1.0).otherwise(_f1(share("head_hits", "head_said"), share("head_hits", "head_gold"))).alias("header_accuracy"),
        ((d_rows == 0) & (d_cols == 0)).alias("shape_exact"), ((d_rows <= 1) & (d_cols <= 1)).alias("shape_near"),
        (F.col("hits") / F.col("places")).alias("structure"), F.greatest(recall - p_recall, F.lit(0.0)).alias("misplacement"),
    )


def corpus_scores(tables: DataFrame) -> DataFrame:
    """One row: content, place, structure and misplacement weighted by gold cells, the others as plain means."""
    exact = lambda c: F.col(c).cast("decimal(12,9)")
    weighted = [(F.sum(exact(c) * F.col("n_gold")).cast("double") / F.sum("n_gold")).alias(c) for c in ("content_precision", "content_recall", "content_f1", "positional_f1", "structure", "misplacement")]
    plain = [(F.sum(exact(c)).cast("double") / F.count("*")).alias(c) for c in ("row_accuracy", "col_accuracy", "header_accuracy")]
    return tables.agg(F.count("*").alias("tables"), F.sum("n_gold").alias("gold_cells"), *weighted, *plain, (F.count_if("shape_exact") / F.count("*")).alias("shape_exact_rate"))
