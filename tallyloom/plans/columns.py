"""What the columns of a table hold: numbers, the money column, and the roles of quantity, rate and amount.

Cells are rows (doc, row, col, raw); the first three rows give a column's header text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import is_amount, read_cells
from tallyloom.sources.shared import put_together

#: Parts of a header that name money, and the words and native terms that name each role.
MONEY = ["amount", "total", "price", "value", "rate", "cost", "राशि", "रकम", "कुल", "योग", "धनराशि", "मूल्य", "दर"]
ROLES = {
    "qty": (["qty", "quantity", "nos", "number"], ["मात्रा", "संख्या", "नग", "परिमाण"]),
    "rate": (["rate", "price"], ["दर", "मूल्य", "प्रति"]),
    "amount": (["amount", "total", "value", "cost"], ["राशि", "रकम", "कुल", "योग", "धनराशि"]),
}
HEADER_ROWS = 3


def _has(header: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | header.contains(part)
    return found


def _changes(*keys: np.ndarray) -> np.ndarray:
    """True where one of the keys differs from the row before; the first row does."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _keys_of(column: pa.Array) -> list[np.ndarray]:
    """A column of numbers as keys of a sort, with one more that sets nulls apart if there are any."""
    if not column.null_count:
        return [column.to_numpy(zero_copy_only=False)]
    return [column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)]


def _lower(texts: pa.Array) -> pa.Array:
    """Lower case; texts beyond ASCII by their whole mapping."""
    wide = pc.fill_null(pc.not_equal(pc.binary_length(texts), pc.utf8_length(texts)), False)
    lower = pc.ascii_lower(texts)
    return pc.replace_with_mask(lower, wide, pa.array([s.lower() for s in texts.filter(wide).to_pylist()], pa.string())) if pc.any(wide).as_py() else lower


def _profiled(rows: pa.Table) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """The doc, col, header, number of header texts, and (numbers, amounts, wins) of each column of whole rows."""
    doc, row, cols, raws = (c.combine_chunks() for c in rows.columns)
    each = pc.list_parent_indices(cols)
    doc, row, col, raw = doc.take(each), row.take(each), cols.flatten(), raws.flatten()
    number, amount = read_cells(raw)
    text = _lower(pc.if_else(pc.less(row, HEADER_ROWS), raw, pa.scalar(None, pa.string())))
    docs = doc.dictionary_encode(null_encoding="encode").indices.to_numpy()
    at = np.lexsort([*_keys_of(col), *_keys_of(row), docs])
    docs, col, text = docs[at], col.take(at), text.take(at)
    rows, cols = [k[at] for k in _keys_of(row)], _keys_of(col)
    has, amounts = number.is_valid().to_numpy(zero_copy_only=False)[at], amount.to_numpy(zero_copy_only=False)[at]
    # Cells of one place (mostly one), and lines.
    place, line = np.cumsum(_changes(docs, *rows, *cols)) - 1, np.cumsum(_changes(docs, *rows)) - 1
    sizes = np.bincount(place)
    # The first place of a line's largest number.
    told = np.flatnonzero(has)
    values = number.fill_null(0.0).to_numpy(zero_copy_only=False)[at][told]
    first = _changes(line[told])
    best = np.maximum.reduceat(values, np.flatnonzero(first))[np.cumsum(first) - 1] if len(told) else values
    largest = told[(values == best) & (cols[1][told] if len(cols) > 1 else True)]
    winners = largest[_changes(line[largest])]
    # Columns; cells of one column stay in the order of their rows.
    by_col = np.lexsort([*cols, docs])
    opens = _changes(docs[by_col], *(k[by_col] for k in cols))
    starts = np.flatnonzero(opens)
    column = np.empty(len(at), np.int64)
    column[by_col] = np.cumsum(opens) - 1
    wins = np.zeros(len(starts), np.int64)
    np.add.at(wins, column[winners], sizes[place[winners]])
    counts = np.stack([np.add.reduceat(x[by_col].astype(np.int64), starts) for x in (has, amounts)] + [wins], axis=1)
    heads = by_col[text.is_valid().to_numpy(zero_copy_only=False)[by_col]]
    texts, n_texts = text.take(heads), np.bincount(column[heads], minlength=len(starts))
    if (sizes > 1).any():
        # Texts of one place stand in their own order.
        places, said = place[heads].tolist(), texts.to_pylist()
        ranks = {p: i for i, p in enumerate(dict.fromkeys(places))}
        texts = pa.array([s for _, s in sorted(zip((ranks[p] for p in places), said))], pa.string())
    header = pc.binary_join(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n_texts)]).astype(np.int32), texts), " ")
    return doc.take(at).take(by_col[starts]), col.take(by_col[starts]), header, n_texts, counts


class _Open:
    """The columns of the table that the rows so far end in; its next rows may follow."""

    def __init__(self, doc):
        self.doc, self.columns = doc, {}

    def add(self, col, header: str, n_texts: int, counts: np.ndarray) -> None:
        texts, before = self.columns.setdefault(col, ([], np.zeros(3, np.int64)))
        if n_texts:
            texts.append(header)
        before += counts

    def rows(self, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
        counts = [c for _, c in self.columns.values()]
        columns = [[self.doc] * len(counts), list(self.columns), [" ".join(texts) for texts, _ in self.columns.values()], *([int(c[i]) for c in counts] for i in range(3))]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names=names)


def profiles(cells: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, col, header, numbers, amounts, wins): cells with a number, cells that are amounts, and rows whose largest number the column has (the first of equals).

    Cells are dealt by their table once.
    """
    ordered = put_together(cells.select(doc, "row", "col", "raw"), doc).sortWithinPartitions(doc, "row")
    return profiles_of_rows(ordered.select(doc, "row", F.array("col").alias("cols"), F.array("raw").alias("raws")), doc)


def profiles_of_rows(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """``profiles`` of rows (doc, row, cols, raws: arrays of one length) that come dealt: a table's in one partition, one after another.

    They stream through a task; what is held is a batch, a row and a table's columns.
    """
    col = rows.schema["cols"].dataType.elementType
    schema = T.StructType([rows.schema[doc], T.StructField("col", col), T.StructField("header", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("numbers", "amounts", "wins"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, waiting, table = None, [], None

        def told_of(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            # All tables but the last are whole; the first may have begun before.
            nonlocal table
            docs, cols, headers, n_texts, counts = _profiled(whole)
            if not len(docs):
                return
            begins = np.flatnonzero(_changes(docs.dictionary_encode(null_encoding="encode").indices.to_numpy())).tolist()
            ends = [*begins[1:], len(docs)]
            for i in dict.fromkeys((0, len(begins) - 1)):
                key = docs[begins[i]].as_py()
                if i and len(begins) > 2:
                    inner = slice(begins[1], begins[-1])
                    yield pa.RecordBatch.from_arrays([docs[inner], cols[inner], headers[inner], *(pa.array(n) for n in counts[inner].T)], names=schema.names)
                if table is None or key != table.doc:
                    if table is not None:
                        yield table.rows(types, schema.names)
                    table = _Open(key)
                for j in range(begins[i], ends[i]):
                    table.add(cols[j].as_py(), headers[j].as_py(), int(n_texts[j]), counts[j])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.types[0], batch.schema.types[2].value_type, pa.string(), pa.int64(), pa.int64(), pa.int64()]
            # The last row's cells may go on in the next batch.
            rows = _changes(batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(), *_keys_of(batch.column(1)))
            last = int(np.flatnonzero(rows)[-1])
            same = last == 0 and waiting and all(batch.column(i)[0] == waiting[-1].column(i)[-1] for i in (0, 1))
            if not same:
                if waiting and last == 0:
                    yield from told_of(pa.Table.from_batches(waiting))
                    waiting = []
                elif last:
                    yield from told_of(pa.Table.from_batches([*waiting, batch.slice(0, last)]))
                    waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield from told_of(pa.Table.from_batches(waiting))
        if table is not None:
            yield table.rows(types, schema.names)

    return rows.select(doc, "row", "cols", "raws").mapInArrow(run, schema)


def _money(least: int) -> tuple[Column, Column]:
    """The best column as (col, r) over a table's profiles, and the most numbers of any."""
    able = F.col("numbers") >= least
    named = able & _has(F.col("header"), MONEY)
    rank = F.when(named, F.struct(F.lit(2).alias("a"), F.col("col").cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("d"))).when(
        able & (F.col("wins") > 0), F.struct(F.lit(1).alias("a"), F.col("wins").alias("b"), F.col("numbers").alias("c"), (-F.col("col")).cast("long").alias("d"))
    ).otherwise(F.struct(F.lit(0).alias("a"), F.col("numbers").alias("b"), F.lit(0).cast("long").alias("c"), (-F.col("col")).cast("long").alias("d")))
    return F.max_by(F.struct("col", rank.alias("r")), rank), F.max("numbers")


def amount_column(found: DataFrame, doc: str = "doc", least: int = 3) -> DataFrame:
    """(doc, col, by) from ``profiles``: the rightmost column whose header names money, else the one that most often has a row's largest number, else the one with most numbers."""
    best, most = _money(least)
    chosen = found.groupBy(doc).agg(best.alias("x"), most.alias("__most")).where(F.col("__most") >= least)
    by = F.when(F.col("x.r.a") == 2, "header").when(F.col("x.r.a") == 1, "largest").otherwise("most numbers")
    return chosen.select(doc, F.col("x.col").alias("col"), by.alias("by"))


def _roles(least: int) -> list[Column]:
    """The column of each role over a table's profiles, null if none or in tables of fewer than three columns."""
    words = F.split("header", r"[^\p{L}\p{M}\p{N}_]+")
    out = []
    for role, (english, native) in ROLES.items():
        meant = (F.col("amounts") >= least) & (F.arrays_overlap(words, F.array(*map(F.lit, english))) | _has(F.col("header"), native))
        out.append(F.when(F.max("col") >= 2, (F.max if role == "amount" else F.min)(F.when(meant, F.col("col")))).alias(role))
    return out


def roles(found: DataFrame, doc: str = "doc", least: int = 2) -> DataFrame:
    """(doc, qty, rate, amount) from ``profiles``: the first column of each role by its header (of amounts the last), null if none."""
    return found.groupBy(doc).agg(*_roles(least))


def tabular(cells: DataFrame, doc: str = "doc", most_words: int = 15) -> DataFrame:
    """(doc, rows, emit, tabular): whether a grid has more than one filled cell, and whether it is a table and no prose.

    A table has three filled rows and two columns or more, and either two columns with two amounts each, or half of its
    rows (two at least) with two filled cells and cells of fewer than ``most_words`` words on average.
    """
    filled = F.trim(F.coalesce("raw", F.lit(""))) != ""
    words = F.size(F.filter(F.split(F.coalesce("raw", F.lit("")), r"\s+"), lambda w: w != ""))
    rows = cells.groupBy(doc, "row").agg(F.count("*").alias("cells"), F.count_if(filled).alias("filled"), F.sum(words).alias("words"), F.max("col").alias("last")).where("filled > 0")
    per = rows.groupBy(doc).agg(F.count("*").alias("rows"), F.sum("filled").alias("filled"), (F.max("last") + 1).alias("cols"), F.count_if(F.col("filled") >= 2).alias("several"), (F.sum("words") / F.sum("cells")).alias("mean"))
    numeric = cells.where(is_amount(F.col("raw"))).groupBy(doc, "col").agg(F.count("*").alias("n")).where("n >= 2").groupBy(doc).agg(F.count("*").alias("numeric"))
    both = cells.select(doc).distinct().join(per, doc, "left").join(numeric, doc, "left").fillna(0, ["rows", "filled", "cols", "several", "numeric"])
    dense = (F.col("several") >= F.greatest(F.lit(2.0), 0.5 * F.col("rows"))) & (F.col("mean") < most_words)
    table = (F.col("rows") >= 3) & (F.col("cols") >= 2) & ((F.col("numeric") >= 2) | F.coalesce(dense, F.lit(False)))
    return both.select(doc, "rows", (F.col("filled") > 1).alias("emit"), table.alias("tabular"))


def uncertain(tables: DataFrame, found: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, reason, money, qty, rate, amount) of the ``tables`` (route, low, flags) that a trusted sheet may replace.

    Every table of a scanned page, and any other that carries flags; ``found`` are the ``profiles`` of their cells.
    """
    scanned = F.col("route").startswith("scanned")
    reason = F.when(scanned & F.col("low"), "scanned_low_conf").when(scanned, "scanned_table").when(F.col("flags") > 0, "tieout_flags")
    marked = tables.select(doc, reason.alias("reason")).where("reason IS NOT NULL")
    # One grouping of the profiles gives both the money column and the roles.
    best, most = _money(3)
    told = found.groupBy(doc).agg(F.when(most >= 3, best["col"]).alias("money"), *_roles(2))
    return marked.join(told, doc, "left").select(doc, "reason", "money", *ROLES)
