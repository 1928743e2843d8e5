"""Verification of tables of cells: arithmetic, totals, repairs, scores.

Cells are rows (doc, row, column, raw or value); a bill is one doc.  Everything is
grouped by the bill or a key within it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import is_amount, parse_number

#: Letters that scanners take for digits.
GLYPHS = [("O", "0"), ("o", "0"), ("l", "1"), ("I", "1"), ("S", "5"), ("B", "8"), ("Z", "2")]


def row_mismatch(qty: Column, rate: Column, amount: Column) -> Column:
    """True where quantity times rate misses the amount by more than 1 and 0.5 %."""
    return F.abs(qty * rate - amount) > F.greatest(F.lit(1.0), F.abs(amount) * 0.005)


def rounding_tolerance(n: Column, floor: float = 1.0, per_row: float = 0.5) -> Column:
    return F.greatest(F.lit(floor), F.ceil(F.greatest(n, F.lit(1)) * per_row))


def tie_out(lines: DataFrame, doc: str, order: str, amount: str, is_total: str) -> DataFrame:
    """Each total row with the sum of the rows since the total before it, and the gap."""
    w = Window.partitionBy(doc).orderBy(order)
    section = F.coalesce(F.sum(F.col(is_total).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = lines.withColumn("section", section).groupBy(doc, "section").agg(
        F.sum(F.when(~F.col(is_total), F.col(amount))).alias("added"), F.max(F.when(F.col(is_total), F.col(amount))).alias("stated"), F.count_if(~F.col(is_total)).alias("n")
    )
    gap = F.col("stated") - F.col("added")
    return grouped.where("stated IS NOT NULL AND n > 0").withColumn("gap", gap).withColumn("flagged", F.abs("gap") > rounding_tolerance(F.col("n")))


def stitch(fragments: DataFrame, doc: str, page: str, width: str, ended: str) -> DataFrame:
    """Numbers the logical tables: a fragment goes on with the one on the page before if the width is equal and no total ended it."""
    w = Window.partitionBy(doc).orderBy(page)
    goes_on = (F.col(page) - F.lag(page).over(w) == 1) & (F.col(width) == F.lag(width).over(w)) & ~F.lag(ended).over(w)
    marked = fragments.withColumn("__new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    return marked.withColumn("table_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def repaired(cell: Column) -> Column:
    """Digits read for look-alike letters, as a number; null if that gives none."""
    return F.translate(cell, "".join(a for a, _ in GLYPHS), "".join(b for _, b in GLYPHS)).try_cast("double")


def repair_row(qty: Column, rate: Column, amount: Column) -> Column:
    """Readings of a row's cells (as they are, or repaired) that make its arithmetic right with the fewest changes.

    Null if none does, or if different readings do with equally few.
    """

    def readings(c: Column) -> Column:
        plain = c.try_cast("double")
        both = F.array(F.struct(plain.alias("v"), F.lit(0).alias("n")), F.struct(F.when(plain.isNull(), repaired(c)).alias("v"), F.lit(1).alias("n")))
        return F.filter(both, lambda r: r["v"].isNotNull())

    def triples(x: Column) -> Column:
        three = lambda q, r, a: F.struct((q["n"] + r["n"] + a["n"]).alias("n"), q["v"].alias("qty"), r["v"].alias("rate"), a["v"].alias("amount"))
        return F.flatten(F.transform(x["q"], lambda q: F.flatten(F.transform(x["r"], lambda r: F.transform(x["a"], lambda a: three(q, r, a))))))

    # Each array is named once by a one-element array around it, else every use would compute it again.
    read = F.array(F.struct(readings(qty).alias("q"), readings(rate).alias("r"), readings(amount).alias("a")))
    right = F.transform(read, lambda x: F.array_distinct(F.filter(triples(x), lambda t: ~row_mismatch(t["qty"], t["rate"], t["amount"]))))
    found = F.transform(right, lambda ts: F.struct(ts.alias("ts"), F.array_min(F.transform(ts, lambda t: t["n"])).alias("best")))
    fewest = F.transform(found, lambda f: F.filter(f["ts"], lambda t: t["n"] == f["best"]))
    return F.transform(fewest, lambda ts: F.when(F.size(ts) == 1, ts[0]))[0]


#: Characters that are read for digits, each with its digit.
LOOK_ALIKES = {"O": "0", "o": "0", "D": "0", "Q": "0", "l": "1", "I": "1", "|": "1", "i": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "B": "8", "g": "9", "b": "6", "T": "7", "A": "4", "G": "6"}


def cell_readings(cell: Column, most: int = 2) -> Column:
    """array of (value, changes): the cell as it is read, and with one or more of its look-alikes (``most`` at most) as digits."""
    pairs = F.create_map(*[F.lit(x) for pair in LOOK_ALIKES.items() for x in pair])
    chars = F.split(cell, "")
    odd = F.filter(F.transform(chars, lambda c, i: F.when(pairs[c].isNotNull(), i)), lambda i: i.isNotNull())
    one = F.transform(odd, lambda i: F.array(i))
    # Every subset of the places, from the empty one up; a cell has ``most`` of them at most.
    grown = F.aggregate(odd, F.array(F.array().cast("array<int>")), lambda sets, i: F.concat(sets, F.transform(sets, lambda s: F.concat(s, F.array(i)))))
    sets = F.when(F.size(odd) > most, F.array().cast("array<array<int>>")).otherwise(F.filter(grown, lambda s: F.size(s) > 0)) if most > 2 else F.when(F.size(odd) > most, F.array().cast("array<array<int>>")).when(F.size(odd) == 2, F.concat(one, F.array(odd))).otherwise(one)
    as_digits = lambda at: F.array_join(F.transform(chars, lambda c, i: F.when(F.array_contains(at, i), pairs[c]).otherwise(c)), "")
    variants = F.transform(sets, lambda at: F.array(F.struct(as_digits(at).alias("s"), F.size(at).alias("changes"))))
    read = F.transform(F.flatten(variants), lambda v: F.struct(F.when(is_amount(v["s"]), parse_number(v["s"])).alias("value"), v["changes"].alias("changes")))
    plain = F.array(F.struct(parse_number(cell).alias("value"), F.lit(0).alias("changes")))
    return F.filter(F.concat(plain, read), lambda r: r["value"].isNotNull())


def merged_numbers(cell: Column, share: float = 0.6) -> Column:
    """True for a cell that holds two different numbers or more, which are three fifths of its words at least."""
    words = F.filter(F.split(cell, r"\s+"), lambda w: w != "")
    numbers = F.filter(words, lambda w: is_amount(w))
    merged = (F.size(F.array_distinct(F.transform(numbers, lambda w: F.round(parse_number(w), 4)))) >= 2) & (F.size(numbers) >= share * F.size(words))
    # Most cells are one word: only longer ones are taken apart.
    return F.when(cell.rlike(r"\S\s+\S"), merged).when(cell.isNotNull(), F.lit(False))


def misread(qty: Column, rate: Column, amount: Column) -> Column:
    """True for cells that all hold numbers and whose arithmetic fails."""
    q, r, a = parse_number(qty), parse_number(rate), parse_number(amount)
    return F.coalesce(row_mismatch(q, r, a), F.lit(False))


def repair_look_alikes(qty: Column, rate: Column, amount: Column) -> Column:
    """struct(qty, rate, amount) that makes a wrong row's arithmetic right with the fewest look-alikes read as digits.

    Null where the row is right as it stands, a cell has no number, nothing helps, or different values do with equally few.
    """
    read = F.array(F.struct(cell_readings(qty).alias("q"), cell_readings(rate).alias("r"), cell_readings(amount).alias("a"), parse_number(qty).alias("q0"), parse_number(rate).alias("r0"), parse_number(amount).alias("a0")))
    three = lambda q, r, a: F.struct((q["changes"] + r["changes"] + a["changes"]).alias("changes"), F.struct(q["value"].alias("qty"), r["value"].alias("rate"), a["value"].alias("amount")).alias("row"))
    every = lambda x: F.flatten(F.transform(x["q"], lambda q: F.flatten(F.transform(x["r"], lambda r: F.transform(x["a"], lambda a: three(q, r, a))))))
    wrong = lambda x: x["q0"].isNotNull() & x["r0"].isNotNull() & x["a0"].isNotNull() & row_mismatch(x["q0"], x["r0"], x["a0"])
    right = F.transform(read, lambda x: F.when(wrong(x), F.filter(every(x), lambda t: (t["changes"] > 0) & ~row_mismatch(t["row"]["qty"], t["row"]["rate"], t["row"]["amount"]))))
    named = F.transform(right, lambda ts: F.struct(ts.alias("ts"), F.array_min(F.transform(ts, lambda t: t["changes"])).alias("best")))
    fewest = F.transform(named, lambda n: F.array_distinct(F.transform(F.filter(n["ts"], lambda t: t["changes"] == n["best"]), lambda t: t["row"])))
    return F.transform(fewest, lambda rows: F.when(F.size(rows) == 1, rows[0]))[0]


def piecewise(df: DataFrame, value: str, points: list[tuple[float, float]], name: str) -> DataFrame:
    """``df`` with the value mapped through the points' straight segments, clamped at both ends."""
    first, last = points[0], points[-1]
    out = F.when(F.col(value) <= first[0], F.lit(first[1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(F.col(value) <= x1, y0 + (F.col(value) - x0) * ((y1 - y0) / (x1 - x0)))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), out.otherwise(F.lit(last[1]))))


def sides(said: DataFrame, gold: DataFrame, columns: list[str]) -> DataFrame:
    """Both sides' rows in one table: ``__a`` is 1 for what was said, ``__b`` for the gold."""
    n = lambda a, b: (F.lit(a).alias("__a"), F.lit(b).alias("__b"))
    return said.select(*columns, *n(1, 0)).unionByName(gold.select(*columns, *n(0, 1)))


def cell_scores(said: DataFrame, gold: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per doc (the first key): precision, recall and F1 of cells at the right place."""
    return place_scores(sides(said, gold, [*keys, value]), keys, value)


def place_scores(both: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``cell_scores`` of ``sides``; rows that are dealt by their doc stay so."""
    doc, told = keys[0], F.col(value).isNotNull()
    # Each cell said at a place meets each gold one there.
    per = both.groupBy(*keys, value).agg(F.sum("__a").alias("a"), F.sum("__b").alias("b")).groupBy(*keys).agg(
        F.sum(F.when(told, F.col("a") * F.col("b")).otherwise(0)).alias("hits"), F.sum(F.when(told, F.col("a")).otherwise(0)).alias("said"), F.sum(F.when(told, F.col("b")).otherwise(0)).alias("gold"), F.sum("a").alias("__a"), F.sum("b").alias("__b")
    )
    placed = reduce(and_, (F.col(k).isNotNull() for k in keys))
    met = lambda n, others: F.sum(F.when(placed, F.col(n) * F.greatest(others, F.lit(1))).otherwise(F.col(n))).alias(n)
    n = per.groupBy(doc).agg(F.sum(F.when(placed, F.col("hits")).otherwise(0)).alias("hits"), met("said", F.col("__b")), met("gold", F.col("__a")))
    return n.withColumn("f1", F.when(F.col("said") + F.col("gold") > 0, 2 * F.col("hits") / (F.col("said") + F.col("gold"))))


def calibration(pairs: DataFrame, confidence: str, wrong: str) -> DataFrame:
    """Ten bins of confidence: rows, mean confidence, error rate."""
    bin_ = F.least(F.floor(F.col(confidence) * 10), F.lit(9)).cast("int")
    return pairs.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), (F.count_if(F.col(wrong)) / F.count("*")).alias("error_rate"))


def lowest_gate(pairs: DataFrame, confidence: str, wrong: str, target: float, least: int) -> DataFrame:
    """The lowest confidence from which at least ``least`` rows have an error rate within the target.

    Rows are summed by confidence and those sums by thousandths of it, so that running sums over distinct
    confidences are taken within a thousandth, on top of what lies above it.
    """
    sums = pairs.groupBy(confidence).agg(F.count("*").alias("n"), F.count_if(F.col(wrong)).alias("e")).withColumn("__part", F.floor(F.least(F.greatest(F.col(confidence), F.lit(0)), F.lit(1)) * 1000))
    above = Window.orderBy(F.col("__part").desc()).rowsBetween(Window.unboundedPreceding, -1)  # 1001 rows at most
    parts = sums.groupBy("__part").agg(F.sum("n").alias("__n"), F.sum("e").alias("__e"))
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__n"), F.coalesce(F.sum("__e").over(above), F.lit(0)).alias("__e"))
    w = Window.partitionBy("__part").orderBy(F.col(confidence).desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = sums.join(F.broadcast(parts), "__part").select(confidence, (F.sum("n").over(w) + F.col("__n")).alias("n"), (F.sum("e").over(w) + F.col("__e")).alias("e"))
    return run.where((F.col("n") >= least) & (F.col("e") / F.col("n") <= target)).agg(F.min(confidence).alias("gate"))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in pairs)))


def fill_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Empty cells (doc, row, col, raw) of a merged range (doc, r0, r1, c0, c1) take its first cell's value."""
    anchors = ranges.join(cells.select("doc", F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("raw").alias("anchor")), ["doc", "r0", "c0"])
    covered = anchors.select("doc", F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1", "anchor").select("doc", "row", F.explode(F.sequence("c0", "c1")).alias("col"), "anchor")
    return cells.join(covered, ["doc", "row", "col"], "left").select("doc", "row", "col", F.coalesce("raw", "anchor").alias("raw"))


def completeness(signals: DataFrame, gate: float, strict: Column) -> DataFrame:
    """``signals`` (orphans, gaps, dropped, errored, confidence, failed) with status, reasons and outcome.

    Any signal sends a document to review; where ``strict`` holds it is withheld then, else committed with its flags.
    """
    counted = [("orphans", "unplaced rows"), ("gaps", "tables fail the tie-out"), ("dropped", "pages not read"), ("errored", "pages with errors")]
    said = lambda c, what: (F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {what}")))
    pairs = [*(said(c, what) for c, what in counted), (F.col("confidence") < gate, F.lit("mean confidence below the gate")), said("failed", "checks fail")]
    why = F.array_compact(F.array(*(F.when(c, what) for c, what in pairs)))
    clean = F.size(why) == 0
    outcome = F.when(clean, "commit").when(strict, "withhold").otherwise("commit with flags")
    return signals.withColumns({"status": F.when(clean, "AUTO_ACCEPT").otherwise("NEEDS_REVIEW"), "reasons": F.array_join(why, "; "), "outcome": outcome})
