"""Quality rules as a learned decision list.

Sequential covering over labelled statistics: a rule grows one threshold
condition at a time by information gain on two thirds of the rows, is pruned on
the other third, and stays if its precision there is high enough; the rows that
it covers are put aside and the next rule is grown.  The list is emitted as one
ordered Spark conditional expression.

Learning reads a bounded sample: at most ``max_rows`` labels, those with the
least hash of their id, and of the rows that these ids have as many at most, whose
statistics come to the driver.  Everything
else covers all rows with built-in functions only.

Defined results: labels that are null are left out; repeated labels count as
often as they stand there; no labels, or labels of one class only, give an empty
list, which keeps all rows that the base rules keep; null texts have no words and
fail the base rules; ids may be of any type; other columns pass through, but those
that have the name of a statistic or verdict are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.text_stats import with_stats


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))



def features() -> dict[str, Column]:
    """What conditions can test, as expressions over the statistics."""
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": _ratio("word_chars", "n_words"),
        "symbols_per_char": _ratio("n_symbols", "word_chars"),
        "upper_per_char": _ratio("n_upper", "word_chars"),
        "marks_per_word": _ratio("n_marks", "n_words"),
        "repeated_lines": _ratio("n_dup_lines", "n_lines"),
        "repeated_words": _ratio("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, values: dict[str, Column]) -> Column:
        value = values[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _cuts(rows: list[tuple[dict, bool]], names: list[str]) -> dict[str, list[float]]:
    """Thresholds halfway between neighbouring values whose rows differ in class."""
    out: dict[str, list[float]] = {}
    for name in names:
        classes: dict[float, set] = {}
        for row, y in rows:
            classes.setdefault(row[name], set()).add(y)
        values = sorted(classes)
        out[name] = [(u + v) / 2 for u, v in zip(values, values[1:]) if len(classes[u] | classes[v]) > 1]
    return out


def _grow(rows: list[tuple[dict, bool]], cuts: dict[str, list[float]], most: int) -> Rule:
    rule: list[Condition] = []
    while len(rule) < most:
        p, n = sum(y for _, y in rows), sum(not y for _, y in rows)
        if not n or not p:
            break
        base, best = log2(p / (p + n)), (1e-9, None)
        for name, thresholds in cuts.items():
            # Positives and negatives at or below each threshold, from one pass.
            below = [[0, 0] for _ in range(len(thresholds) + 1)]
            for row, y in rows:
                below[bisect_left(thresholds, row[name])][y] += 1
            q = m = 0
            for t, (bad, good) in zip(thresholds, below):
                m, q = m + bad, q + good
                for above, pos, neg in ((False, q, m), (True, p - q, n - m)):
                    if pos and (gain := pos * (log2(pos / (pos + neg)) - base)) > best[0]:
                        best = (gain, Condition(name, above, t))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if best[1].holds(r[0])]
    return tuple(rule)


def _score(rule: Rule, rows: list[tuple[dict, bool]]) -> tuple[float, int, int]:
    covered = [y for row, y in rows if all(c.holds(row) for c in rule)]
    p = sum(covered)
    return ((p + 1) / (len(covered) + 2), p, len(covered) - p)


def learn(rows: list[tuple[dict, bool]], max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.97, min_cover: int = 8) -> list[Rule]:
    """Rules for the positive class, in order; ``rows`` are (features, positive) in a fixed order."""
    names = sorted(rows[0][0]) if rows else []
    found: list[Rule] = []
    left = rows
    while len(found) < max_rules and any(y for _, y in left) and not all(y for _, y in left):
        growing = [r for i, r in enumerate(left) if i % 3]
        pruning = [r for i, r in enumerate(left) if not i % 3]
        rule = _grow(growing, _cuts(growing, names), max_conditions)
        if not rule:
            break
        # Of the rule's beginnings, the one that is most precise on rows that did not grow it.
        rule = max((rule[: i + 1] for i in range(len(rule))), key=lambda r: (_score(r, pruning)[0], -len(r)))
        precision, p, _ = _score(rule, pruning)
        if p < min_cover or precision < min_precision - 1 / (p + 2):
            break
        found.append(rule)
        left = [r for r in left if not all(c.holds(r[0]) for c in rule)]
    return found


def verdict(rules: list[Rule]) -> Column:
    """True for rows that no rule covers: the list as one ordered conditional expression."""
    values = features()
    out = None
    for rule in rules:
        condition = rule[0].column(values)
        for c in rule[1:]:
            condition &= c.column(values)
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, bad_value: int, max_rows: int, id_col: str, text_col: str) -> list[tuple[dict, bool]]:
    """(features, is bad) of the bounded sample, in the order of the ids' hashes."""
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), (F.col(label_col) == bad_value).alias("__bad"))
    picked = picked.orderBy(F.xxhash64("__id"), "__id", "__bad").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    tested = features()
    order = F.crc32(F.col("__id").cast("string")).alias("__order")
    rows = with_stats(texts.join(F.broadcast(picked), "__id"), "__text").select(order, F.col("__id").cast("string").alias("__id"), "__bad", *(c.alias(n) for n, c in tested.items()))
    # A labelled id may stand on any number of rows: the bound holds for what the labels meet.
    found = sorted(rows.orderBy(*rows.columns).limit(max_rows).collect())
    return [({n: r[n] for n in tested}, r["__bad"]) for r in found]


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", bad_value: int = 0, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[Rule]]:
    """``docs`` with the statistics, ``base_failed`` and ``kept``; and the learned rules."""
    rules = learn(labelled_sample(docs, labels, label_col, bad_value, max_rows, id_col, text_col))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    docs = docs.select(*(c for c in docs.columns if c.lower() not in ("base_failed", "kept")))
    out = with_stats(docs, text_col).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules
