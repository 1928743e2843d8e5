"""Column expressions over text: numbers in cells, labels, checks, extraction."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEVANAGARI = "०१२३४५६७८९"


#: Cells without a digit hold no number, and plain ones are their number: only the others need the steps below.
DIGIT, PLAIN = f"[0-9{DEVANAGARI}]", r"^-?[0-9]+(\.[0-9]+)?\z"


def parse_number(raw: Column) -> Column:
    """The number in a cell: native digits, currency, commas, percent; (x) is negative; else null."""
    s = F.trim(F.translate(raw, DEVANAGARI, "0123456789"))
    plain = F.regexp_replace(s, r"(?i)₹|rs\.?|inr|[,%\s()]", "")
    value = F.regexp_extract(plain, r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    dressed = F.when(s.rlike(r"^\(.*\)$"), -F.abs(value)).otherwise(value)
    return F.when(raw.rlike(PLAIN), raw.try_cast("double")).when(raw.rlike(DIGIT), dressed)


def is_amount(raw: Column) -> Column:
    s = F.regexp_replace(F.translate(raw, DEVANAGARI, "0123456789"), r"(?i)₹|rs\.?|inr|[,%\s()]", "")
    return F.when(raw.rlike(PLAIN), True).when(raw.rlike(DIGIT), s.rlike(r"^-?[0-9]+(\.[0-9]+)?$")).otherwise(False)


#: Line ends of Java's patterns beyond those that \\s takes; digits beyond which a plain number may be too large or too small.
_ENDS, _LONG = "\u0085\u2028\u2029", 300
_DRESS = re.compile(r"₹|rs\.?|inr|[,%\s()]", re.IGNORECASE | re.ASCII)
_BRACKETS, _NUMBER = re.compile(rf"\([^\n\r{_ENDS}]*\)(\r\n|[\n\r{_ENDS}])?\Z"), re.compile(r"-?[0-9]+(?:\.[0-9]+)?")
_AMOUNT = re.compile(rf"-?[0-9]+(\.[0-9]+)?[{_ENDS}]?\Z")


def _dressed(raw: str) -> tuple[float | None, bool]:
    digits = raw.translate(str.maketrans(DEVANAGARI, "0123456789"))
    plain, found = _DRESS.sub("", digits.strip(" ")), None
    if number := _NUMBER.search(plain):
        found = float(number[0])
        if _BRACKETS.match(digits.strip(" ")):
            found = -abs(found)
    return found, _AMOUNT.match(_DRESS.sub("", digits)) is not None


def read_cells(raws: pa.Array) -> tuple[pa.Array, pa.Array]:
    """``parse_number`` and ``is_amount`` of a task's whole batch of cells."""
    plain = pc.fill_null(pc.match_substring_regex(raws, PLAIN), False)
    short = pc.fill_null(pc.less(pc.binary_length(raws), _LONG), False)
    number = pc.if_else(pc.and_(plain, short), raws, pa.scalar(None, pa.string())).cast(pa.float64())
    odd = pc.and_(pc.fill_null(pc.match_substring_regex(raws, DIGIT), False), pc.invert(pc.and_(plain, short)))
    if not pc.any(odd).as_py():
        return number, plain
    read = [_dressed(s) for s in raws.filter(odd).to_pylist()]
    return pc.replace_with_mask(number, odd, pa.array([n for n, _ in read], pa.float64())), pc.replace_with_mask(plain, odd, pa.array([a for _, a in read], pa.bool_()))


def is_total_label(label: Column) -> Column:
    """A short label (six words at most) that names a total, but no sub-total."""
    short = F.size(F.split(F.trim(label), r"\s+")) <= 6
    return F.coalesce(short & F.lower(label).rlike(r"\b(grand total|total|कुल)\b") & ~is_subtotal_label(label), F.lit(False))


def is_subtotal_label(label: Column) -> Column:
    return F.coalesce(F.lower(label).rlike(r"sub[ -]?total|carried|उप"), F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def error_rate(said: Column, gold: Column) -> Column:
    """Character errors over the gold length, case and runs of spaces aside."""

    def plain(c: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))

    return F.when(F.length(plain(gold)) > 0, F.levenshtein(plain(said), plain(gold)) / F.length(plain(gold)))


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(0.0)


def script_of(text: Column) -> Column:
    """latin, devanagari or mixed, by the share of letters of each script."""
    latin = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    native = F.length(F.regexp_replace(text, r"[^\x{0900}-\x{097F}]", ""))
    share = native / F.greatest(latin + native, F.lit(1))
    return F.when(share > 0.9, "devanagari").when(share < 0.1, "latin").otherwise("mixed")


def plain_text(html: Column) -> Column:
    """Markup without script and style bodies, tags and control characters; common entities decoded."""
    s = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    for entity, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(value))
    return F.trim(F.regexp_replace(s, r"[\x00-\x20]+", " "))


def guard_formula(c: Column) -> Column:
    """Quote-prefixes text that a spreadsheet would run."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), c)).otherwise(c)


#: The Verhoeff scheme's multiplication and permutation tables.
VERHOEFF_D = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 2, 3, 4, 0, 6, 7, 8, 9, 5],
    [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
    [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2],
    [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
VERHOEFF_P = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 5, 7, 6, 2, 8, 3, 0, 9, 4],
    [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0],
    [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5],
    [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]


def verhoeff_ok(digits: Column) -> Column:
    """True where a string of digits ends in its Verhoeff check digit; separators are dropped first."""
    plain = F.regexp_replace(digits, r"[^0-9]", "")
    d, p = (F.lit([x for row in table for x in row]) for table in (VERHOEFF_D, VERHOEFF_P))
    places = F.reverse(F.split(plain, ""))
    places = F.transform(F.filter(places, lambda c: c != ""), lambda c, i: F.get(p, (i % 8) * 10 + c.cast("int")))
    return (F.length(plain) > 0) & (F.aggregate(places, F.lit(0), lambda s, x: F.get(d, s * 10 + x)) == 0)


def engine_votes(readings: DataFrame, page: str, engine: str, text: str, least: float = 0.6) -> DataFrame:
    """(page, pairs, agreement, primary_stands): mean agreement of the word sets that a few engines read of a page.

    Words are counted by pairs of engines that both have them, so no pair of readings is compared word by word.
    """
    words = readings.select(page, engine, F.explode(tokens(F.col(text))).alias("__w")).distinct()
    engines = readings.select(page, engine).distinct().join(words.groupBy(page, engine).agg(F.count("*").alias("__n")), [page, engine], "left").fillna(0, ["__n"])
    shared = words.join(words.select(page, "__w", F.col(engine).alias("__other")), [page, "__w"]).where(F.col(engine) < F.col("__other"))
    shared = shared.groupBy(page, engine, "__other").agg(F.count("*").alias("__met"))
    pairs = engines.join(engines.select(page, F.col(engine).alias("__other"), F.col("__n").alias("__m")), page).where(F.col(engine) < F.col("__other"))
    pairs = pairs.join(shared, [page, engine, "__other"], "left").fillna(0, ["__met"])
    union = F.col("__n") + F.col("__m") - F.col("__met")
    mean = F.avg(F.when(union > 0, F.col("__met") / union).otherwise(0.0))
    return pairs.groupBy(page).agg(F.count("*").alias("pairs"), F.round(mean, 9).alias("agreement"), (mean >= least).alias("primary_stands"))
