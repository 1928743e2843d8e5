"""Statistics of whole texts as native column expressions.

Words are runs of bytes other than ASCII white space.  All steps are built-in
functions; those that a text needs more than once are named columns, so Spark
computes them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACES, named_again, numbered, text_of

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!?"
#: Prefix of working columns.
_P = "__stats_"


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), lambda w: w != "")


STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def with_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_marks (all long).

    They replace input columns of their names; all others pass through.
    n_repeat_words counts the words in three-word windows found twice or more in
    the text, first ones included: window hashes are sorted with their places,
    places of equal neighbours are kept, and each adds what it covers beyond the
    one before.
    """
    text, words, windows, ranked = (F.col(_P + x) for x in ("text", "words", "windows", "ranked"))
    blank = F.translate(text, SPACES, "")
    out = numbered(df).withColumn(_P + "text", text_of(f"in_{df.columns.index(text_col)}")).withColumn(_P + "words", words_of(F.col(_P + "text")))
    out = out.withColumn(_P + "lines", F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    indices = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn(_P + "windows", F.transform(indices, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])))
    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    out = out.withColumn(_P + "ranked", F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.array_sort(placed)))
    # get() gives null outside the array, and a null neighbour is not an equal one.
    twice = F.filter(ranked, lambda x, i: F.coalesce(x["h"] == F.get(ranked, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ranked, i + 1)["h"], F.lit(False)))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["at"])),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total")),
        lambda s, at: F.struct(at.alias("last"), (s["total"] + F.least(F.lit(3), at - s["last"])).alias("total")),
        lambda s: s["total"],
    )
    lines = F.col(_P + "lines")
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(blank).cast("long"),
            "n_symbols": count_chars(text, SYMBOLS),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_upper": count_chars(text, UPPER),
            "n_marks": count_chars(text, MARKS),
        }
    )
    return out.select(*named_again(df.columns, *STATS))
