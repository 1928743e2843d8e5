"""Trusted tables against noisy ones: row alignment, context, trust gates, link assignment.

Trusted rows are (keys, i, amount, rate, qty) with numbers, noisy ones (keys, j, page, amount_raw, rate_raw, qty_raw)
with what a scanner read; i and j count from 0 in reading order within the keys (a document, or a file's sheet and
table).  ``aligned`` puts both sides together by their keys once and scores them in the task that holds a key
(``plans.alignment``).  The steps by joins compare rows of equal content once, under the least place of their kind, and
only rows that share an amount, rate or quantity (in value, or in look-alike digits) meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import parse_number
from tallyloom.plans import alignment
from tallyloom.plans.alignment import ALIKE, ANCHOR_REPEATS, ANCHOR_SCORE, GATE, NEAR, SAME, SLACK, WEIGHTS, longest_rising
from tallyloom.plans.verify import LOOK_ALIKES
from tallyloom.sources.shared import put_together

SCORE = "decimal(9,6)"


def digits_of(value: Column) -> Column:
    """The significant digits of a number of two decimals: 3000.00 gives 3000, 12.50 gives 125."""
    return F.translate(F.rtrim(F.rtrim(value.cast("decimal(18,2)").cast("string"), F.lit("0")), F.lit(".")), "-.", "")


def _letters(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[^0-9A-Za-z|]", "")


def look_alike_digits(raw: Column) -> Column:
    """The cell's digits with look-alikes read as digits; null if it holds any other letter or nothing."""
    digits = F.translate(_letters(raw), "".join(LOOK_ALIKES), "".join(LOOK_ALIKES.values()))
    return F.when(digits.rlike("^[0-9]+$"), digits)


def number_match(value: Column, raw: Column, most: int = 2) -> Column:
    """1 within 1 of the value, 0.9 within 1 %, 0.7 if ``most`` or fewer look-alikes give its digits, else 0; null without a value."""
    return _matched(value.cast("double"), digits_of(value), parse_number(raw), _alike(raw, most))


def _alike(raw: Column, most: int = 2) -> Column:
    """``look_alike_digits`` where so many letters or fewer had to be read as digits, else null."""
    return F.when(F.length(F.regexp_replace(_letters(raw), "[0-9]", "")) <= most, look_alike_digits(raw))


def _matched(v: Column, own: Column, p: Column, alike: Column) -> Column:
    """``number_match`` from what each side's cell was parsed to."""
    off = F.abs(v - p)
    score = F.when(off <= 1.0, SAME).when(off <= 0.01 * F.greatest(F.abs(v), F.abs(p), F.lit(1.0)), NEAR).when(alike == own, ALIKE).otherwise(0.0)
    return F.when(v.isNotNull(), score)


def _parsed(rows: DataFrame) -> DataFrame:
    """``rows`` with the numbers and digits of the roles that they have: a cell is parsed once, not once a pair."""
    for role in WEIGHTS:
        value, raw = F.col(role), F.col(f"{role}_raw")
        if role in rows.columns:
            rows = rows.withColumns({f"__v_{role}": value.cast("double"), f"__own_{role}": digits_of(value)})
        if f"{role}_raw" in rows.columns:
            rows = rows.withColumns({f"__p_{role}": parse_number(raw), f"__alike_{role}": _alike(raw)})
    return rows


def _pair_match(role: str) -> Column:
    """The match of ``_parsed`` rows that met."""
    return _matched(*(F.col(f"__{c}_{role}") for c in ("v", "own", "p", "alike")))


def row_score(roles: tuple[str, ...] = tuple(WEIGHTS), match: Callable[[str], Column] = lambda role: number_match(F.col(role), F.col(f"{role}_raw"))) -> Column:
    """The matches of ``roles`` weighted over all columns that the trusted row has; other roles count as 0."""
    gained, possible = F.lit(0.0), F.lit(0.0)
    for role, weight in WEIGHTS.items():
        if role in roles:
            gained = gained + weight * F.coalesce(match(role), F.lit(0.0))
        possible = possible + F.when(F.col(role).isNotNull(), weight).otherwise(0.0)
    return F.when(possible > 0, F.round(gained / possible, 6)).otherwise(0.0).cast(SCORE)


def _bucket(v: Column) -> Column:
    """Values within 1, or within 1 % beyond 100, fall into the same bucket or neighbours."""
    size = F.abs(v)
    return F.floor(F.signum(v) * F.when(size <= 100, size).otherwise(100 + 100 * F.ln(size / 100)) / 2)


def _meeting(trusted: DataFrame, noisy: DataFrame, keys: list[str], role: str) -> DataFrame:
    """``_parsed`` trusted kinds with noisy ones that may match in one column; a pair can come twice."""
    b, p = _bucket(F.col(f"__v_{role}")), _bucket(F.col(f"__p_{role}"))
    # Hashes: what meets by a collision is told apart by its score.
    value, digits = (lambda x: F.xxhash64(F.lit("v"), x)), (lambda x: F.xxhash64(F.lit("d"), x))
    own = F.array(value(b), digits(F.col(f"__own_{role}")))
    read = F.array(*(F.when(p.isNotNull(), value(p + k)) for k in (-1, 0, 1)), F.when(F.col(f"__alike_{role}").isNotNull(), digits(F.col(f"__alike_{role}"))))
    left = trusted.where(F.col(role).isNotNull()).withColumn("__key", F.explode(own))
    right = noisy.withColumn("__key", F.explode(F.array_compact(read)))
    return left.join(right, [*keys, "__key"]).drop("__key")


def _kinds(rows: DataFrame, keys: list[str], columns: list[str], place: str) -> DataFrame:
    """``rows`` with ``kind``, the least place of a row with equal content."""
    return rows.withColumn("kind", F.min(place).over(Window.partitionBy(*keys, *columns)))


RAW = [f"{role}_raw" for role in WEIGHTS]


def scored_pairs(trusted: DataFrame, noisy: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, score) of kinds of rows whose amounts match."""
    t = _kinds(trusted, keys, list(WEIGHTS), "i").where("i = kind").select(*keys, "i", *WEIGHTS)
    n = _kinds(noisy, keys, RAW, "j").where("j = kind").select(*keys, "j", *RAW)
    met = _meeting(_parsed(t), _parsed(n), keys, "amount").where(_pair_match("amount") > 0)
    return met.select(*keys, "i", "j", row_score(match=_pair_match).alias("score")).dropDuplicates([*keys, "i", "j"])


def best_scores(trusted: DataFrame, noisy: DataFrame, keys: list[str], pairs: DataFrame) -> DataFrame:
    """(keys, i, best) of every trusted row: its best score against any noisy row."""
    every = _kinds(trusted, keys, list(WEIGHTS), "i")
    t = _parsed(every.where("i = kind").select(*keys, "i", *WEIGHTS))
    by_rate = _meeting(t, _parsed(noisy.select(*keys, "rate_raw", "qty_raw").distinct()), keys, "rate").select(*keys, "i", row_score(("rate", "qty"), _pair_match).alias("score"))
    by_qty = _meeting(t, _parsed(noisy.select(*keys, "qty_raw").distinct()), keys, "qty").select(*keys, "i", row_score(("qty",), _pair_match).alias("score"))
    found = pairs.select(*keys, "i", "score").unionByName(by_rate).unionByName(by_qty)
    best = found.groupBy(*keys, F.col("i").alias("kind")).agg(F.max("score").alias("best"))
    return every.select(*keys, "i", "kind").join(best, [*keys, "kind"], "left").select(*keys, "i", F.coalesce("best", F.lit(0).cast(SCORE)).alias("best"))


def mutual_anchors(trusted: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j): pairs that are best for both sides, score enough, and whose amount is rare among the trusted rows."""
    by_i = Window.partitionBy(*keys, "i").orderBy(F.col("score").desc(), "j")
    by_j = Window.partitionBy(*keys, "j").orderBy(F.col("score").desc(), "i")
    best = pairs.withColumn("__i", F.row_number().over(by_i)).withColumn("__j", F.row_number().over(by_j)).where(f"__i = 1 AND __j = 1 AND score >= {ANCHOR_SCORE}")
    amount = F.round(F.col("amount"), 2)
    rare = trusted.where("amount IS NOT NULL").withColumn("__n", F.count("*").over(Window.partitionBy(*keys, amount))).where(f"__n <= {ANCHOR_REPEATS}")
    return best.select(*keys, "i", "j").join(rare.select(*keys, "i"), [*keys, "i"], "left_semi")


def rising_rows(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, order, value): the rows of a longest strictly rising subsequence of each key's values.

    A key's rows stream through a task in their order, which holds two numbers and a link for each row of the key.
    """
    out = T.StructType([df.schema[c] for c in (*keys, order, value)])
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:width] != held[0][:width]:
                    done += longest_rising(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(batch.schema)], names=batch.schema.names)
        if held:
            done = longest_rising(held)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(batch.schema)], names=batch.schema.names)

    rows = df.where(F.col(value).isNotNull()).select(*keys, order, value)
    return put_together(rows, *keys).sortWithinPartitions(*keys, order).mapInArrow(run, out)


def aligned(trusted: DataFrame, noisy: DataFrame, keys: list[str], linked: tuple[str, str] | None = None) -> DataFrame:
    """(keys, i, j, page, anchored, best, method, n_trusted, n_noisy, on_page): the noisy row that each trusted row stands for.

    Between anchors places are shared out in proportion.  Where anchors are too few the counts must agree within
    ``SLACK`` and rows are taken in order (``count_order``), else the keys fail and j and page are null.  ``on_page``
    counts the noisy rows of the page.  With ``linked``, columns of one type that name parts of the trusted and of the noisy
    rows, each part is aligned with each one of its keys that it shares a row with whose amount matches; both names follow
    the keys, and places are numbered within the part.
    """
    kinds = {"i": T.LongType(), "j": T.LongType(), "page": T.LongType(), "anchored": T.BooleanType(), "best": T.LongType(), "method": T.StringType(), "n_trusted": T.LongType(), "n_noisy": T.LongType(), "on_page": T.LongType()}
    return _told(trusted, noisy, keys, linked, kinds, False)


def aligned_runs(trusted: DataFrame, noisy: DataFrame, keys: list[str], linked: tuple[str, str] | None = None) -> DataFrame:
    """``segments`` of ``aligned`` rows, with n_trusted and n_noisy: the rows stay in the task that aligns them."""
    kinds = {n: T.LongType() for n in ("segment", "page", "first_i", "n", "__a", "best", "method", "n_trusted", "n_noisy", "__on_page")} | {"method": T.StringType()}
    runs = _told(trusted, noisy, keys, linked, kinds, True).withColumn("__best", F.col("best").cast("double"))
    return _weighed(runs, [*keys, *(linked or ())], "n_trusted", "n_noisy")


def _told(trusted: DataFrame, noisy: DataFrame, keys: list[str], linked: tuple[str, str] | None, kinds: dict[str, T.DataType], runs: bool) -> DataFrame:
    """What ``alignment.steps`` tells: both sides are put together by their keys once, and a task holds whole keys."""
    parts = linked or (None, None)

    def sided(df: DataFrame, side: int, place: str, page: Column, cells: list[Column]) -> DataFrame:
        part = F.col(parts[side]) if linked else F.lit(0)
        named = [c.alias(f"__c{k}") for k, c in enumerate(cells)]
        return df.dropna(subset=keys).select(*keys, F.lit(side).alias("__side"), part.alias("__part"), F.col(place).cast("long").alias("__place"), page.cast("long").alias("__page"), *named)

    value = lambda role: [F.col(role).cast("double"), (F.abs(F.col(role).cast("decimal(18,2)")) * 100).cast("long"), F.lit(None).cast("string")]
    told = sided(trusted, 0, "i", F.lit(0), [c for role in WEIGHTS for c in value(role)])
    read = sided(noisy, 1, "j", F.coalesce("page", F.lit(0)), [c for role in WEIGHTS for c in (F.lit(None).cast("double"), F.lit(None).cast("long"), F.col(f"{role}_raw"))])
    named = [*(trusted.schema[k] for k in keys), *(T.StructField(p, df.schema[p].dataType) for p, df in zip(parts, (trusted, noisy)) if p)]
    schema = T.StructType([*named, *(T.StructField(n, k) for n, k in kinds.items())])
    width, names = len(keys), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return alignment.steps(batches, width, linked is not None, runs, names)

    both = put_together(told.unionByName(read), *keys).sortWithinPartitions(*keys, "__side", "__part", "__place")
    return both.mapInArrow(run, schema).withColumn("best", (F.col("best") * F.lit(Decimal("0.000001"))).cast("decimal(18,6)" if runs else SCORE))


def _thousandths(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def segments(rows: DataFrame, noisy: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, segment, page, first_i, n, method, confidence) of ``aligned`` rows: runs of rows on one page.

    Confidence weighs the share of anchors, how well the rows cover the page, and the mean of best scores; rows placed
    by count stay below the gate.
    """
    w = Window.partitionBy(*keys).orderBy("i")
    moved = F.coalesce(F.col("page") != F.lag("page").over(w), F.lit(True))
    runs = rows.where("method <> 'failed'").withColumn("__new", moved.cast("int")).withColumn("segment", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy(*keys, "segment", "page", "method").agg(F.min("i").alias("first_i"), F.count("*").alias("n"), F.count_if("anchored").alias("__a"), F.sum("best").cast("double").alias("__best"))
    on_page = noisy.groupBy(*keys, "page").agg(F.count("*").alias("__on_page"))
    return _weighed(found.join(on_page, [*keys, "page"]), keys)


def _weighed(runs: DataFrame, keys: list[str], *kept: str) -> DataFrame:
    n = F.col("n").cast("double")
    cover = F.greatest(1 - F.abs(F.col("n") - F.col("__on_page")) / n, F.lit(0.0))
    weight = 0.5 * (F.col("__a") / n) + 0.3 * cover + 0.2 * (F.col("__best") / n)
    weight = F.when(F.col("method") == "count_order", F.least(weight, F.lit(GATE - 0.01))).otherwise(weight)
    return runs.select(*keys, "segment", "page", "first_i", "n", "method", _thousandths(weight).alias("confidence"), *kept)


def overall(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, confidence, least, segments, method): the segments' confidence weighted by rows, and the least of them."""
    mean = F.sum((F.col("confidence").cast("decimal(9,3)") * F.col("n")).cast("decimal(24,3)")).cast("double") / F.sum("n")
    return parts.groupBy(*keys, "method").agg(_thousandths(mean).alias("confidence"), F.min("confidence").alias("least"), F.count("*").alias("segments"))


#: Words that number a table, with what numbers it.
CAPTION = r"(?i)\b(table|schedule|annexure|annex|appendix|exhibit|form|bill)\b[\s\-:.#]*([0-9]+(?:\.[0-9]+)*|[a-z])\b"
#: Weights of header and section, and what an equal or another caption of one kind adds.
HEADER, SECTION, CAPTION_SAME, CAPTION_OTHER = 0.12, 0.08, 0.10, -0.25


def _bound(values: list[Column], use: Callable[..., Column]) -> Column:
    """``use`` of the values, each computed once however often it is named."""
    one = F.array(F.struct(*(c.alias(f"x{k}") for k, c in enumerate(values))))
    return F.get(F.transform(one, lambda x: use(*(x[f"x{k}"] for k in range(len(values))))), F.lit(0))


def shared_words(a: Column, b: Column) -> Column:
    """The share of the smaller text's words that the other one has; null if one has no word."""

    def words(c: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\S+"), F.lit(0)))

    return _bound([words(a), words(b)], lambda x, y: F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))))


def caption_signal(a: Column, b: Column) -> Column:
    """Whether two texts number a table of one kind alike (+) or differently (-); 0 where either names none or kinds differ."""
    part = lambda c, g: F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), CAPTION, g))
    signal = lambda x, y: F.when((x == "") | (x != y), 0.0).when(part(a, 2) == part(b, 2), CAPTION_SAME).otherwise(CAPTION_OTHER)
    return _bound([part(a, 1), part(b, 1)], signal)


def in_context(confidence: Column, header: tuple[Column, Column], section: tuple[Column, Column]) -> Column:
    """The confidence raised or lowered by headers, sections and captions that agree or don't; a contradicting caption isn't outweighed."""

    def moved(by_header: Column, by_section: Column, caption: Column) -> Column:
        by = F.coalesce(HEADER * (by_header - 0.5) * 2, F.lit(0.0)) + F.coalesce(SECTION * (by_section - 0.5) * 2, F.lit(0.0)) + caption
        return F.when(caption < 0, F.least(by, caption)).otherwise(by)

    by = _bound([shared_words(*header), shared_words(*section), caption_signal(*section)], moved)
    return _thousandths(F.least(F.greatest(confidence + by, F.lit(0.0)), F.lit(1.0)))


def trust_reasons(flags: Column, uncalculated: Column, n_trusted: Column, n_noisy: Column) -> Column:
    """Why a sheet may not replace a table: it doesn't tie out, holds formulas without values, or has other counts of rows."""
    return F.array_compact(
        F.array(
            F.when(flags > 0, F.lit("does not tie out")),
            F.when(uncalculated > 0, F.lit("formulas without values")),
            F.when(F.abs(n_trusted - n_noisy) > SLACK, F.format_string("%d rows against %d", n_trusted, n_noisy)),
        )
    )


def best_first(scores: DataFrame, group: str, left: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs of each group, the highest positive score first, each side used once (ties by ids).

    A group's rows stream through a task in that order; it holds the ids that the group has used.
    """
    names = scores.columns
    at = [names.index(c) for c in (group, left, right, score)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used_left, used_right, first = None, set(), set(), True
        for batch in batches:
            taken = []
            for g, a, b, s in zip(*(batch.column(i).to_pylist() for i in at)):
                if first or g != now:
                    now, used_left, used_right, first = g, set(), set(), False
                taken.append(s is not None and s > 0 and a not in used_left and b not in used_right)
                if taken[-1]:
                    used_left.add(a)
                    used_right.add(b)
            yield batch.filter(pa.array(taken, pa.bool_()))

    # Scores are tested here: Spark would move a filter below what makes them, and make them twice.
    dealt = put_together(scores, group).sortWithinPartitions(group, F.col(score).desc(), left, right)
    return dealt.mapInArrow(run, scores.schema)


def eligibility(links: DataFrame) -> DataFrame:
    """``links`` (confidence, least, method, reasons) with ``eligible``: trusted, aligned, and every segment over the gate."""
    ok = (F.size("reasons") == 0) & (F.col("method") != "failed") & (F.col("confidence") >= GATE) & (F.col("least") >= GATE)
    return links.withColumn("eligible", ok)


def queue(links: DataFrame, file: str) -> DataFrame:
    """One row a file: links, eligible ones, the best confidence, the methods and the reasons in the order of sheets."""
    said = F.array_sort(F.collect_list(F.when(F.size("reasons") > 0, F.struct("sheet", F.array_join("reasons", "; ").alias("why")))))
    per = links.groupBy(file).agg(
        F.count("*").alias("links"), F.count_if("eligible").alias("eligible"), F.max("confidence").alias("best_confidence"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"), said.alias("__said")
    )
    return per.withColumn("reasons", F.array_join(F.transform("__said", lambda x: x["why"]), "; ")).drop("__said")
