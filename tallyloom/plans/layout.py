"""Pages of boxes: columns, bands and reading order; headings against their numbers.

Elements are rows (page, pos, type, x0, y0, x1, y1), ``pos`` the order in which they were found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types that cut a page into bands, and those whose extents make its columns.
SPANNERS, BODY_TEXT = ("table", "figure", "heading"), ("paragraph", "list_item")
#: The least gutter and the least width of a spanner, as shares of the page's width.
GUTTER, WIDE = 0.05, 0.6


def column_bounds(elements: DataFrame, page: str, width: float) -> DataFrame:
    """(page, bounds): the middles of the gutters between merged horizontal extents of text, from the left.

    A gutter takes a twentieth of the page, so an array has twenty entries at most.
    """
    w = Window.partitionBy(page).orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    text = elements.where(F.col("type").isin(*BODY_TEXT)).select(page, "x0", "x1", (F.col("x0") - reach).alias("gap"), ((F.col("x0") + reach) / 2).alias("middle"))
    gutters = text.where(F.col("gap") > 1).where(F.col("gap") >= GUTTER * width)
    return gutters.groupBy(page).agg(F.array_sort(F.collect_list("middle")).alias("bounds"))


def reading_order(elements: DataFrame, page: str, width: float) -> DataFrame:
    """``elements`` with ``column``, ``band`` and ``place``: headers, then band by band the columns from the left, then footers.

    Tables, figures, headings and boxes wider than three fifths of the page end a band (column -1).  A page of one column
    is read from top to bottom.
    """
    bounds = column_bounds(elements, page, width)
    centre = (F.col("x0") + F.col("x1")) / 2
    inside = F.size(F.filter("bounds", lambda b: b <= centre))
    spans = (F.col("x1") - F.col("x0") > WIDE * width) | F.col("type").isin(*SPANNERS)
    column = F.when(spans, -1).when((centre < 0) | (centre >= width), 0).otherwise(inside)
    furniture = F.when(F.col("type") == "header", 0).when(F.col("type") == "footer", 2).otherwise(1)
    held = elements.join(bounds, page, "left").withColumn("part", furniture).withColumn("column", F.when((F.col("part") == 1) & F.col("bounds").isNotNull(), column).otherwise(0))
    w = Window.partitionBy(page, "part").orderBy("y0", "pos").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("band", F.coalesce(F.count_if(F.col("column") == -1).over(w), F.lit(0)))
    order = Window.partitionBy(page).orderBy("part", "band", F.col("column") == -1, "column", "y0", "pos")
    return held.withColumn("place", F.row_number().over(order)).drop("part", "bounds")


def number_level(number: Column) -> Column:
    """The level that a dotted number stands for: 3.2.1 is 3."""
    return F.size(F.split(F.rtrim(number, F.lit(".")), r"\."))


def natural_key(number: Column) -> Column:
    """Dotted numbers in natural order: 2.10 comes after 2.9."""
    return F.transform(F.split(number, r"\."), lambda p: p.try_cast("long"))


def heading_audit(headings: DataFrame, doc: str, pos: str, number: str, level: str, text: str) -> DataFrame:
    """(doc, headings, wrong_level, number_only, out_of_order, skipped): headings that clash with their numbers.

    A number of two parts or more must have the heading's level; text must hold more than the number; numbers must rise
    from heading to heading; and a level may go down by one at a time only.
    """
    w = Window.partitionBy(doc).orderBy(pos)
    dotted = F.col(number).contains(".")
    last = F.last(F.when(F.col(number).isNotNull(), natural_key(F.col(number))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = headings.select(
        doc,
        (dotted & (F.col(level) != number_level(F.col(number)))).alias("wrong"),
        F.col(text).rlike(r"^\s*[0-9]+([.][0-9]+)*[.)]?\s*$").alias("only"),
        (natural_key(F.col(number)) <= last).alias("order"),
        (F.col(level) > F.lag(level).over(w) + 1).alias("skips"),
    )
    return marked.groupBy(doc).agg(F.count("*").alias("headings"), F.count_if("wrong").alias("wrong_level"), F.count_if("only").alias("number_only"), F.count_if("order").alias("out_of_order"), F.count_if("skips").alias("skipped"))


def repeated_figures(figures: DataFrame, doc: str, page: str, grid: float = 8.0) -> DataFrame:
    """``figures`` (image or null, x0, y0, x1, y1) with ``decorative``: the same image, or a drawing of like place and size, on two pages or more."""
    box = [F.bround(c / grid).cast("long") for c in (F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))]
    drawn = F.when(F.col("image").isNull(), F.concat_ws(" ", *(b.cast("string") for b in box)))
    marked = figures.withColumn("__sig", F.coalesce(F.concat(F.lit("image "), F.col("image").cast("string")), drawn))
    pages = marked.groupBy(doc, "__sig").agg(F.countDistinct(page).alias("__pages"))
    return marked.join(pages, [doc, "__sig"]).withColumn("decorative", F.col("__pages") >= 2).drop("__sig", "__pages")


#: The longest side of an icon, the least ratio of a banner's sides, and the pixels up to which an image may be decoded.
ICON, BANNER, MOST_PIXELS = 160, 6, 300_000_000


def image_kinds(images: DataFrame) -> DataFrame:
    """``images`` (w, h) with ``kind`` and ``safe``: unknown or senseless sizes are never safe to decode."""
    long, short = F.greatest("w", "h"), F.greatest(F.lit(1), F.least("w", "h"))
    kind = F.when(long <= ICON, "icon/logo").when(long >= BANNER * short, "banner/rule").otherwise("photo/figure")
    fits = (F.col("w") > 0) & (F.col("h") > 0) & (F.col("w").cast("long") * F.col("h") <= MOST_PIXELS)
    return images.withColumns({"kind": kind, "safe": F.coalesce(fits, F.lit(False))})
