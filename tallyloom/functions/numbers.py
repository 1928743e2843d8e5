"""Column helpers for money, rounding and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column | str) -> Column:
    """Two exact decimals, so that sums don't depend on their order."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def total(c: Column | str) -> Column:
    """Exact sum of money, as a double."""
    return F.sum(money(c)).cast("double")


def half_up(x: Column, places: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = 10**places
    return F.floor(x * scale + 0.5) / scale


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, and ``otherwise`` where b is zero or null."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(otherwise))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def band(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the first edge that x doesn't exceed; the last label beyond all; null stays null."""
    out = F.when(x <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(x <= edge, label)
    return out.when(x.isNotNull(), labels[len(edges)])
