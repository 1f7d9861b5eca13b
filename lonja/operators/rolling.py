"""Totals and averages over trailing calendar periods, days without activity included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT, LARGE = "decimal(28,6)", 1e20


def rolling_totals(
    rows: DataFrame,
    entity: Column,
    day: Column,
    amount: Column,
    price: Column,
    periods: Sequence[int] = (7, 30),
    tail_days: int = 0,
) -> DataFrame:
    """One row per entity and calendar day from its first to its last day of activity (plus ``tail_days``).

    Columns: ``entidad``, ``dia``, ``filas``, and per period N ``monto_Nd`` (sum of ``amount``; days without rows add
    nothing), ``monto_prom_Nd`` (that sum / N), ``cierre_prom_Nd`` (mean of the non-null prices of the period's
    rows, NULL if there are none). The period is the day and the N-1 calendar days before it.

    Steps: aggregate per entity and day (with map-side combine, so an entity with a third of all rows shrinks to its
    days before anything is sorted), make the entity's calendar by filling the gap up to its next day of activity,
    then take window sums over a fixed number of preceding rows. An entity's window holds at most one row per
    calendar day, whatever its number of rows. The product of entities and days is generated from each entity's own
    days, so there is no cross join, and filling gaps and window share one shuffle.

    Sums are taken in decimal (six places), so they do not depend on the order of rows; figures of 1e20 and more, which
    decimals can't hold, are summed as doubles and added. NULL, NaN and infinite amounts and prices add nothing. An entity
    with a day far off (a marker such as 9999-12-31) has a row for every day up to it; set such days to NULL before. Rows without entity or day are left out. An empty table gives an empty result.
    Only the four expressions are read, so further columns with any name do no harm. Rows count as often as they
    occur; take repeated deliveries out before.
    """
    number = lambda c: F.when(~F.isnan(c.try_cast("double")) & (F.abs(c.try_cast("double")) != float("inf")), c)
    large = lambda c: F.abs(c.try_cast("double")) >= LARGE
    exact = lambda c: F.when(~large(c), c).try_cast(EXACT)
    beyond = lambda c: F.when(large(c), c.try_cast("double"))
    parts = {"a": exact(number(amount)), "aa": beyond(number(amount)), "p": exact(number(price)), "pp": beyond(number(price))}
    daily = (
        rows.select(entity.alias("entidad"), day.cast("date").alias("dia"), *(c.alias(n) for n, c in parts.items()))
        .where("entidad is not null and dia is not null")
        .groupBy("entidad", "dia")
        .agg(*(F.sum(n).alias(n) for n in parts), F.count(F.coalesce("p", "pp")).alias("np"), F.count(F.lit(1)).alias("filas"))
    )
    order = Window.partitionBy("entidad").orderBy("dia")
    until = F.coalesce(F.date_sub(F.lead("dia").over(order), 1), F.date_add("dia", tail_days))
    dense = daily.withColumn("hasta", until).select("entidad", F.posexplode(F.sequence("dia", "hasta")).alias("k", "dia"), *parts, "np", "filas")
    real = lambda c: F.when(F.col("k") == 0, F.col(c))
    dense = dense.select("entidad", "dia", *(real(c).alias(c) for c in parts), *(F.coalesce(real(c), F.lit(0)).alias(c) for c in ("np", "filas")))
    out = [F.col("entidad"), F.col("dia"), F.col("filas")]
    for n in periods:
        w = order.rowsBetween(-(n - 1), 0)
        both = lambda c, w=w: F.coalesce(F.sum(c).over(w), F.lit(0).cast(EXACT)).cast("double") + F.coalesce(F.sum(2 * c).over(w), F.lit(0.0))
        out += [
            both("a").alias(f"monto_{n}d"),
            (both("a") / n).alias(f"monto_prom_{n}d"),
            F.try_divide(both("p"), F.sum("np").over(w)).alias(f"cierre_prom_{n}d"),
        ]
    return dense.select(*out)


def differs(stated: Column, true: Column, relative: float, absolute: float = 0.0) -> Column:
    """TRUE if exactly one is NULL, or they differ by more than both tolerances; NaN counts as NULL."""
    s, t = (F.when(~F.isnan(c), c) for c in (stated, true))
    gap = F.abs(s - t)
    return F.coalesce((s.isNull() != t.isNull()) | ((gap > relative * F.abs(t)) & (gap > absolute)), F.lit(False))
