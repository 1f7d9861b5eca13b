"""Data-quality measures, each one aggregate over the data, and gates on their outcome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions.text import percent
from lonja.operators.shared import kept


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row (``columna``, ``nulos``, ``filas``) per column, in one pass."""
    columns = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("columna"), F.col(f"c{i}").alias("nulos")) for i, c in enumerate(columns))))
    return one.select("n", each.alias("x")).select("x.columna", "x.nulos", F.col("n").alias("filas"))


def castability(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """A row (``columna``, ``no_convertibles``) per column: values that the type would lose."""
    one = df.agg(*(F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in types.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("columna"), F.col(c).alias("no_convertibles")) for c in types))).alias("x")).select("x.*")


def key_uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: ``filas``, ``claves``, ``repetidas`` (rows beyond the first of each key; NULLs count as a value).

    Grouping first keeps a hot key in one partial row per task.
    """
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("filas"), F.count(F.lit(1)).alias("claves")).withColumn("repetidas", F.col("filas") - F.col("claves"))


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def group_size_histogram(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many groups have each size."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("tamano")).groupBy("tamano").agg(F.count(F.lit(1)).alias("grupos"))


def many_to_one_violations(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that go with more than one value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1")


def inconsistent_attributes(df: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Groups in which some attribute has more than one non-null value, with the number of values of each."""
    per = df.groupBy(*keys).agg(*(F.count_distinct(a).alias(a) for a in attributes))
    return per.where(" or ".join(f"`{a}` > 1" for a in attributes))


def series_audit(df: DataFrame, date: str, value: str) -> DataFrame:
    """One row on a series: rows, distinct dates, first and last, NULLs of date and value, repeated dates."""
    return df.agg(
        F.count(F.lit(1)).alias("filas"), F.count_distinct(date).alias("fechas"), F.min(date).alias("primera"), F.max(date).alias("ultima"),
        F.count_if(F.col(date).isNull()).alias("fechas_nulas"), F.count_if(F.col(value).isNull()).alias("valores_nulos"),
    ).withColumn("repetidas", F.col("filas") - F.col("fechas") - F.col("fechas_nulas"))


def expected(measured: DataFrame, limits: dict[str, tuple]) -> DataFrame:
    """Rows (``medida``, ``valor``, ``estado``): COINCIDE if the measure lies within its limits (None: open), else REVISAR."""
    def state(c: str, lo, hi) -> Column:
        ok = F.lit(True)
        if lo is not None:
            ok = ok & (F.col(c) >= F.lit(lo))
        if hi is not None:
            ok = ok & (F.col(c) <= F.lit(hi))
        return F.struct(F.lit(c).alias("medida"), F.col(c).cast("string").alias("valor"), F.when(ok, "COINCIDE").otherwise("REVISAR").alias("estado"))

    return measured.select(F.explode(F.array(*(state(c, *l) for c, l in limits.items()))).alias("x")).select("x.*")


def key_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys on the left, on the right, in both, and the share of the left that is covered."""
    l, r = (d.where(F.col(key).isNotNull()).select(key).distinct() for d in (left, right))
    both = l.withColumn("l", F.lit(1)).join(r.withColumn("r", F.lit(1)), key, "full_outer")
    out = both.agg(F.count("l").alias("izquierda"), F.count("r").alias("derecha"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("comunes"))
    return out.withColumn("cobertura", percent(F.col("comunes"), F.col("izquierda")))


def coverage_by(facts: DataFrame, reference: DataFrame, key: str, by: str, digits: int = 2) -> DataFrame:
    """Rows of facts per ``by`` and how many have their key in the reference."""
    known = reference.where(F.col(key).isNotNull()).select(key).distinct().withColumn("hay", F.lit(True))
    per = facts.join(known, key, "left").groupBy(by).agg(F.count(F.lit(1)).alias("filas"), F.count("hay").alias("cubiertas"))
    return per.withColumn("cobertura", percent(F.col("cubiertas"), F.col("filas"), digits))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(c) for c in columns))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("columna"), percent(F.col(c), F.col("n"), 2).alias("completitud")) for c in columns)))
    return one.select(each.alias("x")).select("x.*")


def explaining_fields(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Among the groups with repeated keys, in how many each field has different values."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("∅"))).alias(f) for f in fields)).where("n > 1")
    one = per.agg(*(F.count_if(F.col(f) > 1).alias(f) for f in fields))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("campo"), F.col(f).alias("grupos")) for f in fields))).alias("x")).select("x.*")


def out_of_range(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row (``serie``, ``filas``, ``fuera``) per rule: how many rows break it; NULLs break none. One pass."""
    one = df.agg(F.count(F.lit(1)).alias("__n"), *(F.count_if(c).alias(n) for n, c in rules.items()))
    return one.select("__n", F.explode(F.array(*(F.struct(F.lit(n).alias("serie"), F.col(n).alias("fuera")) for n in rules))).alias("x")).select("x.serie", F.col("__n").alias("filas"), "x.fuera")


def flagged(df: DataFrame, flag: str) -> DataFrame:
    """The rows whose flag is TRUE; all rows if there is no such column."""
    return df.where(F.col(flag)) if flag in df.columns else df


def accepted(rule: Column, mark: Column | None = None) -> Column:
    """TRUE where the rule holds and the stored mark, if there is one, says so too; FALSE otherwise, also for NULLs."""
    no = F.lit(False)
    return F.coalesce(rule, no) & (F.coalesce(mark, no) if mark is not None else F.lit(True))


def exact_quantile(df: DataFrame, column: str, p: float) -> DataFrame:
    """One row (``cuantil``, ``n``): the exact quantile with linear interpolation over the non-null values.

    Values shrink to distinct ones with their number, which are sorted by range over all tasks; the two values around
    the place are then found from the ranges' sums, so no task sees more than one range.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("m"))
    parts = kept(counts.repartitionByRange("x").select("x", "m", F.spark_partition_id().alias("r")))
    sums = parts.groupBy("r").agg(F.sum("m").alias("s"))
    # one row per range
    before = sums.select("r", F.coalesce(F.sum("s").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("antes"), F.sum("s").over(Window.partitionBy(F.lit(1))).alias("n"))
    upto = F.sum("m").over(Window.partitionBy("r").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    placed = parts.withColumn("hasta", upto).join(F.broadcast(before), "r").withColumn("hasta", F.col("hasta") + F.col("antes"))
    place = (F.col("n") - 1) * F.lit(p)
    at = lambda k: F.min(F.when((F.col("hasta") > k) & (F.col("hasta") - F.col("m") <= k), F.col("x")))
    ends = placed.agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"), F.max("n").alias("n"))
    part = (F.col("n") - 1) * F.lit(p)
    return ends.select((F.col("a") + (F.col("b") - F.col("a")) * (part - F.floor(part))).alias("cuantil"), F.coalesce("n", F.lit(0)).alias("n"))
