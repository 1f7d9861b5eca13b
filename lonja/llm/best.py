"""The best representative of each group of duplicate records, whole and field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _usable(records: DataFrame, group: list[str]) -> DataFrame:
    return records.where(" and ".join(f"`{g}` is not null" for g in group))


def surviving_fields(records: DataFrame, group: list[str], idc: str, fields: list[str], trust: str, recency: str) -> DataFrame:
    """One row (``id_grupo``, ``campo``, ``id``, ``valor``) per group of two or more records and field with a value.

    The value that survives is that of the most trusted record (least ``trust``; NULL last), then the most recent
    (``recency`` descending; NULL last), then the least id, among the records whose field is not NULL; make values
    that mean nothing NULL before. id_grupo is the group's least id. Records with a NULL in a group column belong to
    no group; records without id are left out. A field without any value in a group has no row.

    Each record is spread into a row per field, which are ranked by a window over (group, field). Spark keeps only the
    first rank of each task before it shuffles, so a group with a third of all records sends a few rows.
    """
    rows = _usable(records, [*group, idc])
    long = rows.select(*group, idc, trust, recency, F.explode(F.array(*(F.struct(F.lit(f).alias("campo"), F.col(f).cast("string").alias("valor")) for f in fields))).alias("v"))
    long = long.select(*group, idc, trust, recency, "v.campo", "v.valor").where("valor is not null")
    order = Window.partitionBy(*group, "campo").orderBy(F.col(trust).asc_nulls_last(), F.col(recency).desc_nulls_last(), F.col(idc).asc())
    first = long.withColumn("__r", F.row_number().over(order)).where("__r = 1").select(*group, "campo", F.col(idc).alias("id"), "valor")
    groups = rows.groupBy(*group).agg(F.count_distinct(idc).alias("__n"), F.min(idc).alias("id_grupo")).where("__n > 1").drop("__n")
    return first.join(groups, group).select("id_grupo", "campo", "id", "valor")


def best_records(records: DataFrame, group: list[str], idc: str, fields: list[str], trust: str, recency: str) -> DataFrame:
    """One whole record per group, with ``completitud`` (how many ``fields`` it has): the most complete, then the most
    trusted, then the most recent, then the one with the least id. The group rules are those of surviving_fields, but a
    record alone represents its group."""
    full = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    rows = _usable(records, [*group, idc]).withColumn("completitud", full)
    order = Window.partitionBy(*group).orderBy(F.desc("completitud"), F.col(trust).asc_nulls_last(), F.col(recency).desc_nulls_last(), F.col(idc).asc())
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
