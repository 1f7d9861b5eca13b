"""Companies, their tickers and the two routes from a name to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions.text import company_name


def bridge(securities: DataFrame, company: Column, ticker: Column, attributes: list[str]) -> DataFrame:
    """One row per (``ruc``, ``nemonico_valor``) with the least non-null value of each attribute; rows lacking a key are left out."""
    rows = securities.withColumn("__c", company).withColumn("__t", ticker).where("__c is not null and __t is not null")
    return rows.groupBy(F.col("__c").alias("ruc"), F.col("__t").alias("nemonico_valor")).agg(*(F.min(a).alias(a) for a in attributes))


def universe(rows: DataFrame, company: Column, attributes: list[str]) -> DataFrame:
    """Every company with the least non-null value of each attribute."""
    return rows.withColumn("__c", company).where("__c is not null").groupBy(F.col("__c").alias("ruc")).agg(*(F.min(a).alias(a) for a in attributes))


def unique_names(rows: DataFrame, name: Column, company: Column) -> DataFrame:
    """Normalised names that belong to exactly one company: (``nombre_norm``, ``ruc``)."""
    per = rows.select(company_name(name).alias("nombre_norm"), company.alias("ruc")).where("nombre_norm is not null and ruc is not null").groupBy("nombre_norm")
    return per.agg(F.count_distinct("ruc").alias("n"), F.min("ruc").alias("ruc")).where("n = 1").drop("n")


def tickers_of(bridge_rows: DataFrame) -> DataFrame:
    """Sorted tickers of each company."""
    return bridge_rows.groupBy("ruc").agg(F.array_sort(F.collect_set("nemonico_valor")).alias("nemonicos"))


def resolve(events: DataFrame, key: str, name: Column, first: DataFrame, bridge_rows: DataFrame, second: DataFrame) -> DataFrame:
    """Identity of each event: name to company by the first source, else by the second (both ``unique_names``), and its tickers.

    ``metodo``: PRIMERA, SEGUNDA or SIN_IDENTIDAD. An event key that is captured twice counts once if its names agree;
    otherwise the least normalised name is taken. The sources are keyed by name, so no join multiplies events.
    """
    e = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(company_name(name)).alias("nombre_norm"))
    a = first.select("nombre_norm", F.col("ruc").alias("r1"))
    b = second.select("nombre_norm", F.col("ruc").alias("r2"))
    found = e.join(a, "nombre_norm", "left").join(b, "nombre_norm", "left").withColumn("ruc", F.coalesce("r1", "r2"))
    how = F.when(F.col("r1").isNotNull(), "PRIMERA").when(F.col("r2").isNotNull(), "SEGUNDA").otherwise("SIN_IDENTIDAD")
    out = found.withColumn("metodo", how).join(tickers_of(bridge_rows), "ruc", "left")
    return out.select(key, "nombre_norm", "ruc", "metodo", F.coalesce(F.array_size("nemonicos"), F.lit(0)).alias("n_nemonicos"), F.array_join("nemonicos", ",").alias("nemonicos"), F.col("ruc").isNotNull().alias("identificado"))
