"""Scale and partitioning benchmarks: replicate, compute, join, write, re-read, time."""

from __future__ import annotations

import re
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.sources.files import Files
from lonja.sources.writers import write_table


def replicated(df: DataFrame, n: int) -> DataFrame:
    """Every row ``n`` times with its ``replica`` number, generated row by row without a join."""
    return df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def scale_table(quotes: DataFrame, fx: DataFrame, risk: DataFrame, n: int) -> DataFrame:
    """The scale workload: replicas of the quotes with four metrics and two macro joins; NULL where a divisor is 0 or NULL."""
    close, prev, high, low, mean = (F.col(c) for c in ("cierre_actual", "cierre_anterior", "maxima_actual", "minima_actual", "promedio_actual"))
    q = replicated(quotes, n).select(
        "*", (close - prev).alias("variacion"), F.when(prev != 0, 100 * (close - prev) / prev).alias("retorno_pct"), (high - low).alias("rango"), F.when(mean != 0, 100 * (high - low) / mean).alias("rango_pct"),
    )
    return q.join(fx.withColumnRenamed("fecha", "fecha_cotizacion"), "fecha_cotizacion", "left").join(risk.withColumnRenamed("fecha", "fecha_cotizacion"), "fecha_cotizacion", "left")


def replica_audit(table: DataFrame) -> DataFrame:
    """Rows, replicas, and least and most rows of a replica."""
    per = table.groupBy("replica").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("filas"), F.count(F.lit(1)).alias("replicas"), F.min("n").alias("minimo"), F.max("n").alias("maximo"))


def run_scale(spark: SparkSession, quotes: DataFrame, fx: DataFrame, risk: DataFrame, n: int, path: str) -> dict:
    """Writes the workload by year and month, reads it back, and reports seconds, rows, bytes and rows per second."""
    began = time.time()
    write_table(scale_table(quotes, fx, risk, n), path, ("anio", "mes"))
    wrote = time.time()
    audit = replica_audit(spark.read.parquet(path)).first().asDict()
    size = Files(spark).size(path)
    return {"escala": n, "segundos_escritura": wrote - began, "segundos_auditoria": time.time() - wrote, "bytes": size, "filas_por_segundo": audit["filas"] / max(1e-9, wrote - began), **audit}


def month_aggregate(df: DataFrame, year: int, month: int) -> DataFrame:
    return df.where((F.col("anio") == year) & (F.col("mes") == month)).agg(F.count(F.lit(1)).alias("filas"), F.sum("monto_negociado").alias("monto"), F.avg("cierre_actual").alias("cierre"))


def prunes(df: DataFrame) -> bool:
    """Whether the physical plan filters by partition."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return bool(re.search(r"PartitionFilters: \[[^\]]+\]", text))


def compare_layouts(spark: SparkSession, flat: str, partitioned: str, year: int, month: int, runs: int = 7, warm_ups: int = 1) -> dict:
    """Alternating timed runs of one month's aggregate on both layouts, after untimed ones: medians, means, gain, and
    whether results agree. For replicated data pass the tables that ``run_scale`` wrote."""
    times: dict[str, list[float]] = {"plano": [], "particionado": []}
    results = {}
    schema = spark.read.parquet(partitioned).schema  # stated, so that a run does not infer it again
    for turn in range(warm_ups + runs):
        for name, path in (("plano", flat), ("particionado", partitioned)):
            began = time.time()
            results[name] = month_aggregate(spark.read.schema(schema).parquet(path), year, month).first()
            if turn >= warm_ups:
                times[name].append(time.time() - began)
    medians = {k: statistics.median(v) for k, v in times.items()}
    a, b = results["plano"], results["particionado"]
    same = a["filas"] == b["filas"] and abs((a["monto"] or 0) - (b["monto"] or 0)) <= 1e-9 * max(1.0, abs(a["monto"] or 0))
    return {"medianas": medians, "medias": {k: statistics.mean(v) for k, v in times.items()}, "ganancia_pct": 100 * (1 - medians["particionado"] / medians["plano"]), "iguales": same, "poda": prunes(month_aggregate(spark.read.parquet(partitioned), year, month))}
