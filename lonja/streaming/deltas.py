"""Streams: arriving files applied as deltas, and rolling figures over event time with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lonja.operators.delta import merged


def arriving(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def apply_arriving(stream: DataFrame, table: str, keys: list[str], payload: list[str], checkpoint: str, on_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Applies everything that has arrived to the table at ``table``, batch by batch, and ends.

    Each batch writes a new version next to the last (``version=N``), so a batch that is repeated after a loss gives
    the same result and a reader always sees a whole version; read the greatest with ``current``.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = current(spark, table, before=number)
        out = merged(last, batch.select(*last.columns), keys, payload) if last is not None else merged(batch.limit(0), batch, keys, payload)
        out.write.mode("overwrite").parquet(f"{table}/version={number:08d}")
        if on_batch:
            on_batch(number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The greatest finished version (below ``before``), or None."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    done = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbers = sorted(int(n.split("=")[1]) for n in done if n.startswith("version="))
    numbers = [n for n in numbers if before is None or n < before]
    return spark.read.parquet(f"{table}/version={numbers[-1]:08d}") if numbers else None


def sliding_totals(stream: DataFrame, time: str, entity: str, amount: str, length: str = "7 days", slide: str = "1 day", late: str = "3 days") -> DataFrame:
    """Totals per entity over sliding windows of event time; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length, slide), entity).agg(F.sum(amount).alias("monto"), F.count(F.lit(1)).alias("filas"))
