"""The training-data queries p1 to p5 over the tables of the domain, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.functions.keys import company_id, ticker
from lonja.operators import compare_copies as cc
from lonja.operators import references as rf
from lonja.operators import rolling, schema_drift, timestamps
from lonja.operators.shared import kept, small
from lonja.sources import table
from lonja.sql import SQL  # noqa: F401


def registrations(spark: SparkSession, root: str) -> DataFrame:
    """cotizaciones with each registration once. Two deliveries of one registration have the same figures, or none; where
    they should differ, each figure is the greater one."""
    q = table(spark, root, "cotizaciones").where("fecha_cotizacion is not null")
    best = lambda c: F.max(c).alias(c)
    return (
        q.select(ticker(F.col("valor")).alias("t"), "fecha_cotizacion", "num_registro", "monto_negociado", "cierre_actual")
        .groupBy("t", "fecha_cotizacion", "num_registro")
        .agg(best("monto_negociado"), best("cierre_actual"))
    )


def p1_rolling(spark: SparkSession, root: str, tail_days: int = 0, only: DataFrame | None = None) -> DataFrame:
    rows = registrations(spark, root)
    rows = rows if only is None else rows.join(small(only), "t", "left_semi")
    return rolling.rolling_totals(rows, F.col("t"), F.col("fecha_cotizacion"), F.col("monto_negociado"), F.col("cierre_actual"), (7, 30), tail_days)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    stated = table(spark, root, "acumulados").alias("s")
    tickers = table(spark, root, "acumulados").select(ticker(F.col("valor")).alias("t")).where("t is not null").distinct()
    true = p1_rolling(spark, root, tail_days=29, only=tickers).alias("t")  # no other ticker's figures are compared
    joined = stated.join(true, (ticker(F.col("s.valor")) == F.col("t.entidad")) & (F.col("s.fecha") == F.col("t.dia")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    wrong = (
        rolling.differs(F.col("s.monto_7d"), zero(F.col("t.monto_7d")), 0.005, 0.02)
        | rolling.differs(F.col("s.monto_30d"), zero(F.col("t.monto_30d")), 0.005, 0.02)
        | rolling.differs(F.col("s.monto_prom_30d"), zero(F.col("t.monto_prom_30d")), 0.005, 0.02)
        | rolling.differs(F.col("s.cierre_prom_7d"), F.col("t.cierre_prom_7d"), 0.005)
    )
    return joined.where(wrong & F.col("s.valor").isNotNull() & F.col("s.fecha").isNotNull()).select(F.col("s.valor").alias("valor"), F.col("s.fecha").cast("date").cast("string").alias("fecha")).distinct()


def _files(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "archivos_crudos")


_P2 = ("id_archivo", "fuente", "canal", "secuencia", "fecha_recepcion", "contenido")


def _schemas(spark: SparkSession, root: str) -> DataFrame:
    return schema_drift.file_schemas(_files(spark, root), *_P2)


def _changes(schemas: DataFrame) -> DataFrame:
    return schema_drift.schema_changes(schemas, "id_archivo", "canal", "secuencia", "fecha_recepcion")


def p2_schemas(spark: SparkSession, root: str) -> DataFrame:
    fields = F.array_join(F.transform("campos", lambda x: F.concat_ws(":", x["nombre"], x["tipo"])), ",")
    return _schemas(spark, root).select("id_archivo", "canal", "secuencia", "nombre_arreglo", F.size("campos").alias("n_campos"), fields.alias("campos"), "huella")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _changes(_schemas(spark, root)).select(F.col("id").alias("id_archivo"), "campo", "cambio").distinct()


def p2_migraciones(spark: SparkSession, root: str) -> DataFrame:
    """The registry: a row per version of a source and migration step."""
    s = kept(_schemas(spark, root))
    r = schema_drift.registry(s, _changes(s), "id_archivo", "fuente", "fecha_recepcion")
    return r.select("fuente", "version", "archivos", "nombre_arreglo", "huella", F.explode("pasos").alias("p")).select("fuente", "version", "archivos", "nombre_arreglo", "huella", "p.*")


def _consistent(spark: SparkSession, root: str, which: str) -> DataFrame:
    df = schema_drift.consistent_table(_files(spark, root), which, *_P2)
    pairs = F.array_sort(F.transform(F.map_entries("otros"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return df.withColumn("no_convertidos", F.array_join("no_convertidos", ",")).withColumn("otros", F.array_join(pairs, ";"))


def p2_cotizaciones(spark: SparkSession, root: str) -> DataFrame:
    return _consistent(spark, root, "cotizaciones")


def p2_principales_cuentas(spark: SparkSession, root: str) -> DataFrame:
    return _consistent(spark, root, "principales_cuentas")


def p3_times(spark: SparkSession, root: str) -> DataFrame:
    """All three text columns in one pass per table: tabla, id_fila, campo, texto, instante and local (microseconds)."""
    places = table(spark, root, "plazas")
    zones = [r[0] for r in places.select("zona_horaria").where("zona_horaria is not null").distinct().collect()]  # a few names
    raw = table(spark, root, "cotizaciones_bronce")
    place = small(places.select(F.upper(F.trim("plaza")).alias("__p"), "zona_horaria", (F.upper("orden_fecha") == "MDY").alias("__mdy")).where("__p is not null").dropDuplicates(["__p"]))
    joined = raw.select("id_fila", "plaza", "fecharegistro", "fechacotizacion").join(place, F.upper(F.trim("plaza")) == F.col("__p"), "left")
    two = joined.select("id_fila", "zona_horaria", "__mdy", F.explode(F.create_map(F.lit("fecharegistro"), F.col("fecharegistro"), F.lit("fechacotizacion"), F.col("fechacotizacion"))).alias("campo", "texto"))
    quotes = timestamps.normalise(two, F.col("texto"), F.col("zona_horaria"), F.col("__mdy"), zones, [F.lit("cotizaciones_bronce").alias("tabla"), F.col("id_fila"), F.col("campo"), F.col("texto")])
    series = table(spark, root, "embig")
    days = timestamps.normalise(series, F.col("_c0"), F.lit("UTC"), F.lit(False), ["UTC"], [F.lit("embig").alias("tabla"), F.col("num_linea").alias("id_fila"), F.lit("_c0").alias("campo"), F.col("_c0").alias("texto")])
    return quotes.unionByName(days)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    t = p3_times(spark, root)
    text = F.when(F.col("campo") == "fecharegistro", timestamps.instant_text(F.col("instante"))).otherwise(timestamps.day_of(F.col("local")).cast("string"))
    return t.select("tabla", "id_fila", "campo", text.alias("instante")).where("instante is not null and id_fila is not null")


def p4_orphans(spark: SparkSession, root: str) -> DataFrame:
    bridge = table(spark, root, "puente_ruc_nemonico")
    ends = table(spark, root, "bajas_valores").groupBy(ticker(F.col("nemonico_valor")).alias("t")).agg(F.max("fecha_baja").alias("fecha_baja"))
    begun = bridge.groupBy(ticker(F.col("nemonico_valor")).alias("t")).agg(F.min("fecha_inscripcion").alias("desde"))
    listed = begun.where("t is not null").join(ends, "t", "left")
    quotes = table(spark, root, "cotizaciones")
    key, day = ticker(F.col("valor")), F.col("fecha_cotizacion")
    a = rf.orphans(
        quotes, key, day, [F.lit("cotizaciones").alias("tabla"), F.col("id_fila").cast("string").alias("clave"), key.alias("clave_referida"), F.date_format(day, "yyyy-MM").alias("periodo")], listed, F.col("t"), F.col("desde"), F.col("fecha_baja")
    )
    filings = table(spark, root, "principales_cuentas")
    ruc = company_id(F.col("ruc"))
    b = rf.orphans(
        filings, ruc, None, [F.lit("principales_cuentas").alias("tabla"), F.col("id_registro").alias("clave"), ruc.alias("clave_referida"), F.concat_ws("-", F.col("ejercicio").cast("string"), F.lit("ejercicio")).alias("periodo")], bridge, company_id(F.col("ruc"))
    )
    return a.unionByName(b)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_orphans(spark, root).select("tabla", "clave").distinct()


def p4_report(spark: SparkSession, root: str) -> DataFrame:
    return rf.orphan_report(p4_orphans(spark, root), F.col("tabla"), F.col("periodo"))


def p5_differences(spark: SparkSession, root: str) -> DataFrame:
    fields = {"fecha_cotizacion": ("date", None), "valor": ("ticker", None), "cierre_actual": ("number", 0.005), "monto_negociado": ("number", 0.005)}
    return cc.compare_copies(table(spark, root, "cotizaciones"), table(spark, root, "cotizaciones_copia"), "id_fila", fields, "solo_cotizaciones", "solo_copia")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return p5_differences(spark, root).select("id_fila", "campo").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_rolling, p2_found, p2_schemas, p2_migraciones, p2_cotizaciones, p2_principales_cuentas, p3_found, p4_found, p4_report, p5_found)}
