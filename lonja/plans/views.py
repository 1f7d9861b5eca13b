"""The typed tables that the products and audits start from, over the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lonja.functions.keys import company_id, quarter, ticker
from lonja.functions.text import company_name, day, quarter_label, series_date, series_number
from lonja.operators.delta import with_collisions
from lonja.operators.identity import bridge as make_bridge
from lonja.operators.identity import resolve, unique_names
from lonja.plans.gold import macro as macro_of
from lonja.sources import table

BRIDGE_ATTRIBUTES = ["razon_social", "codigo_isin", "denominacion_valor", "tipo_valor", "moneda", "fecha_inscripcion", "resolucion_inscripcion"]


#: The figures of a quote, and the columns that only the product hands on.
FIGURES = ("cierre_anterior", "cierre_actual", "apertura_actual", "maxima_actual", "minima_actual", "promedio_actual", "monto_negociado")
PASSED_ON = ("num_registro", "descripcion", "fuente", "fecha_ingesta")


def quotes(spark: SparkSession, root: str, more: Sequence[str] = ()) -> DataFrame:
    """One row per ticker and day: the last registration of the day (then the least id), with its FIGURES and ``more``."""
    q = table(spark, root, "cotizaciones").withColumn("t", ticker(F.col("valor"))).where("t is not null and fecha_cotizacion is not null")
    last = q.groupBy(F.col("t").alias("valor"), "fecha_cotizacion").agg(F.max_by(F.struct(*FIGURES, *more), F.struct(F.coalesce("num_registro", F.lit(-1)), -F.col("id_fila"))).alias("r"))
    own = lambda cols: (F.col(f"r.{c}").alias(c) for c in cols)
    return last.select("valor", "fecha_cotizacion", *own(FIGURES), F.year("fecha_cotizacion").alias("anio"), F.month("fecha_cotizacion").alias("mes"), *own(more))


def fx(spark: SparkSession, root: str) -> DataFrame:
    """A daily macro series with gaps, as there is no exchange rate among the tables: mean order total per day, 26 years
    later so that its days are those of the quotes; NULL on days with one order."""
    o = table(spark, root, "orders").groupBy(F.add_months(F.to_date("o_orderdate"), 26 * 12).alias("fecha"))
    return o.agg(F.when(F.count(F.lit(1)) > 1, F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("tipo_cambio"))


def risk_series(spark: SparkSession, root: str) -> DataFrame:
    """The lines of the country-risk series with a readable day, in any of its notations."""
    s = table(spark, root, "embig")
    d = series_date(s["_c0"])
    return s.select("num_linea", d.alias("fecha"), series_number(s["pd04709xd"]).alias("embig"), F.year(d).alias("anio"), F.month(d).alias("mes")).where("fecha is not null")


def risk(spark: SparkSession, root: str) -> DataFrame:
    """Country risk by day; of several lines of a day the greatest value."""
    return risk_series(spark, root).groupBy("fecha").agg(F.max("embig").alias("embig"))


def macro(spark: SparkSession, root: str, corrected: bool = True) -> DataFrame:
    return macro_of(fx(spark, root), risk(spark, root), corrected)


def brokers(spark: SparkSession, root: str) -> DataFrame:
    """Daily turnover per broker made of order lines (supplier as broker), with shares of the day's turnover."""
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    buy = F.col("l_returnflag") == "R"
    per = (
        table(spark, root, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("fecha_negociacion"), F.col("l_suppkey").alias("codigo_sab"))
        .agg(F.coalesce(F.sum(F.when(buy, amount)), F.lit(0)).alias("compras"), F.coalesce(F.sum(F.when(~buy, amount)), F.lit(0)).alias("ventas"), F.sum(amount).alias("total"))
    )
    day = Window.partitionBy("fecha_negociacion")
    share = lambda c: F.round(F.try_divide(100 * F.col(c).cast("double"), F.sum(c).over(day).cast("double")), 6).alias(f"porcentaje_{c}")
    names = table(spark, root, "supplier").select(F.col("s_suppkey").alias("codigo_sab"), F.col("s_name").alias("sociedad_agente_bolsa"))
    kinds = ("compras", "ventas", "total")
    return per.select("fecha_negociacion", "codigo_sab", *(F.col(c).cast("double").alias(f"monto_{c}") for c in kinds), *(share(c) for c in kinds)).join(names, "codigo_sab", "left")


def bridge(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "puente_ruc_nemonico")
    return make_bridge(p, company_id(p["ruc"]), ticker(p["nemonico_valor"]), BRIDGE_ATTRIBUTES)


def filings(spark: SparkSession, root: str) -> DataFrame:
    """Headline financials with quarter number and label and the validity of the company id."""
    f = table(spark, root, "principales_cuentas")
    n = quarter(f["trimestre"])
    return f.select(
        "id_registro", company_id(f["ruc"]).alias("ruc"), "nombre_empresa", "tipo_sector", "ejercicio", n.alias("trimestre_num"), quarter_label(n).alias("trimestre"), "tipo_informacion",
        "activo_total", "patrimonio_total", "total_ingreso", F.nanvl("utilidad_neta", F.lit(None).cast("double")).alias("utilidad_neta"), "pasivo_total", "fecha_registro", company_id(f["ruc"]).isNotNull().alias("ruc_valido"),
        "clave_negocio",
    )


def filings_with_collisions(spark: SparkSession, root: str) -> DataFrame:
    """The typed table: filings with the number of rows of their business key and whether there are several."""
    return with_collisions(filings(spark, root), "clave_negocio")


def events(spark: SparkSession, root: str) -> DataFrame:
    """One row per case number (of repeated captures the least by content), with typed dates."""
    e = table(spark, root, "eventos").where("numero_expediente is not null")
    rest = [c for c in e.columns if c != "numero_expediente"]
    one = e.groupBy("numero_expediente").agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("r")).select("numero_expediente", "r.*")
    return one.withColumn("fecha_presentacion_date", day(F.col("fecha_presentacion"))).withColumn("fecha_acuerdo_date", day(F.col("fecha_acuerdo"))).withColumn("empresa_norm", company_name(F.col("empresa")))


def identity(spark: SparkSession, root: str) -> DataFrame:
    """Events resolved by the names of the financials first, then by those of the bridge."""
    f, p = table(spark, root, "principales_cuentas"), table(spark, root, "puente_ruc_nemonico")
    first = unique_names(f, f["nombre_empresa"], company_id(f["ruc"]))
    second = unique_names(p, p["razon_social"], company_id(p["ruc"]))
    return resolve(table(spark, root, "eventos"), "numero_expediente", F.col("empresa"), first, bridge(spark, root), second)
