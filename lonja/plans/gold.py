"""The five products, in the published and the corrected definition, and the extensions that the design asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions.text import percent_change, quarter_label
from lonja.operators.shared import join_hot, kept


def macro(fx: DataFrame, risk: DataFrame, corrected: bool = True) -> DataFrame:
    """Both series by date. Corrected: a date in either is kept; published: only dates in both."""
    return fx.join(risk, "fecha", "full_outer" if corrected else "inner")


def market_daily(quotes: DataFrame, macro_rows: DataFrame) -> DataFrame:
    """Quotes with the day's macro values, the change and return against the previous traded row, and the day's range.

    All other columns of the quotes are passed on.
    The window needs one shuffle on the ticker; the macro side has a row per day and is broadcast by its size.
    """
    w = Window.partitionBy("nemonico").orderBy("fecha")
    names = {"fecha_cotizacion": "fecha", "valor": "nemonico", "cierre_actual": "precio_cierre", "maxima_actual": "precio_maximo", "minima_actual": "precio_minimo"}
    q = quotes.select(*(F.col(c).alias(names.get(c, c)) for c in quotes.columns))
    prev, close, high, low = F.lag("precio_cierre").over(w), F.col("precio_cierre"), F.col("precio_maximo"), F.col("precio_minimo")
    out = q.withColumn("__prev", prev).withColumn("variacion_precio", close - F.col("__prev")).withColumn("retorno_diario_pct", percent_change(close, F.col("__prev")))
    out = out.withColumn("rango_intradia", high - low).withColumn("rango_intradia_pct", F.when(low > 0, 100 * (high - low) / low)).drop("__prev")
    return out.join(macro_rows, "fecha", "left")


def broker_daily(brokers: DataFrame) -> DataFrame:
    """The nine columns of turnover with the broker's dense rank of the day, ties sharing a rank and NULL totals last."""
    w = Window.partitionBy("fecha").orderBy(F.col("monto_total").desc_nulls_last())
    nine = ["codigo_sab", "sociedad_agente_bolsa", *(f"{a}_{b}" for a in ("monto", "porcentaje") for b in ("compras", "ventas", "total"))]
    return brokers.select(F.col("fecha_negociacion").alias("fecha"), *nine).withColumn("ranking_sab_dia_por_monto", F.dense_rank().over(w))


def quarterly_market(quotes: DataFrame, bridge: DataFrame, corrected: bool = True) -> DataFrame:
    """Tickers, days, amount and volatility per company, year and quarter.

    Corrected: deviation of daily returns; published: of closes. Quotes of a hot ticker shrink to its days before.
    """
    w = Window.partitionBy("valor").orderBy("fecha_cotizacion")
    q = quotes.withColumn("x", percent_change(F.col("cierre_actual"), F.lag("cierre_actual").over(w)) if corrected else F.col("cierre_actual"))
    j = q.join(bridge.select("ruc", F.col("nemonico_valor").alias("valor")), "valor")
    return j.groupBy("ruc", F.year("fecha_cotizacion").alias("ejercicio"), quarter_label(F.quarter("fecha_cotizacion")).alias("trimestre")).agg(
        F.count_distinct("valor").alias("nemonicos_cotizados"), F.count_distinct("fecha_cotizacion").alias("dias_con_cotizacion"),
        F.sum(F.col("monto_negociado").cast("decimal(20,2)")).cast("double").alias("monto_negociado_trimestral"), F.round(F.stddev_samp("x"), 6).alias("volatilidad_retorno_pct"),
    )


PERIOD = ["ruc", "ejercicio", "trimestre"]


def split_filings(filings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(usable, invalid, ambiguous): rows without a valid company id, and of periods with more than one row, are set aside.

    The three add up to the input. The periods with more than one row are broadcast by their size or salted, so a hot
    period stays spread. A NULL year or quarter is a period like any other.
    """
    invalid = filings.where("ruc is null")
    valid = filings.where("ruc is not null").withColumn("__p", F.to_json(F.struct(*PERIOD), {"ignoreNullFields": "false"}))
    n = valid.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    marked = join_hot(valid, kept(n), "__p", "left", rows="__n")
    part = lambda many: marked.where(f"__n is {'not ' if many else ''}null").select(*filings.columns)
    return part(False), invalid, part(True)


def filing_classes(filings: DataFrame) -> DataFrame:
    """How many rows ``split_filings`` sets aside as invalid and as ambiguous, and how many it leaves: (``clase``, ``filas``).

    The periods are counted, by task and then together, and nothing is joined or broadcast. A class without rows is 0.
    """
    n = filings.groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("__n"))
    of = {"invalido": F.col("ruc").isNull(), "ambiguo": F.col("ruc").isNotNull() & (F.col("__n") > 1), "utilizable": F.col("ruc").isNotNull() & (F.col("__n") == 1)}
    sums = n.agg(*(F.coalesce(F.sum(F.when(c, F.col("__n"))), F.lit(0)).alias(k) for k, c in of.items()))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(k).alias("clase"), F.col(k).alias("filas")) for k in of))))


def company_quarter(filings: DataFrame, market: DataFrame) -> DataFrame:
    """Corrected: the usable filings with the quarter's market figures."""
    return split_filings(filings)[0].join(market, PERIOD, "left")


def company_quarter_published(filings: DataFrame, market: DataFrame, order: str, tie: str) -> DataFrame:
    """Published: of each period the row with the greatest ``order`` (then ``tie``) whatever it says."""
    w = Window.partitionBy(*PERIOD).orderBy(F.desc_nulls_last(order), F.desc(tie))
    return filings.where("ruc is not null").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r").join(market, PERIOD, "left")


def ratios(filings: DataFrame) -> DataFrame:
    """Debt ratio, net margin, return on assets and on equity; division by zero gives NULL."""
    d = F.try_divide
    return filings.select(
        "id_registro", d("pasivo_total", "activo_total").alias("razon_endeudamiento"), d("utilidad_neta", "total_ingreso").alias("margen_neto"),
        d("utilidad_neta", "activo_total").alias("roa"), d("utilidad_neta", "patrimonio_total").alias("roe"),
    )


def company_events(events: DataFrame, identity: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Events with identity and number of documents; NULL, not 0, for a case without documents."""
    counts = documents.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("total_documentos"))
    extra = [c for c in identity.columns if c not in events.columns]
    return events.join(identity.select(key, *extra), key, "left").join(counts, key, "left")


def event_impact(events: DataFrame, bridge: DataFrame, quotes: DataFrame, key: str, date: str) -> DataFrame:
    """The same day's quote of every ticker of an identified event's company."""
    e = events.where("ruc is not null").select(key, "ruc", F.col(date).alias("fecha_evento"))
    t = bridge.select("ruc", F.col("nemonico_valor").alias("nemonico"))
    q = quotes.select(F.col("valor").alias("nemonico"), F.col("fecha_cotizacion").alias("fecha_evento"), F.col("cierre_actual").alias("cierre_evento"), F.col("monto_negociado").alias("monto_negociado_evento"))
    return e.join(t, "ruc").join(q, ["nemonico", "fecha_evento"]).select(key, "nemonico", "fecha_evento", "cierre_evento", "monto_negociado_evento")


def event_impact_asof(events: DataFrame, bridge: DataFrame, quotes: DataFrame, key: str, date: str) -> DataFrame:
    """The last quote before an event and the first on or after it, per ticker, without an inequality join.

    The distinct event days of a ticker and its quotes are put into one sequence by day, and the neighbours come from
    two window functions, so a window holds at most two rows per ticker and day however many events there are. The
    neighbours are then joined back to the events, broadcast by their size or salted.
    """
    e = events.where("ruc is not null").select(key, "ruc", F.col(date).alias("dia")).where("dia is not null").join(bridge.select("ruc", F.col("nemonico_valor").alias("nemonico")), "ruc").select(key, "nemonico", "dia")
    q = quotes.select(F.col("valor").alias("nemonico"), F.col("fecha_cotizacion").alias("dia"), F.lit(1).alias("orden"), F.struct(F.col("fecha_cotizacion").alias("dia"), F.col("cierre_actual").alias("cierre"), F.col("monto_negociado").alias("monto")).alias("p"))
    a = e.select("nemonico", "dia").distinct().select("nemonico", "dia", F.lit(0).alias("orden"), F.lit(None).cast(q.schema["p"].dataType).alias("p"))
    w = Window.partitionBy("nemonico").orderBy("dia", "orden")
    before = F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # in descending order the running last value is the next quote on or after the event
    back = Window.partitionBy("nemonico").orderBy(F.desc("dia"), F.desc("orden"))
    after = F.last("p", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    days = q.unionByName(a).withColumn("antes", before).withColumn("despues", after).where("orden = 0").select(F.struct("nemonico", "dia").alias("__k"), "antes", "despues")
    return join_hot(e.withColumn("__k", F.struct("nemonico", "dia")), kept(days), "__k").select(
        key, "nemonico", F.col("dia").alias("fecha_evento"), F.col("antes.dia").alias("fecha_cotizacion_previa"), F.col("despues.dia").alias("fecha_cotizacion_evento_o_siguiente"),
        F.col("antes.cierre").alias("cierre_previo"), F.col("despues.cierre").alias("cierre_evento"),
        F.try_divide(100 * (F.col("despues.cierre") - F.col("antes.cierre")), F.col("antes.cierre")).alias("retorno_evento_pct"), (F.col("despues.monto") - F.col("antes.monto")).alias("cambio_monto_negociado"),
    )
