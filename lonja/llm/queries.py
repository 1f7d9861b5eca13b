"""The queries p6 to p10 over names and texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.functions.keys import company_id, information_type, number_value, quarter, stripped, text_value, ticker
from lonja.llm import best, language, leakage, mixing, names
from lonja.llm.sql import SQL  # noqa: F401
from lonja.operators.shared import join_hot, kept, small
from lonja.sources import table


def _names_and_companies(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    bridge = table(spark, root, "puente_ruc_nemonico")
    events = table(spark, root, "eventos").select(F.col("empresa").alias("nombre"), "sector")
    filings = table(spark, root, "principales_cuentas").where(company_id(F.col("ruc")).isNull()).select(F.col("nombre_empresa").alias("nombre"), F.col("tipo_sector").alias("sector"))
    companies = bridge.select(company_id(F.col("ruc")).alias("ruc"), F.col("razon_social").alias("nombre"), F.substring(ticker(F.col("nemonico_valor")), 1, 5).alias("raiz")).where("ruc is not null")
    companies = companies.groupBy("ruc", "nombre").agg(F.collect_set("raiz").alias("raices"))
    return events.unionByName(filings), companies


def p6_links(spark: SparkSession, root: str) -> DataFrame:
    """Every distinct name that means a company of the bridge, with that company."""
    return names.link(*_names_and_companies(spark, root))


def p6_bloques(spark: SparkSession, root: str) -> DataFrame:
    """The twenty blocks with most pairs."""
    every, companies = _names_and_companies(spark, root)
    return names.blocks(every, companies, names.learn(companies, "nombre")).orderBy(F.desc(F.col("nombres") * F.col("empresas")), "clave", "linea", "region").limit(20)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    links = kept(p6_links(spark, root).select("nombre", "ruc"))
    official = table(spark, root, "puente_ruc_nemonico").select(company_id(F.col("ruc")).alias("ruc"), F.col("razon_social").alias("nombre")).distinct()
    variants = kept(links.join(official, ["nombre", "ruc"], "left_anti"))
    events = table(spark, root, "eventos").select(F.lit("eventos").alias("tabla"), F.col("numero_expediente").alias("clave"), F.col("empresa").alias("nombre"))
    filings = table(spark, root, "principales_cuentas").where(company_id(F.col("ruc")).isNull()).select(F.lit("principales_cuentas").alias("tabla"), F.col("id_registro").alias("clave"), F.col("nombre_empresa").alias("nombre"))
    return join_hot(events.unionByName(filings), variants, "nombre").where("clave is not null").select("tabla", "clave", "ruc").distinct()


FIELDS = ["activo_total", "patrimonio_total", "total_ingreso", "utilidad_neta", "pasivo_total", "ciiu"]


def _filings(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "principales_cuentas")
    trust = table(spark, root, "fuentes_confianza").where("fuente_datos is not null").groupBy(F.upper(F.trim("fuente_datos")).alias("__f")).agg(F.min("prioridad").alias("prioridad"))
    joined = f.join(small(trust), F.upper(F.trim(f["fuente_datos"])) == F.col("__f"), "left")
    return joined.select(
        "id_registro", company_id(f["ruc"]).alias("ruc"), "ejercicio", quarter(f["trimestre"]).alias("trimestre"), information_type(f["tipo_informacion"]).alias("tipo_informacion"),
        *(number_value(f[c]).alias(c) for c in FIELDS[:-1]), text_value(f["ciiu"]).alias("ciiu"), "prioridad", "fecha_registro",
    )


GROUP = ["ruc", "ejercicio", "trimestre", "tipo_informacion"]


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    s = best.surviving_fields(_filings(spark, root), GROUP, "id_registro", FIELDS, "prioridad", "fecha_registro")
    return s.select("id_grupo", "campo", F.col("id").alias("id_registro"))


def p7_records(spark: SparkSession, root: str) -> DataFrame:
    b = best.best_records(_filings(spark, root), GROUP, "id_registro", FIELDS, "prioridad", "fecha_registro")
    return b.select(*GROUP, "id_registro", "completitud")


def p8_leaks(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents")
    return leakage.leaked(d, "doc_id", "text", table(spark, root, "items_evaluacion"), "item_id", "texto").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "palabras")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_leaks(spark, root).select("doc_id", "item_id")


def _mixed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, root, "documents")
    path = spark.conf.get("lonja.tokenizer", mixing.TOKENIZER)
    return mixing.mixed(d, "doc_id", d["source"], d["text"], table(spark, root, "mezcla_objetivo"), path=path)


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    return _mixed(spark, root)[0]


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return _mixed(spark, root)[1]


def p10_languages(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents")
    model = language.fit(d, "doc_id", "text", d["lang"])
    return language.detect(d, "doc_id", "text", d["lang"], model).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    every = p10_languages(spark, root)
    wrong = (F.col("segmento") == -1) & ~F.coalesce(F.col("etiqueta") == F.col("lang"), F.lit(False))
    return every.where(wrong | (F.col("mezclado") & (F.col("segmento") >= 0))).select("doc_id", "segmento", "lang")


QUERIES = {f.__name__: f for f in (p6_found, p6_bloques, p7_found, p7_records, p8_found, p8_leaks, p9_mix, p9_shares, p10_found, p10_languages)}
