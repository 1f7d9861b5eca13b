"""The pipeline as a whole: raw profile, typed tables with a report each, products in staging, and their audit."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.operators import audit
from lonja.operators.delta import STATE_STAGED, Gate, run_id
from lonja.plans import gold, views
from lonja.sources import table
from lonja.sources.files import Files
from lonja.sources.writers import write_table


@dataclass
class Report:
    conjunto: str
    estado: str
    filas: int = 0
    claves: int = 0
    repetidas: int = 0
    segundos: float = 0.0
    error: str = ""


@dataclass(frozen=True)
class Step:
    name: str
    make: Callable[[SparkSession, str], DataFrame]
    keys: tuple[str, ...]
    partitions: tuple[str, ...] = ()


TYPED = [
    Step("cotizaciones", lambda s, r: views.quotes(s, r, views.PASSED_ON), ("valor", "fecha_cotizacion"), ("anio", "mes")),
    Step("puente", views.bridge, ("ruc", "nemonico_valor")),
    Step("cuentas", views.filings_with_collisions, ("id_registro",), ("ejercicio", "trimestre_num")),
    Step("riesgo", views.risk, ("fecha",)),
    Step("eventos", views.events, ("numero_expediente",), ("coherencia_temporal",)),
    Step("identidad", views.identity, ("numero_expediente",)),
]


def _events(spark, root):
    return gold.company_events(views.events(spark, root), views.identity(spark, root), table(spark, root, "documents"), "numero_expediente")


def _impact(spark, root):
    return gold.event_impact(_events(spark, root), views.bridge(spark, root), views.quotes(spark, root), "numero_expediente", "fecha_presentacion_date")


PRODUCTS = [
    Step("mercado_valor_diario", lambda s, r: gold.market_daily(views.quotes(s, r, views.PASSED_ON), views.macro(s, r)), ("nemonico", "fecha")),
    Step("actividad_sab_diaria", lambda s, r: gold.broker_daily(views.brokers(s, r)), ("fecha", "codigo_sab")),
    Step("empresa_trimestre", lambda s, r: gold.company_quarter(views.filings(s, r), gold.quarterly_market(views.quotes(s, r), views.bridge(s, r))), ("ruc", "ejercicio", "trimestre")),
    Step("hechos_empresa", _events, ("numero_expediente",)),
    Step("impacto_hechos_valor", _impact, ("numero_expediente", "nemonico")),
]


def run(spark: SparkSession, root: str, steps: list[Step], out: str, run: str | None = None) -> list[Report]:
    """Writes every step once below ``out/run_id=...``, reads it back and audits its key. A step that fails is reported
    and does not stop the others; the manifest lists all."""
    run = run or run_id()
    reports = []
    for s in steps:
        began = time.time()
        r = Report(s.name, "ERROR")
        try:
            path = f"{out}/run_id={run}/{s.name}"
            write_table(s.make(spark, root), path, s.partitions, mode="errorifexists")
            r.filas, r.claves, r.repetidas = audit.key_uniqueness(spark.read.parquet(path), s.keys).first()
            Gate().expect(r.repetidas == 0, f"{r.repetidas} repeated keys").check()
            r.estado = STATE_STAGED
        except Exception as e:  # isolated on purpose
            r.error = f"{type(e).__name__}: {str(e)[:300]}"
        r.segundos = round(time.time() - began, 3)
        reports.append(r)
    Files(spark).write_json(f"{out}/run_id={run}/manifest.json", {"run_id": run, "conjuntos": [asdict(r) for r in reports]})
    return reports


def profile(spark: SparkSession, root: str, names: list[str]) -> list[dict]:
    """Rows, columns, types and NULLs per column of each raw table, one pass each; errors are isolated per table."""
    out = []
    for n in names:
        began = time.time()
        try:
            df = table(spark, root, n)
            nulls = {r["columna"]: r["nulos"] for r in audit.null_profile(df).collect()}  # a row per column
            rows = df.agg(F.count(F.lit(1))).first()[0]
            out.append({"conjunto": n, "filas": rows, "columnas": len(df.columns), "esquema": dict(df.dtypes), "nulos": nulls, "muestra": [r.asDict() for r in df.take(3)], "segundos": round(time.time() - began, 3)})
        except Exception as e:  # isolated on purpose
            out.append({"conjunto": n, "error": f"{type(e).__name__}: {str(e)[:300]}"})
    return out


def verify(spark: SparkSession, root: str) -> DataFrame:
    """The audits' verdicts: (``medida``, ``valor``, ``estado``)."""
    parts = [
        audit.expected(audit.key_uniqueness(views.quotes(spark, root), ["valor", "fecha_cotizacion"]), {"filas": (1, None), "repetidas": (0, 0)}),
        audit.expected(audit.key_uniqueness(views.bridge(spark, root), ["ruc", "nemonico_valor"]), {"filas": (1, None), "repetidas": (0, 0)}),
        audit.expected(audit.key_coverage(views.quotes(spark, root), views.bridge(spark, root).withColumnRenamed("nemonico_valor", "valor"), "valor"), {"cobertura": (80, 100)}),
        audit.expected(audit.series_audit(views.fx(spark, root), "fecha", "tipo_cambio"), {"fechas_nulas": (0, 0), "repetidas": (0, 0)}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
