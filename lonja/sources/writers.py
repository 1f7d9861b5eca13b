"""Writers of tables and reports, and the ingestion of raw files with checksums and quarantine."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.sources.files import Files


def write_table(df: DataFrame, path: str, partitions: Sequence[str] = (), mode: str = "overwrite", dynamic: bool = False) -> None:
    """Parquet with Snappy. ``mode``: overwrite, append or errorifexists (staging, written once). ``dynamic``: an
    overwrite replaces only the partitions that ``df`` has. Rows are gathered by partition first, so that each has few
    files; a partition with a large share of the rows is split over several tasks at run time (rebalance hint)."""
    w = (df.hint("rebalance", *partitions) if partitions else df).write.mode(mode).option("compression", "snappy")
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def input_file_count(df: DataFrame) -> int:
    """How many files the scans below ``df`` read."""
    return len(df.inputFiles())


#: What refuses a file, in this order: the text of the finding, and the condition under which it is found.
def _findings(extension: str) -> list[tuple[str, Column]]:
    text = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    encoded = ~F.is_valid_utf8(F.col("content").cast("string"))
    return [
        ("vacío", F.col("length") == 0),
        (f"no es .{extension}", ending != f".{extension}"),
        ("no es UTF-8", ending.isin(".json", ".csv") & encoded),
        ("JSON ilegible", (ending == ".json") & F.try_parse_json(text).isNull()),
        ("CSV sin cabecera", (ending == ".csv") & (F.trim(F.split(text, "\r?\n")[0]) == "")),
    ]


def checked(spark: SparkSession, paths: Sequence[str], extension: str) -> DataFrame:
    """One row (``ruta``, ``bytes``, ``sha256``, ``hallazgo``) per file that is there; NULL in hallazgo: the file is fine.

    Files are read whole by the executors, one per row, and neither parsed nor hashed on the driver.
    """
    files = spark.read.format("binaryFile").load(list(paths))
    first = F.coalesce(*(F.when(c, F.lit(t)) for t, c in _findings(extension.lower().lstrip("."))), F.lit(None).cast("string"))
    return files.select(F.col("path").alias("ruta"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), first.alias("hallazgo"))


@dataclass
class IngestRecord:
    archivo: str
    fuente: str
    conjunto: str
    estado: str  # SUCCESS, SKIPPED_DUPLICATE, REJECTED or FAILED
    detalle: str
    sha256: str
    destino: str
    corrida: str
    momento: str


def ingest(spark: SparkSession, lake: str, paths: Sequence[str], source: str, dataset: str, extension: str, run: str, day: str) -> list[IngestRecord]:
    """Checks raw files and lands each once in ``bronze``, by checksum; refused files go to ``quarantine``. Nothing is
    overwritten or deleted, and every outcome leaves an audit record below ``metadata``. One record per path, in order.

    A checksum's marker is created before its file is copied and in one step, so of two runs with one file one lands it.
    """
    files, out = Files(spark), []
    there = [p for p in paths if files.is_file(p)]
    found = {r["ruta"].split(":", 1)[-1].lstrip("/"): r for r in checked(spark, there, extension).collect()} if there else {}  # a short row per file
    for path in paths:
        name, row = path.rsplit("/", 1)[-1], found.get(path.split(":", 1)[-1].lstrip("/"))
        state, detail, sha, target = "REJECTED", "no existe o no es un archivo", "", ""
        try:
            if row is not None and row["hallazgo"]:
                detail, target = row["hallazgo"], f"{lake}/quarantine/{source}/{dataset}/run_id={run}/{name}"
                files.copy(path, target)
            elif row is not None:
                sha, place = row["sha256"], f"{lake}/bronze/{source}/{dataset}/ingestion_date={day}/{name}"
                marker = f"{lake}/metadata/ingestion/checksums/{sha}.json"
                if files.exists(marker):
                    state, detail = "SKIPPED_DUPLICATE", f"ya está: {files.read_text(marker)}"
                elif files.exists(place):
                    state, detail = "FAILED", "el destino existe con otro contenido"
                elif not files.create(marker, place):
                    state, detail = "SKIPPED_DUPLICATE", "otra corrida lo está cargando"
                else:
                    try:
                        files.copy(path, place)
                    except Exception:
                        files.delete(marker)
                        raise
                    state, detail, target = "SUCCESS", "válido", place
        except Exception as e:  # one file's failure must not stop the others
            state, detail = "FAILED", f"{type(e).__name__}: {str(e)[:300]}"
        record = IngestRecord(name, source, dataset, state, detail, sha, target, run, datetime.now(timezone.utc).isoformat())
        files.write_json(f"{lake}/metadata/ingestion/audit/run_id={run}/{name}.json", asdict(record))
        out.append(record)
    return out


def exit_code(records: Sequence[IngestRecord]) -> int:
    return int(any(r.estado == "FAILED" for r in records))


def reload(spark: SparkSession, lake: str, folder: str, source: str, dataset: str, version: str, expected: dict[str, int], rows: DataFrame | None = None, expected_rows: int | None = None) -> dict:
    """Lands a whole folder as a new version of a source and makes it current, if the counts are right.

    ``expected``: number of files per extension; ``rows``: a DataFrame over the folder, of ``expected_rows`` rows. Every
    landed file is compared with its original by SHA-256. Nothing is deleted: the former version stays, and ``vigente``
    is written last, so a load that fails leaves the former version current.
    """
    files = Files(spark)
    entries = files.list(folder)
    have: dict[str, int] = {}
    for e in entries:
        ending = e.name.rsplit(".", 1)[-1].lower()
        have[ending] = have.get(ending, 0) + 1
    wrong = [f"{have.get(k, 0)} .{k}, {n} expected" for k, n in expected.items() if have.get(k, 0) != n]
    n = rows.count() if rows is not None else None
    if n != expected_rows and expected_rows is not None:
        wrong.append(f"{n} rows, {expected_rows} expected")
    base = f"{lake}/bronze/{source}/{dataset}"
    if wrong:
        return {"estado": "FAILED", "detalle": "; ".join(wrong), "archivos": len(entries)}
    target = f"{base}/version={version}"
    if files.exists(target):
        return {"estado": "FAILED", "detalle": f"{target} exists", "archivos": len(entries)}
    sums = {}
    for e in entries:
        files.copy(e.path, f"{target}/{e.name}")
        sums[e.name] = files.sha256(e.path)
        if files.sha256(f"{target}/{e.name}") != sums[e.name]:
            return {"estado": "FAILED", "detalle": f"{e.name} differs after the copy", "archivos": len(entries)}
    files.write_text(f"{base}/vigente", version)
    return {"estado": "SUCCESS", "detalle": target, "archivos": len(entries), "filas": n, "sha256": sums}
