"""Batch deltas: new, unchanged, corrected and missing rows of a batch against a table, gates, staging, publishing."""

from __future__ import annotations

import secrets
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lonja.functions.text import payload_hash
from lonja.operators.audit import key_uniqueness
from lonja.operators.shared import join_hot, kept, small
from lonja.sources.files import Files, is_below, normal
from lonja.sources.writers import write_table

#: The state of a manifest whose staging is checked and not yet published. Fixed value.
STATE_STAGED = "STAGING_VALIDADO_NO_PUBLICADO"
#: Up to so many partitions are listed as literals of a filter.
LISTED = 500


class GateError(ValueError):
    """A gate found errors; nothing was written."""


@dataclass
class Gate:
    """Collects findings and refuses to go on if there are any."""

    errors: list[str] = field(default_factory=list)

    def expect(self, ok: bool, message: str) -> Gate:
        if not ok:
            self.errors.append(message)
        return self

    def check(self) -> None:
        if self.errors:
            raise GateError("; ".join(self.errors))


def schema_map(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def cast_like(batch: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The batch with the columns and types of the table, and a row of counts of values that can't be cast."""
    types = schema_map(current)
    missing = sorted(set(types) - set(batch.columns))
    if missing:
        raise GateError(f"batch lacks {missing}")
    tried = {c: F.col(c).try_cast(t) for c, t in types.items()}
    lost = batch.agg(*(F.count_if(F.col(c).isNotNull() & v.isNull()).alias(c) for c, v in tried.items()))
    return batch.select(*(v.alias(c) for c, v in tried.items())), lost


def conflicts(batch: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Keys that occur in the batch with more than one payload, and how many."""
    return batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("filas"), F.count_distinct(payload_hash(*payload)).alias("versiones")).where("versiones > 1")


def classify(current: DataFrame, batch: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Every key of either side with ``estado``: nuevo, igual, corregido or ausente.

    Payloads are compared null-safely; other columns (lineage) don't count. A key that occurs more than once on a side
    is represented by the row with the least payload hash, so the outcome does not depend on the order of rows; look
    for them with ``conflicts`` before. Rows with a NULL in a key column are left out. One shuffle on the key per side.
    """
    usable = " and ".join(f"`{k}` is not null" for k in keys)

    def side(df: DataFrame, name: str) -> DataFrame:
        h = df.where(usable).select(*keys, payload_hash(*payload).alias("h"))
        return h.groupBy(*keys).agg(F.min("h").alias(name))

    both = side(current, "antes").join(side(batch, "despues"), keys, "full_outer")
    state = F.when(F.col("antes").isNull(), "nuevo").when(F.col("despues").isNull(), "ausente").when(F.col("antes") == F.col("despues"), "igual").otherwise("corregido")
    return both.select(*keys, state.alias("estado"))


def latest(batch: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """One row per key: of several the one with the least payload hash. Rows with a NULL in a key column are left out."""
    usable = " and ".join(f"`{k}` is not null" for k in keys)
    rest = [c for c in batch.columns if c not in keys]
    one = batch.where(usable).groupBy(*keys).agg(F.min_by(F.struct(*rest), payload_hash(*payload)).alias("r"))
    return one.select(*(c if c in keys else F.col(f"r.{c}").alias(c) for c in batch.columns))


def replaced(current: DataFrame, news: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``news`` (unique by key) in the place of its own of these keys."""
    cols = current.columns
    return current.join(news.select(*keys), keys, "left_anti").select(*cols).unionByName(news.select(*cols))


def merged(current: DataFrame, batch: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """The table after the batch: rows of keys outside the batch stay, the batch's rows take the place of theirs.

    Of several batch rows with one key the one with the least payload hash is taken. Rows of the table with a NULL key
    stay; such rows of the batch are left out.
    """
    return replaced(current, latest(batch, keys, payload), keys)


def run_id() -> str:
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}_{secrets.token_hex(4)}"


def inside(path: str, allowed: Sequence[str], apart_from: Sequence[str] = ()) -> str:
    """``path``, if it lies below one of the allowed folders and neither holds nor lies in one of ``apart_from``."""
    gate = Gate().expect(any(is_below(path, a) for a in allowed), f"{path} is not below {list(allowed)}")
    for other in apart_from:
        gate.expect(normal(path) != normal(other) and not is_below(path, other) and not is_below(other, path), f"{path} overlaps {other}")
    gate.check()
    return path


def fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 over the sorted sizes, times and names of the files below ``path``."""
    return Files(spark).fingerprint(path)


def stage(table: DataFrame, path: str, partitions: Sequence[str], keys: Sequence[str], manifest: dict | None = None) -> dict:
    """Writes ``table`` once to a new folder, reads it back, and returns the manifest; raises if counts or keys differ.

    The rows are counted while they are written, so the table is computed once.
    """
    seen = Observation()
    write_table(table.observe(seen, F.count(F.lit(1)).alias("n")), path, partitions, mode="errorifexists")
    rows = seen.get["n"]
    got = key_uniqueness(table.sparkSession.read.parquet(path), keys).first()
    Gate().expect(got["filas"] == rows, f"{got['filas']} rows stored, {rows} expected").expect(got["claves"] == rows, f"{rows - got['claves']} repeated keys").check()
    return {**(manifest or {}), "estado": STATE_STAGED, "ruta": path, "filas": rows, "claves": got["claves"], "huella": fingerprint(table.sparkSession, path)}


def of_partitions(df: DataFrame, partitions: Sequence[str], values: DataFrame, outside: bool = False) -> DataFrame:
    """The rows of ``df`` in (or ``outside``) the listed partitions; a NULL is a partition like any other.

    Up to LISTED partitions become a filter on literals, by which a scan skips the folders of the others; more are joined.
    """
    some = [r.asDict() for r in values.select(*partitions).distinct().limit(LISTED + 1).collect()]
    if len(some) > LISTED:
        on = [df[p].eqNullSafe(values[p]) for p in partitions]
        return df.join(small(values), on, "left_anti" if outside else "left_semi")
    hit = F.lit(False)
    for v in some:
        one = F.lit(True)
        for p in partitions:
            one = one & (F.col(p).isNull() if v[p] is None else F.coalesce(F.col(p) == F.lit(v[p]), F.lit(False)) if outside else F.col(p) == F.lit(v[p]))
        hit = hit | one
    return df.where(~hit if outside else hit)


def affected_partitions(current: DataFrame, news: DataFrame, keys: Sequence[str], partitions: Sequence[str]) -> DataFrame:
    """The partitions that the batch changes: those its rows belong to and those that the table has their keys in."""
    old = current.select(*keys, *(p for p in partitions if p not in keys)).join(small(news.select(*keys)), list(keys), "left_semi")
    return old.select(*partitions).unionAll(news.select(*partitions)).distinct()


def apply_batch(
    current: DataFrame, batch: DataFrame, keys: list[str], payload: list[str], partitions: list[str], target: str, allow_corrections: bool = True,
    table_path: str | None = None, business_key: list[str] | None = None, conflicts_to: str | None = None, allowed: Sequence[str] | None = None,
) -> dict:
    """The whole protocol: path, schema, in-batch and business-key gates, classification, staging of the affected
    partitions, verification and manifest. Nothing is written if the batch changes nothing (``SIN_CAMBIOS``).

    Affected is every partition that a changed row belongs to or that the table has its key in, so a key that moves
    leaves its old partition. Each affected partition is staged whole. After staging the keys of the whole table as it
    would be are counted: they have to be the old ones and the new ones, each once. ``business_key``: new keys under a
    business key that is there already, or twice in the batch, block the batch (``CONFLICTO``) and are written to
    ``conflicts_to``. ``allowed``: folders that the target has to lie in, apart from the table itself.
    """
    spark = current.sparkSession
    if allowed is not None:
        inside(target, allowed, [table_path] if table_path else [])
    typed, lost = cast_like(batch, current)
    bad = {c: n for c, n in lost.first().asDict().items() if n}
    Gate().expect(not bad, f"values that can't be cast: {bad}").expect(conflicts(typed, keys, payload).isEmpty(), "a key has several versions in the batch").check()
    before = fingerprint(spark, table_path) if table_path else None
    state = classify(current, typed, keys, payload).cache()
    try:
        counts = {r["estado"]: r["n"] for r in state.groupBy("estado").agg(F.count(F.lit(1)).alias("n")).collect()}
        Gate().expect(allow_corrections or not counts.get("corregido"), f"{counts.get('corregido')} corrected rows").check()
        summary = {"nuevos": counts.get("nuevo", 0), "iguales": counts.get("igual", 0), "corregidos": counts.get("corregido", 0)}
        if not summary["nuevos"] and not summary["corregidos"]:
            return {**summary, "estado": "SIN_CAMBIOS", "particiones": 0}
        news = latest(typed, keys, payload).join(state.where("estado in ('nuevo', 'corregido')").select(*keys), keys, "left_semi")
        if business_key:
            clash = key_conflicts(current, news, keys, business_key)
            if not clash.isEmpty():
                if conflicts_to:
                    write_table(clash, conflicts_to, mode="errorifexists")
                return {**summary, "estado": "CONFLICTO", "conflictos": clash.count(), "ruta_conflictos": conflicts_to}
        old, parts = key_uniqueness(current, keys).first(), None
        rows = replaced(current, news, keys)
        if partitions:
            parts = kept(affected_partitions(current, news, keys, partitions))
            rows = replaced(of_partitions(current, partitions, parts), news, keys)
        manifest = stage(rows.select(*current.columns), target, partitions, keys, summary)
        staged = spark.read.parquet(target)
        rest = of_partitions(current, partitions, parts, outside=True).select(*keys) if partitions else current.limit(0).select(*keys)
        new = key_uniqueness(rest.unionAll(staged.select(*keys)), keys).first()
        Gate().expect(new["claves"] == old["claves"] + summary["nuevos"], f"{new['claves']} keys after the batch, {old['claves']} before and {summary['nuevos']} new").expect(
            new["repetidas"] <= old["repetidas"], f"{new['repetidas']} repeated keys after the batch, {old['repetidas']} before"
        ).check()
        manifest |= {"claves_tabla": new["claves"], "repetidas_tabla": new["repetidas"], "huella_tabla": before}
        if partitions:
            there = staged.select(*partitions).distinct()
            on = [parts[p].eqNullSafe(there[p]) for p in partitions]
            manifest |= {"particiones": parts.count(), "vaciadas": [r.asDict() for r in parts.join(there, on, "left_anti").collect()]}  # a row per folder
            parts.write.mode("errorifexists").parquet(f"{target}.particiones")
        return manifest
    finally:
        state.unpersist()


def _folder(partitions: Sequence[str], values: dict) -> str:
    """Where the table keeps a partition, by Spark's own naming."""
    return "/".join(f"{p}={'__HIVE_DEFAULT_PARTITION__' if values[p] is None else quote(str(values[p]), safe=' ')}" for p in partitions)


def publish(spark: SparkSession, manifest: dict, table_path: str, partitions: list[str], confirm: bool = False, keys: list[str] | None = None, backup: str | None = None) -> bool:
    """Puts the staged partitions in the place of the table's, if the staging, and the table since, are as the manifest
    says and ``confirm`` is set.

    One publisher at a time: a lock file next to the table is created first and removed at the end. With ``backup`` the
    affected partitions are copied there before anything changes (``restore`` puts them back). Partitions that the batch
    left empty are removed. With ``keys`` the whole table's keys are counted afterwards against the manifest.
    """
    files = Files(spark)
    Gate().expect(manifest.get("estado") == STATE_STAGED, "nothing is staged").check()
    Gate().expect(fingerprint(spark, manifest["ruta"]) == manifest["huella"], "the staging changed").check()
    if not confirm:
        return False
    lock = f"{table_path.rstrip('/')}.lock"
    Gate().expect(files.create(lock, run_id()), f"{lock} exists: another run is publishing").check()
    try:
        stated = manifest.get("huella_tabla")
        Gate().expect(stated is None or fingerprint(spark, table_path) == stated, "the table changed since the staging").check()
        if backup and files.exists(table_path):
            now = spark.read.parquet(table_path)
            if partitions:
                now = of_partitions(now, partitions, spark.read.parquet(f"{manifest['ruta']}.particiones"))
            write_table(now, backup, partitions, mode="errorifexists")
        write_table(spark.read.parquet(manifest["ruta"]), table_path, partitions, dynamic=bool(partitions))
        for values in manifest.get("vaciadas", []):
            files.delete(f"{table_path}/{_folder(partitions, values)}")
        if keys and "claves_tabla" in manifest:
            got = key_uniqueness(spark.read.parquet(table_path), keys).first()
            Gate().expect((got["claves"], got["repetidas"]) == (manifest["claves_tabla"], manifest["repetidas_tabla"]), f"{got['claves']} keys published, {manifest['claves_tabla']} expected").check()
    finally:
        files.delete(lock)
    return True


def restore(spark: SparkSession, manifest: dict, table_path: str, partitions: list[str], backup: str) -> None:
    """Undoes a publication from its backup: the affected partitions become what they were, and new ones are removed."""
    files = Files(spark)
    lock = f"{table_path.rstrip('/')}.lock"
    Gate().expect(files.create(lock, run_id()), f"{lock} exists: another run is publishing").check()
    try:
        old = spark.read.parquet(backup)
        write_table(old, table_path, partitions, dynamic=bool(partitions))
        if partitions:
            there, parts = old.select(*partitions).distinct(), spark.read.parquet(f"{manifest['ruta']}.particiones")
            for r in parts.join(there, [parts[p].eqNullSafe(there[p]) for p in partitions], "left_anti").collect():  # a row per folder
                files.delete(f"{table_path}/{_folder(partitions, r.asDict())}")
    finally:
        files.delete(lock)


def key_conflicts(current: DataFrame, batch: DataFrame, ids: list[str], business_key: list[str]) -> DataFrame:
    """Batch rows with a new id whose business key the table has under another id, or the batch has more than once.

    ``causa``: EXISTE_EN_TABLA or REPETIDA_EN_LOTE (the first if both). A NULL in the business key matches nothing.
    """
    usable = " and ".join(f"`{k}` is not null" for k in business_key)
    new = batch.join(current.select(*ids), ids, "left_anti").where(usable)
    there = new.join(current.where(usable).select(*business_key).distinct(), business_key, "left_semi").withColumn("causa", F.lit("EXISTE_EN_TABLA"))
    many = new.groupBy(*business_key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    twice = new.join(many, business_key, "left_semi").join(there.select(*ids), ids, "left_anti").withColumn("causa", F.lit("REPETIDA_EN_LOTE"))
    return there.unionByName(twice)


def with_collisions(rows: DataFrame, key: str, count: str = "cantidad_clave_negocio", flag: str = "colision_clave_negocio") -> DataFrame:
    """``rows`` with the number of rows of their business key and whether there are several; rebuilt after every merge.

    A NULL key has no count and no collision. Only the counts of keys with several rows are joined back, by their size,
    and the keys that many rows share are salted, so they stay spread; a key that is not among them has one row.
    """
    n = kept(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1))
    plain = rows.drop(count, flag)
    of_row = F.when(F.col(key).isNotNull(), F.coalesce(F.col(count), F.lit(1).cast("long")))
    return join_hot(plain, n, key, "left", rows=count).select(*(c for c in plain.columns), of_row.alias(count), F.col(count).isNotNull().alias(flag))


def save_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    Files(spark).write_json(path, manifest)
