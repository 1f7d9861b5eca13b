"""References to records that do not exist.

References are first aggregated to their distinct keys, with the first and last day each is used, so a key with a third
of all rows is one row from there on. Parents are cut into ranges of a 64-bit hash of their key and stored as sorted
arrays, one per range; the distinct keys are sent to their range and probe its array in batches by binary search. Only
keys that fail somewhere are taken back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.operators.shared import join_hot, kept

#: Parents of one range.
PARENTS_PER_RANGE = 50_000
FAR_PAST, FAR_FUTURE = -(10**6), 10**7


def _range(key: Column, bits: int) -> Column:
    """Equal slices of the hash space: uniform whatever the keys look like, and the same on both sides."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("int") if bits else F.lit(0)


def parent_arrays(parents: DataFrame, bits: int) -> DataFrame:
    """One row per range: sorted keys, and per key the first and last day (days since 1970) it is valid."""
    one = F.array_sort(F.collect_list(F.struct("k", "desde", "hasta")))
    per = parents.groupBy(_range(F.col("k"), bits).alias("rango")).agg(one.alias("p"))
    return per.select("rango", F.col("p.k").alias("claves"), F.col("p.desde").alias("desde"), F.col("p.hasta").alias("hasta"))


def probed(keys: DataFrame, parents: DataFrame, bits: int) -> DataFrame:
    """``keys`` (k, ...) with ``hay``, ``desde`` and ``hasta`` of the parent (k, desde, hasta: unique keys), if any.

    A task holds the arrays of one range at a time and streams the range's keys past them.
    """
    other = [c for c in keys.columns if c != "k"]
    tables = parent_arrays(parents, bits).withColumn("orden", F.lit(0))
    child = keys.withColumn("rango", _range(F.col("k"), bits)).withColumn("orden", F.lit(1))
    both = tables.unionByName(child, allowMissingColumns=True)
    # sorted by range, the arrays come before the keys that probe them
    arranged = both.repartition("rango").sortWithinPartitions("rango", "orden").select("rango", "orden", "claves", "desde", "hasta", "k", *other)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields)
    names = keys.columns

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sorted_keys, since, until = None, np.array([], dtype=object), np.array([]), np.array([])
        for b in batches:
            ranges, kinds = b.column("rango").to_numpy(), b.column("orden").to_numpy()
            cut = np.flatnonzero(np.r_[True, (ranges[1:] != ranges[:-1]) | (kinds[1:] != kinds[:-1]) | (kinds[1:] == 0)])
            for a, z in zip(cut, np.r_[cut[1:], len(ranges)]):
                if kinds[a] == 0:
                    at = ranges[a]
                    sorted_keys = b.column("claves")[a].values.to_numpy(zero_copy_only=False)
                    since, until = (b.column(c)[a].values.to_numpy() for c in ("desde", "hasta"))
                    continue
                if ranges[a] != at:  # no parent in this range
                    at, sorted_keys = ranges[a], sorted_keys[:0]
                part = b.slice(a, z - a)
                k = part.column("k").to_numpy(zero_copy_only=False)
                if len(sorted_keys):
                    i = np.minimum(np.searchsorted(sorted_keys, k), len(sorted_keys) - 1)
                    found = sorted_keys[i] == k
                    lo, hi = since[i], until[i]
                else:
                    found = np.zeros(len(k), dtype=bool)
                    lo = hi = np.zeros(len(k), dtype=np.int32)
                hit = pa.array(found.astype(bool))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), hit, pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=[*names, "hay", "desde", "hasta"])

    return arranged.mapInArrow(probe, f"{types}, hay boolean, desde int, hasta int")


def orphans(refs: DataFrame, refs_key: Column, refs_day: Column | None, keep: list[Column], parents: DataFrame, parent_key: Column, valid_from: Column | None = None, valid_to: Column | None = None) -> DataFrame:
    """``keep`` of every reference without a parent that is valid on its day, and ``motivo``.

    motivo: ``inexistente`` (no parent has the key), ``anterior`` or ``posterior`` (the parent begins later or has
    ended). A parent listed more than once is valid from the earliest of its days to the latest; a NULL day leaves that
    end open. A reference without day is only looked up by key. A NULL key refers to nothing and is no orphan. Empty
    parents make every reference an orphan. Parents that are repeated count once. Extra columns are not read.

    The references are scanned twice and their rows never shuffled, unless more keys fail than can be broadcast.
    """
    number = lambda c: F.date_diff(c, F.lit("1970-01-01").cast("date"))
    bound = lambda c, default: F.coalesce(number(c), F.lit(default)) if c is not None else F.lit(default)
    known = (
        parents.select(parent_key.alias("k"), bound(valid_from, FAR_PAST).alias("d"), bound(valid_to, FAR_FUTURE).alias("h"))
        .where("k is not null")
        .groupBy("k")
        .agg(F.min("d").alias("desde"), F.max("h").alias("hasta"))
    )
    bits = max(0, (known.count() // PARENTS_PER_RANGE).bit_length())
    day = number(refs_day) if refs_day is not None else F.lit(None).cast("int")
    child = refs.select(refs_key.alias("__k"), day.alias("__dia"), F.struct(*keep).alias("__fila")).where("__k is not null")
    keys = child.groupBy(F.col("__k").alias("k")).agg(F.min("__dia").alias("primero"), F.max("__dia").alias("ultimo"))
    failing = kept(probed(keys, known, bits).where("not hay or primero < desde or ultimo > hasta").select(F.col("k").alias("__k"), "hay", "desde", "hasta"))
    why = F.when(~F.col("hay"), "inexistente").when(F.col("__dia") < F.col("desde"), "anterior").when(F.col("__dia") > F.col("hasta"), "posterior")
    return join_hot(child, failing, "__k").select("__fila.*", why.alias("motivo")).where("motivo is not null")


def orphan_report(missing: DataFrame, table: Column, period: Column) -> DataFrame:
    """Orphans per table, period and cause: number of references and of distinct keys (column ``clave_referida``)."""
    return missing.groupBy(table.alias("tabla"), period.alias("periodo"), "motivo").agg(F.count(F.lit(1)).alias("referencias"), F.count_distinct("clave_referida").alias("claves"))
