"""Differences between two copies of a dataset, found with invertible Bloom lookup tables.

Keys are cut into blocks of neighbours (buckets) and these into smaller runs. First each side is reduced to a digest per
run (number of rows, sum of row hashes), and the digests are subtracted: runs that are alike are done with, and how many
runs of a bucket differ tells about how many rows do. Then each bucket with differences is reduced to a table of cells
that hold the number of elements hashed to them and sums of their keys, row hashes and checks, as large as its estimate
asks for. The two sides' tables are subtracted, so equal rows cancel, and the rest is peeled to the keys of the rows
that differ; only these rows are fetched and compared field by field. Digests and cells are summed before they cross the
network: where files are clustered by key, as those of growing tables are, a task meets few buckets and a few bytes per
run leave it; in files of random order a run's rows leave one by one, which is no more than a join of keys and hashes
moves. Sums take the place of the usual exclusive or, so that a row delivered twice does not cancel itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.operators.shared import fits, kept, small

#: Cells of a bucket: three sub-tables of 2 ** bits, between these bits.
LEAST_BITS, MOST_BITS = 4, 10
#: Keys of a bucket (about, in the middle of the keys' range), and the runs a bucket has.
ROWS_PER_BUCKET, RUNS = 8192, 128
LOW = 0xFFFFFFFF
PARTS = ("clave_b", "clave_a", "huella_b", "huella_a", "control")


def row_hash(key: Column, fields: list[Column]) -> Column:
    """A 64-bit hash of a row; NULLs keep their place."""
    return F.xxhash64(key, *(F.struct(c.isNotNull().alias("d"), c.alias("v")) for c in fields))


def block_bits(left: DataFrame, right: DataFrame, key: str, rows_per_bucket: int) -> int:
    """How many low bits of a key are left out of its bucket's number, so that a bucket holds about ``rows_per_bucket`` rows.

    Taken from the spacing of keys between neighbouring twentieths, at its median, so keys far off form buckets of their own.
    """
    twentieths = [i / 20 for i in range(21)]
    bits = 0
    for side in (left, right):
        n, at = side.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)), F.percentile_approx(key, twentieths, 2000)).first()
        if n:
            span = float(np.median(np.diff(np.array(at, dtype=float)))) * 20 / n * rows_per_bucket
            bits = max(bits, int(np.ceil(np.log2(max(1.0, span)))))
    return min(bits, 62)


def _hashed(side: DataFrame, key: str, fields: list[Column], bits: int) -> DataFrame:
    """(``cubeta``, ``tramo``, ``k``, ``h``): bucket, run, key and row hash of each row with a key."""
    run_bits = max(0, bits - (RUNS - 1).bit_length())
    k = F.col(key).cast("long")
    return side.where(F.col(key).isNotNull()).select(F.shiftright(k, bits).alias("cubeta"), F.shiftright(k, run_bits).alias("tramo"), k.alias("k"), row_hash(F.col(key), fields).alias("h"))


def differing_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (``cubeta``, ``distintos``) of the buckets of which some runs' digests differ, and how many do."""
    digest = lambda d, sign: d.select("cubeta", "tramo", F.lit(sign).cast("long").alias("n"), (F.col("h").bitwiseAND(F.lit(LOW)) * sign).alias("a"), (F.shiftrightunsigned("h", 32) * sign).alias("b"))
    both = digest(left, 1).unionAll(digest(right, -1)).groupBy("cubeta", "tramo").agg(*(F.sum(c).alias(c) for c in ("n", "a", "b")))
    return both.where("n <> 0 or a <> 0 or b <> 0").groupBy("cubeta").agg(F.count(F.lit(1)).alias("distintos"))


def table_bits(differing: Column, runs: int) -> Column:
    """Bits of a bucket's sub-tables for ``differing`` of its ``runs``; NULL where even the largest would hardly be peeled.

    If rows differ at random, -runs * ln(1 - share) of them do, each with two elements. A table is peeled as long as it
    holds fewer elements than about 0.8 of its cells; half as many again are allowed for, and some for small numbers.
    """
    share = F.least(differing / F.lit(float(runs)), F.lit(1 - 0.5 / runs))
    cells = (-F.lit(float(runs)) * F.log1p(-share) * 2 + 8) * 1.5 / 0.8
    bits = F.greatest(F.ceil(F.log2(cells / 3)).cast("int"), F.lit(LEAST_BITS))
    return F.when(bits <= MOST_BITS, bits)


def _elements(side: DataFrame, sign: int) -> DataFrame:
    """One row per row and sub-table: bucket, cell, and what is added to the cell. ``side`` has ``bits``."""
    cells = [F.expr(f"cast((shiftrightunsigned(h, {i} * bits) & (shiftleft(1, bits) - 1)) + shiftleft({i}, bits) as int)") for i in range(3)]
    check = F.crc32(F.concat_ws(":", F.col("k").cast("string"), F.col("h").cast("string")).cast("binary"))
    add = [F.col("k").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned("k", 32), F.col("h").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned("h", 32), check]
    return side.select("cubeta", "bits", F.explode(F.array(*cells)).alias("celda"), F.lit(sign).cast("long").alias("n"), *((c * sign).alias(p) for c, p in zip(add, PARTS)))


def subtracted(left: DataFrame, right: DataFrame) -> DataFrame:
    """The non-empty cells of left minus right. Sums of halves of 32 bits stay exact up to 2 ** 31 rows per cell."""
    both = _elements(left, 1).unionAll(_elements(right, -1))
    cells = both.groupBy("cubeta", "bits", "celda").agg(*(F.sum(c).alias(c) for c in ("n", *PARTS)))
    return cells.where(" or ".join(f"{c} <> 0" for c in ("n", *PARTS)))


def _signed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))).astype(np.int64)


def peel(cells: np.ndarray, sums: np.ndarray, bits: int) -> tuple[list[tuple[int, int]], bool]:
    """(key, signed count) of the elements of a bucket's subtracted table, and whether the table was peeled empty.

    ``cells``: their numbers; ``sums``: a row per cell of n and the five parts; ``bits``: of a sub-table.
    """
    size = 3 << bits
    t = np.zeros((size, 6), dtype=np.int64)
    t[cells] = sums
    found: list[tuple[int, int]] = []
    look = np.flatnonzero(t.any(axis=1))
    while len(look):
        n = t[look, 0]
        c = look[n != 0]
        n = t[c, 0]
        exact = (t[c, 1:] % n[:, None] == 0).all(axis=1)
        c, n = c[exact], n[exact]
        each = t[c, 1:] // n[:, None]
        ok = ((each >= 0) & (each <= LOW)).all(axis=1)
        c, n, each = c[ok], n[ok], each[ok]
        if not len(c):
            break
        k, h = _signed(each[:, 0], each[:, 1]), _signed(each[:, 2], each[:, 3])
        touched: list[int] = []
        for i in range(len(c)):
            if zlib.crc32(f"{k[i]}:{h[i]}".encode()) != each[i, 4] or t[c[i], 0] != n[i] or (t[c[i], 1:] != each[i] * n[i]).any():
                continue
            hu = int(h[i]) & 0xFFFFFFFFFFFFFFFF
            at = [((hu >> (j * bits)) & ((1 << bits) - 1)) + (j << bits) for j in range(3)]
            if c[i] not in at:
                continue
            t[at] -= np.concatenate(([n[i]], each[i] * n[i]))
            found.append((int(k[i]), int(n[i])))
            touched += at
        if not touched:
            break
        touched_cells = np.unique(touched)
        look = touched_cells[t[touched_cells].any(axis=1)]
    return found, not t.any()


def _peel_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    found, empty = peel(pdf["celda"].to_numpy(), pdf[["n", *PARTS]].to_numpy(dtype=np.int64), int(pdf["bits"].iloc[0]))
    if not empty:
        return pd.DataFrame({"cubeta": pdf["cubeta"].iloc[:1], "k": pd.array([None], dtype="Int64"), "pelado": [False]})
    return pd.DataFrame({"cubeta": pdf["cubeta"].iloc[0], "k": pd.array(sorted({k for k, _ in found}), dtype="Int64"), "pelado": True})


def differing_keys(left: DataFrame, right: DataFrame, key: str, fields_left: list[Column], fields_right: list[Column], rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, int]:
    """Rows (``cubeta``, ``k``, ``pelado``) of the keys whose rows differ, and the bits that a key's bucket leaves out.

    A bucket in which more rows differ than its table can show has one row with ``pelado`` FALSE: all its keys have to
    be compared.
    """
    bits = block_bits(left, right, key, rows_per_bucket)
    a, b = _hashed(left, key, fields_left, bits), _hashed(right, key, fields_right, bits)
    runs = kept(differing_runs(a, b).withColumn("bits", table_bits(F.col("distintos"), min(RUNS, 1 << bits))))
    whole = runs.where("bits is null").select("cubeta", F.lit(None).cast("long").alias("k"), F.lit(False).alias("pelado"))
    sizes = runs.where("bits is not null").select("cubeta", "bits")
    if fits(sizes):
        a, b = (d.join(F.broadcast(sizes), "cubeta") for d in (a, b))
    else:  # too many to send: every bucket gets a table of the largest size
        a, b = (d.withColumn("bits", F.lit(MOST_BITS)) for d in (a, b))
    peeled = subtracted(a, b).groupBy("cubeta").applyInPandas(_peel_bucket, "cubeta long, k long, pelado boolean")
    return peeled.unionByName(whole), bits


def compare_copies(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fields: dict[str, tuple[str, float | None]],
    only_left: str,
    only_right: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row (``key``, ``campo``, ``izquierda``, ``derecha``) per difference, field by field.

    ``fields`` maps each compared field to (how, tolerance): "number" with its tolerance, "date" or "ticker" (trimmed,
    upper case). A key on one side only gives one row with ``only_left`` or ``only_right`` as campo. NULL differs
    from a value and equals NULL; NaN counts as NULL. The key is a bigint.

    Numbers enter the row hash as the number of their cell of a grid as wide as the tolerance: two values in one cell
    never differ by more, and those in different cells are compared exactly after the fetch. A key that occurs more
    than once on a side is compared as a set: a field differs if the sides' least or greatest values do. Rows without
    key can't be matched and give no rows. Buckets whose tables can't be peeled are compared whole, so nothing is lost
    however much differs. Other columns are not read.
    """

    def value(c: str) -> Column:
        how, tol = fields[c]
        if how == "number":
            d = F.col(c).try_cast("double")
            return F.when(~F.isnan(d), d)
        return F.nullif(F.upper(F.trim(F.col(c).cast("string"))), F.lit("")) if how == "ticker" else F.col(c).cast(how)

    def hashed(c: str) -> Column:
        how, tol = fields[c]
        return F.floor(F.col(c) / F.lit(tol) + 0.5).cast("string") if how == "number" and tol else F.col(c).cast("string")

    one, two = (side.select(F.col(key).cast("long").alias("k"), *(value(c).alias(c) for c in fields)) for side in (left, right))
    found, bits = differing_keys(one, two, "k", [hashed(c) for c in fields], [hashed(c) for c in fields], rows_per_bucket)
    found = kept(found)
    bucket = F.shiftright(F.col("k"), bits)
    keys = small(found.where("k is not null").select("k"))
    bad = found.where("not pelado").select(F.col("cubeta").alias("__c")).distinct()
    bad = None if bad.isEmpty() else small(bad)

    def fetch(side: DataFrame) -> DataFrame:
        rows = side.join(keys, "k", "left_semi")
        if bad is not None:
            in_bad = side.where("k is not null").join(bad, bucket == F.col("__c"), "left_semi")
            rows = rows.unionAll(in_bad)
        return rows.groupBy("k").agg(*(f(c).alias(f"{n}_{c}") for c in fields for n, f in (("min", F.min), ("max", F.max), ("todos", lambda c: F.count(c) == F.count(F.lit(1))))))

    a, b = fetch(one).alias("a"), fetch(two).alias("b")
    joined = a.join(b, F.col("a.k") == F.col("b.k"), "full_outer")

    def unequal(c: str) -> Column:
        how, tol = fields[c]
        ends = []
        for e in ("min", "max"):
            x, y = F.col(f"a.{e}_{c}"), F.col(f"b.{e}_{c}")
            gap = F.coalesce(F.abs(x - y) > F.lit(tol or 0.0), F.lit(False)) if how == "number" else F.coalesce(x != y, F.lit(False))
            ends.append((x.isNull() != y.isNull()) | gap)
        return ends[0] | ends[1] | (F.col(f"a.todos_{c}") != F.col(f"b.todos_{c}"))

    def row(name: str, x: Column, y: Column) -> Column:
        return F.struct(F.lit(name).alias("campo"), x.cast("string").alias("izquierda"), y.cast("string").alias("derecha"))

    nothing = F.lit(None).cast("string")
    diffs = F.array_compact(F.array(*(F.when(unequal(c), row(c, F.col(f"a.min_{c}"), F.col(f"b.min_{c}"))) for c in fields)))
    result = F.when(F.col("b.k").isNull(), F.array(row(only_left, nothing, nothing))).when(F.col("a.k").isNull(), F.array(row(only_right, nothing, nothing))).otherwise(diffs)
    return joined.select(F.coalesce("a.k", "b.k").alias(key), F.explode(result).alias("d")).select(key, "d.*")
