"""Building blocks that several operators use: checkpoints, size-checked broadcasts, ordered predecessors."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast if its measured content, as JSON text, is no larger than this. The driver holds such a
#: side several times (fetched, hashed, and in pieces to be sent), and those of one query at once.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``, else (tests, one machine) a temporary one."""
    sc = spark.sparkContext
    set_already = sc._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lonja-")
    sc.setCheckpointDir(path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared folder, so that several readers don't compute it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Inputs above this size, by the planner's statistics, have work enough per partition and are not spread.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work in Python that costs far more than a shuffle.

    Only a small table, by its size and not by the number of cores, is shuffled for it: one of a few small files is
    scanned in few tasks. ``df`` should be a scan with a projection, below which nothing shuffles.
    """
    plan = df._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if plan.toRdd().getNumPartitions() >= cores else df.repartition(cores * 2)


def fits(df: DataFrame, limit: int | None = None) -> bool:
    """Whether the content of ``df``, measured by one aggregate, is small enough to be broadcast.

    The measure is the text of all values, so it holds for long texts too. ``df`` should be stored or cheap.
    """
    text = F.octet_length(F.to_json(F.struct(*df.columns)))
    return (df.agg(F.sum(text.cast("long"))).first()[0] or 0) <= (BROADCAST_BYTES if limit is None else limit)


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it fits; else the planner chooses a join that shuffles."""
    return F.broadcast(df) if fits(df) else df


def ranged(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` stored in ranges of ``columns`` (NULLs first), with the number of a row's range in ``__run``."""
    return kept(df.repartitionByRange(*(F.col(c).asc_nulls_first() for c in columns)).withColumn("__run", F.spark_partition_id()))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``: 1, 2, ... in ``order`` within ``group``. A group is numbered over as many tasks as its ranges fill."""
    runs = ranged(df, [*group, *order])
    own = F.row_number().over(Window.partitionBy(*group, "__run").orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    before = Window.partitionBy(*(f"__g{i}" for i in range(len(group)))).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = runs.groupBy(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__run").alias("__r")).agg(F.count(F.lit(1)).alias("__n"))
    shifts = sizes.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return _by_range(runs.withColumn(out, own), shifts, group).withColumn(out, F.col(out) + F.col("__shift")).drop("__run", "__r", "__n", "__shift", *(f"__g{i}" for i in range(len(group))))


def _by_range(runs: DataFrame, per: DataFrame, group: list[str]) -> DataFrame:
    """``runs`` with the row of ``per`` (one per group and range) that belongs to its range."""
    on = F.col("__run") == F.col("__r")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return runs.join(per, on, "left")


def previous_rows(df: DataFrame, group: list[str], order: str, ties: list[str], payload: Column, out: str) -> DataFrame:
    """Adds ``out``: ``payload`` of the row before, by (``order``, ``ties``), within ``group``; NULL for a group's first row.

    A group may hold any share of the rows, so it is not sorted in one task: the rows lie in ranges of group and order,
    and the predecessor of a range's first row is the last row of the group's range before, looked up among one row per
    range. ``order`` may be NULL, and equal for all rows; NULLs come first.
    """
    keys = [order, *ties]
    runs = ranged(df, [*group, *keys]).withColumn("__payload", F.struct(payload.alias("v")))
    w = Window.partitionBy(*group, "__run").orderBy(*(F.col(c).asc_nulls_first() for c in keys))
    key = F.struct(*(F.struct(F.col(c).isNotNull(), F.col(c)) for c in keys))
    last = runs.groupBy(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__run").alias("__r")).agg(F.max_by("__payload", key).alias("__last"))
    before = last.withColumn("__before", F.lag("__last").over(Window.partitionBy(*(f"__g{i}" for i in range(len(group)))).orderBy("__r"))).drop("__last")
    joined = _by_range(runs.withColumn("__prev", F.lag("__payload").over(w)), before, group)
    return joined.withColumn(out, F.coalesce("__prev", "__before")["v"]).drop("__run", "__payload", "__prev", "__before", "__r", *(f"__g{i}" for i in range(len(group))))


def join_hot(big: DataFrame, lookup: DataFrame, key: str | list[str], how: str = "inner", salt: int = 16, rows: str | None = None, hot: int = 100_000) -> DataFrame:
    """``big`` joined (inner or left) to ``lookup`` where one key may hold a third of ``big``.

    A lookup that fits is broadcast; beyond that both sides are shuffled, and keys with at least ``hot`` rows of ``big``
    are salted, so that such a key is spread over ``salt`` tasks while the lookup's other rows are sent once. ``rows``: the
    lookup's column that says how many rows of ``big`` have its key, if it has one; else they are counted. Rows with a
    NULL in the key match nothing and are spread too.
    """
    if fits(lookup):
        return big.join(F.broadcast(lookup), key, how)
    keys = [key] if isinstance(key, str) else list(key)
    n = lookup.select(*keys, F.col(rows).alias("__rows")) if rows else big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    # one row per `hot` rows of the larger side at most
    often = kept(n.where(F.col("__rows") >= hot).select(*keys, F.lit(True).alias("__hot")).distinct())
    spread_out = F.col("__hot").isNotNull()
    for k in keys:
        spread_out = spread_out | F.col(k).isNull()
    salted = big.join(small(often), keys, "left").withColumn("__sal", F.when(spread_out, F.pmod(F.xxhash64(*big.columns), F.lit(salt))).otherwise(0).cast("int")).drop("__hot")
    copies = lookup.join(small(often), keys, "left").withColumn("__sal", F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return salted.join(copies, [*keys, "__sal"], how).drop("__sal")
