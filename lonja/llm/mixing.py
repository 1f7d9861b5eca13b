"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lonja.operators.shared import kept, small, spread

#: Ranks of a public byte-level BPE vocabulary; the driver reads the file and sends it to the executors.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary cuts text before it merges bytes. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DOCS_PER_BUCKET = 20_000
_loaded: dict[str, object] = {}


def _tokenizer(name: str, content: bytes):
    if name not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}
        _loaded[name] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[name]


def token_count(spark: SparkSession, text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of the whole text; 0 for NULL and empty texts. Runs in Arrow batches. The vocabulary is a fixed file of
    about a megabyte, sent to the executors once and loaded once per Python worker."""
    with open(path, "rb") as f:
        content = f.read()
    name, sent = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _tokenizer(name, sent.value)
        for s in batches:
            yield pd.Series([len(t.encode_ordinary(x)) if isinstance(x, str) else 0 for x in s], dtype="int64")

    return count(text)


def _sized(docs: DataFrame, idc: str, source: Column, text: Column, targets: DataFrame, path: str, seed: int) -> DataFrame:
    plain = lambda c: F.lower(F.trim(c))
    wanted = targets.where("fuente is not null and peso > 0").groupBy(plain(F.col("fuente")).alias("fuente")).agg(F.max("peso").alias("peso"), F.max(F.coalesce("max_repeticiones", F.lit(1))).alias("veces"))
    chosen = spread(docs.select(F.col(idc).alias("doc_id"), plain(source).alias("fuente"), text.alias("t")).where("fuente is not null and t is not null")).join(small(wanted.select("fuente")), "fuente")
    return kept(chosen.select("doc_id", "fuente", F.xxhash64(F.lit(seed), "doc_id").alias("azar"), token_count(docs.sparkSession, F.col("t"), path).alias("tokens")).where("tokens > 0")), wanted


def finish(goal: dict[str, tuple[float, int]], totals: dict[str, int], total_tokens: int | None) -> float:
    """The virtual time at which the mix ends.

    Without a budget: when the first source is used up, so that all still have their share. With one: when the budget is
    used up; sources that are used up before drop out, and the others go on at their weights. Infinite if there are
    fewer tokens than that.
    """
    ends = sorted((totals[s] * goal[s][1] / goal[s][0], s) for s in totals)
    if total_tokens is None:
        return ends[0][0] if ends else 0.0
    now, used, rate = 0.0, 0.0, sum(goal[s][0] for s in totals)
    for end, s in ends:
        if used + (end - now) * rate >= total_tokens:
            return now + (total_tokens - used) / rate
        now, used, rate = end, used + (end - now) * rate, rate - goal[s][0]
    return float("inf")


def mixed(docs: DataFrame, idc: str, source: Column, text: Column, targets: DataFrame, total_tokens: int | None = None, path: str = TOKENIZER, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """(mix, shares). mix: ``doc_id``, ``vuelta`` (0 for the first use), ``fuente``, ``tokens``, ``fin_virtual``, in its
    order; shares: per source of the targets ``peso``, ``tokens_fuente``, ``documentos``, ``usos``, ``tokens``, ``cuota``,
    the share aimed at (``cuota_objetivo``), whether the source is used up (``agotada``), and the tokens of the whole mix
    asked for and given (``tokens_pedidos``, NULL without a budget, ``tokens_dados``).

    Each source's documents are shuffled by a hash and queue up, again and again up to max_repeticiones; a document's
    virtual finish time is its source's cumulative tokens divided by the target weight. The mix is what has finished at
    the time at which the budget is used up, sorted by finish time, so every prefix has about the target shares too.
    ``total_tokens`` None: the largest budget at which every source that has documents still reaches its share. A larger
    one is filled by the sources that are not used up, and the shares show how far that is from the targets.

    A source may hold any share of the documents: cumulative tokens are taken within buckets of the shuffled order and
    shifted by the sum of the buckets before. Sources are compared trimmed and without case; documents of NULL or
    unlisted sources, without text or with no tokens are not used. Weights need not sum to 1. A source without
    documents is reported with 0. Equal hashes are ordered by id.
    """
    sized, wanted = _sized(docs, idc, source, text, targets, path, seed)
    sums = sized.groupBy("fuente").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("d")).collect()  # a row per target source
    totals, numbers = {r["fuente"]: r["n"] for r in sums}, {r["fuente"]: r["d"] for r in sums}
    goal = {r["fuente"]: (r["peso"], max(1, r["veces"])) for r in wanted.collect()}
    until = finish(goal, totals, total_tokens)
    spark = docs.sparkSession
    per = spark.createDataFrame([(s, float(p), int(v), int(totals.get(s, 0)), int(numbers.get(s, 0))) for s, (p, v) in goal.items()], "fuente string, peso double, veces int, tokens_fuente long, n_fuente long")
    bits = max(1, (sum(numbers.values()) // DOCS_PER_BUCKET).bit_length())
    cut = sized.withColumn("cubo", F.shiftrightunsigned("azar", 64 - bits))
    sums = kept(cut.groupBy("fuente", "cubo").agg(F.sum("tokens").alias("s")))
    before = Window.partitionBy("fuente").orderBy("cubo").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select("fuente", "cubo", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("previos"))
    own = Window.partitionBy("fuente", "cubo").orderBy("azar", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    queued = cut.withColumn("acumulado", F.sum("tokens").over(own)).join(small(shifts), ["fuente", "cubo"]).join(small(per), "fuente")
    turns = queued.withColumn("vuelta", F.explode(F.sequence(F.lit(0), F.col("veces") - 1)))
    end = (F.col("previos") + F.col("acumulado") + F.col("vuelta").cast("long") * F.col("tokens_fuente")) / F.col("peso")
    mix = turns.select("doc_id", "vuelta", "fuente", "tokens", end.alias("fin_virtual")).where(F.col("fin_virtual") <= F.lit(until) * (1 + 1e-12))
    used = mix.groupBy("fuente").agg(F.count_distinct("doc_id").alias("documentos"), F.count(F.lit(1)).alias("usos"), F.sum("tokens").alias("tokens"))
    shares = per.join(used, "fuente", "left").select("fuente", "peso", "veces", "n_fuente", "tokens_fuente", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documentos", "usos", "tokens")))
    # one row per source of the targets: a window over them all is a few rows
    all_of_them = Window.partitionBy(F.lit(1))
    shares = shares.withColumn("tokens_dados", F.sum("tokens").over(all_of_them)).select(
        "*", F.try_divide("tokens", "tokens_dados").alias("cuota"), F.try_divide("peso", F.sum("peso").over(all_of_them)).alias("cuota_objetivo"),
        (F.col("usos") == F.col("veces") * F.col("n_fuente")).alias("agotada"), F.lit(total_tokens).cast("long").alias("tokens_pedidos"),
    ).drop("veces", "n_fuente")
    return mix.orderBy("fin_virtual", "fuente", "doc_id"), shares
