"""The baseline model: will the next session's return be large? Features, temporal split, training and evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions.text import percent_change

FEATURES = ["retorno_pct", "rango_pct", "log_monto", "tipo_cambio", "embig"]


def features(quotes: DataFrame, macro: DataFrame) -> DataFrame:
    """Return, range, log amount and macro values per eligible row, and the absolute return of the next eligible row.

    A row is eligible if its previous traded row has a positive close. Two windows on one partitioning: one shuffle.
    """
    w = Window.partitionBy("valor").orderBy("fecha_cotizacion")
    low, high = F.col("minima_actual"), F.col("maxima_actual")
    q = quotes.withColumn("__prev", F.lag("cierre_actual").over(w)).where("__prev > 0")
    q = q.select(
        "valor", F.col("fecha_cotizacion").alias("fecha"), percent_change(F.col("cierre_actual"), F.col("__prev")).alias("retorno_pct"),
        F.when(low > 0, 100 * (high - low) / low).alias("rango_pct"), F.log1p(F.greatest(F.coalesce("monto_negociado", F.lit(0.0)), F.lit(0.0))).alias("log_monto"),
    )
    q = q.withColumn("retorno_siguiente_abs", F.abs(F.lead("retorno_pct").over(Window.partitionBy("valor").orderBy("fecha"))))
    return q.join(macro, "fecha", "left")


@dataclass
class Fitted:
    model: object
    threshold: float
    metrics: dict[str, float]
    confusion: DataFrame
    scored: DataFrame


def train(table: DataFrame, last_train_year: int, test_year: int, percentile: float = 0.75) -> Fitted:
    """Logistic regression on rows up to a year, tested on a later one; the label threshold comes from the training rows only."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    whole = table.dropna(subset=[*FEATURES, "retorno_siguiente_abs"])
    fit, test = whole.where(F.year("fecha") <= last_train_year), whole.where(F.year("fecha") == test_year)
    threshold = fit.approxQuantile("retorno_siguiente_abs", [percentile], 0.001)[0]
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features")
    labelled = lambda d: ready.transform(d.withColumn("label", (F.col("retorno_siguiente_abs") >= threshold).cast("double")))
    model = LogisticRegression(maxIter=50, regParam=0.0, elasticNetParam=0.0).fit(labelled(fit))
    scored = model.transform(labelled(test)).select("label", "prediction", "rawPrediction").cache()
    metrics = {"roc_auc": BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(scored)}
    for m in ("f1", "accuracy", "weightedPrecision", "weightedRecall"):
        metrics[m] = MulticlassClassificationEvaluator(metricName=m).evaluate(scored)
    return Fitted(model, threshold, metrics, scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("filas")), scored)


def majority_share(table: DataFrame, label: Column) -> DataFrame:
    """The accuracy of always saying the more frequent label."""
    n = table.groupBy(label.alias("l")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg((F.max("n") / F.sum("n")).alias("acierto_mayoria"))
