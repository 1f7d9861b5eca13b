"""Readers of raw files: JSON envelopes, CSV series and metadata, whole texts, XML answers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names under which services put the array of records. Fixed values.
ARRAY_NAMES = ("Resultado", "resultado", "data", "Data", "result", "value")


@dataclass(frozen=True)
class Dataset:
    """An entry of the registry: where a dataset's files lie and how to read them."""

    name: str
    source: str
    format: str  # json, csv, parquet or text
    path: str
    array: str | None = None
    key: tuple[str, ...] = ()
    partitions: tuple[str, ...] = ()


def read(spark: SparkSession, d: Dataset, root: str) -> DataFrame:
    path = f"{root.rstrip('/')}/{d.path}"
    if d.format == "json":
        return envelopes(spark, path, (d.array,) if d.array else ARRAY_NAMES)
    return {"csv": series, "parquet": lambda s, p: s.read.parquet(p), "text": whole_texts}[d.format](spark, path)


def envelopes(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str] = ARRAY_NAMES, schema: T.StructType | None = None, require_unique: bool = False, required: Sequence[str] = ()) -> DataFrame:
    """The records of JSON files that wrap an array of records in an object, or are a bare array of records.

    With ``schema`` (of the files) nothing is inferred. ``required``: columns by which bare records are known.
    Files that wrap their records under different names are read together, columns by name. ``require_unique``: refuse
    several names. Raises ValueError if there is no array.
    """
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    df = (reader.schema(schema) if schema else reader).json(paths if isinstance(paths, str) else list(paths))
    return unwrap(df, names, require_unique, required)


def unwrap(df: DataFrame, names: Sequence[str] = ARRAY_NAMES, require_unique: bool = False, required: Sequence[str] = ()) -> DataFrame:
    arrays = [n for n in names if n in df.columns and isinstance(df.schema[n].dataType, T.ArrayType) and isinstance(df.schema[n].dataType.elementType, T.StructType)]
    if required and set(required) <= set(df.columns):
        return df
    if not arrays:
        raise ValueError(f"no array of records under {tuple(names)}; there are {df.columns}")
    if require_unique and len(arrays) > 1:
        raise ValueError(f"several arrays of records: {arrays}")
    parts = [df.select(F.explode(a).alias("r")).select("r.*") for a in arrays]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def whole_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files whose JSON document goes over several lines, one row each: ``nombre``, ``documento`` (NULL where it can't be
    read). A file is read as a whole by one task, so its lines can't come out of order."""
    t = whole_texts(spark, path, "*")
    return t.select("nombre", F.from_json("texto", schema).alias("documento"))


def series(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """A CSV series with header, all text unless ``infer``; a blank first header becomes ``_c0``."""
    return spark.read.option("header", True).option("inferSchema", infer).option("recursiveFileLookup", True).csv(path)


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """A quoted UTF-8 CSV, all text, with byte-order mark and blanks taken out of the column names."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)
    return df.toDF(*(c.replace("﻿", "").strip() for c in df.columns))


def whole_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """One row per text file: ``nombre``, ``ruta``, ``texto``. Read in the JVM; no Python worker sees the rows."""
    df = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_name").alias("nombre"), F.col("_metadata.file_path").alias("ruta"), F.col("value").alias("texto"))


def link_texts(documents: DataFrame, texts: DataFrame, direct: str, canonical: str) -> DataFrame:
    """Documents with the text of their own file, else of the file of the canonical copy (``texto``, ``origen_texto``)."""
    name = lambda c: F.regexp_replace(c, "(?i)\\.pdf$", ".txt")
    t = texts.groupBy("nombre").agg(F.min("texto").alias("texto"))
    d = documents.withColumn("__a", name(F.col(direct))).withColumn("__b", name(F.col(canonical)))
    d = d.join(t.select(F.col("nombre").alias("__a"), F.col("texto").alias("__ta")), "__a", "left").join(t.select(F.col("nombre").alias("__b"), F.col("texto").alias("__tb")), "__b", "left")
    how = F.when(F.col("__ta").isNotNull(), "DIRECTO").when(F.col("__tb").isNotNull(), "CANONICO").otherwise("SIN_TEXTO")
    return d.withColumn("texto", F.coalesce("__ta", "__tb")).withColumn("origen_texto", how).drop("__a", "__b", "__ta", "__tb")


def xml_answers(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """Records of stored XML answers of a service (the network part stays outside), with the file they came from."""
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(schema).load(path).withColumn("_archivo", F.col("_metadata.file_name"))


def with_lineage(df: DataFrame, source: str, day: str) -> DataFrame:
    return df.withColumn("fuente", F.lit(source)).withColumn("fecha_ingesta", F.to_date(F.lit(day)))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames those columns that are there."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def typed(df: DataFrame, texts: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Texts trimmed, numbers cast to double with NULL for what is none; columns that are not there are left out."""
    return df.select(*(F.trim(F.col(c).cast("string")).alias(c) for c in texts if c in df.columns), *(F.col(c).try_cast("double").alias(c) for c in numbers if c in df.columns))


def partition_of(spark: SparkSession, path: str, **values) -> DataFrame:
    """One partition of a stored table with its partition columns; only its folder is listed."""
    sub = "/".join(f"{k}={v}" for k, v in values.items())
    return spark.read.option("basePath", path).parquet(f"{path}/{sub}")
