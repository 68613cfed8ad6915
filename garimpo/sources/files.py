"""JSON and CSV artefacts, and generated candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


BLOCK = 1000  # rows under one envelope


def write_json(df: DataFrame, path: str, envelope: str | None = None, block: int = BLOCK) -> None:
    """One JSON object a line, in as many files as there are partitions; with ``envelope`` lines that hold up to ``block`` rows in an array of that name."""
    if envelope is not None:
        numbered = df.select(F.struct(*df.columns).alias("__row"), F.floor(F.monotonically_increasing_id() / block).alias("__b"))
        df = numbered.groupBy("__b").agg(F.collect_list("__row").alias(envelope)).select(envelope)  # block rows at most
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str, envelope: str | None = None, whole: bool = True) -> DataFrame:
    """JSON lines with a declared schema; with ``envelope`` files (or lines, unless ``whole``) whose rows stand in an array of that name, or alone."""
    if envelope is None:
        return spark.read.schema(schema).json(path)
    rows = T.StructType.fromDDL(schema)
    wrapped = T.StructType([T.StructField(envelope, T.ArrayType(rows)), *rows.fields])
    read = spark.read.schema(wrapped).option("multiLine", whole).json(path)
    bare = read.where(F.col(envelope).isNull()).select(rows.names)
    return read.select(F.inline(envelope)).select(rows.names).unionByName(bare)


def write_csv(df: DataFrame, path: str, decimal_comma: bool = False, mark: bool = False) -> None:
    """A semicolon table with a header; doubles with a decimal comma if asked; with ``mark`` each file starts with a byte-order mark."""
    if decimal_comma:
        df = df.select(*(F.translate(F.col(f.name).cast("string"), ".", ",").alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name for f in df.schema))
    if mark:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, decimal_comma: bool = False) -> DataFrame:
    """A semicolon table with a header and a declared schema."""
    wanted = T.StructType.fromDDL(schema)
    if not decimal_comma:
        return spark.read.schema(wanted).option("sep", ";").option("header", True).csv(path)
    raw = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.DoubleType) else f.dataType) for f in wanted])
    read = spark.read.schema(raw).option("sep", ";").option("header", True).csv(path)
    return read.select(*(F.translate(f.name, ",", ".").cast("double").alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name for f in wanted))


def _candidates(spark: SparkSession, n: int, score: Column) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("i"), F.format_string("chunk_%04d", "id").alias("id_chunk"), score.cast("double").alias("score"))


def synthetic_candidates(spark: SparkSession, n: int, scores: int = 41) -> DataFrame:
    """``n`` candidates whose scores, integers below ``scores``, tie often; the same on every run."""
    return _candidates(spark, n, (F.col("id") * 7919 + 104729) % scores)


def pareto_candidates(spark: SparkSession, n: int, shape: float = 1.8) -> DataFrame:
    """``n`` candidates with many low and few high scores, drawn from about ``2 n`` values, so that some tie; the same on every run."""
    drawn = (F.col("id") * 48271 + 11) % (2 * n)
    even = ((drawn * 7919 + 104729) % 65537 + 0.5) / 65537
    return _candidates(spark, n, F.round(F.pow(even, F.lit(-1 / shape)), 4))


def uniform_candidates(spark: SparkSession, n: int, top: float = 100.0) -> DataFrame:
    """``n`` candidates with scores spread evenly below ``top``; the same on every run."""
    return _candidates(spark, n, F.round(((F.col("id") * 7919 + 104729) % 65537 + 0.5) / 65537 * top, 4))
