"""Ordinals and running sums that no single task has to compute alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.workdir import materialize


def global_ordinal(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its position (from 1) in the order of the columns ``order``, which must be a key.

    Rows are range-partitioned and written; each range is numbered by itself
    and moved by the number of rows in the ranges before. Only the counts of the ranges come together.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    written = materialize(ranged.withColumn("__range", F.spark_partition_id()), "ordem")
    counts = written.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = written.withColumn("__rn", F.row_number().over(within)).join(offsets, "__range")
    return numbered.withColumn(name, F.col("__offset") + F.col("__rn")).drop("__range", "__offset", "__rn")


def running_sum(df: DataFrame, group: list[str], order: str, value: str, block: Column) -> DataFrame:
    """``df`` with ``antes`` and ``ate``, the sums of ``value`` in ``order`` before and with each row of its group.

    ``block`` grows with ``order``: only the sums of the blocks of a group come
    together in one task, and the rows of one block.
    """
    df = df.withColumn("__b", block)
    sums = df.groupBy(*group, "__b").agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    inner = Window.partitionBy(*group, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__c", F.sum(value).over(inner)).join(sums, [*group, "__b"])
    return out.withColumn("ate", F.col("__o") + F.col("__c")).withColumn("antes", F.col("ate") - F.col(value)).drop("__b", "__o", "__c")
