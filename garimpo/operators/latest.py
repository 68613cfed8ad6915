"""The latest row of every key, without moving the rows of keys that occur once."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.workdir import materialize

BROADCAST_KEYS, BROADCAST_BYTES = 100_000, 16 << 20  # repeated keys, and their bytes, that are broadcast at most; beyond, all rows are shuffled by key


def latest_rows(df: DataFrame, keys: list[str], when: str, ties: list[Column] = (), broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row for each distinct ``keys``: the latest by ``when``, then the first by ``ties``.

    Null keys form a key of their own; callers filter them where they don't count.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(when).desc_nulls_last(), *ties)

    def newest(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")

    repeated = materialize(df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys), "repetidas")
    width = functools.reduce(Column.__add__, (F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys))
    number, size = repeated.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    if number > broadcast_keys or size > BROADCAST_BYTES:
        return newest(df)  # each task keeps one row a key before anything moves
    few = F.broadcast(repeated.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))))
    same = functools.reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    return df.join(few, same, "left_anti").unionByName(newest(df.join(few, same, "left_semi")))
