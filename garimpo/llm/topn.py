"""Problem 5: the N highest-scoring items of every group, by descending score bands.

The score range is cut into bands at quantiles of all scores, and each task writes its
rows by band, without a shuffle. Within a batch a group keeps its N best distinct items at most,
which loses nothing: an item among the best of all is among the best of its batch. So
a group of any size costs a few rows a batch.

Bands are processed from the top. Rows of groups that are already full are dropped before they
move, as long as the full groups can be broadcast (counted, ``BROADCAST_GROUPS``), else by an
anti-join. The rest moves once, by group, to where the band's predecessors lie: what a group has is kept
in tables bucketed by group, which are joined where they are. Items that the group has are left out
(an item's highest score is in its highest band), the others are ranked exactly, and their
places continue after those the group has.

Rows with a null group or item, and null, NaN, zero or negative scores are left
out (``only_positive``). An item that repeats in a group counts once with its
highest score. Ties: item ascending by code points. Fewer than N: all.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.workdir import bucketed, materialize

#: Shares of the rows above each band edge, from the top band down.
BAND_SHARES = (0.05, 0.35, 0.6)
BROADCAST_GROUPS = 1_000_000  # full groups that are broadcast at most


def band_edges(rows: DataFrame, score: str, shares: tuple[float, ...] = BAND_SHARES) -> list[float]:
    """Distinct descending scores that cut the rows at about the given shares."""
    found = rows.agg(F.percentile_approx(score, [1 - s for s in shares], 2000).alias("q")).first()["q"]
    return sorted(set(found or []), reverse=True)


def best_of_batch(group: np.ndarray, item: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Rows of the ``n`` first distinct items of each group, by score descending, then item.

    ``group`` and ``item`` are ranks, those of items in code-point order.
    """
    order = np.lexsort((-score, item, group))
    group, item, score = group[order], item[order], score[order]
    best = np.append(True, (np.diff(group) != 0) | (np.diff(item) != 0))[: len(order)]  # each item at its highest score
    order, group, item, score = order[best], group[best], item[best], score[best]
    again = np.lexsort((item, -score, group))
    order, group = order[again], group[again]
    first = np.flatnonzero(np.append(True, np.diff(group) != 0))[: len(group)]
    place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    return order[place < n]


def _ranks(col: pa.Array) -> np.ndarray:
    """A number for each value, in the order of the values (of strings: of their bytes, which is that of code points)."""
    return np.asarray(pc.rank(col, sort_keys="ascending", tiebreaker="dense")).astype(np.int64)


def reduced(rows: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """``rows`` (group, item, __s) without those that can't be among the first ``n`` of their group; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = best_of_batch(_ranks(batch.column(0)), _ranks(batch.column(1)), np.asarray(batch.column(2)), n)
                yield batch.take(pa.array(np.sort(keep)))

    return rows.mapInArrow(run, rows.schema)


def top_n_per_group(
    df: DataFrame, group: str, item: str, score: str, n: int = 5, only_positive: bool = True, shares: tuple[float, ...] = BAND_SHARES, broadcast_groups: int = BROADCAST_GROUPS
) -> DataFrame:
    """(group, posicao, item, score) of the first ``n`` distinct items of each group."""
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(F.col(group).alias("__g"), F.col(item).alias("__i"), F.col(score).cast("double").alias("__s"))
    rows = rows.where(F.col("__g").isNotNull() & F.col("__i").isNotNull() & F.col("__s").isNotNull() & ~F.isnan("__s"))
    if only_positive:
        rows = rows.where("__s > 0")
    edges = band_edges(rows, "__s", shares)
    band = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        band = F.when(F.col("__s") >= edges[k], k).otherwise(band)
    bands = materialize(reduced(rows, "__g", "__i", n).withColumn("__band", band.cast("int")), "faixas", ["__band"])
    order = Window.partitionBy("__g").orderBy(F.col("__s").desc(), F.col("__i"))
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made: list[DataFrame] = []
    filled = 0
    state: DataFrame | None = None  # of each group that isn't full: its number of items, and the items, fewer than n
    for k in range(len(edges) + 1):
        part = bands.where(F.col("__band") == k).drop("__band")
        full = [m.where(F.col("posicao") == n).select("__g") for m in made]
        filled += full[-1].count() if full else 0
        few = 0 < filled <= broadcast_groups
        if few:
            part = part.join(F.broadcast(_union(full)), "__g", "left_anti")
        part = part.repartition(buckets, "__g")
        for f in full if not few else ():
            part = part.hint("merge").join(f.hint("merge"), "__g", "left_anti")
        if state is None:
            part = part.withColumn("__have", F.lit(0))
        else:
            part = part.join(state.hint("merge"), "__g", "left").where(~F.coalesce(F.array_contains("__own", F.col("__i")), F.lit(False)))
            part = part.withColumn("__have", F.coalesce("__have", F.lit(0)))
        best = part.groupBy("__g", "__i").agg(F.max("__s").alias("__s"), F.first("__have").alias("__have"))
        ranked = best.withColumn("posicao", F.row_number().over(order) + F.col("__have")).where(F.col("posicao") <= n)
        made.append(bucketed(ranked.select("__g", "posicao", "__i", "__s"), "__g", buckets, "topo"))
        if k < len(edges):
            new = made[-1].groupBy("__g").agg(F.max("posicao").alias("__now"), F.collect_list("__i").alias("__new"))
            if state is None:
                after = new.select("__g", F.col("__now").alias("__have"), F.col("__new").alias("__own"))
            else:
                none = F.array().cast(T.ArrayType(rows.schema["__i"].dataType))
                both = F.concat(F.coalesce("__own", none), F.coalesce("__new", none))
                after = state.hint("merge").join(new.hint("merge"), "__g", "full").select("__g", F.coalesce("__now", "__have").alias("__have"), both.alias("__own"))
            state = bucketed(after.where(F.col("__have") < n), "__g", buckets, "abertos")
    return _union(made).select(F.col("__g").alias(group), "posicao", F.col("__i").alias(item), F.col("__s").alias(score))


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)
