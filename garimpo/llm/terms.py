"""Problem 4: occurrences and chunk counts of every distinct term.

Each task counts the terms of its Arrow batches before anything moves
(``folding``), so that a term in every chunk costs a few rows a task. The partial counts are written to
the shared folder in partitions by the first bits of the term's hash, as many as the
size of the texts suggests. All partitions beyond the size limit are read again and written by their next
bits in one job, level by level, until all fit (recursive radix spilling); one that holds a single hash isn't split. Each
partition is then aggregated by DuckDB within a memory limit, in a task of its own.

A chunk is a distinct ``id``; of its rows the latest with a text counts. Null
texts and null ids count nowhere; empty texts are chunks without terms. An
empty table gives no terms.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.functions import codepoints as cp
from garimpo.functions import folding
from garimpo.operators.latest import latest_rows
from garimpo.workdir import new_path

RARE_BELOW, COMMON_SHARE = 3, 0.5
RADIX_BITS, MOST_BITS, RADIX_MAX = 4, 12, 60  # bits of a split, of the first one at most, of the hash that can be used
PARTITION_BYTES = 64 << 20
DUCKDB_MEMORY = "192MB"
SPAN_BYTES = 4 << 20  # text counted at once
HELD_ROWS = 300_000  # partial counts that a task merges before it gives them away


def latest_texts(df: DataFrame, key: str, text: str, when: str, keep: list[str] = ()) -> DataFrame:
    """One row for each distinct key: of its rows with a text the latest (ties: the greater text)."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, *keep, text, when)
    return latest_rows(rows, [key], when, [F.col(text).desc()]).drop(when)


def partial_counts(df: DataFrame, text: str, group: str | None) -> DataFrame:
    """(grupo, term, chunks, ocorrencias) counted within each task, in parts of bounded size."""
    names = ["grupo", "term", "chunks", "ocorrencias"]

    def counted(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        groups = batch.column(0).dictionary_encode()
        number = np.asarray(groups.indices.fill_null(-1)) if len(groups) else np.zeros(0, np.int64)
        for at, t in cp.spans(batch.column(1), SPAN_BYTES):
            found = folding.count_terms(t, number[at : at + t.rows].astype(np.int64))
            of = groups.dictionary.take(pa.array(found.group, mask=found.group < 0)).cast(pa.string())
            yield pa.table([of, found.text, pa.array(found.rows, pa.int64()), pa.array(found.times, pa.int64())], names)

    def merged(held: list[pa.Table]) -> pa.Table:
        total = pa.concat_tables(held).group_by(["grupo", "term"], use_threads=False).aggregate([("chunks", "sum"), ("ocorrencias", "sum")])
        return total.rename_columns({"chunks_sum": "chunks", "ocorrencias_sum": "ocorrencias"}).select(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            for part in counted(batch):
                held.append(part)
                rows += part.num_rows
                if rows > HELD_ROWS:
                    held = [merged(held)]
                    rows = held[0].num_rows
                    if rows > HELD_ROWS // 2:
                        yield from held[0].to_batches(20_000)
                        held, rows = [], 0
        if held:
            yield from merged(held).to_batches(20_000)

    source = df.select((F.col(group) if group else F.lit(None)).cast("string").alias("grupo"), F.col(text).alias("texto"))
    return source.mapInArrow(run, "grupo string, term string, chunks bigint, ocorrencias bigint")


def _key() -> Column:
    return F.xxhash64("grupo", "term")


def _prefix(bits: int) -> Column:
    """The first ``bits`` bits of a row's hash."""
    return F.shiftrightunsigned(_key(), 64 - bits).cast("bigint")


def _sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of each partition folder under ``path``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [s.getPath() for s in fs.listStatus(target) if s.isDirectory()]
    return {p.toString(): fs.getContentSummary(p).getLength() for p in folders}


def first_bits(size: int, limit: int = PARTITION_BYTES) -> int:
    """Bits of the first split for texts of ``size`` bytes: their terms' counts take no more room than they."""
    return min(max((max(size, 1) // limit).bit_length(), RADIX_BITS), MOST_BITS)


def radix_partitions(counts: DataFrame, limit: int = PARTITION_BYTES, first: int = RADIX_BITS, bits: int = RADIX_BITS) -> list[str]:
    """Write partial counts by hash bits, splitting what exceeds ``limit`` bytes; paths of the final partitions.

    A level is one writing job, whatever the number of partitions it splits, spread over the width of the
    cluster; a second, small one looks whether what is still too large can be split at all.
    """
    spark, schema = counts.sparkSession, counts.schema
    width = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part, used, buckets, final = counts, first, 1 << first, []
    while True:
        path = new_path(spark, f"radix{used}")
        # a bucket is written by several tasks, so that none has to hold all of it
        salts = max(1, -(-width // buckets))
        placed = part.withColumn("balde", _prefix(used))
        placed.repartition(min(buckets * salts, 4 * width), "balde", F.pmod(F.xxhash64("term", F.lit(used)), F.lit(salts))).write.partitionBy("balde").parquet(path)
        sizes = _sizes(spark, path)
        large = [folder for folder, size in sizes.items() if size > limit]
        final += [folder for folder in sizes if folder not in set(large)]
        if large and used + bits <= RADIX_MAX:
            # a partition of one hash can't be split
            read = spark.read.schema(schema).parquet(*large).select(_prefix(used).alias("balde"), _key().alias("k"))
            mixed = {r["balde"] for r in read.groupBy("balde").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a != b").select("balde").collect()}
            split = [folder for folder in large if int(folder.rsplit("=", 1)[1]) in mixed]
            final += [folder for folder in large if folder not in set(split)]
        else:
            split = []
            final += large
        if not split:
            return final
        part, used, buckets = spark.read.schema(schema).parquet(*split), used + bits, len(split) << bits


def _spill_folder(where: str, local: bool) -> str:
    """Where DuckDB spills: beside the partition, or where the shared folder is no file system, with Spark's own spill files."""
    return os.path.join(where if local else SparkFiles.getRootDirectory(), "_spill")


def aggregate_partitions(spark: SparkSession, paths: list[str], memory: str = DUCKDB_MEMORY) -> DataFrame:
    """(grupo, term, chunks, ocorrencias) summed over the partitions, each by DuckDB in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, where = FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", uri) else uri)
                config = {"memory_limit": memory, "threads": 1, "preserve_insertion_order": False}
                config["temp_directory"] = _spill_folder(where, fs.type_name == "local")
                with duckdb.connect(config=config) as con:
                    part = ds.dataset(where, filesystem=fs, format="parquet", exclude_invalid_files=False).scanner(batch_size=32_768).to_reader()
                    con.register("part", part)
                    total = con.sql("select grupo, term, sum(chunks)::bigint chunks, sum(ocorrencias)::bigint ocorrencias from part group by all")
                    yield from total.to_arrow_reader(20_000)

    schema = T.StructType([T.StructField(n, k) for n, k in (("grupo", T.StringType()), ("term", T.StringType()), ("chunks", T.LongType()), ("ocorrencias", T.LongType()))])
    if not paths:
        return spark.createDataFrame([], schema)
    tasks = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path")
    return tasks.mapInArrow(run, schema)


def term_frequencies(
    df: DataFrame, key: str = "id_chunk", text: str = "texto", when: str = "carregado_em", group: str | None = None, limit: int = PARTITION_BYTES
) -> DataFrame:
    """(term, chunks, ocorrencias), for each value of ``group`` if one is named, over all rows."""
    texts = latest_texts(df, key, text, when, [group] if group else [])
    counts = partial_counts(texts, text, group)
    size = int(texts.select(text)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    out = aggregate_partitions(df.sparkSession, radix_partitions(counts, limit, first_bits(size, limit)))
    return out.withColumnRenamed("grupo", group) if group else out.drop("grupo")


def mark_terms(freq: DataFrame, total: int, rare_below: int = RARE_BELOW, common_share: float = COMMON_SHARE) -> DataFrame:
    """``marca``: ``rara`` in fewer than ``rare_below`` chunks, ``comum`` in more than ``common_share`` of them, else null.

    A term that is both (few chunks altogether) is ``rara``.
    """
    mark = F.when(F.col("chunks") < rare_below, "rara").when(F.col("chunks") > F.lit(common_share) * F.lit(total), "comum")
    return freq.withColumn("marca", mark)


def chunk_total(df: DataFrame, key: str = "id_chunk", text: str = "texto") -> int:
    """Number of distinct ids with a text; one number comes to the driver."""
    return df.where(F.col(text).isNotNull()).agg(F.countDistinct(key)).first()[0]
