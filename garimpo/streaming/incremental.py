"""An index that grows with arriving chunks, and arrival counts, as streams.

An extension: the batch engine has no stream. Each micro-batch writes its
postings into a folder of its own number, overwriting it when a batch is repeated after a
failure, so that the index has every posting once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from garimpo.operators.index import postings

POSTING_SCHEMA = "term string, id_chunk string, tf bigint, lote bigint"


def first_arrivals(chunks: DataFrame, late: str = "1 day") -> DataFrame:
    """Each chunk once, as long as its repeats arrive within ``late``; state older than that is dropped."""
    return chunks.withWatermark("carregado_em", late).dropDuplicatesWithinWatermark(["id_chunk"])


def grow_index(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start writing the postings of a stream of chunks under ``path``; ends when what is there has been read."""

    def write(batch: DataFrame, number: int) -> None:
        postings(batch).write.mode("overwrite").parquet(f"{path}/lote={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def grown_postings(spark: SparkSession, path: str) -> DataFrame:
    """The postings written so far."""
    return spark.read.schema(POSTING_SCHEMA).parquet(path).drop("lote")


def arrivals(chunks: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Chunks and words that arrived in each window and load."""
    window = F.window("carregado_em", every)
    counted = chunks.withWatermark("carregado_em", late).groupBy(window.alias("janela"), "id_carga")
    return counted.agg(F.count("*").alias("chunks"), F.sum("quantidade_palavras").alias("palavras")).select(F.col("janela.start").alias("inicio"), "id_carga", "chunks", "palavras")
