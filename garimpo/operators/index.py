"""The inverted index in long form: postings, vocabulary, lengths, statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.functions import codepoints as cp
from garimpo.functions import folding
from garimpo.workdir import materialize

BLOCK = 4096  # postings of a block of the nested index


def analyse(chunks: DataFrame, key: str = "id_chunk", text: str = "texto", terms: list[str] | None = None) -> DataFrame:
    """(term, key, tf, dl): the terms of every chunk, or those named, with the chunk's number of terms; and for each chunk a row without a term.

    Keys are taken to be distinct, so that a chunk's terms are counted where it
    lies: a map without any shuffle. Null and empty texts have only the row without a term.
    """
    wanted = None if terms is None else pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, t in cp.spans(batch.column(1)):
                found = folding.count_terms(t, np.arange(t.rows))
                length = np.bincount(found.group, found.times, t.rows).astype(np.int64)
                term, row, times = found.text.cast(pa.string()), found.group, found.times
                if wanted is not None:
                    keep = np.flatnonzero(pc.is_in(term, wanted))
                    term, row, times = term.take(pa.array(keep)), row[keep], times[keep]
                rows = np.concatenate([row, np.arange(t.rows)])
                columns = [
                    pa.concat_arrays([term, pa.nulls(t.rows, pa.string())]), batch.column(0).take(pa.array(at + rows)),
                    pa.array(np.concatenate([times, np.zeros(t.rows, np.int64)]), pa.int64()), pa.array(length[rows], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["term", key, "tf", "dl"])

    schema = T.StructType([T.StructField("term", T.StringType()), chunks.schema[key], T.StructField("tf", T.LongType()), T.StructField("dl", T.LongType())])
    return chunks.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def postings(chunks: DataFrame, key: str = "id_chunk", text: str = "texto") -> DataFrame:
    """(term, key, tf): occurrences of every term in every chunk."""
    return analyse(chunks, key, text).where("term is not null").select("term", key, "tf")


def vocabulary(post: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def nested(post: DataFrame, key: str = "id_chunk", block: int = BLOCK) -> DataFrame:
    """The nested form of the index for export: (term, bloco, chunks, frequencia): each term's postings in key order, in blocks.

    A term in every chunk has as many blocks as it needs: no row holds more than about ``block`` postings
    (a few more where the sampled bounds of the blocks are uneven).
    The blocks of a term follow each other in key order.
    """
    ranges = max(1, -(-post.select("term").count() // block))
    placed = post.repartitionByRange(ranges, "term", key).select("term", key, "tf", F.spark_partition_id().alias("bloco"))
    entry = F.struct(F.col(key).alias("id_chunk"), F.col("tf").alias("frequencia"))
    return placed.groupBy("term", "bloco").agg(F.array_sort(F.collect_list(entry)).alias("chunks"), F.sum("tf").alias("frequencia"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n, avgdl (0 for none), total."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))


def index_totals(post: DataFrame, chunks: int | None = None) -> DataFrame:
    """One row: terms, postings, occurrences."""
    return vocabulary(post).agg(F.count("*").alias("total_termos"), F.coalesce(F.sum("df"), F.lit(0)).alias("total_postings"), F.coalesce(F.sum("cf"), F.lit(0)).alias("total_ocorrencias"))


def restrict(post: DataFrame, load: DataFrame, key: str = "id_chunk") -> DataFrame:
    """Postings of the chunks of a load; terms without any vanish."""
    return post.join(load.select(key).distinct(), key, "left_semi")


def orphans(post: DataFrame, chunks: DataFrame, key: str = "id_chunk") -> DataFrame:
    """Postings whose chunk doesn't exist."""
    return post.join(chunks.select(key).distinct(), key, "left_anti")


@dataclass(frozen=True)
class Index:
    """A built index: chunk attributes, postings (with the length of their chunk), lengths, and the numbers of the collection."""

    chunks: DataFrame
    postings: DataFrame
    lengths: DataFrame
    n: int
    mean_length: float
    total: int

    @staticmethod
    def build(chunks: DataFrame, key: str = "id_chunk", text: str = "texto") -> Index:
        """Index ``chunks`` once into the shared folder; searches then read only the postings of their terms.

        Postings are ordered by term and chunk over ranges of both: a term in every chunk is
        spread over as many tasks as it needs, and a filter on terms skips all other ranges.
        """
        made = materialize(analyse(chunks, key, text).withColumn("__chunk", F.col("term").isNull()), "termos", ["__chunk"])
        lengths = made.where("__chunk").select(key, "dl")
        post = made.where("not __chunk").select("term", key, "tf", "dl").repartitionByRange("term", key).sortWithinPartitions("term", key)
        n, mean, total = corpus_stats(lengths).first()  # three numbers
        return Index(chunks, materialize(post, "postings"), lengths, n, mean, total)

    def restricted(self, load: DataFrame, key: str = "id_chunk") -> Index:
        """The index of a part of the chunks; document frequencies and lengths are those of the part."""
        keys = materialize(load.select(key).distinct(), "carga")
        lengths = self.lengths.join(keys, key, "left_semi")
        n, mean, total = corpus_stats(lengths).first()
        return Index(self.chunks.join(keys, key, "left_semi"), self.postings.join(keys, key, "left_semi"), lengths, n, mean, total)

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession
