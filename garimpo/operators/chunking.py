"""Overlapping word windows over single texts and over the pages of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.functions import codepoints as cp
from garimpo.functions import folding
from garimpo.functions import text as tx
from garimpo.operators.ordinals import global_ordinal, running_sum

SIZE, OVERLAP = 200, 30
PAGE_BLOCK = 256  # pages of a document summed in one task


def check_window(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and 0 <= overlap < size")


def _last_window(n: np.ndarray, size: int, overlap: int) -> np.ndarray:
    """Number of the last window over ``n`` words: the first that reaches the end."""
    return np.maximum(n - overlap - 1, 0) // (size - overlap)


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of ``count`` numbers from ``first`` on for each row."""
    return np.repeat(np.arange(len(count)), count), cp.gather(first, count)


def chunk_texts(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows over one text a row: key, ordem, inicio_palavra, fim_palavra, quantidade_*, texto. A map without shuffle.

    The text of a window is the original span, inner white space kept. Blank
    and null texts have no window. Words and windows are offsets into the code points of a batch: only
    the windows' texts are made.
    """
    check_window(size, overlap)
    step = size - overlap
    names = ["ordem_chunk_documento", "inicio_palavra", "fim_palavra", "quantidade_palavras", "quantidade_caracteres", "texto"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, t in cp.spans(batch.column(1)):
                start, end, of = tx.words_of(t)
                n = np.bincount(of, minlength=t.rows)
                row, k = _spread(np.zeros(t.rows, np.int64), np.where(n > 0, _last_window(n, size, overlap) + 1, 0))
                lo, hi = k * step, np.minimum(k * step + size, n[row])
                base = (np.cumsum(n) - n)[row]
                a, b = start[base + lo], end[base + hi - 1]
                ints = (k + 1, lo, hi, hi - lo, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + row)), *(pa.array(x, pa.int32()) for x in ints), folding.spans_to_arrow(t.cps, a, b)], [key, *names])

    kinds = [T.IntegerType()] * 5 + [T.StringType()]
    schema = T.StructType([df.schema[key], *(T.StructField(n, kind) for n, kind in zip(names, kinds))])
    return df.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def page_words(df: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, page, __n): words of each page that has any. Texts don't move."""
    return df.select(doc, page, tx.word_count(F.col(text)).cast("bigint").alias("__n")).where("__n > 0")


def chunk_pages(df: DataFrame, doc: str, page: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows over the joined pages of each document: as ``chunk_texts``, with ``paginas``.

    Blank pages are left out, the others are joined by an empty line. Word counts are summed on keys alone; a page,
    once it knows the words before it, is cut into the parts that its windows take of it, so that no task holds a
    document: what comes together is one window.
    """
    check_window(size, overlap)
    step = size - overlap
    counts = page_words(df, doc, page, text)
    placed = running_sum(counts, [doc], page, "__n", F.floor(F.col(page) / PAGE_BLOCK))
    totals = counts.groupBy(doc).agg(F.sum("__n").alias("__total"))
    placed = placed.join(totals, doc).select(doc, page, "antes", "__total")
    pages = df.select(doc, page, F.col(text).cast("string").alias("__text")).join(placed, [doc, page])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, total = (np.asarray(batch.column(i)).astype(np.int64) for i in (3, 4))
            for at, t in cp.spans(batch.column(2)):
                start, end, of = tx.words_of(t)
                n = np.bincount(of, minlength=t.rows)
                antes, all_words = before[at : at + t.rows], total[at : at + t.rows]
                first = np.maximum(0, -(-(antes - size + 1) // step))
                last = np.minimum((antes + n - 1) // step, _last_window(all_words, size, overlap))
                row, k = _spread(first, np.maximum(last - first + 1, 0))
                lo, hi = k * step, np.minimum(k * step + size, all_words[row])
                base = (np.cumsum(n) - n - antes)[row]
                a, b = start[base + np.maximum(lo, antes[row])], end[base + np.minimum(hi, (antes + n)[row]) - 1]
                take = pa.array(at + row)
                ints = [pa.array(x, pa.int32()) for x in (k, lo, hi)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *ints, folding.spans_to_arrow(t.cps, a, b)], [doc, page, "__k", "__lo", "__hi", "__t"])

    schema = T.StructType([df.schema[doc], df.schema[page], *T.StructType.fromDDL("__k int, __lo int, __hi int, __t string").fields])
    cut = pages.select(doc, page, "__text", "antes", "__total").mapInArrow(run, schema)
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col("__t").alias("t"))))  # at most one a word of the window
    joined = cut.groupBy(doc, "__k").agg(F.first("__lo").alias("inicio_palavra"), F.first("__hi").alias("fim_palavra"), parts.alias("__parts"))
    joined = joined.withColumn("texto", F.array_join(F.transform("__parts", lambda x: x.t), "\n\n"))
    return joined.select(
        doc, (F.col("__k") + 1).alias("ordem_chunk_documento"), F.transform("__parts", lambda x: x.p).alias("paginas"), "inicio_palavra", "fim_palavra",
        (F.col("fim_palavra") - F.col("inicio_palavra")).alias("quantidade_palavras"), F.length("texto").alias("quantidade_caracteres"), "texto",
    )


def with_global_ids(chunks: DataFrame, doc: str) -> DataFrame:
    """``chunks`` with ``ordem_global`` over documents in order, and ``id_chunk``; ids are padded to four digits, never cut."""
    counts = chunks.groupBy(doc).agg(F.max("ordem_chunk_documento").alias("__n"))
    ordered = global_ordinal(counts, [doc], "__ordem")
    offsets = running_sum(ordered.withColumn("__g", F.lit(0)), ["__g"], "__ordem", "__n", F.floor(F.col("__ordem") / 10_000)).select(doc, "antes")
    out = chunks.join(offsets, doc).withColumn("ordem_global", (F.col("antes") + F.col("ordem_chunk_documento")).cast("bigint")).drop("antes")
    return out.withColumn("id_chunk", F.format_string("chunk_%04d", "ordem_global"))


def chunk_report(chunks: DataFrame, counts: Column, pages: Column) -> DataFrame:
    """One row: chunks, those over several pages and their share, words: mean, least, most, sum."""
    n, crossing = F.count("*"), F.count_if(F.size(pages) > 1)
    return chunks.agg(
        n.alias("total_chunks"), crossing.alias("chunks_entre_paginas"),
        F.round(F.coalesce(F.try_divide(crossing * 100.0, n), F.lit(0.0)), 2).alias("percentual_entre_paginas"),
        F.round(F.coalesce(F.avg(counts), F.lit(0.0)), 2).alias("media_palavras"), F.min(counts).alias("menor"), F.max(counts).alias("maior"), F.sum(counts).alias("soma_palavras"),
    )
