"""Browsing: chunk and vocabulary pages, term profiles, heat maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.operators.index import Index, vocabulary


def heat_level(tf: Column) -> Column:
    """0, 1, 2, 3 for three and four, 4 from five on."""
    return F.when(tf <= 0, 0).when(tf == 1, 1).when(tf == 2, 2).when(tf <= 4, 3).otherwise(4)


def filter_chunks(chunks: DataFrame, needle: str = "", document: str | None = None, crossing: bool = False) -> DataFrame:
    """Chunks of a document, over several pages, holding ``needle`` in id, text or file name whatever its case.

    A blank needle filters nothing; any other is taken as it is, blanks included.
    """
    out = chunks if document is None else chunks.where(F.col("id_documento") == document)
    out = out.where(F.size("paginas") > 1) if crossing else out
    if needle.strip():
        low = needle.lower()
        out = out.where(F.lower("id_chunk").contains(low) | F.lower("texto").contains(low) | F.lower("nome_arquivo").contains(low))
    return out


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Page number ``page`` (from 1) of ``size`` rows."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    """One row: rows and pages, at least one page."""
    n = F.count("*")
    return df.agg(n.alias("total"), F.greatest(F.ceil(n / size), F.lit(1)).cast("bigint").alias("paginas"))


def vocabulary_matching(post: DataFrame, needle: str = "") -> DataFrame:
    """Terms that contain the folded needle, with df and cf."""
    return vocabulary(post.where(F.col("term").contains(needle.lower())) if needle else post)


def term_profile(index: Index, term: str) -> DataFrame:
    """One row: occurrences, chunks, coverage, peak and its first chunk, document with most occurrences.

    Of equal documents the one whose first chunk comes first; of equal chunks the first by id.
    """
    own = index.postings.where(F.col("term") == term).join(index.chunks.select("id_chunk", "id_documento"), "id_chunk", "left")
    by_doc = own.groupBy("id_documento").agg(F.sum("tf").alias("n"), F.min("id_chunk").alias("first")).where(F.col("id_documento").isNotNull())
    best = by_doc.agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "id_documento")).alias("d"))
    peak = own.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("ocorrencias"), F.count("*").alias("chunks"), F.min(F.struct((-F.col("tf")).alias("tf"), "id_chunk")).alias("p"))
    both = peak.withColumn("__k", F.lit(1)).join(best.withColumn("__k", F.lit(1)), "__k")  # one row each
    share = F.round(F.col("chunks") * 100.0 / max(index.n, 1), 1)
    return both.select(
        F.lit(term).alias("term"), "ocorrencias", "chunks", share.alias("cobertura"), F.coalesce(-F.col("p.tf"), F.lit(0)).alias("pico"),
        F.col("p.id_chunk").alias("pico_chunk"), F.col("d.id_documento").alias("documento"), (-F.col("d.n")).alias("ocorrencias_documento"),
    )


def heat_chunks(index: Index, term: str) -> DataFrame:
    """Every chunk with the term's frequency and its heat level, 0 where it doesn't occur."""
    own = index.postings.where(F.col("term") == term).select("id_chunk", "tf")
    out = index.chunks.select("id_chunk", "id_documento").join(own, "id_chunk", "left").withColumn("tf", F.coalesce("tf", F.lit(0)))
    return out.withColumn("nivel", heat_level(F.col("tf")))


def heat_documents(index: Index, catalogue: DataFrame, term: str) -> DataFrame:
    """Every catalogued or chunked document: chunks, chunks with the term, occurrences, share of all occurrences."""
    heat = heat_chunks(index, term).groupBy("id_documento").agg(F.count("*").alias("chunks"), F.count_if(F.col("tf") > 0).alias("com_termo"), F.sum("tf").alias("ocorrencias"))
    out = catalogue.select("id_documento").distinct().join(heat, "id_documento", "full").fillna(0, ["chunks", "com_termo", "ocorrencias"])
    total = heat.agg(F.sum("ocorrencias").alias("__total"))
    out = out.withColumn("__k", F.lit(1)).join(F.broadcast(total.withColumn("__k", F.lit(1))), "__k")  # one row
    share = F.when(F.col("__total") > 0, F.round(F.col("ocorrencias") * 100.0 / F.col("__total"), 1)).otherwise(0.0)
    return out.select("id_documento", "chunks", "com_termo", "ocorrencias", share.alias("parte"))


def top_terms(post: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` most frequent terms, ties by term."""
    return vocabulary(post).orderBy(F.col("cf").desc(), F.col("term")).limit(n)


def zipf(post: DataFrame, n: int = 1000) -> DataFrame:
    """(posicao, term, cf, ideal) of the first ``n`` terms; ideal is the first frequency over the position."""
    first = top_terms(post, n)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cf").desc(), F.col("term"))  # at most n rows
    ranked = first.withColumn("posicao", F.row_number().over(order)).withColumn("__f", F.first("cf").over(order))
    return ranked.select("posicao", "term", "cf", F.round(F.col("__f") / F.col("posicao"), 4).alias("ideal"))


def hapax_share(post: DataFrame) -> DataFrame:
    """One row: terms, terms that occur once, their share."""
    n, once = F.count("*"), F.count_if(F.col("cf") == 1)
    return vocabulary(post).agg(n.alias("termos"), once.alias("hapax"), F.round(F.coalesce(F.try_divide(once * 100.0, n), F.lit(0.0)), 2).alias("percentual"))
