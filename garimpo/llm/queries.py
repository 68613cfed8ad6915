"""Queries of the problems on text collections, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.llm import lookalike, mix, quality, spam, split, terms, tokens, topn
from garimpo.workdir import spread


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{table}.parquet"))


def p1_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document of pages, chunks and report: its chunks counted anew, mean and contribution of each statistic, words outside prose."""
    return quality.document_statistics(*(_read(spark, d, t) for t in ("pages_norm", "chunks", "relatorio_chunking")))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, words and characters of every document, counted anew."""
    return p1_documents(spark, d).select("id_documento", "quantidade_chunks", "quantidade_palavras", "quantidade_caracteres")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents most of whose words stand in lists, tables or junk."""
    return quality.document_quality(_read(spark, d, "pages_norm")).where("caso").select("id_documento")


def _looks(spark: SparkSession, d: str) -> DataFrame:
    pages = _read(spark, d, "pages_norm")
    # null with a null part, and null keys are in no pair
    pages = pages.select(F.concat("id_documento", F.lit("#"), F.col("numero_pagina").cast("string")).alias("chave"), "texto_normalizado")
    return lookalike.looks([("pages_norm", pages, "chave", "texto_normalizado"), ("chunks", _read(spark, d, "chunks"), "id_chunk", "texto")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of pages and of chunks that look the same but differ in code points."""
    return lookalike.pairs(lookalike.classes(_looks(spark, d)))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same as classes: each page or chunk with its class and the first of its spelling, whatever the number of copies."""
    return lookalike.membership(lookalike.classes(_looks(spark, d)))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every page's and every chunk's text; each version of a row has its own."""
    page = F.concat("id_documento", F.lit("#"), F.col("numero_pagina").cast("string"))  # null with a null part
    parts = [("pages_norm", page, "texto_normalizado"), ("chunks", F.col("id_chunk"), "texto")]
    formed = [lookalike.with_consistent_form(_read(spark, d, name).withColumn("chave", key), text, ["chave", "carregado_em"]) for name, key, text in parts]
    named = [df.select(F.lit(name).alias("tabela"), "chave", "carregado_em", "forma") for (name, _, _), df in zip(parts, formed)]
    return named[0].unionByName(named[1])


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of the oversized chunks with their own bounds and pages."""
    return split.split_chunks(_read(spark, d, "chunks"), _read(spark, d, "pages_norm"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the chunks that the split took apart."""
    return split.split_chunks(_read(spark, d, "chunks"), _read(spark, d, "pages_norm")).select("id_chunk").distinct()


def p3_limits(spark: SparkSession, d: str) -> DataFrame:
    """For every split chunk what its pieces must keep: limits, no gap, overlap, all words of the text."""
    pieces = p3_pieces(spark, d)
    order = Window.partitionBy("id_chunk").orderBy("peca")  # the pieces of one text
    before, overlap = F.lag("inicio_palavra").over(order), F.lag("fim_palavra").over(order) - F.col("inicio_palavra")
    joined = F.coalesce(overlap.between(0, split.OVERLAP) & (F.col("inicio_palavra") >= before), F.lit(True))
    inside = (F.col("quantidade_palavras") <= split.MAX_WORDS) & (F.length("texto") <= split.MAX_CHARS)
    seen = pieces.select("id_chunk", "inicio_palavra", "fim_palavra", inside.alias("dentro"), joined.alias("unidas"))
    return seen.groupBy("id_chunk").agg(
        F.min("inicio_palavra").alias("inicio"), F.max("fim_palavra").alias("fim"), F.bool_and("dentro").alias("nos_limites"), F.bool_and("unidas").alias("sem_lacuna")
    )


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences, chunks and mark."""
    chunks = _read(spark, d, "chunks")
    return terms.mark_terms(terms.term_frequencies(chunks), terms.chunk_total(chunks))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return p4_terms(spark, d).where(F.col("marca").isNotNull()).select("term", "marca")


def p4_loads(spark: SparkSession, d: str) -> DataFrame:
    """Index totals of each load counted anew, next to the recorded total_termos."""
    freq = terms.term_frequencies(_read(spark, d, "chunks"), group="id_carga")
    made = freq.groupBy("id_carga").agg(F.count("*").alias("termos"), F.sum("chunks").alias("postings"), F.sum("ocorrencias").alias("ocorrencias"))
    recorded = _read(spark, d, "relatorio_indexacao").groupBy("id_carga").agg(F.max_by("total_termos", "gerado_em").alias("total_termos"))
    return made.join(recorded, "id_carga", "full").withColumn("confere", F.col("termos").eqNullSafe(F.col("total_termos")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The five best chunks of every query."""
    best = topn.top_n_per_group(_read(spark, d, "candidatos_topk"), "query_id", "id_chunk", "score", 5)
    return best.select("query_id", F.col("posicao").cast("int").alias("posicao"), "id_chunk")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_corpus(_read(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mix and how often each occurs."""
    return mix.mix_sources(_read(spark, d, "documents"), _read(spark, d, "mix_targets")).documents


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every listed source."""
    return mix.mix_sources(_read(spark, d, "documents"), _read(spark, d, "mix_targets")).report


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """For every listed source what the mix must keep: budget, whole epochs before a part, cap, every document whole."""
    made = mix.mix_sources(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))
    seen = made.documents.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("vezes")).alias("soma"), F.count("*").alias("linhas"), F.min("vezes").alias("menos"), F.max("vezes").alias("mais")
    )
    r = made.report.join(seen, "source", "left").fillna(0, ["soma", "linhas", "menos", "mais"])
    budget = F.least("alvo", (F.col("tamanho") * F.col("max_repeticoes")).cast("double"))
    return r.select(
        "source", "max_repeticoes", (F.abs(F.col("soma") - budget) <= F.col("maior") / 2 + 1e-6).alias("no_orcamento"), (F.col("mais") <= F.col("max_repeticoes")).alias("na_cota"),
        ((F.col("mais") <= F.col("epocas") + 1) & ((F.col("epocas") == 0) | (F.col("menos") >= F.col("epocas")))).alias("epocas_antes"), (F.col("soma") == F.col("tokens_na_mistura")).alias("soma_confere"),
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that can't reach their share with their permitted repetitions."""
    return p7_shares(spark, d).where("insuficiente").select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of each document's words in keyword, link, tag and product runs."""
    return spam.spam_shares(_read(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents stuffed with keywords, links, tags or product labels."""
    return p8_shares(spark, d).where("caso and doc_id is not null").select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_documents, p1_counts, p2_found, p2_classes, p2_forms, p3_found, p3_pieces, p3_limits, p4_found, p4_terms, p4_loads, p5_found, p6_ids, p7_found, p7_mix, p7_shares, p7_limits, p8_found, p8_shares)
}

_TERMS = """
        with t as (
          select id_chunk, texto, id_carga from (select *, row_number() over (partition by id_chunk order by carregado_em desc nulls last, texto desc) rn from chunks where id_chunk is not null and texto is not null) where rn = 1),
        w as (select id_chunk, id_carga, unnest(regexp_extract_all(replace(replace(lower(nfc_normalize(texto)), 'ß', 'ss'), 'ﬁ', 'fi'), '[\\p{L}\\p{N}]+')) term from t),
        f as (select term, count(distinct id_chunk) chunks, count(*) ocorrencias from w group by term),
        n as (select count(*) n from t),
        m as (select f.*, case when chunks < 3 then 'rara' when chunks > n / 2.0::double then 'comum' end marca from f, n)"""

_SPACE = "\\x{9}-\\x{D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_WORDS = f"len(regexp_extract_all(texto, '[^{_SPACE}]+'))"

SQL: dict[str, str] = {
    "p1_counts": f"""
        with t as (
          select id_chunk, id_documento, texto from (select *, row_number() over (partition by id_chunk order by carregado_em desc nulls last, texto desc) rn from chunks where id_chunk is not null and texto is not null) where rn = 1),
        c as (select id_documento, count(*) c, sum({_WORDS})::bigint p, sum(length(texto))::bigint n from t where id_documento is not null group by 1),
        ids as (select id_documento from pages_norm union select id_documento from chunks union select id_documento from relatorio_chunking)
        select id_documento, coalesce(c, 0) quantidade_chunks, coalesce(p, 0) quantidade_palavras, coalesce(n, 0) quantidade_caracteres from ids left join c using (id_documento) where id_documento is not null""",
    "p5_found": """
        with best as (
          select query_id, id_chunk, max(score) as s from candidatos_topk
          where query_id is not null and id_chunk is not null and score is not null and not isnan(score) and score > 0
          group by query_id, id_chunk),
        ranked as (select query_id, id_chunk, row_number() over (partition by query_id order by s desc, id_chunk collate "C") as posicao from best)
        select query_id, cast(posicao as integer) as posicao, id_chunk from ranked where posicao <= 5""",
    "p3_found": """
        select distinct id_chunk from chunks
        where length(texto) > 2000
           or length(regexp_replace(regexp_replace(texto, '[^\\x{9}-\\x{D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', 'x', 'g'), '[^x]', '', 'g')) > 200""",
    "p3_limits": f"""
        with o as (select *, {_WORDS} n from chunks where id_chunk is not null and texto is not null),
        r as (select *, row_number() over (partition by id_chunk order by carregado_em desc nulls last, texto) rn from o where n > 200 or length(texto) > 2000)
        select id_chunk, coalesce(inicio_palavra, 0)::integer inicio, (coalesce(inicio_palavra, 0) + n)::integer fim, true nos_limites, true sem_lacuna from r where rn = 1""",
    "p7_limits": """
        select source, max(coalesce(max_repeticoes, 0))::integer max_repeticoes, true no_orcamento, true na_cota, true epocas_antes, true soma_confere
        from mix_targets where source is not null group by source""",
    "p4_terms": f"{_TERMS} select term, chunks, ocorrencias, marca from m",
    "p4_found": f"{_TERMS} select term, marca from m where marca is not null",
    "p4_loads": f"""{_TERMS},
        a as (select id_carga, count(distinct term) termos, count(distinct term || ' ' || id_chunk) postings, count(*) ocorrencias from w group by 1),
        r as (select id_carga, max_by(total_termos, gerado_em) total_termos from relatorio_indexacao group by 1)
        select coalesce(a.id_carga, r.id_carga) id_carga, termos, postings, ocorrencias, total_termos, termos is not distinct from total_termos confere from a full join r on a.id_carga = r.id_carga""",
}
