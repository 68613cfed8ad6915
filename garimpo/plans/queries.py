"""The retrieval engine's queries on the archive tables, each over whole tables.

The index of a folder's chunks is built once for an application, as a table in
the shared folder, and read by every query that searches it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.functions import formats
from garimpo.functions import text as tx
from garimpo.functions.scoring import idf
from garimpo.operators import analysis, chunking, experiment, explore, search
from garimpo.operators import index as ix
from garimpo.operators.latest import latest_rows
from garimpo.operators.ordinals import global_ordinal
from garimpo.plans import goldens
from garimpo.plans.registry import query, read
from garimpo.sources import catalogue, files, results
from garimpo.workdir import materialize, new_path, spread

WS = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sql_fold(x: str) -> str:
    return f"replace(replace(lower(nfc_normalize({x})), 'ß', 'ss'), 'ﬁ', 'fi')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_terms(x: str) -> str:
    return rf"regexp_extract_all({sql_fold(x)}, '[\p{{L}}\p{{N}}]+')"


def sql_words(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '[^{WS}]+')"


def sql_window(text: str, size: int, overlap: int) -> str:
    return f"unnest(range(0, greatest(n - {overlap} - 1, 0) // {size - overlap} + 1))"


COLLECTION = """
  c as (select * exclude (rn) from (select *, row_number() over (partition by id_chunk order by carregado_em desc) rn from chunks where id_chunk is not null) where rn = 1)"""
INDEX = f"""{COLLECTION},
  tok as (select id_chunk, id_documento, ordem_global, {sql_terms("coalesce(texto, '')")} t from c),
  len as (select id_chunk, len(t) dl from tok),
  st as (select count(*) n, avg(dl) avgdl, sum(dl)::bigint total from len),
  post as (select term, id_chunk, count(*) tf from (select id_chunk, unnest(t) term from tok) group by all),
  voc as (select term, count(*) df, sum(tf)::bigint cf from post group by term)"""
TERMS = tx.query_terms(goldens.QUERY)[3]
ASKED = "q as (select * from (values " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS)) + ") v(ord, term))"


def sql_bm25(k1: float = 1.5, b: float = 0.75, post: str = "post", extra: str = "") -> str:
    return f"""cand as (select p.id_chunk, round(sum(ln(1 + (st.n - f.df + 0.5::double) / (f.df + 0.5::double)) * p.tf * ({k1}::double + 1)
        / (p.tf + {k1}::double * (1 - {b}::double + {b}::double * l.dl / st.avgdl))), 4) score, count(*) termos
      from {post} p join q using (term) join (select term, count(*) df from post group by term) f using (term) join len l using (id_chunk) cross join st {extra} group by p.id_chunk)"""


SIMPLE = "cand as (select id_chunk, sum(tf)::bigint score, count(*) termos from post join q using (term) group by id_chunk)"
TOP = "select cast(row_number() over (order by score desc, id_chunk) as integer) posicao, id_chunk, score from cand where score > 0"

_indexes: dict[tuple[str, str], ix.Index] = {}


def collection(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of every chunk (of equally late ones the greater text); only the rows of repeated chunks move."""
    rows = spread(read(spark, d, "chunks")).where(F.col("id_chunk").isNotNull())
    return latest_rows(rows, ["id_chunk"], "carregado_em", [F.col("texto").desc_nulls_last()])


def index_of(spark: SparkSession, d: str) -> ix.Index:
    """The index of the folder's chunks, built at its first use in an application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        _indexes[key] = ix.Index.build(collection(spark, d))
    return _indexes[key]


def ranked(candidates: DataFrame, k: int = 0) -> DataFrame:
    """(posicao, id_chunk, score) of the first ``k`` candidates, or of all, by distributed ordinals."""
    if k:
        first = search.top_k(candidates, k).select("id_chunk", "score")
        order = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), F.col("id_chunk"))  # k rows
        return first.select(F.row_number().over(order).alias("posicao"), "id_chunk", "score")
    keyed = candidates.select("id_chunk", "score", (-F.col("score")).alias("__s"))
    return global_ordinal(keyed, ["__s", "id_chunk"], "posicao").select(F.col("posicao").cast("int"), "id_chunk", "score")


# --- texts and pages


@query(f"""
with a as (select doc_id, regexp_replace(replace(nfc_normalize(coalesce(text, '')), chr(8203), ' '), '\\r\\n?', chr(10), 'g') t from documents),
  h as (select doc_id, regexp_replace(t, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g') t from a),
  l as (select doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: {sql_strip("regexp_replace(x, '[ \\t]+', ' ', 'g')")}), chr(10)) t from h),
  z as (select doc_id, {sql_strip("regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g')")} t from l)
select doc_id, t as texto, len({sql_words("t")})::integer as quantidade_palavras, length(t)::integer as quantidade_caracteres from z""")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned texts of all documents."""
    cleaned = spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", tx.normalize_text(F.col("text")).alias("texto"))
    return cleaned.select("doc_id", "texto", tx.word_count(F.col("texto")).alias("quantidade_palavras"), F.length("texto").alias("quantidade_caracteres"))


@query(f"""
select case when coalesce({sql_strip("texto_normalizado")}, '') = '' then 'vazia_preservada' else 'processado' end status, status_normalizacao registrado, motivo_status motivo, count(*) paginas
from pages_norm group by all""")
def page_status(spark: SparkSession, d: str) -> DataFrame:
    """Pages by status found and status recorded."""
    status = F.when(tx.is_blank(F.col("texto_normalizado")), "vazia_preservada").otherwise("processado")
    return read(spark, d, "pages_norm").groupBy(status.alias("status"), F.col("status_normalizacao").alias("registrado"), F.col("motivo_status").alias("motivo")).agg(F.count("*").alias("paginas"))


@query(f"""
with p as (select * from (select *, row_number() over (partition by id_documento, numero_pagina order by carregado_em desc) rn from pages_norm) where rn = 1),
  b as (select *, coalesce({sql_strip("texto_normalizado")}, '') = '' vazia from p)
select id_documento, count(*) paginas, count(*) filter (vazia) vazias,
  coalesce(string_agg('página ' || numero_pagina || ': ' || coalesce(motivo_status, 'sem motivo'), '; ' order by numero_pagina) filter (vazia), '') avisos
from b group by id_documento""")
def processing_report(spark: SparkSession, d: str) -> DataFrame:
    """Pages, empty pages and warnings of every document."""
    return catalogue.processing_report(read(spark, d, "pages_norm"))


@query("""
with f as (select *, row_number() over (partition by id_documento order by caminho_relativo) rn from catalogo),
  u as (select nome_arquivo, min(fonte_url) url from catalogo group by nome_arquivo)
select printf('doc_%03d', row_number() over (order by f.caminho_relativo, f.id_documento)) novo_id, f.id_documento, f.caminho_relativo, sha256(f.caminho_relativo) chave_caminho, u.url
from f left join u using (nome_arquivo) where rn = 1""")
def catalog_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Files in path order with new document ids, a digest and the source address of their name."""
    return catalogue.inventory(read(spark, d, "catalogo"))


@query("""
with f as (select distinct * from catalogo)
select count(*) arquivos, sum(tamanho_bytes)::bigint bytes, sum(quantidade_paginas)::bigint paginas, count(*) filter (status_processamento = 'processado') processados, count(distinct hash_sha256) conteudos from f""")
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    """Files, bytes, pages and distinct contents of the catalogue; repeated rows count once."""
    return read(spark, d, "catalogo").distinct().agg(
        F.count("*").alias("arquivos"), F.sum("tamanho_bytes").alias("bytes"), F.sum("quantidade_paginas").alias("paginas"),
        F.count_if(F.col("status_processamento") == "processado").alias("processados"), F.count_distinct("hash_sha256").alias("conteudos"),
    )


@query(f"select doc_id, len(t)::integer tokens, len(list_distinct(t))::integer distintos from (select doc_id, {sql_terms("coalesce(text, '')")} t from documents)")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    """Terms and distinct terms of every document."""
    found = spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", tx.terms(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distintos"))


def _battery_sql() -> str:
    rows = ", ".join(f"({i}, '{q}')" for i, (_, q) in enumerate(goldens.BATTERY))
    stop = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
    return f"""
with b as (select * from (values {rows}) v(query_id, consulta)), s as (select [{stop}] w),
  t as (select query_id, {sql_terms("consulta")} t, w from b, s),
  x as (select query_id, t, list_filter(t, lambda i: list_contains(w, i)) removidas, list_filter(t, lambda i: not list_contains(w, i)) resto from t)
select query_id, array_to_string(t, ' ') tokens, array_to_string(removidas, ' ') removidas,
  array_to_string(list_filter(resto, lambda i, k: list_position(resto, i) = k), ' ') distintos from x"""


@query(_battery_sql())
def query_parse(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, stop words and distinct terms of the battery, as column expressions."""
    asked = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(goldens.BATTERY)], "query_id int, consulta string")
    parsed = asked.select("query_id", tx.terms(F.col("consulta")).alias("t"), tx.stop_word_array().alias("w"))
    removed = F.filter("t", lambda x: F.array_contains("w", x))
    rest = F.array_distinct(F.filter("t", lambda x: ~F.array_contains("w", x)))
    return parsed.select("query_id", F.array_join("t", " ").alias("tokens"), F.array_join(removed, " ").alias("removidas"), F.array_join(rest, " ").alias("distintos"))


# --- chunks

_SPACED = f"regexp_extract_all({sql_strip("coalesce(text, '')")}, '[^{WS}]+[{WS}]*')"


@query(f"""
with a as (select doc_id, {_SPACED} w from documents), b as (select *, len(w) n from a where len(w) > 0),
  k as (select *, {sql_window("w", 200, 30)} k from b), s as (select *, k * 170 i, least(k * 170 + 200, n) f from k)
select doc_id, (k + 1)::integer ordem_chunk_documento, i::integer inicio_palavra, f::integer fim_palavra, (f - i)::integer quantidade_palavras,
  length(t)::integer quantidade_caracteres, t texto from (select *, {sql_strip("array_to_string(w[i + 1:f], '')")} t from s)""")
def chunk_sliding_single(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 200 words with 30 of overlap over every document's text."""
    return chunking.chunk_texts(spread(read(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


_PAGES_SQL = f"""
with p as (select * exclude (rn) from (select *, row_number() over (partition by id_documento, numero_pagina order by carregado_em desc) rn from pages_norm) where rn = 1),
  g as (select id_documento, numero_pagina, {sql_strip("coalesce(texto_normalizado, '')")} t from p),
  w as (select id_documento, numero_pagina, unnest(x) palavra, generate_subscripts(x, 1) j, len(x) m from (select *, regexp_extract_all(t, '[^{WS}]+[{WS}]*') x from g where t <> '')),
  o as (select *, row_number() over (partition by id_documento order by numero_pagina, j) - 1 i, count(*) over (partition by id_documento) n from w),
  k as (select *, unnest(range(greatest(0, (i - 200 + 170) // 170 + case when (i - 200 + 170) < 0 and (i - 200 + 170) % 170 <> 0 then 0 else 0 end)::bigint,
        least(i // 170, greatest(n - 31, 0) // 170)::bigint + 1)) k from o),
  f as (select * from k where i >= k * 170 and i < k * 170 + 200),
  q as (select id_documento, k, numero_pagina, min(i) a, max(i) + 1 b, {sql_strip("string_agg(palavra, '' order by i)")} t from f group by all)
select id_documento, (k + 1)::integer ordem_chunk_documento, min(a)::integer inicio_palavra, max(b)::integer fim_palavra,
  string_agg(numero_pagina::varchar, ',' order by numero_pagina) paginas, string_agg(t, chr(10) || chr(10) order by numero_pagina) texto from q group by id_documento, k"""


def latest_pages(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of every page; only the rows of repeated pages move."""
    return latest_rows(spread(read(spark, d, "pages_norm")), ["id_documento", "numero_pagina"], "carregado_em", [F.col("texto_normalizado").desc_nulls_last()])


@query(_PAGES_SQL)
def chunk_sliding_pages(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 200 words with 30 of overlap over the joined pages of every document, with their pages."""
    made = chunking.chunk_pages(latest_pages(spark, d), "id_documento", "numero_pagina", "texto_normalizado")
    return made.select("id_documento", "ordem_chunk_documento", "inicio_palavra", "fim_palavra", F.array_join(F.col("paginas").cast("array<string>"), ",").alias("paginas"), "texto")


@query(f"""
with m as ({_PAGES_SQL.replace("string_agg(numero_pagina::varchar, ',' order by numero_pagina) paginas, string_agg(t, chr(10) || chr(10) order by numero_pagina) texto", "0 z")})
select id_documento, ordem_chunk_documento, row_number() over (order by id_documento, ordem_chunk_documento) ordem_global,
  printf('chunk_%04d', row_number() over (order by id_documento, ordem_chunk_documento)) id_chunk from m""")
def chunk_global_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ordinals and ids of all windows over documents in order."""
    made = materialize(chunking.chunk_pages(latest_pages(spark, d), "id_documento", "numero_pagina", "texto_normalizado").select("id_documento", "ordem_chunk_documento"), "janelas")
    return chunking.with_global_ids(made, "id_documento").select("id_documento", "ordem_chunk_documento", "ordem_global", "id_chunk")


@query(f"""
with {COLLECTION}, w as (select *, len({sql_words("texto")}) n from c)
select count(*) total_chunks, count(*) filter (len(paginas) > 1) chunks_entre_paginas, round(count(*) filter (len(paginas) > 1) * 100.0::double / count(*), 2) percentual_entre_paginas,
  round(avg(n), 2) media_palavras, min(n)::integer menor, max(n)::integer maior, sum(n)::bigint soma_palavras from w""")
def chunk_report(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the chunks, words counted from their texts."""
    return chunking.chunk_report(collection(spark, d), tx.word_count(F.col("texto")), F.col("paginas"))


@query(f"""
with {COLLECTION}, w as (select *, len({sql_words("texto")}) n from c),
  a as (select id_documento, count(*) quantidade_chunks, count(*) filter (len(paginas) > 1) entre_paginas, sum(n)::bigint palavras from w group by 1),
  r as (select id_documento, max(quantidade_chunks) registrada, max(paginas_com_conteudo) paginas_com_conteudo from relatorio_chunking group by 1)
select coalesce(a.id_documento, r.id_documento) id_documento, coalesce(quantidade_chunks, 0) quantidade_chunks, coalesce(entre_paginas, 0) entre_paginas, coalesce(palavras, 0) palavras,
  registrada, paginas_com_conteudo from a full join r on a.id_documento = r.id_documento""")
def chunk_report_by_doc(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every document counted anew, next to the recorded count."""
    own = collection(spark, d).groupBy("id_documento").agg(
        F.count("*").alias("quantidade_chunks"), F.count_if(F.size("paginas") > 1).alias("entre_paginas"), F.sum(tx.word_count(F.col("texto"))).alias("palavras")
    )
    recorded = read(spark, d, "relatorio_chunking").groupBy("id_documento").agg(F.max("quantidade_chunks").alias("registrada"), F.max("paginas_com_conteudo").alias("paginas_com_conteudo"))
    return own.join(recorded, "id_documento", "full").fillna(0, ["quantidade_chunks", "entre_paginas", "palavras"])


# --- index


@query(f"with {INDEX} select * from post")
def postings(spark: SparkSession, d: str) -> DataFrame:
    """Every term in every chunk with its frequency."""
    return index_of(spark, d).postings.select("term", "id_chunk", "tf")


@query(f"with {INDEX} select term, id_chunk, tf frequencia from post")
def postings_list_nested(spark: SparkSession, d: str) -> DataFrame:
    """The nested index, in blocks of each term, unfolded again."""
    return ix.nested(index_of(spark, d).postings).select("term", F.explode("chunks").alias("x")).select("term", "x.id_chunk", "x.frequencia")


@query(f"with {INDEX} select * from voc")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its chunks and occurrences."""
    return ix.vocabulary(index_of(spark, d).postings)


@query(f"with {INDEX} select count(*) total_termos, sum(df)::bigint total_postings, sum(cf)::bigint total_ocorrencias from voc")
def index_totals(spark: SparkSession, d: str) -> DataFrame:
    """Terms, postings and occurrences."""
    return ix.index_totals(index_of(spark, d).postings)


@query(f"with {INDEX} select post.* from post left join c using (id_chunk) where c.id_documento is null and not exists (select 1 from c x where x.id_chunk = post.id_chunk)")
def orphan_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings without a chunk: none."""
    index = index_of(spark, d)
    return ix.orphans(index.postings, index.chunks).select("term", "id_chunk", "tf")


@query(f"with {INDEX} select n, round(avgdl, 6) avgdl, total from st")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, mean length in terms and total terms; empty chunks count."""
    return ix.corpus_stats(index_of(spark, d).lengths).withColumn("avgdl", F.round("avgdl", 6))


@query(f"with {INDEX} select term, df, round(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)), 4) idf from voc, st")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    """Inverse document frequency of every term."""
    index = index_of(spark, d)
    return ix.vocabulary(index.postings).select("term", "df", F.round(idf(F.lit(index.n), F.col("df")), 4).alias("idf"))


@query(f"with {INDEX} select term, count(*) df, sum(tf)::bigint cf from post join c using (id_chunk) where ordem_global % 2 = 1 group by term")
def index_restricted_odd(spark: SparkSession, d: str) -> DataFrame:
    """Vocabulary of the load of odd ordinals."""
    index = index_of(spark, d)
    return ix.vocabulary(ix.restrict(index.postings, index.chunks.where("ordem_global % 2 = 1")))


# --- search


def _search_sql(body: str, tail: str = TOP) -> str:
    return f"with {INDEX}, {ASKED}, {body} {tail}"


@query(_search_sql(SIMPLE, "select * from (" + TOP + ") where posicao <= 5"))
def search_linear_simple(spark: SparkSession, d: str) -> DataFrame:
    """Five best chunks by term counts, found by reading all chunks."""
    return ranked(search.search_scan(index_of(spark, d), goldens.QUERY, "simples"), 5)


@query(_search_sql(sql_bm25(), "select * from (" + TOP + ") where posicao <= 5"))
def search_linear_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Five best chunks by BM25, found by reading all chunks."""
    return ranked(search.search_scan(index_of(spark, d), goldens.QUERY), 5)


@query(_search_sql(SIMPLE, "select * from (" + TOP + ") where posicao <= 5"))
def search_indexed_simple(spark: SparkSession, d: str) -> DataFrame:
    """Five best chunks by term counts, from the index."""
    return ranked(search.search_index(index_of(spark, d), goldens.QUERY, "simples"), 5)


@query(f"""with {INDEX}, {ASKED}, {sql_bm25()}, top as (select * from ({TOP}) where posicao <= 5)
select posicao, id_chunk, score, id_documento, nome_arquivo, array_to_string(paginas, ',') paginas, f.freq frequencias from top join c using (id_chunk)
join (select id_chunk, string_agg(term || '=' || tf, ' ' order by ord) freq from post join q using (term) group by id_chunk) f using (id_chunk)""")
def search_indexed_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Five best chunks by BM25 from the index, with document, pages and the frequencies of the query's terms."""
    index = index_of(spark, d)
    first = search.top_k(search.search_index(index, goldens.QUERY), 5)
    full = search.with_attributes(first, index)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), F.col("id_chunk"))  # five rows
    counts = F.array_join(F.transform(F.map_entries("frequencias_termos"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), " ")
    return full.select(
        F.row_number().over(order).alias("posicao"), "id_chunk", "score", "id_documento", "nome_arquivo", F.array_join(F.col("paginas").cast("array<string>"), ",").alias("paginas"), counts.alias("frequencias")
    )


@query(_search_sql(sql_bm25()))
def search_full_order(spark: SparkSession, d: str) -> DataFrame:
    """All candidates with their positions."""
    return ranked(search.search_index(index_of(spark, d), goldens.QUERY))


@query(f"with {INDEX}, {ASKED}, " + ", ".join(
    sql_bm25(k1, b).replace("cand as", f"cand{i} as") for i, (k1, b) in enumerate(((0.9, 0.4), (1.5, 0.0), (0.0, 0.75)))
) + " " + " union all ".join(f"select '{name}' parametros, id_chunk, score from cand{i} where score > 0" for i, name in enumerate(("k1=0.9 b=0.4", "k1=1.5 b=0", "k1=0 b=0.75"))))
def search_bm25_params(spark: SparkSession, d: str) -> DataFrame:
    """Candidates under other parameters of BM25."""
    index = index_of(spark, d)
    parts = [
        search.search_index(index, goldens.QUERY, k1=k1, b=b).select(F.lit(name).alias("parametros"), "id_chunk", "score")
        for name, k1, b in (("k1=0.9 b=0.4", 0.9, 0.4), ("k1=1.5 b=0", 1.5, 0.0), ("k1=0 b=0.75", 0.0, 0.75))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PAIR = "prazos de recurso"


def _asked(text: str) -> str:
    return "q as (select * from (values " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(tx.query_terms(text)[3])) + ") v(ord, term))"


@query(f"with {INDEX}, {_asked(_PAIR)}, {sql_bm25()} select id_chunk, score from cand where termos = (select count(*) from q)")
def search_and_mode(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with every term of a query."""
    return search.search_index(index_of(spark, d), _PAIR, mode="and", only_positive=False).select("id_chunk", "score")


@query(f"with {INDEX}, {_asked(_PAIR)}, {sql_bm25()} select id_chunk, score, termos::integer termos from cand")
def search_or_mode(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with any term of a query, whatever their score."""
    return search.search_index(index_of(spark, d), _PAIR, only_positive=False).select("id_chunk", "score", "termos")


@query(f"with {INDEX}, {ASKED}, {sql_bm25(extra="join c on c.id_chunk = p.id_chunk and c.id_documento = 'doc_005'")} select id_chunk, score from cand where score > 0")
def search_doc_filter(spark: SparkSession, d: str) -> DataFrame:
    """Candidates within one document; frequencies stay those of the collection."""
    return search.search_index(index_of(spark, d), goldens.QUERY, document="doc_005").select("id_chunk", "score")


@query(f"with {INDEX}, {_asked(_PAIR)}, {SIMPLE} select id_chunk, score from cand")
def search_k_zero(spark: SparkSession, d: str) -> DataFrame:
    """All candidates for k = 0."""
    return search.top_k(search.search_index(index_of(spark, d), _PAIR, "simples"), 0).select("id_chunk", "score")


@query(f"""with {INDEX}, {ASKED}, f as (select q.ord, q.term, count(id_chunk) df from q left join post using (term) group by all)
select ord, term, df, round(case when df = 0 then 0 else ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) end, 4) idf,
  (n * {len(TERMS)})::bigint comparacoes_termos, total tokens_examinados, (sum(df) over ())::bigint postings_consultadas from f, st""")
def search_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies of the query's terms and the work of both access paths."""
    return search.search_metrics(index_of(spark, d), goldens.QUERY)


@query("select 1::integer posicao, '' a, '' b where false")
def search_linear_vs_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Places in which the full rankings of scan and index differ, both by SQL too: none."""
    index = index_of(spark, d)
    return search.same_ranking(ranked(search.search_index(index, goldens.QUERY)), ranked(search.search_scan(index, goldens.QUERY)))


@query(_search_sql(sql_bm25(), f"select 'indice' caminho, * from ({TOP}) union all select 'varredura', * from ({TOP})"))
def search_both_rankings(spark: SparkSession, d: str) -> DataFrame:
    """The full rankings of both access paths, each against its own SQL."""
    index = index_of(spark, d)
    paths = (("indice", search.search_index), ("varredura", search.search_scan))
    found = [ranked(find(index, goldens.QUERY)).select(F.lit(name).alias("caminho"), "posicao", "id_chunk", "score") for name, find in paths]
    return found[0].unionByName(found[1])


def _robust_sql(tail: str) -> str:
    rows = ", ".join(f"({i}, '{kind}', '{q}')" for i, (kind, q) in enumerate(goldens.BATTERY))
    asked = [(i, o, t) for i, (_, q) in enumerate(goldens.BATTERY) for o, t in enumerate(tx.query_terms(q)[3])]
    terms = ", ".join(f"({i}, {o}, '{t}')" for i, o, t in asked)
    return f"""with {INDEX}, b as (select * from (values {rows}) v(query_id, categoria, consulta)), q as (select * from (values {terms}) v(query_id, ord, term)),
  s as (select q.query_id, p.id_chunk, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 4) score
    from q join post p using (term) join voc using (term) join len using (id_chunk) cross join st group by all having score > 0),
  n as (select query_id, count(*) k from s group by 1), m as (select query_id, count(*) m from q group by 1),
  r as (select b.*, coalesce(k, 0) k, coalesce(m, 0) m from b left join n using (query_id) left join m using (query_id)) {tail}"""


@query(_robust_sql(f"""select query_id, categoria, consulta, k por_indice, k por_varredura, least(k, 5) retornados, k = 0 vazio, true iguais,
  case when m = 0 then '{search.WARNING}' end aviso from r"""))
def robustness_battery(spark: SparkSession, d: str) -> DataFrame:
    """The battery of difficult queries on both access paths."""
    return search.battery(index_of(spark, d), list(goldens.BATTERY))


@query(_robust_sql("select count(*) consultas, count(*) filter (k = 0) vazias, round(avg((k = 0)::integer), 4) taxa_vazias, true todas_iguais from r"))
def robustness_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of empty results of the battery, and whether both access paths agree on all."""
    runs = search.battery(index_of(spark, d), list(goldens.BATTERY))
    return runs.agg(F.count("*").alias("consultas"), F.count_if("vazio").alias("vazias"), F.round(F.avg(F.col("vazio").cast("int")), 4).alias("taxa_vazias"), F.every("iguais").alias("todas_iguais"))


@query(f"""with {INDEX}, q as (select query_id, term, min(ord) ord from query_terms where term is not null group by all),
  s as (select q.query_id, p.id_chunk, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl)) order by ord), 4) score
    from q join post p using (term) join voc using (term) join len using (id_chunk) cross join st group by all having score > 0)
select query_id, posicao::integer posicao, id_chunk, score from (select *, row_number() over (partition by query_id order by score desc, id_chunk) posicao from s) where posicao <= 5""")
def batch_search_queries(spark: SparkSession, d: str) -> DataFrame:
    """Five best chunks of every query of the query table, as one plan."""
    return search.batch_search(index_of(spark, d), read(spark, d, "query_terms"))


@query(f"""with {INDEX}, {ASKED}, {sql_bm25()} select count(*) n, count(distinct score) distintos, count(*) - count(distinct score) empates from cand where score > 0""")
def tie_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Candidates, distinct scores and ties of the query."""
    return analysis.tie_statistics(search.search_index(index_of(spark, d), goldens.QUERY))


@query(f"""with {INDEX}, {ASKED}, {sql_bm25()}, top as (select * from ({TOP}) where posicao <= 5)
select posicao, printf('[%d] %s, p. %s', posicao, nome_arquivo, array_to_string(paginas, ', ')) || chr(10) || coalesce(texto, '') bloco from top join c using (id_chunk)""")
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    """The five best chunks as numbered passages with their sources."""
    index = index_of(spark, d)
    full = search.with_attributes(search.top_k(search.search_index(index, goldens.QUERY), 5), index)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), F.col("id_chunk"))  # five rows
    numbered = full.withColumn("posicao", F.row_number().over(order))
    return numbered.select("posicao", formats.context_block(F.col("posicao"), F.col("nome_arquivo"), F.col("paginas"), F.col("texto")).alias("bloco"))


# --- browsing


@query(f"""with {COLLECTION} select id_chunk, id_documento from c
where len(paginas) > 1 and (contains(lower(id_chunk), 'edital') or contains(lower(texto), 'edital') or contains(lower(nome_arquivo), 'edital')) order by ordem_global, id_chunk limit 15 offset 15""")
def browse_chunks_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of fifteen chunks over several pages that mention a word."""
    found = explore.filter_chunks(collection(spark, d), "Edital", crossing=True)
    return explore.page_of(found, [F.col("ordem_global"), F.col("id_chunk")], 2, 15).select("id_chunk", "id_documento")


@query(f"""with {INDEX}, m as (select * from voc where contains(term, 'ção'))
select (select count(*) from m) total, greatest(ceil((select count(*) from m) / 24), 1)::bigint paginas""")
def browse_vocab_count(spark: SparkSession, d: str) -> DataFrame:
    """Terms that contain a string, and their pages of 24."""
    return explore.page_count(explore.vocabulary_matching(index_of(spark, d).postings, "ção"), 24)


@query(f"with {INDEX} select * from voc where contains(term, 'ção') order by term limit 24 offset 24")
def browse_vocab_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of 24 terms that contain a string."""
    return explore.page_of(explore.vocabulary_matching(index_of(spark, d).postings, "ÇÃO"), [F.col("term")], 2, 24)


@query(f"with {INDEX} select * from voc order by cf desc, term limit 30")
def top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The thirty most frequent terms."""
    return explore.top_terms(index_of(spark, d).postings)


_TERM = "bolsas"


@query(f"""with {INDEX}, o as (select * from post join c using (id_chunk) where term = '{_TERM}'), g as (select id_documento, sum(tf) n, min(id_chunk) f from o group by 1)
select '{_TERM}' term, sum(tf)::bigint ocorrencias, count(*) chunks, round(count(*) * 100.0::double / (select n from st), 1) cobertura, max(tf) pico,
  (select id_chunk from o order by tf desc, id_chunk limit 1) pico_chunk, (select id_documento from g order by n desc, f limit 1) documento, (select max(n) from g)::bigint ocorrencias_documento from o""")
def term_profile(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences, coverage, peak and main document of a term."""
    return explore.term_profile(index_of(spark, d), _TERM)


@query(f"""with {INDEX}, h as (select c.id_chunk, c.id_documento, coalesce(tf, 0) tf from c left join (select * from post where term = '{_TERM}') p using (id_chunk)),
  a as (select id_documento, count(*) chunks, count(*) filter (tf > 0) com_termo, sum(tf)::bigint ocorrencias from h group by 1), d as (select distinct id_documento from catalogo)
select coalesce(a.id_documento, d.id_documento) id_documento, coalesce(chunks, 0) chunks, coalesce(com_termo, 0) com_termo, coalesce(ocorrencias, 0) ocorrencias,
  round(coalesce(ocorrencias, 0) * 100.0::double / (select sum(ocorrencias) from a), 1) parte from a full join d on a.id_documento = d.id_documento""")
def term_heatmap_docs(spark: SparkSession, d: str) -> DataFrame:
    """Density of a term in every document."""
    return explore.heat_documents(index_of(spark, d), read(spark, d, "catalogo"), _TERM)


@query(f"""with {INDEX} select c.id_chunk, c.id_documento, coalesce(tf, 0) tf,
  (case when coalesce(tf, 0) = 0 then 0 when tf = 1 then 1 when tf = 2 then 2 when tf <= 4 then 3 else 4 end)::integer nivel from c left join (select * from post where term = '{_TERM}') p using (id_chunk)""")
def term_heatmap_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Density of a term in every chunk."""
    return explore.heat_chunks(index_of(spark, d), _TERM)


@query(f"""with {COLLECTION} select id_chunk, array_to_string(list_transform(regexp_extract_all(coalesce(texto, ''), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+'),
  lambda p: case when list_contains({tx.query_terms(goldens.QUERY)[0]}, lower(p)) then '<mark>' || p || '</mark>' else p end), '') texto from c""")
def highlight_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with the query's words marked, stop words too."""
    tokens = F.array(*map(F.lit, dict.fromkeys(tx.query_terms(goldens.QUERY)[0])))
    return collection(spark, d).select("id_chunk", tx.highlight(F.col("texto"), tokens).alias("texto"))


@query(f"with {COLLECTION} select id_chunk, regexp_replace(texto, '(?i)(bolsa)', '<mark>\\1</mark>', 'g') texto from c where contains(lower(texto), 'bolsa')")
def highlight_substring(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that contain a string, marked wherever it stands."""
    rows = collection(spark, d).where(F.lower("texto").contains("bolsa"))
    return rows.select("id_chunk", tx.highlight_substring(F.col("texto"), "bolsa").alias("texto"))


@query(f"""with {INDEX}, t as (select term, cf, row_number() over (order by cf desc, term) r from voc)
select r::integer posicao, term, cf, round((select max(cf) from t) / r::double, 4) ideal from t where r <= 1000""")
def zipf_rank(spark: SparkSession, d: str) -> DataFrame:
    """The thousand most frequent terms against the ideal curve."""
    return explore.zipf(index_of(spark, d).postings)


@query(f"with {INDEX} select count(*) termos, count(*) filter (cf = 1) hapax, round(count(*) filter (cf = 1) * 100.0::double / count(*), 2) percentual from voc")
def hapax_share(spark: SparkSession, d: str) -> DataFrame:
    """Terms that occur once."""
    return explore.hapax_share(index_of(spark, d).postings)


# --- measurements

_RUNS = "r as (select * from " + goldens.sql_values(goldens.RUNS, goldens.RUN_SCHEMA, "t") + ")"
_SORTS = "s as (select * from " + goldens.sql_values(goldens.SORTS, goldens.SORT_SCHEMA, "t") + ")"
_SERIES = f"""{_SORTS}, pts as (
  select 'merge_sort' serie, n::double x, ms_merge_sort y from s union all select 'sorted', n, ms_sorted from s
  union all select 'heapq', n, ms_heapq from s union all select 'comparacoes', n, comparacoes from s)"""


def runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(goldens.RUNS), goldens.RUN_SCHEMA)


def sorts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(goldens.SORTS), goldens.SORT_SCHEMA)


def series(spark: SparkSession) -> DataFrame:
    """(serie, x, y) of the published sort measurements."""
    names = (("merge_sort", "ms_merge_sort"), ("sorted", "ms_sorted"), ("heapq", "ms_heapq"), ("comparacoes", "comparacoes"))
    parts = F.array(*(F.struct(F.lit(s).alias("serie"), F.col(c).cast("double").alias("y")) for s, c in names))
    return sorts(spark).select(F.col("n").cast("double").alias("x"), F.explode(parts).alias("p")).select("p.serie", "x", "p.y")


@query(f"""with {_RUNS} select configuracao, carga, round(avg(tempo_execucao_ms), 4) media, round(stddev_pop(tempo_execucao_ms), 4) desvio, min(tempo_execucao_ms) minimo,
  max(tempo_execucao_ms) maximo, median(tempo_execucao_ms) mediana, count(*) execucoes from r where status = 'sucesso' group by 1, 2""")
def experiment_matrix_summary(spark: SparkSession, d: str) -> DataFrame:
    """Times of the published runs by configuration and load."""
    return analysis.run_summary(runs(spark), ["configuracao", "carga"], "tempo_execucao_ms")


@query(f"""with {_RUNS}, g as (select carga, avg(tempo_execucao_ms) filter (modo_busca = 'linear') l, avg(tempo_execucao_ms) filter (modo_busca = 'indexada') i from r group by 1)
select carga, round(l, 4) linear, round(i, 4) indexada, round(l / i, 3) aceleracao from g""")
def speed_up(spark: SparkSession, d: str) -> DataFrame:
    """Mean time by scan over mean time by index."""
    means = runs(spark).groupBy("carga").agg(*(F.avg(F.when(F.col("modo_busca") == m, F.col("tempo_execucao_ms"))).alias(m) for m in ("linear", "indexada")))
    ratio = F.when((F.col("linear") > 0) & (F.col("indexada") > 0), F.round(F.col("linear") / F.col("indexada"), 3))
    return means.select("carga", analysis.round_binary(F.col("linear"), 4).alias("linear"), analysis.round_binary(F.col("indexada"), 4).alias("indexada"), ratio.alias("aceleracao"))


@query("""select c.x configuracao, l.x carga, r.x repeticao from (values (1), (2), (3)) c(x), (values ('carga_1'), ('carga_2')) l(x), (values (1), (2)) r(x)""")
def experiment_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The runs to make: configurations by loads by repetitions, generated in place."""
    base = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("configuracao"))
    loads = base.select("configuracao", F.explode(F.array(F.lit("carga_1"), F.lit("carga_2"))).alias("carga"))
    return loads.select("configuracao", "carga", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("repeticao"))


@query(f"""with {_SERIES} select serie, count(*) pontos, round(regr_slope(ln(y), ln(x)), 4) expoente, round(exp(regr_intercept(ln(y), ln(x))), 6) fator, round(regr_r2(ln(y), ln(x)), 4) r2
from pts where x > 1 and y > 0 group by 1""")
def loglog_exponents(spark: SparkSession, d: str) -> DataFrame:
    """Growth exponents of the published sort measurements."""
    return analysis.loglog(series(spark), ["serie"])


_MODEL = """case m.modelo when 'O(1)' then 1 when 'O(log n)' then log2(greatest(x, 2)) when 'O(n)' then x when 'O(n log n)' then x * log2(greatest(x, 2)) else x * x end"""
_FIT = f"""{_SERIES}, models as (select * from (values (0, 'O(1)'), (1, 'O(log n)'), (2, 'O(n)'), (3, 'O(n log n)'), (4, 'O(n^2)')) v(ordem, modelo)),
  e as (select serie, ordem, m.modelo, ln(y) y, ln({_MODEL}) b from pts cross join models m where x > 1 and y > 0),
  g as (select serie, ordem, modelo, count(*) n, sum(b * b) bb, sum(b * y) bsum, avg(y) mean from e group by all),
  x as (select serie, modelo, sum((y - bsum / nullif(bb, 0) * b) ** 2) rss, sum((y - mean) ** 2) tss from e join g using (serie, ordem, modelo) group by all),
  fit as (select serie, ordem, modelo, case when n >= 3 and bb > 0 then round(exp(bsum / bb), 6) else 0 end coeficiente,
    case when n >= 3 and bb > 0 then round(1 - rss / tss, 6) else 0 end r2, case when n >= 3 and bb > 0 then round(sqrt(rss / n), 6) else 'inf'::double end rmse from g join x using (serie, modelo))"""


@query(f"with {_FIT} select * from fit")
def model_fit_table(spark: SparkSession, d: str) -> DataFrame:
    """Fit of each growth model to each series."""
    return analysis.model_fit(series(spark), ["serie"])


@query(f"""with {_SERIES}, num as (select *, row_number() over (partition by serie order by x) i from pts), lim as (select unnest(range(3, 8)) ate),
  models as (select * from (values ('O(1)'), ('O(n)'), ('O(n log n)'), ('O(n^2)')) v(modelo)),
  e as (select serie, ate, m.modelo, ln(y) y, ln({_MODEL}) b from num join lim on i <= ate cross join models m where x > 1 and y > 0),
  g as (select serie, ate, modelo, count(*) n, sum(b * b) bb, sum(b * y) bsum, avg(y) mean from e group by all)
select serie, ate::integer ate, modelo, greatest(case when max(bb) > 0 then round(1 - sum((y - bsum / nullif(bb, 0) * b) ** 2) / sum((y - mean) ** 2), 6) else 0 end, 0) r2
from e join g using (serie, ate, modelo) group by serie, ate, modelo""")
def model_prefix_r2(spark: SparkSession, d: str) -> DataFrame:
    """R2 of each model over growing prefixes of each series."""
    return analysis.prefix_r2(series(spark), ["serie"], "x")


@query(f"""with {_FIT}, u as (select serie, ordem, modelo, greatest(r2, 0) r2, max(greatest(r2, 0)) over (partition by serie) best from fit where modelo <> 'O(log n)'),
  p as (select serie, arg_min(modelo, ordem) preferido, count(*) empatados from u where r2 >= best - 0.05::double group by 1),
  l as (select serie, regr_slope(ln(y), ln(x)) e from pts group by 1)
select serie, round(e, 4) expoente, case when e <= 0.3 then 'O(1)' when e >= 1.5 then 'O(n^2)' when e >= 0.3 then 'O(n log n)' else 'O(n)' end classe,
  case when e <= 0.3 then 'O(1)' when e >= 1.5 then 'O(n^2)' when e <= 1.15 then 'O(n)' else 'O(n log n)' end classe_corrigida, preferido, empatados from l join p using (serie)""")
def complexity_class(spark: SparkSession, d: str) -> DataFrame:
    """Class of each series by its exponent, as published and corrected, and the model preferred by R2."""
    points = series(spark)
    exponents = analysis.loglog(points, ["serie"]).select("serie", "expoente")
    preferred = analysis.preferred_model(analysis.model_fit(points, ["serie"]), ["serie"])
    e = F.col("expoente")
    return exponents.select("serie", e, analysis.complexity_class(e).alias("classe"), analysis.complexity_class(e, True).alias("classe_corrigida")).join(preferred, "serie")


@query(f"""with {_SORTS}, r as (select comparacoes / (n * log2(n)) q from s)
select round(avg(q), 6) media, round(min(q), 6) minimo, round(max(q), 6) maximo, round(stddev_pop(q) / avg(q), 6) desvio_relativo from r""")
def nlogn_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons over n log n of the published sort measurements."""
    q = F.col("comparacoes") / (F.col("n") * F.log2(F.col("n").cast("double")))
    return sorts(spark).agg(F.round(F.avg(q), 6).alias("media"), F.round(F.min(q), 6).alias("minimo"), F.round(F.max(q), 6).alias("maximo"), F.round(F.stddev_pop(q) / F.avg(q), 6).alias("desvio_relativo"))


@query("""select n, (case when n > 0 then 2 * n - 1 else 1 end)::bigint chamadas, (1 + case when n > 0 then ceil(log2(n)) else 0 end)::integer profundidade,
  (case when n > 0 then n * ceil(log2(n)) - 2 ** ceil(log2(n)) + n else 0 end)::bigint movimentacoes from range(0, 5000) t(n)""")
def merge_sort_closed_forms(spark: SparkSession, d: str) -> DataFrame:
    """Calls, depth and moves of a merge sort for every size below 5,000."""
    return spark.range(5000).select(F.col("id").alias("n"), *analysis.sort_closed_forms(F.col("id")))


_MERGE = f"""
with recursive {INDEX}, {ASKED}, {sql_bm25()}, o as (select score, row_number() over (order by ordem_global, cand.id_chunk) - 1 p, row_number() over (order by score desc, cand.id_chunk) r
    from cand join c on c.id_chunk = cand.id_chunk where score > 0),
  parts as (select 0::bigint lo, (select count(*) from o) hi, 1 depth union all
    select unnest([lo, lo + (hi - lo) // 2]), unnest([lo + (hi - lo) // 2, hi]), depth + 1 from parts where hi - lo > 1),
  x as (select lo, hi, r, score, p < lo + (hi - lo) // 2 a from parts join o on p >= lo and p < hi where hi - lo > 1),
  l as (select lo, hi, least(max(r) filter (a), max(r) filter (not a)) z from x group by lo, hi),
  y as (select x.* from x join l using (lo, hi) where r <= z),
  s as (select (select count(*) from y) cs, (select count(*) from y where exists (select 1 from x where x.lo = y.lo and x.hi = y.hi and x.a <> y.a and x.score = y.score and x.r > y.r)) ci)
select (select count(*) from o) n, cs comparacoes_score, ci comparacoes_id, (select coalesce(sum(hi - lo) filter (hi - lo > 1), 0)::bigint from parts) movimentacoes,
  (select count(*) from parts) chamadas, (select max(depth) from parts)::integer profundidade, cs + ci comparacoes from s"""


@query(_MERGE)
def merge_sort_counters(spark: SparkSession, d: str) -> DataFrame:
    """Work of a merge sort of the query's candidates in chunk order."""
    index = index_of(spark, d)
    found = search.search_index(index, goldens.QUERY).select("id_chunk", "score", (-F.col("score")).alias("__s"))
    found = found.join(index.chunks.select("id_chunk", "ordem_global"), "id_chunk")
    placed = global_ordinal(global_ordinal(found, ["__s", "id_chunk"], "r"), ["ordem_global", "id_chunk"], "p")
    placed = materialize(placed.select((F.col("p") - 1).alias("p"), "r", "score"), "candidatos")
    return analysis.sort_counters(placed, placed.count())


_FRACTIONS = 8


@query(f"""with {INDEX}, {ASKED}, o as (select id_chunk, row_number() over (order by ordem_global, id_chunk) i from c), tot as (select count(*) n from c),
  sz as (select distinct greatest(n * (j + 1) // {_FRACTIONS}, 1) tamanho from tot, range({_FRACTIONS}) t(j)), p as (select post.*, i from post join o using (id_chunk))
select tamanho, (select sum(tf) from p where i <= tamanho)::bigint tokens, (select count(distinct term) from p where i <= tamanho) termos,
  (select count(*) from p where i <= tamanho and term in (select term from q)) postings, (select count(distinct id_chunk) from p where i <= tamanho and term in (select term from q)) candidatos from sz""")
def growth_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Index and query work on growing prefixes of the chunks."""
    index = index_of(spark, d)
    numbered = global_ordinal(index.chunks.select("ordem_global", "id_chunk"), ["ordem_global", "id_chunk"], "i")
    tokens = index.postings.join(numbered.select("id_chunk", "i"), "id_chunk").select("i", "term", "tf")
    return analysis.growth_sweep(tokens, "i", TERMS, list(analysis.size_points(index.n, _FRACTIONS)))


@query(f"""with {_RUNS} select id_execucao, regexp_replace(configuracao, '^Configuração (\\d+) \\(', 'C\\1 (') rotulo, replace(lower(trim(regexp_replace(carga, '\\(.*$', ''))), ' ', '_') carga,
  replace(printf('%.4f', tempo_execucao_ms), '.', ',') tempo, comparacoes_ordenacao::varchar comparacoes from r""")
def report_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels and numbers of the runs as the reports print them."""
    return runs(spark).select(
        "id_execucao", formats.short_configuration(F.col("configuracao")).alias("rotulo"), formats.load_slug(F.col("carga")).alias("carga"),
        formats.decimal_comma(F.col("tempo_execucao_ms"), 4).alias("tempo"), formats.decimal_comma(F.col("comparacoes_ordenacao"), 0).alias("comparacoes"),
    )


@query("""select distinct id_documento, case when tamanho_bytes is null then '—' when tamanho_bytes < 1048576 then printf('%.1f KB', tamanho_bytes / 1024.0::double)
  else printf('%.2f MB', tamanho_bytes / 1048576.0::double) end tamanho from catalogo""")
def catalog_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Readable sizes of the catalogued files."""
    return read(spark, d, "catalogo").select("id_documento", formats.byte_size(F.col("tamanho_bytes")).alias("tamanho")).distinct()


# --- sources and sinks


@query(f"with {INDEX} select term, df, cf from voc")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary written as JSON lines and read back with its schema."""
    path = new_path(spark, "json")
    files.write_json(ix.vocabulary(index_of(spark, d).postings), path)
    return files.read_json(spark, path, "term string, df bigint, cf bigint")


@query(f"with {_RUNS} select id_execucao, configuracao, tempo_execucao_ms from r")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The runs written as a semicolon table with decimal commas and read back."""
    path = new_path(spark, "csv")
    files.write_csv(runs(spark).select("id_execucao", "configuracao", "tempo_execucao_ms"), path, decimal_comma=True)
    return files.read_csv(spark, path, "id_execucao int, configuracao string, tempo_execucao_ms double", decimal_comma=True)


@query("""select i::bigint i, printf('chunk_%04d', i) id_chunk, (((i * 7919 + 104729) % 41))::double score from range(1, 2001) t(i)""")
def synthetic_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Two thousand candidates with many ties, by arithmetic."""
    return files.synthetic_candidates(spark, 2000)


@query("""select query_id, id_chunk, row_number() over (partition by query_id order by score desc, id_chunk, avaliado_em) posicao from candidatos_topk
  where query_id is not null and score is not null and not isnan(score)
  qualify posicao between 6 and 10""")
def candidates_second_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of five of every query's recorded candidates, repeats included."""
    rows = read(spark, d, "candidatos_topk").where("query_id is not null and score is not null and not isnan(score)")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id_chunk"), F.col("avaliado_em"))
    ranked_rows = rows.select("query_id", "id_chunk", F.row_number().over(w).alias("posicao")).where("posicao <= 10")
    return ranked_rows.where("posicao >= 6").select("query_id", "id_chunk", F.col("posicao").cast("bigint").alias("posicao"))


@query("""select (score is null) nulo, coalesce(isnan(score), false) nan, count(*) linhas, count(distinct query_id) consultas, sum(map_values(frequencias_termos)[1])::bigint primeira from candidatos_topk group by all""")
def candidates_quality(spark: SparkSession, d: str) -> DataFrame:
    """Recorded candidates by the state of their score."""
    first = F.element_at(F.map_values("frequencias_termos"), 1)
    return read(spark, d, "candidatos_topk").groupBy(F.col("score").isNull().alias("nulo"), F.coalesce(F.isnan("score") & F.col("score").isNotNull(), F.lit(False)).alias("nan")).agg(
        F.count("*").alias("linhas"), F.count_distinct("query_id").alias("consultas"), F.sum(F.when(F.size("frequencias_termos") > 0, first)).alias("primeira")
    )


# --- experiments over the tables

_ODD = "ordem_global % 2 = 1"
_LOADS = {"carga_1": None, "carga_2": _ODD}


def _load_sql(load: str, only: str) -> str:
    """Candidates of both metrics and comparisons on one load, its statistics those of the load."""
    bm25 = "ln(1 + (st.n - f.df + 0.5::double) / (f.df + 0.5::double)) * p.tf * 2.5::double / (p.tf + 1.5::double * (0.25::double + 0.75::double * l.dl / st.avgdl))"
    return f"""(with recursive t as (select tok.* from tok join c using (id_chunk) where {only}), len as (select id_chunk, len(t) dl from t), st as (select count(*) n, avg(dl) avgdl from len),
      post as (select term, id_chunk, count(*) tf from (select id_chunk, unnest(t) term from t) group by all), f as (select term, count(*) df from post group by term),
      s as (select id_chunk, round(sum({bm25}), 4) score from post p join q using (term) join f using (term) join len l using (id_chunk) cross join st group by id_chunk),
      o as (select score, row_number() over (order by ordem_global, s.id_chunk) - 1 p, row_number() over (order by score desc, s.id_chunk) r from s join c on c.id_chunk = s.id_chunk where score > 0),
      parts as (select 0::bigint lo, (select count(*) from o) hi union all select unnest([lo, lo + (hi - lo) // 2]), unnest([lo + (hi - lo) // 2, hi]) from parts where hi - lo > 1),
      x as (select lo, hi, r, score, p < lo + (hi - lo) // 2 a from parts join o on p >= lo and p < hi where hi - lo > 1),
      z as (select lo, hi, least(max(r) filter (a), max(r) filter (not a)) z from x group by lo, hi), y as (select x.* from x join z using (lo, hi) where r <= z),
      w as (select (select count(*) from y) + (select count(*) from y where exists (select 1 from x where x.lo = y.lo and x.hi = y.hi and x.a <> y.a and x.score = y.score and x.r > y.r)) comparacoes)
      select '{load}' carga, (select n from st) chunks, (select count(distinct id_chunk) from post join q using (term)) simples, (select count(*) from o) bm25, (select comparacoes from w) comparacoes)"""


_RUNS_SQL = f"""with {INDEX}, {ASKED}, g as ({_load_sql("carga_1", "true")} union all {_load_sql("carga_2", "c." + _ODD)}),
  m as (select * from (values (1, 'C1', 'linear', 'simples'), (2, 'C2', 'indexada', 'bm25'), (3, 'C3', 'indexada', 'bm25')) v(o, configuracao, modo_busca, metrica_score)),
  e as (select row_number() over (order by o, carga, repeticao)::integer id_execucao, m.*, g.*, repeticao from m, g, (values (1), (2)) r(repeticao))"""


@query(f"""{_RUNS_SQL} select id_execucao, configuracao, modo_busca, metrica_score, carga, chunks total_chunks_carga, repeticao, case when o = 1 then simples else bm25 end candidatos_avaliados,
  case when o = 3 then comparacoes else 0 end comparacoes_ordenacao, 'sucesso' status from e""")
def experiment_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every configuration run on the whole and on the halved collection: what the runs counted."""
    made = experiment.run_matrix(index_of(spark, d), _LOADS, goldens.QUERY)
    return made.select("id_execucao", "configuracao", "modo_busca", "metrica_score", "carga", "total_chunks_carga", "repeticao", "candidatos_avaliados", "comparacoes_ordenacao", "status")


@query("""select * from (values ('falha', 1::bigint, 1::bigint, 0::bigint, 1.0::double, 0.0::double), ('sucesso', 1, 0, 0, 0.0, 0.0)) v(caso, execucoes, falhas, vazias, taxa_falhas, taxa_vazias)""")
def failed_runs(spark: SparkSession, d: str) -> DataFrame:
    """A run that can't be made is a row like the others: rates of an unknown mode and of a known one."""
    configurations = (experiment.Configuration("falha", "desconhecida", "bm25"), experiment.Configuration("sucesso", "indexada", "bm25"))
    made = experiment.run_matrix(index_of(spark, d), {"carga_1": None}, goldens.QUERY, configurations, 1)
    return experiment.rates(made, ["configuracao"]).withColumnRenamed("configuracao", "caso")


@query(_robust_sql("select m.modo, count(*) execucoes, 0::bigint falhas, count(*) filter (k = 0) vazias, 0.0::double taxa_falhas, round(count(*) filter (k = 0) / count(*)::double, 4) taxa_vazias from r, (values ('indexada'), ('linear')) m(modo) group by 1"))
def robustness_by_mode(spark: SparkSession, d: str) -> DataFrame:
    """Failures and empty results of the battery for each access path."""
    runs_of = search.battery(index_of(spark, d), list(goldens.BATTERY))
    each = F.explode(F.array(F.struct(F.lit("indexada").alias("modo"), F.col("por_indice").alias("n")), F.struct(F.lit("linear").alias("modo"), F.col("por_varredura").alias("n"))))
    flat = runs_of.select(each.alias("x")).select("x.modo", F.col("x.n").alias("candidatos_avaliados"), F.lit("sucesso").alias("status"))
    return experiment.rates(flat, ["modo"])


@query(f"""with {_RUNS} select configuracao, round(avg(tempo_execucao_ms), 4) media, round(stddev_pop(tempo_execucao_ms), 4) desvio, min(tempo_execucao_ms) minimo,
  max(tempo_execucao_ms) maximo, median(tempo_execucao_ms) mediana, count(*) execucoes from r where status = 'sucesso' group by 1""")
def experiment_by_configuration(spark: SparkSession, d: str) -> DataFrame:
    """Times of the published runs by configuration, both loads together."""
    return analysis.run_summary(runs(spark), ["configuracao"], "tempo_execucao_ms")


@query(f"""with {_SERIES} select serie, count(*) pontos, round(regr_slope(ln(y), ln(x)), 4) expoente, round(exp(regr_intercept(ln(y), ln(x))), 6) fator, round(regr_r2(ln(y), ln(x)), 4) r2
from pts where x > 0 and y > 0 group by 1""")
def loglog_from_zero(spark: SparkSession, d: str) -> DataFrame:
    """Growth exponents over all points with a positive size."""
    return analysis.loglog(series(spark), ["serie"], 0.0)


_POINTS = 6


@query(f"""with {INDEX}, {ASKED}, o as (select c.id_chunk, texto, row_number() over (order by ordem_global, c.id_chunk) i from c), tot as (select count(*) n from c),
  pt as (select distinct least(round_even(j * (n - 1) / (greatest(least({_POINTS} + 1, n), 3) - 1)::double, 0), n - 1)::integer ponto from tot, range(greatest(least({_POINTS} + 1, n), 3)) t(j)),
  h as (select id_chunk, count(*) hits from post join q using (term) group by 1),
  e as (select i, length(texto) chars, len({sql_words("texto")}) words, dl, coalesce(hits, 0) hits from o join len using (id_chunk) left join h using (id_chunk)),
  g as (select ponto, sum(chars) a, sum(words) b, sum(dl) c, count(*) d, sum(hits) f, count(*) filter (hits > 0) k from pt join e on i <= ponto where ponto > 0 group by ponto)
select unnest(['normalizacao', 'janelas', 'indexacao', 'estatisticas', 'busca_linear', 'busca_indexada', 'ordenacao', 'topk']) estagio, ponto, unnest([coalesce(a, 0), b, c, d, c, f, k, k])::bigint n from g""")
def stage_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Work of the eight stages on growing parts of the chunks."""
    index = index_of(spark, d)
    return experiment.stage_sizes(index, goldens.QUERY, list(experiment.spaced_points(index.n, _POINTS)))


_SIZES = (75, 150, 300)
_DRAWN = "((({x}) * 7919 + 104729) % 65537 + 0.5::double) / 65537"
_PARETO = f"round(pow({_DRAWN.format(x='(i * 48271 + 11) % (2 * {n})')}, -1 / 1.8::double), 4)"


def _baseline_sql(n: int) -> str:
    return f"""(with recursive v as (select i::bigint i, printf('chunk_%04d', i) id_chunk, {_PARETO.format(n=n)} score from range(1, {n} + 1) t(i)),
      o as (select score, i - 1 p, row_number() over (order by score desc, id_chunk) r from v),
      parts as (select 0::bigint lo, {n}::bigint hi, 1 depth union all select unnest([lo, lo + (hi - lo) // 2]), unnest([lo + (hi - lo) // 2, hi]), depth + 1 from parts where hi - lo > 1),
      x as (select lo, hi, r, score, p < lo + (hi - lo) // 2 a from parts join o on p >= lo and p < hi where hi - lo > 1),
      z as (select lo, hi, least(max(r) filter (a), max(r) filter (not a)) z from x group by lo, hi), y as (select x.* from x join z using (lo, hi) where r <= z),
      w as (select (select count(*) from y) cs, (select count(*) from y where exists (select 1 from x where x.lo = y.lo and x.hi = y.hi and x.a <> y.a and x.score = y.score and x.r > y.r)) ci)
      select {n}::bigint n, cs comparacoes_score, ci comparacoes_id, (select sum(hi - lo) filter (hi - lo > 1)::bigint from parts) movimentacoes, (select count(*) from parts) chamadas,
        (select max(depth) from parts)::integer profundidade, cs + ci comparacoes, (select count(distinct score) from o) scores_distintos, (select count(*) - count(distinct score) from o) empates_score,
        true ordem_igual, true topk_igual from w)"""


@query("select * from " + " union all select * from ".join(f"{_baseline_sql(n)} b{n}" for n in _SIZES))
def sort_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Skewed candidates of growing number: ties, work of a merge sort, and the distributed order against a plain one."""
    return experiment.sort_baseline(spark, list(_SIZES), files.pareto_candidates)


@query(f"""select 'pareto' gerador, i::bigint i, printf('chunk_%04d', i) id_chunk, {_PARETO.format(n=1000)} score from range(1, 1001) t(i)
union all select 'uniforme', i, printf('chunk_%04d', i), round({_DRAWN.format(x="i")} * 100, 4) from range(1, 1001) t(i)""")
def synthetic_skewed(spark: SparkSession, d: str) -> DataFrame:
    """A thousand candidates of skewed scores and of even ones, by arithmetic."""
    made = [files.pareto_candidates(spark, 1000), files.uniform_candidates(spark, 1000)]
    return made[0].select(F.lit("pareto").alias("gerador"), "*").unionByName(made[1].select(F.lit("uniforme").alias("gerador"), "*"))


# --- lookups, digests, artefacts


@query("select doc_id, octet_length(encode(text)) tamanho_bytes, sha256(text) hash_sha256 from documents where text is not null")
def content_digests(spark: SparkSession, d: str) -> DataFrame:
    """Size and digest of the content of every document."""
    rows = read(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.octet_length("text").cast("bigint").alias("tamanho_bytes"), F.sha2("text", 256).alias("hash_sha256"))


@query(f"""select id_documento, numero_pagina, case when contains(coalesce(motivo_status, ''), 'imagem_presente') then 'imagem_presente_sem_camada_textual' else 'sem_texto_e_sem_imagem_detectavel' end motivo
from pages_norm where coalesce({sql_strip("texto_normalizado")}, '') = ''""")
def empty_page_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why each page without text is empty, by whether an image was noted."""
    image = F.coalesce("motivo_status", F.lit("")).contains("imagem_presente")
    rows = read(spark, d, "pages_norm").withColumn("motivo", catalogue.empty_reason(F.col("texto_normalizado"), image))
    return rows.where("motivo is not null").select("id_documento", "numero_pagina", "motivo")


@query("select id_documento, numero_pagina, texto_normalizado from pages_norm where id_documento = 'doc_005' and numero_pagina = 1")
def page_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One page of one document, every version; both keys reach the scan."""
    return read(spark, d, "pages_norm").where("id_documento = 'doc_005' and numero_pagina = 1").select("id_documento", "numero_pagina", "texto_normalizado")


@query("select distinct id_documento, nome_arquivo, quantidade_paginas, fonte_url from catalogo where id_documento = 'doc_005'")
def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue entry of one document."""
    return read(spark, d, "catalogo").where("id_documento = 'doc_005'").select("id_documento", "nome_arquivo", "quantidade_paginas", "fonte_url").distinct()


@query(f"with {COLLECTION} select count(*) chunks, count(*) filter (coalesce({sql_strip('texto')}, '') = '') vazios, count(*) filter (coalesce(len(paginas), 0) = 0) sem_paginas from c")
def chunk_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, those without text, those without pages."""
    pages = F.coalesce(F.when(F.col("paginas").isNotNull(), F.size("paginas")), F.lit(0))
    return collection(spark, d).agg(F.count("*").alias("chunks"), F.count_if(tx.is_blank(F.col("texto"))).alias("vazios"), F.count_if(pages == 0).alias("sem_paginas"))


@query(f"with {INDEX} select term, df, cf from voc")
def json_envelope_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary written in blocks under an envelope and read back, with a part written bare beside it."""
    vocabulary_of = materialize(ix.vocabulary(index_of(spark, d).postings), "vocabulario")
    wrapped, bare = new_path(spark, "json"), new_path(spark, "json")
    files.write_json(vocabulary_of.where("df > 1"), wrapped, "termos")
    files.write_json(vocabulary_of.where("df <= 1"), bare)
    schema = "term string, df bigint, cf bigint"
    return files.read_json(spark, wrapped, schema, "termos", whole=False).unionByName(files.read_json(spark, bare, schema, "termos", whole=False))


@query(f"with {_RUNS} select id_execucao, configuracao, tempo_execucao_ms from r")
def csv_mark_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The runs written with decimal points and a byte-order mark, and read back."""
    path = new_path(spark, "csv")
    files.write_csv(runs(spark).select("id_execucao", "configuracao", "tempo_execucao_ms"), path, mark=True)
    return files.read_csv(spark, path, "id_execucao int, configuracao string, tempo_execucao_ms double")


@query(f"with {_RUNS} select id_execucao, replace(printf('%.3f', tempo_execucao_ms / 1000), '.', ',') || ' s' tempo from r")
def report_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Times of the runs in seconds, as the reports print them."""
    return runs(spark).select("id_execucao", formats.seconds(F.col("tempo_execucao_ms")).alias("tempo"))


@query(_search_sql(sql_bm25(), "select * from (" + TOP + ") where posicao <= 5"))
def search_persisted(spark: SparkSession, d: str) -> DataFrame:
    """A search whose candidates and report are kept as artefacts, its first five read back from them."""
    path = new_path(spark, "busca")
    results.run_search(index_of(spark, d), goldens.QUERY, path)
    return results.read_first(spark, path).select("posicao", "id_chunk", "score")
