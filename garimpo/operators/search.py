"""Lexical search: by scan or by index, by BM25 or term counts, one query or many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions import text as tx
from garimpo.functions.scoring import K1, B, idf, tf_weight
from garimpo.operators.blocks import best_in_blocks
from garimpo.operators.index import Index, analyse
from garimpo.workdir import materialize

UNIT = 1 << 40  # a score of 1 in exact sums
WARNING = "Consulta sem termos úteis após a remoção de stop words."


def check_parameters(k: int, k1: float, b: float, metric: str, mode: str = "or") -> None:
    if k < 0 or k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k >= 0, k1 >= 0 and 0 <= b <= 1 are required")
    if metric not in ("bm25", "simples") or mode not in ("or", "and"):
        raise ValueError("metric is bm25 or simples, mode is or or and")


def _terms(index: Index, terms: list[str]) -> DataFrame:
    """(ord, term) of one query: a local relation."""
    return index.spark.createDataFrame(list(enumerate(terms)), "ord int, term string")


def _score(parts: Column, metric: str) -> Column:
    """Sum of the parts in the order of the query's terms, so that it is the same on every run."""
    if metric == "simples":
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s + x.tf)
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x.part)


def score_matches(index: Index, matches: DataFrame, metric: str = "bm25", k1: float = K1, b: float = B, by: list[str] = ()) -> DataFrame:
    """(by, id_chunk, score, frequencias_termos, termos) from matched postings (by, ord, term, id_chunk, tf, dl, df).

    BM25 is rounded to four places; a chunk's matched terms, at most as many as the query has, come together.
    """
    matches = matches.withColumn("part", _part(index, k1, b) if metric == "bm25" else F.lit(0.0))
    entry = F.struct("ord", "term", "tf", "part")
    grouped = matches.groupBy(*by, "id_chunk").agg(F.array_sort(F.collect_list(entry)).alias("__m"))
    score = _score(F.col("__m"), metric)
    return grouped.select(
        *by, "id_chunk", (F.round(score, 4) if metric == "bm25" else score).alias("score"),
        F.map_from_entries(F.transform("__m", lambda x: F.struct(x.term, x.tf))).alias("frequencias_termos"), F.size("__m").alias("termos"),
    )


def _part(index: Index, k1: float, b: float) -> Column:
    """What a posting (tf, dl, df) adds to a score."""
    return idf(F.lit(index.n), F.col("df")) * tf_weight(F.col("tf"), F.col("dl"), F.lit(float(index.mean_length)), k1, b)


def search_index(
    index: Index, query: str, metric: str = "bm25", k1: float = K1, b: float = B, mode: str = "or", document: str | None = None, only_positive: bool = True
) -> DataFrame:
    """Candidates of one query from the postings of its terms.

    ``mode`` ``and`` keeps chunks with every term of the query. ``document``
    keeps the chunks of one document; document frequencies stay those of the
    whole collection. The terms reach the scan of the postings as a filter.
    """
    check_parameters(0, k1, b, metric, mode)
    terms = tx.query_terms(query)[3]
    found = index.postings.where(F.col("term").isin(terms)) if terms else index.postings.limit(0)
    matches = _placed(found, terms)
    if document is not None:
        matches = matches.join(index.chunks.where(F.col("id_documento") == document).select("id_chunk"), "id_chunk", "left_semi")
    out = score_matches(index, matches, metric, k1, b)
    if mode == "and":
        out = out.where(F.col("termos") == len(terms))
    return out.where("score > 0") if only_positive else out


def search_scan(index: Index, query: str, metric: str = "bm25", k1: float = K1, b: float = B, text: str = "texto") -> DataFrame:
    """The candidates of ``search_index``, found by reading every chunk instead of the index."""
    check_parameters(0, k1, b, metric)
    terms = tx.query_terms(query)[3]
    found = materialize(analyse(index.chunks, "id_chunk", text, terms).where("term is not null"), "achados")  # one pass over the texts
    return score_matches(index, _placed(found, terms), metric, k1, b).where("score > 0")


def _placed(found: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of a query's terms with ``ord``, their place in it, and ``df``: one number a term comes to the driver and goes into the plan."""
    df = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}
    if not terms:
        return found.withColumns({"ord": F.lit(0), "df": F.lit(0).cast("bigint")})

    def of_term(values: list[Column]) -> Column:
        return F.try_element_at(F.create_map(*(x for term, value in zip(terms, values) for x in (F.lit(term), value))), F.col("term"))

    return found.withColumns({"ord": of_term([F.lit(i) for i in range(len(terms))]), "df": of_term([F.lit(df.get(t, 0)).cast("bigint") for t in terms])})


def ordered(candidates: DataFrame) -> DataFrame:
    """Score descending, then id ascending by code points."""
    return candidates.orderBy(F.col("score").desc(), F.col("id_chunk").asc())


def top_k(candidates: DataFrame, k: int) -> DataFrame:
    """The first ``k`` candidates, all of them for 0."""
    if k < 0:
        raise ValueError("k must not be negative")
    return ordered(candidates).limit(k) if k else ordered(candidates)


def with_attributes(candidates: DataFrame, index: Index) -> DataFrame:
    """Candidates with document, file, pages and text of their chunks; missing ones are empty."""
    own = index.chunks.select("id_chunk", "id_documento", "nome_arquivo", "paginas", "texto")
    out = candidates.join(own, "id_chunk", "left")
    return out.withColumns({"texto": F.coalesce("texto", F.lit("")), "paginas": F.coalesce("paginas", F.array().cast("array<int>"))})


def _distinct_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): repeated terms of a query count once."""
    return queries.where(F.col("term").isNotNull()).select("query_id", "term").distinct()


def _weighed(index: Index, terms: DataFrame, metric: str, k1: float, b: float) -> DataFrame:
    """(term, id_chunk, part): what each posting of the terms adds to a score, in whole units, so that sums don't depend on their order."""
    asked = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    if metric == "simples":
        return asked.select("term", "id_chunk", F.col("tf").alias("part"))
    # a posting's weight is the same in every query: it is worked out once for each posting
    frequencies = asked.groupBy("term").agg(F.count("*").alias("df"))
    return asked.join(frequencies, "term").select("term", "id_chunk", F.round(_part(index, k1, b) * UNIT).cast("bigint").alias("part"))


def _scores(matches: DataFrame, metric: str) -> DataFrame:
    """(query_id, id_chunk, score) from (query_id, id_chunk, part); positive scores only."""
    total = F.sum("part")
    score = F.round(total / F.lit(float(UNIT)), 4) if metric == "bm25" else total
    return matches.groupBy("query_id", "id_chunk").agg(score.alias("score")).where("score > 0")


def batch_scores(index: Index, queries: DataFrame, metric: str = "bm25", k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id_chunk, score) of every chunk with a term of each query (query_id, ord, term)."""
    check_parameters(0, k1, b, metric)
    distinct = _distinct_terms(queries)
    return _scores(distinct.join(_weighed(index, distinct, metric, k1, b), "term"), metric)


def batch_search(index: Index, queries: DataFrame, k: int = 5, metric: str = "bm25", k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, posicao, id_chunk, score) of the first ``k`` chunks of many queries at once, from (query_id, ord, term); all for 0.

    Queries with the same terms are answered once. They meet the chunks in blocks (``blocks``): work grows with the matches,
    what moves with the first ``k`` of each block. Repeated terms of a query count once.
    """
    check_parameters(k, k1, b, metric)
    if k == 0:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id_chunk"))
        return batch_scores(index, queries, metric, k1, b).select("query_id", F.row_number().over(order).alias("posicao"), "id_chunk", "score")
    distinct = _distinct_terms(queries)
    # a query has few terms
    listed = distinct.groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    listed = materialize(listed, "consultas")
    kinds = materialize(listed.select("terms").distinct().withColumn("s", F.monotonically_increasing_id()), "tipos")
    asked = kinds.select("s", F.explode("terms").alias("term"))
    best = best_in_blocks(asked, _weighed(index, asked, metric, k1, b), k, float(UNIT) if metric == "bm25" else 0.0)
    score = F.col("score") if metric == "bm25" else F.col("score").cast("bigint").alias("score")
    return listed.join(kinds, "terms").select("query_id", "s").join(best, "s").select("query_id", "posicao", "id_chunk", score)


def search_metrics(index: Index, query: str) -> DataFrame:
    """One row for each distinct term of the query, in its order: df, idf, and the work of both access paths."""
    terms = tx.query_terms(query)[3]
    frequencies = index.postings.where(F.col("term").isin(terms)).groupBy("term").agg(F.count("*").alias("df"))
    out = _terms(index, terms).join(frequencies, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return out.select(
        "ord", "term", "df", F.round(idf(F.lit(index.n), F.col("df")), 4).alias("idf"), F.lit(index.n * len(terms)).cast("bigint").alias("comparacoes_termos"),
        F.lit(index.total).cast("bigint").alias("tokens_examinados"), F.sum("df").over(Window.partitionBy(F.lit(0))).alias("postings_consultadas"),
    )


def same_ranking(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in which two rankings (posicao, id_chunk) differ; none if they are the same."""
    a, c = left.select("posicao", F.col("id_chunk").alias("a")), right.select("posicao", F.col("id_chunk").alias("b"))
    return a.join(c, "posicao", "full").where(~F.col("a").eqNullSafe(F.col("b")))


def battery(index: Index, queries: list[tuple[str, str]], k: int = 5) -> DataFrame:
    """Each (kind, query) by scan and by index: candidates, returned, empty, warning, equal results. One plan for all.

    Both access paths run for every query over the queries' terms as one batch, each with its own frequencies and
    lengths. Results are equal if both give the same chunks with the same scores: then they rank them alike.
    """
    spark = index.spark
    rows, terms = [], []
    for i, (kind, query) in enumerate(queries):
        distinct = tx.query_terms(query)[3]
        rows.append((i, kind, query, len(distinct)))
        terms += [(i, o, t) for o, t in enumerate(distinct)]
    asked = spark.createDataFrame(rows, "query_id int, categoria string, consulta string, m int")
    wanted = spark.createDataFrame(terms, "query_id int, ord int, term string")
    by_index = batch_scores(index, wanted).select("query_id", "id_chunk", F.col("score").alias("a"))
    # one pass over the texts; the queries' terms are a few literal rows
    found = materialize(analyse(index.chunks, terms=sorted({t for _, _, t in terms})).where("term is not null"), "achados")
    frequencies = found.groupBy("term").agg(F.count("*").alias("df"))
    scanned = found.join(F.broadcast(frequencies), "term").join(F.broadcast(wanted), "term")
    by_scan = score_matches(index, scanned, by=["query_id"]).where("score > 0").select("query_id", "id_chunk", F.col("score").alias("b"))
    both = by_index.join(by_scan, ["query_id", "id_chunk"], "full")
    counts = both.groupBy("query_id").agg(F.count("a").alias("por_indice"), F.count("b").alias("por_varredura"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("diferencas"))
    out = asked.join(counts, "query_id", "left").fillna(0, ["por_indice", "por_varredura", "diferencas"])
    return out.select(
        "query_id", "categoria", "consulta", "por_indice", "por_varredura", F.least("por_indice", F.lit(k)).alias("retornados"), (F.col("por_indice") == 0).alias("vazio"),
        (F.col("diferencas") == 0).alias("iguais"), F.when(F.col("m") == 0, F.lit(WARNING)).alias("aviso"),
    )
