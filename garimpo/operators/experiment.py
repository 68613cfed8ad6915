"""Experiments on an index: runs of configurations, growth of the stages, sorting methods against each other.

What a run counts (candidates, terms examined, comparisons) is data and can be checked; its
times and memory are measured and belong to the machine. A run that fails is a row too.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.functions import text as tx
from garimpo.operators import analysis, search
from garimpo.operators.index import Index
from garimpo.operators.ordinals import global_ordinal
from garimpo.workdir import materialize

RUN_SCHEMA = """id_execucao int, configuracao string, modo_busca string, metrica_score string, carga string, total_chunks_carga bigint, repeticao int,
    tempo_execucao_ms double, tempo_ordenacao_ms double, pico_memoria_mb double, candidatos_avaliados bigint, comparacoes_ordenacao bigint, status string, erro string"""


@dataclass(frozen=True)
class Configuration:
    name: str
    mode: str  # linear or indexada
    metric: str
    sorts: bool = False  # the merge sort of the candidates is counted


CONFIGURATIONS = (Configuration("C1", "linear", "simples"), Configuration("C2", "indexada", "bm25"), Configuration("C3", "indexada", "bm25", True))


def candidates_of(index: Index, query: str, mode: str, metric: str, k1: float = search.K1, b: float = search.B) -> DataFrame:
    """Candidates by one of the two access paths."""
    if mode not in ("linear", "indexada"):
        raise ValueError(f"unknown mode {mode}")
    return (search.search_scan if mode == "linear" else search.search_index)(index, query, metric, k1, b)


def measured(spark: SparkSession, work) -> tuple[object, float, float]:
    """(result, milliseconds, greatest execution memory of a stage in MB) of a piece of work that runs Spark jobs."""
    context = spark.sparkContext
    group = f"medida-{time.monotonic_ns()}"
    context.setJobGroup(group, "measured")
    began = time.perf_counter()
    try:
        result = work()
    finally:
        took = (time.perf_counter() - began) * 1000
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    peak = 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            try:
                peak = max(peak, store.lastStageAttempt(stage).peakExecutionMemory())
            except Exception:  # stages that were skipped have no attempt
                continue
    return result, took, peak / 1e6


def counted_sort(index: Index, found: DataFrame) -> int:
    """Comparisons of a merge sort of the candidates, given in chunk order."""
    keyed = found.select("id_chunk", "score", (-F.col("score")).alias("__s")).join(index.chunks.select("id_chunk", "ordem_global"), "id_chunk")
    placed = global_ordinal(global_ordinal(keyed, ["__s", "id_chunk"], "r"), ["ordem_global", "id_chunk"], "p")
    placed = materialize(placed.select((F.col("p") - 1).alias("p"), "r", "score"), "candidatos")
    return analysis.sort_counters(placed, placed.count()).first()["comparacoes"]


def run_matrix(
    index: Index, loads: dict[str, str | None], query: str, configurations: tuple[Configuration, ...] = CONFIGURATIONS, repetitions: int = 2, k: int = 5
) -> DataFrame:
    """One row a run: every configuration on every load (a condition on chunks, or none), so many times over.

    A run writes out its candidates and takes the first ``k``; an error becomes a row with status ``falha`` and its text.
    """
    spark, rows = index.spark, []
    parts = {name: index if only is None else index.restricted(index.chunks.where(only)) for name, only in loads.items()}
    for config in configurations:
        for load, part in parts.items():
            for again in range(1, repetitions + 1):
                row = [len(rows) + 1, config.name, config.mode, config.metric, load, part.n, again]
                try:

                    def find(part: Index = part, config: Configuration = config) -> DataFrame:
                        found = materialize(candidates_of(part, query, config.mode, config.metric).select("id_chunk", "score"), "corrida")
                        search.top_k(found, k).collect()  # k rows
                        return found

                    found, took, peak = measured(spark, find)
                    compared, sorting = 0, 0.0
                    if config.sorts:
                        compared, sorting, more = measured(spark, lambda part=part, found=found: counted_sort(part, found))
                        peak = max(peak, more)
                    rows.append((*row, round(took, 4), round(sorting, 4), round(peak, 4), found.count(), compared, "sucesso", None))
                except Exception as error:  # a failed run is data
                    rows.append((*row, None, None, None, None, None, "falha", f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"))
    return spark.createDataFrame(rows, RUN_SCHEMA)


def rates(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs, failures, empty results and their shares, for each group."""
    n = F.count("*")
    failed, empty = F.count_if(F.col("status") == "falha"), F.count_if(F.col("candidatos_avaliados") == 0)
    return runs.groupBy(*by).agg(n.alias("execucoes"), failed.alias("falhas"), empty.alias("vazias"), F.round(failed / n, 4).alias("taxa_falhas"), F.round(empty / n, 4).alias("taxa_vazias"))


def spaced_points(total: int, points: int) -> Iterator[int]:
    """Distinct growing indices below ``total``, evenly spaced, without the first: ``points`` of them where there are as many."""
    steps = max(min(points + 1, total), 3)
    return iter(sorted({int(i) for i in np.rint(np.linspace(0, total - 1, steps)) if i > 0}))


STAGES = ("normalizacao", "janelas", "indexacao", "estatisticas", "busca_linear", "busca_indexada", "ordenacao", "topk")


def stage_sizes(index: Index, query: str, points: list[int]) -> DataFrame:
    """(estagio, ponto, n): the work of each stage on the first ``ponto`` chunks: characters, words, occurrences, chunks, terms examined, postings, candidates.

    One pass over the chunks and one over the postings, whatever the number of points.
    """
    spark, terms = index.spark, tx.query_terms(query)[3]
    numbered = materialize(global_ordinal(index.chunks.select("ordem_global", "id_chunk"), ["ordem_global", "id_chunk"], "i").select("id_chunk", "i"), "ordem")
    texts = index.chunks.select("id_chunk", F.length("texto").alias("chars"), tx.word_count(F.col("texto")).alias("words")).join(numbered, "id_chunk").join(index.lengths, "id_chunk")
    asked = index.postings.where(F.col("term").isin(terms)) if terms else index.postings.limit(0)
    hits = asked.join(numbered, "id_chunk").groupBy("i").agg(F.count("*").alias("hits"))
    each = texts.join(hits, "i", "left").select(
        F.explode(F.array(*map(F.lit, sorted(points)))).alias("ponto"), "i", "chars", "words", "dl", F.coalesce("hits", F.lit(0)).alias("hits")
    ).where("i <= ponto")
    counted = each.groupBy("ponto").agg(
        F.sum("chars").alias("normalizacao"), F.sum("words").alias("janelas"), F.sum("dl").alias("indexacao"), F.count("*").alias("estatisticas"),
        F.sum("dl").alias("busca_linear"), F.sum("hits").alias("busca_indexada"), F.count_if(F.col("hits") > 0).alias("ordenacao"), F.count_if(F.col("hits") > 0).alias("topk"),
    )
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("estagio"), F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias("n")) for s in STAGES)))
    return spark.createDataFrame([(p,) for p in points], "ponto int").join(counted, "ponto", "left").select("ponto", rows.alias("x")).select("x.estagio", "ponto", "x.n")


def stage_measurements(index: Index, query: str, points: list[int]) -> DataFrame:
    """(estagio, i, n, tempo_ms): each stage run on the first chunks of each point; the input of the growth fits of ``analysis``."""
    from garimpo.operators import chunking

    spark = index.spark
    numbered = global_ordinal(index.chunks.select("ordem_global", "id_chunk"), ["ordem_global", "id_chunk"], "i").select("id_chunk", "i")
    chunks = materialize(index.chunks.select("id_chunk", "ordem_global", "texto").join(numbered, "id_chunk"), "medidas")
    size = {(r["estagio"], r["ponto"]): r["n"] for r in stage_sizes(index, query, points).collect()}  # stages by points

    def write(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    rows = []
    for i, point in enumerate(sorted(points)):
        load = chunks.where(F.col("i") <= point)
        part = Index.build(load)
        found = materialize(search.search_index(part, query).select("id_chunk", "score"), "medidas")
        work = {
            "normalizacao": lambda: write(load.select(tx.normalize_text(F.col("texto")))),
            "janelas": lambda: write(chunking.chunk_texts(load, "id_chunk", "texto")),
            "indexacao": lambda: Index.build(load),
            "estatisticas": lambda: write(part.lengths.agg(F.count("*"), F.avg("dl"))),
            "busca_linear": lambda: write(search.search_scan(part, query)),
            "busca_indexada": lambda: write(search.search_index(part, query)),
            "ordenacao": lambda: write(search.ordered(found)),
            "topk": lambda: write(search.top_k(found, 5)),
        }
        rows += [(s, i, float(size[s, point]), measured(spark, work[s])[1]) for s in STAGES]
    return spark.createDataFrame(rows, "estagio string, i int, n double, tempo_ms double")


def sort_baseline(spark: SparkSession, sizes: list[int], make, k: int = 5) -> DataFrame:
    """One row a size: candidates from ``make(spark, n)``, distinct scores, ties, comparisons of a merge sort, and whether orders agree.

    The distributed order (by ranges) is held against a plain ranking of the same rows, over all places and over the first ``k``.
    """
    out = None
    for n in sizes:
        rows = materialize(make(spark, n).withColumn("__s", -F.col("score")), "sinteticos")
        ranked = materialize(global_ordinal(rows, ["__s", "id_chunk"], "r").select("i", "id_chunk", "score", "r"), "sinteticos")
        plain = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), F.col("id_chunk"))  # n rows of a size of the experiment
        both = ranked.withColumn("q", F.row_number().over(plain))
        work = analysis.sort_counters(ranked.select((F.col("i") - 1).alias("p"), "r", "score"), n)
        agree = both.agg(
            F.count_distinct("score").alias("scores_distintos"), (F.count("*") - F.count_distinct("score")).alias("empates_score"),
            F.bool_and(F.col("q") == F.col("r")).alias("ordem_igual"), F.coalesce(F.bool_and(F.when(F.col("q") <= k, F.col("q") == F.col("r"))), F.lit(True)).alias("topk_igual"),
        )
        row = work.withColumn("__k", F.lit(1)).join(agree.withColumn("__k", F.lit(1)), "__k").drop("__k")  # one row each
        out = row if out is None else out.unionByName(row)
    return out
