"""Searches kept as artefacts: all candidates, the first of them in order, and a report of the run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.functions import text as tx
from garimpo.functions.scoring import K1, B
from garimpo.operators import experiment, search
from garimpo.operators.index import Index
from garimpo.sources import files
from garimpo.workdir import materialize

FIRST_SCHEMA = "posicao int, id_chunk string, id_documento string, nome_arquivo string, paginas array<int>, score double, frequencias_termos map<string,bigint>, texto string"


def run_search(index: Index, query: str, path: str, mode: str = "indexada", metric: str = "bm25", k: int = 5, k1: float = K1, b: float = B) -> dict:
    """Search, order and keep: ``path``/candidatos (JSON lines), ``path``/primeiros (the first ``k``, all for 0), ``path``/relatorio (one line). Gives the report."""
    search.check_parameters(k, k1, b, metric)
    if not index.n:
        raise ValueError("the index holds no chunks")
    tokens, removed, _, distinct = tx.query_terms(query)
    found, took, peak = experiment.measured(index.spark, lambda: materialize(experiment.candidates_of(index, query, mode, metric, k1, b), "candidatos"))
    files.write_json(found, f"{path}/candidatos")
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), F.col("id_chunk"))
    first = search.top_k(found, k)
    # k rows are numbered in one task; all of them keep the order of their files
    numbered = first.withColumn("posicao", F.row_number().over(order)) if k else first.withColumn("posicao", F.lit(None).cast("int"))
    _, sorting, _ = experiment.measured(index.spark, lambda: files.write_json(search.with_attributes(numbered, index), f"{path}/primeiros"))
    report = {
        "consulta": query, "tokens": tokens, "stopwords_removidas": removed, "termos_distintos": distinct, "configuracao": mode, "metrica_score": metric, "k": k, "k1": k1, "b": b,
        "chunks": index.n, "candidatos": found.count(), "tempo_busca_ms": round(took, 4), "tempo_ordenacao_ms": round(sorting, 4), "pico_memoria_mb": round(peak, 4),
        "aviso": None if distinct else search.WARNING,
    }
    index.spark.createDataFrame([(json.dumps(report, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/relatorio")
    return report


def read_first(spark: SparkSession, path: str) -> DataFrame:
    """The first candidates that a search kept."""
    return files.read_json(spark, f"{path}/primeiros", FIRST_SCHEMA)


def read_report(spark: SparkSession, path: str) -> dict:
    """The report that a search kept."""
    return json.loads(spark.read.text(f"{path}/relatorio").first()[0])
