"""Runs, growth and sorting methods; artefacts; the command line."""

import json

import pytest
from pyspark.sql import functions as F

from garimpo import __main__ as cli
from garimpo.operators import analysis, experiment, search
from garimpo.operators.index import Index
from garimpo.sources import catalogue, files, results
from test_search import SCHEMA, corpus


@pytest.fixture(scope="module")
def index(spark):
    return Index.build(spark.createDataFrame(corpus(), SCHEMA))


def test_matrix(index):
    rows = experiment.run_matrix(index, {"toda": None, "nenhuma": "false"}, "bolsa prazo").collect()
    assert len(rows) == 12 and [r["id_execucao"] for r in rows] == list(range(1, 13)) and {r["status"] for r in rows} == {"sucesso"}
    by = {(r["configuracao"], r["carga"]): r for r in rows}
    assert by["C1", "toda"]["candidatos_avaliados"] == search.search_scan(index, "bolsa prazo", "simples").count() and by["C1", "nenhuma"]["candidatos_avaliados"] == 0
    assert by["C3", "toda"]["comparacoes_ordenacao"] > by["C3", "toda"]["candidatos_avaliados"] > 0 == by["C2", "toda"]["comparacoes_ordenacao"]
    assert all(r["tempo_execucao_ms"] > 0 and r["pico_memoria_mb"] >= 0 for r in rows)


def test_failures_are_rows(index):
    made = experiment.run_matrix(index, {"toda": None}, "bolsa", (experiment.Configuration("x", "?", "bm25"), experiment.Configuration("y", "linear", "outra")), 1)
    assert [(r["status"], r["erro"][:10]) for r in made.orderBy("id_execucao").collect()] == [("falha", "ValueError")] * 2
    assert [tuple(r) for r in experiment.rates(made, ["status"]).collect()] == [("falha", 2, 2, 0, 1.0, 0.0)]


def test_points_and_stages(index):
    assert list(experiment.spaced_points(60, 6)) == [10, 20, 30, 39, 49, 59] and list(experiment.spaced_points(3, 9)) == [1, 2] and list(experiment.spaced_points(1, 4)) == []
    measured = experiment.stage_measurements(index, "bolsa prazo", [20, 40, 59])
    assert measured.count() == 24 and measured.where("tempo_ms <= 0 or n <= 0").count() == 0
    fits = analysis.model_fit(measured.withColumnsRenamed({"n": "x", "tempo_ms": "y"}), ["estagio"])
    assert fits.count() == 8 * len(analysis.MODELS)


def test_sort_baseline(spark):
    for make in (files.pareto_candidates, files.uniform_candidates, files.synthetic_candidates):
        rows = experiment.sort_baseline(spark, [1, 2, 75], make).collect()
        assert [r["n"] for r in rows] == [1, 2, 75] and all(r["ordem_igual"] and r["topk_igual"] for r in rows)
        assert all(r["scores_distintos"] + r["empates_score"] == r["n"] for r in rows) and rows[2]["chamadas"] == 149


def test_kept_search(spark, index, tmp_path):
    report = results.run_search(index, "bolsa prazo", str(tmp_path), "linear", k=3)
    assert results.read_report(spark, str(tmp_path)) == report and report["candidatos"] == search.search_scan(index, "bolsa prazo").count()
    alone = search.top_k(search.search_index(index, "bolsa prazo"), 3).collect()
    first = results.read_first(spark, str(tmp_path)).orderBy("posicao").collect()
    assert [(r["id_chunk"], r["score"], r["frequencias_termos"]) for r in first] == [(r["id_chunk"], r["score"], r["frequencias_termos"]) for r in alone]
    assert spark.read.json(f"{tmp_path}/candidatos").count() == report["candidatos"]
    assert results.run_search(index, "de o", f"{tmp_path}/b", k=0)["aviso"] == search.WARNING
    with pytest.raises(ValueError):
        results.run_search(Index.build(spark.createDataFrame([], SCHEMA)), "bolsa", f"{tmp_path}/c")
    with pytest.raises(ValueError):
        results.run_search(index, "bolsa", f"{tmp_path}/c", k=-1)


def test_command_line(spark, data, tmp_path, capsys):
    assert cli.main([data, str(tmp_path), "--modo", "ambos", "--k", "2"], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    reports = [json.loads(x) for x in lines if x.startswith("{")]
    assert [r["configuracao"] for r in reports] == ["linear", "indexada"] and reports[0]["candidatos"] == reports[1]["candidatos"]
    shown = [x.split("\t")[1:] for x in lines if not x.startswith("{")]
    assert len(shown) == 4 and shown[:2] == shown[2:]
    assert cli.main([data, str(tmp_path), "--k", "-1"], spark) == 2
    assert cli.main([f"{tmp_path}/nada", str(tmp_path)], spark) == 2


def test_envelopes(spark, tmp_path):
    df = spark.range(2500).selectExpr("id", "concat('t', id) t")
    files.write_json(df, f"{tmp_path}/e", "linhas", block=100)
    lines = [json.loads(x["value"]) for x in spark.read.text(f"{tmp_path}/e").collect()]
    assert sum(len(x["linhas"]) for x in lines) == 2500 and max(len(x["linhas"]) for x in lines) <= 100
    assert sorted(files.read_json(spark, f"{tmp_path}/e", "id bigint, t string", "linhas", whole=False).collect()) == sorted(df.collect())
    files.write_csv(df, f"{tmp_path}/c", mark=True)
    raw = spark.read.format("binaryFile").load(f"{tmp_path}/c/*.csv").collect()
    assert all(bytes(r["content"]).startswith(b"\xef\xbb\xbfid;t\n") for r in raw)
    assert sorted(files.read_csv(spark, f"{tmp_path}/c", "id bigint, t string").collect()) == sorted(df.collect())


def test_reasons(spark):
    df = spark.createDataFrame([(" ", True), (" ", False), (None, None), ("x", True)], "t string, i boolean")
    assert [r[0] for r in df.select(catalogue.empty_reason(F.col("t"), F.col("i"))).collect()] == [catalogue.WITH_IMAGE, catalogue.WITHOUT_IMAGE, catalogue.WITHOUT_IMAGE, None]
