"""Budgets, epochs, shares and the draw of the mix."""

import math
import os
import random
from collections import defaultdict

import pytest

from garimpo.llm import mix, tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="no vocabulary files")
DOC = "doc_id bigint, text string, source string, tokens int, vezes int"
TARGET = "source string, peso double, max_repeticoes int, tamanho int"


def docs():
    r = random.Random(4)
    made = []
    for i in range(900):
        source = r.choice(["grande"] * 12 + ["media"] * 3 + ["pequena", "fora", None])
        made.append((i, r.choice([None, "", "   "]) if r.random() < 0.05 else "palavra " * r.randint(1, 60) + "; 12 " * r.randint(0, 20), source, 0, 0))
    return made


TARGETS = [("grande", 0.3, 2, 0), ("media", 0.4, 3, 0), ("pequena", 0.2, 2, 0), ("vazia", 0.1, 5, 0), (None, 0.5, 1, 0), ("grande", 0.2, 1, 0)]


@pytest.fixture(scope="module")
def made(spark):
    d, t = spark.createDataFrame(docs(), DOC).repartition(5), spark.createDataFrame(TARGETS, TARGET)
    m = mix.mix_sources(d, t)
    sizes = {r["doc_id"]: r["tokens"] for r in tokens.count_tokens(d, ["doc_id"]).collect()}
    return m, {r["source"]: r for r in m.report.collect()}, [tuple(r) for r in m.documents.collect()], sizes


def test_report(made):
    _, report, chosen, sizes = made
    size = defaultdict(int)
    for i, _, source, *_ in docs():
        size[source] += sizes[i]
    total = size["grande"] + size["media"] + size["pequena"]
    assert set(report) == {"grande", "media", "pequena", "vazia"}
    for source, peso, most, _ in TARGETS[:4]:
        row = report[source]
        assert (row["tamanho"], row["max_repeticoes"]) == (size[source], most) and row["alvo"] == pytest.approx(peso * total)
        assert row["insuficiente"] == (size[source] * most < peso * total)
        budget = min(peso * total, size[source] * most)
        longest = max((sizes[i] for i, _, s, *_ in docs() if s == source), default=0)
        assert abs(row["tokens_na_mistura"] - budget) <= longest / 2 + 1e-6
        assert row["tokens_na_mistura"] == sum(t * v for _, s, t, v in chosen if s == source)
    assert sum(r["parte"] for r in report.values()) == pytest.approx(1)
    assert report["vazia"]["insuficiente"] and report["vazia"]["tokens_na_mistura"] == 0


def test_epochs_come_first(made):
    _, report, chosen, sizes = made
    for source, row in report.items():
        times = [v for _, s, _, v in chosen if s == source]
        assert all(row["epocas"] <= v <= min(row["epocas"] + 1, row["max_repeticoes"]) for v in times)
        if row["epocas"]:
            assert len(times) == sum(s == source and sizes[i] > 0 for i, _, s, *_ in docs())
    assert len({i for i, *_ in chosen}) == len(chosen)


def test_draw_is_repeatable_and_seeded(spark, made):
    d, t = spark.createDataFrame(docs(), DOC).repartition(9), spark.createDataFrame(TARGETS, TARGET)
    again = {tuple(r) for r in mix.mix_sources(d, t).documents.collect()}
    assert again == set(made[2])
    assert {tuple(r) for r in mix.mix_sources(d, t, seed=7).documents.collect()} != again


def test_buckets_change_nothing(spark, made, monkeypatch):
    monkeypatch.setattr(mix, "DOCS_PER_BUCKET", 10)
    d, t = spark.createDataFrame(docs(), DOC), spark.createDataFrame(TARGETS, TARGET)
    assert {tuple(r) for r in mix.mix_sources(d, t).documents.collect()} == set(made[2])


def test_few_or_many_quantiles_change_nothing(spark, made, monkeypatch):
    monkeypatch.setattr(mix, "DOCS_PER_BUCKET", 1)
    monkeypatch.setattr(mix, "QUANTILES", 2)
    monkeypatch.setattr(mix, "BROADCAST_SOURCES", 0)
    d, t = spark.createDataFrame(docs(), DOC), spark.createDataFrame(TARGETS, TARGET)
    assert {tuple(r) for r in mix.mix_sources(d, t).documents.collect()} == set(made[2])


def test_ranges_are_even_whatever_the_weights(spark):
    """Weights from least to most: the range in which a budget ends still holds few documents."""
    keyed = spark.range(20000).selectExpr("'s' source", "1L tokens", "-ln((id + 0.5) / 20000) / (case when id % 2 = 0 then 0.05 else 1 end) chave")
    plan = spark.createDataFrame([("s", 7000.5, 20000)], "source string, resto double, documentos bigint")
    old, mix.DOCS_PER_BUCKET = mix.DOCS_PER_BUCKET, 900
    try:
        r = mix.edge_ranges(keyed, plan).first()
    finally:
        mix.DOCS_PER_BUCKET = old
    assert keyed.where(f"chave < {r['de']!r}").count() == r["antes"] and 0 < keyed.where(f"chave between {r['de']!r} and {r['ate']!r}").count() <= 900


@pytest.mark.parametrize("least", [20_000, 3])
def test_copies_and_null_ids(spark, monkeypatch, least):
    """A third of the rows is one row again and again, many ids are null."""
    monkeypatch.setattr(mix, "DOCS_PER_BUCKET", least)
    rows = [(1, "a mesma linha de sempre", "s", 0, 0)] * 200 + [(None, f"texto sem id número {i}", "s", 0, 0) for i in range(200)] + [(i, f"texto {i} da fonte", "s", 0, 0) for i in range(2, 202)]
    d, t = spark.createDataFrame(rows, DOC).repartition(4), spark.createDataFrame([("s", 0.45, 1, 0), ("t", 0.55, 1, 0)], TARGET)
    m = mix.mix_sources(d, t)
    report, chosen = {r["source"]: r for r in m.report.collect()}, m.documents.collect()
    longest = max(r["tokens"] for r in chosen)
    assert abs(report["s"]["tokens_na_mistura"] - report["s"]["alvo"]) <= longest / 2 + 1e-6
    assert sum(r["tokens"] * r["vezes"] for r in chosen) == report["s"]["tokens_na_mistura"]
    assert sum(r["doc_id"] == 1 for r in chosen) <= 200 and {r["vezes"] for r in chosen} == {1}


def test_weights():
    from garimpo.functions import codepoints as cp
    import pyarrow as pa

    texts = ["A comissão poderá rever o prazo de inscrição.", "1 2 3 4 5", "A nota 7 vale 3 pontos.", "", None]
    w = mix.quality(next(cp.spans(pa.array(texts)))[1])
    assert w[0] > w[2] > w[1] == mix.LEAST_WEIGHT and len(w) == 5


def test_heavier_documents_are_taken_more_often(spark):
    rows = [(i, "palavra" if i % 2 else "1 2 3 4 5 6", "s", 0, 0) for i in range(4000)]
    d, t = spark.createDataFrame(rows, DOC), spark.createDataFrame([("s", 0.4, 1, 0), ("t", 0.6, 1, 0)], TARGET)
    taken = [r["doc_id"] % 2 for r in mix.mix_sources(d, t).documents.collect()]
    share = sum(taken) / len(taken)
    assert share > 0.8 and math.isfinite(share)


def test_empty(spark):
    d, t = spark.createDataFrame([], DOC), spark.createDataFrame(TARGETS, TARGET)
    m = mix.mix_sources(d, t)
    assert m.documents.count() == 0 and m.report.where("tamanho = 0 and not insuficiente").count() == 4
    assert mix.mix_sources(spark.createDataFrame(docs(), DOC), t.limit(0)).report.count() == 0
