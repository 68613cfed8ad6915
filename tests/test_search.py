"""Scores, access paths, filters, order and top-k."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from garimpo.functions.scoring import idf, tf_weight
from garimpo.functions.text import query_terms
from garimpo.operators import analysis, explore, search
from garimpo.operators.index import Index, nested, orphans

SCHEMA = "id_chunk string, id_documento string, nome_arquivo string, paginas array<int>, ordem_global bigint, texto string"


def corpus(n=60, seed=5):
    r = random.Random(seed)
    vocabulary = ["bolsa", "edital", "matrícula", "prazo", "recurso", "ata", "xis", "de", "o"]
    rows = []
    for i in range(n):
        text = None if i % 17 == 3 else " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 25)))
        rows.append((f"chunk_{9970 + i}", f"doc_{i % 7}", f"f{i % 7}.pdf", [1, 2][: 1 + i % 2], 9970 + i, text))
    return rows


@pytest.fixture(scope="module")
def index(spark):
    return Index.build(spark.createDataFrame(corpus(), SCHEMA))


def plain(rows, query, metric="bm25", k1=1.5, b=0.75):
    terms = query_terms(query)[3]
    tokens = {row[0]: re.findall(r"[^\W_]+", (row[5] or "").casefold()) for row in rows}
    n, mean = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = {t: sum(t in ts for ts in tokens.values()) for t in terms}
    out = {}
    for key, ts in tokens.items():
        tf = Counter(ts)
        if metric == "simples":
            score = sum(tf[t] for t in terms)
        else:
            score = round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(ts) / mean)) for t in terms if tf[t]), 4)
        if score > 0:
            out[key] = (score, {t: tf[t] for t in terms if tf[t]})
    return out


@pytest.mark.parametrize("metric", ["bm25", "simples"])
@pytest.mark.parametrize("query", ["bolsa matrícula", "edital edital de BOLSA", "xis", "nada disso", "", "de o da", "!!!"])
def test_scan_equals_index_equals_plain(index, query, metric):
    expected = plain(corpus(), query, metric)
    for found in (search.search_index(index, query, metric), search.search_scan(index, query, metric)):
        got = {r["id_chunk"]: (r["score"], r["frequencias_termos"]) for r in found.collect()}
        assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in expected.items()}
        assert all(got[k][0] == pytest.approx(expected[k][0], abs=1e-4) for k in expected)


def test_types(index):
    assert dict(search.search_index(index, "bolsa").dtypes)["score"] == "double"
    assert dict(search.search_index(index, "bolsa", "simples").dtypes)["score"] == "bigint"


def test_parameters(index):
    for k1, b in ((0.9, 0.4), (1.5, 0.0), (0.0, 0.75)):
        expected = plain(corpus(), "bolsa prazo", k1=k1, b=b)
        got = {r["id_chunk"]: r["score"] for r in search.search_index(index, "bolsa prazo", k1=k1, b=b).collect()}
        assert got == pytest.approx({k: v[0] for k, v in expected.items()}, abs=1e-4)
    for bad in (dict(k1=-1), dict(b=2), dict(metric="x"), dict(mode="x")):
        with pytest.raises(ValueError):
            search.search_index(index, "bolsa", **bad)
    with pytest.raises(ValueError):
        search.top_k(search.search_index(index, "bolsa"), -1)


def test_and_and_document(index):
    every = plain(corpus(), "bolsa ata")
    both = {k for k, v in every.items() if len(v[1]) == 2}
    assert {r["id_chunk"] for r in search.search_index(index, "bolsa ata", mode="and").collect()} == both
    assert search.search_index(index, "bolsa inexistente", mode="and").count() == 0
    own = {r["id_chunk"]: r["score"] for r in search.search_index(index, "bolsa ata", document="doc_3").collect()}
    docs = {row[0]: row[1] for row in corpus()}
    assert own == pytest.approx({k: v[0] for k, v in every.items() if docs[k] == "doc_3"}, abs=1e-4)


def test_order_is_by_string_id(spark):
    rows = spark.createDataFrame([("chunk_9999", 1.0), ("chunk_10000", 1.0), ("c3", 2.0)], "id_chunk string, score double")
    assert [r[0] for r in search.top_k(rows, 0).collect()] == ["c3", "chunk_10000", "chunk_9999"]
    assert [r[0] for r in search.top_k(rows, 1).collect()] == ["c3"]
    assert search.top_k(rows, 9).count() == 3
    assert search.top_k(rows.limit(0), 3).count() == 0


def test_idf_and_tf(spark):
    df = spark.createDataFrame([(100, 10), (0, 5), (100, 0)], "n int, df int")
    values = [r[0] for r in df.select(idf(F.col("n"), F.col("df"))).collect()]
    assert values == pytest.approx([math.log(1 + 90.5 / 10.5), 0.0, 0.0])
    goldens = {36: 1.6122, 3: 3.9567, 22: 2.096, 12: 2.6838, 17: 2.3473}
    got = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in goldens], "df int").select("df", F.round(idf(F.lit(182), F.col("df")), 4)).collect()}
    assert got == goldens
    tf = spark.createDataFrame([(1000, 200), (3, 100), (3, 200), (3, 400), (0, 5)], "tf int, dl int")
    w = [r[0] for r in tf.select(tf_weight(F.col("tf"), F.col("dl"), F.lit(200.0))).collect()]
    assert 2.45 < w[0] < 2.5 and w[1] > w[2] > w[3] and w[4] == 0


def test_batch_equals_single(spark, index):
    queries = {1: "bolsa ata", 2: "xis edital edital", 3: "nada"}
    rows = [(q, o, t) for q, text in queries.items() for o, t in enumerate(text.split())] + [(None, 0, "bolsa"), (4, 0, None)]
    asked = spark.createDataFrame(rows, "query_id int, ord int, term string").where("query_id is not null")
    got = {}
    for r in search.batch_search(index, asked, 5).collect():
        got.setdefault(r["query_id"], {})[r["posicao"]] = (r["id_chunk"], r["score"])
    for q, text in queries.items():
        alone = search.top_k(search.search_index(index, text), 5).collect()
        assert got.get(q, {}) == {i + 1: (r["id_chunk"], r["score"]) for i, r in enumerate(alone)}
    assert 4 not in got


@pytest.mark.parametrize("k", [1, 3, 10])
@pytest.mark.parametrize("metric", ["bm25", "simples"])
def test_pruning_loses_nothing(spark, k, metric):
    """Queries of rare and frequent terms over chunks of very uneven terms and many ties: the same as scoring everything."""
    r = random.Random(k)
    words = [f"t{i}" for i in range(30)]
    rows = [(f"c{i}", "d", "f", [1], i, " ".join(w for j, w in enumerate(words) for _ in range(r.choice([0, 0, 1, 2]) if r.random() < 2 / (j + 2) else 0))) for i in range(300)]
    made = Index.build(spark.createDataFrame(rows, SCHEMA))
    asked = spark.createDataFrame([(q, o, t) for q in range(60) for o, t in enumerate(r.sample([*words, "nada"], r.randint(1, 4)))], "query_id int, ord int, term string")
    everything: dict = {}
    for x in search.batch_scores(made, asked, metric).collect():
        everything.setdefault(x["query_id"], []).append((-x["score"], x["id_chunk"]))
    got: dict = {}
    for x in search.batch_search(made, asked, k, metric).orderBy("query_id", "posicao").collect():
        got.setdefault(x["query_id"], []).append((-x["score"], x["id_chunk"]))
    assert got == {q: sorted(found)[:k] for q, found in everything.items()}


def test_nested_blocks_are_bounded(spark):
    post = spark.range(20000).selectExpr("if(id % 4 = 0, concat('t', id % 97), 'quente') term", "format_string('c%05d', id) id_chunk", "1L tf")
    rows = nested(post, block=1000).collect()
    assert max(len(r["chunks"]) for r in rows) < 2000 and sum(len(r["chunks"]) for r in rows) == 20000
    hot = [x["id_chunk"] for r in sorted((r for r in rows if r["term"] == "quente"), key=lambda r: r["bloco"]) for x in r["chunks"]]
    assert hot == sorted(hot) and sum(r["frequencia"] for r in rows) == 20000


def test_battery(index):
    rows = search.battery(index, [("a", "bolsa prazo"), ("b", ""), ("c", "de o"), ("d", "inexistente")]).orderBy("query_id").collect()
    assert [r["vazio"] for r in rows] == [False, True, True, True]
    assert [r["aviso"] is None for r in rows] == [True, False, False, True]
    assert all(r["iguais"] for r in rows) and rows[0]["por_indice"] == rows[0]["por_varredura"] == len(plain(corpus(), "bolsa prazo"))


def test_restricted_and_orphans(spark, index):
    load = index.chunks.where("ordem_global % 2 = 1")
    part = index.restricted(load)
    expected = plain([r for r in corpus() if r[4] % 2 == 1], "bolsa ata")
    got = {r["id_chunk"]: r["score"] for r in search.search_index(part, "bolsa ata").collect()}
    assert got == pytest.approx({k: v[0] for k, v in expected.items()}, abs=1e-4)
    assert orphans(index.postings, index.chunks).count() == 0
    assert orphans(index.postings, load).count() + part.postings.count() == index.postings.count()


def test_empty_collection(spark):
    empty = Index.build(spark.createDataFrame([], SCHEMA))
    assert (empty.n, empty.mean_length) == (0, 0.0)
    assert search.search_index(empty, "bolsa").count() == search.search_scan(empty, "bolsa").count() == 0
    assert explore.hapax_share(empty.postings).first()["percentual"] == 0.0


def test_heat_and_profile(index):
    tf = {row[0]: Counter((row[5] or "").split())["bolsa"] for row in corpus()}
    heat = {r["id_chunk"]: (r["tf"], r["nivel"]) for r in explore.heat_chunks(index, "bolsa").collect()}
    assert heat == {k: (v, 0 if v == 0 else 1 if v == 1 else 2 if v == 2 else 3 if v <= 4 else 4) for k, v in tf.items()}
    profile = explore.term_profile(index, "bolsa").first()
    assert (profile["ocorrencias"], profile["pico"]) == (sum(tf.values()), max(tf.values()))
    assert profile["pico_chunk"] == min(k for k, v in tf.items() if v == profile["pico"])
    assert explore.term_profile(index, "inexistente").first()["ocorrencias"] == 0


def test_filters(index):
    assert explore.filter_chunks(index.chunks, "   ").count() == 60
    assert explore.filter_chunks(index.chunks, "F3.PDF").count() == sum(r[1] == "doc_3" for r in corpus())
    assert explore.page_count(index.chunks.limit(0), 15).first()["paginas"] == 1


@pytest.mark.parametrize("n", [0, 1, 2, 3, 75, 100])
def test_sort_counters(spark, n):
    r = random.Random(n)
    items = [(f"c{i}", float(r.randint(0, 9))) for i in range(n)]
    work = Counter()

    def halve(part, depth=1):
        work["chamadas"] += 1
        work["profundidade"] = max(work["profundidade"], depth)
        if len(part) <= 1:
            return part
        a, b = halve(part[: len(part) // 2], depth + 1), halve(part[len(part) // 2 :], depth + 1)
        out = []
        while a and b:
            work["score"] += 1
            work["id"] += a[0][1] == b[0][1]
            out.append((a if (-a[0][1], a[0][0]) <= (-b[0][1], b[0][0]) else b).pop(0))
        work["mov"] += len(out) + len(a) + len(b)
        return out + a + b

    halve(items)
    if n:
        rank = {x: k + 1 for k, x in enumerate(sorted(items, key=lambda x: (-x[1], x[0])))}
        df = spark.createDataFrame([(i, rank[x], x[1]) for i, x in enumerate(items)], "p int, r int, score double")
        got = analysis.sort_counters(df, n).first()
        assert (got["chamadas"], got["profundidade"], got["comparacoes_score"], got["comparacoes_id"], got["movimentacoes"]) == (
            work["chamadas"], work["profundidade"], work["score"], work["id"], work["mov"])
    closed = spark.range(n, n + 1).select(*analysis.sort_closed_forms(F.col("id"))).first()
    assert tuple(closed) == (work["chamadas"], work["profundidade"], work["mov"])


def test_published_exponents(spark):
    from garimpo.plans import queries

    got = {r["serie"]: r["expoente"] for r in queries.loglog_exponents(spark, "").collect()}
    assert got == {"merge_sort": 1.25, "sorted": 1.1493, "heapq": 0.9332, "comparacoes": 1.1864}
