"""The best items of every group against a plain sort."""

import math
import random

import numpy as np
import pytest

from garimpo.llm import topn
from garimpo.llm.topn import band_edges, best_of_batch, top_n_per_group

SCHEMA = "g bigint, item string, s double, posicao int, __s int, __band int"


def rows():
    r = random.Random(9)
    made = [(1 if r.random() < 0.4 else r.randint(2, 60), f"c{r.randint(9990, 10020)}", r.choice([None, math.nan, -1.0, 0.0, *(x / 2 for x in range(1, 12))]), 1, 2, 3) for _ in range(3000)]
    return made + [(None, "c1", 5.0, 1, 2, 3), (99, None, 5.0, 1, 2, 3), (98, "só", 1.0, 1, 2, 3), (97, "x", -1.0, 1, 2, 3), (96, "x", math.inf, 1, 2, 3)]


def plain(n, positive=True):
    best: dict = {}
    for g, item, s, *_ in rows():
        if g is not None and item is not None and s is not None and not math.isnan(s) and (s > 0 or not positive):
            best.setdefault(g, {})[item] = max(s, best.get(g, {}).get(item, -math.inf))
    return {(g, k + 1, i, s) for g, items in best.items() for k, (i, s) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))[:n])}


@pytest.mark.parametrize("n", [1, 5, 40])
@pytest.mark.parametrize("shares", [(0.02, 0.08, 0.25, 0.6), (0.5,), ()])
@pytest.mark.parametrize("few", [0, 1000])
def test_top(spark, n, shares, few):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(6)
    got = [tuple(r) for r in top_n_per_group(df, "g", "item", "s", n, shares=shares, broadcast_groups=few).select("g", "posicao", "item", "s").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(n)


def test_best_of_batch():
    r = random.Random(4)
    g, i, s = (np.array([r.randint(0, k) for _ in range(500)]) for k in (6, 12, 9))
    for n in (1, 3, 100):
        best: dict = {}
        for x, y, z in zip(g.tolist(), i.tolist(), s.tolist()):
            best.setdefault(x, {})[y] = max(z, best.get(x, {}).get(y, -1))
        expected = {(x, y, z) for x, items in best.items() for y, z in sorted(items.items(), key=lambda t: (-t[1], t[0]))[:n]}
        kept = best_of_batch(g, i, s.astype(float), n)
        assert len(kept) == len(expected) and {(g[k], i[k], s[k]) for k in kept} == expected
    assert len(best_of_batch(g[:0], i[:0], s[:0].astype(float), 2)) == 0


def test_numbers_as_items(spark):
    df = spark.createDataFrame([("a", i % 9, float(i)) for i in range(40)] + [("b", 1, 1.0)], "g string, i int, s double")
    got = sorted(tuple(r) for r in top_n_per_group(df, "g", "i", "s", 2).select("g", "posicao", "i", "s").collect())
    assert got == [("a", 1, 3, 39.0), ("a", 2, 2, 38.0), ("b", 1, 1, 1.0)]


def test_state_is_not_shuffled(spark, monkeypatch):
    """Each band moves its own rows once; what the groups have stays where it is."""
    plans = []
    written = topn.bucketed

    def seen(df, *rest):
        plans.append(df._jdf.queryExecution().toString())
        return written(df, *rest)

    monkeypatch.setattr(topn, "bucketed", seen)
    top_n_per_group(spark.createDataFrame(rows(), SCHEMA), "g", "item", "s", 3, shares=(0.2, 0.5), broadcast_groups=0).count()
    assert [p.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") for p in plans] == [1, 0, 1, 0, 1]


def test_all_scores(spark):
    got = {tuple(r) for r in top_n_per_group(spark.createDataFrame(rows(), SCHEMA), "g", "item", "s", 3, only_positive=False).collect()}
    assert got == plain(3, False)


def test_one_score_and_empty(spark):
    df = spark.createDataFrame([(1, f"c{i}", 2.0, 0, 0, 0) for i in range(50)], SCHEMA)
    assert sorted(r["item"] for r in top_n_per_group(df, "g", "item", "s", 3).collect()) == sorted(f"c{i}" for i in range(50))[:3]
    assert top_n_per_group(df.limit(0), "g", "item", "s", 3).count() == 0
    assert band_edges(df.limit(0), "s") == []
    with pytest.raises(ValueError):
        top_n_per_group(df, "g", "item", "s", 0)


def test_agrees_with_sql(spark, data, duck):
    from compare import duck_rows, spark_rows
    from garimpo.llm.queries import SQL, p5_found

    assert spark_rows(p5_found(spark, data)) == duck_rows(duck, SQL["p5_found"])
