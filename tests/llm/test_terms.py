"""Term counts against a plain count; radix splits change nothing."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from garimpo.functions import codepoints as cp
from garimpo.functions import hashing as hs
from garimpo.functions import folding
from garimpo.llm import terms as tm
from garimpo.operators.latest import latest_rows
from garimpo.workdir import materialize

SCHEMA = "id_chunk string, carregado_em int, texto string, id_carga string, term int"


def terms_of(text):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFC", text).casefold())


def rows():
    r = random.Random(2)
    words = ["Ata", "ATA", "straße", "STRASSE", "ﬁm", "12ª", "a_b", "é", "é", "x" * 300, *(f"t{i}" for i in range(400))]
    made = [(f"c{i}", 1, " ".join(["sempre", *(r.choice(words) for _ in range(r.randint(0, 40)))]), f"l{i % 3}", 0) for i in range(200)]
    return made + [("c0", 2, "novo texto novo", "l0", 0), ("c1", None, "nunca", "l1", 0), ("c2", 5, None, "l2", 0), (None, 1, "nada", "l0", 0), ("c3", *made[3][1:]), ("z", 1, "", "l9", 0), ("y", 1, "outro", None, 0)]


def plain():
    latest = {}
    for key, when, text, load, _ in rows():
        if key is not None and text is not None:
            order = (when is not None, when or 0, text)
            if key not in latest or order > latest[key][0]:
                latest[key] = (order, text, load)
    chunks, times = Counter(), Counter()
    for _, text, _ in latest.values():
        chunks.update(set(terms_of(text)))
        times.update(terms_of(text))
    return {t: (chunks[t], times[t]) for t in times}, len(latest), latest


@pytest.mark.parametrize("limit", [1 << 30, 2000])
def test_counts(spark, limit):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = {r["term"]: (r["chunks"], r["ocorrencias"]) for r in tm.term_frequencies(df, limit=limit).collect()}
    expected, n, _ = plain()
    assert got == expected and tm.chunk_total(df) == n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(st.one_of(st.sampled_from("aAéßﬁİſ ́._1ªΣ가ㅏ"), st.characters(codec="utf-8", exclude_categories=["Cn"])), max_size=30), st.integers(0, 1)), max_size=6))
def test_terms_of_any_text(texts):
    expected: dict = {}
    for text, g in texts:
        for term, n in Counter(terms_of(text)).items():
            c, o = expected.get((g, term), (0, 0))
            expected[g, term] = (c + 1, o + n)
    got: dict = {}
    group = np.array([g for _, g in texts], np.int64)
    for at, t in cp.spans(pa.array([x for x, _ in texts], pa.string())):
        found = folding.count_terms(t, group[at : at + t.rows])
        got = {(int(g), term): (int(c), int(o)) for term, g, c, o in zip(found.text.to_pylist(), found.group, found.rows, found.times)}
    assert got == expected


def test_one_hash_for_all_terms(monkeypatch):
    monkeypatch.setattr(folding.hs.Prefix, "spans", lambda self, a, b: np.full(len(a), 7, np.uint64))
    t = next(cp.spans(pa.array(["um dois um", "dois três"])))[1]
    found = folding.count_terms(t, np.zeros(2, np.int64))
    assert dict(zip(found.text.to_pylist(), zip(found.rows.tolist(), found.times.tolist()))) == {"um": (1, 2), "dois": (2, 2), "três": (1, 1)}


def jobs_of(spark, work):
    """Number of Spark jobs that ``work`` starts."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    out = work()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    return jobs, out


def test_splits_oversized_partitions(spark):
    counts = spark.sql("select cast(null as string) grupo, concat('termo', id div 2) term, 1L chunks, id ocorrencias from range(40000)")
    whole, split = tm.radix_partitions(counts, 1 << 30), tm.radix_partitions(counts, 60_000, first=1, bits=2)
    assert len(whole) == 16 and len(split) > 4 and any("radix3" in p for p in split)
    for paths in (whole, split):
        got = tm.aggregate_partitions(spark, paths)
        assert got.count() == 20000 and got.where("chunks != 2 or ocorrencias != 4 * cast(substr(term, 6) as bigint) + 1").count() == 0


def test_jobs_grow_with_levels_only(spark):
    counts = spark.sql("select cast(null as string) grupo, concat('termo', id) term, 1L chunks, id ocorrencias from range(60000)")
    one, few = jobs_of(spark, lambda: tm.radix_partitions(counts, 1 << 30))
    two, many = jobs_of(spark, lambda: tm.radix_partitions(counts, 30_000))
    assert len(few) == 16 and len(many) > 200 and two <= one + 6
    assert tm.first_bits(0) == 4 and tm.first_bits(100 << 40) == 12 and tm.first_bits(10 << 30) == 8


def test_one_term_is_not_split_for_ever(spark):
    counts = spark.sql("select cast(null as string) grupo, 'de' term, 1L chunks, id ocorrencias from range(40000)")
    paths = tm.radix_partitions(counts, 1000)
    assert len(paths) == 1 and tm.aggregate_partitions(spark, paths).first()["chunks"] == 40000


def test_spills_beside_the_partition_or_with_spark():
    assert tm._spill_folder("/shared/x", True) == "/shared/x/_spill"
    assert tm._spill_folder("/shared/x", False).endswith("/_spill") and not tm._spill_folder("/shared/x", False).startswith("/shared")


def test_groups(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {(r["id_carga"], r["term"]): (r["chunks"], r["ocorrencias"]) for r in tm.term_frequencies(df, group="id_carga").collect()}
    expected: dict = {}
    for _, text, load in plain()[2].values():
        for t, n in Counter(terms_of(text)).items():
            c, o = expected.get((load, t), (0, 0))
            expected[load, t] = (c + 1, o + n)
    assert got == expected


def test_marks(spark):
    df = spark.createDataFrame([("a", 1, 9), ("b", 2, 2), ("c", 3, 3), ("d", 50, 60), ("e", 51, 51)], "term string, chunks bigint, ocorrencias bigint")
    got = {r["term"]: r["marca"] for r in tm.mark_terms(df, 100).collect()}
    assert got == {"a": "rara", "b": "rara", "c": None, "d": None, "e": "comum"}
    assert {r["marca"] for r in tm.mark_terms(df.limit(2), 2).collect()} == {"rara"}


def test_empty(spark):
    assert tm.term_frequencies(spark.createDataFrame([], SCHEMA)).count() == 0
    assert tm.term_frequencies(spark.createDataFrame([("a", 1, None, "l", 0), ("b", 1, "...", "l", 0)], SCHEMA)).count() == 0


@pytest.mark.parametrize("bound", [0, 10])
def test_latest_rows(spark, bound):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), ("b", None, "z"), ("c", 3, "w"), (None, 1, "n"), (None, 2, "m")], "k string, w int, t string")
    assert sorted((r["t"] for r in latest_rows(materialize(df), ["k"], "w", broadcast_keys=bound).where("k is not null").collect())) == ["w", "y", "z"]


def test_agrees_with_sql(spark, data, duck):
    from compare import duck_rows, spark_rows
    from garimpo.llm.queries import QUERIES, SQL

    for name in ("p1_counts", "p3_limits", "p4_found", "p4_terms", "p4_loads", "p7_limits"):
        assert spark_rows(QUERIES[name](spark, data)) == duck_rows(duck, SQL[name])
