"""Pieces: limits, overlap, cover, natural ends; greedy cuts one by one give the same."""

import random
import re

import pyarrow as pa
import pytest

from garimpo.functions import codepoints as cp
from garimpo.llm import split as sp

WORD = re.compile("[^" + "".join(map(chr, cp.WHITE_SPACE)) + "]+")


def pieces(texts, words, chars, overlap):
    out = {}
    for rows, columns in sp.split_column(pa.array(texts, pa.string()), words, chars, overlap):
        for row, *values in zip(rows.tolist(), *(c.to_pylist() for c in columns)):
            out.setdefault(row, []).append(values)
    return out


def texts(seed, n=150):
    r = random.Random(seed)
    made = ["".join(r.choice("abcé.ãx") * r.choice([1, 2, 5, 9, 30]) + r.choice([" ", " ", "  ", "\n", " \n", ", ", ". "]) for _ in range(r.randint(0, 700))) for _ in range(n)]
    return [*made, "", None, " " * 2500, "a" * 5000, "b" * 2000, "b" * 2001, "x " * 201, "x " * 200, "é" * 3000 + " z", "w" * 1999 + " " + "y" * 1500 + " " + "k " * 300, "é" * 1500]


@pytest.mark.parametrize(("words", "chars", "overlap"), [(200, 2000, 30), (50, 300, 10), (5, 20, 4), (7, 15, 0), (200, 100, 30), (1, 5, 0)])
def test_pieces(words, chars, overlap):
    rows = texts(words + chars)
    got = pieces(rows, words, chars, overlap)
    for i, text in enumerate(rows):
        spans = [m.span() for m in WORD.finditer(text or "")]
        over = text is not None and (len(spans) > words or len(text) > chars)
        assert over == (i in got)
        if not over:
            continue
        if not spans:
            assert got[i] == [[1, "", 0, 0, 0, 0]]
            continue
        long = any(b - a > chars for a, b in spans)
        before = 0
        for k, (order, piece, length, count, lo, hi) in enumerate(got[i]):
            assert order == k + 1 and length == len(piece) <= chars and 0 < count == hi - lo <= words
            if long:
                assert lo <= before <= hi
            else:
                assert piece == text[spans[lo][0] : spans[hi - 1][1]]
                assert lo == 0 if k == 0 else max(0, before - overlap) <= lo <= before < hi
                if k and before - lo < overlap:  # one word more of overlap would leave no room
                    start = lo - 1
                    assert spans[before][1] - spans[start][0] > chars or before + 1 - start > words
            before = hi
        assert before == len(spans)
        if long:
            assert re.sub(r"\s", "", text) == re.sub(r"\s", "", text) and "".join(p[1] for p in got[i]).count("z") == text.count("z")


def test_ends_at_a_sentence_where_there_is_one():
    text = "um dois três quatro. cinco seis, sete oito nove dez onze. doze treze quatorze"
    got = pieces([text], 8, 1000, 2)[0]
    assert got[0][1].endswith("quatro.") and got[1][1] == "três quatro. cinco seis, sete oito nove dez"[: len(got[1][1])]
    assert all(p[1][-1] in ".,e" for p in got)


def test_column(spark):
    chunk = "id_chunk string, id_documento string, paginas array<int>, inicio_palavra int, carregado_em int, texto string, peca int, versao int"
    long = " ".join(f"p{i}" for i in range(450))
    rows = [
        ("c1", "d1", [1], 100, 1, long, 0, 0), ("c1", "d1", [1], 100, 2, long, 0, 0), ("c1", "d1", [1], 100, 2, long, 0, 0), ("c2", "d1", [], None, 1, long, 0, 0),
        ("c3", "d9", None, 0, 1, long, 0, 0), ("c4", "d1", [1], 0, 1, "curto", 0, 0), (None, "d1", [1], 0, 1, long, 0, 0), ("c5", None, [4], 3, None, long, 0, 0), ("c6", "d1", [1], 0, 1, None, 0, 0),
    ]
    pages = [("d1", p, 1, " ".join(["w"] * 300)) for p in (1, 2, 3)] + [("d1", 2, 2, " ".join(["w"] * 100)), ("d1", 4, 1, None), (None, 1, 1, "x")]
    page_df = spark.createDataFrame(pages, "id_documento string, numero_pagina int, carregado_em int, texto_normalizado string")
    got = {}
    for r in sp.split_chunks(spark.createDataFrame(rows, chunk), page_df).orderBy("id_chunk", "peca").collect():
        got.setdefault(r["id_chunk"], []).append((r["inicio_palavra"], r["fim_palavra"], r["paginas"]))
    assert set(got) == {"c1", "c2", "c3", "c5"}
    assert got["c1"] == [(100, 300, [1]), (270, 470, [1, 2, 3]), (440, 550, [3])]
    assert [x[:2] for x in got["c2"]] == [(0, 200), (170, 370), (340, 450)] and got["c2"][2][2] == [2, 3]
    assert {x[2] for x in got["c3"]} == {None} and [x[2] for x in got["c5"]] == [[4]] * 3
    empty = spark.createDataFrame([], chunk)
    assert sp.split_chunks(empty, page_df).count() == sp.split_chunks(empty, page_df.limit(0)).count() == 0
    for bad in (dict(max_words=0), dict(overlap=200), dict(overlap=-1)):
        with pytest.raises(ValueError):
            sp.split_oversized(empty, "id_chunk", "texto", **bad)


def test_oversized_rows_count_whatever_comes_later(spark):
    chunk = "id_chunk string, id_documento string, paginas array<int>, inicio_palavra int, carregado_em int, texto string"
    long, longer = " ".join(f"p{i}" for i in range(250)), " ".join(f"q{i}" for i in range(260))
    rows = [("a", "d", [1], 0, 1, long), ("a", "d", [1], 0, 2, "curto"), ("b", "d", [1], 0, 1, "curto"), ("b", "d", [1], 0, 2, long), ("c", "d", [1], 0, 1, long), ("c", "d", [1], 0, None, longer), ("d", "d", [1], 0, 1, "curto")]
    got = sp.split_chunks(spark.createDataFrame(rows, chunk)).groupBy("id_chunk").agg({"fim_palavra": "max"})
    assert dict(map(tuple, got.collect())) == {"a": 250, "b": 250, "c": 250}


def test_agrees_with_sql(spark, data, duck):
    from garimpo.llm.queries import SQL, p3_found

    assert sorted(r[0] for r in p3_found(spark, data).collect()) == sorted(r[0] for r in duck.execute(SQL["p3_found"]).fetchall())
