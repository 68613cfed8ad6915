"""Windows against a plain reading of their definition."""

import random
import re

import pytest
from pyspark.sql import functions as F

from garimpo.operators import chunking
from garimpo.operators.ordinals import global_ordinal, running_sum


def plain_windows(pages, size, overlap):
    """[(pages, first, end, text)] over [(number, text)]."""
    pages = [(n, t.strip()) for n, t in pages if t and t.strip()]
    text, words = "", []
    for number, page in sorted(pages):
        text += "\n\n" if text else ""
        words += [(m.start() + len(text), m.end() + len(text), number) for m in re.finditer(r"\S+", page)]
        text += page
    out, start = [], 0
    while start < len(words):
        end = min(start + size, len(words))
        part = words[start:end]
        out.append((sorted({w[2] for w in part}), start, end, text[part[0][0] : part[-1][1]]))
        if end == len(words):
            break
        start += size - overlap
    return out


@pytest.mark.parametrize(("n", "bounds"), [(0, []), (1, [(0, 1)]), (200, [(0, 200)]), (201, [(0, 200), (170, 201)]), (370, [(0, 200), (170, 370)]), (371, [(0, 200), (170, 370), (340, 371)])])
def test_bounds(spark, n, bounds):
    df = spark.createDataFrame([(1, " ".join(["x"] * n))], "d int, t string")
    rows = chunking.chunk_texts(df, "d", "t").orderBy("ordem_chunk_documento").collect()
    assert [(r["inicio_palavra"], r["fim_palavra"]) for r in rows] == bounds


@pytest.mark.parametrize(("size", "overlap"), [(7, 2), (5, 0), (3, 2), (40, 8)])
def test_pages(spark, size, overlap):
    r = random.Random(size)
    docs = {d: [(p, None if r.random() < 0.1 else "".join(r.choice(["ab", "é", "x.", " ", "  ", "\n"]) for _ in range(r.randint(0, 60)))) for p in range(1, r.randint(2, 9))] for d in range(30)}
    rows = [(d, p, t) for d, pages in docs.items() for p, t in pages]
    r.shuffle(rows)
    made = chunking.chunk_pages(spark.createDataFrame(rows, "d int, p int, t string"), "d", "p", "t", size, overlap)
    got = {}
    for row in made.orderBy("d", "ordem_chunk_documento").collect():
        got.setdefault(row["d"], []).append((row["paginas"], row["inicio_palavra"], row["fim_palavra"], row["texto"]))
    assert got == {d: w for d, pages in docs.items() if (w := plain_windows(pages, size, overlap))}


def test_single_equals_one_page(spark):
    df = spark.createDataFrame([(1, 1, " a  b\nc d e f "), (2, 1, None), (3, 1, "\t")], "d int, p int, t string")
    one = chunking.chunk_texts(df, "d", "t", 4, 1).select("inicio_palavra", "fim_palavra", "texto")
    assert sorted(one.collect()) == sorted(chunking.chunk_pages(df, "d", "p", "t", 4, 1).select("inicio_palavra", "fim_palavra", "texto").collect())


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (5, 5), (5, -1)])
def test_rejects(spark, size, overlap):
    with pytest.raises(ValueError):
        chunking.check_window(size, overlap)


def test_global_ids_pass_four_digits(spark):
    chunks = spark.range(3).select(F.format_string("d%d", "id").alias("d"), F.explode(F.sequence(F.lit(1), F.lit(4000))).alias("ordem_chunk_documento"))
    made = chunking.with_global_ids(chunks, "d").where("ordem_global in (1, 4001, 9999, 10000, 12000)").orderBy("ordem_global").collect()
    assert [(r["d"], r["id_chunk"]) for r in made] == [("d0", "chunk_0001"), ("d1", "chunk_4001"), ("d2", "chunk_9999"), ("d2", "chunk_10000"), ("d2", "chunk_12000")]


def test_ordinal_and_running_sum(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"), F.lit(2).alias("v"))
    assert global_ordinal(df, ["k"], "n").where("n != k + 1").count() == 0
    summed = running_sum(df, ["g"], "k", "v", F.floor(F.col("k") / 50))
    by = {}
    for row in summed.orderBy("g", "k").collect():
        assert row["antes"] == by.get(row["g"], 0)
        by[row["g"]] = row["ate"]
    assert global_ordinal(df.limit(0), ["k"], "n").count() == 0
