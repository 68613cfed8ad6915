"""The consistent form against a character-by-character reading, and the pairs against all pairs."""

import itertools
import random
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from garimpo.functions import codepoints as cp
from garimpo.llm import lookalike as lk
from garimpo.llm import queries

SPACES = set(map(chr, cp.WHITE_SPACE))


def plain(text):
    if text is None:
        return None
    hidden = lk._expansions()[0] == 0
    seen = "".join(" " if c in SPACES else "" if hidden[ord(c)] else "".join(x for x in lk._spell(c) if not hidden[ord(x)]) for c in text)
    return " ".join(unicodedata.normalize("NFC", seen).split(" ")).strip(" ") if "  " not in (n := unicodedata.normalize("NFC", seen)) else " ".join(x for x in n.split(" ") if x)


def formed(texts):
    return lk.canonical_arrow(pa.array(texts, pa.string())).to_pylist()


def test_examples():
    same = [
        ("ação", "аçãо"), ("ação", "ação"), ("ABC 12", "ＡＢＣ　１２"), ("plano de", "pla​no\xa0de"), ("fim", "ﬁm"), ("III", "Ⅲ"),
        ("a b", " a \n\t b "), ("não", "na­̃o"), ("각", "각"), ("ấ", "ấ"), ("q̣̇", "q̣̇"),
    ]
    for a, b in same:
        assert formed([a]) == formed([b]), (a, b)
    for a, b in (("a", "A"), ("ação", "acao"), ("1", "2"), ("a.b", "a,b"), ("a b", "ab"), ("l", "1"), ("O", "0"), ("ª", "a"), ("𝔘", "U")):
        assert formed([a]) != formed([b]), (a, b)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cn"]), max_size=30), max_size=6))
def test_any_text(texts):
    assert formed(texts) == [plain(t) for t in texts]


def test_marks():
    r = random.Random(7)
    pool = [chr(i) for i in (*range(0x41, 0x5B), *range(0xC0, 0x180), *range(0x300, 0x345), *range(0x300, 0x345), 0x20, 0x200B, 0x9C7, 0x9BE, 0x1100, 0x1161, 0x11A8, 0xAC00, 0x430, 0xFF41)]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 25))) for _ in range(4000)] + [None, "", "́" * 300, "a" + "̣́" * 200]
    got = formed(texts)
    assert got == [plain(t) for t in texts]
    assert formed(got) == got  # forms stay as they are


def test_pairs(spark):
    r = random.Random(3)
    base = ["plano de ensino", "ata", "edital nº 5", "​", " "]
    def vary(t):
        return "".join({"a": "а", "e": "е", " ": "\xa0", "o": "ο"}.get(c, c) if r.random() < 0.3 else c for c in t)
    rows = [(f"k{i}", vary(r.choice(base)), i) for i in range(120)] + [("k0", "ata", 0), ("k0", "аta", 0), (None, "ata", 0), ("z1", None, 0), ("z2", "", 0)]
    df = spark.createDataFrame(rows, "chave string, texto string, forma int")
    got = [tuple(x) for x in lk.equal_looking_pairs(df, "chave", "texto").collect()]
    shown = [(k, t, plain(t)) for k, t, _ in rows if k is not None and t]
    expected = {(min(a[0], b[0]), max(a[0], b[0])) for a, b in itertools.combinations(shown, 2) if a[2] and a[2] == b[2] and a[1] != b[1] and a[0] != b[0]}
    assert len(got) == len(set(got)) and set(got) == expected
    assert lk.equal_looking_pairs(df.limit(0), "chave", "texto").count() == 0


def test_letters_of_other_alphabets():
    for a, b in (("Ү", "Y"), ("υ", "u"), ("γ", "y"), ("Ꭺ", "A"), ("ꓮ", "A"), ("𝐀𝑏𝖢𝟏", "AbC1"), ("к", "κ")):
        assert formed([a]) == formed([b]), (a, b)
    for a, b in (("Һ", "H"), ("к", "k"), ("𝔘", "U"), ("ℕ", "N"), ("π", "n")):
        assert formed([a]) != formed([b]), (a, b)


def test_only_changed_rows_are_worked_on(monkeypatch):
    worked = []
    monkeypatch.setattr(lk, "_expanded", lambda cps, off, lines, do=lk._expanded: worked.append(len(off) - 1) or do(cps, off, lines))
    texts = ["um\ndois", "", "três  quatro ", "ﬁm", "a", "e\u0301", "cinco"]
    assert formed(texts) == [plain(t) for t in texts] and worked == [2]
    assert formed(["um", "dois"]) == ["um", "dois"] and worked == [2]


def test_classes(spark):
    rows = [("k1", "ata"), ("k2", "аta"), ("k3", "аta"), ("k4", "outra"), ("k4", "outra"), ("k5", "ata"), ("k5", "аta"), ("k6", "fim"), (None, "ata"), ("k7", None)]
    df = spark.createDataFrame(rows, "chave string, texto string")
    got = sorted(tuple(r) for r in lk.membership(lk.classes(lk.looks([("t", df, "chave", "texto"), ("u", df.where("chave = 'k1'"), "chave", "texto")]))).collect())
    assert got == [("t", "k1", "k1", "k1", 2), ("t", "k2", "k1", "k2", 3), ("t", "k3", "k1", "k2", 3), ("t", "k5", "k1", "k1", 2), ("t", "k5", "k1", "k2", 3)]
    assert lk.membership(lk.classes(lk.looks([("t", df.limit(0), "chave", "texto")]))).count() == 0


def test_copies_cost_no_pairs(spark):
    """A third of the rows in one spelling meets only the few rows of another."""
    rows = [(f"k{i}", "mesmo texto") for i in range(3000)] + [("x", "mesmo texto")]
    assert lk.equal_looking_pairs(spark.createDataFrame(rows, "k string, t string"), "k", "t").count() == 3000


def test_forms_of_pages_and_chunks(spark, tmp_path):
    pages = [("d1", 1, "а\xa0 ção", 1), ("d1", 1, "ação", 2), ("d1", 2, None, 1), ("d2", None, "fim", 1)]
    spark.createDataFrame(pages, "id_documento string, numero_pagina int, texto_normalizado string, carregado_em int").write.parquet(f"{tmp_path}/pages_norm.parquet")
    spark.createDataFrame([("c1", "ﬁm ", 1), ("c2", "", 1)], "id_chunk string, texto string, carregado_em int").write.parquet(f"{tmp_path}/chunks.parquet")
    got = sorted((tuple(x) for x in queries.p2_forms(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(
        [
            ("pages_norm", "d1#1", 1, "a ção"), ("pages_norm", "d1#1", 2, "ação"), ("pages_norm", "d1#2", 1, None), ("pages_norm", None, 1, "fim"),
            ("chunks", "c1", 1, "fim"), ("chunks", "c2", 1, ""),
        ],
        key=str,
    )
