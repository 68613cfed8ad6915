"""Prose against lists, tables and junk; pages for search engines against honest ones."""

import random

import numpy as np
import pyarrow as pa
import pytest

from garimpo.functions import codepoints as cp
from garimpo.functions import hashing as hs
from garimpo.llm import languages as lg
from garimpo.llm import profile as pf
from garimpo.llm import quality, spam
from garimpo.llm import wordtable as wt

_R = random.Random(1)
WORDS = ["".join(_R.choice(["tra", "me", "lor", "pi", "sen", "du", "ca", "vi", "gos", "bel"]) for _ in range(_R.randint(2, 4))) for _ in range(700)]


class Pool:
    """Phrases with words of their own, so that prose doesn't repeat itself."""

    def __init__(self, *patterns):
        self.patterns = patterns

    def pick(self, r):
        return r.choice(self.patterns).format(*(r.choice(WORDS) for _ in range(3)))


SUBJECTS = Pool("a {0} de {1}", "o {0} do {1}", "a {0}", "o {0} {1}", "a {0} da {1} e do {2}")
VERBS = Pool("deverá {0}", "poderá {0} e {1}", "compromete-se a {0}", "terá de {0}", "não poderá {0}")
OBJECTS = Pool("o {0} {1}", "os {0} de {1}", "a {0} da {1}", "o {0} de {1} com a {2}", "as {0} dos {1}")
ENDS = Pool("no prazo de {0}", "sem {0} das demais {1}", "com {0} em {1}", "por {0}", "na forma do {0} e para a {1}")
NAMES = ["Bilva", "Trosco", "Menlur", "Quasto", "Verdin", "Solpra", "Catelo", "Druvan"]


def prose(r, n=14):
    made = [f"{SUBJECTS.pick(r).capitalize()} {VERBS.pick(r)} {OBJECTS.pick(r)} {ENDS.pick(r)}." for _ in range(n)]
    return "\n".join(" ".join(made[i : i + 3]) for i in range(0, n, 3))


def articles(r, n=14):
    return "\n".join(f"Art. {i + 1}º {SUBJECTS.pick(r).capitalize()} {VERBS.pick(r)} {OBJECTS.pick(r)} {ENDS.pick(r)}." for i in range(n))


def table(r, n=25):
    return "\n".join(f"{r.choice(NAMES)}{r.choice([' | ', '  '])}{r.randint(1, 4000)}{r.choice([' | ', '  '])}{r.randint(1, 28)}/0{r.randint(1, 9)}/2020  {r.randint(0, 99)},50" for _ in range(n))


def listing(r, n=30):
    return "\n".join(f"{i + 1}. {r.choice(NAMES)} {r.choice(NAMES)} {r.choice(NAMES)}" for i in range(n))


def shuffled(r, n=14):
    words = prose(r, n).split()
    r.shuffle(words)
    return "\n".join(" ".join(words[i : i + 14]) for i in range(0, len(words), 14))


def coded(r, n=30):
    return "\n".join(" ".join("".join(r.choice("0123456789abcdef") for _ in range(8)) for _ in range(8)) for _ in range(n))


def repeated(r, n=25):
    return "\n".join([prose(r, 1)] * n)


def wide(text):
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text)


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(11)
    kinds = {"prosa": prose, "artigos": articles, "tabela": table, "lista": listing, "embaralhada": shuffled, "codigo": coded, "repetida": repeated}
    rows = []
    for i in range(420):
        kind = r.choice(["prosa"] * 8 + ["artigos"] * 4 + list(kinds))
        for page in range(1, 4):
            rows.append((f"{kind}_{i}", page, kinds[kind](r), 1, "x"))
    rows += [("prosa_larga", 1, wide(prose(r)), 1, "x"), ("prosa_caixa", 1, prose(r).upper(), 1, "x"), ("vazio", 1, "", 1, "x"), ("vazio", 2, None, 1, "x"), ("branco", 1, " \n ", 1, "x")]
    rows += [("prosa_corrigida", 1, table(r), 1, "x"), ("prosa_corrigida", 1, prose(r), 2, "x"), (None, 1, table(r), 1, "x"), ("prosa_dupla", 1, prose(r), 1, "x")] + [("prosa_dupla", 1, prose(r), 3, "x")] * 2
    return spark.createDataFrame(rows, "id_documento string, numero_pagina int, texto_normalizado string, carregado_em int, palavras string").repartition(4)


def test_documents(pages):
    got = {r["id_documento"]: r for r in quality.document_quality(pages).collect()}
    assert not {"vazio", "branco", None} & set(got)
    wrong = [d for d, r in got.items() if r["caso"] == d.startswith(("prosa", "artigos"))]
    assert len(wrong) <= 0.02 * len(got), wrong
    for row in list(got.values())[:50]:
        parts = sum(row[f"contribuicao_{n}"] for n in quality.NAMES)
        assert parts == pytest.approx(row["distancia"], rel=1e-6) and row["palavras_fora"] <= row["palavras"]


def test_documents_empty(pages):
    assert quality.document_quality(pages.limit(0)).count() == 0
    assert quality.document_quality(pages.where("id_documento in ('vazio', 'branco')")).count() == 0
    assert quality.document_quality(pages.where("id_documento = 'prosa_larga'")).count() == 1


def test_statistics_of_every_document(spark, pages):
    report = spark.createDataFrame([("vazio",), ("so_relatorio",), ("so_relatorio",), (None,)], "id_documento string")
    r = random.Random(13)
    long, rows = table(r, 60), []
    rows += [("c1", "prosa_larga", "um  dois\ntrês", 1), ("c1", "prosa_larga", "um dois", 2), ("c2", "prosa_larga", "​ é", 1), ("c3", "prosa_larga", None, 1), (None, "prosa_larga", "x", 1)]
    rows += [("c4", "so_chunks", long, 1), ("c5", "so_chunks", long, 1), ("c6", "so_nulos", None, 1), ("c7", "vazio", " ", 1)]
    chunks = spark.createDataFrame(rows, "id_chunk string, id_documento string, texto string, carregado_em int")
    whole = pages.unionByName(spark.createDataFrame([("contado", 1, "Uma casa.\nDuas 22", 1, "x")], pages.schema))
    listed = quality.document_statistics(whole, chunks, report).collect()
    got = {d["id_documento"]: d for d in listed}
    plain = {d["id_documento"]: d for d in quality.document_quality(whole).collect()}
    assert len(listed) == len(got) and set(got) == set(plain) | {"vazio", "branco", "so_relatorio", "so_chunks", "so_nulos"}
    assert all(got[d][c] == row[c] for d, row in plain.items() for c in ("palavras", "palavras_fora", "caso"))

    def sizes(d):
        return tuple(got[d][f"quantidade_{n}"] for n in ("chunks", "palavras", "caracteres"))

    assert sizes("prosa_larga") == (2, 4, 10) and sizes("vazio") == (1, 0, 1) and sizes("so_chunks") == (2, 2 * len(long.split()), 2 * len(long))
    assert sizes("branco") == sizes("so_relatorio") == sizes("so_nulos") == (0, 0, 0)
    for d in ("vazio", "branco", "so_relatorio", "so_nulos"):
        assert got[d]["palavras"] == 0 and got[d]["caso"] is False and got[d]["media_simbolos"] is None and got[d]["distancia"] is None
    assert got["so_chunks"]["caso"] and got["so_chunks"]["palavras"] == 2 * len(long.split())
    counted = got["contado"]
    assert counted["palavras"] == 4 and counted["media_numericas"] == 0.25 and counted["media_fim_frase"] == 0.25 and counted["media_funcionais"] == 0.25
    assert counted["media_comprimento"] * 20 == pytest.approx((3 + 4 + 4 + 0) / 4, abs=1e-4)
    none = quality.document_statistics(pages.limit(0), chunks, report).collect()
    assert {d["id_documento"] for d in none} == {"prosa_larga", "so_chunks", "so_nulos", "vazio", "so_relatorio"}
    assert quality.document_statistics(pages.limit(0), chunks.limit(0), report.limit(0)).count() == 0


KEYS = ["tcc pronto", "diploma rápido", "curso grátis", "vaga remota", "seguro viagem"]
MODIFIERS = ["promoção", "barato", "download", "2025", "perto de mim", "melhor preço"]


def stuffed(r):
    return " ".join(f"{r.choice(KEYS)} {r.choice(MODIFIERS)}" for _ in range(60))


def sentences(r):
    k = r.choice(KEYS)
    return "\n".join(f"Procurando {k}? Temos {k} {r.choice(MODIFIERS)} para quem precisa de {k}! Compre {k}, peça {k} e receba {k} em casa." for _ in range(8))


def links(r):
    return "\n".join(f'<a href="http://{r.choice(NAMES).lower()}{r.randint(1, 99)}.test/{r.randint(1, 999)}">{r.choice(KEYS)} {r.choice(MODIFIERS)}</a>' for _ in range(25))


def tags(r):
    return " ".join("#" + r.choice(KEYS).replace(" ", "") + str(r.randint(1, 9)) for _ in range(50))


def products(r):
    return "\n".join(f"{r.choice(KEYS)} {r.choice(MODIFIERS)} - ref {r.randint(1000, 99999)} | R$ {r.randint(10, 900)},90 frete grátis" for _ in range(25))


def linked_prose(r):
    return " ".join(f"{line} Ver https://portal.univ.example/{r.choice(NAMES).lower()}." for line in prose(r, 12).replace("\n", " ").split(". "))


@pytest.fixture(scope="module")
def documents(spark):
    r = random.Random(12)
    bad, good = [stuffed, sentences, links, tags, products], [prose, prose, prose, articles, linked_prose, table, listing, coded, shuffled]
    rows = [(i, r.choice(bad)(r) if i % 10 == 0 else r.choice(good)(r), 1.0, "x") for i in range(900)]
    rows += [(i + 1000, prose(r, 2) + "\n" + r.choice(bad)(r), 1.0, "x") for i in range(0, 50, 10)]
    rows += [(2001, prose(r, 20) + "\n#edital #bolsas", 1.0, "x"), (2002, None, 1.0, "x"), (2003, "", 1.0, "x"), (2004, " \n", 1.0, "x"), (None, stuffed(r), 1.0, "x"), (0, rows[0][1], 1.0, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, parte double, perfil string").repartition(4)


def test_spam(documents):
    rows = spam.spam_shares(documents).collect()
    assert len(rows) == documents.count()
    wrong = [r["doc_id"] for r in rows if r["doc_id"] is not None and r["caso"] != (r["doc_id"] % 10 == 0 and r["doc_id"] < 2000)]
    assert len(wrong) <= 0.01 * len(rows), wrong
    assert all(0 <= r["parte"] <= 1 + 1e-9 for r in rows)
    assert [r["palavras"] for r in rows if r["doc_id"] in (2002, 2003, 2004)] == [0, 0, 0]


def test_spam_empty(documents):
    assert spam.spam_shares(documents.limit(0)).count() == 0
    assert spam.spam_shares(documents.where("doc_id > 2001")).where("caso").count() == 0


def test_word_table():
    text = ["O Plano, ｄｅ 12ª x.\nA​ção «fim» --", "", "  \n", "dois textos", None]
    w = wt.word_table(next(cp.spans(pa.array(text)))[1])
    assert ["".join(map(chr, w.cps[a:b])) for a, b in zip(w.start, w.end)] == ["O", "Plano,", "de", "12ª", "x.", "Ação", "«fim»", "--", "dois", "textos"]
    assert w.row.tolist() == [0] * 8 + [3] * 2 and w.line.tolist()[:8] == [0] * 5 + [1] * 3 and w.line[8] > w.line[7]
    assert w.core.tolist()[1] == wt.hash_word("plano") and w.core.tolist()[5] == wt.hash_word("ação") and w.core[7] == 0
    assert w.sizes.tolist() == [8, 0, 0, 2, 0] and [bool(x & wt.SENTENCE) for x in w.last.tolist()] == [False] * 4 + [True] + [False] * 5
    assert w.digits.tolist()[3] == 2 and w.capital.tolist()[:2] == [True, True]


def test_profiles_do_not_depend_on_batches():
    r = random.Random(5)
    texts = [prose(r), None, table(r), "", "uma", links(r), shuffled(r)] * 3
    for plan in (quality.PLAN, spam.PLAN):
        whole = pf.profile_arrays(pa.array(texts), plan, True, True)
        for size in (1, 4):
            parts = [pf.profile_arrays(pa.array(texts[i : i + size], pa.string()), plan, True, True) for i in range(0, len(texts), size)]
            for k in range(5):
                assert pa.concat_arrays([p[k] for p in parts]).to_pylist() == whole[k].to_pylist()


def test_very_long_text():
    r = random.Random(6)
    text = "\n".join(prose(r, 30) for _ in range(300))
    col = pa.array([text, "x" * 200_000])
    language, words, blob, classes = pf.profile_arrays(col, quality.PLAN)
    assert words.to_pylist() == [len(text.split()), 1] and len(classes[0].as_py()) == words[0].as_py()
    w = wt.word_table(next(cp.spans(col.slice(1)))[1])
    assert w.letters.tolist() == [200_000] and w.core[0] == wt.hash_word("x" * 200_000) != wt.hash_word("x" * 199_999 + "y")
    row, cells = pf.tables_of(pf.profile_arrays(col, spam.PLAN, False)[2], spam.WIDTH)
    assert pf.characters(cells)[row == 1].tolist() == [200_000]


def test_hashes_of_spans():
    r = random.Random(8)
    numbers = hs.mix(np.array([r.randint(0, 5) for _ in range(300)]))
    prefix = hs.Prefix(numbers)
    start = np.array([r.randint(0, 290) for _ in range(4000)])
    end = np.minimum(start + np.array([r.randint(0, 4) for _ in range(4000)]), 300)
    seen: dict = {}
    for a, b, key in zip(start, end, prefix.spans(start, end).tolist()):
        assert seen.setdefault(tuple(numbers[a:b].tolist()), key) == key
    assert len(set(seen.values())) == len(seen) and seen[()] == 0


def test_places_by_key():
    r = random.Random(9)
    key = hs.mix(np.array([r.randint(0, 40) for _ in range(500)]))
    usable = np.array([r.random() < 0.8 for _ in range(500)])
    got = hs.together(key, usable)
    used = [k for k, u in zip(key.tolist(), usable) if u]
    assert got.times(500).tolist() == [used.count(k) if u else 0 for k, u in zip(key.tolist(), usable)]
    near = [bool(u and any(i != j and usable[j] and key[j] == key[i] for j in range(max(i - 3, 0), min(i + 4, 500)))) for i, u in enumerate(usable)]
    assert got.near(500, 3).tolist() == near
    assert hs.together(key[:0], usable[:0]).times(0).tolist() == []


def keyword_cycle(r, n=30, times=50):
    return "\n".join([" ".join(r.sample(WORDS, n))] * times)


def keyword_line(r, n=30, times=50):
    return keyword_cycle(r, n, times).replace("\n", " ")


def keyword_shuffles(r, n=40, times=40):
    words = r.sample(WORDS, n)
    return " ".join(w for _ in range(times) for w in r.sample(words, n))


def far_sentences(r, n=12):
    """Sentences of 25 words and more that hold each keyword once, in other words and order each time."""
    keys, made = ["tcc pronto", "diploma rápido", "curso grátis", "vaga remota", "seguro viagem"], []
    for _ in range(n):
        k = r.sample(keys, 5)
        made.append(f"Com {k[0]} e {k[1]} para a sua {r.choice(WORDS)}, o {k[2]} da {r.choice(WORDS)} será com o {k[3]} ou por {k[4]}, sem a {r.choice(WORDS)} de quem o {r.choice(WORDS)}.")
    return " ".join(made)


def subject_prose(r):
    return "\n".join(f"A bolsa de estudo {VERBS.pick(r)} {OBJECTS.pick(r)} {ENDS.pick(r)}. {prose(r, 2)}" for _ in range(8))


def headed_table(r):
    return "\n".join(f"Nome Curso Nota Situação\n{table(r, 6)}" for _ in range(6))


def passage_again(r):
    return "\n".join([prose(r, 4)] * 12)


def test_spam_over_the_whole_text(spark, documents):
    r = random.Random(14)
    bad, good = [keyword_cycle, keyword_line, keyword_shuffles, far_sentences], [subject_prose, headed_table, passage_again]
    rows = [(3000 + 10 * i + k, make(r), 1.0, make.__name__) for i in range(5) for k, make in enumerate(bad + good)]
    got = {x["doc_id"]: x["caso"] for x in spam.spam_shares(documents.unionByName(spark.createDataFrame(rows, documents.schema))).collect()}
    assert [(i, name) for i, _, _, name in rows if got[i] != (name in {f.__name__ for f in bad})] == []


def test_top_shares_of_rows():
    line = "alfa beta gama delta"
    texts = ["\n".join([line] * 3 + ["outra linha bem diferente"]), "\n".join([line] * 2), line, " ".join(["raiz"] * 4 + WORDS[:200]), " ".join(["raiz"] * 6 + WORDS[:200])]
    x = pf.Text(next(cp.spans(pa.array(texts)))[1])
    values = spam.values(x)
    of = [x.w.row == k for k in range(5)]
    assert [int(values["linhas_iguais"][k].sum()) for k in of] == [12, 0, 0, 0, 0]
    assert [int(values["frequentes"][k].sum()) for k in of] == [0, 0, 0, 0, 6]
    assert [int(values["recorrentes"][k].sum()) for k in of] == [0, 0, 0, 4, 6]


def test_prices():
    x = pf.Text(next(cp.spans(pa.array(["Por R$ 754,90 ou US$20 e 30 € ou R$ só, ¢ £xito £ 5"])))[1])
    price = spam.values(x)["precos"]
    assert ["".join(map(chr, x.w.cps[a:b])) for a, b in zip(x.w.start[price], x.w.end[price])] == ["R$", "US$20", "€", "£"]


# Running text in languages of the lists, in others, and in the second person.
TONGUES = {
    "en": "You should know that we were there when they came home. If you want to see what we have done, come with us and ask them where it is. They said you could stay, but we never knew why you would. Your friends were with us, and they told me that you were very happy.",
    "de": "Der Antrag muss bis zum Ende des Monats bei der zuständigen Stelle eingereicht werden. Wer die Frist versäumt, kann einen neuen Antrag erst im folgenden Semester stellen. Die Kommission prüft alle Unterlagen und teilt das Ergebnis schriftlich mit. Gegen die Entscheidung kann innerhalb von vier Wochen Widerspruch eingelegt werden.",
    "it": "La domanda deve essere presentata entro la fine del mese presso l'ufficio competente. Chi non rispetta il termine può presentare una nuova domanda soltanto nel semestre successivo. La commissione esamina tutti i documenti e comunica il risultato per iscritto. Contro la decisione è possibile fare ricorso entro quattro settimane.",
    "nl": "De aanvraag moet voor het einde van de maand bij de bevoegde instantie worden ingediend. Wie zich niet aan de termijn houdt, kan pas in het volgende semester een nieuwe aanvraag doen. De commissie onderzoekt alle stukken en deelt de uitslag schriftelijk mee.",
    "fi": "Hakemus on toimitettava kuukauden loppuun mennessä toimivaltaiselle virastolle. Se, joka ei noudata määräaikaa, voi jättää uuden hakemuksen vasta seuraavalla lukukaudella. Lautakunta tutkii kaikki asiakirjat ja ilmoittaa tuloksesta kirjallisesti. Päätökseen voi hakea muutosta neljän viikon kuluessa.",
    "ru": "Заявление должно быть подано до конца месяца в компетентный орган. Тот, кто не соблюдает срок, может подать новое заявление только в следующем семестре. Комиссия рассматривает все документы и сообщает результат в письменном виде. Решение можно обжаловать в течение четырёх недель.",
    "tr": "Başvuru ay sonuna kadar yetkili makama yapılmalıdır. Süreye uymayan kişi ancak bir sonraki dönemde yeni bir başvuru yapabilir. Komisyon bütün belgeleri inceler ve sonucu yazılı olarak bildirir. Karara karşı dört hafta içinde itiraz edilebilir.",
}


def test_languages():
    x = pf.Text(next(cp.spans(pa.array([*TONGUES.values(), "bolsa edital prova nota", ""])))[1])
    assert [lg.LANGUAGES[k] if k < lg.OTHER else None for k in x.language] == ["en", "de", "it", "nl", *[None] * 5]
    assert (x.own[x.w.row == 8] == -1).all() and (x.own[x.w.row == 0] >= 0).mean() > 0.4
    assert all(len(lg.words_of(k)) < 300 for k in lg.LANGUAGES)


def test_prose_of_any_language(spark, pages, documents):
    rows = [(f"prosa_{k}", 1, t, 1, "x") for k, t in TONGUES.items()]
    got = {r["id_documento"]: r["caso"] for r in quality.document_quality(pages.unionByName(spark.createDataFrame(rows, pages.schema))).collect()}
    assert [k for k in TONGUES if got[f"prosa_{k}"]] == []
    rows = [(5000 + i, t, 1.0, k) for i, (k, t) in enumerate(TONGUES.items())]
    spam_of = {r["doc_id"]: r["caso"] for r in spam.spam_shares(documents.unionByName(spark.createDataFrame(rows, documents.schema))).collect()}
    assert not any(spam_of[5000 + i] for i in range(len(TONGUES)))


def test_latest_page_counts_even_if_blank(spark, pages):
    r = random.Random(21)
    rows = [("apagada", 1, table(r), 1, "x"), ("apagada", 1, " \u00a0", 2, "x"), ("trocada", 1, table(r), 1, "x"), ("trocada", 1, prose(r), 2, "x")]
    got = {x["id_documento"]: x["caso"] for x in quality.document_quality(pages.unionByName(spark.createDataFrame(rows, pages.schema))).collect()}
    assert "apagada" not in got and got["trocada"] is False


HELD_OUT = {
    "en": ("cheap essay,essay writer,buy essay,free download,best price,casino bonus,online pharmacy,weight loss,credit repair,used cars".split(","), "the of and for with in our to"),
    "es": ("ensayo barato,curso online,descarga gratis,mejor precio,casino bono,farmacia online,coche usado,seguro viaje,hotel barato,crédito rápido".split(","), "el la de para con en por los"),
    "de": ("billige arbeit,online kurs,gratis download,bester preis,casino bonus,apotheke online,auto gebraucht,hotel günstig,kredit sofort,versicherung reise".split(","), "der die und für mit in den von"),
}


def held_out(r, spam_page):
    """Pages made by other rules than those of the rest of this module: their number of keywords, cycle, line form and language vary."""
    keys, small = HELD_OUT[r.choice(sorted(HELD_OUT))]
    small = small.split()
    n = r.randint(3, 10)
    some = r.sample(keys, n)
    if not spam_page:
        kind = r.randint(0, 3)
        if kind == 0:  # prose in which a subject returns
            subject = r.choice(keys)
            return " ".join(f"{r.choice(small).capitalize()} {' '.join(r.choice([r.choice(small), r.choice(WORDS)]) for _ in range(12))} {r.choice(small)} {subject} {r.choice(small)} {r.choice(WORDS)}." for _ in range(20))
        if kind == 1:  # contents
            return "\n".join(f"{i + 1}. {' '.join(r.choice(WORDS).capitalize() for _ in range(3))} {r.randint(1, 300)}" for i in range(30))
        if kind == 2:  # references
            return "\n".join(f"{r.choice(NAMES).upper()}, {chr(65 + i % 26)}. {' '.join(r.choice(WORDS) for _ in range(5)).capitalize()}. {r.choice(NAMES)}: {r.choice(NAMES)}, {r.randint(1950, 2024)}. p. {r.randint(1, 99)}." for i in range(25))
        return "\n".join(f"{r.choice(WORDS)};{r.randint(1, 99)};{r.choice(NAMES)};{r.randint(1, 9)},{r.randint(0, 99)}" for _ in range(40))
    kind = r.randint(0, 4)
    if kind == 0:  # keywords behind separators
        return f" {r.choice('|,;/•')} ".join(r.choice(some) for _ in range(60))
    if kind == 1:  # a cycle on one line or on many
        return r.choice([" ", "\n"]).join([" ".join(some)] * r.randint(10, 40))
    if kind == 2:  # makeshift sentences
        return " ".join(f"{r.choice(some).capitalize()} {r.choice(small)} {r.choice(some)} {r.choice(small)} {r.choice(some)}." for _ in range(40))
    if kind == 3:  # links
        return "\n".join(f"[{r.choice(some)}](http://{r.choice(NAMES).lower()}{r.randint(1, 99)}.example/{r.randint(1, 999)})" for _ in range(40))
    return "\n".join(f"{r.choice(some)} {r.choice('$€£')}{r.randint(5, 900)}.99 {r.choice(some)}" for _ in range(30))


def test_held_out_pages(spark, documents):
    """Precision and recall on pages that no threshold was set by; README gives them."""
    r = random.Random(77)
    rows = [(7000 + i, held_out(r, i % 2 == 0), 1.0, "x") for i in range(400)]
    got = {x["doc_id"]: x["caso"] for x in spam.spam_shares(documents.unionByName(spark.createDataFrame(rows, documents.schema))).collect()}
    found, true = {i for i, *_ in rows if got[i]}, {i for i, *_ in rows if i % 2 == 0}
    both = len(found & true)
    print("held-out precision", both / max(len(found), 1), "recall", both / len(true))
    assert both >= 0.9 * len(found) and both >= 0.9 * len(true)
