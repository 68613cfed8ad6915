"""Problem 8: pages that are keywords, links, tags or product labels for the greater part.

Every document is profiled in cells of eight words (``profile``), over 24 words. Of these some
statistics look nearby (function words, separators, links, prices, words and pairs
that come again within 24 words), others at the whole text: the share of its top words
and top pairs, of lines that stand in it several times, and of recurrent words. The
usual value of each statistic in each language is its median over the cells of all
documents, and each threshold a step from there (``Usual``). A document is a case
if more than half of its characters stand in cells beyond them:

* links and tags: many link words, few function words;
* stuffing: content words or word pairs that come again nearby or are top ones of the text,
  or lines, passages and words that recur without function words;
* separated keywords: a dense row of separators without function words;
* product labels: prices without function words.

Rows of no known language are judged by the usual values of the known ones. A language with few
words leans on those of all in proportion to its size. Null, empty and blank texts are no
cases. Copies are cases of their own; repeated rows of one id give one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.functions import hashing as hs
from garimpo.llm import languages as lg
from garimpo.llm import profile as pf
from garimpo.llm import wordtable as wt
from garimpo.workdir import materialize

SHARE = 0.5
PRIOR_WORDS = 2_000  # words by which a language leans on the usual values of all
SPREADS, MOST_STEP = 2.0, 0.85
LEAST_TIMES, TOP_WORD, TOP_PAIR, RECURRENT, SAME_LINE = 4, 0.025, 0.01, 0.005, 3  # from which a word, pair or line is a top one of its text
REASONS = ("ligacoes", "repeticao", "palavras_chave", "produtos")
STATISTICS = (
    "funcionais", "maiusculas", "numericas", "simbolos", "fim_frase", "linha_curta", "estranhas", "repetidas", "ciclicas", "ligacoes",
    "separadores", "precos", "conteudo", "pares_perto", "frequentes", "recorrentes", "pares", "linhas_iguais",
)
WIDTH = len(STATISTICS) + pf.EXTRA


def top(times: np.ndarray, of: np.ndarray, share: float) -> np.ndarray:
    """Places whose key stands often enough among the ``of`` usable places of its row."""
    return times >= np.maximum(LEAST_TIMES, share * of)


def same_lines(x: pf.Text) -> np.ndarray:
    """Words of lines of two words or more that stand at least SAME_LINE times in their row."""
    first = np.flatnonzero(x.line_first)
    size = np.diff(np.append(first, x.n))
    key = x.order.spans(first, first + size) ^ x.row_key[first]
    usable = (size > 1) & (np.maximum.reduceat(x.w.letters, first) > 0)
    return np.repeat(hs.together(key, usable).times(len(first)) >= SAME_LINE, size)


def prices(x: pf.Text) -> np.ndarray:
    """Words with a currency sign and three letters at most, with digits or beside a word with digits."""
    figure, one = x.w.digits > 0, ~x.row_first[1:]
    beside = np.zeros(x.n, bool)
    beside[:-1] |= figure[1:] & one
    beside[1:] |= figure[:-1] & one
    return x.holding(wt.CURRENCY) & (x.w.letters <= 3) & (figure | beside)


def values(x: pf.Text) -> dict[str, np.ndarray]:
    w = x.w
    words = hs.together(w.core ^ x.row_key, x.content)
    times = words.times(x.n)
    contents = np.bincount(w.row, x.content, w.rows)[w.row]
    pair_key = x.runs(2)
    pairs = hs.together(pair_key ^ x.row_key, (pair_key != 0) & (w.core != 0))
    near, common = pairs.near(x.n, pf.NEAR), top(pairs.times(x.n), w.sizes[w.row] - 1, TOP_PAIR)
    url = pf.links(x)
    alone = (w.letters + w.digits == 0) & (w.marks <= 2)
    own = np.where(url, -1, x.own)
    return {
        "funcionais": own >= 0,
        "maiusculas": pf.titles(x),
        "numericas": w.digits > 0,
        "simbolos": pf.symbols(x),
        "fim_frase": (w.last & wt.SENTENCE > 0) & (w.letters > 1),
        "linha_curta": pf.short_lines(x),
        "estranhas": pf.odd_words(x),
        "repetidas": words.near(x.n, pf.NEAR),
        "ciclicas": pf.passages(x, 3),
        "ligacoes": url,
        "separadores": alone | (w.last & wt.SEPARATOR > 0),
        "precos": prices(x),
        "conteudo": x.content,
        "pares_perto": near | np.append(False, near[:-1]),
        "frequentes": x.content & top(times, contents, TOP_WORD),
        "recorrentes": x.content & top(times, contents, RECURRENT),
        "pares": common | np.append(False, common[:-1]),
        "linhas_iguais": same_lines(x),
    }


PLAN = pf.Plan(STATISTICS, values, 1)


class Cells:
    """Statistics of cells by name, with the ratios of repeated content words."""

    def __init__(self, table: np.ndarray):
        self.words, self.characters = table[:, -1].astype(float), pf.characters(table)
        self.of = {name: table[:, j] / 255.0 for j, name in enumerate(STATISTICS)}
        least = np.maximum(self.of["conteudo"], 0.01)
        for name in ("repetidas", "frequentes", "recorrentes"):
            self.of[f"razao_{name}"] = np.minimum(self.of[name] / least, 1)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.of[name]


CALIBRATED = (
    "funcionais", "razao_repetidas", "razao_frequentes", "razao_recorrentes", "pares_perto", "pares", "linhas_iguais", "ciclicas", "ligacoes", "separadores", "precos",
    "numericas", "maiusculas", "simbolos", "estranhas", "linha_curta", "fim_frase", "conteudo",
)


class Usual:
    """Median and lower tenth of each calibrated statistic in each language, and the thresholds they set.

    Repetition, links and the like make the upper side of a statistic, so its spread is taken from the lower side.
    """

    def __init__(self, counts: np.ndarray):
        known = counts[: lg.OTHER]
        pooled = known.sum(axis=0)
        pooled = pooled if pooled.sum() else counts.sum(axis=0)
        prior = pooled / np.maximum(pooled.sum(axis=1, keepdims=True), 1) * PRIOR_WORDS
        median, low = (np.concatenate([_quantile(known + prior, q), _quantile(pooled[None], q)]) for q in (0.5, 0.1))
        self.median = {name: median[:, j] for j, name in enumerate(CALIBRATED)}
        self.low = {name: low[:, j] for j, name in enumerate(CALIBRATED)}

    def above(self, name: str, step: float, language: np.ndarray) -> np.ndarray:
        """``step`` of the way from the usual value to 1, further where the language itself varies much, MOST_STEP of the way at most."""
        m = self.median[name]
        limit = np.clip(m + SPREADS * (m - self.low[name]), m + step * (1 - m), m + MOST_STEP * (1 - m))
        return limit[language]

    def below(self, name: str, part: float, language: np.ndarray) -> np.ndarray:
        """``part`` of the usual value."""
        return part * self.median[name][language]


def _quantile(counts: np.ndarray, q: float) -> np.ndarray:
    """A quantile of each histogram of 256 values (last axis)."""
    run = np.cumsum(counts, axis=-1)
    return np.argmax(run >= run[..., -1:] * q, axis=-1) / 255.0


def profiled(df: DataFrame, key: str, text: str, plan: pf.Plan, classes: bool = False, sums: bool = False) -> DataFrame:
    """(key, lingua, palavras, perfil) of every row, then classes and somas if asked for; a map without any shuffle."""
    made = T.StructType.fromDDL("lingua int, palavras bigint, perfil binary" + ", classes binary" * classes + ", somas binary" * sums)
    names = [key, *made.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *pf.profile_arrays(batch.column(1), plan, classes, sums)], names)

    schema = T.StructType([df.schema[key], *made.fields])
    return df.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def histograms(language: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Words by language, calibrated statistic and value."""
    s, total = Cells(table), np.zeros((lg.OTHER + 1, len(CALIBRATED), 256))
    for j, name in enumerate(CALIBRATED):
        at = language * 256 + np.rint(s[name] * 255).astype(np.int64)
        total[:, j] = np.bincount(at, s.words, (lg.OTHER + 1) * 256).reshape(-1, 256)
    return total


def calibrate(profiles: DataFrame) -> Usual:
    """The usual values from the cells of all documents.

    Each task sends a histogram of 256 values for each language and statistic; their sums,
    at most 36,864 counts, reach the driver, whatever the number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((lg.OTHER + 1, len(CALIBRATED), 256))
        for batch in batches:
            row, table = pf.tables_of(batch.column(1), WIDTH)
            total += histograms(np.asarray(batch.column(0))[row], table)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["i", "n"])

    counts = profiles.select("lingua", "perfil").mapInArrow(run, "i bigint, n double")
    total = np.zeros((lg.OTHER + 1) * len(CALIBRATED) * 256)
    for r in counts.groupBy("i").agg(F.sum("n").alias("n")).collect():
        total[r["i"]] = r["n"]
    return Usual(total.reshape(lg.OTHER + 1, len(CALIBRATED), 256))


def spam_cells(s: Cells, language: np.ndarray, usual: Usual) -> dict[str, np.ndarray]:
    """For each reason the cells beyond the thresholds of their language."""

    def above(name: str, step: float) -> np.ndarray:
        return s[name] >= usual.above(name, step, language)

    def fewer(part: float) -> np.ndarray:
        return s["funcionais"] < usual.below("funcionais", part, language)

    wordy = above("conteudo", 0.3) | (s["conteudo"] > 0.6)
    plain = ~above("estranhas", 0.1) & ~above("maiusculas", 0.1)  # neither codes nor names
    counted = above("numericas", 0.07)  # figures and dates: a table
    stuffed = above("razao_repetidas", 0.45) & fewer(0.8) | above("razao_repetidas", 0.6) & fewer(1)
    phrases = above("razao_repetidas", 0.5) & above("pares_perto", 0.35) & fewer(1.05)
    # sentences made around the same words of the whole text; a passage that returns with its function words is junk
    made = above("razao_frequentes", 0.5) & above("pares", 0.4) & (~above("ciclicas", 0.5) | fewer(0.8))
    again = above("linhas_iguais", 0.5) | above("razao_frequentes", 0.5) | above("ciclicas", 0.5) | above("razao_recorrentes", 0.8)
    bare = (above("razao_repetidas", 0.1) | again) & fewer(0.35) & plain & ~above("simbolos", 0.3) & ~above("fim_frase", 0.03) & wordy & ~above("numericas", 0.12)
    return {
        "ligacoes": above("ligacoes", 0.1) & fewer(0.55),
        "repeticao": (stuffed | phrases | made) & ~counted & (s["conteudo"] > 0.3) | bare,
        "palavras_chave": (s["separadores"] + s["fim_frase"] >= 0.28) & fewer(0.65) & plain & ~counted & ~above("simbolos", 0.6) & (s["conteudo"] > 0.45) & ~above("linha_curta", 0.4),
        "produtos": above("precos", 0.06) & fewer(0.55),
    }


def shares(rows: int, row: np.ndarray, table: np.ndarray, language: np.ndarray, usual: Usual) -> list[np.ndarray]:
    """For each row the share of its characters in cells beyond a threshold: of any reason, then of each."""
    s = Cells(table)
    found = spam_cells(s, language[row], usual)
    extent = np.maximum(np.bincount(row, s.characters, rows), 1)
    return [np.bincount(row, s.characters * hit, rows) / extent for hit in (np.any(list(found.values()), axis=0), *found.values())]


def spam_shares(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, palavras, parte, a share for each reason, caso) of every document."""
    profiles = materialize(profiled(df, key, text, PLAN), "perfis")
    usual = calibrate(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, table = pf.tables_of(batch.column(3), WIDTH)
            share = shares(batch.num_rows, row, table, np.asarray(batch.column(1)), usual)
            columns = [batch.column(0), batch.column(2), *(pa.array(x) for x in share), pa.array(share[0] > SHARE)]
            yield pa.RecordBatch.from_arrays(columns, [key, "palavras", "parte", *REASONS, "caso"])

    doubles = [T.StructField(n, T.DoubleType()) for n in ("parte", *REASONS)]
    schema = T.StructType([df.schema[key], T.StructField("palavras", T.LongType()), *doubles, T.StructField("caso", T.BooleanType())])
    return profiles.mapInArrow(run, schema)
