"""Problem 1: statistics of each document's text, and how far it lies from prose.

Every page is profiled in cells of eight words (``profile``), each statistic
over the 40 words around (order of words: 104). From the cells of all pages
the mean and covariance of prose are estimated for each language, robustly:
the start are cells near the medians in every statistic, then the estimate is
repeated over the cells that lie within the limit of the last one (concentration
steps). The limit is a quantile of the chi-square distribution. A cell's squared Mahalanobis distance is split into the contribution of
each statistic. Words in cells beyond the limit stand outside prose; a document is a
case if they are the greater part of its words.

The order of words is the mean log ratio of adjacent function words against
chance, counted over all pages of the language. A page of no known language (``languages``)
is held against the prose of all, its function words and their order left out.
A language leans on the estimate of all in proportion to ``PRIOR_CELLS``.

Of a page loaded more than once the latest row counts, blank or not. Null documents, null, empty
and blank pages count nowhere; a document without words is no case.

``document_statistics`` gives every document of the pages, the chunks and the
report: what its chunks really hold, the mean of each statistic over its words, and
the above. The text of a document without a page that has words is that of its
chunks (words in their overlap count twice), judged by the estimate of the pages.
A chunk is a distinct id; of its rows the latest with a text counts.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions import codepoints as cp
from garimpo.llm import languages as lg
from garimpo.llm import profile as pf
from garimpo.llm import wordtable as wt
from garimpo.operators.latest import latest_rows
from garimpo.llm.spam import profiled
from garimpo.llm.terms import latest_texts
from garimpo.workdir import materialize

AROUND, ORDER_AROUND = 2, 6
STEPS = 5
QUANTILE = 1.2816  # the limit as a normal deviate: of normal cells one in ten lies beyond
SHARE = 0.5
PRIOR_CELLS = 300  # cells by which a language leans on the estimate of all
# The statistics of the distance, and the least standard deviation each is given.
SPREADS = {
    "funcionais": 0.03, "maiusculas": 0.08, "numericas": 0.06, "simbolos": 0.03, "fim_frase": 0.03, "fim_item": 0.05,
    "comprimento": 0.03, "linha_curta": 0.03, "estranhas": 0.05, "repetidas": 0.03, "ciclicas": 0.15,
    "linha_numero": 0.15, "linha_marcador": 0.15, "linha_aberta": 0.2, "linha_tabela": 0.15, "ordem": 0.03,
}
NAMES = tuple(SPREADS)
DIM = len(NAMES)
FLOORS = np.array(list(SPREADS.values()))
_ROOTS = [NAMES.index(k) for k in ("maiusculas", "numericas", "simbolos")]  # shares with a long tail in prose
_OF_LANGUAGE = [NAMES.index(k) for k in ("funcionais", "ordem")]
_K = pf.CLASSES + 1
_LANGS = lg.OTHER + 1
WIDTH = DIM - 1 + pf.EXTRA


def chi_square(deviate: float, freedom: int = DIM) -> float:
    """The quantile of the chi-square distribution at a normal deviate (Wilson-Hilferty)."""
    return freedom * (1 - 2 / (9 * freedom) + deviate * (2 / (9 * freedom)) ** 0.5) ** 3


LIMIT = chi_square(QUANTILE)


def values(x: pf.Text) -> dict[str, np.ndarray]:
    w = x.w
    url = pf.links(x)
    x.own = np.where(url, -1, x.own)
    return {
        "funcionais": x.own >= 0,
        "maiusculas": pf.titles(x),
        "numericas": w.digits > 0,
        "simbolos": pf.symbols(x),
        "fim_frase": (w.last & wt.SENTENCE > 0) & (w.letters > 1),
        "fim_item": w.last & wt.CLAUSE > 0,
        "comprimento": np.minimum(w.letters, 20) / 20,
        "linha_curta": pf.short_lines(x),
        "estranhas": pf.odd_words(x),
        "repetidas": pf.repeated_near(x),
        "ciclicas": pf.passages(x, 3),
        **pf.line_values(x),
    }


PLAN = pf.Plan(NAMES[:-1], values, AROUND)


class Prose(NamedTuple):
    """Mean and inverse covariance of prose for each language."""

    mean: np.ndarray
    inverse: np.ndarray


def _pairs(at: np.ndarray, classes: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, ...]:
    """(language, class, next class, is a pair, broken) of each word but the last."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    number = (classes & (pf.BROKEN - 1)).astype(np.int64)
    return language[row][:-1], number[:-1], number[1:], row[1:] == row[:-1], (classes >= pf.BROKEN)[:-1]


def _summed(counts: DataFrame, size: int) -> np.ndarray:
    """The sums ``n`` by ``i`` of tasks, of which there are at most ``size``."""
    total = np.zeros(size)
    for r in counts.groupBy("i").agg(F.sum("n").alias("n")).collect():
        total[r["i"]] = r["n"]
    return total


def _sparse(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at].astype(float))], ["i", "n"])


def order_table(profiles: DataFrame) -> np.ndarray:
    """Log ratio of each pair of word classes against chance, for each language.

    The driver gets the counts of pairs of function words: at most 8 x 128 x 128 numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_LANGS * _K * _K, np.int64)
        for batch in batches:
            at, classes = pf.bytes_of(batch.column(1))
            if len(classes) > 1:
                language, a, b, same, _ = _pairs(at, classes, np.asarray(batch.column(0)))
                total += np.bincount(((language * _K + a) * _K + b)[same], minlength=total.size)
        yield _sparse(total)

    counts = _summed(profiles.select("lingua", "classes").mapInArrow(run, "i bigint, n double"), _LANGS * _K * _K).reshape(_LANGS, _K, _K)
    chance = counts.sum(2, keepdims=True) * counts.sum(1, keepdims=True) / np.maximum(counts.sum((1, 2), keepdims=True), 1)
    return np.log((counts + 1) / (chance + 1))


def order_scores(language: np.ndarray, classes: pa.Array, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row offsets, score of each word and the next, in whole 1/256 so that sums don't depend on the batch)."""
    at, number = pf.bytes_of(classes)
    score = np.zeros(len(number))
    if len(number) > 1:
        tongue, a, b, same, broken = _pairs(at, number, language)
        score[:-1] = np.where(same, np.rint(np.clip(np.where(broken, -3, order[tongue, a, b]), -3, 1) * 256) / 256, 0)
    return at, score


def cell_bytes(language: np.ndarray, perfil: pa.Array, classes: pa.Array, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each cell, cells x (statistics, words) as bytes, row offsets of the words, order score of each word)."""
    row, table = pf.tables_of(perfil, WIDTH)
    at, score = order_scores(language, classes, order)
    out = np.empty((len(row), DIM + 1), np.uint8)
    if len(row):
        words = table[:, -1].astype(np.int64)
        size = np.concatenate([[0], np.cumsum(words)])
        total = np.concatenate([[0], np.cumsum(np.add.reduceat(score, size[:-1]))])
        index, cells_of = np.arange(len(row)), np.searchsorted(row, np.arange(len(perfil) + 1))
        lo = np.maximum(index - ORDER_AROUND, cells_of[row])
        hi = np.minimum(index + ORDER_AROUND + 1, cells_of[row + 1])
        mean = (total[hi] - total[lo]) / (size[hi] - size[lo])
        out[:, : DIM - 1], out[:, DIM - 1], out[:, DIM] = table[:, : DIM - 1], np.rint((mean + 3) / 4 * 255), table[:, -1]
    return row, out, at, score


def scaled(profiles: DataFrame, key: str, order: np.ndarray) -> DataFrame:
    """(key, lingua, celulas, and the sums of the statistics if the profiles have them): the cells with their order of words, as bytes."""
    sums = "somas" in profiles.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language = np.asarray(batch.column(1))
            row, table, at, score = cell_bytes(language, batch.column(2), batch.column(3), order)
            cells_of = np.searchsorted(row, np.arange(batch.num_rows + 1))
            columns = [batch.column(0), batch.column(1), pf._binary(cells_of * (DIM + 1), table)]
            if sums:
                ordered = np.bincount(np.repeat(np.arange(batch.num_rows), np.diff(at)), score * pf.UNIT, batch.num_rows).astype(np.int64)
                whole = np.column_stack([pf.sums_of(batch.column(4), DIM - 1), ordered])
                columns.append(pf._binary(np.arange(batch.num_rows + 1) * (8 * DIM), whole))
            yield pa.RecordBatch.from_arrays(columns, [key, "lingua", "celulas", *["somas"] * sums])

    kind = profiles.schema[key].dataType.simpleString()
    cut = profiles.select(key, "lingua", "perfil", "classes", *["somas"] * sums).mapInArrow(run, f"`{key}` {kind}, lingua int, celulas binary" + ", somas binary" * sums)
    return materialize(cut, "celulas")


def cell_values(language: pa.Array, cells: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, language, words, statistics) of every cell of a batch."""
    row, table = pf.tables_of(cells, DIM + 1)
    x = table[:, :DIM].astype(np.float32) / np.float32(255)
    x[:, _ROOTS] = np.sqrt(x[:, _ROOTS])
    return row, np.asarray(language)[row], table[:, DIM].astype(float), x


def distances(x: np.ndarray, language: np.ndarray, prose: Prose) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance of each cell, contribution of each statistic to it). Many function words are no sign of anything: only too few count."""
    parts = np.zeros_like(x)
    for k in np.unique(language):
        of = language == k
        y = x[of] - prose.mean[k].astype(x.dtype)
        y[:, 0] = np.minimum(y[:, 0], 0)
        parts[of] = y * (y @ prose.inverse[k].astype(x.dtype))
    return parts.sum(axis=1), parts


def _sums(cells: DataFrame, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each language count, sums and cross products of the kept cells; one small row for each task goes into the sum."""
    width = 1 + DIM + DIM * DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((_LANGS, width))
        for batch in batches:
            _, language, _, x = cell_values(*batch.columns)
            kept = keep(x, language)
            for k in np.unique(language):
                y = x[kept & (language == k)].astype(np.float64)
                total[k] += np.concatenate([[len(y)], y.sum(axis=0), (y.T @ y).ravel()])
        yield _sparse(total)

    return _summed(cells.select("lingua", "celulas").mapInArrow(run, "i bigint, n double"), _LANGS * width).reshape(_LANGS, width)


def _leaning(counts: np.ndarray) -> np.ndarray:
    """Counts of the known languages, each with a part of those of all; the last row, of no known language, has those of all."""
    known = counts[: lg.OTHER]
    pooled = known.sum(axis=0) if known.sum() else counts.sum(axis=0)
    prior = pooled * (PRIOR_CELLS / max(float(pooled.flat[0] if counts.ndim == 2 else pooled[0].sum()), 1.0))
    return np.concatenate([known + prior, pooled[None]])


def _medians(cells: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Median and median deviation of each statistic in each language, from histograms of 256 values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((_LANGS, DIM, 256), np.int64)
        for batch in batches:
            _, language, _, x = cell_values(*batch.columns)
            bins = np.rint(x * 255).astype(np.int64) + 256 * language[:, None]
            for j in range(DIM):
                total[:, j] += np.bincount(bins[:, j], minlength=256 * _LANGS).reshape(_LANGS, 256)
        yield _sparse(total)

    hist = cells.select("lingua", "celulas").mapInArrow(run, "i bigint, n double")
    counts = _leaning(_summed(hist, _LANGS * DIM * 256).reshape(_LANGS, DIM, 256))
    value = np.arange(256) / 255

    def middle(weights: np.ndarray, values: np.ndarray) -> float:
        at = np.argsort(values, kind="stable")
        return float(values[at][min(np.searchsorted(np.cumsum(weights[at]), weights.sum() / 2), 255)]) if weights.sum() else 0.0

    median = np.array([[middle(h, value) for h in of] for of in counts])
    spread = np.array([[middle(h, np.abs(value - m)) for h, m in zip(of, ms)] for of, ms in zip(counts, median)])
    return median, spread


def _prose(sums: np.ndarray) -> Prose:
    """The estimate from sums of kept cells."""
    sums = _leaning(sums)
    n = np.maximum(sums[:, 0], 1e-9)
    mean = sums[:, 1 : 1 + DIM] / n[:, None]
    cross = sums[:, 1 + DIM :].reshape(-1, DIM, DIM) / n[:, None, None]
    covariance = cross - mean[:, :, None] * mean[:, None, :] + np.diag(FLOORS**2)
    inverse = np.linalg.inv(covariance)
    # of no known language: the distance in the other statistics
    rest = np.setdiff1d(np.arange(DIM), _OF_LANGUAGE)
    inverse[lg.OTHER] = 0
    inverse[lg.OTHER][np.ix_(rest, rest)] = np.linalg.inv(covariance[lg.OTHER][np.ix_(rest, rest)])
    return Prose(mean, inverse)


def fit_prose(cells: DataFrame) -> Prose:
    """The robust estimate of prose, over all cells."""
    median, spread = _medians(cells)
    reach = 4 * np.maximum(1.4826 * spread, np.maximum(FLOORS, 0.05))

    prose = _prose(_sums(cells, lambda x, language: (np.abs(x - median[language]) <= reach[language]).all(axis=1)))
    for _ in range(STEPS - 1):
        prose = _prose(_sums(cells, lambda x, language, p=prose: distances(x, language, p)[0] <= LIMIT))
    return prose


def _page_texts(pages: DataFrame, key: str, page: str, text: str, when: str) -> DataFrame:
    """The latest row of each page, if it has a text."""
    rows = latest_rows(pages.where(F.col(key).isNotNull()).select(key, page, text, when), [key, page], when, [F.col(text)])
    return rows.where(F.length(text) > 0)


def _scored(cells: DataFrame, key: str, prose: Prose) -> DataFrame:
    """For each key with words what document_quality gives; of cells with sums also the mean of each statistic."""
    sums = "somas" in cells.columns
    weighed = ["palavras", "palavras_fora", "__distancia", *(f"__{n}" for n in NAMES)]
    summed = [f"__soma_{n}" for n in NAMES] * sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, language, words, x = cell_values(*batch.columns[1:3])
            distance, parts = distances(x, language, prose)
            out = distance > LIMIT
            n = batch.num_rows
            columns = [np.bincount(row, v, n).astype(float) for v in (words, words * out, words * distance, *(words * parts.T))]
            columns += [*pf.sums_of(batch.column(3), DIM).T] if sums else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], [key, *weighed, *summed])

    kind = cells.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join([*(f"`{n}` double" for n in weighed), *(f"`{n}` bigint" for n in summed)])
    scored = cells.select(key, "lingua", "celulas", *["somas"] * sums).mapInArrow(run, schema)
    total = scored.groupBy(key).agg(*(F.sum(n).alias(n) for n in weighed + summed)).where("palavras > 0")
    share = F.col("palavras_fora") / F.col("palavras")
    return total.select(
        key, F.col("palavras").cast("bigint"), F.col("palavras_fora").cast("bigint"), share.alias("parte"), (F.col("__distancia") / F.col("palavras")).alias("distancia"),
        *((F.col(f"__soma_{n}") / F.lit(float(pf.UNIT)) / F.col("palavras")).alias(f"media_{n}") for n in NAMES * sums),
        *((F.col(f"__{n}") / F.col("palavras")).alias(f"contribuicao_{n}") for n in NAMES), (share > SHARE).alias("caso"),
    )


def document_quality(pages: DataFrame, key: str = "id_documento", page: str = "numero_pagina", text: str = "texto_normalizado", when: str = "carregado_em") -> DataFrame:
    """For each document: palavras, palavras_fora, parte, distancia (mean), a contribution for each statistic, caso."""
    profiles = materialize(profiled(_page_texts(pages, key, page, text, when), key, text, PLAN, True), "perfis")
    cells = scaled(profiles, key, order_table(profiles))
    return _scored(cells, key, fit_prose(cells))


def _chunk_sizes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Chunks, words (runs without white space) and characters (code points) of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, t in cp.spans(batch.column(1)):
                words.append(np.bincount(cp.words(t)[2], minlength=t.rows))
                size.append(np.diff(t.off))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(words)), pa.array(np.concatenate(size))], [key, "p", "c"])

    kind = texts.schema[key].dataType.simpleString()
    sizes = texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, p bigint, c bigint")
    return sizes.groupBy(key).agg(F.count("*").alias("quantidade_chunks"), F.sum("p").alias("quantidade_palavras"), F.sum("c").alias("quantidade_caracteres"))


def document_statistics(pages: DataFrame, chunks: DataFrame, report: DataFrame, key: str = "id_documento") -> DataFrame:
    """Every document of the three tables: quantidade_chunks, quantidade_palavras and quantidade_caracteres of its chunks,
    the mean of each statistic, and what document_quality gives.

    The means are shares of the words, but comprimento (letters in 20, each word
    20 at most) and ordem (log ratio). Without words they are null, as are parte, distancia and the contributions.
    """
    of_pages = materialize(profiled(_page_texts(pages, key, "numero_pagina", "texto_normalizado", "carregado_em"), key, "texto_normalizado", PLAN, True, True), "perfis")
    texts = latest_texts(chunks, "id_chunk", "texto", "carregado_em", [key]).where(F.col(key).isNotNull())
    sizes = materialize(_chunk_sizes(texts, key, "texto"), "tamanhos")
    unpaged = materialize(sizes.select(key).join(of_pages.where("palavras > 0").select(key).distinct(), key, "left_anti"), "sem_paginas")
    of_chunks = profiled(texts.join(unpaged, key, "left_semi"), key, "texto", PLAN, True, True)
    profiles = materialize(of_pages.unionByName(of_chunks), "perfis") if not unpaged.isEmpty() else of_pages
    fitted = profiles if of_pages.where("palavras > 0").isEmpty() else of_pages
    order = order_table(fitted)
    cells = scaled(profiles, key, order)
    stats = _scored(cells, key, fit_prose(cells if fitted is profiles else scaled(fitted, key, order)))
    ids = functools.reduce(DataFrame.unionByName, (df.where(F.col(key).isNotNull()).select(key).distinct() for df in (pages, chunks, report))).distinct()
    counts = [*sizes.columns[1:], "palavras", "palavras_fora"]
    out = ids.join(sizes, key, "left").join(stats, key, "left").fillna(0, counts).fillna(False, ["caso"])
    return out.select(key, *counts, *stats.columns[3:])
