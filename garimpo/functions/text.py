"""Text functions: Unicode normalisation, folding, words, terms, queries, highlights.

White space is Python's. Whatever looks at every character (normalisation, words, terms) works on
Arrow batches as code-point arrays, without a call for each row; the rest is column expressions.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from garimpo.functions import codepoints as cp
from garimpo.functions import folding

TERM = r"[\p{L}\p{N}]+"
LF, CR, HYPHEN, LOW_LINE, ZERO_WIDTH_SPACE = 0xA, 0xD, 0x2D, 0x5F, 0x200B

# Portuguese stop words in NFC and folded, in alphabetical order of the public list.
STOP_WORDS = """
a ao aos aquela aquelas aquele aqueles aquilo as até com como da das de dela delas dele deles depois do dos e ela elas ele
eles em entre era eram essa essas esse esses esta estamos estar estas estava estavam este esteja estejam estejamos estes
esteve estive estivemos estiver estivera estiveram estiverem estivermos estivesse estivessem estivéramos estivéssemos estou
está estávamos estão eu foi fomos for fora foram forem formos fosse fossem fui fôramos fôssemos haja hajam hajamos havemos
haver hei houve houvemos houver houvera houveram houverei houverem houveremos houveria houveriam houvermos houverá houverão
houveríamos houvesse houvessem houvéramos houvéssemos há hão isso isto já lhe lhes mais mas me mesmo meu meus minha minhas
muito na nas nem no nos nossa nossas nosso nossos num numa não nós o os ou para pela pelas pelo pelos por qual quando que
quem se seja sejam sejamos sem ser serei seremos seria seriam será serão seríamos seu seus somos sou sua suas são só também
te tem temos tenha tenham tenhamos tenho terei teremos teria teriam terá terão teríamos teu teus teve tinha tinham tive
tivemos tiver tivera tiveram tiverem tivermos tivesse tivessem tivéramos tivéssemos tu tua tuas tém tínhamos um uma você
vocês vos à às é éramos
""".split()


def cleaned(t: cp.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The cleaning of page texts, in its fixed order, over a run of texts: (code points, row offsets).

    NFC; zero-width space to blank; line ends to LF; hyphenated line ends
    joined; blanks and tabs of each line collapsed and each line stripped; three
    or more line ends to two; stripped.
    """
    cps, off = folding.composed(t)
    cps = np.where(cps == ZERO_WIDTH_SPACE, np.uint32(0x20), cps)
    if (cps == CR).any():
        same_row = ~cp.row_starts(len(cps), off)[1:]
        cps, off = cp.kept(cps, off, (cps == CR) & np.append(cps[1:] == LF, False) & same_row)
        cps = np.where(cps == CR, np.uint32(LF), cps)
    first = cp.row_starts(len(cps), off)
    at = np.flatnonzero(cps == HYPHEN)
    at = at[(at > 0) & (at < len(cps) - 2)]
    at = at[(cps[at + 1] == LF) & ~first[at] & ~first[at + 1] & ~first[at + 2]]
    kind = cp.classes()
    for side in (-1, 2):
        beside = cps[at + side]
        at = at[np.isin(kind[beside], (cp.LETTER, cp.NUMBER)) | (beside == LOW_LINE)]
    joined = np.zeros(len(cps), bool)
    joined[at] = joined[at + 1] = True
    cps, off = cp.kept(cps, off, joined)
    blank = (cps == 0x20) | (cps == 0x9)
    again = np.zeros(len(cps), bool)
    again[1:] = blank[1:] & blank[:-1]
    cps, off = cp.kept(np.where(blank, np.uint32(0x20), cps), off, again & ~cp.row_starts(len(cps), off)[:-1])
    cps, off = _without_edges(cps, off, cp.python_spaces()[cps] & (cps != LF), True)
    line, first = cps == LF, cp.row_starts(len(cps), off)
    third = np.zeros(len(cps), bool)
    third[2:] = line[2:] & line[1:-1] & line[:-2] & ~first[2:-1] & ~first[1:-2]
    cps, off = cp.kept(cps, off, third)
    return _without_edges(cps, off, cp.python_spaces()[cps], False)


def _without_edges(cps: np.ndarray, off: np.ndarray, space: np.ndarray, lines: bool) -> tuple[np.ndarray, np.ndarray]:
    """The texts without the runs of flagged code points at the edges of rows, or of their lines."""
    start, end, row = cp.runs(space, off)
    head, tail = start == off[row], end == off[row + 1]
    if lines:
        head |= cps[np.maximum(start - 1, 0)] == LF
        tail |= cps[np.minimum(end, len(cps) - 1)] == LF
    edge = head | tail
    gone = np.zeros(len(cps), bool)
    gone[cp.gather(start[edge], (end - start)[edge])] = True
    return cp.kept(cps, off, gone)


def words_of(t: cp.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run without white space."""
    return cp.runs(~cp.python_spaces()[t.cps], t.off)


def _counts(rows: int, row: np.ndarray) -> pa.Array:
    return pa.array(np.bincount(row, minlength=rows), pa.int32())


def _term_lists(t: cp.Texts) -> pa.Array:
    cps, off = folding.folded(t)
    start, end, row = folding.term_spans(cps, off)
    ends = np.searchsorted(row, np.arange(t.rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), folding.spans_to_arrow(cps, start, end).cast(pa.string()))


@F.arrow_udf(StringType())
def normalize_text(text: pa.Array) -> pa.Array:
    """``cleaned``; null becomes empty."""
    return cp.mapped(text, lambda t: cp.to_arrow(*cleaned(t)), pa.string())


@F.arrow_udf(IntegerType())
def word_count(text: pa.Array) -> pa.Array:
    """Number of runs without white space; null has none."""
    return cp.mapped(text, lambda t: _counts(t.rows, words_of(t)[2]), pa.int32())


@F.arrow_udf(ArrayType(StringType()))
def terms(text: pa.Array) -> pa.Array:
    """Index terms of a text: folded runs of letters and numbers; null has none."""
    return cp.mapped(text, _term_lists, pa.list_(pa.string()))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit("".join(map(chr, np.flatnonzero(cp.python_spaces())))))


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def query_terms(query: str, stop_words: list[str] | None = None) -> tuple[list[str], list[str], list[str], list[str]]:
    """(tokens, stop words removed, terms left, distinct terms) of one query; order and duplicates kept but in the last."""
    known = set(STOP_WORDS if stop_words is None else stop_words)
    tokens = re.findall(r"[^\W_]+", unicodedata.normalize("NFC", query or "").casefold())
    left = [t for t in tokens if t not in known]
    return tokens, [t for t in tokens if t in known], left, list(dict.fromkeys(left))


def stop_word_array(stop_words: list[str] | None = None) -> Column:
    return F.array(*map(F.lit, STOP_WORDS if stop_words is None else stop_words))


def highlight(text: Column, tokens: Column, mark: str = "mark") -> Column:
    """``text`` with every word marked whose lower-case form is among ``tokens`` (stop words count)."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"{TERM}|[^\p{{L}}\p{{N}}]+"), F.lit(0))
    marked = F.transform(pieces, lambda p: F.when(F.array_contains(tokens, F.lower(p)), F.concat(F.lit(f"<{mark}>"), p, F.lit(f"</{mark}>"))).otherwise(p))
    return F.array_join(marked, "")


def highlight_substring(text: Column, needle: str, mark: str = "mark") -> Column:
    """``text`` with every occurrence of ``needle`` marked, whatever its case; nothing for an empty needle."""
    if not needle:
        return text
    return F.regexp_replace(text, f"(?iu)({re.escape(needle)})", f"<{mark}>$1</{mark}>")
