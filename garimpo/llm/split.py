"""Problem 3: oversized texts cut into pieces at natural boundaries, with overlap.

A text with more than ``max_words`` words or ``max_chars`` code points is cut.
All words of all oversized texts of a batch are nodes of one array. Every node
has a farthest legal end (within both limits, at the end of a line or sentence
if the window has one, else of a clause, else of a word) and from it a
successor: the start of the next piece, ``overlap`` words before that end, or
as many as leave the next piece room to go on. Pointer doubling squares the
successor table and derives all cuts of all texts in ``log2(pieces)`` steps.

A word longer than ``max_chars`` is itself cut into fragments (not before a
combining mark where that can be avoided); its pieces share the word's number.
Null and short texts give no piece; an oversized text of white space only gives
one empty piece. A null ``inicio_palavra`` counts as 0. Of the rows of one key that are
oversized the latest is cut (ties: by a hash of the text); rows within the limits don't take its
place, whether earlier or later. ``paginas`` comes from the words of the document's pages
where those cover the piece, else from the row itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.functions import codepoints as cp
from garimpo.operators.ordinals import running_sum
from garimpo.workdir import materialize

MAX_WORDS, MAX_CHARS, OVERLAP = 200, 2000, 30
PAGE_BLOCK, WORD_BUCKET = 256, 2000  # pages summed together; words of a document joined together
_STRONG = tuple(map(ord, ".!?…。！？"))
_WEAK = tuple(map(ord, ",;:)]،，；：、"))
_CLOSING = tuple(map(ord, "\"'”’»)]"))


class Pieces(NamedTuple):
    """Row of each piece, first and last character, first word and word after the last, in the row."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word_from: np.ndarray
    word_to: np.ndarray


def word_counts(t: cp.Texts) -> np.ndarray:
    _, _, row = cp.words(t)
    return np.bincount(row, minlength=t.rows)


def _fragments(t: cp.Texts, start: np.ndarray, end: np.ndarray, row: np.ndarray, limit: int):
    """Words as units of at most ``limit`` characters: (start, end, row, word number in the row, last of its word)."""
    number = np.arange(len(start)) - np.searchsorted(row, row)
    parts = -(-(end - start) // limit)
    if (parts <= 1).all():
        return start, end, row, number, np.ones(len(start), bool)
    lo, hi, at, last = [], [], [], []
    kinds = cp.classes()
    for w in np.flatnonzero(parts > 1):  # the few words beyond the limit
        a = start[w]
        while a < end[w]:
            b = min(a + limit, end[w])
            c = b
            while b < end[w] and c > a + limit // 2 and kinds[t.cps[c]] in (cp.MARK, cp.FORMAT):
                c -= 1
            b = c if b < end[w] and c > a + limit // 2 else b
            lo.append(a), hi.append(b), at.append(w), last.append(b == end[w])
            a = b
    whole = np.flatnonzero(parts == 1)
    lo, hi = np.concatenate([start[whole], lo]).astype(np.int64), np.concatenate([end[whole], hi]).astype(np.int64)
    at = np.concatenate([whole, at]).astype(np.int64)
    last = np.concatenate([np.ones(len(whole), bool), last]).astype(bool)
    order = np.argsort(lo, kind="stable")
    lo, hi, at, last = lo[order], hi[order], at[order], last[order]
    return lo, hi, row[at], number[at], last


def _latest(flag: np.ndarray) -> np.ndarray:
    """For each position p: the largest q <= p with ``flag[q]``, or -1."""
    return np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1))


def cut(t: cp.Texts, wanted: np.ndarray, max_words: int, max_chars: int, overlap: int) -> Pieces:
    """Pieces of the rows flagged in ``wanted``; see the module text."""
    w_start, w_end, w_row = cp.words(t)
    keep = wanted[w_row]
    start, end, row, number, whole = _fragments(t, w_start[keep], w_end[keep], w_row[keep], max_chars)
    n = len(start)
    empty = np.flatnonzero(wanted & ~np.isin(np.arange(t.rows), row))
    if n == 0:
        zero = np.zeros(len(empty), np.int64)
        return Pieces(empty, t.off[empty], t.off[empty], zero, zero)
    stop = np.searchsorted(row, row, side="right")  # unit after the last of the row
    # farthest end within both limits, as the number of the unit after it
    nodes = np.arange(n)
    word_key = row * (np.int64(1) << 40) + number
    by_words = np.searchsorted(word_key, word_key + max_words)
    by_chars = np.searchsorted(end, start + max_chars, side="right")
    far = np.minimum(np.minimum(by_words, by_chars), stop)
    # natural boundaries after a unit
    line = np.zeros(len(t.cps) + 1, np.int64)
    np.cumsum((t.cps == 0xA) | (t.cps == 0x2029) | (t.cps == 0x2028), out=line[1:])
    following = np.append(start[1:], len(t.cps))
    tail, before = t.cps[end - 1], t.cps[np.maximum(end - 2, start)]
    strong = whole & (np.isin(tail, _STRONG) | (np.isin(tail, _CLOSING) & np.isin(before, _STRONG)) | (line[following] > line[end]))
    weak = whole & np.isin(tail, _WEAK)
    word_key_end = word_key + overlap  # an end must leave the overlap behind it, or the next piece would not move on
    least = np.minimum(np.searchsorted(word_key, word_key_end, side="right"), far)
    ends = far.copy()
    open_ = far < stop
    for flags in (whole, weak, strong):
        at = _latest(flags)[far - 1] + 1
        ends = np.where(open_ & (at > least) & (at > nodes), at, ends)
    # the first start from which a piece reaches beyond each end
    room = np.searchsorted(far, ends, side="right")
    back = np.searchsorted(word_key, word_key[np.minimum(ends, n - 1)] - overlap)
    back = np.where(ends >= stop, n, back)
    after = np.minimum(np.maximum(np.maximum(back, room), nodes + 1), ends)
    after = np.where(ends >= stop, n, after)
    jump = np.append(after, n)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    reached, squares = np.zeros(n + 1, bool), jump
    reached[first] = True
    while True:
        at = squares[np.flatnonzero(reached)]
        if reached[at[at < n]].all():
            break
        reached[at] = True
        squares = squares[squares]
    reached[n] = False
    cuts = np.flatnonzero(reached)
    last = ends[cuts] - 1
    order = np.argsort(np.concatenate([row[cuts], empty]), kind="stable")
    zero = np.zeros(len(empty), np.int64)
    parts = ((row[cuts], empty), (start[cuts], t.off[empty]), (end[last], t.off[empty]), (number[cuts], zero), (number[last] + 1, zero))
    return Pieces(*(np.concatenate(p)[order] for p in parts))


def split_column(col: pa.Array, max_words: int, max_chars: int, overlap: int) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """(rows, [order, texts, characters, words, first word, word after the last]) for each run of rows."""
    for at, t in cp.spans(col):
        over = t.valid & ((np.diff(t.off) > max_chars) | (word_counts(t) > max_words))
        if not over.any():
            continue
        p = cut(t, over, max_words, max_chars, overlap)
        length = p.end - p.start
        off = np.concatenate([[0], np.cumsum(length)])
        texts = cp.to_arrow(t.cps[cp.gather(p.start, length)], off)
        order = np.arange(len(p.row)) - np.searchsorted(p.row, p.row) + 1
        ints = [pa.array(x.astype(np.int32)) for x in (order, length, p.word_to - p.word_from, p.word_from, p.word_to)]
        yield at + p.row, [ints[0], texts, *ints[1:]]


def split_oversized(
    df: DataFrame, key: str, text: str, keep: list[str] = (), max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP
) -> DataFrame:
    """Pieces of the oversized texts of ``df``: key, kept columns, peca, texto, counts, de_palavra, ate_palavra.

    A map without any shuffle. ``peca`` counts from 1 within a row.
    """
    if max_words < 1 or max_chars < 1 or not 0 <= overlap < max_words:
        raise ValueError("limits must be positive and 0 <= overlap < max_words")
    names = [key, *keep]
    out = ["peca", "texto", "quantidade_caracteres", "quantidade_palavras", "de_palavra", "ate_palavra"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, made in split_column(batch.column(len(names)), max_words, max_chars, overlap):
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(names))), *made], [*names, *out])

    kinds = [T.StringType() if c == "texto" else T.IntegerType() for c in out]
    schema = T.StructType([*(df.schema[c] for c in names), *(T.StructField(c, k) for c, k in zip(out, kinds))])
    return df.select(*names, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def word_count_column(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns and ``palavras``, the number of words of the text; null has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [word_counts(t) for _, t in cp.spans(batch.column(len(keep)))]
            made = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], made], [*keep, "palavras"])

    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField("palavras", T.LongType())])
    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def page_bounds(pages: DataFrame) -> DataFrame:
    """(id_documento, numero_pagina, de, ate): where the words of each page stand in its document.

    Of a page loaded more than once the latest counts. The running sum over a
    document goes through blocks of pages, so that a document of any length is
    summed by many tasks.
    """
    keys = ["id_documento", "numero_pagina"]
    counted = word_count_column(pages, "texto_normalizado", [*keys, "carregado_em"])
    counted = counted.groupBy(*keys).agg(F.max(F.struct("carregado_em", "palavras"))["palavras"].alias("palavras"))
    placed = running_sum(counted.where("palavras > 0"), ["id_documento"], "numero_pagina", "palavras", F.floor(F.col("numero_pagina") / PAGE_BLOCK))
    return placed.withColumnRenamed("antes", "de")


def _buckets(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(F.floor(lo / WORD_BUCKET), F.floor((F.greatest(hi, lo + 1) - 1) / WORD_BUCKET)))


def split_chunks(chunks: DataFrame, pages: DataFrame | None = None, **limits: int) -> DataFrame:
    """Pieces of the oversized chunks with their own inicio_palavra, fim_palavra and paginas.

    ``inicio_palavra`` of a chunk is where its text starts in the document (its
    recorded ``fim_palavra`` and counts are not used); without ``pages``, or
    where they don't cover a piece, the recorded ``paginas`` stay.
    """
    over = chunks.where(F.col("id_chunk").isNotNull() & F.col("texto").isNotNull())
    over = over.withColumn("versao", F.struct("carregado_em", F.xxhash64("texto").alias("h")))
    pieces = split_oversized(over, "id_chunk", "texto", ["id_documento", "paginas", "inicio_palavra", "versao"], **limits)
    pieces = materialize(pieces.dropDuplicates(["id_chunk", "versao", "peca"]), "pecas")
    newest = pieces.groupBy("id_chunk").agg(F.max("versao").alias("versao"))
    pieces = pieces.join(newest, ["id_chunk", "versao"], "left_semi")
    base = F.coalesce("inicio_palavra", F.lit(0))
    pieces = pieces.withColumns({"inicio_palavra": base + F.col("de_palavra"), "fim_palavra": base + F.col("ate_palavra")})
    if pages is not None:
        at = page_bounds(pages).select("id_documento", "numero_pagina", "de", "ate", _buckets(F.col("de"), F.col("ate")).alias("b"))
        need = pieces.select("id_documento", "id_chunk", "peca", "inicio_palavra", "fim_palavra", _buckets(F.col("inicio_palavra"), F.col("fim_palavra")).alias("b"))
        hits = need.join(at, ["id_documento", "b"]).where("de < fim_palavra and ate > inicio_palavra")
        own = hits.groupBy("id_chunk", "peca").agg(F.array_sort(F.collect_set("numero_pagina")).alias("__p"), F.max("ate").alias("__ate"))
        pieces = pieces.join(own, ["id_chunk", "peca"], "left")
        pieces = pieces.withColumn("paginas", F.when(F.col("__ate") >= F.col("fim_palavra"), F.col("__p")).otherwise(F.col("paginas")))
    return pieces.select(
        "id_chunk", "peca", "id_documento", "paginas", "inicio_palavra", "fim_palavra", "quantidade_palavras", "quantidade_caracteres", "texto"
    )
