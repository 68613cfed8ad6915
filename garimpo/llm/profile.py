"""Statistics of running text, cell by cell: the common ground of problems 1 and 8.

A text is profiled in cells of eight words; each statistic of a cell is taken
over the cell and its neighbours, and stored as one byte (a share from 0 to 255). A
row's profile is a small binary value, so that later passes over all documents
(calibration, fitting, scoring) don't read the text again. Each problem has a
``Plan`` of its own: only its statistics are worked out.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from garimpo.functions import codepoints as cp
from garimpo.functions import hashing as hs
from garimpo.llm import wordtable as wt
from garimpo.llm.languages import CAPITAL_NOUNS, row_language

CELL = 8
NEAR = 24  # words within which a repeated word or pair stands nearby; repetition further apart is that of the whole row
PASSAGE = 8  # words of a repeated passage
EXTRA = 5  # bytes of a cell beside its statistics: four for its characters, one for its words
UNIT = 1 << 20  # a value of 1 in the exact sums of a row
CLASSES = 127  # classes of words in the order of words; the last is that of words without a place of their own
OUTSIDE, BROKEN = CLASSES, 128  # class of other words; flag of words that break a sentence


class Text:
    """A run of texts as words, with what several statistics need worked out once."""

    def __init__(self, t: cp.Texts):
        w = self.w = wt.word_table(t)
        self.language, self.own = row_language(w)
        n = self.n = len(w.row)
        self.visible = w.end - w.start
        self.head = wt.flags()[w.cps[w.start]] if n else np.zeros(0, np.uint8)
        self.row_first = np.diff(w.row, prepend=-1) != 0
        self.line_first = (np.diff(w.line, prepend=-1) != 0) | self.row_first
        self.row_key = hs.mix(np.arange(w.rows))[w.row]
        upper, letters = np.bincount(w.row, w.upper, w.rows), np.bincount(w.row, w.letters, w.rows)
        self.cased = (upper > 0.5 * letters)[w.row]  # words of rows in capitals
        self.order = hs.Prefix(hs.mix(w.core))
        self.place, self.row_end = np.arange(n), np.repeat(np.cumsum(w.sizes), w.sizes)
        self.content = (self.own < 0) & (w.letters >= 3) & (w.digits == 0)

    def holding(self, bit: int) -> np.ndarray:
        """Words that hold a code point with the flag."""
        return self.at(np.flatnonzero(wt.flags()[self.w.cps] & bit))

    def at(self, positions: np.ndarray) -> np.ndarray:
        """Words that hold one of the positions, which are those of few code points."""
        out = np.zeros(self.n, bool)
        if self.n and len(positions):
            word = np.searchsorted(self.w.start, positions, side="right") - 1
            word = word[(word >= 0) & (positions < self.w.end[np.maximum(word, 0)])]
            out[word] = True
        return out

    def runs(self, size: int) -> np.ndarray:
        """A hash of the ``size`` words from each word on, 0 where the row ends before."""
        to = self.place + size
        return np.where(to <= self.row_end, self.order.spans(self.place, np.minimum(to, self.n)), 0)


def links(x: Text) -> np.ndarray:
    """Addresses, hashtags and markup with words."""
    w, c = x.w, x.w.cps
    slashes = np.flatnonzero(c == 0x2F)
    slashes = slashes[slashes > 1]
    slashes = slashes[(c[slashes - 1] == 0x2F) & (c[slashes - 2] == 0x3A)]
    url = x.at(slashes) & (x.visible > 6)
    tag = (c[w.start] == 0x23) & (w.letters > 1) if x.n else np.zeros(0, bool)
    markup = x.at(np.flatnonzero((c == 0x3C) | (c == 0x3E))) & (w.letters > 0)
    return url | tag | markup


def repeated_near(x: Text) -> np.ndarray:
    """Content words that stand again nearby."""
    return hs.together(x.w.core ^ x.row_key, x.content).near(x.n, NEAR)


def passages(x: Text, times: int) -> np.ndarray:
    """Words inside a run of ``PASSAGE`` words that stands at least ``times`` times in its row."""
    key = x.runs(PASSAGE)
    again = np.flatnonzero(hs.together(key ^ x.row_key, key != 0).times(x.n) >= times)
    hit = np.zeros(x.n + 1, np.int32)
    np.add.at(hit, again, 1)
    np.add.at(hit, np.minimum(again + PASSAGE, x.n), -1)
    return np.cumsum(hit[:-1]) > 0


def odd_words(x: Text) -> np.ndarray:
    """Words that no language writes: without vowels, letters among digits, capitals inside, overlong. Judged in Latin letters only."""
    w = x.w
    latin = ~x.holding(wt.FOREIGN)
    no_vowel = ~_has(x, wt.VOWEL) & (w.letters > 3)
    mixed = (w.letters >= 2) & (w.digits >= 2)
    inner_case = (w.upper > 0) & ~(w.capital & (w.upper == 1)) & (w.upper < w.letters) & (w.letters > 3) & (w.marks == 0)
    return latin & (no_vowel | mixed | inner_case | (w.letters + w.digits > 28)) | (w.letters + w.digits == 0) & (w.marks > 1)


def _has(x: Text, bit: int) -> np.ndarray:
    """Words that hold a frequent flag, by running counts."""
    ends = np.zeros(len(x.w.cps) + 1, np.int32)
    np.cumsum(wt.flags()[x.w.cps] & bit != 0, out=ends[1:], dtype=np.int32)
    return ends[x.w.end] > ends[x.w.start]


def titles(x: Text) -> np.ndarray:
    """Words with a capital inside a sentence; in rows in capitals only those written otherwise, in languages with capital nouns none."""
    w = x.w
    title = w.capital & np.isin(x.language, CAPITAL_NOUNS, invert=True)[w.row] & ((w.upper < w.letters) | (w.letters == 1) | ~x.cased)
    after_end = np.append(True, w.last[:-1] & wt.SENTENCE > 0)[: x.n] | x.row_first
    return title & ~after_end


def symbols(x: Text) -> np.ndarray:
    """Share of marks among the characters of each word, doubled where marks stand among letters."""
    w = x.w
    return np.minimum(w.marks / x.visible * (1 + ((w.marks >= 2) & (w.letters >= 1))), 1)


def short_lines(x: Text) -> np.ndarray:
    per_line = np.diff(np.append(np.flatnonzero(x.line_first), x.n))
    return np.repeat(np.minimum(1, 4 / per_line), per_line)


def line_values(x: Text) -> dict[str, np.ndarray]:
    """For each word what its line looks like: ends in a number, starts with a marker, ends open, has columns.

    A line has columns if two or more wide gaps, bars or semicolons
    without a blank stand between its words. It ends open if it has no closing punctuation and the next line of the
    text doesn't go on in lower case; texts in capitals have no open lines.
    """
    w, n = x.w, x.n
    first = np.flatnonzero(x.line_first)
    size = np.diff(np.append(first, n))
    last = first + size - 1
    kind = cp.classes()[w.cps[w.start[first]]]
    tail = w.last[last]
    comma = np.isin(w.cps[w.end[last] - 1], (ord(","), ord("-")))
    lower = (kind == cp.LETTER) & ~w.capital[first]
    closed = (tail & (wt.SENTENCE | wt.CLAUSE) > 0) | comma
    goes_on = np.append(lower[1:], False)
    final = np.append(w.row[first[1:]] != w.row[first[:-1]], True)
    is_open = ~closed & ~goes_on & ~final & ~x.cased[first]
    numbered = (w.digits[last] > 0) & ~closed
    marked = (x.head[first] & wt.MARKER > 0) | (kind == cp.NUMBER)
    wide = np.append(w.start[1:] - w.end[:-1] > 1, False) & ~np.append(x.line_first[1:], True)
    semicolons = np.flatnonzero(w.cps == ord(";"))
    word = np.searchsorted(w.start, semicolons, side="right") - 1
    alone = x.visible[word] == 1
    bars = (x.visible == 1) & (w.cps[w.start] == ord("|"))
    inner = np.bincount(word[(semicolons < w.end[word] - 1) | alone], minlength=n)
    columns = np.add.reduceat(wide + bars + inner, first) >= 2
    return {k: np.repeat(v, size) for k, v in (("linha_numero", numbered), ("linha_marcador", marked), ("linha_aberta", is_open), ("linha_tabela", columns))}


def order_classes(x: Text) -> np.ndarray:
    """One byte a word: its place among the function words or OUTSIDE, and BROKEN where a sentence goes wrong after it.

    That is a full stop before a lower-case word, or a capital function word
    inside a sentence and a line.
    """
    w, n = x.w, x.n
    out = np.where(x.own < 0, OUTSIDE, np.minimum(x.own, CLASSES - 1)).astype(np.uint8)
    if n < 2:
        return out
    stop = (w.last & wt.SENTENCE > 0) & (w.letters > 2)
    lower = (w.letters > 0) & ~w.capital & (cp.classes()[w.cps[w.start]] == cp.LETTER)
    inside = ~x.line_first[1:] & ~stop[:-1] & (w.last[:-1] & wt.CLAUSE == 0) & (w.letters[:-1] > 1)
    capital = w.capital[1:] & (x.own[1:] >= 0) & (w.upper[1:] < w.letters[1:])
    out[:-1][~x.row_first[1:] & stop[:-1] & lower[1:] | inside & capital] |= BROKEN
    return out


class Plan(NamedTuple):
    """The statistics of a problem, and what works them out for each word of a text (values from 0 to 1)."""

    names: tuple[str, ...]
    values: Callable[[Text], dict[str, np.ndarray]]
    around: int


class Profiles(NamedTuple):
    language: np.ndarray  # of each row
    words: np.ndarray
    classes: np.ndarray  # of each word
    cells_of: np.ndarray  # cell offsets of the rows
    table: np.ndarray  # cells x bytes: statistics, visible characters of the cell (4 bytes), its words
    totals: np.ndarray  # rows x sums of the statistics, in whole UNIT parts


def profile(t: cp.Texts, plan: Plan, sums: bool = False) -> Profiles:
    x = Text(t)
    w, k = x.w, len(plan.names)
    c = wt.cells(w, CELL, plan.around)
    table = np.zeros((len(c.first), k + EXTRA), np.uint8)
    totals = np.zeros((w.rows, k), np.int64)
    if x.n:
        values = plan.values(x)
        size = c.sums(np.ones(x.n, np.uint8))
        for j, name in enumerate(plan.names):
            v = values[name]
            # whole numbers add up to the same sum in any batch
            table[:, j] = np.rint(c.sums(v) * 255 / size) if v.dtype == bool else np.rint(c.sums(np.rint(v * 255).astype(np.uint8)) / size)
            if sums:
                totals[:, j] = np.bincount(w.row, np.rint(v * float(UNIT)), w.rows)
        table[:, k : k + 4] = np.add.reduceat(x.visible, c.first).astype("<u4").view(np.uint8).reshape(-1, 4)
        table[:, -1] = c.words
    cells_of = np.concatenate([[0], np.cumsum(-(-w.sizes // CELL))]).astype(np.int64)
    return Profiles(x.language, w.sizes, order_classes(x), cells_of, table, totals)


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())])


def profile_arrays(col: pa.Array, plan: Plan, classes: bool = True, sums: bool = False) -> list[pa.Array]:
    """[language number, words, profile] of a string column, then word classes and exact sums if asked for."""
    k = len(plan.names)
    made: list[list[pa.Array]] = []
    for _, t in cp.spans(col):
        p = profile(t, plan, sums)
        row = [pa.array(p.language.astype(np.int32)), pa.array(p.words.astype(np.int64)), _binary(p.cells_of * (k + EXTRA), p.table)]
        if classes:
            row.append(_binary(np.concatenate([[0], np.cumsum(p.words)]), p.classes))
        if sums:
            row.append(_binary(np.arange(len(p.totals) + 1) * (8 * k), p.totals))
        made.append(row)
    if not made:
        return [pa.array([], pa.int32()), pa.array([], pa.int64()), *[pa.array([], pa.binary())] * (1 + classes + sums)]
    return [pa.concat_arrays(parts) for parts in zip(*made)]


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row offsets, bytes) of a binary column without nulls."""
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int32, count=len(col) + 1, offset=col.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw


def tables_of(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of each cell, cells x ``width``) of a column of profiles."""
    at, raw = bytes_of(col)
    return np.repeat(np.arange(len(col)), np.diff(at) // width), raw.reshape(-1, width)


def characters(table: np.ndarray) -> np.ndarray:
    """Visible characters of each cell."""
    return np.ascontiguousarray(table[:, -EXTRA:-1]).view("<u4").ravel().astype(np.float64)


def sums_of(col: pa.Array, width: int) -> np.ndarray:
    """Rows x statistics, from a column of exact sums."""
    return bytes_of(col)[1].view(np.int64).reshape(-1, width)
