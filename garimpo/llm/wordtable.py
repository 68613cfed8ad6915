"""The words of a run of texts as parallel arrays, for statistics without per-word Python.

Texts are first brought to their consistent form (full-width and look-alike
letters, invisible characters), so that unusual characters change no
statistic. A word is a run without white space; its core is what is left
between its first and last letter or digit, in lower case, as a 64-bit hash.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from typing import NamedTuple

import numpy as np

from garimpo.functions import codepoints as cp
from garimpo.functions.hashing import Prefix, mix
from garimpo.llm.lookalike import canonical

# Bits of a code point's flags.
SENTENCE, CLAUSE, SEPARATOR, MARKER, VOWEL, FOREIGN, CURRENCY, SMALL = (1 << i for i in range(8))
_SETS = {
    SENTENCE: ".!?…", CLAUSE: ";:", SEPARATOR: ",;|/»•·›>", MARKER: "-–—•*·▪■□◆»>›",
    VOWEL: "aeiouyáàâãäéèêëíìîïóòôõöúùûüýæœøåAEIOUYÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÝÆŒØÅ",
}
_FIELD = 16  # bits of a counter in a packed sum


class Words(NamedTuple):
    """One entry a word, in text order; ``rows`` is the number of texts."""

    rows: int
    cps: np.ndarray
    row: np.ndarray
    sizes: np.ndarray  # words of each row
    start: np.ndarray
    end: np.ndarray
    line: np.ndarray  # number of the line in the run
    letters: np.ndarray
    digits: np.ndarray
    marks: np.ndarray  # visible characters that are neither letters nor digits
    upper: np.ndarray  # upper-case letters
    capital: np.ndarray  # the first letter or digit is an upper-case letter
    last: np.ndarray  # flags of the last code point
    core: np.ndarray  # hash of the core, 0 without letters and digits


@functools.cache
def flags() -> np.ndarray:
    """The flags of each code point."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for bit, chars in _SETS.items():
        out[[ord(c) for c in chars]] |= bit
    kind = cp.classes()
    foreign = kind == cp.LETTER
    foreign[:0x250] = False
    foreign[0x1E00:0x1F00] = False
    out[foreign] |= FOREIGN
    out[[i for i in range(0x24, 0x20D0) if unicodedata.category(chr(i)) == "Sc"]] |= CURRENCY
    out[[i for i in np.flatnonzero(kind == cp.LETTER).tolist() if chr(i).islower()]] |= SMALL
    return out


@functools.cache
def _folds() -> tuple[np.ndarray, np.ndarray]:
    """(a random number for each code point, the same for both cases; packed counters: letter, digit, upper case, combining mark)."""
    low = np.arange(sys.maxunicode + 1, dtype=np.uint64)
    kind = cp.classes()
    packed = (kind == cp.LETTER).astype(np.uint64) + ((kind == cp.NUMBER).astype(np.uint64) << np.uint64(_FIELD))
    packed += (kind == cp.MARK).astype(np.uint64) << np.uint64(3 * _FIELD)
    for i in np.flatnonzero(kind == cp.LETTER).tolist():
        c = chr(i)
        x = c.lower()
        if x != c and len(x) == 1:  # one-to-one folds only
            low[i] = ord(x)
            packed[i] += np.uint64(1 << 2 * _FIELD)
    return mix(low), packed


def hash_word(word: str) -> int:
    codes = np.array([ord(c) for c in word], np.uint32)
    return int(Prefix(_folds()[0][codes]).spans(np.array([0]), np.array([len(word)]))[0])


def word_table(t: cp.Texts) -> Words:
    cps, off = canonical(t.cps, t.off, lines=True)
    form = cp.Texts(t.raw, t.byte_off, cps, off, t.valid)
    start, end, row = cp.words(form)
    n = len(cps)
    number, packed = _folds()
    each = packed[cps]
    ends = np.zeros(n + 1, np.uint64)
    np.cumsum(each, out=ends[1:])
    total = ends[end] - ends[start]
    field = np.uint64((1 << _FIELD) - 1)
    letters, digits, upper, combining = ((total >> np.uint64(k * _FIELD) & field).astype(np.int64) for k in range(4))
    for i in np.flatnonzero(end - start > int(field)):  # beyond a packed counter
        part = each[start[i] : end[i]]
        letters[i], digits[i], upper[i], combining[i] = (int((part >> np.uint64(k * _FIELD) & field).sum()) for k in range(4))
    inner = (each & np.uint64(1 | 1 << _FIELD)) > 0
    places = np.append(np.flatnonzero(inner), n)
    before = np.zeros(len(start) + 1, np.int64)
    np.cumsum(letters + digits, out=before[1:])  # letters and digits stand in words only
    first, has = places[before[:-1]], letters + digits > 0
    last = np.where(has, places[np.maximum(before[1:] - 1, 0)] + 1, first)
    head = np.minimum(first, max(n - 1, 0))
    broken = np.flatnonzero(cps == 0xA)
    sizes = np.bincount(row, minlength=t.rows)
    return Words(
        t.rows, cps, row, sizes, start, end, _lines(start, broken, row),
        letters, digits, (end - start) - letters - digits - combining, upper,
        has & ((each[head] >> np.uint64(2 * _FIELD)) & field > 0) if n else has,
        flags()[cps[end - 1]], Prefix(number[cps]).spans(np.where(has, first, 0), np.where(has, last, 0)),
    )


def _lines(start: np.ndarray, breaks: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Number of the line of each word; every row starts a line."""
    step = np.zeros(len(start) + 1, np.int64)
    np.add.at(step, np.searchsorted(start, breaks), 1)
    return np.cumsum(step[:-1]) + row


class Cells(NamedTuple):
    """Runs of ``size`` words of a row; windows reach ``around`` cells to both sides within the row."""

    first: np.ndarray  # first word of each cell
    row: np.ndarray
    words: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sum of a per-word whole number over each cell's window."""
        if len(self.first) == 0:
            return np.zeros(0)
        ends = np.zeros(len(self.first) + 1, np.int64)
        np.cumsum(np.add.reduceat(x, self.first, dtype=np.int64), out=ends[1:])
        return ends[self.hi] - ends[self.lo]


def cells(w: Words, size: int, around: int) -> Cells:
    each = -(-w.sizes // size)
    row = np.repeat(np.arange(w.rows), each)
    begin = np.concatenate([[0], np.cumsum(w.sizes)[:-1]]) if w.rows else w.sizes
    from_cell = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
    index = np.arange(len(row))
    first = begin[row] + (index - from_cell[row]) * size
    lo = np.maximum(index - around, from_cell[row])
    hi = np.minimum(index + around + 1, from_cell[row + 1])
    return Cells(first, row, np.diff(np.append(first, len(w.row))), lo, hi)
