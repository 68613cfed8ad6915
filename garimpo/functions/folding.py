"""Index terms of a run of texts without per-row Python: NFC, full case folding, runs of letters and numbers.

Texts whose code points may change under canonical composition are normalised together in one call; folding is a table of sequences, and terms are spans of one code-point array known by a hash that is checked.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from garimpo.functions import codepoints as cp
from garimpo.functions import hashing as hs


@functools.cache
def _folds() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(may change under NFC, length and offset of the folded sequence of each code point, pool of sequences).

    All characters are composed and folded in one call each, with NULs between them.
    """
    n = sys.maxunicode + 1
    length, offset, unsure = np.ones(n, np.int64), np.arange(n), np.zeros(n, bool)
    chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in cp.assigned()]
    chars[0] = " "
    text = "\0".join(chars)
    unsure[[i for i, (c, x) in enumerate(zip(chars, unicodedata.normalize("NFC", text).split("\0"))) if c != x]] = True
    unsure[[i for i in np.flatnonzero(cp.classes() == cp.MARK).tolist() if unicodedata.combining(chr(i))]] = True
    unsure[0x1161:0x1176] = unsure[0x11A8:0x11C3] = True
    # second parts of compositions: what a decomposed character holds beyond its first
    for c, x in zip(chars, unicodedata.normalize("NFD", text).split("\0")):
        if len(x) > 1:
            unsure[[ord(y) for y in x[1:]]] = True
    pool: list[int] = []
    for i, (c, x) in enumerate(zip(chars, text.casefold().split("\0"))):
        if c != x:
            length[i], offset[i] = len(x), n + len(pool)
            pool += map(ord, x)
    return unsure, length, offset, np.concatenate([np.arange(n, dtype=np.uint32), np.array(pool, np.uint32)])


def composed(t: cp.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row offsets) of the texts in NFC."""
    unsure, _, _, _ = _folds()
    doubt = np.flatnonzero(unsure[t.cps])
    if len(doubt) == 0:
        return t.cps, t.off
    # only rows with a code point that may compose or decompose: together, a NUL between them
    rows = np.unique(np.searchsorted(t.off, doubt, side="right") - 1)
    size = np.diff(t.off)
    inside = np.zeros(t.rows, bool)
    inside[rows] = True
    places = cp.gather(t.off[rows], size[rows] + 1)
    ends = np.cumsum(size[rows] + 1)
    raw = t.cps[np.minimum(places, len(t.cps) - 1)].copy()
    text_rows = np.repeat(inside, size)
    raw[ends - 1] = 0
    made = np.frombuffer(unicodedata.normalize("NFC", raw.astype("<u4").tobytes().decode("utf-32-le")).encode("utf-32-le"), np.uint32)
    stops = np.flatnonzero(made == 0)
    if len(stops) != len(rows):  # NULs in the texts: each row has as many as before
        before = np.cumsum(np.bincount(np.searchsorted(ends, np.flatnonzero(raw == 0), side="right"), minlength=len(rows)))
        stops = stops[before - 1]
    size[rows] = np.diff(stops, prepend=-1) - 1
    keep = np.ones(len(made), bool)
    keep[stops] = False
    out_rows = np.repeat(inside, size)
    out = np.empty(len(out_rows), np.uint32)
    out[out_rows], out[~out_rows] = made[keep], t.cps[~text_rows]
    return out, np.concatenate([[0], np.cumsum(size)])


def folded(t: cp.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row offsets) of the texts in NFC and folded."""
    _, length, offset, pool = _folds()
    cps, off = composed(t)
    width = length[cps]
    origin = offset[cps]
    if (width == 1).all():
        return pool[origin], off
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    source = np.repeat(np.arange(len(cps)), width)
    return pool[origin[source] + np.arange(ends[-1]) - ends[source]], ends[off]


def term_spans(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each longest run of letters and numbers."""
    kind = cp.classes()[cps]
    return cp.runs((kind == cp.LETTER) | (kind == cp.NUMBER), off)


def spans_to_arrow(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as strings."""
    length = end - start
    return cp.to_arrow(cps[cp.gather(start, length)], np.concatenate([[0], np.cumsum(length)]))


class Terms(NamedTuple):
    """Distinct terms (of a group): their text, group, number of rows that hold them and of occurrences."""

    text: pa.Array
    group: np.ndarray
    rows: np.ndarray
    times: np.ndarray


def count_terms(t: cp.Texts, group: np.ndarray) -> Terms:
    """Terms of the texts, counted within each number of ``group`` (one a row)."""
    cps, off = folded(t)
    start, end, row = term_spans(cps, off)
    n = len(start)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Terms(pa.array([], pa.string()), none, none, none)
    of = group[row]
    key = hs.Prefix(hs.numbers()[cps]).spans(start, end) ^ hs.mix(of)
    found = hs.together(key, np.ones(n, bool))
    place = found.place
    new = np.append(True, ~found.same)
    first = np.flatnonzero(new)
    # terms of one key are the same term: checked code point by code point against the first of them
    head = np.repeat(place[first], np.diff(np.append(first, n)))
    size = end[place] - start[place]
    same = (of[head] == of[place]) & (end[head] - start[head] == size)
    if not same.all() or (cps[cp.gather(start[place], size)] != cps[cp.gather(start[head], size)]).any():
        return _plainly(cps, start, end, row, of)
    rows = np.add.reduceat(new | (np.diff(row[place], prepend=-1) != 0), first, dtype=np.int64)
    one = place[first]
    return Terms(spans_to_arrow(cps, start[one], end[one]), of[one], rows, np.diff(np.append(first, n)))


def _plainly(cps: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, of: np.ndarray) -> Terms:
    """The same for a run of texts in which two terms have one hash."""
    seen: dict[tuple[int, bytes], list[int]] = {}
    for a, b, r, g in zip(start, end, row, of):
        count = seen.setdefault((int(g), cps[a:b].tobytes()), [0, 0, -1])
        count[0] += count[2] != r
        count[1] += 1
        count[2] = r
    text = pa.array([k.decode("utf-32-le") for _, k in seen], pa.string())
    return Terms(text, np.array([g for g, _ in seen]), np.array([c[0] for c in seen.values()]), np.array([c[1] for c in seen.values()]))
