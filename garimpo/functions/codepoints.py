"""Arrow string columns as flat numpy code-point arrays, and back.

A batch of texts is handled as one array of code points with row offsets, so
that lookups, run detection and cuts are array operations over the whole
batch. Only one decode and one encode call is made for a batch, none per row.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPAN_BYTES = 2 << 20

# The code points of the Unicode property White_Space.
WHITE_SPACE = (
    0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006,
    0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
OTHER, LETTER, NUMBER, SPACE, MARK, CONTROL, FORMAT, PUNCT = range(8)


class Texts(NamedTuple):
    """A run of rows: UTF-8 bytes, byte offsets, code points, code-point offsets."""

    raw: np.ndarray
    byte_off: np.ndarray
    cps: np.ndarray
    off: np.ndarray
    valid: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.off) - 1


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    n = len(col)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    step = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, step, count=n + 1, offset=col.offset * np.dtype(step).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def spans(col: pa.Array | pa.ChunkedArray, limit: int = SPAN_BYTES) -> Iterator[tuple[int, Texts]]:
    """Cut a string column into runs of rows of about ``limit`` bytes; yields (first row, Texts).

    Null rows come out as empty texts that aren't ``valid``. A row beyond the
    limit is a run of its own, never cut.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    valid = ~np.asarray(col.is_null()) if col.null_count else np.ones(len(col), bool)
    if col.null_count:
        col = col.fill_null("")
    raw, at = _buffers(col)
    first = 0
    while first < len(at) - 1:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(at) - 1)
        part = raw[at[first] : at[last]]
        byte_off = at[first : last + 1] - at[first]
        cps = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        inner = np.flatnonzero((part & 0xC0) == 0x80) if len(cps) < len(part) else np.zeros(0, np.int64)
        yield first, Texts(part, byte_off, cps, byte_off - np.searchsorted(inner, byte_off), valid[first:last])
        first = last


def mapped(col: pa.Array | pa.ChunkedArray, work: Callable[[Texts], pa.Array], kind: pa.DataType) -> pa.Array:
    """``work`` over the runs of rows of a string column, put together; null rows come as empty texts."""
    parts = [work(t).cast(kind) for _, t in spans(col)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def to_arrow(cps: np.ndarray, off: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse of ``spans`` for one run of rows."""
    raw = cps.astype("<u4", copy=False).tobytes().decode("utf-32-le").encode("utf-8")
    width = np.ones(len(cps), np.int8)
    for edge in (0x80, 0x800, 0x10000):
        width += cps >= edge
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    at = ends[off]
    text = pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)])
    if valid is not None and not valid.all():
        text = pa.compute.if_else(pa.array(valid), text, pa.scalar(None, pa.large_string()))
    return text.cast(pa.string()) if at[-1] < 2**31 else text


def assigned() -> range:
    """The code points up to the last plane with letters; beyond it there are only unassigned and private ones and format characters."""
    return range(0x40000)


@functools.cache
def classes() -> np.ndarray:
    """One class for each code point, from the general categories."""
    by = {"L": LETTER, "N": NUMBER, "M": MARK, "P": PUNCT}
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for part in (assigned(), range(0xE0000, 0xE1000)):
        names = map(unicodedata.category, map(chr, part))
        out[part.start : part.stop] = np.fromiter((by.get(c[0], FORMAT if c == "Cf" else CONTROL if c == "Cc" else OTHER) for c in names), np.uint8, len(part))
    out[list(WHITE_SPACE)] = SPACE
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the concatenated spans [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def runs(ink: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each longest run of flagged code points within a row."""
    edge = row_starts(len(ink), off)
    begins, ends = edge[:-1].copy(), edge[1:].copy()  # a run at the edge of a row touches that of its neighbour
    begins[1:] |= ~ink[:-1]
    ends[:-1] |= ~ink[1:]
    start, end = np.flatnonzero(ink & begins), np.flatnonzero(ink & ends) + 1
    return start, end, np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))


def words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each longest run of characters without white space."""
    return runs(~spaces()[t.cps], t.off)


@functools.cache
def python_spaces() -> np.ndarray:
    """Whether ``str.isspace`` holds for each code point: white space and the four separators before it."""
    out = classes() == SPACE
    out[0x1C:0x20] = True
    return out


def kept(cps: np.ndarray, off: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts without the flagged code points."""
    at = np.flatnonzero(gone)
    return (cps, off) if len(at) == 0 else (cps[~gone], off - np.searchsorted(at, off))


def row_starts(n: int, off: np.ndarray) -> np.ndarray:
    """Flags of the first code point of each row, and one more for the end."""
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    return edge


@functools.cache
def spaces() -> np.ndarray:
    """Whether each code point is white space."""
    return classes() == SPACE
