"""Problem 2: one consistent form for texts that look the same.

A run of texts is one array of code points. Lookup tables give for every code
point the sequence it looks like (width forms, ligatures and Roman numerals
spelled out, look-alike letters of other alphabets, canonical decomposition,
nothing for characters that aren't displayed, a blank for white space);
expansion offsets place the sequences, marks are put in canonical order and
composed by binary search over the sorted composition pairs, and runs of
blanks shrink to one. No string function is called for a row.

Case, accents, digits and punctuation keep their differences. Null stays null;
empty and blank texts become empty and are in no pair. Repeated rows of one key
count once; a key isn't paired with itself.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.functions import codepoints as cp
from garimpo.workdir import materialize

# Letters of other alphabets drawn like Latin ones (or, for the last pair, like each other).
LOOKALIKE = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "α": "a", "ι": "ı", "υ": "u", "γ": "y",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѵ": "V", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I", "Ү": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ѵ": "v",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ү": "y", "ɡ": "g",
    # Armenian
    "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P",
    "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M",
    "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "κ": "ĸ", "к": "ĸ",
}
# Ranges that Unicode calls default ignorable beyond the format characters.
IGNORABLE = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF))
# Roman numerals, ligatures, mathematical letters and digits but for script, Fraktur and double-struck ones.
SPELLED_OUT = ((0x2160, 0x217F), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x1D400, 0x1D49B), (0x1D5A0, 0x1D6A5), (0x1D6A8, 0x1D7CB), (0x1D7CE, 0x1D7D7), (0x1D7E2, 0x1D7FF))
LINE_BREAKS = (0xA, 0xB, 0xC, 0xD, 0x85, 0x2028, 0x2029)
_WIDTHS = ("<wide>", "<narrow>", "<noBreak>")
_CODES = sys.maxunicode + 1
_L, _V, _T, _S = 0x1100, 0x1161, 0x11A7, 0xAC00  # Hangul syllables compose by arithmetic


def _spell(char: str) -> str:
    """What one character looks like, decomposed."""
    code = ord(char)
    tag, _, rest = unicodedata.decomposition(char).partition(" ")
    if tag in _WIDTHS or any(a <= code <= b for a, b in SPELLED_OUT):
        return "".join(_spell(chr(int(x, 16))) for x in rest.split())
    return "".join(LOOKALIKE.get(c, c) for c in unicodedata.normalize("NFD", char))


@functools.cache
def _expansions() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length and offset of the composed sequence of each code point, the same decomposed, pool of sequences).

    Offset -1 marks a code point that stands for itself. Composed sequences
    serve where no mark follows, so that most text needs no composition.
    """
    length, offset = np.ones((2, _CODES), np.int64), np.full((2, _CODES), -1, np.int64)
    pool: list[int] = []
    kinds = cp.classes()
    hidden = (kinds == cp.FORMAT) | (kinds == cp.CONTROL)
    for a, b in IGNORABLE:
        hidden[a : b + 1] = True
    length[:, hidden] = 0
    offset[:, hidden] = 0
    folded = set(map(ord, LOOKALIKE))
    seen = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in cp.assigned()[0x80:]]
    apart = unicodedata.normalize("NFKD", "\0".join(seen)).split("\0")  # all that has a decomposition of any kind
    changes = [ord(c) for c, x in zip(seen, apart) if (c != x or ord(c) in folded) and not hidden[ord(c)]]
    for i in changes:
        spelled = "".join(c for c in _spell(chr(i)) if not hidden[ord(c)])
        for k, seq in enumerate((unicodedata.normalize("NFC", spelled), spelled)):
            if seq != chr(i):
                length[k, i], offset[k, i] = len(seq), len(pool)
                pool += map(ord, seq)
    for i in cp.WHITE_SPACE:
        length[:, i], offset[:, i] = 1, len(pool)
        pool.append(0x20)
    return *(x for k in (0, 1) for x in (length[k], offset[k])), np.array(pool or [0], np.uint32)


@functools.cache
def _leads() -> np.ndarray:
    """Code points whose sequence starts with one that can attach to what stands before."""
    _, _, length, offset, pool = _expansions()
    _, follows, _, _ = _marks()
    return np.where(offset < 0, follows, follows[pool[np.maximum(offset, 0)]] & (length > 0))


@functools.cache
def _marks() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(combining class and follower flag for each code point, sorted pair keys, products)."""
    order, follows, pairs = np.zeros(_CODES, np.uint8), np.zeros(_CODES, bool), []
    for i in np.flatnonzero(cp.classes() == cp.MARK).tolist():
        order[i] = unicodedata.combining(chr(i))
    follows[order > 0] = True
    for i in cp.assigned()[0xC0:]:
        d = unicodedata.decomposition(chr(i))
        if d and d[0] != "<" and " " in d:
            a, b = (int(x, 16) for x in d.split())
            if unicodedata.normalize("NFC", chr(a) + chr(b)) == chr(i):  # not excluded from composition
                pairs.append((a << 21 | b, i))
                follows[b] = True
    follows[_V : _V + 21] = True
    follows[_T + 1 : _T + 28] = True
    table = np.array(sorted(pairs), np.int64)
    return order, follows, table[:, 0], table[:, 1]


def _compose_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The composed character of each pair, or 0."""
    _, _, keys, products = _marks()
    key = (a.astype(np.int64) << 21) | b
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    out = np.where(keys[at] == key, products[at], 0)
    lead, vowel = a.astype(np.int64) - _L, b.astype(np.int64) - _V
    syllable = (0 <= lead) & (lead < 19) & (0 <= vowel) & (vowel < 21)
    out = np.where(syllable, _S + (lead * 21 + vowel) * 28, out)
    block, tail = a.astype(np.int64) - _S, b.astype(np.int64) - _T
    closed = (0 <= block) & (block < 11172) & (block % 28 == 0) & (0 < tail) & (tail < 28)
    return np.where(closed, a.astype(np.int64) + tail, out)


def compose(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition of decomposed code points (NFC of decomposed text)."""
    order, follows, _, _ = _marks()
    n = len(cps)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    attached = follows[cps] & ~(edge[:n] & (order[cps] == 0))
    if not attached.any():
        return cps, off
    cps = cps.copy()
    head = np.flatnonzero(attached & (edge[:n] | ~np.append(False, attached[:-1])))  # first follower of each run
    tail = np.flatnonzero(attached & (edge[1:] | ~np.append(attached[1:], False))) + 1
    several = np.flatnonzero(tail - head > 1)
    if len(several):
        place = cp.gather(head[several], (tail - head)[several])
        run = np.repeat(several, (tail - head)[several])
        ccc = order[cps[place]]
        barrier = np.cumsum(ccc == 0)  # a follower of class 0 isn't moved, nor anything across it
        cps[place] = cps[place][np.lexsort((ccc, barrier, run))]
    # class of the last mark left after the base; -1: none, 256: the row starts with marks and has no base
    base, kept = np.maximum(head - 1, 0), np.where(edge[head], 256, -1)
    drop = np.zeros(n, bool)
    live, step = np.arange(len(head)), 0
    while len(live):
        place = head[live] + step
        ccc = order[cps[place]].astype(np.int64)
        blocked = np.where(ccc == 0, kept[live] != -1, kept[live] >= ccc) & (kept[live] != -1)
        made = np.where(blocked, 0, _compose_pairs(cps[base[live]], cps[place]))
        done = made > 0
        cps[base[live[done]]] = made[done]
        drop[place[done]] = True
        stay = ~done
        kept[live[stay]] = np.maximum(kept[live[stay]], ccc[stay])
        starter = stay & (ccc == 0)
        base[live[starter]] = place[starter]
        kept[live[starter]] = -1
        step += 1
        live = live[head[live] + step < tail[live]]
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(~drop, out=ends[1:])
    return cps[~drop], ends[off]


@functools.cache
def _changed() -> np.ndarray:
    """Code points that don't stand for themselves or can attach to what stands before; blanks and line feeds are none."""
    length, offset, _, _, _ = _expansions()
    out = (length != 1) | (offset >= 0) | _leads()
    out[[0xA, 0x20]] = False
    return out


def _expanded(cps: np.ndarray, off: np.ndarray, lines: bool) -> tuple[np.ndarray, np.ndarray]:
    """Every code point replaced by what it looks like, marks composed."""
    length, offset, whole_length, whole_offset, pool = _expansions()
    width, origin = length[cps], offset[cps]
    joins = _leads()[cps]
    if joins.any():
        shown = np.flatnonzero(width > 0)
        based = shown[:-1][joins[shown[1:]]]
        width[based], origin[based] = whole_length[cps[based]], whole_offset[cps[based]]
        width[joins], origin[joins] = whole_length[cps[joins]], whole_offset[cps[joins]]
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    if ends[-1] == len(cps) and (width == 1).all():
        out = np.where(origin < 0, cps, pool[np.maximum(origin, 0)])
    else:
        source = np.repeat(np.arange(len(cps)), width)
        inside = np.arange(ends[-1]) - ends[source]
        own = origin[source]
        out = np.where(own < 0, cps[source], pool[np.maximum(own, 0) + inside * (own >= 0)])
    if lines:
        out[ends[:-1][np.isin(cps, LINE_BREAKS)]] = 0xA
    return compose(out.astype(np.uint32), ends[off])


def _shown(cps: np.ndarray, off: np.ndarray, lines: bool) -> tuple[np.ndarray, np.ndarray]:
    """``_expanded``, but only rows with a code point to change are worked on."""
    at = np.flatnonzero(_changed()[cps])
    if len(at) == 0:
        return cps, off
    dirty = np.zeros(len(off) - 1, bool)
    dirty[np.searchsorted(off, at, side="right") - 1] = True
    if dirty.all():
        return _expanded(cps, off, lines)
    size = np.diff(off)
    inside = np.repeat(dirty, size)
    part, ends = _expanded(cps[inside], np.concatenate([[0], np.cumsum(size[dirty])]), lines)
    size[dirty] = np.diff(ends)
    made = np.repeat(dirty, size)
    out = np.empty(len(made), np.uint32)
    out[made], out[~made] = part, cps[~inside]
    return out, np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def canonical(cps: np.ndarray, off: np.ndarray, lines: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of a run of texts: (code points, row offsets).

    With ``lines`` each line break becomes U+000A and blanks are left as they are.
    """
    out, off = _shown(cps, off, lines)
    if lines:
        return out, off
    blank = (out == 0x20) | (out == 0xA)
    first = np.zeros(len(out) + 1, bool)
    first[off] = True
    drop = np.zeros(len(out), bool)
    drop[1:] = blank[1:] & blank[:-1]
    drop |= blank & first[:-1]
    # blanks at the end of a row; a row of blanks only is gone already, or has its first blank left
    last = off[1:][off[1:] > off[:-1]] - 1
    kept = np.flatnonzero(~drop)
    if len(kept) and len(last):
        final = kept[np.maximum(np.searchsorted(kept, last, side="right") - 1, 0)]
        drop[final[blank[final]]] = True
    out = np.where(out == 0xA, np.uint32(0x20), out)
    if not drop.any():
        return out, off
    gone = np.flatnonzero(drop)
    return out[~drop], off - np.searchsorted(gone, off)


def canonical_arrow(col: pa.Array) -> pa.Array:
    """The consistent form of a string column; null stays null."""
    parts = [cp.to_arrow(*canonical(t.cps, t.off), t.valid) for _, t in cp.spans(col)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def with_consistent_form(df: DataFrame, text: str, keep: list[str], out: str = "forma") -> DataFrame:
    """The ``keep`` columns, the text and its consistent form; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keep, "__text", out]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, canonical_arrow(batch.column(len(keep)))], names)

    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField("__text", T.StringType()), T.StructField(out, T.StringType())])
    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def looks(parts: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(tabela, forma, escrita, chave) of every text shown of the tables (name, rows, key, text): digests of 128 bits of its form and of its spelling.

    Only these digests are ever shuffled.
    """
    made = []
    for name, df, key, text in parts:
        formed = with_consistent_form(df.where(F.col(key).isNotNull() & (F.length(text) > 0)), text, [key]).where(F.length("forma") > 0)
        digest = [F.substring(F.unhex(F.sha2(c, 256)), 1, 16).alias(n) for c, n in (("forma", "forma"), ("__text", "escrita"))]
        made.append(formed.select(F.lit(name).alias("tabela"), *digest, F.col(key).cast("string").alias("chave")))
    return materialize(functools.reduce(DataFrame.unionByName, made), "formas")


_CLASS = ["tabela", "forma"]


def classes(seen: DataFrame) -> DataFrame:
    """The distinct rows of ``looks`` whose form has several spellings; a form with one costs one row."""
    several = seen.groupBy(*_CLASS).agg(F.min("escrita").alias("a"), F.max("escrita").alias("b")).where("a != b").select(*_CLASS)
    return materialize(seen.join(several, _CLASS, "left_semi").distinct(), "grupos")


def membership(members: DataFrame) -> DataFrame:
    """One row for each key (and spelling) of a class: (tabela, chave, classe, representante, copias).

    ``representante`` is the first key of the same spelling, ``classe`` the first key of the class, ``copias`` the keys of the spelling.
    """
    spelled = members.groupBy(*_CLASS, "escrita").agg(F.min("chave").alias("representante"), F.count("*").alias("copias"))
    first = spelled.groupBy(*_CLASS).agg(F.min("representante").alias("classe"))
    return members.join(spelled.join(first, _CLASS), [*_CLASS, "escrita"]).select("tabela", "chave", "classe", "representante", "copias")


def pairs(members: DataFrame) -> DataFrame:
    """(tabela, chave_a, chave_b) of different keys of a class in different spellings.

    Pairs are made between spellings first, so that exact copies meet only the keys of another spelling.
    """
    own = members.select(*_CLASS, "escrita").distinct()
    variants = own.withColumnRenamed("escrita", "a").join(own.withColumnRenamed("escrita", "b"), _CLASS).where("a < b")
    left, right = members.toDF(*_CLASS, "a", "k"), members.toDF(*_CLASS, "b", "m")
    found = variants.join(left, [*_CLASS, "a"]).join(right, [*_CLASS, "b"]).where(F.col("k") != F.col("m"))
    return found.select("tabela", F.least("k", "m").alias("chave_a"), F.greatest("k", "m").alias("chave_b")).distinct()


def equal_looking_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(chave_a, chave_b) of different keys whose texts look the same but differ in code points."""
    return pairs(classes(looks([("", df, key, text)]))).drop("tabela")
