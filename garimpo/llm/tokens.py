"""Problem 6: token ids of a whole corpus under a public byte-level BPE.

Whole batches are encoded with array operations. Code points are classed by a
lookup table, the pre-token cuts follow from class changes, equal words are
found by a 64-bit hash that is verified byte by byte, and only words not seen
before are merged: their bytes stand in one flat array, and in every round the
adjacent pairs of all words are looked up by binary search over the sorted pair
keys, and each word merges its lowest-ranked pair.

Null and empty texts have an empty list of ids. Special tokens are never
produced: their strings are ordinary text. Rows are independent, so repeated
rows, ties and extra columns pass through; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.functions import codepoints as cp

TOKENIZERS = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k"
SEEN_WORDS = 150_000  # words whose ids a Python worker remembers
LONG_TEXT = 1 << 20  # code points encoded at once of a single long text
_SHIFT = np.int64(20)
_NONE = np.int64(1) << 40


class Merges(NamedTuple):
    """Pair keys in ascending order with their rank and product; ids of the 256 bytes."""

    keys: np.ndarray
    rank: np.ndarray
    product: np.ndarray
    byte_ids: np.ndarray


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level BPE files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(4)
def load_merges(name: str = DEFAULT, folder: str = TOKENIZERS) -> Merges:
    """Merge tables of a byte-level BPE file ``<folder>/<name>.json``."""
    with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, rows = model["vocab"], []
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        rows.append((vocab[left] << int(_SHIFT) | vocab[right], rank, vocab[left + right]))
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    byte_ids = np.zeros(256, np.int64)
    for char, byte in byte_alphabet().items():
        byte_ids[byte] = vocab[char]
    return Merges(*map(np.ascontiguousarray, table.T), byte_ids)


@functools.cache
def _pattern_classes() -> np.ndarray:
    """Letters, numbers, white space and the rest, as the split pattern sees them."""
    table = cp.classes().copy()
    table[table >= cp.MARK] = cp.OTHER
    return table


def pretoken_starts(t: cp.Texts) -> np.ndarray:
    """Code points at which the split pattern of byte-level BPE starts a piece."""
    cps, n = t.cps, len(t.cps)
    start = np.zeros(n + 1, bool)
    if n == 0:
        return start[:n]
    kind = _pattern_classes()[cps]
    edge = np.zeros(n + 1, bool)
    edge[t.off] = True
    start[1:n] = kind[1:] != kind[:-1]
    start |= edge
    # one white-space character before a visible run is split off its own run; a blank joins the visible one
    visible = np.flatnonzero(start[:n] & ~edge[:n] & (kind != cp.SPACE))
    after = visible[kind[visible - 1] == cp.SPACE]
    start[after - 1] = True
    start[after[cps[after - 1] == 0x20]] = False
    # contractions: an apostrophe that starts a piece of its own takes one or two letters
    quote = np.flatnonzero((cps == 0x27) & start[:n])
    if len(quote):
        ahead = np.concatenate([cps, np.zeros(2, cps.dtype)])
        last = np.append(edge, [True, True])
        one, two = ahead[quote + 1], ahead[quote + 2]
        in_row = ~last[quote + 1]
        short = in_row & np.isin(one, [ord(c) for c in "stmd"])
        long = in_row & ~last[quote + 2] & np.isin(one * np.uint32(256) + two, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
        for hit, width in ((short, 2), (long, 3)):
            start[quote[hit] + 1] = False
            start[quote[hit] + width] = True
    return start[:n]


def slices(t: cp.Texts, limit: int) -> Iterator[cp.Texts]:
    """A run of rows as it is, or one long text in parts of about ``limit`` code points that encode as the whole does.

    A blank between two visible characters starts a piece whatever stands
    around it, so the text may be cut before it.
    """
    if t.rows != 1 or len(t.cps) <= 2 * limit:
        yield t
        return
    space = _pattern_classes()[t.cps] == cp.SPACE
    cuts = np.flatnonzero((t.cps[1:-1] == 0x20) & ~space[:-2] & ~space[2:]) + 1
    wanted = np.arange(limit, len(t.cps), limit)
    cuts = np.unique(cuts[np.minimum(np.searchsorted(cuts, wanted), len(cuts) - 1)]) if len(cuts) else cuts
    lead = np.flatnonzero((t.raw & 0xC0) != 0x80)
    edges = np.concatenate([[0], cuts, [len(t.cps)]])
    bytes_at = np.append(lead, len(t.raw))[edges]
    for a, b, x, y in zip(edges[:-1], edges[1:], bytes_at[:-1], bytes_at[1:]):
        yield cp.Texts(t.raw[x:y], np.array([0, y - x]), t.cps[a:b], np.array([0, b - a]), t.valid)


def merge_words(raw: np.ndarray, lengths: np.ndarray, m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words whose bytes stand one after the other; (ids, ids per word).

    A round merges, in every word at once, all places of the word's lowest
    pair from left to right; words without a known pair leave the rounds.
    """
    ids = m.byte_ids[raw]
    word = np.repeat(np.arange(len(lengths)), lengths)
    done_ids, done_word = [], []
    while len(ids):
        key = (ids[:-1] << _SHIFT) | ids[1:]
        at = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
        rank = np.where((m.keys[at] == key) & (word[:-1] == word[1:]), m.rank[at], _NONE)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        best = np.minimum.reduceat(np.append(rank, _NONE), first)
        index = np.cumsum(np.diff(word, prepend=word[0]) != 0)
        idle = (best == _NONE)[index]
        if idle.any():
            done_ids.append(ids[idle])
            done_word.append(word[idle])
        hit = np.flatnonzero((rank == best[index[:-1]]) & (rank != _NONE))
        if len(hit) == 0:
            break
        # of overlapping places (a a a) every second one, from the left
        fresh = np.diff(hit, prepend=-9) != 1
        run = np.flatnonzero(fresh)
        parity = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
        hit = hit[parity % 2 == 0]
        ids[hit] = m.product[at[hit]]
        keep = ~idle
        keep[hit + 1] = False
        ids, word = ids[keep], word[keep]
    if not done_ids:
        return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
    ids, word = np.concatenate(done_ids), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return ids[order], np.bincount(word, minlength=len(lengths))


class Encoder:
    """Encodes runs of texts; remembers the ids of the words it has seen."""

    def __init__(self, merges: Merges, seen: int = SEEN_WORDS):
        self.merges, self.limit = merges, seen
        self.known: dict[bytes, int] = {}
        self.ids, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _distinct(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first places of distinct words, index of each word's distinct word), verified bytewise."""
        salt = np.random.default_rng(len(raw)).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
        step = np.uint64(0x9E3779B97F4A7C15)
        power = np.cumprod(np.full(int(length.max()), step, np.uint64))
        flat = cp.gather(start, length)
        inside = flat - np.repeat(start, length)
        part = salt[raw[flat]] * power[inside]
        digest = np.add.reduceat(part, np.cumsum(length) - length) + length.astype(np.uint64) * salt[0]
        _, first, index = np.unique(digest, return_index=True, return_inverse=True)
        model = first[index]
        same = length == length[model]
        place = np.minimum(np.repeat(start[model], length) + inside, len(raw) - 1)
        differs = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(raw[flat] != raw[place], out=differs[1:])
        ends = np.cumsum(length)
        same &= differs[ends] == differs[ends - length]
        if not same.all():  # words of equal hash: each stands for itself
            odd = np.flatnonzero(~same)
            index = index.copy()
            index[odd] = len(first) + np.arange(len(odd))
            first = np.concatenate([first, odd])
        return first, index

    def encode(self, t: cp.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each word in ``ids``, row boundaries among words, ids per word) for one run."""
        starts = np.flatnonzero(pretoken_starts(t))
        bounds = np.searchsorted(starts, t.off)
        if len(starts) == 0:
            return starts, bounds, starts
        lead = np.flatnonzero((t.raw & 0xC0) != 0x80)
        begin = lead[starts]
        length = np.diff(np.append(begin, len(t.raw)))
        first, index = self._distinct(t.raw, begin, length)
        if len(self.known) > self.limit:
            self.known, self.ids, self.counts = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
        text, lo, hi = t.raw.tobytes(), begin[first].tolist(), (begin[first] + length[first]).tolist()
        names = [text[a:b] for a, b in zip(lo, hi)]
        new = [k for k, w in enumerate(names) if w not in self.known]
        if new:
            fresh = first[new]
            ids, counts = merge_words(t.raw[cp.gather(begin[fresh], length[fresh])], length[fresh], self.merges)
            base = len(self.counts)
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            for i, k in enumerate(new):
                self.known[names[k]] = base + i
        known = self.known
        place = np.fromiter((known[w] for w in names), np.int64, len(names))
        return place[index], bounds, self.counts[place[index]]

    def id_lists(self, t: cp.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, row offsets)."""
        if t.rows == 1 and len(t.cps) > 2 * LONG_TEXT:
            flat = np.concatenate([self._ids(part)[0] for part in slices(t, LONG_TEXT)])
            return flat, np.array([0, len(flat)])
        return self._ids(t)

    def _ids(self, t: cp.Texts) -> tuple[np.ndarray, np.ndarray]:
        place, bounds, counts = self.encode(t)
        ends = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        origin = np.cumsum(self.counts) - self.counts
        flat = self.ids[cp.gather(origin[place], counts)] if len(place) else np.zeros(0, np.int64)
        return flat.astype(np.int32), ends[bounds]

    def sizes(self, t: cp.Texts) -> np.ndarray:
        """Number of ids of each row."""
        if t.rows == 1 and len(t.cps) > 2 * LONG_TEXT:
            return np.array([sum(int(self.encode(part)[2].sum()) for part in slices(t, LONG_TEXT))])
        _, bounds, counts = self.encode(t)
        ends = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        return np.diff(ends[bounds])


def encode_corpus(
    df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT, folder: str = TOKENIZERS, out: str = "ids"
) -> DataFrame:
    """(key, ids array<int>) of every row of ``df``; a map without any shuffle.

    The merge tables are a broadcast whose size is that of the vocabulary file
    (50,000 pairs), whatever the corpus.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_merges(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for at, t in cp.spans(batch.column(1)):
                flat, off = encoder.id_lists(t)
                ids = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, t.rows), ids], [key, out])

    schema = T.StructType([df.schema[key], T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


def count_tokens(
    df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = DEFAULT, folder: str = TOKENIZERS, out: str = "tokens"
) -> DataFrame:
    """The ``keep`` columns of every row and its number of ids; null and empty texts have 0."""
    shared = df.sparkSession.sparkContext.broadcast(load_merges(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for at, t in cp.spans(batch.column(len(keep))):
                rest = [batch.column(i).slice(at, t.rows) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(encoder.sizes(t), pa.int64())], [*keep, out])

    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField(out, T.LongType())])
    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
