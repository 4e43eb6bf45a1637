"""Benchmark decontamination by the q-gram lemma.

A passage of n symbols within k edits of a stretch of text shares at least
n - q + 1 - kq q-grams with it, and the shared ones lie on at most k + 1
neighbouring diagonals (position in the text less position in the passage). So
q-grams of a text that occur in a benchmark item are counted by item in bands of
2(k + 1) diagonals that overlap by half; bands with enough of them are verified
by banded alignment, all bands of a chunk of texts side by side. q is the largest
that the lemma holds with for the item's length and budget; items too short for
edits to mean anything are looked for as they are, between word ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import _LETTER, _NUMBER, _classes
from .store import documents, keep_rows
from .text import chunks, ranges

#: Lengths of q-grams; an item takes the first for which it must share some with any text within its budget.
QS = (8, 6, 4, 2, 1)
#: Edits allowed for each symbol of an item.
BUDGET = 0.1
#: Items of fewer symbols are looked for without edits, as whole words; what holds one is reported, but not rejected for it.
LEAST = 20
#: Postings of q-grams that are looked at together.
HITS = 1 << 21
#: Bytes of benchmark text that one pass over the documents looks for; a larger benchmark takes several passes.
BLOCK = 8 << 20
_symbols: list[np.ndarray] = []
_ODD = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


def _table() -> np.ndarray:
    if not _symbols:
        kind = _classes()
        out = np.zeros(0x110000, np.uint32)
        at = np.flatnonzero((kind == _LETTER) | (kind == _NUMBER))
        out[at] = [ord(s) if len(s := chr(c).lower()) == 1 else c for c in at.tolist()]
        _symbols.append(out)
    return _symbols[0]


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small letters and digits of the texts with one 0 between runs of them, and offsets; ends are trimmed."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    codes = data if len(at) == len(data) else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    symbols = _table()[codes]
    first = np.searchsorted(at, offsets)
    word = symbols != 0
    keep = word.copy()
    keep[:-1] |= word[1:]  # of a run of others the last stays, if a word follows
    begins = first[:-1][np.diff(first) > 0]
    keep[begins] = word[begins]
    return _untrimmed(symbols, keep, word, first)


def _untrimmed(symbols, keep, word, first):
    """Drops what stands before the first word of each text: a 0 that opens it."""
    seen = np.r_[0, np.cumsum(word)]
    opens = np.flatnonzero(keep & ~word)
    begin = first[np.searchsorted(first, opens, side="right") - 1]
    end = first[np.searchsorted(first, opens, side="right")]
    keep[opens[(seen[opens] == seen[begin]) | (seen[end] == seen[opens])]] = False
    return symbols[keep], np.r_[0, np.cumsum(keep)][first]


def grams(symbols: np.ndarray, q: int) -> np.ndarray:
    """32-bit hash of each run of ``q`` symbols."""
    if len(symbols) < q:
        return np.zeros(0, np.uint32)
    out, length = None, 0
    h, step = symbols.astype(np.uint32) * _ODD[0], 1
    for odd in _ODD[1:]:  # runs of 1, 2, 4 and 8 symbols, of which those that q is made of are put together
        if q & step:
            out = h if out is None else out[: len(h) - length] * _ODD[3] + (h[length:] ^ (h[length:] >> np.uint32(13)))
            length += step
        if q < 2 * step:
            return out
        h = h[:-step] * odd + (h[step:] ^ (h[step:] >> np.uint32(15)))
        step *= 2
    return h


class _Grams:
    """Places of the q-grams of the items ``at`` of an index."""

    def __init__(self, index: Index, at: np.ndarray, q: int):
        use = index.size[at] - q + 1
        place = ranges(index.offsets[at], use)
        keys = grams(index.symbols, q)[place]
        order = np.argsort(keys, kind="stable")
        self.q, self.keys, self.item, self.place = q, keys[order], np.repeat(at, use)[order], (place - np.repeat(index.offsets[at], use))[order]
        self._seen = np.zeros(1 << 22, bool)
        self._seen[self.keys >> np.uint32(10)] = True

    def hits(self, symbols: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, place, item, place in the item) of shared q-grams, at most about ``HITS`` at a time."""
        h = grams(symbols, self.q)
        may = np.flatnonzero(self._seen[h >> np.uint32(10)])
        low, high = np.searchsorted(self.keys, h[may]), np.searchsorted(self.keys, h[may], side="right")
        doc = np.searchsorted(at, may, side="right") - 1
        some = (high > low) & (may + self.q <= at[doc + 1])
        may, low, high, doc = may[some], low[some], high[some], doc[some]
        total = np.cumsum(high - low)
        a = 0
        while a < len(may):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, side="right")))
            n = high[a:b] - low[a:b]
            hit = ranges(low[a:b], n)
            yield np.repeat(doc[a:b], n), np.repeat(may[a:b], n), self.item[hit], self.place[hit]
            a = b


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers."""
    keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(which, np.concatenate([n for _, n in parts]), len(keys))


class Index:
    """q-grams of benchmark items ((item_id, text) with neither null), and the verification against them."""

    def __init__(self, items: list[tuple[int, str]], budget: float = BUDGET, least: int = 0):
        raw = [t.encode() for _, t in items]
        data = np.frombuffer(b"".join(raw), np.uint8)
        self.symbols, self.offsets = plain(data, np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64))
        self.ids = np.array([i for i, _ in items], np.int64)
        self.size = np.diff(self.offsets)
        self.edits = np.where(self.size < LEAST, 0, np.floor(budget * self.size + 1e-9)).astype(np.int64)
        shared = np.stack([self.size - q + 1 - self.edits * q for q in QS])
        pick = (shared > 0).argmax(axis=0)  # the last, single symbols, does for every budget below the whole item
        self.least = shared[pick, np.arange(len(self.size))]
        use = (self.size > 0) & (self.size >= least) & (self.least > 0)
        self._grams = [_Grams(self, at, q) for k, q in enumerate(QS) if len(at := np.flatnonzero(use & (pick == k)))]

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, first, end) of the best region of each item in each text; places count normalised symbols."""
        symbols, at = plain(data, offsets)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for own in self._grams:
            self._search(own, symbols, at, best)
        return [(d, i, e, a, b) for (d, i), (e, a, b) in sorted(best.items())]

    def _search(self, own: _Grams, symbols: np.ndarray, at: np.ndarray, best: dict) -> None:
        n = len(self.ids)
        counts, parts = [], []  # all hits are kept for the second look if they are few
        for part in own.hits(symbols, at):
            if parts is not None and sum(len(p[0]) for p in parts) + len(part[0]) <= HITS:
                parts.append(part)
            else:
                parts = None
            doc, _, item, _ = part
            counts.append(np.unique(doc * n + item, return_counts=True))
            if len(counts) > 16:
                counts = [_sums(counts)]
        if not counts:
            return
        pairs, count = _sums(counts)
        pairs = pairs[count >= self.least[pairs % n]]  # too few in the whole text are too few in a band
        if not len(pairs):
            return
        shared = []  # distinct q-grams of the item in each band
        for doc, place, item, there in own.hits(symbols, at) if parts is None else parts:
            pair = doc * n + item
            often = pairs[np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)] == pair
            doc, place, item, there, pair = doc[often], place[often], item[often], there[often], pair[often]
            band = (place - at[doc] - there + self.size[item]) // (self.edits[item] + 1)
            lower = np.flatnonzero(band > 0)
            shared.append(_distinct(np.stack([np.r_[pair, pair[lower]], np.r_[band, band[lower] - 1], np.r_[there, there[lower]]])))
            if len(shared) > 16:
                shared = [_distinct(np.concatenate(shared, axis=1))]
        shared = _distinct(np.concatenate(shared, axis=1))
        first = np.flatnonzero(np.r_[True, (shared[:2, 1:] != shared[:2, :-1]).any(axis=0)]) if shared.shape[1] else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, shared.shape[1]])
        pair, band = shared[:2, first[count >= self.least[shared[0, first] % n]]]
        doc, item = pair // n, pair % n
        low = at[doc] + band * (self.edits[item] + 1) - self.size[item]
        for part in range(0, len(doc), 256):
            cut = slice(part, part + 256)
            edits, end = self._align(symbols, at, doc[cut], item[cut], low[cut])
            for d, i, e, lo, to in zip(doc[cut].tolist(), item[cut].tolist(), edits.tolist(), (low[cut] - at[doc[cut]]).tolist(), (end - at[doc[cut]]).tolist()):
                if e <= self.edits[i] and (self.size[i] >= LEAST or self._whole_words(symbols, at, d, to, int(self.size[i]))):
                    best[d, i] = min(best.get((d, i), (1 << 30, 0, 0)), (e, max(0, lo), to))

    @staticmethod
    def _whole_words(symbols, at, doc: int, end: int, size: int) -> bool:
        """Whether words end on both sides of a region that is like the item."""
        a, b = at[doc] + end - size, at[doc] + end
        return (a == at[doc] or symbols[a - 1] == 0) and (b == at[doc + 1] or symbols[b] == 0)

    def _align(self, symbols, at, doc, item, low) -> tuple[np.ndarray, np.ndarray]:
        """Least edits between each item and a stretch of its text that stays in the band, and where that ends."""
        size, width = self.size[item], int(2 * (self.edits[item].max() + 1))
        steps = np.arange(width)
        outside = steps >= 2 * (self.edits[item][:, None] + 1)
        far = 1 << 20
        now = np.where(outside, far, 0)  # places before the text's first symbol match nothing
        start, stop = at[doc][:, None], at[doc + 1][:, None]
        edits, ends = np.full(len(doc), far), np.zeros(len(doc), np.int64)
        own = self.offsets[item]
        for i in range(1, int(size.max()) + 1):
            there = low[:, None] + i - 1 + steps
            text = np.where((there >= start) & (there < stop), symbols[np.clip(there, 0, len(symbols) - 1)], 0xFFFFFFFF)
            letter = self.symbols[np.minimum(own + i - 1, len(self.symbols) - 1)][:, None]
            then = now + (text != letter)
            then[:, :-1] = np.minimum(then[:, :-1], now[:, 1:] + 1)
            then[outside] = far
            now = np.minimum.accumulate(then - steps, axis=1) + steps
            now[outside] = far
            done = size == i
            if done.any():
                edits[done] = now[done].min(axis=1)
                ends[done] = np.minimum(low[done] + i + now[done].argmin(axis=1), stop[done, 0])
        return edits, ends


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Distinct columns in order."""
    rows = rows[:, np.lexsort(rows[::-1])]
    return rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)]] if rows.shape[1] else rows


def find_leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(doc_id, item_id, edits, first, end): benchmark items that occur in a text within the edit budget.

    Letters count as small ones, and what lies between words as one symbol.
    Items of fewer than ``LEAST`` symbols occur where they stand unedited between
    word ends; items without letters or digits and null ones match nothing, null
    and empty texts contain nothing, repeated texts and items each give their rows.
    Items are sent to the workers in blocks of about ``BLOCK`` bytes, one at a time.
    """
    context = docs.sparkSession.sparkContext

    def one(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(held.value, budget)
            for batch in batches:
                ids = batch.column(0)
                for a, _, data, offsets in chunks(batch.column(1)):
                    found = np.array(index.find(data, offsets), np.int64).reshape(-1, 5)
                    if len(found):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(found[:, 0] + a)), pa.array(index.ids[found[:, 1]]), *(pa.array(found[:, k]) for k in (2, 3, 4))], ["doc_id", "item_id", "edits", "first", "end"])

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, edits long, first long, end long")

    return reduce(DataFrame.unionByName, (one(context.broadcast(items)) for items in blocks_of(benchmark)))


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """(item_id, text) of the usable items in blocks of about ``BLOCK`` bytes, one at least."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    n = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK))
    for b in range(n):
        yield [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def keep_clean(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item of ``LEAST`` symbols or more within the edit budget, with all their columns.

    A text isn't rejected for a word or two that a shorter item has; ``find_leaks`` names these, too.
    """
    for items in blocks_of(benchmark):
        docs = _without(docs, docs.sparkSession.sparkContext.broadcast(items), budget)
    return docs


def _without(docs: DataFrame, held, budget: float) -> DataFrame:
    def make():
        index = Index(held.value, budget, LEAST)

        def wanted(column):
            out = np.ones(len(column), bool)
            for a, _, data, offsets in chunks(column):
                out[[a + found[0] for found in index.find(data, offsets)]] = False
            return out

        return wanted

    return keep_rows(docs, make)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
