"""Edit-aware token counts over a tree of pre-tokens for each document.

Leaves hold runs of pre-tokens with their bytes and token counts, inner nodes
the sums below them. An edit finds its leaf by descending on byte sums, goes back
to the first pre-token whose cut could have looked into the edited bytes, cuts
and encodes anew from there until a boundary falls on an old one behind the edit,
and updates the sums above the leaves in between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import Bpe, load, vocabulary_path
from .store import documents
from .text import chunks

LEAF = 64
#: Bytes behind a pre-token's end that its cut may look at: one character, or the rest of a contraction.
AHEAD = 4


class TokenTree:
    """Token count of one text under edits; special tokens count as ordinary text."""

    def __init__(self, bpe: Bpe, raw: bytes, starts: np.ndarray, counts: np.ndarray):
        self.bpe = bpe
        lengths = np.diff(np.r_[starts, len(raw)]) if len(starts) else np.zeros(0, np.int64)
        at = range(0, max(1, len(starts)), LEAF)
        edges = [*(int(starts[a]) if a < len(starts) else 0 for a in at), len(raw)]
        self.text = [raw[a:b] for a, b in zip(edges, edges[1:])]
        self.lengths = [lengths[a : a + LEAF].tolist() for a in at]
        self.counts = [counts[a : a + LEAF].tolist() for a in at]
        self._build()

    def _build(self) -> None:
        self.width = 1 << max(0, len(self.text) - 1).bit_length()
        self.size, self.sum = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, text in enumerate(self.text):
            self.size[self.width + k], self.sum[self.width + k] = len(text), sum(self.counts[k])
        for k in range(self.width - 1, 0, -1):
            self.size[k], self.sum[k] = self.size[2 * k] + self.size[2 * k + 1], self.sum[2 * k] + self.sum[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.sum[1]

    def bytes(self) -> bytes:
        return b"".join(self.text)

    def _set(self, leaf: int) -> None:
        k = self.width + leaf
        self.size[k], self.sum[k] = len(self.text[leaf]), sum(self.counts[leaf])
        while k > 1:
            k //= 2
            self.size[k], self.sum[k] = self.size[2 * k] + self.size[2 * k + 1], self.sum[2 * k] + self.sum[2 * k + 1]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf with the byte at ``place`` (the last one for the end), and where that leaf starts."""
        k, start = 1, 0
        while k < self.width:
            k *= 2
            if place - start >= self.size[k] and self.size[k + 1]:
                start += self.size[k]
                k += 1
        return k - self.width, start

    def edit(self, first: int, end: int, new: bytes) -> int:
        """Replaces the bytes [first, end) by ``new``, both whole characters; returns the pre-tokens that were encoded anew."""
        first = min(max(0, first), self.size[1])
        end = min(max(first, end), self.size[1])
        leaf, start = self._leaf_at(max(0, first - AHEAD))
        own, at = 0, start
        while own < len(self.lengths[leaf]) and at + self.lengths[leaf][own] + AHEAD <= first:
            at += self.lengths[leaf][own]
            own += 1
        begin = at
        # old boundaries behind the edit, leaf by leaf, and the text behind it
        head = self._read(leaf, begin - start, first - begin)
        behind, reach = self._leaf_at(end)
        tail, shift = 64, len(new) - (end - first)
        while True:
            after = self._read(behind, end - reach, tail)
            text = head + new + after
            whole = end + len(after) >= self.size[1]
            while not whole and after and len(after) > 1 and self._splits(behind, end - reach + len(after)):
                after = after[:-1]
                text = text[:-1]
            starts, counts = self._cut(text)
            ends = np.r_[starts[1:], len(text)] if len(starts) else starts
            stop = self._meet(ends, len(head) + len(new), begin, shift, behind, reach, len(text), whole)
            if stop is not None:
                break
            tail *= 2
        upto, (last, cut, kept) = stop
        n = int(np.searchsorted(ends, upto, side="right")) if upto else 0
        lengths, counts = np.diff(np.r_[starts[:n], upto]).tolist() if n else [], counts[:n].tolist()
        keep = self.lengths[leaf][:own], self.counts[leaf][:own], self.text[leaf][: begin - start]
        rest = self.lengths[last][kept:], self.counts[last][kept:], self.text[last][cut:]
        for k in range(leaf + 1, last + 1):
            self.lengths[k], self.counts[k], self.text[k] = [], [], b""
        if last != leaf:
            self.lengths[last], self.counts[last], self.text[last] = rest
            rest = [], [], b""
        self.lengths[leaf], self.counts[leaf], self.text[leaf] = keep[0] + lengths + rest[0], keep[1] + counts + rest[1], keep[2] + text[:upto] + rest[2]
        for k in range(leaf, last + 1):
            self._set(k)
        if len(self.lengths[leaf]) > 8 * LEAF:
            self._split(leaf)
        return n

    def _split(self, leaf: int) -> None:
        lengths, counts, text = self.lengths[leaf], self.counts[leaf], self.text[leaf]
        edges = np.r_[0, np.cumsum(lengths)].tolist()
        cuts = list(range(0, len(lengths), LEAF))
        self.lengths[leaf : leaf + 1] = [lengths[c : c + LEAF] for c in cuts]
        self.counts[leaf : leaf + 1] = [counts[c : c + LEAF] for c in cuts]
        self.text[leaf : leaf + 1] = [text[edges[c] : edges[min(len(lengths), c + LEAF)]] for c in cuts]
        self._build()

    def _read(self, leaf: int, place: int, n: int) -> bytes:
        out = []
        while n > 0 and leaf < len(self.text):
            part = self.text[leaf][place : place + n]
            out.append(part)
            n -= len(part)
            leaf, place = leaf + 1, max(0, place - len(self.text[leaf]))
        return b"".join(out)

    def _splits(self, leaf: int, place: int) -> bool:
        """Whether the byte at ``place`` goes on with a character."""
        return any(b & 0xC0 == 0x80 for b in self._read(leaf, place, 1))

    def _cut(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and token counts of the pre-tokens of a short text, word by word."""
        words = self.bpe._pieces(text.decode())
        ends = np.cumsum([len(w.encode()) for w in words], dtype=np.int64)
        return np.r_[0, ends[:-1]] if words else ends, np.array([len(self.bpe.word_ids(w)) for w in words], np.int64)

    def _meet(self, ends, least, begin, shift, leaf, reach, length, whole):
        """(bytes of new text, (leaf, byte, pre-token) of the old) of the first trusted boundary that both have behind the edit."""
        known: dict[int, tuple[int, int, int]] = {}
        k, at = leaf, reach
        while k < len(self.text) and at - begin + shift <= length:
            place = 0
            for j, size in enumerate(self.lengths[k]):
                known.setdefault(at + place, (k, place, j))
                place += size
            at += place
            k += 1
        if k == len(self.text):
            known.setdefault(at, (k - 1, len(self.text[k - 1]), len(self.lengths[k - 1])))
        trusted = [0, *ends.tolist()] if length == 0 or not least else ends.tolist()
        for e in trusted:
            if e >= least and (whole or e + AHEAD <= length) and (old := e + begin - shift) in known and old >= begin + least - shift:
                return e, known[old]
        return None


def sample_edits(doc_id: int, size: int, n: int = 3) -> list[tuple[int, int, bytes]]:
    """The edits of the registered query: places that follow from the id, a few bytes replaced by short words."""
    return [((doc_id * 7919 + k * 104729) % (size + 1), (doc_id + k) % 6, f" edit{k}'s".encode()[: 1 + (doc_id + 3 * k) % 9]) for k in range(n)]


def count_with_edits(df: DataFrame, path: str, edits=sample_edits) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_edited, n_reencoded) of each row of ``df`` (doc_id, text).

    n_tokens counts the text, n_edited the text after ``edits(doc_id, bytes)``, a
    list of (first byte, bytes replaced, new bytes) applied in turn and moved back to
    whole characters; n_reencoded is how many pre-tokens they encoded anew. Null
    counts as empty, a null id has edits as id 0, repeated rows give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                _, counts, starts = bpe.encode_words(data, offsets)
                at, raw = np.searchsorted(starts, offsets), data.tobytes()
                rows = []
                for k, i in enumerate(batch.column(0)[a:b].to_pylist()):
                    low, high = int(offsets[k]), int(offsets[k + 1])
                    tree = TokenTree(bpe, raw[low:high], starts[at[k] : at[k + 1]] - low, counts[at[k] : at[k + 1]])
                    before = tree.n_tokens
                    anew = sum(tree.edit(*whole(tree, *e)) for e in edits(i or 0, high - low))
                    rows.append((i, before, int(at[k + 1] - at[k]), tree.n_tokens, anew))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], ["doc_id", "n_tokens", "n_pretokens", "n_edited", "n_reencoded"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long, n_edited long, n_reencoded long")


def whole(tree: TokenTree, first: int, n: int, new: bytes) -> tuple[int, int, bytes]:
    """The edit with both ends moved back to the start of a character."""
    ends = []
    for place in (first, first + n):
        place = min(place, tree.size[1])
        while place and place < tree.size[1] and tree._splits(*(lambda leaf, start: (leaf, place - start))(*tree._leaf_at(place))):
            place -= 1
        ends.append(place)
    return ends[0], ends[1], new


def op6_editcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_with_edits(documents(spark, sf_dir), vocabulary_path())
