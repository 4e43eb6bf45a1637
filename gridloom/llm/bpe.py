"""Byte-level BPE encoding and decoding over a contiguous rank array.

A pre-token of up to ``SHORT`` bytes is merged in one small contiguous array:
part boundaries, and beside each the rank of the pair that starts there. The
array is scanned for the least rank, that boundary's successor is deleted, and
only the two ranks beside it are looked up anew. Longer pre-tokens, where
repeated scans would be quadratic, use the same rule with a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .store import documents
from .text import chunks, hash_ranges, ranges

SHORT = 64
#: Words kept by a worker; beyond it the cache starts anew, which changes no result.
CACHED = 200_000
#: The pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded words kept by a worker for ``encode_words``, in flat arrays.
TABLE = 300_000
_NONE = 1 << 60
_BLANK, _SPACE, _LETTER, _NUMBER, _OTHER, _EDGE = range(6)
_kinds: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of each code point: the blank, other white space, letters, numbers, the rest."""
    if not _kinds:
        kind = np.full(0x110000, _OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for of, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                for c in m[0]:
                    kind[ord(c)] = of
        kind[32] = _BLANK
        _kinds.append(kind)
    return _kinds[0]


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """One vocabulary: ``encode`` as the tokenizers library does without special tokens added, and ``decode``.

    Special tokens of the file are found in a text before anything else, the
    earliest first and the longest of those. Bytes missing from the vocabulary
    are left out, as that library does where no unknown token is set.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = byte_names()
        as_bytes = lambda s: bytes(names[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.ids = {as_bytes(k): v for k, v in vocab.items()}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[as_bytes(left), as_bytes(right)] = rank
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._pieces = regex.compile(PATTERN).findall
        bytes_of = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        n = max(bytes_of) + 1
        self._length = np.array([len(bytes_of.get(i, b"")) for i in range(n)], np.int64)
        self._start = np.cumsum(self._length) - self._length
        self._flat = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in range(n)), np.uint8)
        self._cache: dict[str, tuple[int, ...]] = {}
        digits = [str(i).encode() + b"," for i in range(n)]
        self._digits = np.array([len(d) for d in digits], np.int64)
        self._digits_start = np.cumsum(self._digits) - self._digits
        self._digits_flat = np.frombuffer(b"".join(digits), np.uint8)
        self._clear()

    def merge(self, word: bytes) -> list[bytes]:
        """The parts of one pre-token."""
        if len(word) > SHORT:
            return self._merge_long(word)
        bound = list(range(len(word) + 1))
        rank_of = self.ranks.get
        ranks = [rank_of((word[i : i + 1], word[i + 1 : i + 2]), _NONE) for i in range(len(word) - 1)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            del bound[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((word[bound[i] : bound[i + 1]], word[bound[i + 1] : bound[i + 2]]), _NONE)
            if i:
                ranks[i - 1] = rank_of((word[bound[i - 1] : bound[i]], word[bound[i] : bound[i + 1]]), _NONE)
        return [word[a:b] for a, b in zip(bound, bound[1:])]

    def _merge_long(self, word: bytes) -> list[bytes]:
        n = len(word)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks.get((word[i : end[i]], word[j : end[j]]))) is not None:
                heapq.heappush(queue, (rank, i, end[i], end[j]))

        for i in range(n):
            offer(i)
        while queue:
            _, i, mid, to = heapq.heappop(queue)
            j = mid
            if not alive[i] or end[i] != mid or j >= n or not alive[j] or end[j] != to:
                continue
            alive[j], end[i], after[i] = False, to, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [word[i : end[i]] for i in range(n) if alive[i]]

    def word_ids(self, word: str) -> tuple[int, ...]:
        found = self._cache.get(word)
        if found is None:
            ids = self.ids
            found = tuple(ids[p] for p in self.merge(word.encode()) if p in ids)
            if len(self._cache) >= CACHED:
                self._cache.clear()
            if len(word) <= 4 * SHORT:
                self._cache[word] = found
        return found

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token is one of them."""
        out: list[str] = []
        at = 0
        for m in self._special.finditer(text) if self._special else ():
            out += self._pieces(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._pieces(text[at:] if at else text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        put, known, ids = out.extend, self._cache.get, self.word_ids
        at = 0
        for m in self._special.finditer(text) if self._special else ():
            for w in self._pieces(text[at : m.start()]):
                put(known(w) or ids(w))
            out.append(self.special[m[0]])
            at = m.end()
        for w in self._pieces(text[at:] if at else text):
            put(known(w) or ids(w))
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens side by side."""
        return self._flat[ranges(self._start[ids], self._length[ids])].tobytes()

    def listed(self, ids: np.ndarray) -> bytes:
        """The decimal ids, each with a comma after it."""
        return self._digits_flat[ranges(self._digits_start[ids], self._digits[ids])].tobytes()

    def decode(self, ids) -> str:
        """The text of the tokens, special ones included; broken UTF-8 becomes U+FFFD."""
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", errors="replace")


    # A chunk of texts at once: pre-tokens are cut by character class, and each distinct one is merged once.

    def pretokens(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First byte of every pre-token, as ``PATTERN`` cuts the texts; they lie side by side. No special tokens."""
        kind_of = _classes()
        at = np.flatnonzero((data & 0xC0) != 0x80)
        codes = data if len(at) == len(data) else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        n = len(codes)
        if not n:
            return np.zeros(0, np.int64)
        kind = np.full(n + 2, _SPACE, np.uint8)
        kind[1:-1] = kind_of[codes]
        now, before, after = kind[1:-1], kind[:-2].copy(), kind[2:].copy()
        first = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])
        before[first], after[first[1:] - 1], after[-1] = _EDGE, _EDGE, _EDGE
        space = now <= _SPACE
        start = np.where(space, (before > _SPACE) | ((after > _SPACE) & (after != _EDGE)), (before != now) & (before != _BLANK))
        quote = np.flatnonzero((codes == 39) & start & (after == _LETTER))
        if len(quote):
            end_of = np.r_[first[1:], n]
            left = end_of[np.searchsorted(first, quote, side="right") - 1] - quote
            one, two = codes[quote + 1], codes[np.minimum(quote + 2, n - 1)]
            short = np.isin(one, (115, 116, 109, 100))
            long = (left > 2) & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
            start[quote[short | long] + 1] = False
            after_it = (quote + 1 + short + 2 * long)[short | long]
            start[after_it[after_it < n]] = True
        return at[start]

    def _known(self, words: list[bytes]) -> np.ndarray:
        """Rows of the table of encoded words."""
        if len(self._row) > TABLE:
            self._clear()
        out = np.empty(len(words), np.int64)
        rows = self._row
        for k, w in enumerate(words):
            row = rows.get(w)
            if row is None:
                row = rows[w] = len(rows)
                found = [self.ids[p] for p in self.merge(w) if p in self.ids]
                self._table.extend(found)
                self._table_end.append(len(self._table))
            out[k] = row
        return out

    def _clear(self) -> None:
        self._row: dict[bytes, int] = {}
        self._table, self._table_end = array("i"), array("q", [0])

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts side by side, and the n + 1 offsets of each text's."""
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.special):
            each = [self.encode(raw[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in each)]), np.r_[0, np.cumsum([len(x) for x in each])].astype(np.int64)
        ids, counts, starts = self.encode_words(data, offsets)
        sums = np.r_[0, np.cumsum(counts)]
        return ids, sums[np.searchsorted(starts, offsets)]

    def encode_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the number of ids of each pre-token, and where the pre-tokens start."""
        starts = self.pretokens(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), starts
        raw, ends = data.tobytes(), np.r_[starts[1:], len(data)]
        _, some, which = np.unique(hash_ranges(data, starts, ends), return_index=True, return_inverse=True)
        model = starts[some][which]  # where the word that stands for each pre-token starts; equal hashes must be equal words
        size = ends - starts
        if (size != size[some][which]).any() or (data != data[np.arange(len(data)) + np.repeat(model - starts, size)]).any():
            words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
            rows = self._known(words)
        else:
            rows = self._known([raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())])[which]
        end = np.frombuffer(self._table_end, np.int64)
        first, counts = end[rows], end[rows + 1] - end[rows]
        ids = np.frombuffer(self._table, np.int32)[ranges(first, counts)].astype(np.int64)
        del end
        return ids, counts, starts


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary at ``path``, read once by each worker; it must be at that path on every machine."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each whole text; null counts as empty, and empty gives no ids and an empty text.

    Repeated rows and ids give a row each, a null id stays null, other columns
    of ``df`` are neither read nor returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                ids, at = bpe.encode_chunk(data, offsets)
                texts = [bpe.decode(ids[i:j]) for i, j in zip(at[:-1], at[1:])]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return df.select(df[id_column].alias("doc_id"), df[text_column].alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode_documents`` with the digests taken where the ids are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                ids, at = bpe.encode_chunk(data, offsets)
                n, ids_sha, text_sha = np.diff(at), [], []
                for i, j in zip(at[:-1], at[1:]):
                    own = ids[i:j]
                    ids_sha.append(sha(bpe.listed(own)[:-1]))
                    text_sha.append(sha(bpe.decode(own).encode()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(documents(spark, sf_dir), vocabulary_path())
