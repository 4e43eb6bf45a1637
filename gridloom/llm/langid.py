"""Language ID by cross-parsing: the language whose labelled text parses a document into the fewest phrases.

For each language a suffix automaton is built over a bounded sample of its
labelled text. A document is parsed greedily: each phrase is the longest string
that occurs in the sample, found by walking the automaton until it has no
transition. The number of phrases, times the logarithm of the sample's length and
divided by the text's, is the entropy of the text by the language (Ziv and Merhav),
so that a language is not put back for a smaller sample.

The automata are laid out as one table in which a failing step counts a phrase and
restarts at the root, so a step is one lookup, taken for all windows of a chunk of
texts and all languages side by side. A window is then parsed once more from the
state that the window before it ended in, until a phrase ends where one ended the
first time: the parse is that of the whole text. The table has columns for the most
frequent letters; transitions by all others are found in sorted keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bpe import _LETTER, _classes
from .store import documents, keep_rows
from .text import chunks

#: Labelled documents of a language that are learned from, those with the least hash.
SAMPLE = 48
#: Bytes of whole texts learned from each language, and from all languages together.
SYMBOLS, ALL_SYMBOLS = 40_000, 200_000
#: Letters with a column in the table, the most frequent of the samples; every other letter of a sample has its transitions in sorted keys.
LETTERS = 94
#: Symbols of a window, and of these how many remember where phrases ended; both change no result.
WINDOW, SEEN = 2048, 256
CHUNK = 2 << 20
_lower: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Each code point's small letter, or 0 where it is no letter."""
    if not _lower:
        kind = _classes()
        out = np.zeros(0x110000, np.uint32)
        at = np.flatnonzero(kind == _LETTER)
        out[at] = [ord(s) if len(s := chr(c).lower()) == 1 else c for c in at.tolist()]
        _lower.append(out)
    return _lower[0]


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Small letters of the texts with one 0 for each run of other characters, offsets, and whether a text has letters."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    codes = data if len(at) == len(data) else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    small = _letters()[codes]
    first = np.searchsorted(at, offsets)
    keep = small != 0
    lettered = np.diff(np.r_[0, np.cumsum(keep)][first]) > 0
    if len(keep):
        keep[0] = True
        keep[1:] |= small[:-1] != 0
        keep[first[:-1][first[:-1] < len(keep)]] = True
    return small[keep], np.r_[0, np.cumsum(keep)][first], lettered


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``symbols``; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


@dataclass
class Parser:
    """``samples``: language to learned text as code points, where 0 parts words and documents."""

    samples: dict[str, list[int]]

    def __post_init__(self):
        self.langs = sorted(self.samples)
        learned = [np.array(self.samples[x], np.int64) for x in self.langs]
        codes, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *learned]), return_counts=True)
        order = codes[codes > 0][np.argsort(-counts[codes > 0], kind="stable")]
        self.width = width = min(len(order), LETTERS) + 2
        self._symbol = np.full(0x110000, 1, np.int32)  # 1: a letter that no sample has
        self._symbol[0] = 0
        self._symbol[order] = np.arange(2, len(order) + 2)
        self.rare = rare = len(order) + 2 - width  # letters without a column
        tables, self.roots, base, keys, targets = [], [], 0, [], []
        self._first = np.full((len(learned), rare), -1, np.int32)  # where the roots' transitions by letters without a column go
        for k, text in enumerate(learned):
            step = suffix_automaton(self._symbol[text].tolist())
            alone = len(step)  # the state after a letter that the sample lacks, which is a phrase of its own
            table = np.full((len(step) + 1, width), -1, np.int64)
            for s, to in enumerate(step):
                for c, t in to.items():
                    if c < width:
                        table[s, c] = t
                    else:
                        keys.append((s + base) * rare + c - width)
                        targets.append((t + base) * width)
            for c, t in step[0].items():
                if c >= width:
                    self._first[k, c - width] = (t + base) * width
            restart = np.where(table[0] < 0, alone, table[0])
            failed = table < 0
            table = np.where(failed, restart[None, :], table)
            tables.append((((table + base) * width) << 1 | failed).astype(np.int32))
            self.roots.append(base * width)
            base += len(table)
        self._table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        order = np.argsort(np.array(keys, np.int64))
        self._keys, self._targets = np.array(keys, np.int64)[order], np.array(targets, np.int32)[order]

    def _step(self, state: np.ndarray, lang: np.ndarray, symbol: np.ndarray, rare: bool) -> np.ndarray:
        """Twice the next state, plus one where a phrase ended before the symbol; a row for each language or a value for each."""
        if not rare:
            return self._table[state + symbol]
        letter = symbol - self.width
        to = self._table[state + np.where(letter >= 0, 1, symbol)]  # a restart as if no sample had the letter
        at = np.flatnonzero(np.broadcast_to(letter >= 0, to.shape).ravel())
        if len(at):
            state, lang, letter = (np.broadcast_to(x, to.shape).ravel()[at] for x in (state, lang, letter))
            key = state.astype(np.int64) // self.width * self.rare + letter
            place = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            first = self._first[lang, letter]
            to = to.copy()
            alone = to.ravel()[at]
            to.ravel()[at] = np.where(self._keys[place] == key, self._targets[place] << 1, np.where(first < 0, alone, first << 1 | 1))
        return to

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each text by language, its symbols, and whether it has letters."""
        symbols, at, lettered = normalised(data, offsets)
        symbols = self._symbol[symbols]
        rare = bool((symbols >= self.width).any())
        size = np.diff(at)
        windows = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(size)), windows)
        first = np.repeat(at[:-1], windows)
        start = first + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows))
        length = np.minimum(WINDOW, at[1:][doc] - start)
        k, n = len(self.langs), len(start)
        if not k:
            return np.zeros((0, len(size)), np.int64), size, lettered
        order = np.argsort(-length, kind="stable")  # so that the windows which go on are the first ones
        langs, places, later = np.arange(k)[:, None], start[order], (start > first)[order]
        closed = np.zeros((k, n, SEEN), bool)
        ends = np.zeros((k, n), np.int64)
        state = np.repeat(np.array(self.roots, np.int32)[:, None], n, axis=1)
        active = np.searchsorted(-length[order], -np.arange(1, length.max() + 1), side="right") if n else []
        for t, m in enumerate(active):
            to = self._step(state[:, :m], langs, symbols[places[:m] + t], rare)
            over = to & 1
            ends[:, :m] += over if t else over * later[:m]  # no phrase ends before a text's first symbol
            if t < SEEN:
                closed[:, :m, t] = over
            state[:, :m] = to >> 1
        back = np.argsort(order)
        ends, closed, state = ends[:, back], closed[:, back], state[:, back]
        self._join(symbols, rare, start, length, start > first, closed, ends, state)
        count = (size > 0) + np.stack([np.bincount(doc, row, len(size)) for row in ends])  # the last phrase ends with the text
        return count.astype(np.int64), size, lettered

    def _join(self, symbols, rare, start, length, goes_on, closed, ends, state) -> None:
        """Ends and last states of windows parsed alone become those of the whole text's parse."""
        alone, last = ends.copy(), state.copy()
        lang, window = (x.ravel() for x in np.meshgrid(np.arange(len(ends)), np.flatnonzero(goes_on), indexing="ij"))
        while len(lang):
            now = state[lang, window - 1]
            own, theirs, met = np.zeros(len(lang), np.int64), np.zeros(len(lang), np.int64), np.zeros(len(lang), bool)
            alive, t = np.arange(len(lang)), 0
            while len(alive):
                to = self._step(now[alive], lang[alive], symbols[start[window[alive]] + t], rare)
                now[alive] = to >> 1
                own[alive] += to & 1
                if t < SEEN:
                    there = closed[lang[alive], window[alive], t]
                    theirs[alive] += there
                    met[alive] = ((to & 1) == 1) & there
                t += 1
                alive = alive[~met[alive] & (length[window[alive]] > t)]
            ends[lang, window] = np.where(met, alone[lang, window] - theirs + own, own)
            now = np.where(met, last[lang, window], now)
            changed = (state[lang, window] != now) & np.r_[goes_on, False][window + 1]  # the next window was joined to another state
            state[lang, window] = now
            lang, window = lang[changed], window[changed] + 1

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        phrases, _, lettered = self.phrases(data, offsets)
        if not self.langs:
            return ["und"] * len(lettered), np.zeros(len(lettered))
        entropy = phrases * np.log2([max(2, len(self.samples[x])) for x in self.langs])[:, None]
        best, least = entropy.argmin(axis=0), entropy.min(axis=0)
        share = 1 / ((least / np.maximum(entropy, 1)) ** 8).sum(axis=0).clip(1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist())], np.where(lettered, share, 0.0)


def sample(docs: DataFrame) -> dict[str, list[int]]:
    """Learned text of each language of ``docs`` (doc_id, text, lang).

    Taken are whole texts of ``SAMPLE`` rows at most, in the order of their hashes,
    that fit into what is left of the language's bytes; of a language whose every
    row is longer than that, the shortest text as far as it goes. Repeated rows
    count once; each row has its own label, whatever others its id has.
    """
    marked = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("lang", F.octet_length("text").cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("h"), F.xxhash64(F.lit(1), "doc_id", "text").alias("g"))
    ranked = marked.withColumn("rank", F.dense_rank().over(Window.partitionBy("lang").orderBy("h", "g"))).where(F.col("rank") <= SAMPLE)
    rows = sorted(ranked.distinct().collect(), key=lambda r: (r.lang, r.rank, r.size))
    langs = sorted({r.lang for r in rows})
    if not langs:
        return {}
    limit, chosen = min(SYMBOLS, ALL_SYMBOLS // len(langs)), []
    for lang in langs:
        left, own = limit, [r for r in rows if r.lang == lang]
        for r in own:
            if r.size <= left:
                left -= r.size
                chosen.append(r)
        if left == limit:
            chosen.append(min(own, key=lambda r: (r.size, r.rank)))
    picked = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, r.h, r.g, r.rank) for r in chosen], "lang string, h long, g long, rank int"))  # SAMPLE rows a language
    found = (
        docs.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"), F.xxhash64(F.lit(1), "doc_id", "text").alias("g"))
        .join(picked, ["lang", "h", "g"]).select("lang", "rank", F.substring("text", 1, limit).alias("text")).dropDuplicates(["lang", "rank"]).collect()
    )
    out: dict[str, list[int]] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.rank)):
        raw = np.frombuffer(r.text.encode(), np.uint8)
        symbols, _, lettered = normalised(raw, np.array([0, len(raw)]))
        if lettered[0]:
            out.setdefault(r.lang, []).extend([0, *symbols.tolist()])
    return out


def identify(docs: DataFrame, samples: dict[str, list[int]], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each whole text.

    ``und`` and score 0 where the text is null, empty or without letters, or
    nothing was learned. Of languages with equal entropies the first by name wins.
    The score is the winner's share when languages weigh as the eighth power of
    their entropies' inverse. Repeated rows give a row each.
    """
    held = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(held.value)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1), CHUNK):
                langs, scores = parser.predict(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, samples: dict[str, list[int]]) -> DataFrame:
    """The rows of ``docs`` whose language is not ``und``, with all their columns; all rows with letters, if nothing was learned."""
    held = docs.sparkSession.sparkContext.broadcast(samples)

    def make():
        parser = _parser(held.value)
        if not parser.langs:
            return lambda column: np.concatenate([np.zeros(0, bool), *(normalised(data, offsets)[2] for _, _, data, offsets in chunks(column))])
        return lambda column: [lang != "und" for _, _, data, offsets in chunks(column, CHUNK) for lang in parser.predict(data, offsets)[0]]

    return keep_rows(docs, make)


_parsers: list[tuple[dict, Parser]] = []


def _parser(samples: dict[str, list[int]]) -> Parser:
    """Built once by each worker for as long as the samples stay the same."""
    if not _parsers or _parsers[0][0] != samples:
        _parsers[:] = [(samples, Parser(samples))]
    return _parsers[0][1]


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = identify(docs, sample(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
