"""Language-model scores by a hierarchical Pitman-Yor model of words in context and of their spelling.

A word's restaurant is that of its context, the last two bytes of the word before
it; its parent is the restaurant of the last byte alone, whose parent is that of
all words, shared by all contexts. The base of that one is a spelling model: a
hierarchy of restaurants for the next byte, one for each context of the ``DEPTH``
bytes before it, each with the context that drops the oldest byte as its parent.
Every table of a restaurant is a customer of its parent.

Seatings are sampled by Gibbs sweeps. The tables of a restaurant are coupled only
by its total T, through the gamma function of T + strength / discount; given an
auxiliary variable x with the gamma distribution of that shape, its dishes are
independent, and c customers of a dish take t tables with probability in
proportion to S(c, t) (discount x)**t times the parent's probability of t more
customers of the dish, where S are the generalised Stirling numbers. So a sweep
draws x once for each restaurant, and then every dish by itself, wherever it is
kept, with random numbers from the dish's own hash: the result depends neither on
partitions nor on the order of rows. A dish leaves its parent while it is seated;
the parent's own tables and what lies above are taken as they are. After each
sweep the spelling model is fitted anew to all tables of words. Predictive
probabilities are averaged over the last sweeps.

Counts are those of the whole corpus. Blocks of texts send their words packed, a
row for each bucket of words; for scores they send the words' hashes and get sums
by text back. Only the table of spelling probabilities and the totals of the
restaurants are sent to all workers, and their size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .store import Store, grouped, release
from .text import LOWER, NOT_SPACE, chunks, hash_ranges, mix, ranges, words

#: Bytes of a spelling context, and classes of a byte in it: a context is one of CLASSES ** DEPTH.
DEPTH, CLASSES = 3, 32
END = 256
SYMBOLS = 257
SPELLED = CLASSES**DEPTH * SYMBOLS
#: Word contexts: two classes of bytes, one, none.
CONTEXTS = (CLASSES**2, CLASSES, 1)
SWEEPS, AVERAGED = 5, 3
#: Strength of the word restaurants (by context, the last without any) and of the spelling restaurants.
STRENGTH, SPELLING_STRENGTH = (1.0, 1.0, 10.0), 1.0
#: Customers of a dish up to which its tables are drawn from the exact conditional; beyond, from the binomial with its limiting mean and variance.
EXACT = 256
#: Bytes of text whose words are sent together, and texts at most.
BLOCK, BLOCK_TEXTS = 6 << 20, 1 << 16
#: Buckets of words at least, and bytes of text for one at first; their number grows as the vocabulary of text does, with the power.
BUCKETS, BUCKET_BYTES, POWER = 64, 4 << 20, 0.6
#: Words of a row of the vocabulary.
ROW = 1 << 14
_CLASS = np.array([b - 96 if 97 <= b <= 122 else 27 if 48 <= b <= 57 else 28 if b < 128 else 29 + b % 3 for b in range(256)] + [0], np.int64)


@cache
def stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c, t up to ``EXACT``."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0
    with np.errstate(invalid="ignore", divide="ignore"):
        for c in range(1, EXACT):
            stay = out[c] + np.log(np.maximum(c - discount * np.arange(EXACT + 1), 0))
            out[c + 1] = np.logaddexp(np.r_[-np.inf, out[c, :-1]], stay)
    return out


def uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) from each hash."""
    return ((mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def seat(customers: np.ndarray, odds: np.ndarray, discount: float, h: np.ndarray, sweep: int = 0, more: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
    """Tables that ``customers`` of each dish take: t with probability in proportion to S(customers, t) times the odds of t tables.

    The first table has ``odds``, the one after i others odds + step (i - lost),
    where ``more`` holds step, lost and the tables so far; without it all have
    ``odds``. ``h`` are hashes that the random numbers come from, one for each dish.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    draw = uniform(h, 2 * sweep + 1)
    at = np.flatnonzero((customers > 1) & (customers <= EXACT))
    at = at[np.argsort(customers[at], kind="stable")]
    sizes, low = customers[at], 0
    while low < len(at):
        # dishes of some sizes that differ little are drawn together: there are no Stirling numbers beyond a dish's own customers
        most = sizes[low] + sizes[low] // 8
        high = min(int(np.searchsorted(sizes, most, "right")), low + max(1, (1 << 18) // int(most)))
        some, c = at[low:high], sizes[low:high]
        width = int(c[-1])
        each = np.repeat(odds[some, None], width, axis=1)
        if more is not None:
            each[:, 1:] += more[0][some, None] * (np.arange(1, width) - more[1][some, None])
        weight = stirling(discount)[c, 1 : width + 1] + np.log(np.maximum(each, 1e-300)).cumsum(axis=1)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True)).cumsum(axis=1)
        tables[some] = 1 + (weight < draw[some, None] * weight[:, -1:]).sum(axis=1)
        low = high
    at = np.flatnonzero(customers > EXACT)
    if len(at):
        now = odds[at] if more is None else odds[at] + more[0][at] * np.maximum(more[2][at] - more[1][at], 0)
        mean, variance = limits(customers[at].astype(float), np.maximum(now, 1e-300), discount)
        tables[at] = np.minimum(1 + _binomial(mean - 1, variance, draw[at], uniform(h[at], 2 * sweep + 2)), customers[at])
    return tables


def without(own: np.ndarray, customers: np.ndarray, tables: np.ndarray, fresh: np.ndarray, whole: np.ndarray, discount: float) -> tuple[np.ndarray, ...]:
    """Of dishes with ``own`` tables among their parent's ``customers``: the parent's probability of the first such customer when they have left, and what each adds to that of the next.

    ``fresh`` is the parent's mass for a new table of the dish, ``whole`` that of everything.
    """
    others = customers - own
    odds = (np.where(others > 0, np.maximum(others - discount * np.minimum(tables, others), 0), 0) + fresh) / whole
    return odds, 1 / whole, np.where(others > 0, 0.0, discount)


def limits(c: np.ndarray, odds: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the tables of many customers c.

    The mean m(c, o) follows dm/dc = (o - d o dm/do) / (o + c - d m) from m = 1 at
    c = 1, whose characteristics are o = p ((c - d + p) / (1 - d + p))**d with
    m = 1 + (o - p) / d; the variance is o dm/do.
    """
    low, high = np.full(len(c), -700.0), np.log(odds)
    for _ in range(64):  # the logarithm of p, in which o grows
        middle = (low + high) / 2
        p = np.exp(middle)
        over = middle + discount * (np.log(c - discount + p) - np.log(1 - discount + p)) > np.log(odds)
        low, high = np.where(over, low, middle), np.where(over, middle, high)
    p = np.exp(low)
    slope = 1 + discount * p * (1 / (c - discount + p) - 1 / (1 - discount + p))
    return 1 + (odds - p) / discount, np.maximum((odds - p / slope) / discount, 0)


def _binomial(mean: np.ndarray, variance: np.ndarray, draw: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Numbers of 0 and more with given mean and (no larger) variance: by inversion for small means, else rounded normal ones."""
    out = np.rint(mean + np.sqrt(variance) * np.sqrt(-2 * np.log(draw)) * np.cos(2 * np.pi * other)).astype(np.int64)
    few = np.flatnonzero(mean < 30)
    if len(few):
        m = np.maximum(mean[few], 1e-12)
        share = np.clip(1 - variance[few] / m, 1e-9, 1 - 1e-9)
        n = m / share
        chance, total = np.exp(n * np.log1p(-share)), np.zeros(len(few))
        out[few] = 0
        for k in range(400):
            total += chance
            beyond = (draw[few] > total) & (k < n)
            if not beyond.any():
                break
            out[few] += beyond
            chance = chance * np.maximum(n - k, 0) / (k + 1) * share / (1 - share)
    return np.maximum(out, 0)


def rate(tables, strength: float, discount: float, rng: np.random.Generator):
    """``discount`` times the auxiliary variable of restaurants with so many ``tables``."""
    return discount * rng.gamma(strength / discount + tables)


def discount_from(one: int, two: int) -> float:
    """The usual estimate from the numbers of dishes with one and two customers, kept inside (0, 1)."""
    return float(np.clip(one / (one + 2 * two), 0.1, 0.9)) if one else 0.5


def spelling(keys: np.ndarray, counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """Predictive probabilities [context, symbol] from counts of sorted distinct keys, context * SYMBOLS + symbol."""
    rng = np.random.default_rng(seed)
    at = [keys]  # by depth; keys of shallower contexts, and the place of each key's parent
    above: list[np.ndarray] = []
    for k in range(DEPTH, 0, -1):
        context, symbol = at[0] // SYMBOLS, at[0] % SYMBOLS
        parents, which = np.unique(context % CLASSES ** (k - 1) * SYMBOLS + symbol, return_inverse=True)
        at.insert(0, parents)
        above.insert(0, which)
    customers = [np.zeros(len(a), np.int64) for a in at]
    tables = [np.zeros(len(a), np.int64) for a in at]

    def hand_up(k: int) -> None:
        """Tables of depth k become the customers of depth k - 1."""
        if k:
            customers[k - 1] = np.bincount(above[k - 1], tables[k], len(at[k - 1])).astype(np.int64)

    customers[DEPTH] = counts.astype(np.int64)
    for k in range(DEPTH, -1, -1):
        tables[k] = np.minimum(customers[k], 1)
        hand_up(k)
    discounts = [discount_from(int((c == 1).sum()), int((c == 2).sum())) for c in customers]

    def masses(k: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By key of depth k, from the probabilities above it: mass of a new table, and of everything."""
        n, context = CLASSES**k, at[k] // SYMBOLS
        c, t = (np.bincount(context, x, n) for x in (customers[k], tables[k]))
        return (SPELLING_STRENGTH + discounts[k] * t)[context] * p, (SPELLING_STRENGTH + c)[context]

    def by_key() -> list[np.ndarray]:
        """Probabilities of the keys of each depth, and before them those of their symbols under no restaurant."""
        out = [np.full(len(at[0]), 1 / SYMBOLS)]
        for k in range(DEPTH + 1):
            fresh, whole = masses(k, out[-1] if k == 0 else out[-1][above[k - 1]])
            out.append((customers[k] - discounts[k] * tables[k] + fresh) / whole)
        return out

    def predictive() -> np.ndarray:
        p = np.full((1, SYMBOLS), 1 / SYMBOLS, np.float32)
        for k in range(DEPTH + 1):
            n = CLASSES**k
            c, t = (np.bincount(at[k] // SYMBOLS, x, n) for x in (customers[k], tables[k]))
            p = np.tile(p, (n // len(p), 1))
            p *= ((SPELLING_STRENGTH + discounts[k] * t) / (SPELLING_STRENGTH + c)).astype(np.float32)[:, None]
            p.reshape(-1)[at[k]] += (customers[k] - discounts[k] * tables[k]) / (SPELLING_STRENGTH + c)[at[k] // SYMBOLS]
        return p

    total = np.zeros((CLASSES**DEPTH, SYMBOLS), np.float32)
    for sweep in range(SWEEPS):
        now = by_key()
        for k in range(DEPTH, -1, -1):
            rates = rate(np.bincount(at[k] // SYMBOLS, tables[k], CLASSES**k), SPELLING_STRENGTH, discounts[k], rng)[at[k] // SYMBOLS]
            odds, more = now[0], None
            if k:
                up = above[k - 1]
                fresh, whole = masses(k - 1, now[k - 1] if k == 1 else now[k - 1][above[k - 2]])
                odds, step, lost = without(tables[k], customers[k - 1][up], tables[k - 1][up], fresh[up], whole[up], discounts[k - 1])
                more = rates * step, lost, tables[k]
            tables[k] = seat(customers[k], rates * odds, discounts[k], (at[k] * (DEPTH + 1) + k).astype(np.uint64), sweep + seed, more)
            hand_up(k)
        if sweep >= SWEEPS - AVERAGED:
            total += predictive()
    total /= AVERAGED
    return total


def spelled(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key (context and symbol) of each byte and of the end of each word, and the word of each."""
    size = lengths + 1
    word = np.repeat(np.arange(len(lengths)), size)
    first = np.cumsum(size) - size
    symbol = np.full(int(size.sum()), END, np.int64)
    symbol[ranges(first, lengths)] = data
    place = np.arange(len(symbol)) - first[word]
    kind = _CLASS[symbol]
    context = np.zeros(len(symbol), np.int64)
    for k in range(DEPTH, 0, -1):
        context[k:] = context[k:] * CLASSES + np.where(place[k:] >= k, kind[:-k], 0)
        context[:k] *= CLASSES
    return context * SYMBOLS + symbol, word


def log_spelling(table: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural logarithm of each word's probability under the spelling model."""
    out = np.zeros(len(lengths))
    step = 1 << 16
    ends = np.r_[0, np.cumsum(lengths)]
    for a in range(0, len(lengths), step):
        b = min(len(lengths), a + step)
        key, word = spelled(data[ends[a] : ends[b]], lengths[a:b])
        out[a:b] = np.bincount(word, np.log(table.reshape(-1)[key]), b - a)
    return out


# Words of a block travel packed: their bytes and lengths, and the contexts with counts; to be scored, their hashes and occurrences.


@dataclass
class _Block:
    number: int
    ids: list
    held: list
    data: list
    n: int = 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """Runs of whole texts, each with a number of its own."""
    part = TaskContext.get().partitionId() << 32
    now = _Block(part, [], [], [])
    for batch in batches:
        ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b, data, offsets in chunks(batch.column(2)):
            if now.ids and (now.n + len(data) > BLOCK or len(now.ids) + b - a > BLOCK_TEXTS):
                yield now
                now = _Block(now.number + 1, [], [], [])
            now.ids += ids[a:b]
            now.held += held[a:b]
            now.data.append((data, offsets))
            now.n += len(data)
    if now.ids:
        yield now
    release()


def _tally(block: _Block):
    """Hash, first byte and length of each distinct token; which token, context and text each occurrence has; the lower-cased bytes.

    The end of a text is the empty word.
    """
    hashes, starts, sizes, contexts, texts, base, shift = [], [], [], [], [], 0, 0
    nothing = hash_ranges(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))
    for data, offsets in block.data:
        h, first, end, at = words(data, offsets, NOT_SPACE)
        n = len(at) - 1
        last = _CLASS[LOWER[data[end - 1]]] if len(h) else np.zeros(0, np.int64)
        before = np.where(end - first > 1, _CLASS[LOWER[data[np.maximum(end - 2, 0)]]], 0) if len(h) else last
        # every text's end goes behind its words, and a token's context is that of the token before it
        place = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(at))
        ends = at[1:] + np.arange(n)
        context = np.zeros(len(h) + n + 1, np.int64)
        context[place + 1] = last * CLASSES + before
        context[ends + 1] = 0
        text = np.repeat(np.arange(n), np.diff(at) + 1)
        both = [np.zeros(len(h) + n, k) for k in (np.uint64, np.int32, np.int32)]
        for whole, own, of_end in zip(both, (h, first + shift, end - first), (nothing[0], 0, 0)):
            whole[place], whole[ends] = own, of_end
        for found, own in zip((hashes, starts, sizes, contexts, texts), (*both, context[:-1].astype(np.int16), (text + base).astype(np.int32))):
            found.append(own)
        base, shift = base + n, shift + len(data)
    key, some, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    start, size = (np.concatenate(x)[some].astype(np.int64) for x in (starts, sizes))
    context, text = np.concatenate(contexts), np.concatenate(texts)
    return key, start, size, which, context, text, LOWER[np.concatenate([d for d, _ in block.data])]


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _packed(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, so that no more than one is held as Python values; columns without any are not looked into."""
    for batch in batches:
        blank = dict.fromkeys(batch.schema.names)
        some = [(f, batch.column(j)) for j, f in enumerate(batch.schema.names) if batch.column(j).null_count < batch.num_rows]
        for k in range(batch.num_rows):
            yield blank | {f: c[k].as_py() for f, c in some}


#: ``fan``: training contexts of each word; ``ctx`` and ``train``: these and their counts, word by word in order.
_WORDS = "bucket long, lengths binary, spelling binary, fan binary, ctx binary, train binary"


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, held_out, text) to the distinct words of each block, words that are only held out among them."""
        for block in _blocks(batches):
            key, start, size, which, context, text, whole = _tally(block)
            learned = ~np.array(block.held, bool)[text]
            pair, count = np.unique(which[learned] * CONTEXTS[0] + context[learned], return_counts=True)
            fan = np.bincount(pair // CONTEXTS[0], minlength=len(key))
            ends, of = np.cumsum(fan), _bucket(key, buckets)
            for b in np.unique(of).tolist():
                at = np.flatnonzero(of == b)
                own = ranges(ends[at] - fan[at], fan[at])
                yield _packed([(b, size[at].astype(np.uint32).tobytes(), whole[ranges(start[at], size[at])].tobytes(), fan[at].astype(np.uint16).tobytes(), (pair[own] % CONTEXTS[0]).astype(np.uint16).tobytes(), count[own].astype(np.uint32).tobytes())], _WORDS)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket to its vocabulary with the counts of the corpus; held are the distinct words of a bucket, twice at most."""
    parts: list[tuple[np.ndarray, ...]] = []

    def merged() -> None:
        size, data, fan, ctx, train = (np.concatenate(x) for x in zip(*parts))
        end = np.cumsum(size)
        h, some, which = np.unique(hash_ranges(data, end - size, end), return_index=True, return_inverse=True)
        pair, place = np.unique(np.repeat(which, fan) * CONTEXTS[0] + ctx, return_inverse=True)
        parts[:] = [(size[some], data[ranges((end - size)[some], size[some])], np.bincount(pair // CONTEXTS[0], minlength=len(h)), pair % CONTEXTS[0], np.bincount(place, train, len(pair)).astype(np.int64))]

    def ready(bucket: int) -> Iterator[pa.RecordBatch]:
        merged()
        size, data, fan, ctx, train = parts.pop()
        ends, fans = np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(fan)]
        for a in range(0, len(size), ROW):
            b = min(len(size), a + ROW)
            own = slice(fans[a], fans[b])
            yield _packed([(bucket, size[a:b].astype(np.uint32).tobytes(), data[ends[a] : ends[b]].tobytes(), fan[a:b].astype(np.uint16).tobytes(), ctx[own].astype(np.uint16).tobytes(), train[own].astype(np.int64).tobytes())], _WORDS)

    last = None
    for row in _rows(batches):
        if row["bucket"] != last:
            if last is not None:
                yield from ready(last)
            last = row["bucket"]
        parts.append(tuple(np.frombuffer(row[c], k).astype(t) for c, k, t in (("lengths", np.uint32, np.int64), ("spelling", np.uint8, np.uint8), ("fan", np.uint16, np.int64), ("ctx", np.uint16, np.int64), ("train", np.uint32, np.int64))))
        if len(parts) > 1 and sum(len(p[3]) + len(p[0]) for p in parts[1:]) > max(1 << 19, len(parts[0][3]) + len(parts[0][0])):
            merged()
    if last is not None:
        yield from ready(last)


@dataclass
class Totals:
    """Tables of every restaurant by level (two classes of context, one, none) in a seating, and customers of the first."""

    customers: np.ndarray
    tables: tuple[np.ndarray, ...]

    def whole(self, level: int) -> np.ndarray:
        """Customers and strength of each restaurant of a level."""
        n = self.customers if level == 0 else self.tables[level - 1].reshape(CONTEXTS[level], -1).sum(axis=1)
        return STRENGTH[level] + n

    def fresh(self, level: int, discounts: tuple[float, ...]) -> np.ndarray:
        """Mass of a new table in each restaurant of a level."""
        return STRENGTH[level] + discounts[level] * self.tables[level]


class Dishes:
    """Words of a row of the vocabulary with their contexts: places of the levels' dishes in each other."""

    def __init__(self, fan: np.ndarray, ctx: np.ndarray):
        word = np.repeat(np.arange(len(fan)), fan)
        self.keys = [word * CONTEXTS[0] + ctx]
        one, self.up = np.unique(word * CONTEXTS[1] + ctx // CLASSES, return_inverse=True)
        self.keys.append(one)
        self.word = one // CONTEXTS[1]
        self.n = len(fan)
        self.context = [ctx, one % CONTEXTS[1], np.zeros(self.n, np.int64)]

    def customers(self, train: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
        sums = lambda at, x, n: np.bincount(at, x, n).astype(np.int64)
        return [train, sums(self.up, tables[0], len(self.word)), sums(self.word, tables[1], self.n)]

    def split(self, values: np.ndarray) -> list[np.ndarray]:
        """A row's tables of all levels from one array."""
        a, b = len(self.up), len(self.up) + len(self.word)
        return [values[:a].astype(np.int64), values[a:b].astype(np.int64), values[b:].astype(np.int64)]

    def first(self, train: np.ndarray) -> list[np.ndarray]:
        """One table each."""
        out = [np.minimum(train, 1), np.ones(len(self.word), np.int64)]
        return [*out, (np.bincount(self.word, minlength=self.n) > 0).astype(np.int64)]

    def sweep(self, train: np.ndarray, tables: list[np.ndarray], base: np.ndarray, totals: Totals, rates: list[np.ndarray], discounts: tuple[float, ...], h: np.ndarray, sweep: int) -> list[np.ndarray]:
        """All dishes seated anew, deepest contexts first; ``h``: hashes of the words."""
        now = self.customers(train, tables)
        out = list(tables)
        fresh2 = totals.fresh(2, discounts)[0] * base
        p2 = (np.maximum(now[2] - discounts[2] * tables[2], 0) + fresh2) / totals.whole(2)[0]
        fresh1 = totals.fresh(1, discounts)[self.context[1]] * p2[self.word]
        whole1 = totals.whole(1)[self.context[1]]
        hashes = [h[self.keys[0] // CONTEXTS[0]] + self.context[0].astype(np.uint64) * np.uint64(3), h[self.word] + self.context[1].astype(np.uint64) * np.uint64(3) + np.uint64(1), h + np.uint64(2)]
        odds, step, lost = without(tables[0], now[1][self.up], tables[1][self.up], fresh1[self.up], whole1[self.up], discounts[1])
        r = rates[0][self.context[0]]
        out[0] = seat(train, r * odds, discounts[0], mix(hashes[0]), sweep, (r * step, lost, tables[0]))
        now[1] = np.bincount(self.up, out[0], len(self.word)).astype(np.int64)
        odds, step, lost = without(tables[1], now[2][self.word], tables[2][self.word], fresh2[self.word], np.broadcast_to(totals.whole(2), len(self.word)), discounts[2])
        r = rates[1][self.context[1]]
        out[1] = seat(now[1], r * odds, discounts[1], mix(hashes[1]), sweep, (r * step, lost, tables[1]))
        now[2] = np.bincount(self.word, out[1], self.n).astype(np.int64)
        out[2] = seat(now[2], rates[2][0] * base, discounts[2], mix(hashes[2]), sweep)
        return out

    def predict(self, train: np.ndarray, tables: list[np.ndarray], base: np.ndarray, totals: Totals, discounts: tuple[float, ...], word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Probability of each ``word`` (its place) after each ``context`` under a seating."""
        now = self.customers(train, tables)
        p = ((np.maximum(now[2] - discounts[2] * tables[2], 0) + totals.fresh(2, discounts)[0] * base) / totals.whole(2)[0])[word]
        for level in (1, 0):
            own = context // CLASSES if level else context
            at, there = self.find(level, word * CONTEXTS[level] + own)
            seen = np.where(there, (now[level] - discounts[level] * tables[level])[at], 0) if len(self.keys[level]) else 0
            p = (seen + totals.fresh(level, discounts)[own] * p) / totals.whole(level)[own]
        return p

    def find(self, level: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys[level], key), max(0, len(self.keys[level]) - 1))
        return at, self.keys[level][at] == key if len(self.keys[level]) else np.zeros(len(key), bool)


#: A row of the vocabulary with its tables now, and with tables and spelling probabilities of the seatings that are averaged; rows of sums have a part instead.
_STATE = "bucket long, lengths binary, spelling binary, fan binary, ctx binary, train binary, tables binary, past binary, part long, keys binary, counts binary"
_KEYS = "part long, keys binary, counts binary"
#: Sums travel in so many parts.
_PARTS = 16
#: What is summed behind the spelling keys: customers and tables of the restaurants, words learned from, and dishes of each level with one and with two customers.
_SUMMED = np.cumsum([SPELLED, CONTEXTS[0], *CONTEXTS, 1, 6])


def _arrays(row: dict) -> tuple[np.ndarray, ...]:
    size = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
    data, end = np.frombuffer(row["spelling"], np.uint8), np.cumsum(size)
    fan, ctx = (np.frombuffer(row[c], np.uint16).astype(np.int64) for c in ("fan", "ctx"))
    return hash_ranges(data, end - size, end), data, size, Dishes(fan, ctx), np.frombuffer(row["train"], np.int64)


def _sweep(held, totals: Totals | None, rates, discounts, sweep: int):
    """The vocabulary after ``sweep`` sweeps, with the ``totals`` and the spelling model of these, to that after one more.

    Sweep 0 gives every dish one table. The last seatings are kept; the pass after the last sweep only does that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt = None if held is None else np.frombuffer(_zstd().decompress(held.value, SPELLED * 4), np.float32).reshape(-1, SYMBOLS)
        spellings: list[tuple[np.ndarray, np.ndarray]] = []
        others = np.zeros(int(_SUMMED[-1]) - SPELLED, np.int64)
        for row in _rows(batches):
            h, data, size, dishes, train = _arrays(row)
            past = row["past"] or b""
            if sweep:
                tables, log_base = dishes.split(np.frombuffer(row["tables"], np.uint32)), log_spelling(spelt, data, size)
                if sweep > SWEEPS - AVERAGED + 1:
                    past += row["tables"] + log_base.tobytes()
            if sweep <= SWEEPS:
                tables = dishes.sweep(train, tables, np.exp(log_base), totals, rates, discounts, h, sweep) if sweep else dishes.first(train)
                ends = np.r_[0, np.cumsum(size)]
                for a in range(0, len(size), 1 << 14):
                    b = min(len(size), a + (1 << 14))
                    key, word = spelled(data[ends[a] : ends[b]], size[a:b])
                    some, which = np.unique(key, return_inverse=True)
                    spellings.append((some, np.bincount(which, tables[2][a:b][word], len(some))))
                    if len(spellings) > 16:
                        spellings = [_sums(spellings)]
                customers = dishes.customers(train, tables)
                few = [(c == n).sum() for c in customers for n in (1, 2)]
                for k, own in enumerate((np.bincount(dishes.context[0], train, CONTEXTS[0]), *(np.bincount(c, t, n) for c, t, n in zip(dishes.context, tables, CONTEXTS)), np.array([(customers[2] > 0).sum()]), np.array(few))):
                    others[_SUMMED[k] - SPELLED : _SUMMED[k + 1] - SPELLED] += own.astype(np.int64)
            now = np.concatenate(tables).astype(np.uint32).tobytes() if sweep <= SWEEPS else row["tables"]
            yield _packed([(*(row[c] for c in ("bucket", "lengths", "spelling", "fan", "ctx", "train")), now, past, None, None, None)], _STATE)
        if sweep <= SWEEPS and others.any():
            some = np.flatnonzero(others)
            keys, found = _sums([*spellings, (some + SPELLED, others[some])])
            part, found = keys % _PARTS, found.astype(np.int64)
            yield _packed([(*[None] * 8, k, keys[part == k].tobytes(), found[part == k].tobytes()) for k in range(_PARTS) if (part == k).any()], _STATE)
        release()

    return run


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(which, np.concatenate([n for _, n in parts]), len(keys))


def _sum_keys(batches: Iterator[pa.RecordBatch], most: int = int(_SUMMED[-1])) -> Iterator[pa.RecordBatch]:
    """Sums of each part; the stream is sorted by part."""
    last, total = None, np.zeros(0, np.int64)

    def ready() -> pa.RecordBatch:
        some = np.flatnonzero(total)
        return _packed([(last, (some * _PARTS + last).tobytes(), total[some].tobytes())], _KEYS)

    for row in _rows(batches):
        if row["part"] != last:
            if last is not None:
                yield ready()
            last, total = row["part"], np.zeros(most // _PARTS + 1, np.int64)
        total[np.frombuffer(row["keys"], np.int64) // _PARTS] += np.frombuffer(row["counts"], np.int64)
    if last is not None:
        yield ready()


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def _train(batches: Iterator[pa.RecordBatch], most: int = int(_SUMMED[-1])) -> Iterator[pa.RecordBatch]:
    """Sums to the spelling model, compressed (part 0), and the other sums (part 1); keys are less than ``most``."""
    rows = [(row["keys"], row["counts"]) for row in _rows(batches)]
    if rows:
        keys, counts = (np.frombuffer(b"".join(r[k] for r in rows), np.int64) for k in (0, 1))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        n = np.searchsorted(keys, SPELLED)
        others = np.zeros(most - SPELLED, np.int64)
        others[keys[n:] - SPELLED] = counts[n:]
        yield _packed([(1, others.tobytes())], "part long, table binary")
        if n:
            yield _packed([(0, _zstd().compress(spelling(keys[:n], counts[:n]), asbytes=True))], "part long, table binary")
        release()


def _fit_spelling(state: DataFrame, summed_to: np.ndarray = _SUMMED) -> tuple[bytes, list[np.ndarray]]:
    """The spelling model of all tables, compressed, and the other sums; one task, whose memory is fixed by the number of contexts."""
    most = int(summed_to[-1])
    summed = grouped(state.where(F.col("part").isNotNull()).select("part", "keys", "counts"), ["part"], lambda b: _sum_keys(b, most), _KEYS, _PARTS)
    rows = {r.part: bytes(r.table) for r in summed.coalesce(1).mapInArrow(lambda b: _train(b, most), "part long, table binary").collect()}
    others = np.frombuffer(rows[1], np.int64) if rows else np.zeros(most - SPELLED, np.int64)
    table = rows[0] if 0 in rows else _zstd().compress(np.full(SPELLED, 1 / SYMBOLS, np.float32), asbytes=True)
    return table, np.split(others, summed_to[1:-1] - SPELLED)


@dataclass
class Lexicon:
    """What the restaurants know together: training tokens and distinct words, discounts by level, totals of the seatings that are averaged."""

    n: int = 0
    types: int = 0
    discounts: tuple[float, ...] = ()
    past: tuple[Totals, ...] = ()


def _seated(vocabulary: DataFrame, store: Store) -> tuple[DataFrame, Lexicon]:
    """``vocabulary`` after all sweeps, with the seatings that are averaged."""
    context, lexicon, past = vocabulary.sparkSession.sparkContext, Lexicon(), []
    nothing = F.lit(None).cast("binary")
    now, held, totals, rates = vocabulary.withColumns({"tables": nothing, "past": nothing}), None, None, None
    now._kept_at = vocabulary._kept_at
    for sweep in range(SWEEPS + 2):
        after = store.keep(now.select(*(c.split()[0] for c in _STATE.split(", ")[:8])).mapInArrow(_sweep(held, totals, rates, lexicon.discounts, sweep), _STATE), "seated")
        if held is not None:
            held.unpersist()
        if sweep > SWEEPS - AVERAGED + 1:
            past.append(totals)
        store.drop(now)
        now = after.where("part is null")
        now._kept_at = after._kept_at
        if sweep <= SWEEPS:
            table, (customers, two, one, none, types, few) = _fit_spelling(after)
            totals = Totals(customers, (two, one, none))
            if not sweep:
                lexicon.n, lexicon.types = int(customers.sum()), int(types[0])
                lexicon.discounts = tuple(discount_from(int(few[2 * k]), int(few[2 * k + 1])) for k in range(3))
            rng = np.random.default_rng(sweep + 1)
            rates = [rate(t, s, d, rng) for t, s, d in zip(totals.tables, STRENGTH, lexicon.discounts)]
            held = context.broadcast(table)
    lexicon.past = tuple(past)
    return now, lexicon


_SENT = "bucket long, block long, hashes binary, fan binary, ctx binary, train binary, past binary, texts binary, n long, ids binary, flags binary"
_SUMS = "block long, bucket long, n binary, known binary, base binary, score binary, ids binary, flags binary"


def _send(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts to the words of each block with their occurrences (``fan``: how often; contexts and texts word by word), a row for each bucket."""
        for block in _blocks(batches):
            key, _, size, which, context, text, _ = _tally(block)
            order = np.argsort(which, kind="stable")
            count = np.bincount(which, minlength=len(key))
            ends, of = np.cumsum(count), _bucket(key, buckets)
            last = int(of[size == 0][0])  # every text has an end, so this bucket has a row of the block: it takes the ids
            ids = np.array([0 if i is None else i for i in block.ids], np.int64).tobytes()
            flags = np.array([2 * (i is None) + bool(h) for i, h in zip(block.ids, block.held)], np.uint8).tobytes()
            for b in np.unique(of).tolist():
                at = np.flatnonzero(of == b)
                own = order[ranges(ends[at] - count[at], count[at])]
                sent = key[at].tobytes(), count[at].astype(np.uint32).tobytes(), context[own].astype(np.uint16).tobytes(), None, None, text[own].astype(np.uint16).tobytes()
                yield _packed([(b, block.number, *sent, len(block.ids), *((ids, flags) if b == last else (None, None)))], _SENT)

    return run


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the vocabulary as they are asked in scoring: hashes instead of spellings."""
    for row in _rows(batches):
        yield _packed([(row["bucket"], -1, _arrays(row)[0].tobytes(), row["fan"], row["ctx"], row["train"], row["past"], None, 0, None, None)], _SENT)


class _Bucket:
    """The vocabulary of a bucket, from its rows."""

    def __init__(self, rows: list[dict], seatings: int):
        parts, bases = [], []
        for r in rows:
            h = np.frombuffer(r["hashes"], np.uint64)
            dishes = Dishes(*(np.frombuffer(r[c], np.uint16).astype(np.int64) for c in ("fan", "ctx")))
            n, at, own, base = len(dishes.up) + len(dishes.word) + dishes.n, 0, [], []
            for _ in range(seatings):
                own.append(dishes.split(np.frombuffer(r["past"], np.uint32, n, at)))
                base.append(np.exp(np.frombuffer(r["past"], np.float64, dishes.n, at + 4 * n)))
                at += 4 * n + 8 * dishes.n
            parts.append((h, np.frombuffer(r["fan"], np.uint16).astype(np.int64), np.frombuffer(r["ctx"], np.uint16).astype(np.int64), np.frombuffer(r["train"], np.int64), own))
            bases.append(base)
        self.h, fan, ctx, self.train = (np.concatenate([p[k] for p in parts]) for k in range(4))
        self.dishes = Dishes(fan, ctx)
        self.tables = [[np.concatenate([p[4][s][k] for p in parts]) for k in range(3)] for s in range(seatings)]
        self.base = [np.concatenate([b[s] for b in bases]) for s in range(seatings)]
        self.count = np.bincount(np.repeat(np.arange(len(fan)), fan), self.train, len(fan)).astype(np.int64)
        self.order = np.argsort(self.h)
        self.sorted = self.h[self.order]

    def place(self, h: np.ndarray) -> np.ndarray:
        return self.order[np.searchsorted(self.sorted, h)]  # every word is there

    def probability(self, lexicon: Lexicon, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """The average over the seatings."""
        return sum(self.dishes.predict(self.train, t, b, totals, lexicon.discounts, word, context) for t, b, totals in zip(self.tables, self.base, lexicon.past)) / len(lexicon.past)


def _score(lexicon: Lexicon):
    """Rows of a bucket, its words first (block -1), to sums by text for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, bucket = None, [], None
        for row in _rows(batches):
            if row["bucket"] != last:
                last, rows, bucket = row["bucket"], [], None
            if row["block"] < 0:
                rows.append(row)
                continue
            if bucket is None:
                bucket, rows = _Bucket(rows, len(lexicon.past)), []
            times = np.frombuffer(row["fan"], np.uint32)
            word = np.repeat(bucket.place(np.frombuffer(row["hashes"], np.uint64)), times)
            context, text = (np.frombuffer(row[c], np.uint16).astype(np.int64) for c in ("ctx", "texts"))
            n, c = row["n"], bucket.count[word]
            plain = np.log10((c + 1) / (lexicon.n + lexicon.types + 1))
            score = np.log10(np.maximum(bucket.probability(lexicon, word, context), 1e-300))
            sums = (np.bincount(text, x, n).tobytes() for x in (plain, score))
            yield _packed([(row["block"], last, np.bincount(text, minlength=n).astype(np.uint32).tobytes(), np.bincount(text, c > 0, n).astype(np.uint32).tobytes(), *sums, row["ids"], row["flags"])], _SUMS)

    return run


def _add(lexicon: Lexicon):
    """Sums of a block by bucket, sorted by both, to a row for each text."""
    kinds = {"n": np.uint32, "known": np.uint32, "base": np.float64, "score": np.float64}

    def ready(total: dict, ids, flags) -> pa.RecordBatch:
        ids, flags = np.frombuffer(ids, np.int64), np.frombuffer(flags, np.uint8)
        whole = [pa.array(total[c].astype(np.int64)) for c in ("n", "known")]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=flags >= 2), pa.array(flags % 2 == 1), *whole, pa.array(np.full(len(ids), lexicon.n)), pa.array(total["base"]), pa.array(total["score"])],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, ids, flags = None, {}, None, None
        for row in _rows(batches):
            if row["block"] != last:
                if last is not None:
                    yield ready(total, ids, flags)
                last, total = row["block"], {}
            for c, kind in kinds.items():
                total[c] = np.frombuffer(row[c], kind).astype(np.float64) + total.get(c, 0)
            if row["ids"] is not None:
                ids, flags = row["ids"], row["flags"]
        if last is not None:
            yield ready(total, ids, flags)

    return run


def score_texts(docs: DataFrame, store: Store) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, held_out, text).

    Tokens are runs of other bytes than space and 09 to 0D with A-Z lower-cased, then
    the end of the text; null and empty texts have the end alone. The model is
    learned from the rows that are not held out; a word that they lack has the
    probability of a new table with its spelling, so that the probabilities of all
    strings of bytes sum to one. base_score is the sum of the add-one log10
    probabilities, score that of the model's. Without training rows every spelling
    is equally likely byte by byte. Perplexity is 10 ** (-score / n_tokens). Rows
    with equal ids stay apart. The scores are the same however the rows are
    partitioned.
    """
    source = docs.select("doc_id", "held_out", "text")
    size = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(BUCKETS, int((size / BUCKET_BYTES) ** POWER))
    sent = source.mapInArrow(_count(buckets), _WORDS)
    vocabulary = store.keep(sent.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(_merge, _WORDS), "vocabulary")
    seated, lexicon = _seated(vocabulary, store)
    asked = source.mapInArrow(_send(buckets), _SENT).unionByName(seated.select("bucket", "lengths", "spelling", "fan", "ctx", "train", "past").mapInArrow(_known, _SENT))
    scored = asked.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "block").mapInArrow(_score(lexicon), _SUMS)
    by_block = scored.repartition("block").sortWithinPartitions("block", "bucket")
    return by_block.mapInArrow(_add(lexicon), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
