"""The hierarchical Pitman-Yor model with a restaurant for each whole word before.

On top of the restaurants of ``pitman_yor`` (two classes of bytes, one, none) each
distinct token has a restaurant of the tokens behind it, whose parent is that of
its own two classes. Texts begin behind the empty word. No context is dropped,
merged or capped.

A dish's customers are the occurrences of a pair of tokens. A pair that occurs once
has one table in every seating, so sweeps carry only those that occur more often.
Dishes are kept with their words, by bucket. A restaurant's total is made at the home
of its own token, a range of hashes: every sweep the buckets send there the tables of
their pairs by token before, and get the restaurants' rates back. For scores they get
customers and tables of the restaurants in the seatings that are averaged.

Texts are read and sent once. A bucket numbers its words, the tokens before them and
its distinct pairs, held-out ones among them, in the order of their hashes; from then
on numbers stand for hashes, and lists whose order both ends know travel without keys.
Blocks stay as numbers of pairs, which rise, and are scored by those; each pair of a
bucket is scored once. What does not change in sweeps is kept apart from what does.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import pitman_yor as py
from .store import Store, documents, release
from .text import hash_ranges, mix, ranges

#: Strength of the restaurants of whole words.
STRENGTH = 1.0
#: Buckets of words at least, and the power with which they grow (``pitman_yor`` has the bytes for one at first); buckets for each home of restaurants.
BUCKETS, POWER, FOR_HOME = 32, 0.7, 4
#: Pairs that are scored at a time.
STEP = 1 << 18
#: ``kind`` of a row, in the order in which a bucket takes them: answers of a home, the bounds of homes in the list of tokens before, a seating, all pairs, the
#: vocabulary, blocks; and what homes get and keep: tokens asked for, restaurants, places of a bucket's tokens in these, tables; sums of the model.
ANSWERS, HOMES, SEATED, PAIRS, WORDS, BLOCKS, ASKS, KEPT, PLACES, TABLES, SUMS = range(11)
#: ``hot_*``: pairs of two customers and more, word by word, with the place of the token before among those of such pairs, and of their parents' dishes;
#: ``pair_*``: all pairs, with 0, 1 or 2 for none, one and more customers; ``us*``: tokens before.
_COLUMNS = (
    "kind long, bucket long, origin long, part long, n long, lengths binary, spelling binary, fan binary, ctx binary, train binary, hot_u binary, hot_n binary, hot_at binary, "
    "tables binary, hot_t binary, pair_fan binary, pair_u binary, pair_n binary, us binary, us_ctx binary, us_n binary, us_once binary, us_hot binary, xs binary, "
    "keys binary, counts binary, held binary, times binary, texts binary, ids binary, flags binary"
)
_KINDS = dict(c.split() for c in _COLUMNS.split(", "))


@cache
def _null(kind: str) -> pa.Array:
    return pa.nulls(1, {"long": pa.int64(), "binary": pa.binary()}[kind])


def _row(**values) -> pa.RecordBatch:
    arrays = [_null(t) if (v := values.get(c)) is None else pa.array([v], pa.int64() if t == "long" else pa.binary()) for c, t in _KINDS.items()]
    return pa.RecordBatch.from_arrays(arrays, list(_KINDS))


@cache
def _fast() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def squeeze(x: np.ndarray) -> bytes:
    """Numbers of 0 and more as compressed bytes, of the least width that holds them; all first bytes come before all second ones."""
    x = np.asarray(x)
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)
    x = np.ascontiguousarray(x, f"<u{width}")
    flat = x if width == 1 else np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + x.nbytes.to_bytes(8, "little") + _fast().compress(flat.tobytes(), asbytes=True)


def spread(data: bytes, to=np.int64) -> np.ndarray:
    width, size = data[0], int.from_bytes(data[1:9], "little")
    if not size:
        return np.zeros(0, to)
    flat = np.frombuffer(_fast().decompress(data[9:], size), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(f"<u{width}").reshape(-1).astype(to)


def rising(x: np.ndarray) -> bytes:
    """Numbers that rise, by their steps."""
    return squeeze(np.diff(x, prepend=x.dtype.type(0)))


def risen(data: bytes, to=np.int64) -> np.ndarray:
    return np.cumsum(spread(data, to), dtype=to)


def pair_hash(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(word * np.uint64(3) + mix(before + np.uint64(0x632BE59BD9B4E019)))


def gamma(shape: np.ndarray, h: np.ndarray, salt: int) -> np.ndarray:
    """A gamma variate of each shape of 1 and more, from each hash (Marsaglia and Tsang)."""
    d = shape - 1 / 3
    c, out, left = 1 / np.sqrt(9 * d), d.copy(), np.arange(len(d))
    for k in range(64):
        if not len(left):
            break
        three = [py.uniform(h[left], 1000 + 300 * salt + 3 * k + j) for j in range(3)]
        x = np.sqrt(-2 * np.log(three[0])) * np.cos(2 * np.pi * three[1])
        v = (1 + c[left] * x) ** 3
        good = (v > 0) & (np.log(three[2]) < 0.5 * x * x + d[left] * (1 - v + np.log(np.maximum(v, 1e-300))))
        out[left[good]] = (d[left] * v)[good]
        left = left[~good]
    return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of some sorted runs, the first place of each, and which of them each is."""
    order = np.argsort(x, kind="stable")
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return x[new], order[new], which


def _home(u: np.ndarray, homes: int) -> np.ndarray:
    """Homes take ranges of hashes, so that sorted tokens go to them in slices."""
    return (((u >> np.uint64(32)) * np.uint64(homes)) >> np.uint64(32)).astype(np.int64)


def _send(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, held_out, text) to the distinct words and pairs of each block with their occurrences, a row for each bucket of words."""
        for block in py._blocks(batches):
            key, start, size, which, context, text, whole = py._tally(block)
            held = np.array(block.held, bool)
            before = np.r_[np.flatnonzero(size == 0)[:1], which[:-1]]
            of_key = np.zeros(len(key), np.int64)
            of_key[before] = context
            code = which * len(key) + before
            order = np.argsort(code, kind="stable")
            code, texts = code[order], text[order]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            times = np.diff(np.r_[first, len(code)])
            unlearned = np.add.reduceat(held[texts].astype(np.int64), first)
            word, before = np.divmod(code[first], len(key))
            fan = np.bincount(word, minlength=len(key))
            fans, of = np.cumsum(fan), py._bucket(key, buckets)
            last = int(of[size == 0][0])  # every text has an end, so this bucket has a row of the block: it takes the ids
            ids = np.array([0 if i is None else i for i in block.ids], np.int64)
            flags = np.array([2 * (i is None) + bool(h) for i, h in zip(block.ids, block.held)], np.uint8)
            for b in np.unique(of).tolist():
                at = np.flatnonzero(of == b)
                own = ranges(fans[at] - fan[at], fan[at])
                there = np.zeros(len(key), bool)
                there[before[own]] = True
                us = np.flatnonzero(there)
                yield _row(
                    kind=BLOCKS, bucket=b, part=block.number, n=len(block.ids), lengths=squeeze(size[at]), spelling=whole[ranges(start[at], size[at])].tobytes(), fan=squeeze(fan[at]),
                    us=rising(key[us]), us_ctx=squeeze(of_key[us]), pair_u=squeeze((np.cumsum(there) - 1)[before[own]]), times=squeeze(times[own]), held=squeeze(unlearned[own]),
                    texts=squeeze(texts[ranges(first[own], times[own])]), **({"ids": ids.tobytes(), "flags": flags.tobytes()} if b == last else {}),
                )

    return run


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[dict]]]:
    last, rows = None, []
    for row in py._rows(batches):
        if row[column] != last and rows:
            yield last, rows
            rows = []
        last = row[column]
        rows.append(row)
    if rows:
        yield last, rows


def _merge(homes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket to its vocabulary, its pairs, its blocks as numbers of pairs, and the tokens that are asked for."""
        for bucket, rows in _groups(batches, "bucket"):
            sizes = [spread(r["lengths"]) for r in rows]
            size, data = np.concatenate(sizes), np.frombuffer(b"".join(r.pop("spelling") for r in rows), np.uint8)
            end = np.cumsum(size)
            h, some, which = _distinct(hash_ranges(data, end - size, end))
            us = [risen(r.pop("us"), np.uint64) for r in rows]
            u, first, place = _distinct(np.concatenate(us))
            u_ctx = np.concatenate([spread(r["us_ctx"]) for r in rows])[first]
            words, tokens = (np.r_[0, np.cumsum([len(x) for x in xs])] for xs in (sizes, us))
            codes = [np.repeat(which[words[k] : words[k + 1]], spread(r["fan"])) * len(u) + place[tokens[k] + spread(r["pair_u"])] for k, r in enumerate(rows)]
            ends = np.cumsum([len(c) for c in codes])
            code, _, pair = _distinct(np.concatenate(codes))
            n = np.bincount(pair, np.concatenate([spread(r["times"]) - spread(r["held"]) for r in rows]), len(code)).astype(np.int64)
            for r, a, b in zip(rows, np.r_[0, ends], ends):
                yield _row(kind=BLOCKS, bucket=bucket, **{c: r[c] for c in ("part", "n", "times", "texts", "ids", "flags")}, keys=rising(pair[a:b]))
            del rows, codes, pair, us, place, which, first
            word, token = np.divmod(code, len(u))
            customers, once = (np.bincount(token, x, len(u)).astype(np.int64) for x in (n, n == 1))
            hot = np.bincount(token, n > 1, len(u)) > 0
            cuts = np.searchsorted(_home(u, homes), np.arange(homes + 1))
            yield _row(kind=HOMES, bucket=bucket, xs=squeeze(np.r_[0, np.cumsum(hot)][cuts]), us_ctx=squeeze(u_ctx))
            for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                if a < b:
                    yield _row(kind=ASKS, bucket=k, origin=bucket, us=rising(u[a:b]), us_n=squeeze(customers[a:b]), us_once=squeeze(once[a:b]), us_hot=squeeze(hot[a:b]))
            size, start, of_hot = size[some], (end - size)[some], np.cumsum(hot) - 1
            for a in range(0, len(h), py.ROW):
                b = min(len(h), a + py.ROW)
                low, high = np.searchsorted(word, (a, b))
                yield _row(kind=PAIRS, bucket=bucket, origin=a, pair_fan=squeeze(np.bincount(word[low:high] - a, minlength=b - a)), pair_u=squeeze(token[low:high]), pair_n=squeeze(np.minimum(n[low:high], 2)))
                own = low + np.flatnonzero(n[low:high])
                dish, _, at = _distinct((word[own] - a) * py.CONTEXTS[0] + u_ctx[token[own]])
                now = n[own]
                yield _row(
                    kind=WORDS, bucket=bucket, origin=a, lengths=squeeze(size[a:b]), spelling=data[ranges(start[a:b], size[a:b])].tobytes(), fan=squeeze(np.bincount(dish // py.CONTEXTS[0], minlength=b - a)),
                    ctx=squeeze(dish % py.CONTEXTS[0]), train=squeeze(np.bincount(at[now == 1], minlength=len(dish))), hot_u=squeeze(of_hot[token[own[now > 1]]]), hot_n=squeeze(now[now > 1]), hot_at=squeeze(at[now > 1]),
                )
        release()

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ASKS of a home, sorted, to what it knows of its restaurants for good, and the places in these of each bucket's tokens; part 1: of those with hot pairs only."""
    for home, rows in _groups(batches, "bucket"):
        us = [risen(r["us"], np.uint64) for r in rows]
        u, _, place = _distinct(np.concatenate(us))
        customers, once = (np.bincount(place, np.concatenate([spread(r[c]) for r in rows]), len(u)).astype(np.int64) for c in ("us_n", "us_once"))
        own = np.concatenate([spread(r["us_hot"], bool) for r in rows])
        hot = np.bincount(place, own, len(u)) > 0
        of_hot = np.cumsum(hot) - 1
        yield _row(kind=KEPT, bucket=home, part=0, us_n=squeeze(customers), us_once=squeeze(once), us_hot=squeeze(hot))
        yield _row(kind=KEPT, bucket=home, part=1, us=rising(u[hot]), us_once=squeeze(once[hot]))
        ends = np.cumsum([len(x) for x in us])
        for r, a, b in zip(rows, np.r_[0, ends], ends):
            yield _row(kind=PLACES, bucket=home, origin=r["origin"], part=0, xs=rising(place[a:b]))
            yield _row(kind=PLACES, bucket=home, origin=r["origin"], part=1, xs=rising(of_hot[place[a:b][own[a:b]]]))
    release()


def _answer(seatings: int, discount: float, sweep: int):
    """Rows of a home to the rates of each bucket's tokens, or with ``seatings`` customers and tables by seating; TABLES of part k are those of the k-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, rows in _groups(batches, "bucket"):
            kept = {r["part"]: r for r in rows if r["kind"] == KEPT}
            places = {(r["origin"], r["part"]): risen(r["xs"]) for r in rows if r["kind"] == PLACES}
            once = spread(kept[0 if seatings else 1]["us_once"])
            hot = np.flatnonzero(spread(kept[0]["us_hot"])) if seatings else np.arange(len(once))
            tables = np.repeat(once[None, :], max(1, seatings), axis=0)
            for r in rows:
                if r["kind"] == TABLES:
                    tables[r["part"] - 1, hot[places[r["origin"], 1]]] += spread(r["xs"])
            if seatings:
                out = np.vstack([spread(kept[0]["us_n"]), tables])
            else:
                rates = discount * gamma(STRENGTH / discount + tables[0], risen(kept[1]["us"], np.uint64), sweep)
            for (origin, part), place in places.items():
                if part == (0 if seatings else 1):
                    yield _row(kind=ANSWERS, bucket=origin, origin=home, xs=squeeze(out[:, place]) if seatings else rates[place].astype(np.float32).tobytes())
        release()

    return run


def hot_tables(dishes: py.Dishes, train, tables, base, totals: py.Totals, discounts, rates, h, sweep: int, place, n, t, at, discount: float) -> np.ndarray:
    """Pairs of two customers and more seated anew in the restaurants of whole words; ``place``: of the token before among those of the bucket; ``train``: the customers of their parents' dishes."""
    now = dishes.customers(train, tables)
    p2 = (np.maximum(now[2] - discounts[2] * tables[2], 0) + totals.fresh(2, discounts)[0] * base) / totals.whole(2)[0]
    one = dishes.context[1]
    p1 = (np.maximum(now[1] - discounts[1] * tables[1], 0) + totals.fresh(1, discounts)[one] * p2[dishes.word]) / totals.whole(1)[one]
    two = dishes.context[0]
    fresh, whole = totals.fresh(0, discounts)[two] * p1[dishes.up], totals.whole(0)[two]
    odds, step, lost = py.without(t, train[at], tables[0][at], fresh[at], whole[at], discounts[0])
    word = dishes.keys[0][at] // py.CONTEXTS[0]
    return py.seat(n, rates * odds, discount, mix(pair_hash(h[word], place.astype(np.uint64))), sweep, (rates * step, lost, t))


#: What is summed behind the spelling keys: as in ``pitman_yor``, then training tokens, and pairs with one and with two customers.
_SUMMED = np.cumsum([py.SPELLED, py.CONTEXTS[0], *py.CONTEXTS, 1, 6, 3])


def _arrays(row: dict) -> tuple[np.ndarray, ...]:
    """Hashes, bytes and lengths of the words of a row of the vocabulary, their dishes, customers of these for good; tokens before, customers and dishes of hot pairs."""
    size, data = spread(row["lengths"]), np.frombuffer(row["spelling"], np.uint8)
    end = np.cumsum(size)
    dishes = py.Dishes(*(spread(row[c]) for c in ("fan", "ctx")))
    return hash_ranges(data, end - size, end), data, size, dishes, *(spread(row[c]) for c in ("train", "hot_u", "hot_n", "hot_at"))


def _table(held) -> np.ndarray:
    return np.frombuffer(py._zstd().decompress(held.value, py.SPELLED * 4), np.float32).reshape(-1, py.SYMBOLS)


def _base(table: np.ndarray, key: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Probability of each of ``n`` words under a spelling model, from ``pitman_yor.spelled``."""
    return np.exp(np.bincount(word, np.log(table.reshape(-1)[key]), n))


def _sweep(held, totals: py.Totals | None, rates, discounts, discount: float, sweep: int):
    """The seating after ``sweep`` sweeps to that after one more, as in ``pitman_yor``; sweep 0 makes the first.

    Answers, bounds of homes and the seating of a bucket come before its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt = None if held is None else _table(held)
        spellings: list[tuple[np.ndarray, np.ndarray]] = []
        others = np.zeros(int(_SUMMED[-1]) - py.SPELLED, np.int64)
        last, answers, seated, cuts, sums = None, [], {}, None, None

        def told() -> Iterator[pa.RecordBatch]:
            for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                if a < b:
                    yield _row(kind=TABLES, bucket=k, origin=last, part=1, xs=squeeze(sums[a:b]))

        for row in py._rows(batches):
            if row["bucket"] != last:
                if last is not None:
                    yield from told()
                last, answers, seated = row["bucket"], [np.zeros(0, np.float32)], {}
            if row["kind"] == ANSWERS:
                answers.append(np.frombuffer(row["xs"], np.float32))
            elif row["kind"] == HOMES:
                cuts, answers = spread(row["xs"]), np.concatenate(answers).astype(float)
                sums = np.zeros(cuts[-1], np.int64)
            elif row["kind"] == SEATED:
                seated[row["origin"]] = row
            if row["kind"] != WORDS:
                continue
            h, data, size, dishes, once, place, n, at = _arrays(row)
            key, word = py.spelled(data, size)
            customers = lambda t: once + np.bincount(at, t, len(once)).astype(np.int64)  # noqa: E731, B023
            if sweep:
                before = seated.pop(row["origin"])
                tables, t, base = dishes.split(spread(before["tables"])), spread(before["hot_t"]), _base(spelt, key, word, len(size))
                t = hot_tables(dishes, customers(t), tables, base, totals, discounts, answers[place], h, sweep, place, n, t, at, discount)
                train = customers(t)
                tables = dishes.sweep(train, tables, base, totals, rates, discounts, h, sweep)
            else:
                t = np.ones(len(n), np.int64)
                train = customers(t)
                tables = dishes.first(train)
            sums += np.bincount(place, t, len(sums)).astype(np.int64)
            some, which = np.unique(key, return_inverse=True)
            spellings.append((some, np.bincount(which, tables[2][word], len(some))))
            if len(spellings) > 16:
                spellings = [py._sums(spellings)]
            by_level = dishes.customers(train, tables)
            few = [(c == k).sum() for c in by_level for k in (1, 2)]
            whole = np.array([once.sum() + n.sum(), once.sum(), (n == 2).sum()])
            for k, own in enumerate((np.bincount(dishes.context[0], train, py.CONTEXTS[0]), *(np.bincount(c, x, m) for c, x, m in zip(dishes.context, tables, py.CONTEXTS)), np.array([(by_level[2] > 0).sum()]), np.array(few), whole)):
                others[_SUMMED[k] - py.SPELLED : _SUMMED[k + 1] - py.SPELLED] += own.astype(np.int64)
            yield _row(kind=SEATED, bucket=last, origin=row["origin"], tables=squeeze(np.concatenate(tables)), hot_t=squeeze(t))
        if last is not None:
            yield from told()
        if others.any():
            some = np.flatnonzero(others)
            keys, found = py._sums([*spellings, (some + py.SPELLED, others[some])])
            part, found = keys % py._PARTS, found.astype(np.int64)
            for k in range(py._PARTS):
                if (part == k).any():
                    yield _row(kind=SUMS, part=k, keys=keys[part == k].tobytes(), counts=found[part == k].tobytes())
        release()

    return run


def _dealt(df: DataFrame, buckets: int, *order: str) -> DataFrame:
    return df.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", *order)


def _of(df: DataFrame, columns: str, *kinds: int) -> DataFrame:
    """Rows of some kinds; only their ``columns`` are read."""
    own = {"kind", "bucket", *columns.split()}
    return df.where(F.col("kind").isin(*kinds)).select(*(F.col(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in _KINDS.items()))


class _Bucket:
    """What the pairs of a bucket score and whether their words are known, from its rows; seatings are columns."""

    def __init__(self, rows: list[dict], held: list, lexicon: py.Lexicon, discount: float):
        of = lambda kind: [r for r in rows if r["kind"] == kind]
        seated = {(r["origin"], r["part"]): r for r in of(SEATED)}
        words, d = [(r["origin"], *_arrays(r)) for r in of(WORDS)], lexicon.discounts
        keys = [py.spelled(data, size) for _, _, data, size, *_ in words]
        levels, hot = [[] for _ in words], [[] for _ in words]
        for k, totals in enumerate(lexicon.past):
            spelt = _table(held[k])
            for i, (origin, _, _, size, dishes, once, _, n, at) in enumerate(words):
                tables, t = dishes.split(spread(seated[origin, k + 1]["tables"])), spread(seated[origin, k + 1]["hot_t"])
                now = dishes.customers(once + np.bincount(at, t, len(once)).astype(np.int64), tables)
                p2 = (np.maximum(now[2] - d[2] * tables[2], 0) + totals.fresh(2, d)[0] * _base(spelt, *keys[i], len(size))) / totals.whole(2)[0]
                p1 = (now[1] - d[1] * tables[1] + totals.fresh(1, d)[dishes.context[1]] * p2[dishes.word]) / totals.whole(1)[dishes.context[1]]
                p0 = (now[0] - d[0] * tables[0] + totals.fresh(0, d)[dishes.context[0]] * p1[dishes.up]) / totals.whole(0)[dishes.context[0]]
                levels[i].append((p0, p1, p2))
                hot[i].append(n - discount * t)
            del spelt
        self.levels = [np.concatenate([np.array([x[k] for x in own]).T for own in levels]) for k in range(3)]
        hot = np.concatenate([np.array(x).T for x in hot])
        fan = np.concatenate([np.bincount(w[4].keys[0] // py.CONTEXTS[0], minlength=w[4].n) for w in words])
        self.dishes = py.Dishes(fan, np.concatenate([w[4].context[0] for w in words]))
        count = np.concatenate([np.bincount(w[4].keys[0] // py.CONTEXTS[0], w[5] + np.bincount(w[8], w[7], len(w[5])), w[4].n) for w in words])
        self.new = [np.array([t.fresh(k, d) / t.whole(k) for t in lexicon.past]).T for k in (0, 1)]
        pair_fan, u, seen = (np.concatenate([spread(r[c], to) for r in of(PAIRS)]) for c, to in (("pair_fan", np.int64), ("pair_u", np.int64), ("pair_n", np.uint8)))
        word = np.repeat(np.arange(len(fan)), pair_fan)
        about = np.concatenate([spread(r["xs"]).reshape(1 + len(lexicon.past), -1) for r in of(ANSWERS)], axis=1).T
        context, self.score, place = spread(of(HOMES)[0]["us_ctx"]), np.zeros(len(word)), np.cumsum(seen == 2) - 1
        for a in range(0, len(word), STEP):
            own = slice(a, a + STEP)
            p = self.parent(word[own], context[u[own]]) * (STRENGTH + discount * about[u[own], 1:])
            p[seen[own] == 1] += 1 - discount
            more = seen[own] == 2
            p[more] += hot[place[own][more]]
            self.score[own] = np.log10(np.maximum(p.mean(axis=1) / (STRENGTH + about[u[own], 0]), 1e-300))
        self.base, self.known = np.log10((count + 1) / (lexicon.n + lexicon.types + 1))[word], (count > 0)[word]

    def parent(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Probability of each ``word`` (its place) behind its classes ``context`` in each seating."""
        p = self.levels[2][word]
        for level in (1, 0):
            own = context // py.CLASSES if level else context
            p = self.new[level][own] * p
            at, there = self.dishes.find(level, word * py.CONTEXTS[level] + own)
            p[there] = self.levels[level][at[there]]
        return p


def _score(held: list, lexicon: py.Lexicon, discount: float):
    """Rows of a bucket, its blocks last, to sums by text for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, bucket = None, [], None
        for row in py._rows(batches):
            if row["bucket"] != last:
                last, rows, bucket = row["bucket"], [], None
            if row["kind"] != BLOCKS:
                rows.append(row)
                continue
            if bucket is None:
                bucket, rows = _Bucket(rows, held, lexicon, discount), []
            pair, text, n = np.repeat(risen(row["keys"]), spread(row["times"])), spread(row["texts"]), row["n"]
            sums = (np.bincount(text, x[pair], n).tobytes() for x in (bucket.base, bucket.score))
            known, all_ = (np.bincount(text[x], minlength=n).astype(np.uint32).tobytes() for x in (bucket.known[pair], slice(None)))
            yield py._packed([(row["part"], last, all_, known, *sums, row["ids"], row["flags"])], py._SUMS)
        release()

    return run


def score_texts(docs: DataFrame, store: Store) -> DataFrame:
    """As ``pitman_yor.score_texts``, with a restaurant for each whole token before."""
    source = docs.select("doc_id", "held_out", "text")
    size = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(BUCKETS, int((size / py.BUCKET_BYTES) ** POWER))
    homes = buckets // FOR_HOME
    first = store.keep(_dealt(source.mapInArrow(_send(buckets), _COLUMNS), buckets).mapInArrow(_merge(homes), _COLUMNS), "vocabulary")
    store.forget()
    kept = store.keep(_dealt(_of(first, "origin us us_n us_once us_hot", ASKS), homes).mapInArrow(_keep, _COLUMNS), "restaurants")
    vocabulary = "origin lengths spelling fan ctx train hot_u hot_n hot_at"
    words = _of(first, vocabulary + " xs", HOMES, WORDS)
    places = _of(kept.where(F.col("part") == 1), "origin part us us_once xs", KEPT, PLACES)
    context, lexicon, past = docs.sparkSession.sparkContext, py.Lexicon(), []
    after, held, totals, rates, discount = None, None, None, None, 0.0
    for sweep in range(py.SWEEPS + 1):
        now = words
        if sweep:
            told = _dealt(_of(after, "origin part xs", TABLES).unionByName(places), homes).mapInArrow(_answer(0, discount, sweep), _COLUMNS)
            now = words.unionByName(told).unionByName(_of(after, "origin tables hot_t", SEATED))
        before, after = after, store.keep(_dealt(now, buckets, "kind", "origin").mapInArrow(_sweep(held, totals, rates, lexicon.discounts, discount, sweep), _COLUMNS), "seated")
        averaged = sweep > py.SWEEPS - py.AVERAGED
        if before is not None and not (past and past[-1][0] is before):
            store.drop(before)
        if held is not None and not (past and past[-1][1] is held):
            held.unpersist()
        now = told = before = None
        store.forget()
        table, (customers, two, one, none, types, few, whole) = py._fit_spelling(_of(after, "part keys counts", SUMS), _SUMMED)
        totals = py.Totals(customers, (two, one, none))
        if not sweep:
            lexicon.n, lexicon.types = int(whole[0]), int(types[0])
            lexicon.discounts = tuple(py.discount_from(int(few[2 * k]), int(few[2 * k + 1])) for k in range(3))
            discount = py.discount_from(int(whole[1]), int(whole[2]))
        rng = np.random.default_rng(sweep + 1)
        rates = [py.rate(t, s, d, rng) for t, s, d in zip(totals.tables, py.STRENGTH, lexicon.discounts)]
        held = context.broadcast(table)
        if averaged:
            past.append((after, held, totals))
    lexicon.past = tuple(totals for _, _, totals in past)
    told = _of(kept, "origin part us_n us_once us_hot xs", KEPT, PLACES)
    asked = _of(first, vocabulary + " part n pair_fan pair_u pair_n us_ctx keys times texts ids flags", HOMES, PAIRS, WORDS, BLOCKS)
    for k, (seating, _, _) in enumerate(past):
        part = F.lit(k + 1).cast("long")
        told = told.unionByName(_of(seating, "origin part xs", TABLES).withColumn("part", part))
        asked = asked.unionByName(_of(seating, "origin tables hot_t", SEATED).withColumn("part", part))
    told = _dealt(told, homes).mapInArrow(_answer(len(past), discount, 0), _COLUMNS)
    scored = _dealt(asked.unionByName(told), buckets, "kind", "origin", "part").mapInArrow(_score([held for _, held, _ in past], lexicon, discount), py._SUMS)
    return scored.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(py._add(lexicon), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score_texts(documents(spark, sf_dir).select("doc_id", held_out.alias("held_out"), "text"), Store(spark))
