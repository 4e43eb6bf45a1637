import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import langid, pitman_yor, text, toxicity
from gridloom.llm.store import Store

SYLLABLES = {"aa": ["the", "ing", "on", "er", "wh"], "bb": ["qué", "ción", "os", "la", "ñ"], "cc": ["ung", "der", "sch", "ö", "ei"]}


def sentence(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    rows = [(k, sentence(rng, lang), lang) for k, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(150))]
    odd = [(500, None, "aa"), (501, "", None), (502, "12 !? \n", "bb"), (None, sentence(rng, "bb"), "bb"), (503, sentence(rng, "cc", 9000), None), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double")
    got = langid.identify(df, langid.sample(df.where("doc_id % 2 = 0"))).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert sum(by[i].lang_pred == lang for i, _, lang in rows) >= 0.98 * len(rows)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (500, 501, 502))
    assert by[503].lang_pred == "cc" and by[None].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in langid.keep_known(df, langid.sample(df)).collect()} == {r[0] for r in rows + odd} - {500, 501, 502}
    assert langid.identify(df, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.sample(df.limit(0)) == {} and langid.identify(df.limit(0), {}).count() == 0


def brute_phrases(sample, t):
    """Greedy phrases by searching the sample."""
    n, k = 0, 0
    while k < len(t):
        j = k
        while j < len(t) and t[k : j + 1] in sample:
            j += 1
        k = max(j, k + 1)
        n += 1
    return n


def spelt(t):
    raw = np.frombuffer(t.encode(), np.uint8)
    return "".join(chr(c) if c else " " for c in langid.normalised(raw, np.array([0, len(raw)]))[0].tolist())


def brute_language(samples, t):
    """The language with the least phrases times the logarithm of its sample's length, and all phrases by name."""
    found = {lang: brute_phrases(own, spelt(t)) if spelt(t) else 0 for lang, own in samples.items()}
    return min(sorted(found), key=lambda lang: found[lang] * math.log2(max(2, len(samples[lang])))), [found[x] for x in sorted(found)]


@pytest.mark.parametrize("window, seen", [(2048, 256), (40, 8), (7, 3), (5, 0)])
def test_phrases_and_predictions_by_search(monkeypatch, window, seen):
    """Whatever the windows: letters without a column, texts of many windows, letters that no sample has."""
    monkeypatch.setattr(langid, "WINDOW", window)
    monkeypatch.setattr(langid, "SEEN", seen)
    rng = random.Random(5)
    chinese = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    texts = {lang: sentence(rng, lang, n) for lang, n in zip(SYLLABLES, (80, 200, 40))} | {"zh": "".join(rng.choice(chinese) for _ in range(900))}
    samples = {lang: spelt(t) for lang, t in texts.items()}
    parser = langid.Parser({lang: [0 if c == " " else ord(c) for c in t] for lang, t in samples.items()})
    assert parser.rare > 100
    docs = [sentence(rng, rng.choice(list(SYLLABLES)), rng.randrange(1, 90)) + rng.choice(["", " zzz", "é1", chinese[3]]) for _ in range(40)]
    docs += [sentence(rng, "bb", 1500), texts["zh"][100:160] + "ab", chinese[5] * 4000, "", " . ", "a" * 9000, texts["aa"] * 3 + texts["cc"], "x", texts["zh"] * 4]
    at = 0
    for a, b, data, offsets in text.chunks(pa.array(docs), 700):
        found, size, _ = parser.phrases(data, offsets)
        langs, scores = parser.predict(data, offsets)
        for k in range(b - a):
            lang, want = brute_language(samples, docs[a + k])
            assert found[:, k].tolist() == want and size[k] == len(spelt(docs[a + k]))
            assert langs[k] == (lang if any(c.isalpha() for c in docs[a + k]) else "und") and 0 <= scores[k] <= 1
        at = b
    assert at == len(docs)


def test_samples_keep_their_labels(spark):
    """Rows of one id under several labels, repeated rows, and texts that don't fit."""
    rows = [(1, "aaa bbb", "x"), (1, "ccc", "y"), (1, "ccc", "y"), (1, "aaa bbb", "z"), (2, "ddd " * 20_000, "y"), (3, "eee " * 20_000, "w"), (4, None, "x"), (5, "!!", "x"), (None, "fff", "x"), (6, "ggg", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {lang: "".join(chr(c) if c else " " for c in t) for lang, t in langid.sample(df).items()}
    assert set(got) == {"x", "y", "z", "w"} and got["y"] == " ccc" and got["z"] == " aaa bbb"
    assert sorted(got["x"].replace(" fff", "").strip().split() + ["fff"]) == ["aaa", "bbb", "fff"] and got["w"].startswith(" eee eee") and len(got["w"]) <= langid.SYMBOLS + 1


def test_toxicity(spark):
    rng = random.Random(3)
    bad = ["vile", "nasty", "hateful", "rotten"]
    rows, labels = [], []
    for k in range(700):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([20, 200]))]
        toxic = k % 6 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), "x"))
        if k % 7:
            labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (None, "vile nasty hateful", "x"), (902, "w1 " * 40_000, "x")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, labels[0], (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.where("doc_id % 5 <> 0 or doc_id is null"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    right = [(got[k] >= 0.5) == (k % 6 == 0) for k in range(700) if k % 5 == 0]
    assert np.mean(right) > 0.95 and got[None] > 0.5 and got[900] == got[901] < 0.5 and all(0 <= s <= 1 for s in got.values())
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}
    for some, want in ((marks.where("toxic = 1"), 1), (marks.limit(0), 0)):
        assert round(toxicity.score(docs.limit(1), toxicity.fit(docs, some)).first().score) == want
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_features_count_once():
    texts = ["a b a b a b", "a b", "b a"]
    raw = [t.encode() for t in texts]
    h, doc = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    own = [set(h[doc == k].tolist()) for k in range(3)]
    assert own[1] < own[0] and own[1] != own[2] and len(own[1]) == 3 and len(own[0]) == 6


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    x = [np.unique(np.r_[rng.integers(2, 400, 20), 0 if k % 4 == 0 else 1]) for k in range(600)]
    y = np.array([float(k % 4 == 0) for k in range(600)])
    bias, w = toxicity.ftrl(x, y, 400)
    assert w[0] > 1 and (w != 0).sum() < 120
    assert np.mean([(bias + w[i].sum() > 0) == t for i, t in zip(x, y)]) > 0.98


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [""]


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(["the", "of", "and", sentence(rng, "aa", 1), sentence(rng, "bb", 1).upper()]) for _ in range(rng.choice([5, 80])))) for k in range(160)]
    rows += [(500, None), (501, ""), (502, "\x85 \xa0\n\x1c"), (None, "the of"), (3, rows[3][1]), (503, "x" * 3000)]
    df = spark.createDataFrame([(i, zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False, t, 1) for i, t in rows], "doc_id long, held_out boolean, text string, n_tokens int")
    return rows, df, pitman_yor.score_texts(df, Store(spark)).collect()


def test_counts_and_base(scored):
    rows, df, got = scored
    held = {(i, t): h for i, h, t, _ in df.collect()}
    seen = Counter(w for i, t in rows if not held[i, t] for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    want = sorted((str(i), held[i, t], len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_model_beats_base_on_held_out(spark):
    """On texts of one language each, with few words that training lacks; the base takes all other strings for one word, the model shares out their probability."""
    rng = random.Random(2)
    known = {lang: [sentence(rng, lang, 1) for _ in range(150)] for lang in SYLLABLES}
    rows = [(k, k % 7 == 2, " ".join(rng.choice(known[lang]) if rng.random() < 0.99 else sentence(rng, lang, 1) for _ in range(40))) for k, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(200))]
    got = [r for r in pitman_yor.score_texts(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string"), Store(spark)).collect() if r.held_out]
    assert len(got) > 20 and sum(r.score for r in got) > sum(r.base_score for r in got)


def packed(vocabulary):
    raw = [w.encode() for w in vocabulary]
    data, size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
    return data, size, text.hash_ranges(data, np.cumsum(size) - size, np.cumsum(size))


def spelling_of(vocabulary, tables):
    data, size, _ = packed(vocabulary)
    key, word = pitman_yor.spelled(data, size)
    some, which = np.unique(key, return_inverse=True)
    return pitman_yor.spelling(some, np.bincount(which, np.asarray(tables)[word]).astype(np.int64))


def test_probabilities_sum_to_one():
    vocabulary = ["", "a", "ab", "the", "then", "é"]
    data, size, h = packed(vocabulary)
    table = spelling_of(vocabulary, np.ones(6))
    np.testing.assert_allclose(table.sum(1), 1, rtol=1e-4)
    base = np.exp(pitman_yor.log_spelling(table, data, size))
    fan, ctx, train = np.array([3, 2, 0, 2, 1, 1]), np.array([0, 5, 70, 5, 6, 5, 70, 0, 5]), np.array([40, 9, 1, 25, 2, 1, 1, 3, 1])
    dishes, discounts = pitman_yor.Dishes(fan, ctx), (0.4, 0.5, 0.6)
    tables = dishes.first(train)
    for sweep in range(3):
        sums = [np.bincount(c, t, n) for c, t, n in zip(dishes.context, tables, pitman_yor.CONTEXTS)]
        totals = pitman_yor.Totals(np.bincount(ctx, train, 1024), tuple(sums))
        assert all((1 <= t).all() or k == 2 for k, t in enumerate(tables)) and all((t <= c).all() for t, c in zip(tables, dishes.customers(train, tables)))
        for context in (0, 5, 6, 70, 900):
            p = dishes.predict(train, tables, base, totals, discounts, np.arange(6), np.full(6, context))
            # what is left for all other strings: a new table at every level
            new = np.prod([totals.fresh(k, discounts)[context // (1, 32, 1024)[k]] / totals.whole(k)[context // (1, 32, 1024)[k]] for k in range(3)])
            assert abs(p.sum() + new * (1 - base.sum()) - 1) < 1e-6
        rates = [np.full(n, 4.0) for n in pitman_yor.CONTEXTS]
        tables = dishes.sweep(train, tables, base, totals, rates, discounts, h, sweep + 1)


@pytest.mark.parametrize("d, odds", [(0.3, 0.4), (0.6, 3.0), (0.8, 40.0)])
def test_tables_follow_their_conditional(d, odds):
    """Exact draws and their limit against the weights of all numbers of tables by the recurrence."""
    for c in (2, 7, 60, 200, 1500):
        now = np.zeros(c + 2)
        now[1] = 1.0
        for k in range(1, c):
            now[1:] = now[:-1] * odds + np.maximum(k - d * np.arange(1, c + 2), 0) * now[1:]
            now[0] = 0
            now /= now.sum()
        if c == 1:
            continue
        mean = (now * np.arange(c + 2)).sum()
        sd = math.sqrt((now * (np.arange(c + 2) - mean) ** 2).sum())
        got = pitman_yor.seat(np.full(4000, c), np.full(4000, odds), d, np.arange(4000, dtype=np.uint64), c)
        assert got.min() >= 1 and got.max() <= c
        assert abs(got.mean() - mean) < 4 * sd / math.sqrt(4000) + (0.02 * mean if c > pitman_yor.EXACT else 0)
        assert abs(got.std() - sd) < 0.05 * sd + 0.02 if c <= pitman_yor.EXACT else got.std() < 1.5 * sd + 0.1


class Restaurant:
    """The plain Chinese restaurant: every table is kept, customers leave and come back one by one."""

    def __init__(self, strength, discount, parent):
        self.strength, self.discount, self.parent, self.tables = strength, discount, parent, {}

    def totals(self):
        return sum(map(sum, self.tables.values())), sum(map(len, self.tables.values()))

    def p(self, dish):
        own, (n, t) = self.tables.get(dish, []), self.totals()
        return (sum(own) - self.discount * len(own) + (self.strength + self.discount * t) * self.base(dish)) / (self.strength + n)

    def base(self, dish):
        return self.parent.p(dish) if isinstance(self.parent, Restaurant) else self.parent(dish)

    def add(self, dish, rng):
        own = self.tables.setdefault(dish, [])
        odds = [x - self.discount for x in own] + [(self.strength + self.discount * self.totals()[1]) * self.base(dish)]
        k = rng.choices(range(len(odds)), odds)[0]
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            if isinstance(self.parent, Restaurant):
                self.parent.add(dish, rng)

    def remove(self, dish, rng):
        own = self.tables[dish]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            del own[k]
            if isinstance(self.parent, Restaurant):
                self.parent.remove(dish, rng)


def test_word_restaurant_against_customers_one_by_one():
    train, base, d = [1, 2, 3, 12, 40, 1, 5], [0.02, 0.1, 0.01, 0.05, 0.2, 0.001, 0.002], 0.5
    rng, one, means = random.Random(4), Restaurant(10.0, d, lambda w: base[w]), []
    for w, c in enumerate(train):
        for _ in range(c):
            one.add(w, rng)
    for sweep in range(3000):
        for w, c in enumerate(train):
            for _ in range(c):
                one.remove(w, rng)
                one.add(w, rng)
        if sweep >= 200:
            means.append([len(one.tables[w]) for w in range(len(train))])
    h, tables, got, draw = np.arange(7, dtype=np.uint64), np.ones(7), [], np.random.default_rng(1)
    for sweep in range(20_000):
        tables = pitman_yor.seat(np.array(train), pitman_yor.rate(tables.sum(), 10.0, d, draw) * np.array(base), d, h, sweep)
        if sweep >= 200:
            got.append(tables)
    np.testing.assert_allclose(np.mean(got, axis=0), np.mean(means, axis=0), rtol=0.06)


def test_spelling_against_customers_one_by_one():
    """Words' bytes in plain nested restaurants; parents taken as given in a sweep cost little."""
    words, times = ["the", "then", "than", "a", "an", "and", ""], [6, 3, 2, 5, 4, 3, 7]
    table = spelling_of(words, times)
    data, size, _ = packed(words)
    key, word = pitman_yor.spelled(data, size)
    counts = np.bincount(np.unique(key, return_inverse=True)[1], np.array(times)[word])
    # the discounts that the model takes, by depth
    discounts, level = [], {int(k): int(c) for k, c in zip(np.unique(key), counts)}
    for k in range(pitman_yor.DEPTH, -1, -1):
        discounts.insert(0, pitman_yor.discount_from(*(sum(c == n for c in level.values()) for n in (1, 2))))
        up = Counter()
        for x in level:
            up[x // 257 % 32 ** (k - 1) * 257 + x % 257 if k else x] += 1
        level = up
    rng, places = random.Random(8), {}

    def place(context, k):
        if (context, k) not in places:
            above = place(context % 32 ** (k - 1), k - 1) if k else lambda s: 1 / 257
            places[context, k] = Restaurant(pitman_yor.SPELLING_STRENGTH, discounts[k], above)
        return places[context, k]

    customers = [(int(x) // 257, int(x) % 257) for x, w in zip(key, word) for _ in range(times[w])]
    for c, s in customers:
        place(c, pitman_yor.DEPTH).add(s, rng)
    total = Counter()
    for sweep in range(60):
        for c, s in customers:
            place(c, pitman_yor.DEPTH).remove(s, rng)
            place(c, pitman_yor.DEPTH).add(s, rng)
        if sweep >= 10:
            for c, s in set(customers):
                total[c, s] += place(c, pitman_yor.DEPTH).p(s) / 50
    for (c, s), p in total.items():
        assert abs(math.log(table[c, s] / p)) < 0.25, (c, s, table[c, s], p)


def in_context(t):
    """Tokens with the classes of the last byte, and of the one before it, of the token before."""
    kind = lambda w, k: int(pitman_yor._CLASS[w.encode()[-k]]) if len(w.encode()) >= k else 0
    own = tokens(t)
    return [(w, (kind(v, 1), kind(v, 2))) for v, w in zip(["", *own], own)]


def test_score_against_customers_one_by_one(spark):
    """All restaurants of words with every table kept, over the same spelling model of their tables."""
    rng = random.Random(12)
    rows = [(k, k % 5 == 0, " ".join(rng.choice(["the", "of", "and", "And", "theory", sentence(rng, "aa", 1)]) for _ in range(12))) for k in range(40)] + [(50, True, "qqq the zzzz")]
    got = {r.doc_id: r for r in pitman_yor.score_texts(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string"), Store(spark)).collect()}
    train = [x for _, held, t in rows if not held for x in in_context(t)]
    vocabulary = sorted({w for w, _ in train})
    levels = [Counter(train)]
    levels.append(Counter((w, c[0]) for w, c in levels[0]))
    levels.append(Counter(w for w, _ in levels[1]))
    discounts = [pitman_yor.discount_from(*(sum(c == n for c in level.values()) for n in (1, 2))) for level in levels]
    table, cache, places = spelling_of(vocabulary, np.ones(len(vocabulary))), {}, {}

    def base(w):
        if w not in cache:
            data, size, _ = packed([w])
            cache[w] = math.exp(pitman_yor.log_spelling(table, data, size)[0])
        return cache[w]

    def place(*context):
        if context not in places:
            level = 2 - len(context)
            places[context] = Restaurant(pitman_yor.STRENGTH[level], discounts[level], place(*context[:-1]) if context else base)
        return places[context]

    for w, c in train:
        place(*c).add(w, rng)
    asked, total, used = {x for _, _, t in rows for x in in_context(t)}, Counter(), 0
    for sweep in range(25):
        for w, c in train:
            place(*c).remove(w, rng)
            place(*c).add(w, rng)
        table = spelling_of(vocabulary, [len(place().tables[w]) for w in vocabulary])
        cache.clear()
        if sweep >= 5:
            used += 1
            for w, c in asked:
                total[w, c] += place(*c).p(w)
    worst = max(abs(got[i].score - sum(math.log10(total[x] / used) for x in in_context(t))) / len(tokens(t)) for i, _, t in rows)
    bias = np.mean([(got[i].score - sum(math.log10(total[x] / used) for x in in_context(t))) / len(tokens(t)) for i, _, t in rows])
    assert worst < 0.08 and abs(bias) < 0.02, (worst, bias)
    assert got[50].n_known == 2


def test_order_of_words_matters(scored, spark):
    rows = [(k, False, "aa bb cc dd") for k in range(30)] + [(40, True, "aa bb cc dd"), (41, True, "dd cc bb aa")]
    got = {r.doc_id: r.score for r in pitman_yor.score_texts(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string"), Store(spark)).collect()}
    assert got[40] > got[41] + 1


def test_scores_are_the_same_in_any_partitions(spark):
    rng = random.Random(5)
    rows = [(k, k % 7 == 2, " ".join(sentence(rng, rng.choice(list(SYLLABLES)), 1) for _ in range(rng.choice([4, 90])))) for k in range(120)]
    found = []
    for shuffle, parts in (("4", 2), ("30", 9)):
        was = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        try:
            df = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string").repartition(parts)
            found.append({r.doc_id: (r.base_score, r.score) for r in pitman_yor.score_texts(df, Store(spark)).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", was)
    assert found[0] == found[1]


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, True, "a b"), (2, True, None)], "doc_id long, held_out boolean, text string")
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in pitman_yor.score_texts(df, Store(spark)).collect()}
    assert got == {1: (3, 0, 0, 0.0), 2: (1, 0, 0, 0.0)}
    assert pitman_yor.score_texts(df.limit(0), Store(spark)).count() == 0


def test_sweeps_see_the_tables_before(spark, monkeypatch):
    df = spark.createDataFrame([(k, False, " ".join(f"w{k * j % 41}" for j in range(60))) for k in range(50)], "doc_id long, held_out boolean, text string")
    given, fitted = [], []
    sweep, fit = pitman_yor._sweep, pitman_yor._fit_spelling
    monkeypatch.setattr(pitman_yor, "_sweep", lambda held, totals, *others: given.append((totals, others[-1])) or sweep(held, totals, *others))
    monkeypatch.setattr(pitman_yor, "_fit_spelling", lambda now: fitted.append(fit(now)) or fitted[-1])
    assert pitman_yor.score_texts(df, Store(spark)).count() == 50
    assert [k for _, k in given] == list(range(pitman_yor.SWEEPS + 2)) and given[0][0] is None
    for level in range(3):
        sums = [t.tables[level].sum() for t, _ in given[1:]]
        assert sums[1] > sums[0] and len(set(sums)) > 1
    assert len(fitted) == pitman_yor.SWEEPS + 1 and fitted[-1][0] != fitted[1][0]


def test_ftrl_against_the_plain_rule():
    """Coordinate by coordinate as published: z, n and the closed form of the weight."""
    rng = random.Random(6)
    examples = [sorted(rng.sample(range(30), rng.randrange(1, 8))) for _ in range(80)]
    labels = [float(2 in x or rng.random() < 0.1) for x in examples]
    alpha, beta, l1, l2, z, n, bias, grown = 0.7, 1.0, 0.3, 0.01, [0.0] * 30, [0.0] * 30, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(3):
        for x, y in zip(examples, labels):
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - y
            for i in x:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
            grown += g * g
            bias -= alpha / (beta + math.sqrt(grown)) * g
    got = toxicity.ftrl([np.array(x) for x in examples], np.array(labels), 30, 3, alpha, beta, l1, l2)
    assert abs(got[0] - bias) < 1e-9 and np.allclose(got[1], [weight(i) for i in range(30)], atol=1e-9)
