import math
import random
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import pitman_yor, word_contexts
from gridloom.llm.queries import QUERIES
from gridloom.llm.store import Store

from .test_models import SYLLABLES, Restaurant, in_context, packed, sentence, spelling_of, tokens

SCHEMA = "doc_id long, held_out boolean, text string"


def scores(spark, rows, parts=2):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return {r.doc_id: r for r in word_contexts.score_texts(df, Store(spark)).collect()}


def test_query_tells_words_of_one_ending_apart(spark, tmp_path):
    """Both words before end alike, so that only whole words tell what follows."""
    rows = [(k, "xxab pp" if k % 2 else "yyab qq") for k in range(60)]
    rows += [(100, "xxab pp"), (101, "xxab qq"), (102, "yyab pp"), (103, "yyab qq")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in QUERIES["op5_pitman_yor"](spark, str(tmp_path)).collect()}
    assert got[100] > got[101] + 0.5 and got[103] > got[102] + 0.5


def test_gamma():
    for shape in (1.2, 3.0, 50.0, 4000.0):
        got = word_contexts.gamma(np.full(40_000, shape), np.arange(40_000, dtype=np.uint64), 3)
        assert abs(got.mean() / shape - 1) < 5 / math.sqrt(40_000 * shape) and abs(got.var() / shape - 1) < 0.06


def test_score_against_customers_one_by_one(spark):
    """All restaurants, those of whole words before among them, with every table kept."""
    rng = random.Random(12)
    rows = [(k, k % 5 == 0, " ".join(rng.choice(["the", "of", "and", "And", "theory", "bathe", sentence(rng, "aa", 1)]) for _ in range(12))) for k in range(40)] + [(50, True, "qqq the zzzz")]
    got = scores(spark, rows)
    asked_in = lambda t: [(w, (*c, v)) for (w, c), v in zip(in_context(t), ["", *tokens(t)])]
    train = [x for _, held, t in rows if not held for x in asked_in(t)]
    vocabulary = sorted({w for w, _ in train})
    levels = [Counter(train)]
    for n in (2, 1, 0):
        levels.append(Counter((w, c[:n]) for w, c in levels[-1]))
    discounts = [pitman_yor.discount_from(*(sum(c == n for c in level.values()) for n in (1, 2))) for level in levels]
    strengths = (word_contexts.STRENGTH, *pitman_yor.STRENGTH)
    table, cache, places = spelling_of(vocabulary, np.ones(len(vocabulary))), {}, {}

    def base(w):
        if w not in cache:
            data, size, _ = packed([w])
            cache[w] = math.exp(pitman_yor.log_spelling(table, data, size)[0])
        return cache[w]

    def place(*context):
        if context not in places:
            level = 3 - len(context)
            places[context] = Restaurant(strengths[level], discounts[level], place(*context[:-1]) if context else base)
        return places[context]

    for w, c in train:
        place(*c).add(w, rng)
    asked, total, used = {x for _, _, t in rows for x in asked_in(t)}, Counter(), 0
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
    off = [(got[i].score - sum(math.log10(total[x] / used) for x in asked_in(t))) / len(tokens(t)) for i, _, t in rows]
    assert max(map(abs, off)) < 0.08 and abs(np.mean(off)) < 0.02, (max(map(abs, off)), np.mean(off))
    assert got[50].n_known == 2


def test_counts_base_and_partitions(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, k % 7 == 2, " ".join(sentence(rng, rng.choice(list(SYLLABLES)), 1) for _ in range(rng.choice([0, 4, 90])))) for k in range(120)] + [(200, False, None), (201, True, "\x85 \xa0\n")]
    found = []
    for parts, row in ((2, 1 << 14), (9, 50)):
        monkeypatch.setattr(pitman_yor, "ROW", row)
        found.append({i: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for i, r in scores(spark, rows, parts).items()})
    assert found[0] == found[1]
    seen = Counter(w for _, held, t in rows if not held for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    for i, held, t in rows:
        want = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t))
        assert found[0][i][:4] == (held, len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n)
        assert found[0][i][4] == pytest.approx(want) and math.isfinite(found[0][i][5])


def test_no_training_rows(spark):
    got = scores(spark, [(1, True, "a b"), (2, True, None)])
    assert {i: (r.n_tokens, r.n_known, r.train_tokens, r.base_score) for i, r in got.items()} == {1: (3, 0, 0, 0.0), 2: (1, 0, 0, 0.0)}
    assert word_contexts.score_texts(spark.createDataFrame([], SCHEMA), Store(spark)).count() == 0


def test_numbers_travel_narrow_and_whole():
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64, endpoint=False))
    for x in (h, np.zeros(0, np.int64), np.array([0, 255]), np.array([3, 256, 65536]), np.arange(1 << 33, (1 << 33) + 9)):
        assert (word_contexts.risen(word_contexts.rising(x), x.dtype) == x).all()
        assert (word_contexts.spread(word_contexts.squeeze(x), x.dtype) == x).all()
    assert len(word_contexts.squeeze(np.ones(10_000, np.int64))) < 100 and len(word_contexts.rising(h)) < 7.5 * len(h)


def test_what_is_moved_is_in_proportion_to_the_texts(spark):
    """All shuffles together, whose files may all lie on disk at once."""
    rng = np.random.default_rng(3)
    words = np.array(["".join(w) for w in rng.choice(list("etaoinshrdlu"), (8000, 6))])
    rows = [(k, k % 7 == 2, " ".join(words[np.minimum(rng.zipf(1.3, 500), 8000) - 1])) for k in range(400)]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert len(scores(spark, rows)) == 400
    assert written() - before < 8 * sum(len(t) for _, _, t in rows), (written() - before) / sum(len(t) for _, _, t in rows)
