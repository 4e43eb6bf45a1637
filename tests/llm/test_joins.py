import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import capjoin, decontam, neardup, text
from gridloom.llm.graph import connected_components
from gridloom.llm.store import Store


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + k, 301 + k) for k in range(40)] + [(500, 500), (7, 7)] + [(600, 601 + k) for k in range(50)]
    df = spark.createDataFrame([*pairs, *pairs[:9], (None, 3), (4, None)], "a long, b long")
    got = {r.id: r.root for r in connected_components(df, Store(spark)).collect()}
    want = union(700, pairs)
    for a, b in pairs:
        if a != b:
            assert got[a] == want[a] and got[b] == want[b]
    assert connected_components(df.limit(0), Store(spark)).count() == 0


def test_long_chain_and_hub(spark):
    """A path whose numbers go up and down, and a node with half of all edges."""
    rng = random.Random(7)
    names = rng.sample(range(10_000), 700)
    pairs = list(zip(names, names[1:])) + [(20_000, 20_001 + k) for k in range(700)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.id: r.root for r in connected_components(df, Store(spark)).collect()}
    assert got == {n: min(names) for n in names} | {20_000 + k: 20_000 for k in range(701)}
    with pytest.raises(RuntimeError, match="not settled"):
        connected_components(df, Store(spark), rounds=2)


def words_of(t):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "")]


def brute_jaccard(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    both = Counter((b, a) for v in where.values() for i, a in enumerate(v) for b in v[:i])
    pairs = [p for p, n in both.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= threshold - 1e-12]
    links = Counter(x for p in pairs for x in p)
    root = union(len(rows), pairs)
    return [(rows[root[k]][0], links[k]) for k in range(len(rows))]


def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)] + ["ÉTÉ", "naïve", "x1"]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 7, 40, 120, 600]))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:25]:
        for _ in range(rng.choice([1, 2, 12])):
            c = list(b)
            for _ in range(rng.randrange(1 + len(c) // 25)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", ", "]).join(c).upper() if rng.random() < 0.2 else " ".join(c))
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [shared + " " + " ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(20)]
    texts += [texts[0]] * 30 + [None, "", "  ...", "one", "ONE", "one two", " ".join(["a"] * 3000)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_duplicates(spark, monkeypatch):
    rows = corpus()
    want = brute_jaccard(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    for block, large in ((1024, 1 << 14), (8, 6)):  # small blocks: groups are compared in parts; large prefixes are gathered whole
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "LARGE", large)
        got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.near_duplicates(df, Store(spark)).collect()}
        assert [got[i] for i, _ in rows] == want
    out = neardup.near_duplicates(spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, None)], "doc_id long, text string"), Store(spark)).collect()
    assert sorted((r.doc_id or 0, r.n_links, r.kept) for r in out) == [(0, 0, False), (0, 2, False), (5, 2, True), (5, 2, True)]
    assert neardup.near_duplicates(df.limit(0), Store(spark)).count() == 0


def test_one_id_with_several_texts(spark):
    rows = [(5, "a b c d e f"), (5, "u v w x y z"), (6, "A b c d e f"), (7, "u v w x y z"), (5, "u v w x y z"), (None, "q q q q q q"), (None, "q q q q q q")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Store(spark)).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in out) == [(0, 0, 0), (0, 0, 0), (5, 5, 1), (5, 5, 2), (5, 5, 2), (6, 5, 1), (7, 5, 2)]


def test_prefixes_are_shortened_until_the_recall(spark, monkeypatch):
    """Copies that differ little are found by whole labels; pairs near the threshold ask for shorter ones, and are found."""
    rng = random.Random(3)
    asked = []
    labels = neardup._labels
    monkeypatch.setattr(neardup, "_labels", lambda depth: asked.append(depth) or labels(depth))
    for share, depths in ((0.002, 1), (0.02, 2)):
        rows = []
        for k in range(150):
            words = [f"w{rng.randrange(3000)}" for _ in range(500)]
            other = list(words)
            for at in rng.sample(range(500), int(500 * share)):
                other[at] = "new"
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        asked.clear()
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Store(spark)).collect()
        want = brute_jaccard(rows)
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted((i, c, n) for (i, _), (c, n) in zip(rows, want))
        assert len(set(asked)) == depths and max(asked) == neardup.DEPTH
    assert neardup.estimated_recall(6, {114: 10}, 0.8) > neardup.estimated_recall(6, {114: 10, 96: 10}, 0.8) > neardup.estimated_recall(6, {96: 10}, 0.8) == neardup.estimated_recall(6, {90: 3}, 0.8)
    assert neardup.estimated_recall(6, {}, 0.8) == 0


def test_forest_depth_and_signatures():
    assert 1 - (1 - 0.8 ** neardup.prefix_depth()) ** neardup.TREES >= neardup.RECALL > 1 - (1 - 0.8 ** (neardup.prefix_depth() + 1)) ** neardup.TREES
    assert neardup.prefix_depth(0.99) == neardup.DEPTH
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    b = np.r_[a[:800], rng.integers(0, 1 << 63, 100, dtype=np.uint64)]
    s = neardup.signatures(np.r_[a, b], np.array([0, 900, 900, 1800]))
    assert abs((s[0] == s[2]).mean() - 0.8) < 0.15 and not s[1].any()


def test_same_words_whatever_the_chunk():
    import pyarrow as pa

    texts = ["One two  three", "", None, "ONE, two-three", "été x" * 300, "a", "tail"]
    every = []
    for limit in (1, 50, 1 << 20):
        got = []
        for _, _, data, offsets in text.chunks(pa.array(texts), limit):
            h, _, _, at = text.words(data, offsets)
            got += [h[i:j].tolist() for i, j in zip(at[:-1], at[1:])]
        every.append(got)
    assert every[0] == every[1] == every[2] and every[0][0] == every[0][3] and [len(g) for g in every[0]][:4] == [3, 0, 0, 3]


def brute_leaks(docs, items):
    out = set()
    plain = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).strip()
    for d, t in docs:
        t = plain(t)
        for i, p in items:
            p = plain(p)
            if len(p) < decontam.LEAST:  # as it is, between word ends
                if p and f" {p} " in f" {t} ":
                    out.add((d, i, 0))
                continue
            k = math.floor(decontam.BUDGET * len(p) + 1e-9)
            row = np.zeros(len(t) + 1, np.int64)
            for c in p:
                new = np.minimum(row[:-1] + (np.array([x != c for x in t], np.int64) if t else 0), row[1:] + 1) if t else np.zeros(0, np.int64)
                full = np.r_[row[0] + 1, new]
                row = np.minimum.accumulate(full - np.arange(len(full))) + np.arange(len(full))
            if row.min() <= k:
                out.add((d, i, int(row.min())))
    return out


def test_leaks(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeéo") for _ in range(rng.randrange(1, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    items = [(k, sentence(rng.choice([6, 12, 30]))) for k in range(12)] + [(50, "short"), (51, None), (None, sentence(9)), (52, "")]

    def edited(t, share):
        t = list(t)
        for _ in range(int(share * len(t))):
            k = rng.randrange(len(t))
            kind = rng.random()
            if kind < 0.4:
                t[k] = rng.choice("xyz")
            elif kind < 0.7:
                t[k] = ""
            else:
                t[k] += rng.choice("xyz")
        return "".join(t)

    docs = []
    for d in range(60):
        own = rng.choice(items[:12])[1]
        docs.append((d, rng.choice(["", sentence(20) + " "]) + edited(own.upper() if d % 5 == 0 else own.replace(" ", " ,\n") if d % 7 == 0 else own, rng.choice([0, 0.03, 0.07, 0.1, 0.13, 0.3])) + rng.choice(["", " " + sentence(25)])))
    docs += [(100, None), (101, ""), (102, "..."), (103, items[0][1]), (103, items[0][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.edits) for r in decontam.find_leaks(df, bench).collect()]
    want = brute_leaks(docs, [(i, t) for i, t in items if i is not None and t])
    assert set(got) == want and len(got) == len(want) + 1  # the repeated row
    kept = {r.doc_id for r in decontam.keep_clean(df, bench).collect()}
    long = {i for i, t in items if t and len(re.sub(r"[\W_]+", " ", t).strip()) >= decontam.LEAST}
    assert kept == {d for d, _ in docs} - {d for d, i, _ in want if i in long}
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0 == decontam.find_leaks(df.limit(0), bench).count()


def test_short_items_and_whole_budgets(spark, monkeypatch):
    """All lengths of items with as many edits as they have, and with one more; common q-grams in parts."""
    rng = random.Random(9)
    letter = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz")
    items = [(n, "".join(letter() for _ in range(n))) for n in range(1, 60)] + [(100, "ab ab ab ab ab ab ab ab ab ab"), (101, "yes"), (102, "ab" * 40)]
    docs = []
    for n, t in items:
        for k in {0, n // 10, n // 10 + 1} if n < 60 else {0}:
            edited = list(t)
            for place in rng.sample(range(1, max(2, len(t) - 1)), min(k, max(1, len(t) - 2))):
                edited[place % len(t)] = "0"
            docs.append(f"before {''.join(edited)} behind")
    docs += ["eyes yesterday", "Yes!", "ab " * 3000, "ab" * 3000]
    docs = list(enumerate(docs))
    want = brute_leaks(docs, items)
    for hits in (1 << 21, 50):
        monkeypatch.setattr(decontam, "HITS", hits)
        index = decontam.Index(items)
        found = {(docs[a + d][0], int(index.ids[i]), e) for a, _, data, offsets in text.chunks(pa.array([t for _, t in docs])) for d, i, e, _, _ in index.find(data, offsets)}
        assert found == want
    assert (23, 20) not in {(d, i) for d, i, _ in want} and sum(e == 2 for _, i, e in want if i == 20) == 1


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 60)
    items = [(k, f"this is benchmark item number {k} of a small list of items") for k in range(6)]
    df = spark.createDataFrame([(k, f"before {t} after") for k, t in items], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).where("edits = 0").collect()}
    assert got == {(k, k) for k, _ in items}


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 16))
    near = base[:40].repeat(8, axis=0) + rng.standard_normal((320, 16)) * rng.choice([0.02, 0.1, 0.2], (320, 1))
    big = base[50] + rng.standard_normal((150, 16)) * 0.05
    v = np.concatenate([base, near, big, base[:5], base[:5] * 3]).astype(np.float32)
    rng.shuffle(v)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    want = linked.sum(1), neardup.roots_of(linked)
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [1.0, 2.0]), (2006, [2.0, 4.0])]
    df = spark.createDataFrame([(k, [float(x) for x in row], 0) for k, row in enumerate(v)] + [(i, x, 0) for i, x in odd], "vec_id long, embedding array<float>, component_id int")
    for block, tile, wide in ((1024, 512, 1 << 20), (32, 7, 0)):
        monkeypatch.setattr(capjoin, "BLOCK", block)
        monkeypatch.setattr(capjoin, "TILE", tile)
        monkeypatch.setattr(capjoin, "WIDE", wide)
        rows = {r.vec_id: r for r in capjoin.near_vectors(df, Store(spark)).collect()}
        got = np.array([rows[k].n_links for k in range(len(v))])
        assert (got <= want[0]).all()  # no link below the threshold
        assert got.sum() >= 0.97 * want[0].sum()
        assert np.mean([rows[k].component_id == want[1][k] for k in range(len(v))]) > 0.97
        assert all(rows[i].n_links == 0 and rows[i].component_id == i and rows[i].kept for i in range(2000, 2005))
        assert rows[2005].n_links == rows[2006].n_links == 1 and rows[2006].component_id == 2005 and not rows[2006].kept
    assert capjoin.near_vectors(df.limit(0), Store(spark)).count() == 0


def test_filters_are_all_found():
    caps = capjoin.Caps(12, 3000)
    rng = np.random.default_rng(0)
    u = rng.standard_normal((50, 12))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    row, code = caps.decode(u)
    turned = u @ caps.rotation
    total = np.zeros((50, 1))
    for (a, b), words in zip(zip(caps.cuts, caps.cuts[1:]), caps.codes):
        total = (total[:, :, None] + (turned[:, a:b] @ words.T)[:, None, :]).reshape(50, -1)
    want = {(i, c) for i, c in zip(*np.nonzero(total >= caps.height))}
    assert set(zip(row.tolist(), code.tolist())) == want and len(want) > 100


@pytest.mark.parametrize("n,blocks", [(10, 2), (10**6, 3), (10**9, 4)])
def test_more_vectors_take_more_filters(n, blocks):
    caps = capjoin.Caps(64, n)
    assert caps.blocks <= blocks and caps.words <= capjoin.WORDS and caps.words**caps.blocks >= n * capjoin.PASSED / capjoin.HELD


@pytest.mark.parametrize("dim,n", [(4, 10**5), (8, 10**6), (16, 10**6), (64, 10**5), (64, 10**6), (64, 5 * 10**6)])
def test_recall_at_the_threshold(dim, n):
    caps = capjoin._caps_for(dim, n)
    rng = np.random.default_rng(7)
    x, y = rng.standard_normal((2, 500, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    u = np.concatenate([x, y])
    row, code = caps.decode(u, caps.heights(u))
    found = [set() for _ in u]
    for r, c in zip(row.tolist(), code.tolist()):
        found[r].add(c)
    assert all(found)  # each vector has filters
    assert np.mean([bool(found[k] & found[k + 500]) for k in range(500)]) > 0.95
