import os
import random
import textwrap

import duckdb
import numpy as np
import pytest

from gridloom.llm import bpe, editcount, licences, urls
from gridloom.llm.store import Store

PAGES = [
    (1, "https://A.B.com/en/1?x#y", None), (2, "http://example.com/en/7x", ""), (3, "ftp://x.net/de/8", None), (4, "https://example.net/de/8", None),
    (5, "https://m.example.net/de/81#top", None), (6, None, "x"), (7, "no url", None), (8, "://", None), (9, "https://com/en/", None), (10, "https://xcom/en/", None),
    (11, "https://alias.io/1#f", '<link rel="canonical" href="https://b.org/es/9">'), (12, "https://alias.io/2", '<meta http-equiv="refresh" content="0; url=https://alias.io/1">'),
    (13, "https://good.io/1", '<link rel="canonical" href="https://a.net/de/3">'), (14, "https://good.io/2", '<link rel="canonical" href="https://good.io/1">'),
    (15, "https://q.com/en/5", '<link rel="canonical" href="https://good.io/2">'), (15, "https://q.com/en/5", None), (None, "https://z.org/es", None),
    (16, "https://ÄX.Com:80/en/é?", None),
]


def by_duckdb(sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df.toPandas())
    return c.sql(sql).df()


def same(spark_df, duck):
    ours = spark_df.toPandas()[sorted(spark_df.columns)]
    duck = duck[sorted(duck.columns)]
    assert list(ours.columns) == list(duck.columns)
    key = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).values.tolist()))
    norm = lambda d: d.assign(**{c: d[c].astype("Int64") for c in d.columns if d[c].dtype.kind in "if"})
    assert key(norm(ours)) == key(norm(duck))


def test_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = urls.judge(pages.select("page_id", "url"), urls.page_edges(pages), Store(spark))
    same(got, by_duckdb(urls.ORACLE, pages=pages))
    verdict = {r.page_id: (r.rule, r.verdict) for r in got.collect()}
    assert verdict[11] == (None, "block") == verdict[12]  # an alias of an alias of a blocked url that no page has
    assert verdict[13] == verdict[14] == (None, "allow") and verdict[15] == ("com/en/", "block")
    assert verdict[2] == ("example.com/en/7", "allow") and verdict[4] == ("example.net/de/8", "block") and verdict[5][1] == "block"
    assert verdict[10] == (None, "allow") and verdict[9][1] == "block"
    assert urls.judge(pages.limit(0), urls.page_edges(pages.limit(0)), Store(spark)).count() == 0


LINKS = [
    ('<LINK HREF=https://T.org/es/1#x REL=canonical>', "https://t.org/es/1"), ("<link rel='nofollow Canonical' href='/es/2?a=1&amp;b=2'>", "http://site.com/es/2?a=1&b=2"),
    ('<link href="//t.org/es/3"\n rel = "canonical" />', "http://t.org/es/3"), ('<meta content="0;URL=\'https://t.org/es/4\'" http-equiv="Refresh">', "https://t.org/es/4"),
    ("<META HTTP-EQUIV=refresh CONTENT='5; url=../../x/./y'>", "http://site.com/x/y"), ('<link rel="canonical" href="sub/p?q">', "http://site.com/a/b/sub/p?q"), ('<link rel="canonical" href="?z=1">', "http://site.com/a/b/c?z=1"),
    ('<link rel="canonical" href="..">', "http://site.com/a/"), ('<link rel="canonical" href="../../../../up">', "http://site.com/up"),
    ('<link rel="canonicals" href="https://no.org/1">', None), ('<link rel="canonical" href="mailto:me@no.org">', None), ('<link rel="canonical" href="#top">', None), ('<link rel="canonical">', None),
    ('<link rel="stylesheet" href="https://no.org/2"><meta name="x" content="url=https://no.org/3">', None), ("<p>rel=canonical href=https://no.org/4</p>", None), ('<link rel="canonical" href="HTTP://Site.COM/a/b/c?q#f">', None),
]


def test_links_in_all_spellings(spark):
    rows = [(k, f"http://Site.com/a/b/c?q{'' if k == 15 else k}#top", f"<html>{tag}<body>") for k, (tag, _) in enumerate(LINKS)]
    rows.append((50, "https://many.io", "".join(tag for tag, _ in LINKS[:6])))
    pages = spark.createDataFrame([*rows, (51, None, LINKS[0][0]), (52, "no url", LINKS[0][0]), (53, "https://e.io/", None)], "page_id long, url string, html string")
    got = {(r.a, r.b) for r in urls.page_edges(pages).collect()}
    want = {(f"http://site.com/a/b/c?q{k}", b) for k, (_, b) in enumerate(LINKS) if b}
    assert {e for e in got if e[0].startswith("http://site")} == want
    assert {b for a, b in got if a == "https://many.io"} == {"https://t.org/es/1", "https://many.io/es/2?a=1&b=2", "https://t.org/es/3", "https://t.org/es/4", "https://many.io/x/y", "https://many.io/sub/p?q"}
    judged = urls.judge(pages.select("page_id", "url"), urls.page_edges(pages), Store(spark))
    assert {r.page_id for r in judged.where("verdict = 'block'").collect()} == {0, 2, 3, 50}
    same(judged, by_duckdb(urls.ORACLE, pages=pages))


def test_many_aliases_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(urls, "SENT", 0)
    rows = [(k, f"https://a.io/{k % 60}", f'<link rel=canonical href="https://a.io/{(k % 60) // 2}">' if k % 60 else '<link rel=canonical href="https://b.org/es/1">') for k in range(300)]
    rows += [(1000 + k, "https://hot.io/x", None) for k in range(200)] + [(2000 + k, None, None) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urls.judge(pages.select("page_id", "url"), urls.page_edges(pages), Store(spark))
    assert {r.page_id for r in got.where("verdict = 'block'").collect()} == set(range(300)) and got.count() == 540
    same(got, by_duckdb(urls.ORACLE, pages=pages))


def of(*numbers):
    return [licences.SENTENCES[i - 1] for i in numbers]


MIT = """MIT License

Copyright (c) 2021 A. Person and others

{}:

{}.

{}. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY.
""".format(*of(5, 6), of(7)[0].upper().replace("AS IS", '"AS IS"'))
BSD_2 = """Copyright 1999-2010, The Regents. All rights reserved.
{}:

1. {}.
2. {}.

{}. IN NO EVENT SHALL (INCLUDING, BUT NOT LIMITED TO, SUBSTITUTE GOODS; LOSS OF USE) WE BE LIABLE.
""".format(*of(8, 9, 10), of(31)[0].upper())
BSD_3 = BSD_2.replace("\n\nTHIS SOFTWARE", "\n3. " + of(11)[0] + ".\n\nTHIS SOFTWARE")
ISC = "Copyright (c) 2004 by Somebody\n\n{}.\n\n{}.\n".format(of(27)[0], of(30)[0].upper())
APACHE = """Copyright 2019 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions.
"""
GPL_3 = "{}.\n\n{}.  See the\nGNU General Public License for more details.\n".format(*of(14, 15))
GPL_2 = "{}.\n\n{}.\n".format(*of(32, 15))
LGPL = "{}.\n\n{}.\n".format(*of(34, 38))
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file,\nYou can obtain one at http://mozilla.org/MPL/2.0/."
WHOLE = {"MIT": MIT, "BSD-2-Clause": BSD_2, "BSD-3-Clause": BSD_3, "ISC": ISC, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL_3, "GPL-2.0-or-later": GPL_2, "LGPL-2.1-or-later": LGPL, "MPL-2.0": MPL}
LICENCE_TEXTS = [
    (1, "Released under the MIT License.\nWords. Licensed under CC BY-NC 4.0."), (2, None), (3, ""), (4, "software"),
    (5, ". ".join(s.capitalize() for s in of(8, 9, 10, 11)) + "."), (6, ".\n".join(of(8, 9, 10))),
    (7, "THE MIT LICENSE\n\n" + ".  ".join(of(5, 6, 7)) + " !"), (8, ". ".join(of(6, 5))),
    (9, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."), (9, "Released under the MIT License.\n" * 3), (None, "Released under the mit licence"),
    (10, "x. " * 3000 + "This work is licensed under the GNU General Public License, version 3."),
    (11, "some words without an end\nReleased under the MIT License\nmore words\r\nLicensed under CC BY 4.0"), (12, "# SPDX-License-Identifier: GPL-2.0-only\n/* SPDX-License-Identifier:  MIT */"),
    (13, "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions"), (14, "  Apache License\n     Version 2.0, January 2004\n  http://www.apache.org/licenses/\n\n TERMS"),
    (15, "MIT License\n" + of(5)[0] + ": " + of(6)[0] + ". " + of(7)[0]), (16, "\n\n \n#\n licence"), (17, "The software" + MIT[40:900]),
]


def wrapped(text, width, sign, newline="\n"):
    """Paragraph by paragraph to lines of so many characters behind a comment sign."""
    out = []
    for part in text.split("\n\n"):
        if part.startswith(("1. ", "Copyright")):  # lists and lines about whose it is keep their lines
            out += [line for piece in part.split("\n") for line in textwrap.wrap(piece, width, break_long_words=False, break_on_hyphens=False)]
        else:
            out += textwrap.wrap(part, width, break_long_words=False, break_on_hyphens=False)
        out.append("")
    return newline.join((sign + line).rstrip(" ") for line in out)


def test_licences(spark):
    import re

    assert all(re.search(licences.HINT, s) for s in licences.KNOWN) and len(licences.KNOWN) == len(licences.SENTENCES) + len(licences.TAGS)
    assert len({ids for _, ids in licences.RULES}) == len(licences.RULES)
    docs = spark.createDataFrame(LICENCE_TEXTS, "doc_id long, text string")
    got = licences.scan(docs)
    same(got, by_duckdb(licences.ORACLE, documents=docs))
    found = {r.doc_id: r.licences for r in got.where("doc_id < 9 or doc_id >= 10").collect()}
    assert found == {
        1: "MIT,CC-BY-NC-4.0", 2: "", 3: "", 4: "", 5: "BSD-3-Clause", 6: "BSD-2-Clause", 7: "MIT", 8: "", 10: "GPL-3.0", 11: "MIT,CC-BY-4.0",
        12: "GPL-2.0-only,MIT", 13: "MPL-2.0", 14: "Apache-2.0", 15: "MIT", 16: "", 17: found[17],
    }


def test_every_sentence_is_found_alone(spark):
    docs = spark.createDataFrame([(i, f"Before this. {s}.\n\nBehind it") for i, s in enumerate(licences.SENTENCES, 1)], "doc_id long, text string")
    assert {r.doc_id: r.sentences for r in licences.scan(docs).collect() if r.doc_id != 20} == {i: f"|{i}|" for i in range(1, len(licences.SENTENCES) + 1) if i != 20}
    assert licences.scan(docs.where("doc_id = 20")).first().licences == "Apache-2.0"


def test_wrapped_and_repeated_licences(spark):
    """Whole texts at several widths behind comment signs, alone, several times and one behind the other."""
    rows, want = [], {}
    for name, text in WHOLE.items():
        for width, sign, newline in ((10_000, "", "\n"), (72, "", "\n"), (50, " * ", "\n"), (64, "// ", "\r\n"), (40, "# ", "\n")):
            one = wrapped(text, width, sign, newline)
            for times in (1, 2, 3):
                want[len(rows)] = (name, times)
                rows.append((len(rows), newline.join([one] * times)))
    pairs = [(a, b) for a in WHOLE for b in WHOLE if a != b]
    for a, b in pairs:
        want[len(rows)] = (f"{a},{b}", 1)
        rows.append((len(rows), wrapped(WHOLE[a], 70, "# ") + "\n" + wrapped(WHOLE[b], 60, "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert {i: r.licences for i, r in got.items()} == {i: name for i, (name, _) in want.items()}
    single = {name: got[i].sentences for i, (name, times) in want.items() if times == 1}
    assert all(got[i].sentences == "|" + single[name][1:] * times for i, (name, times) in want.items())
    same(licences.scan(docs), by_duckdb(licences.ORACLE, documents=docs))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_registered_oracles(spark):
    from gridloom.llm.queries import ORACLES, QUERIES

    d = "/root/testdata/sf0.001"
    tables = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("pages", "documents")}
    for name, sql in ORACLES.items():
        same(QUERIES[name](spark, d), by_duckdb(sql, **tables))


def test_edits_equal_recount(spark):
    b = bpe.load(bpe.vocabulary_path())
    rng = random.Random(3)
    count = lambda raw: len(b.encode_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])
    bits = ["a", "b ", " ", "\n", "'", "s", "'re", "1", "é", "日", "!", "  ", "the ", "\t", "ll"]
    for case in range(60):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 60, 3000])))
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8)
        _, counts, starts = b.encode_words(data, np.array([0, len(raw)]))
        tree = editcount.TokenTree(b, raw, starts, counts)
        for _ in range(12):
            new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 0, 1, 3, 200]))).encode()
            first, end, new = editcount.whole(tree, rng.randrange(tree.size[1] + 1), rng.choice([0, 0, 1, 2, 7, 500]), new)
            want = tree.bytes()[:first] + new + tree.bytes()[end:]
            tree.edit(first, end, new)
            assert tree.bytes() == want
            assert tree.n_tokens == count(want), (case, first, end, new)


def test_count_with_edits(spark):
    df = spark.createDataFrame([(1, "it's here", 1), (1, "it's here", 1), (2, None, 2), (None, "x" * 500, 3), (3, "", 4)], "doc_id long, text string, n_tokens int")
    rows = editcount.count_with_edits(df, bpe.vocabulary_path()).collect()
    b = bpe.load(bpe.vocabulary_path())
    assert len(rows) == 5 and sorted((r.doc_id or 0, r.n_tokens) for r in rows) == sorted((i or 0, len(b.encode(t or ""))) for i, t, _ in df.collect())
    assert editcount.count_with_edits(df.limit(0), bpe.vocabulary_path()).count() == 0
