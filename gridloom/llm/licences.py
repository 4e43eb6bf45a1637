"""Licence scans by sentence rules.

A text is cut into sentences; normalised sentences that are known get their
identifier, the rest are passed over; the sequence of identifiers is then read
from left to right, each time by the first of the ordered rules that starts there.
Lines that a text is wrapped into, with or without comment signs, make no
difference. Everything is a column expression over the row, so a scan neither
shuffles nor leaves the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import documents

#: Sentences of public licences and of the notices that name them.
SENTENCES = (
    "Released under the MIT License",
    "Licensed under the Apache License, Version 2.0",
    "This work is licensed under the GNU General Public License, version 3",
    "Licensed under CC BY-NC 4.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "You may not use this file except in compliance with the License",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose",
    "The MIT License",
    "Licensed under the MIT License",
    "Apache License, Version 2.0",
    "Licensed under the Apache License, Version 2.0 (the License)",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "Apache License Version 2.0, January 2004",
    "MIT License",
    "The MIT License (MIT)",
    "This project is licensed under the MIT License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "This library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose",
    "GNU General Public License Version 2, June 1991",
    "GNU General Public License Version 3, 29 June 2007",
    "GNU Lesser General Public License Version 2.1, February 1999",
    "GNU Lesser General Public License Version 3, 29 June 2007",
    "GNU Affero General Public License Version 3, 19 November 2007",
    "This Source Code Form is subject to the terms of the Mozilla Public License",
    "Mozilla Public License Version 2.0",
    "This is free and unencumbered software released into the public domain",
    "Distributed under the Boost Software License, Version 1.0",
    "Boost Software License - Version 1.0 - August 17th, 2003",
    "This software is provided as-is, without any express or implied warranty",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "Licensed under CC BY 4.0",
    "Licensed under CC BY-SA 4.0",
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "Licensed under the BSD 3-Clause License",
    "Licensed under the BSD 2-Clause License",
)
#: Identifiers that a tag line may name, each a sentence of its own behind the others.
TAGS = ("MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "MPL-2.0", "Unlicense", "BSL-1.0", "Zlib", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
TAG = "SPDX-License-Identifier"
#: Licence and the numbers (from 1) of its sentences in order; where several start at a sentence, the earlier rule holds.
RULES = (
    ("BSD-3-Clause", (8, 9, 10, 11)),
    ("BSD-2-Clause", (8, 9, 10)),
    ("MIT", (5, 6, 7)),
    ("MIT", (5, 6)),
    ("MIT-0", (26, 7)),
    ("MIT-0", (26,)),
    ("ISC", (27, 30)),
    ("ISC", (28, 30)),
    ("ISC", (27,)),
    ("ISC", (28,)),
    ("0BSD", (29, 30)),
    ("0BSD", (29,)),
    ("Apache-2.0", (2, 12, 13)),
    ("Apache-2.0", (19, 12, 13)),
    ("Apache-2.0", (20, 13)),
    ("Apache-2.0", (2, 12)),
    ("Apache-2.0", (19, 12)),
    ("GPL-3.0-or-later", (14, 15)),
    ("GPL-2.0-or-later", (32, 15)),
    ("GPL-2.0-only", (33, 15)),
    ("LGPL-2.1-or-later", (34, 38)),
    ("LGPL-3.0-or-later", (35, 38)),
    ("LGPL-3.0-or-later", (36, 15)),
    ("AGPL-3.0-or-later", (37, 15)),
    ("Zlib", (49, 50)),
    *((name, (number,)) for name, numbers in (
        ("MIT", (1, 16, 17, 23, 24, 25)), ("Apache-2.0", (2, 18, 19, 20, 21, 22)), ("GPL-3.0", (3, 40)), ("GPL-3.0-or-later", (14,)),
        ("GPL-2.0", (39,)), ("GPL-2.0-or-later", (32,)), ("GPL-2.0-only", (33,)), ("LGPL-2.1-or-later", (34,)), ("LGPL-2.1", (41,)),
        ("LGPL-3.0-or-later", (35, 36)), ("LGPL-3.0", (42,)), ("AGPL-3.0-or-later", (37,)), ("AGPL-3.0", (43,)), ("MPL-2.0", (44, 45)),
        ("Unlicense", (46,)), ("BSL-1.0", (47, 48)), ("Zlib", (50,)), ("CC-BY-4.0", (51, 54)), ("CC-BY-SA-4.0", (52, 55)),
        ("CC-BY-NC-4.0", (4, 53)), ("CC0-1.0", (56,)), ("BSD-3-Clause", (57,)), ("BSD-2-Clause", (58,)),
    ) for number in numbers),
    *((name, (len(SENTENCES) + k,)) for k, name in enumerate(TAGS, 1)),
)
#: Every known sentence has one of these.
HINT = "(?i)licen[sc]e|software|copyright|redistribution|warranty"
#: Stands where a sentence ends. A text's own counts as an end, too.
MARK = "\x01"
#: What is replaced, one after the other, to set the marks; \\1 and \\2 are the groups.
CUTS = (
    ("\r\n?", "\n"),
    (f"(?i){TAG}:[ \t]*([A-Za-z0-9.-]+)", rf"{MARK}{TAG} \1{MARK}"),
    (r"(?i)((?:^|\n)[^A-Za-z0-9\n]*)(copyright[ \t]*(?:\(c\)|©|\[|<|[0-9])[^\n]*)", rf"\1{MARK}\2{MARK}"),  # a line about whose it is
    ("\n[^A-Za-z0-9\n]*\n", f"{MARK}\n"),  # an empty line
    (r"([:;.,]\s+|\n[^A-Za-z0-9\n]*|^)\(?[0-9a-zA-Z]{1,2}[.)]\s", MARK),  # the sign of a list item
    (r"\);\s", f"){MARK}"),
    (r"[:;]\s+([A-Z])", rf"{MARK}\1"),
    (r"[.!?]+[)\x22']*\s", MARK),
)
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(_CAPITALS, _SMALL))).strip()


#: Normalised sentence to its number.
KNOWN = {plain(s): i for i, s in enumerate((*SENTENCES, *(f"{TAG} {t}" for t in TAGS)), 1)}


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, _CAPITALS, _SMALL), "[^a-z0-9]+", " "))


def marked(text: Column) -> Column:
    for pattern, by in CUTS:
        text = F.regexp_replace(text, pattern, re.sub(r"\\([12])", r"$\1", by))
    return text


def identifiers(text: Column) -> Column:
    """The numbers of the known sentences in the order of the text.

    What stands between two marks is one sentence over all its lines, or else its
    first line and the rest are two, or else its lines are one each.
    """
    known = F.create_map(*(F.lit(x) for s, i in KNOWN.items() for x in (s, i)))
    number = lambda s: F.try_element_at(known, normalised(s))

    def numbers(s: Column) -> Column:
        whole, first, rest = number(s), F.substring_index(s, "\n", 1), F.regexp_replace(s, "^[^\n]*\n", "")
        parted = F.when(number(rest).isNotNull(), F.array(number(first), number(rest))).otherwise(F.transform(F.split(s, "\n"), number))
        return F.when(whole.isNotNull(), F.array(whole)).when(s.contains("\n"), parted).otherwise(F.array().cast("array<int>"))

    hinted = F.when(text.rlike(HINT), F.filter(F.split(marked(text), MARK), lambda s: s.rlike(HINT)))
    return F.coalesce(F.array_compact(F.flatten(F.transform(hinted, numbers))), F.array().cast("array<int>"))


def _run(ids) -> str:
    return "".join(f"<{i}>" for i in ids)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentences, licences) of each row of ``docs`` (doc_id, text).

    sentences holds the numbers of the known sentences in order, each between
    ``|`` (``|`` alone where there are none); licences the names of the rules that
    match, in the order of the text, parted by commas and each once. Null and empty
    texts have neither. Rules don't overlap: one that has matched goes on behind its
    last sentence, so that texts which stand one after the other are each found.
    """
    names = F.create_map(*(F.lit(x) for name, ids in RULES for x in (_run(ids), name)))
    rows = docs.select("doc_id", identifiers(F.col("text")).alias("ids"))
    joined = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), "")
    found = F.transform(F.regexp_extract_all(joined, F.lit("|".join(_run(ids) for _, ids in RULES)), F.lit(0)), lambda r: F.try_element_at(names, r))
    sentences = F.concat(F.lit("|"), F.array_join(F.transform("ids", lambda i: F.concat(i.cast("string"), F.lit("|"))), ""))
    return rows.select("doc_id", sentences.alias("sentences"), F.array_join(F.array_distinct(found), ",").alias("licences"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _oracle() -> str:
    """Sentences as rows that are joined with the known ones; rules by walking along lists of numbers."""
    known = ", ".join(f"('{s}', {i})" for s, i in KNOWN.items())
    rules = ", ".join(f"({k}, '{name}', {list(ids)})" for k, (name, ids) in enumerate(RULES))
    text = "text"
    for pattern, by in CUTS:
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, pattern.replace("'", "''"), by)
    plain_of = lambda s: f"trim(regexp_replace(translate({s}, '{_CAPITALS}', '{_SMALL}'), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH RECURSIVE known(sentence, number) AS (VALUES {known}),
rules(k, name, ids) AS (VALUES {rules}),
texts AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
cut AS (SELECT r, string_split({text}, '{MARK}') AS parts FROM texts WHERE regexp_matches(text, '{HINT}')),
flat AS (SELECT r, unnest(parts) AS s, generate_subscripts(parts, 1) AS place FROM cut),
pieces AS (
  SELECT r, place, 0 AS way, 1 AS line, {plain_of('s')} AS sentence FROM flat
  UNION ALL SELECT r, place, 1, 1, {plain_of("split_part(s, chr(10), 1)")} FROM flat WHERE contains(s, chr(10))
  UNION ALL SELECT r, place, 1, 2, {plain_of("substr(s, strpos(s, chr(10)) + 1)")} FROM flat WHERE contains(s, chr(10))
  UNION ALL SELECT r, place, 2, line, {plain_of('piece')} FROM (
    SELECT r, place, unnest(string_split(s, chr(10))) AS piece, generate_subscripts(string_split(s, chr(10)), 1) AS line FROM flat WHERE contains(s, chr(10)))
),
hits AS (SELECT r, place, way, line, number FROM pieces JOIN known USING (sentence)),
ways AS (SELECT r, place, min(way) AS way FROM hits WHERE way <> 1 OR line = 2 GROUP BY r, place),
ids AS (SELECT r, list(number ORDER BY place, line) AS ids, string_agg(number || '|', '' ORDER BY place, line) AS shown FROM hits JOIN ways USING (r, place, way) GROUP BY r),
steps AS (
  SELECT r, i, arg_min(name, k) AS name, arg_min(len(rules.ids), k) AS own
  FROM (SELECT r, ids, unnest(range(1, len(ids) + 1)) AS i FROM ids) AS spots JOIN rules ON list_slice(spots.ids, i, i + len(rules.ids) - 1) = rules.ids GROUP BY r, i
),
walk(r, i, name) AS (
  SELECT r, 0 + 1, CAST(NULL AS VARCHAR) FROM ids
  UNION ALL
  SELECT walk.r, CAST(walk.i + coalesce(steps.own, 1) AS INTEGER), steps.name
  FROM walk JOIN ids ON ids.r = walk.r LEFT JOIN steps ON steps.r = walk.r AND steps.i = walk.i WHERE walk.i <= len(ids.ids)
),
names AS (SELECT r, string_agg(name, ',' ORDER BY i) AS licences FROM (SELECT r, name, min(i) AS i FROM walk WHERE name IS NOT NULL GROUP BY r, name) GROUP BY r)
SELECT doc_id, '|' || coalesce(shown, '') AS sentences, coalesce(licences, '') AS licences
FROM texts LEFT JOIN ids USING (r) LEFT JOIN names USING (r)
"""


ORACLE = _oracle()
