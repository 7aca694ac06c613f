"""Licence recognition by sentence rules, in DataFrame functions only.

A text is normalised (lower case, only letters and digits, single blanks, so that
comment marks go) with marks where sentences and lines end, and known licence
sentences are looked up in it.  A sentence stands between two marks and may be
wrapped over several lines; the long ones of licence texts and notices (NOTICES)
may also stand inside a longer sentence or be cut by other marks.  The numbers
of the known ones, in the order of the text, form a sequence, against which
ordered rules are matched: a rule is a run of sentence numbers, and what a rule
has taken is gone for those after it, so specific rules come first.

The rules are small fixed tables and part of the plan; texts are read once and
nothing is shuffled.

Defined cases: null and empty texts have no sentences and no licence; a sentence
may begin and end at a line break; a sentence may occur many times and each run counts;
repeated rows give repeated rows; extra columns take no part; an empty table
gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences by number, as normalised.
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "this project is licensed under the mit license",
    4: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    5: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    6: "the software is provided as is without warranty of any kind express or implied",
    10: "licensed under the apache license version 2 0",
    11: "licensed under the apache license version 2 0 the license",
    12: "you may not use this file except in compliance with the license",
    13: "you may obtain a copy of the license at",
    14: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    20: "this work is licensed under the gnu general public license version 3",
    21: "this work is licensed under the gnu general public license version 2",
    22: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    23: "either version 3 of the license or at your option any later version",
    24: "either version 2 of the license or at your option any later version",
    25: "this work is licensed under the gnu lesser general public license version 3",
    26: "this work is licensed under the gnu affero general public license version 3",
    30: "licensed under cc by 4 0",
    31: "licensed under cc by sa 4 0",
    32: "licensed under cc by nc 4 0",
    33: "this work is licensed under a creative commons attribution 4 0 international license",
    34: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    35: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    36: "released under cc0 1 0",
    40: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    41: "licensed under the bsd 3 clause license",
    42: "licensed under the bsd 2 clause license",
    43: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    50: "licensed under the mozilla public license version 2 0",
    60: "this work is in the public domain",
    70: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    71: "this is free and unencumbered software released into the public domain",
    72: "this source code form is subject to the terms of the mozilla public license v 2 0",
    73: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    74: "either version 2 1 of the license or at your option any later version",
    75: "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    76: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    77: "boost software license version 1 0",
    90: "all rights reserved",
}
#: Ordered rules: a licence, and the run of sentences that states it.
RULES = [
    ("MIT", [4, 5, 6]),
    ("MIT", [4]),
    ("BSD-3-Clause", [40, 43]),
    ("BSD-2-Clause", [40]),
    ("Apache-2.0", [11, 12, 13, 14]),
    ("Apache-2.0", [11, 12]),
    ("Apache-2.0", [11]),
    ("LGPL-3.0-or-later", [73, 23]),
    ("LGPL-2.1-or-later", [73, 74]),
    ("LGPL", [73]),
    ("AGPL-3.0-or-later", [75, 23]),
    ("AGPL", [75]),
    ("GPL-3.0-or-later", [22, 23]),
    ("GPL-2.0-or-later", [22, 24]),
    ("GPL", [22]),
    ("MIT", [1]),
    ("MIT", [2]),
    ("MIT", [3]),
    ("Apache-2.0", [10]),
    ("GPL-3.0", [20]),
    ("GPL-2.0", [21]),
    ("LGPL-3.0", [25]),
    ("AGPL-3.0", [26]),
    ("CC-BY-4.0", [30]),
    ("CC-BY-SA-4.0", [31]),
    ("CC-BY-NC-4.0", [32]),
    ("CC-BY-4.0", [33]),
    ("CC-BY-SA-4.0", [34]),
    ("CC-BY-NC-4.0", [35]),
    ("CC0-1.0", [36]),
    ("BSD-3-Clause", [41]),
    ("BSD-2-Clause", [42]),
    ("MPL-2.0", [50]),
    ("MPL-2.0", [72]),
    ("ISC", [70]),
    ("Unlicense", [71]),
    ("Zlib", [76]),
    ("BSL-1.0", [77]),
    ("public-domain", [60]),
    ("all-rights-reserved", [90]),
]
#: Sentences so long that they are known wherever they stand.
NOTICES = {4, 5, 6, 12, 14, 22, 23, 24, 40, 43, 70, 71, 72, 73, 74, 75, 76, 77}
#: Sentence 43 with any holder's name.
HOLDER = ("neither the name of the copyright holder nor", r"neither the name of (?:[^ AB]+ ){1,15}?nor")
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# capitals are marks: A where a sentence ends, B where only a line does
ENDS, OTHER = r"[.!?;:]+[ \t\r\n]+", r"[^\x30-\x39\x61-\x7A\x{80}-\x{10FFFF}AB]+"


def _known(sentences: dict[int, str], notices: set[int], inside: bool, gap: str) -> str:
    """The sentences that are, or aren't, known inside longer ones, longer ones first, with ``gap`` between words."""
    some = sorted((s for n, s in sentences.items() if (n in notices) == inside), key=len, reverse=True)
    return "|".join(gap.join(re.split(" (?!AB)", s.replace(*HOLDER) if inside else s)) for s in some)


def _pattern(sentences: dict[int, str], notices: set[int]) -> str:
    """All sentences in a text with marks."""
    bounded, anywhere = _known(sentences, notices, False, " (?:B )?+"), _known(sentences, notices, True, " (?:[AB] )*+")
    ways = ([rf"(?<=[AB] )(?:{bounded})(?= [AB] )"] if bounded else []) + ([rf"(?:{anywhere})(?= )"] if anywhere else [])
    return rf"(?<= )(?:{'|'.join(ways)})"


def _plain_pattern(sentences: dict[int, str], notices: set[int]) -> str:
    """The same without looking around: every blank and mark is there twice, one for either side."""
    bounded, anywhere = _known(sentences, notices, False, "  (?:B  B  )?"), _known(sentences, notices, True, "  (?:[AB]  [AB]  )*")
    ways = ([rf" [AB]  (?:{bounded})  [AB] "] if bounded else []) + ([rf" (?:{anywhere}) "] if anywhere else [])
    return "|".join(ways)


def known_ids(text: Column, sentences: dict[int, str] = SENTENCES, notices: set[int] = NOTICES) -> Column:
    """Numbers of the known sentences of a text, in its order."""
    lowered = F.translate(F.concat(F.coalesce(text, F.lit("")), F.lit(" ")), UPPER, LOWERED)
    marked = F.concat(F.lit(" A "), F.replace(F.regexp_replace(lowered, ENDS, " A "), F.lit("\n"), F.lit(" B ")), F.lit(" A "))
    plain = F.regexp_replace(marked, OTHER, " ")
    found = F.regexp_extract_all(plain, F.lit(_pattern(sentences, notices)), F.lit(0))
    whole = F.transform(found, lambda s: F.regexp_replace(F.regexp_replace(s, " (?:[AB] )+", " "), f"^{HOLDER[1]}", HOLDER[0]))
    numbers = F.create_map(*[F.lit(x) for n, s in sentences.items() for x in (s, n)])
    return F.transform(whole, lambda s: F.element_at(numbers, s))


def scan(docs: DataFrame, sentences: dict[int, str] = SENTENCES, rules: list[tuple[str, list[int]]] = RULES) -> DataFrame:
    """(doc_id, n_known, sentence_ids, n_licenses, licenses) for every row; ids and sorted licence names are joined by commas."""
    found = docs.select("doc_id", known_ids(F.col("text"), sentences).alias("ids"))
    state = F.when(F.size("ids") > 0, F.concat(F.lit(","), F.array_join(F.transform("ids", lambda n: n.cast("string")), ",,"), F.lit(",")))
    table = found.select("doc_id", "ids", F.array(state, F.lit("")).alias("s"))
    steps = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f",{n}," for n in run)).alias("run")) for name, run in rules])
    start = F.struct(F.col("s")[0].alias("rest"), F.array().cast("array<string>").alias("names"))
    taken = F.aggregate(steps, start, lambda acc, r: F.struct(F.replace(acc["rest"], r["run"], F.lit("|")).alias("rest"), F.when(F.contains(acc["rest"], r["run"]), F.array_append(acc["names"], r["name"])).otherwise(acc["names"]).alias("names")))
    names = F.when(F.col("s")[0].isNotNull(), F.array_sort(F.array_distinct(taken["names"]))).otherwise(F.array().cast("array<string>"))
    done = table.select("doc_id", "ids", names.alias("names"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join(F.transform("ids", lambda n: n.cast("string")), ",").alias("sentence_ids"), F.size("names").cast("long").alias("n_licenses"), F.array_join("names", ",").alias("licenses"))


def oracle(sentences: dict[int, str] = SENTENCES, rules: list[tuple[str, list[int]]] = RULES, notices: set[int] = NOTICES) -> str:
    """The same over ``documents`` in DuckDB SQL, whose patterns can't look around."""
    known = ", ".join(f"({n}, '{s}')" for n, s in sentences.items())
    steps, last = "", "s0"
    for i, (name, run) in enumerate(rules, 1):
        text = "".join(f",{n}," for n in run)
        steps += f"s{i} AS (SELECT r, replace(rest, '{text}', '|') AS rest, CASE WHEN contains(rest, '{text}') THEN list_append(names, '{name}') ELSE names END AS names FROM {last}),\n"
        last = f"s{i}"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, ' A ' || replace(regexp_replace(translate(coalesce(text, '') || ' ', '{UPPER}', '{LOWERED}'), '{ENDS}', ' A ', 'g'), chr(10), ' B ') || ' A ' AS marked FROM documents),
known(n, s) AS (VALUES {known}),
w AS (SELECT r, replace(replace(replace(regexp_replace(marked, '{OTHER}', ' ', 'g'), ' ', '  '), ' A ', ' A  A '), ' B ', ' B  B ') AS twice FROM d),
x AS (SELECT r, regexp_extract_all(twice, '{_plain_pattern(sentences, notices)}') AS p FROM w),
v AS (SELECT r, unnest(p) AS s, unnest(range(1, len(p) + 1)) AS i FROM x),
y AS (SELECT r, i, regexp_replace(trim(regexp_replace(s, '[AB ]+', ' ', 'g')), '^{HOLDER[1]}', '{HOLDER[0]}') AS s FROM v),
z AS (SELECT r, count(*) AS n_known, string_agg(CAST(n AS VARCHAR), ',' ORDER BY i) AS ids, ',' || string_agg(CAST(n AS VARCHAR), ',,' ORDER BY i) || ',' AS rest FROM y JOIN known USING (s) GROUP BY r),
s0 AS (SELECT r, rest, CAST([] AS VARCHAR[]) AS names FROM z),
{steps}f AS (SELECT r, list_sort(list_distinct(names)) AS names FROM {last})
SELECT doc_id, coalesce(n_known, 0) AS n_known, coalesce(ids, '') AS sentence_ids, CAST(coalesce(len(names), 0) AS BIGINT) AS n_licenses, coalesce(array_to_string(names, ','), '') AS licenses
FROM d LEFT JOIN z USING (r) LEFT JOIN f USING (r)
"""
