"""Licence texts and notices as they are really written: wrapped, indented and behind comment marks."""

import duckdb
import pytest
from test_contracts import frame

from relplan.llm import licenses

MIT = """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD2 + """
3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
CASES = [
    (MIT, "4,5,6", "MIT"),
    (BSD2, "40", "BSD-2-Clause"),
    (BSD3.format("the copyright holder"), "40,43", "BSD-3-Clause"),
    (BSD3.format("Some Company Inc."), "40,43", "BSD-3-Clause"),
    (GPL.format(":", ",", 3), "22,23", "GPL-3.0-or-later"),
    (GPL.format(";", ";", 2), "22,24", "GPL-2.0-or-later"),
    (APACHE, "11,12,13,14", "Apache-2.0"),
    ("This project is licensed\nunder the MIT License.", "3", "MIT"),
    ("It was never licensed under the MIT License, they say.\n\nLicensed under\n\nthe MIT License.", "", ""),
    ("B licensed A under the MIT license. A", "", ""),
]


@pytest.mark.parametrize("mark", ["", "// ", " * ", "# ", "one line"])
def test_real_texts(spark, mark):
    def written(t):
        return t.replace("\n", " ") if mark == "one line" else "\r\n".join(mark + line for line in t.split("\n"))

    cases = CASES[:8] if mark == "one line" else CASES
    rows = [(i, written(t)) for i, (t, _, _) in enumerate(cases)]
    found = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan(frame(spark, rows)).collect()}
    want = {i: (ids, names) for i, (_, ids, names) in enumerate(cases)}
    if mark == "one line":  # nothing ends the sentences before the address there
        want[6], found[6] = (want[6][1],), (found[6][1],)
    assert found == want


def test_notices_of_other_licences(spark):
    from relplan.llm import licenses

    texts = {
        "ISC": "Copyright (c) 2020 Someone\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n",
        "LGPL-2.1-or-later": "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version.\n",
        "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n",
        "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish it.\n",
        "Zlib": "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n",
        "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted\n",
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())] + [(99, "you can redistribute it, said the general public")], "doc_id long, text string")
    found = {r.doc_id: r.licenses for r in licenses.scan(rows).collect()}
    assert found == {**dict(enumerate(texts)), 99: ""}


def test_sql_knows_the_same_texts(spark, tmp_path):
    texts = [t for t, _, _ in CASES] + ["> " + t.replace("\n", "\n> ") for t, _, _ in CASES] + [" ".join(t.split()) for t, _, _ in CASES]
    texts += [" ".join(t for t, _, _ in CASES), "\n".join(t for t, _, _ in CASES), "Licensed under\r\nthe MIT License.\r\nLicensed under the MIT License!", "", None, "A B\n\n A", "Straße. All rights\nreserved; ALL RIGHTS RESERVED: all rights reserved"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (0, texts[1])]
    docs = frame(spark, rows)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = sorted(c.sql(licenses.oracle()).fetchall(), key=str)
    found = [tuple(r) for r in licenses.scan(docs).collect()]
    assert sorted(found, key=str) == want
    assert sum(r[1] > 0 for r in found) > 25
