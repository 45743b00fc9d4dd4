"""Licences in notices with names, expressions of tags, and statements within sentences; held against the SQL."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from qpanel.llm import licenses

BSD2 = f"{licenses.BSD_GRANT}\n\n1. {licenses.BSD_SOURCE}\n\n2. {licenses.BSD_BINARY}\n\n"
HOLDER = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
NAMED = HOLDER.replace("the copyright holder", "Foo, Bar & Sons")
GPL = "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
TAG = "// SPDX-License-Identifier: "
CASES = [
    (BSD2 + NAMED, "BSD-3-Clause"),
    (BSD2 + HOLDER, "BSD-3-Clause"),
    (BSD2 + NAMED.replace("its contributors", "any other contributors"), "BSD-3-Clause"),
    (BSD2 + "The name of J. Doe may not be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"),
    (BSD2 + NAMED.replace("Foo, Bar & Sons", "Foo Inc. and J. Doe"), "BSD-3-Clause"),
    (BSD2, "BSD-2-Clause"),
    (BSD2 + HOLDER + BSD2, "BSD-3-Clause,BSD-2-Clause"),
    (BSD2 + BSD2 + NAMED, "BSD-3-Clause,BSD-2-Clause"),
    (BSD2 + HOLDER + BSD2 + NAMED, "BSD-3-Clause"),
    (HOLDER + BSD2, "BSD-2-Clause"),
    (GPL, "GPL-3.0-or-later"),
    (TAG + "Apache-2.0 OR MIT\nint x;", "MIT,Apache-2.0"),
    (TAG + "(MIT AND BSD-3-Clause)\n", "MIT,BSD-3-Clause"),
    (TAG + "GPL-2.0+\n", "GPL-2.0-or-later"),
    (TAG + "GPL-2.0\n", "GPL-2.0-only"),
    (TAG + "LGPL-2.1-or-later OR MIT */\n", "MIT,LGPL-2.1-or-later"),
    (TAG + "GPL-2.0-or-later WITH Classpath-exception-2.0\n", "GPL-2.0-or-later"),
    (TAG + "Nothing-1.0\n", ""),
    ("This tool by Foo is licensed under the MIT license and comes without warranty.", "MIT"),
    ("Foo is licensed under the MIT License or released under the Apache License, Version 2.0, at your choice.", "Apache-2.0,MIT"),
    ("It is not licensed under the MIT license.", ""),
    ("Neither the name of the game nor the names of its players matter.", ""),
    ("No beer is free software", ""),
    (f"{'x' * 200} is free software: {GPL.split(': ')[1]}", ""),
    ("GPL-2.0+ and 2+2", ""),
    (None, ""),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    return {r["doc_id"]: r.asDict() for r in licenses.scanned(docs).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_licences_of_common_notices(found, i):
    assert found[i]["licenses"] == CASES[i][1]


def test_sql_finds_the_same(found):
    documents = pd.DataFrame({"doc_id": range(len(CASES)), "text": [t for t, _ in CASES]})
    db = duckdb.connect()
    db.register("documents", documents)
    r = db.execute(licenses.oracle())
    names = [d[0] for d in r.description]
    got = {row[0]: dict(zip(names, row)) for row in r.fetchall()}
    assert got == found
