"""Licence scans by sentence rules, in DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

#: Rules in order of precedence: a licence and the sentences it needs, in this order, others allowed between.
#: The wording of public licences and of the notices that they ask for.
MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_HOLDER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_AUTHOR = "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."
FSF = "as published by the Free Software Foundation"
LATER = "or (at your option) any later version."
ISC_GRANT = "Permission to use, copy, modify, {} distribute this software for any purpose with or without fee is hereby granted"
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License"
TEXTS = (
    ("MIT", (MIT_GRANT, MIT_NOTICE)),
    ("BSD-3-Clause", (BSD_GRANT, BSD_SOURCE, BSD_BINARY, BSD_HOLDER)),
    ("BSD-3-Clause", (BSD_GRANT, BSD_SOURCE, BSD_BINARY, BSD_AUTHOR)),
    ("BSD-2-Clause", (BSD_GRANT, BSD_SOURCE, BSD_BINARY)),
    ("Apache-2.0", ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',)),
    ("Apache-2.0", ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",)),
    ("GPL-3.0-or-later", (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License {FSF}, either version 3 of the License, {LATER}",)),
    ("GPL-2.0-or-later", (f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License {FSF}; either version 2 of the License, {LATER}",)),
    ("GPL-3.0-only", (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License {FSF}, version 3.",)),
    ("GPL-3.0-only", (f"This program is free software: you can redistribute it and/or modify it under the terms of version 3 of the GNU General Public License {FSF}.",)),
    ("GPL-2.0-only", (f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 {FSF}.",)),
    ("GPL-2.0-only", (f"This program is free software; you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License {FSF}.",)),
    ("LGPL-3.0-or-later", (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License {FSF}, either version 3 of the License, {LATER}",)),
    ("LGPL-3.0-or-later", (f"This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License {FSF}, either version 3 of the License, {LATER}",)),
    ("LGPL-2.1-or-later", (f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License {FSF}; either version 2.1 of the License, {LATER}",)),
    ("AGPL-3.0-or-later", (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License {FSF}, either version 3 of the License, {LATER}",)),
    ("MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",)),
    ("ISC", (ISC_GRANT.format("and/or") + ", provided that the above copyright notice and this permission notice appear in all copies.",)),
    ("ISC", (ISC_GRANT.format("and") + ", provided that the above copyright notice and this permission notice appear in all copies.",)),
    ("0BSD", (ISC_GRANT.format("and/or") + ".",)),
    ("EPL-2.0", (EPL + " 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",)),
    ("EPL-2.0", (EPL + " 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",)),
    ("EPL-1.0", (EPL + " v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",)),
    ("CC0-1.0", ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",)),
    ("BSL-1.0", ('Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',)),
    ("BSL-1.0", ("Distributed under the Boost Software License, Version 1.0.",)),
    ("Zlib", ("In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:")),
    ("Unlicense", ("This is free and unencumbered software released into the public domain.",)),
    ("WTFPL", ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",)),
    # titles of whole licence texts, which stand in paragraphs of their own
    ("GPL-3.0-only", ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",)),
    ("GPL-2.0-only", ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",)),
    ("LGPL-3.0-only", ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",)),
    ("LGPL-2.1-only", ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",)),
    ("AGPL-3.0-only", ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",)),
    ("MPL-2.0", ("Mozilla Public License Version 2.0",)),
    ("EPL-2.0", ("Eclipse Public License - v 2.0",)),
    ("BSL-1.0", ("Boost Software License - Version 1.0 - August 17th, 2003",)),
    ("CC0-1.0", ("CC0 1.0 Universal",)),
    # short statements
    ("Apache-2.0", ("Licensed under the Apache License, Version 2.0.",)),
    ("MIT", ("Released under the MIT License.",)),
    ("MIT", ("Licensed under the MIT License.",)),
    ("GPL-3.0-only", ("This work is licensed under the GNU General Public License version 3.",)),
    ("GPL-2.0-only", ("This work is licensed under the GNU General Public License version 2.",)),
)
#: Licences whose short identifiers occur in tags, and the kinds of Creative Commons licences. Fixed values.
TAGGED = ("MIT", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0", "GPL-3.0-or-later", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-2.0-only", "LGPL-3.0-or-later", "LGPL-3.0-only", "LGPL-2.1-or-later", "LGPL-2.1-only", "AGPL-3.0-or-later", "AGPL-3.0-only", "MPL-2.0", "ISC", "0BSD", "EPL-2.0", "EPL-1.0", "CC0-1.0", "BSL-1.0", "Zlib", "Unlicense", "WTFPL")
#: Short identifiers of before the suffixes -only and -or-later, which is written as a plus. Fixed values.
PLAIN = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
COMMONS = (("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-SA", "Attribution-ShareAlike"), ("BY", "Attribution"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A tag is a sentence to the end of its line.
TAG = r"spdx-license-identifier:[ \t]*([^\r\n]*)"
SPDX = "spdx license identifier "
#: A plus behind a version of these, within texts that have a tag.
PLUS = r"(gpl-[0-9.]+)\+"
#: A sentence ends at a mark before white space or the end, or at a line without letters and digits; other line ends, and what comments have before their lines, are space.
END = r"[.!?:;]+[\x22\x27)\]]*([ \t\r\n]+|\z)|\n[^a-z0-9\x01\n]*\n[^a-z0-9\x01]*"
OTHER = "[^a-z0-9\x01]+"


def cut(text: str) -> list[str]:
    """sentences() of a short text, for the tables."""
    t = re.sub(TAG, "\x01spdx license identifier \\1\x01", text.translate(str.maketrans(UPPER, LOWER)))
    t = re.sub(OTHER, " ", re.sub(END.replace(r"\z", r"\Z"), "\x01", t))
    return [s.strip(" ") for s in t.split("\x01") if s.strip(" ")]


def tables() -> tuple[dict[str, int], list[tuple[str, tuple[int, ...]]]]:
    """Identifiers of the known sentences, and rules as sequences of them."""
    texts = list(TEXTS)
    for short, name in COMMONS:
        for version, realm in (("4.0", "International"), ("3.0", "Unported")):
            spdx = f"CC-{short}-{version}"
            texts += [(spdx, (t,)) for t in (f"Licensed under CC {short} {version}.", f"This work is licensed under CC {short} {version}.", f"This work is licensed under a Creative Commons {name} {version} {realm} License.", f"SPDX-License-Identifier: {spdx}")]
    texts += [(n, (f"SPDX-License-Identifier: {n}",)) for n in TAGGED]
    texts += [(f"{n}-only", (f"SPDX-License-Identifier: {n}",)) for n in PLAIN]
    texts.append(("LicenseRef-AllRightsReserved", ("All rights reserved.",)))
    known: dict[str, int] = {}
    rules = []
    for name, parts in texts:
        rules.append((name, tuple(known.setdefault(s, len(known) + 1) for p in parts for s in cut(p))))
    return known, rules


SENTENCES, RULES = tables()
#: Sentences with an open slot (holders, an author, a program): how they end, up to how many characters they have, and the known sentence.
#: Names may hold marks that end a sentence ("J. Doe", "Foo Inc."), so what stands before the slot may have been cut off.
ENDORSE = "be used to endorse or promote products derived from this software without specific prior written permission"
SLOTS = (
    (f" contributors may {ENDORSE}", 400, cut(BSD_HOLDER)[0]),
    (f" may not {ENDORSE}", 400, cut(BSD_AUTHOR)[0]),
    (" is free software", 100, "this program is free software"),
)
#: Statements within longer sentences, and the known sentence; not behind "not".
PHRASES = tuple(
    (f"{verb} {name}", known)
    for name, known in (("the mit license", "licensed under the mit license"), ("the apache license version 2 0", "licensed under the apache license version 2 0"))
    for verb in ("licensed under", "released under", "distributed under", "available under", "under the terms of")
)
#: A rule that begins others falls away where their further sentence takes its place: its sentences, and the further ones.
BASE = next(r for name, r in RULES if name == "BSD-2-Clause")
BEYOND = tuple(r[len(BASE)] for name, r in RULES if name == "BSD-3-Clause" and len(r) > len(BASE))


def sentences(text: Column) -> Column:
    """Normalised sentences: a-z and 0-9, one space for each run of anything else; empty ones left out."""
    t = F.translate(text, UPPER, LOWER)
    tagged = F.regexp_replace(F.regexp_replace(t, PLUS, "$1-or-later"), TAG, "\x01spdx license identifier $1\x01")
    t = F.when(F.contains(t, F.lit("spdx-license-identifier:")), tagged).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, END, "\x01"), OTHER, " ")
    return F.filter(F.transform(F.split(t, "\x01"), lambda s: F.trim(s)), lambda s: s != "")


def in_order(line: Column, rule: tuple[int, ...]) -> Column:
    """Whether the identifiers of a rule occur in this order in a line like ',3,17,4,': each is sought from where the one before was found."""
    at = F.lit(1)
    for i in rule:
        at = F.call_function("locate", F.lit(f",{i},"), line, at)
        # 0 (not found) stays 0: nothing is found from there
        at = F.when(at > 0, at + len(str(i)) + 1).otherwise(0)
    return at > 0


def readings(s: Column) -> Column:
    """The known sentences that a sentence stands for: itself, the licences of a tag's expression, that of its slot, or statements within it."""
    nothing = F.array().cast("array<string>")
    # "or later" is part of a name, other words join names; what follows "with" is an exception
    names = F.split(F.replace(F.substring(s, len(SPDX) + 1, 1_000_000), F.lit(" or later"), F.lit(" orlater")), " (or|and) ")
    tags = F.transform(names, lambda n: F.concat(F.lit(SPDX), F.trim(F.replace(F.regexp_replace(n, " with .*", ""), F.lit(" orlater"), F.lit(" or later")))))
    out = F.when(s.isin(*SENTENCES), F.array(s)).when(s.startswith(SPDX), F.filter(tags, lambda t: t.isin(*SENTENCES)))
    for last, most, known in SLOTS:
        out = out.when(s.endswith(last) & (F.length(s) <= most), F.array(F.lit(known)))
    stated = F.array_distinct(F.array_compact(F.array(*[F.when(s.contains(p) & ~s.contains(f"not {p}"), F.lit(known)) for p, known in PHRASES])))
    return out.when(s.contains(" license"), stated).otherwise(nothing)


def stands_alone(ids: Column) -> Column:
    """Whether the sentences of BASE occur in order once more than further sentences take them up, in one pass over the identifiers.

    Counts of what has been found up to the first, the second, ... sentence: each
    sentence moves one on, and one of BEYOND takes a whole one away.
    """
    n = len(BASE)

    def step(c: Column, i: Column) -> Column:
        gone = [(c[k] > 0) & (i == BASE[k + 1] if k + 1 < n else i.isin(*BEYOND)) for k in range(n)]
        come = [i == BASE[0], *gone[:-1]]
        return F.array(*[c[k] + come[k].cast("int") - gone[k].cast("int") for k in range(n)])

    return F.aggregate(ids, F.array(*[F.lit(0)] * n), step)[n - 1] > 0


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of each whole text.

    Sentences are looked up in a fixed table, those with an open slot (a name, a program)
    by how they end, tags by the licences of their expression, and statements
    within longer sentences by their words; the identifiers found, in the
    text's order, are matched against RULES, whose sentences must occur in order. A
    licence that is the beginning of another counts only if it also stands alone. Both
    tables are constants, so a scan is a projection: no shuffle, nothing broadcast.
    Matching goes through the identifiers once for each sentence of a rule, however
    many there are. Null text is the empty text, without sentences; null ids stay null;
    repeated rows are scanned each; columns beside id_col and text_col are not read; an
    empty table gives an empty result.
    Returns id_col, n_sentences, n_known, sentence_ids, licenses (distinct, in the order
    of RULES), license (the first of them, or null).
    """
    ids = F.create_map(*[x for s, i in SENTENCES.items() for x in (F.lit(s), F.lit(i))])
    # the lists are made once: a higher-order function on its own row
    df = docs.select(F.col(id_col).alias(id_col), sentences(text_or_empty(text_col)).alias("_all"))
    df = df.select(id_col, F.size("_all").cast("long").alias("n_sentences"), F.transform(F.flatten(F.transform("_all", readings)), lambda s: F.element_at(ids, s)).alias("_ids"))
    df = df.select(id_col, "n_sentences", "_ids", F.size("_ids").cast("long").alias("n_known"), F.array_join(F.col("_ids").cast("array<string>"), ",").alias("sentence_ids"))
    line = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    found = F.array_distinct(F.array_compact(F.array(*[F.when(in_order(line, r) & (stands_alone(F.col("_ids")) if r == BASE else F.lit(True)), name) for name, r in RULES])))
    df = df.withColumn("_found", F.when(F.col("n_known") > 0, found).otherwise(F.array().cast("array<string>")))
    return df.select(id_col, "n_sentences", "n_known", "sentence_ids", F.array_join("_found", ",").alias("licenses"), F.try_element_at("_found", F.lit(1)).alias("license"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    n = len(BASE)
    quoted = ", ".join(f"('{s}', {i})" for s, i in SENTENCES.items())
    rules = ", ".join(f"({k}, '{name}', '" + "," + ",([0-9,]*,)?".join(map(str, r)) + f",', {r == BASE})" for k, (name, r) in enumerate(RULES))
    slots = " ".join(f"WHEN ends_with(s, '{last}') AND length(s) <= {most} THEN ['{known}']" for last, most, known in SLOTS)
    each = ", ".join(f"CASE WHEN contains(s, '{p}') AND NOT contains(s, 'not {p}') THEN '{known}' END" for p, known in PHRASES)
    stated = f"list_filter([{each}], lambda x, k: x IS NOT NULL AND list_position([{each}], x) = k)"
    gone = [f"(c.c{k} > 0 AND " + (f"x.i = {BASE[k + 1]})" if k + 1 < n else f"x.i IN ({', '.join(map(str, BEYOND))}))") for k in range(n)]
    come = [f"(x.i = {BASE[0]})", *gone[:-1]]
    zeros = ", ".join(f"c{k} := 0" for k in range(n))
    step = ", ".join(f"c{k} := (c.c{k} + {come[k]}::INT - {gone[k]}::INT)::INT" for k in range(n))
    return f"""
WITH known(s, i) AS (VALUES {quoted}), m AS (SELECT map(list(s), list(i)) AS m FROM known), rules(k, name, pattern, base) AS (VALUES {rules}),
t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
a AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(
         CASE WHEN contains(t, 'spdx-license-identifier:') THEN regexp_replace(regexp_replace(t, '{PLUS}', '\\1-or-later', 'g'), '{TAG}', chr(1) || 'spdx license identifier \\1' || chr(1), 'g') ELSE t END,
         '{END}', chr(1), 'g'), '[^a-z0-9\\x01]+', ' ', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS l FROM t
), b AS (
  SELECT doc_id, len(l)::BIGINT AS n_sentences, list_filter(list_transform(flatten(list_transform(l, lambda s: CASE
           WHEN m.m[s] IS NOT NULL THEN [s]
           WHEN starts_with(s, '{SPDX}') THEN list_transform(regexp_split_to_array(replace(substr(s, {len(SPDX) + 1}), ' or later', ' orlater'), ' (or|and) '), lambda n: '{SPDX}' || trim(replace(regexp_replace(n, ' with .*', ''), ' orlater', ' or later')))
           {slots}
           WHEN contains(s, ' license') THEN {stated}
           ELSE [] END)), lambda s: m.m[s]), lambda x: x IS NOT NULL) AS ids FROM a, m
), c AS (
  SELECT row_number() OVER () AS row, doc_id, n_sentences, len(ids)::BIGINT AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
         list_reduce(list_concat([struct_pack(i := 0, {zeros})], list_transform(ids, lambda i: struct_pack(i := i, {zeros}))), lambda c, x: struct_pack(i := 0, {step})).c{n - 1} > 0 AS alone FROM b
), f AS (
  SELECT row, list(name ORDER BY k) AS found FROM c JOIN rules ON regexp_matches(',' || sentence_ids || ',', pattern) AND (NOT base OR alone) WHERE n_known > 0 GROUP BY row
), g AS (SELECT row, list_filter(found, lambda x, k: list_position(found, x) = k) AS once FROM f)
SELECT doc_id, n_sentences, n_known, sentence_ids, coalesce(array_to_string(once, ','), '') AS licenses, once[1] AS license FROM c LEFT JOIN g USING (row)
"""
