"""License scan by sentence rules, in DataFrame functions only.

A text is normalised to its words of ASCII small letters and digits, so line breaks, comment leaders and
punctuation don't matter. Known licence sentences are found where their words stand one after the other,
longer sentences first, and each becomes its identifier; what may stand in a sentence's place for an owner
or a year is left out of it. Over GAP characters of other words break a sequence of identifiers. The
sequences are matched against the rules from the first to the last: a rule takes every place where its
sentences follow one another, and what it takes no later rule sees.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sentences of public licences and notices, by identifier
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-may-not": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-address": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-address-s": "https://www.apache.org/licenses/LICENSE-2.0",
    "apache-unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-short": "Released under the MIT License.",
    "mit-short-2": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-title-2": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-names-2": "may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-short-2": "Use of this source code is governed by a BSD-style license",
    "bsd-disclaimer": "ARE DISCLAIMED. IN NO EVENT SHALL",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "bsl-short": "Distributed under the Boost Software License, Version 1.0.",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "epl2-terms-v": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
    "epl1-terms": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-short": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-even": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "lgpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl21-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl2-later": "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "agpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc0-short": "Licensed under CC0 1.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

# fixed values: licences named by SPDX tags
TAGS = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")
SENTENCES |= {f"spdx-{t}": f"SPDX-License-Identifier: {t}" for t in TAGS}

# fixed values: licences by the sentences that declare them, the more specific first
RULES = [
    ("Apache-2.0", ("apache-header", "apache-may-not", "apache-obtain", "apache-address", "apache-unless", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-may-not", "apache-obtain", "apache-address-s", "apache-unless", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-may-not")),
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-short",)),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("MIT", ("mit-title-2", "mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-short-2",)),
    ("MIT", ("mit-title",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-short",)),
    ("ISC", ("isc-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names-2")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-short-2",)),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("LGPL-2.1-or-later", ("lgpl21-later",)),
    ("LGPL-2.0-or-later", ("lgpl2-later",)),
    ("GPL-3.0-or-later", ("gpl3-later", "gpl-hope", "gpl-even", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later", "gpl-hope", "gpl-even", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("GPL-2.0-only", ("gpl2-short",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("EPL-2.0", ("epl2-terms-v",)),
    ("EPL-1.0", ("epl1-terms",)),
    ("MPL-2.0", ("mpl-subject",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC0-1.0", ("cc0-short",)),
    ("Unlicense", ("unlicense",)),
    *((t, (f"spdx-{t}",)) for t in TAGS),
]

#: Characters of other words between two sentences of one sequence, at most.
GAP = 400
_REST = r"[^a-z0-9]+"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A text with a known sentence has one of these words or beginnings of words.
SIGNS = ("licens", "permission", "redistribut", "warrant", "merchantab", "liable", "copyright", "compliance", "domain", "disclaimed")
_GAPS, _MARK = ">[^<]{" + str(GAP) + ",}<", r"<[0-9]+>|\|"


def normal(sentence: str) -> str:
    """Each word between two spaces of its own, so that sentences that follow one another share none."""
    return "".join(f" {w} " for w in re.sub(_REST, " ", sentence.translate(str.maketrans(_UPPER, _SMALL))).split())


#: Normalised sentences, and for each rule the mark of its identifiers; both in one order everywhere.
_KNOWN = {name: normal(s) for name, s in SENTENCES.items()}
#: Sentences that are alike when normalised share the first one's number.
_NUMBER = {name: list(_KNOWN.values()).index(s) + 1 for name, s in _KNOWN.items()}
_MARKS = [("".join(f"<{_NUMBER[n]}>" for n in names), licence) for licence, names in RULES]
#: (words, number) of each sentence, longer ones first.
_FIND = sorted({s: _NUMBER[n] for n, s in reversed(_KNOWN.items())}.items(), key=lambda x: (-len(x[0]), x[1]))


def marks(text: Column) -> Column:
    """The identifiers of a text's known sentences in order, as <number>, and | where too much stands between two."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _SMALL)
    words = F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace(low, _REST, " ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    for s, number in _FIND:
        words = F.replace(words, F.lit(s), F.lit(f"<{number}>"))
    return F.when(low.rlike("|".join(SIGNS)), F.array_join(F.regexp_extract_all(F.regexp_replace(words, _GAPS, ">|<"), F.lit(_MARK), F.lit(0)), "")).otherwise("")


def scanned(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named, ``sentence_ids`` (numbers of the known ones, in order) and ``licences`` (in order of rules).

    Null and empty texts have no sentences. Repeated declarations count once in ``licences``. Repeated rows
    each keep their row, null ids stay, an empty table gives no rows, and other columns are left out unless
    named. A text is scanned whole, in a few passes for each known sentence if it has one of SIGNS.
    """
    rules = F.array(*(F.struct(F.lit(m).alias("mark"), F.lit(x).alias("licence")) for m, x in _MARKS))
    rows = docs.select(*columns, marks(F.col("text")).alias("__m"))
    start = F.struct(F.col("__m").alias("left"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, r: F.struct(F.replace(acc["left"], r["mark"], F.lit("<0>")).alias("left"), F.when(F.contains(acc["left"], r["mark"]), F.array_append(acc["found"], r["licence"])).otherwise(acc["found"]).alias("found"))
    matched = F.when(F.col("__m") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.aggregate(rules, start, step, lambda acc: acc["found"])))
    numbers = F.transform(F.regexp_extract_all("__m", F.lit("[0-9]+"), F.lit(0)), lambda k: k.cast("int"))
    return rows.select(*columns, numbers.alias("sentence_ids"), matched.alias("licences"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_known (sentences), sentence_ids, licences and n_licences."""
    found = scanned(docs)
    ids = F.array_join(F.transform("sentence_ids", lambda k: k.cast("string")), ",")
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_known"), ids.alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), F.size("licences").cast("long").alias("n_licences"))


def sql() -> str:
    """The same for DuckDB."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    words = f"' ' || replace(trim(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '{_REST}', ' ', 'g')), ' ', '  ') || ' '"
    steps = ",\n".join(f"replace(w{k}, {quoted(s)}, '<{number}>') AS w{k + 1}" for k, (s, number) in enumerate(_FIND))
    lefts = ",\n".join(f"replace(left{k}, '{m}', '<0>') AS left{k + 1}" for k, (m, _) in enumerate(_MARKS))
    found = ", ".join(f"CASE WHEN contains(left{k}, '{m}') THEN {quoted(x)} END" for k, (m, x) in enumerate(_MARKS))
    order = "[" + ", ".join(map(quoted, dict.fromkeys(x for _, x in _MARKS))) + "]"
    return f"""
WITH words AS (SELECT doc_id, {words} AS w0 FROM documents),
known AS (SELECT *, {steps} FROM words),
marks AS (SELECT doc_id, coalesce(array_to_string(regexp_extract_all(regexp_replace(w{len(_FIND)}, '{_GAPS}', '>|<', 'g'), '{_MARK}'), ''), '') AS left0 FROM known),
taken AS (SELECT *, {lefts} FROM marks),
named AS (SELECT *, [{found}] AS f, regexp_extract_all(left0, '[0-9]+') AS k FROM taken),
final AS (SELECT *, list_filter({order}, lambda x: list_contains(f, x)) AS l FROM named)
SELECT doc_id, len(k)::BIGINT AS n_known, coalesce(array_to_string(k, ','), '') AS sentence_ids, coalesce(array_to_string(l, ','), '') AS licences, len(l)::BIGINT AS n_licences FROM final"""
