import textwrap

import duckdb
import pytest

from tidelog.llm import licenses

MIT = "\n\n".join(licenses.SENTENCES[n] for n in ("mit-title-2", "mit-grant", "mit-notice", "mit-as-is")) + " " + licenses.SENTENCES["mit-liable"]
WRAPPED = licenses.SENTENCES["isc-grant"].replace("software for any", "software\n   for any").replace("hereby granted", "hereby\ngranted")

def commented(names, leader="# ", width=30):
    """Sentences wrapped as in a source file's header."""
    lines = textwrap.wrap(" ".join(licenses.SENTENCES[n] for n in names), width)
    return "\n".join(leader + x for x in lines)


def by(*names, glue=" "):
    return glue.join(licenses.SENTENCES[n] for n in names)


BSD3 = by("bsd-redistribution", "bsd-source", "bsd-binary") + " Neither the name of Ace Inc. " + by("bsd-names")
CASES = {
    None: "", "": "", " \n.": "", "No licence here. None at all!": "",
    "Some prose.\nLicensed under CC BY-NC 4.0.\nMore.": "CC-BY-NC-4.0",
    "So licensed UNDER the Apache license,   version 2.0. Released under the MIT License": "Apache-2.0,MIT",
    "licensed UNDER -- the Apache license,   version 2.0": "Apache-2.0",
    "not licensed under the Apache license, version 2.0.5 or version 21.0": "Apache-2.0",
    "unlicensed under the Apache license, version 2.0": "",
    MIT: "MIT", WRAPPED: "ISC",
    "Released under the MIT License.\nReleased under the MIT License.": "MIT",
    by("bsd-redistribution", "bsd-source", "bsd-binary"): "BSD-2-Clause",
    by("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names", glue="\n"): "BSD-3-Clause",
    BSD3: "BSD-3-Clause",
    by("bsd-source", "bsd-redistribution", "bsd-binary", glue="\n"): "",
    by("gpl3-later", "gpl-hope", "gpl-even", "gpl-see", glue="\n"): "GPL-3.0-or-later",
    commented(["gpl2-later", "gpl-hope"], " * "): "GPL-2.0-or-later",
    commented(["lgpl21-later"], "// "): "LGPL-2.1-or-later", commented(["agpl3-later"], "-- "): "AGPL-3.0-or-later",
    commented(["mit-grant", "mit-notice"], "# "): "MIT", commented(["apache-header", "apache-may-not"], ";; "): "Apache-2.0",
    commented(["bsd-redistribution", "bsd-source", "bsd-binary"], "dnl "): "",
    "/* SPDX-License-Identifier: Apache-2.0 */": "Apache-2.0", "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0": "GPL-2.0",
    by("epl2-terms"): "EPL-2.0", by("bsl-short"): "BSL-1.0", by("zlib-as-is", "zlib-grant"): "Zlib",
    by("mit-grant") + " few words between " + by("mit-notice"): "MIT",
    by("mit-grant") + " word" * 200 + " " + by("mit-notice"): "",
    "word " * 20000 + ".\nLicensed under CC0 1.0.": "CC0-1.0",
}


@pytest.fixture
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(CASES)] + [(1, "twice", "x"), (1, "twice", "x"), (None, "Licensed under CC BY 4.0.", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, licences string")


def test_cases(docs):
    got = {r.doc_id: r.licences for r in licenses.digest(docs).where("doc_id is not null").collect()}
    want = dict(enumerate(CASES.values()))
    assert {k: v for k, v in got.items() if k != 1} == {k: v for k, v in want.items() if k != 1}
    assert licenses.digest(docs).count() == docs.count()
    assert licenses.digest(docs.where("false")).count() == 0


def test_sql_agrees(docs):
    pandas = docs.select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", pandas)
    key = lambda r: tuple(None if x is None or x != x else str(int(x)) if isinstance(x, float) else str(x) for x in r)
    want = sorted(map(key, con.sql(licenses.sql()).fetchall()), key=str)
    assert sorted(map(key, licenses.digest(docs).collect()), key=str) == want


def test_no_python_in_the_plan(docs):
    plan = licenses.digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rules_are_of_known_sentences():
    assert all(any(x in licenses.SENTENCES[n].lower() for x in licenses.SIGNS) for n in licenses.SENTENCES)
    assert set(licenses.TAGS) <= {x for x, _ in licenses.RULES}
    assert all(n in licenses.SENTENCES for _, names in licenses.RULES for n in names)
