"""Licence scan: official texts as they are wrapped, comment leaders, tags, the SQL twin, edge cases; no Python in its plan."""

import os
import textwrap

import pytest

from riskloom.llm.licence_texts import NOTICES, RULES, SENTENCES
from riskloom.llm.licenses import licenses_sql, scan_licenses

from .helpers import DOCS, docs, prose
from .test_native import no_python, spark_rows, sql_rows

MIT = next(t for n, t in NOTICES if n == "MIT")
BSD2, BSD3 = next(t for n, t in NOTICES if n == "BSD-2-Clause"), next(t for n, t in NOTICES if n == "BSD-3-Clause").replace("<holder>", "the copyright holder")
GPL2, GPL3, MPL = (next(t for n, t in NOTICES if n == name and "\n\n" in t or n == name == "MPL-2.0" and "Source Code Form" in t) for name in ("GPL-2.0-or-later", "GPL-3.0-or-later", "MPL-2.0"))
APACHE = next(t for n, t in NOTICES if n == "Apache-2.0" and "You may obtain" in t)
MIT_FILE = f"The MIT License (MIT)\n\nCopyright (c) 2015 Some One\nAll rights reserved.\n\n{MIT} IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.\n"


def commented(text, leader):
    return "\n".join(f"{leader}{x}".rstrip() for x in text.split("\n"))


LICENSED = [
    (1, f"Some words. {MIT}\nMore."), (2, "Hello\nLicensed under the Apache License, Version 2.0."), (3, "Released under the MIT  License. And more\nAll rights reserved!\n"), (4, None), (5, ""), (6, "  \n "), (7, "no licence here"),
    (8, MIT.replace("\n\nThe above", "\n\nunknown words.\n\nThe above")), (9, "\n\n".join(MIT.split("\n\n")[1::-1])), (10, BSD3), (11, BSD2), (12, prose(2, 20_000) + "\nLicensed under CC BY-NC 4.0."), (13, "." * 100_000 + " " * 100_000 + "\n\t\nEnd.. \nx" + "*" * 50_000),
    (14, MIT_FILE), (15, "/*\n" + commented(MIT_FILE, " * ") + "\n */\nint main() {}\n"), (16, commented(APACHE, "# ")), (17, commented(GPL2, "// ")), (18, GPL3), (19, f"***** BEGIN LICENSE BLOCK *****\n{MPL}\n***** END *****".replace("<address>", "s://")),
    (20, "// SPDX-License-Identifier: GPL-2.0-only\n// Copyright 2020 A\nint x;"), (21, commented(BSD3, "\t;; ")), (22, textwrap.fill(MIT, 40, break_long_words=False)), (23, "(c) Me. All rights reserved.\n\n" + BSD3), (24, MIT.upper()), (25, "Ü. ßx! Ünd\n中文\nAll rights reserved"),
]
NAMED = {
    1: "MIT", 2: "Apache-2.0", 3: "MIT,Proprietary", 8: "MIT", 10: "BSD-3-Clause", 11: "BSD-2-Clause", 12: "CC-BY-NC-4.0", 14: "MIT", 15: "MIT", 16: "Apache-2.0", 17: "GPL-2.0-or-later", 18: "GPL-3.0-or-later",
    19: "MPL-2.0", 20: "GPL-2.0-only", 21: "BSD-3-Clause", 22: "MIT", 23: "BSD-3-Clause", 24: "MIT", 25: "Proprietary",
}


def test_licenses(spark):
    out = scan_licenses(docs(spark, LICENSED))
    no_python(out)
    got = {x["doc_id"]: x for x in spark_rows(out)}
    assert sorted(got.values(), key=lambda x: x["doc_id"]) == sorted(sql_rows(licenses_sql(), documents=LICENSED), key=lambda x: x["doc_id"])
    assert {i: x["licenses"] for i, x in got.items() if x["licenses"]} == NAMED


def test_licenses_repeats(spark):
    rows = [(None, "All rights reserved."), (5, "All rights reserved."), (5, "All rights reserved.")]
    assert [x["licenses"] for x in spark_rows(scan_licenses(docs(spark, rows)))] == ["Proprietary"] * 3
    assert scan_licenses(spark.createDataFrame([], DOCS)).collect() == []


def test_every_rule_finds_its_own_licence(spark):
    """Each rule's sentences, a word in place of each star, one to a line."""
    texts = [(i, "\n\n".join(SENTENCES[s].replace("*", " some words ") + "." for s in ids)) for i, (_, ids) in enumerate(RULES)]
    got = {x["doc_id"]: x["licenses"] for x in scan_licenses(docs(spark, texts)).collect()}
    assert {i: got[i] for i in got if RULES[i][0] not in got[i].split(",")} == {}
    assert len({licence for licence, _ in RULES}) >= 30


SHARED = "/usr/share/common-licenses"
FILES = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0"}


@pytest.mark.skipif(not os.path.isdir(SHARED), reason="no licence files on this system")
def test_unaltered_files(spark):
    names = [n for n in FILES if os.path.exists(f"{SHARED}/{n}")]
    texts = [(i, open(f"{SHARED}/{n}", encoding="utf-8").read()) for i, n in enumerate(names)]
    got = {names[x["doc_id"]]: x["licenses"] for x in scan_licenses(docs(spark, texts)).collect()}
    assert got == {n: FILES[n] for n in names}
