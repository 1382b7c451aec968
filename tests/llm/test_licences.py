"""Full licence texts, and lines that begin with "copyright" in clauses and in notices."""

from __future__ import annotations

import textwrap

import pytest
from oracle import both
from test_text import docs

from hushlake.llm import licences
from hushlake.llm.queries import ORACLES, QUERIES

ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
NAMES = {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "Zlib", "BSL-1.0", "0BSD"}


def test_wrapped_and_full_texts(spark):
    isc = dict(licences.KNOWN)["ISC"].removeprefix("ISC License\n\n")
    wrapped = [textwrap.fill(isc, n) for n in range(40, 100)]
    wrapped = [t for t in wrapped if "\ncopyright notice" in t]
    assert wrapped
    notices = ["Copyright (c) 2020 Someone", "Copyright 2020-2024, Someone", "Copyright Jane Doe <jane@example.com>", " * (C) 2019 Someone", "© 2020", "Copyright © Someone\nAll rights reserved."]
    rows = [(i, t, "s", "en") for i, t in enumerate(wrapped)] + [(100 + i, f"{n}\n\n{isc}", "s", "en") for i, n in enumerate(notices)]
    rows += [(200, "Copyright (C) A Name\n\n" + textwrap.fill(ZERO_BSD.replace("\n\n", " "), 70), "s", "en"), (201, ZERO_BSD.replace("\n\n", " "), "s", "en"), (300, "one\ncopyright law of the country\ntwo", "s", "en"), (301, "one\ntwo", "s", "en")]
    got = {r["doc_id"]: r for r in licences.scan(docs(spark, rows), licences.known(spark)).collect()}
    assert {got[i]["licence"] for i in got if i < 200} == {"ISC"}
    assert got[200]["licence"] == got[201]["licence"] == "0BSD" and got[201]["line_licences"] == ["0BSD"]
    assert got[300]["digest"] != got[301]["digest"]
    assert NAMES <= {r["licence"] for r in licences.known(spark).collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    got, wanted = both(spark, QUERIES["op6_licences"], ORACLES["op6_licences"], f"/root/testdata/{sf}")
    assert got == wanted and got
