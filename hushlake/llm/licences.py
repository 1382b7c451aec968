"""Licence scans by canonical digests of whole texts."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, as pattern and replacement, applied in this order to lower-case text.
SPELLINGS = [
    ("licence", "license"),
    ("licens(?:ee|or)s", "licensee"),
    ("sub-licen[cs]e", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("copyright-holder", "copyright holder"),
    ("merchantibility", "merchantability"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("fulfil ", "fulfill "),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("labour", "labor"),
    ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"),
    ("https://", "http://"),
]
#: Words after "copyright" at the beginning of a line that is part of a clause, not a notice.
_CLAUSE = "notices?|holders?|owners?|laws?|licensed?|licen[sc]es?|licensing|interests?|rights?|protections?|statements?|and|or|in|of|to|is|as|for|on|that|acts?|doctrines?|treaty|treaties|status|disclaimers?|permissions?|information|infringements?|registrations?|ownership|applicable|materials?|works?|terms?|from|under|with|without|shall|may|are|was|has|have|will|be|which|if|exists|subsists|attributions?|legends?|including|any|all|such|other|header|over|covering|claims?|grants?|by law"
#: A notice: "copyright" with (c), a year or a holder, (c) with a year, or "all rights reserved" alone on a line.
COPYRIGHT = rf"(?m)^[ \t*#/;.|-]*(?:copyright[ \t:,]*(?:\(c\)|©|(?:19|20)[0-9][0-9]|[\[<{{])[^\n]*|copyright[ \t:,]+(?!(?:{_CLAUSE})\b)[\p{{L}}][^\n]*|(?:\(c\)|©)[ \t]*(?:copyright[ \t]*)?(?:19|20)[0-9][0-9][^\n]*|all rights reserved[.]?[ \t]*)$"
#: The SQL's, which doesn't know notices from clauses.
SQL_COPYRIGHT = r"(?m)^[ \t*#/;.|-]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"

#: Public licence texts and the usual notices, by SPDX name.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD3 + _BSD_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
]

#: (licence, digest, word) of the full texts that are too long to stand here, with and without what follows their terms.
#: The word is a part of any line that is the text; "license" is looked for in any case.
DIGESTS = Path(__file__).with_name("licence_digests.json")


#: Known words up to which lines are looked through for them first.
GATE = 200
#: Parts of the patterns above: a text without any of them is as it was.
SPELLING_SIGNS = ["licen", "non-commercial", "copyright-holder", "merchantibility", "whilst", "wilful", "fulfil ", "organisation", "authorisation", "favour", "labour", "judgement", "acknowledgement", "https://"]
COPYRIGHT_SIGNS = ["copyright", "(c)", "©", "all rights reserved"]


def _any(text: Column, signs: list[str]) -> Column:
    out = F.lit(False)
    for s in signs:
        out = out | F.contains(text, F.lit(s))
    return out


def canonical(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with canonical_: a text without case, copyright lines, punctuation and extra white space, in one spelling.

    Plain searches spare most texts the patterns. Each step is a column of its own, so none is worked out twice.
    """
    rows = rows.withColumn("low_", F.lower(text))
    rows = rows.withColumn("plain_", F.when(_any(F.col("low_"), COPYRIGHT_SIGNS), F.regexp_replace("low_", COPYRIGHT, " ")).otherwise(F.col("low_")))
    spelt = F.col("plain_")
    for pattern, by in SPELLINGS:
        spelt = F.regexp_replace(spelt, pattern, by)
    rows = rows.withColumn("spelt_", F.when(_any(F.col("plain_"), SPELLING_SIGNS), spelt).otherwise(F.col("plain_")))
    return rows.withColumn("canonical_", F.trim(F.regexp_replace("spelt_", "[^a-z0-9]+", " "))).drop("low_", "plain_", "spelt_")


def digest(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with digest: SHA-256 of the canonical form; null if that is empty or the text null."""
    c = F.col("canonical_")
    return canonical(rows, text).withColumn("digest", F.when(c != "", F.sha2(c.cast("binary"), 256)))


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, licence, word) of the known texts, those of ``DIGESTS`` included if none are given; of texts with one canonical form the first licence by name. word is the longest of a text."""
    rows = digest(spark.createDataFrame(texts or KNOWN, "licence string, text string"), "text").where("digest is not null").withColumn("c", F.col("canonical_"))
    word = F.array_max(F.transform(F.split("c", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    rows = rows.select("licence", "digest", word.alias("word"))
    if texts is None:
        rows = rows.union(spark.createDataFrame([tuple(x) for x in json.loads(DIGESTS.read_text())], "licence string, digest string, word string"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"), F.min("word").alias("word"))


def scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """(doc_id, digest, licence, line_licences): for each document the licence that its whole text is, null if none, and those of its lines, sorted.

    ``licences`` has one row per digest, as ``known`` gives it. A line equal to a known text holds that
    text's longest word, or something that is spelt anew; other lines need no digest. Null and empty texts match nothing. Documents of
    one digest stay apart, so copies of a licence are one row each.
    """
    table = licences.select("digest", "licence")
    own = docs.select("doc_id", F.xxhash64("text").alias("own"), "text")
    whole = digest(own, "text").select("doc_id", "own", "digest").join(table, "digest", "left")
    signs = [r["word"] for r in licences.select("word").distinct().limit(GATE + 1).collect()]
    lines = own.select("doc_id", "own", F.explode(F.split("text", "\n")).alias("line"))
    if len(signs) <= GATE:
        lines = lines.where(_any(F.lower("line"), signs + SPELLING_SIGNS))
    found = digest(lines, "line").join(table, "digest").groupBy("doc_id", "own").agg(F.sort_array(F.collect_set("licence")).alias("line_licences"))
    found = found.withColumnsRenamed({"doc_id": "id", "own": "o"})
    out = whole.join(found, whole["doc_id"].eqNullSafe(found["id"]) & (whole["own"] == found["o"]), "left")
    return out.select("doc_id", "digest", "licence", F.coalesce("line_licences", F.array().cast("array<string>")).alias("line_licences"))


def sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(t: str) -> str:
        t = f"regexp_replace(lower({t}), {quote(SQL_COPYRIGHT)}, ' ', 'g')"
        for pattern, by in SPELLINGS:
            t = f"regexp_replace({t}, {quote(pattern)}, {quote(by)}, 'g')"
        return f"trim(regexp_replace({t}, '[^a-z0-9]+', ' ', 'g'))"

    rows = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    return f"""
with k0 as (select licence, {canon('text')} as c from (values {rows}) v(licence, text)),
k as (select sha256(c) as digest, min(licence) as licence from k0 where c <> '' group by 1),
d as (select doc_id, text, {canon('text')} as c from documents),
l as (select doc_id, text, unnest(string_split(text, chr(10))) as line from documents),
lc as (select doc_id, text, {canon('line')} as c from l),
f as (select doc_id, text, list_sort(list_distinct(list(licence))) as line_licences
      from lc join k on sha256(lc.c) = k.digest where c <> '' group by 1, 2)
select d.doc_id, case when c <> '' then sha256(c) end as digest, k.licence, coalesce(f.line_licences, []) as line_licences
from d left join k on c <> '' and sha256(c) = k.digest
left join f on d.doc_id is not distinct from f.doc_id and d.text is not distinct from f.text
"""
