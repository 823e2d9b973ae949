"""License scans by canonical digest lookup.

Method: a whole text is normalised (lower case, copyright lines out, equivalent
spellings alike, punctuation and runs of space to one space) and its SHA-256 is
hash-joined to the digests of known licence texts, normalised by the same
expression. The table of known licences is the only broadcast side: it is a list
of parameters, not data. Its SQL knows this form and the four short licences.

What that form misses is looked up by a second one, which doesn't depend on line
wrapping: only real copyright statements go (a year, (c) or a holder), as do title,
"all rights reserved" and holders' names in the usual clauses, and spellings are
folded more widely. Its table holds the texts of ``licenses/`` as well, each with
and without what follows its terms. ``digest`` is that of the first form.

Edge cases: null and empty texts match nothing; null doc_ids and repeated rows
keep a row each; an empty table gives an empty result; further columns are
ignored. Of licences with one canonical form the first name in order is reported.
"""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

# Public licence texts, short permissive ones in full.
LICENSES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
}
# Spellings that licence matching treats as equal.
EQUAL = (("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("organisation", "organization"), ("https", "http"))
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©)[^\n]*$"
OTHER = r"[^a-z0-9\x80-\x{10FFFF}]+"

# A line that states a copyright; words that follow "copyright" where a sentence was wrapped before it.
PROSE = r"notices?|laws?|licen[sc]es?|licensed|holders?|owners?|owned|statements?|interests?|rights?|or|and|in|to|is|are|if|line|also|the[^a-z0-9\n]*(?:above|software|library|program|$)|grant|treaty|treaties|permission|disclaimer|infringement|protection|status|doctrines|ownership|act|as|on|of|for|with|that|claims?"
STATEMENT = rf"(?m)^[^a-z0-9©\n]*(?:portions\x20)?(?:copyright[^a-z\n]*(?:\d{{4}}|\(c\)|©|yyyy|year)[^\n]*|copyright(?![a-z]|[^a-z0-9\n]*(?:(?:{PROSE})(?![a-z0-9])|$))[^\n]*|©[^\n]*|\(c\)[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*)?\d{{4}}[^\n]*)$"
# Fixed values, for texts with single spaces between words: what stands for a holder or a title, and spellings.
TITLE = r"^(?:(?:(?:the )?(?:(?:expat|x11|mit|isc|zlib|zlib libpng|0bsd|unlicense|bsd zero clause|zero clause bsd|(?:original |new |modified |revised |simplified )?bsd(?: [23])?(?: clause)?(?: (?:new|simplified|original|modified|revised))?|(?:2|3|two|three) clause bsd)(?: or)? )+license(?: (?:expat|x11|mit|isc|zlib|bsd|0bsd|bsd [23] clause))*) )+"
FOLDS = (
    (r"licence", "license"), (r"is(e|ed|es|ing|ation|ations)(?![a-z0-9])", "iz$1"), (r"(fav|lab|col|hon|behavi)our", "$1or"), (r"(acknowledg|judg)ement", "$1ment"), (r"(catal|anal)ogue", "$1og"),
    (r"(?<![a-z])(sub|non) (?=licens|infring|commercial)", "$1"), (r"per cent", "percent"), (r"https", "http"), (r"whilst", "while"), (r"centre", "center"), (r"copyright owner", "copyright holder"),
    (r"all rights reserved ?", ""), (r"neither the names? of .{1,200}? nor the names? of (?:its |their |any |other )?contributors", "neither the name of the holder nor the names of its contributors"),
    (r"this software is provided by .{1,200}? as is and any", "this software is provided by the holder as is and any"), (r"in no event (shall|will) (?:.{1,200}?) be (held )?liable", "in no event $1 the holder be $2liable"),
    (r"the software is provided as is and .{1,100}? disclaims all", "the software is provided as is and the holder disclaims all"), (r"copy modify and distribute", "copy modify and or distribute"), (TITLE, ""),
)


def canonical(text: Column) -> Column:
    c = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), COPYRIGHT, " ")
    for a, b in EQUAL:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, OTHER, " "))


def loose(text: Column) -> Column:
    """The second form: the same for every wrapping, title and holder of a licence."""
    c = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, STATEMENT, " "), r"[^a-z0-9\x80-\x{10FFFF}]+|[\x{2010}-\x{201F}\x{2022}\x{A0}\x{FEFF}]+", " "))
    c = F.regexp_replace(c, r" {2,}", " ")
    for a, b in FOLDS:
        c = F.regexp_replace(c, a, b)
    return F.trim(c)


@cache
def texts() -> tuple[tuple[str, str], ...]:
    """(licence, text) of all known ones; of those with an appendix also without it, of numbered lists also without numbers."""
    found = sorted((*LICENSES.items(), *((p.name.removesuffix(".txt"), p.read_text("utf-8")) for p in (Path(__file__).parent / "licenses").glob("*.txt"))))
    out = []
    for name, body in found:
        out.append((name, body))
        if name.startswith("BSD"):
            out.append((name, re.sub(r"(?m)^\d\. ", "", body)))
        end = re.search(r"END OF TERMS AND CONDITIONS", body)
        if end:
            out += [(name, body[: end.start()]), (name, body[: end.end()])]
    return tuple(out)


def scan(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """One row a document: doc_id, digest (of the canonical text, null where that is empty), license."""
    spark = docs.sparkSession
    table = spark.createDataFrame(sorted((known or LICENSES).items()), "license string, body string")
    table = table.select("license", F.sha2(canonical(F.col("body")), 256).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))
    wide = spark.createDataFrame(sorted(known.items()) if known else list(texts()), "wide_license string, body string")
    wide = wide.select("wide_license", F.sha2(loose(F.col("body")), 256).alias("wide")).groupBy("wide").agg(F.min("wide_license").alias("wide_license"))
    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), canonical(F.col("text")).alias("form"), F.sha2(loose(F.col("text")), 256).alias("wide"))
    source = source.select("doc_id", F.when(F.col("form") != "", F.sha2("form", 256)).alias("digest"), "wide")
    found = source.join(F.broadcast(table), "digest", "left").join(F.broadcast(wide), "wide", "left")
    return found.select("doc_id", "digest", F.coalesce("license", "wide_license").alias("license"))


def sql(known: dict[str, str] | None = None) -> str:
    """The same result as DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        c = f"regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {q(COPYRIGHT)}, ' ', 'g')"
        for a, b in EQUAL:
            c = f"replace({c}, {q(a)}, {q(b)})"
        return f"trim(regexp_replace({c}, {q(OTHER)}, ' ', 'g'))"

    rows = ", ".join(f"({q(n)}, {q(t)})" for n, t in sorted((known or LICENSES).items()))
    return f"""WITH known AS (SELECT min(license) AS license, sha256({form('body')}) AS digest FROM (VALUES {rows}) AS v(license, body) GROUP BY 2),
forms AS (SELECT doc_id, {form('text')} AS form FROM documents),
digests AS (SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM forms)
SELECT doc_id, d.digest, license FROM digests d LEFT JOIN known k ON d.digest = k.digest"""
