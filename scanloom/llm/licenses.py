"""Licence scans by canonical digests, in DataFrame functions only.

A unit is a whole document without its copyright lines, or one of its lines. A unit is normalised (case,
punctuation, white space, equivalent spellings) and its digest is hash-joined with the digests of known
licence texts and notices, whose number is fixed, so that they may be broadcast. Units that hold none of the
ANCHORS, of which every known text holds one, are passed over unnormalised, and those whose normalised length is no
known text's unhashed; neither loses anything.

Whole licences are those of license_texts, besides the MIT and ISC texts of KNOWN: as wrapped there or with a line for each
paragraph, and without what follows the end of the terms. The query's SQL holds KNOWN as text and the others by their digests.

Null and empty texts hold no unit. Long texts are scanned whole, line by line and as one unit. Repeated rows of an id add up. Rows without an id are reported under null. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Spellings that count as equal (from, to), applied in this order to text of words with a space on each side; fixed values.
SPELLINGS = [
    (" licence ", " license "), (" licences ", " licenses "), (" licenced ", " licensed "), (" sub license ", " sublicense "),
    (" non commercial ", " noncommercial "), (" copyright owner ", " copyright holder "), (" per cent ", " percent "),
    (" ver ", " version "), (" v2 ", " version 2 "), (" v3 ", " version 3 "), (" v4 ", " version 4 "),
]

#: Known notices and texts (licence, text); fixed values.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]

#: Whole licences, a file each, named by licence and, after two underscores, by form.
TEXTS = Path(__file__).parent / "license_texts"
END = "END OF TERMS AND CONDITIONS"

#: Characters that are neither letters nor digits, typographic quotes, dashes and blanks among them.
MARKS = r"[^\p{L}\p{N}]+"
#: Parts of words, untouched by SPELLINGS, that show a unit worth a closer look.
ANCHORS = ("licen", "warrant", "permission", "redistribution")
COPYRIGHT = r"(?i)^\s*(copyright\b|\(c\)|©|all rights reserved)"


def normalised(text: Column) -> Column:
    """Words in lower case, one space apart and around."""
    out = F.concat(F.lit(" "), F.trim(F.lower(F.regexp_replace(text, MARKS, " "))), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def without_copyright(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(COPYRIGHT)), "\n")


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) of TEXTS, in the forms that a document may have."""
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        for form in (text, text[: text.index(END) + len(END)], text[: text.index(END)]) if END in text else (text,):
            flowing = "\n\n".join(" ".join(x.split()) for x in re.split(r"\n\s*\n", form))
            out += [(path.stem.split("__")[0], x) for x in (form, flowing)]
    return out


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """license_id, digest, chars, shown (whether an anchor is in it)."""
    rows = spark.createDataFrame(known, "license_id string, text string").withColumn("n", normalised(without_copyright(F.col("text"))))
    return rows.select("license_id", F.sha2("n", 256).alias("digest"), F.length("n").alias("chars"), F.col("n").rlike("|".join(ANCHORS)).alias("shown")).distinct()


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license_id, n_lines (lines that are a known text), whole (the document is one). Documents without any are left out. known: KNOWN and whole_texts() if None."""
    digests = known_digests(docs.sparkSession, KNOWN + whole_texts() if known is None else known)
    lengths = [r[0] for r in digests.select("chars").distinct().collect()]
    text, pattern = F.col("text"), "(?i)" + "|".join(ANCHORS)
    shown = (lambda x: x.rlike(pattern)) if not digests.where(~F.col("shown")).limit(1).count() else (lambda x: F.lit(True))
    units = F.concat(
        F.transform(F.filter(F.split(text, "\n"), shown), lambda x: F.struct(x.alias("unit"), F.lit(False).alias("whole"))),
        F.array(F.struct(without_copyright(text).alias("unit"), F.lit(True).alias("whole"))),
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").where(shown(text))
    rows = rows.select("doc_id", F.explode(units).alias("u")).where(F.length("u.unit") >= 1)
    rows = rows.select("doc_id", "u.whole", normalised(F.col("u.unit")).alias("n")).where(F.length("n").isin(lengths))
    # the known texts are a fixed list, far below any broadcast limit
    hits = rows.select("doc_id", "whole", F.sha2("n", 256).alias("digest")).join(F.broadcast(digests.select("license_id", "digest")), "digest")
    return hits.groupBy("doc_id", "license_id").agg(F.count_if(~F.col("whole")).alias("n_lines"), F.bool_or("whole").alias("whole"))


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def norm(x: str) -> str:
        out = f"' ' || trim(lower(regexp_replace({x}, '{MARKS}', ' ', 'g'))) || ' '"
        for a, b in SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return out

    def kept(x: str) -> str:
        return f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: not regexp_matches(l, '{COPYRIGHT}')), chr(10))"

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def digest(text: str) -> str:
        lines = [x for x in text.split("\n") if not re.search(COPYRIGHT, x)]
        out = f" {regex.sub(MARKS, ' ', chr(10).join(lines)).lower().strip()} "
        for a, b in SPELLINGS:
            out = out.replace(a, b)
        return hashlib.sha256(out.encode()).hexdigest()

    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in KNOWN)
    whole = ", ".join(f"({quoted(a)}, '{d}')" for a, d in sorted({(a, digest(b)) for a, b in whole_texts()}))
    return f"""
with known as (
  select license_id, sha256({norm(kept("text"))}) as digest from (values {values}) v(license_id, text)
  union select * from (values {whole}) w(license_id, digest)),
units as (
  select doc_id, false as whole, unnest(string_split(text, chr(10))) as unit from documents where text is not null
  union all
  select doc_id, true, {kept("text")} from documents where text is not null),
hits as (select doc_id, whole, license_id from units join known on sha256({norm("unit")}) = digest where length(unit) >= 1)
select doc_id, license_id, count(*) filter (not whole) as n_lines, bool_or(whole) as whole
from hits group by doc_id, license_id
"""


OP8_SQL = _sql()
