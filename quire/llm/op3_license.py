"""Licence scans by canonical digest.

A text is brought to a canonical form: copyright notices dropped, lower-cased, titles of known licences and "all rights reserved"
dropped, punctuation (typographic too) and white space folded to single spaces, and spellings that licence readers hold
equivalent folded to one. A copyright notice is a line that begins with the sign, or with the word and goes on with a year, a sign, a
placeholder in brackets or a name; lines of a licence's body that happen to begin with the word stay. The digest of the whole
canonical text is looked up among the digests of known licence texts by a hash join. The same lookup is applied to each line
of a document as a text of its own, which finds licence notices inside documents; a line's digest is made only if its
canonical form is as long as that of a known text, since no other can have its digest.

The known texts are a table (license, body) of any size that a broadcast can hold, by default ``KNOWN``. Nulls and empty texts
have no licence. Very long texts are read whole. Equal rows and ties give equal results and are kept. An empty table gives no rows. Columns
named like this operator's, in any case of letters, are replaced; others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import own_prefix, table

#: Spellings to treat as equal, whole words of the canonical form.
EQUIVALENT = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("noncommercially", "noncommercial"), ("whilst", "while"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("honour", "honor"), ("organisation", "organization"), ("programme", "program"), ("copyright owner", "copyright holder"), ("v3", "version 3"), ("v2", "version 2"), ("gpl", "general public license"), ("this software is", "this work is"),
)
#: Punctuation, white space and controls but for line feeds: of ASCII, typographic quotes, dashes and dots, and wide spaces.
IN_LINES = r"[\x00-\x09\x0B-\x20!-/:-@\[-`{-~\x{A0}\x{AB}\x{BB}\x{2000}-\x{200B}\x{2010}-\x{2015}\x{2018}-\x{201F}\x{2022}\x{2026}\x{2212}\x{3000}\x{FEFF}]+"
#: A line with a notice, before letters are lowered: capitals and small letters of a name tell it from a line in capitals.
COPYRIGHT = r"^[^A-Za-z0-9\n]*(?:(?i:copyright)[^A-Za-z0-9\n]*(?:\([cC]\)|©|[\[<{]|(?:19|20)[0-9][0-9]|(?i:by) )|Copyright +(?:The +)?[A-Z][a-z.]|\([cC]\)|©)[^\n]*$"
#: Titles that stand above known texts, in canonical form.
TITLES = (
    "(the )?mit license( mit)?", "(the )?isc license( isc)?", "(the )?bsd 2 clause (simplified )?license", "(the )?2 clause bsd license", "simplified bsd license", "(the )?bsd 3 clause (new or revised )?license", "(the )?3 clause bsd license", "new bsd license",
    "(bsd zero clause|zero clause bsd) license", "boost software license (version )?1 0( august 17th 2003)?", "(the )?zlib license", "(the )?unlicense",
)
TITLE_LINE = "^ *(?:" + "|".join(t.replace(" ", " +") for t in TITLES) + ") *$"
_BSD = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Known licence texts and notices, without their copyright lines.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n" + _BSD),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO."),
)


def _equal_spellings(form: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Words stand between two spaces, so that neighbours have one each."""
    for said, meant in pairs:
        form = F.replace(form, F.lit(f" {said.replace(' ', '  ')} "), F.lit(f" {meant.replace(' ', '  ')} "))
    return form


def canonical_lines(text: Column) -> Column:
    """The canonical form with every line by itself: words between two spaces, lines between line feeds."""
    # the expressions for notices and titles run only where one of their words is
    marked = F.contains(F.lower(text), F.lit("copyright")) | F.contains(F.lower(text), F.lit("(c)")) | F.contains(text, F.lit("©"))
    lowered = F.lower(F.when(marked, F.regexp_replace(text, "(?md)" + COPYRIGHT, " ")).otherwise(text))
    spaced = F.replace(F.regexp_replace(lowered, IN_LINES, "  "), F.lit("\n"), F.lit("  \n  "))
    form = _equal_spellings(F.concat(F.lit("  "), spaced, F.lit("  ")), EQUIVALENT)
    form = F.replace(form, F.lit(" all  rights  reserved "), F.lit(" "))
    return F.when(F.contains(form, F.lit("license")), F.regexp_replace(form, "(?md)" + TITLE_LINE, "  ")).otherwise(form)


def _single(form: Column) -> Column:
    """Words between single spaces."""
    return F.trim(F.regexp_replace(form, " {2,}", " "))


def whole_form(lines: Column) -> Column:
    """The canonical form of the whole text: also across lines, spellings of several words are folded."""
    joined = F.regexp_replace(lines, "[ \n]+", "  ")
    return _single(_equal_spellings(joined, tuple(p for p in EQUIVALENT if " " in p[0])))


def digest(form: Column) -> Column:
    return F.when(form != "", F.sha2(form, 256))


def known_digests(known: DataFrame) -> DataFrame:
    """digest, license and size (of the canonical form) of known texts. known: license, body."""
    rows = known.select("license", whole_form(canonical_lines(F.col("body"))).alias("form"))
    return rows.where("form <> ''").groupBy(digest(F.col("form")).alias("digest")).agg(F.min("license").alias("license"), F.min(F.length("form")).alias("size"))


def scan_licenses(docs: DataFrame, text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """The rows with digest, license (of the whole text) and line_licenses (sorted, distinct, of whole lines)."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("digest", "license", "line_licenses")]
    known = known if known is not None else spark.createDataFrame(list(KNOWN), "license string, body string")
    table_of = known_digests(known)
    sizes = [r["size"] for r in table_of.select("size").distinct().orderBy("size").collect()]  # of the known texts
    mine = own_prefix(docs)
    rows = docs.withColumn(f"{mine}lines", canonical_lines(F.col(text)))
    whole = whole_form(F.col(f"{mine}lines"))
    candidates = F.filter(F.transform(F.split(f"{mine}lines", "\n", -1), _single), lambda x: F.length(x).isin(sizes))
    rows = rows.select(*[F.col(c) for c in kept], digest(whole).alias("digest"), F.array_distinct(F.transform(candidates, lambda x: F.sha2(x, 256))).alias(f"{mine}found"), F.monotonically_increasing_id().alias(f"{mine}row"))
    known_rows = F.broadcast(table_of.select(F.col("digest").alias(f"{mine}digest"), F.col("license").alias(f"{mine}license")))
    found = rows.join(known_rows, F.col("digest") == F.col(f"{mine}digest"), "left").withColumn("license", F.col(f"{mine}license")).drop(f"{mine}digest", f"{mine}license")
    # only rows with a line as long as a known text go on to the join by line
    units = found.select("*", F.explode_outer(f"{mine}found").alias(f"{mine}line"))
    units = units.join(known_rows, F.col(f"{mine}line") == F.col(f"{mine}digest"), "left")
    out = units.groupBy(f"{mine}row").agg(*[F.first(c).alias(c) for c in [*kept, "digest", "license"]], F.sort_array(F.collect_set(f"{mine}license")).alias("line_licenses"))
    return out.drop(f"{mine}row")


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_chars", F.length("text").cast("long")))
    return found.select("doc_id", "n_chars", "digest", "license", F.array_join("line_licenses", ",").alias("line_licenses"))


def _sql_lines(text: str) -> str:
    form = f"'  ' || replace(regexp_replace(lower(regexp_replace({text}, '(?m){COPYRIGHT}', ' ', 'g')), '{IN_LINES}', '  ', 'g'), chr(10), '  ' || chr(10) || '  ') || '  '"
    for said, meant in EQUIVALENT:
        form = f"replace({form}, ' {said.replace(' ', '  ')} ', ' {meant.replace(' ', '  ')} ')"
    return f"regexp_replace(replace({form}, ' all  rights  reserved ', ' '), '(?m){TITLE_LINE}', '  ', 'g')"


def _sql_whole(lines: str) -> str:
    form = f"regexp_replace({lines}, '[ \\n]+', '  ', 'g')"
    for said, meant in EQUIVALENT:
        if " " in said:
            form = f"replace({form}, ' {said.replace(' ', '  ')} ', ' {meant.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({form}, ' {{2,}}', ' ', 'g'), ' ')"


_VALUES = ", ".join("('{}', '{}')".format(name, body.replace("'", "''")) for name, body in KNOWN)
QUERIES = {"op3_license": op3_license}
SQL = {
    "op3_license": f"""
WITH k AS (SELECT sha256({_sql_whole("f")}) AS digest, min(license) AS license FROM (SELECT license, {_sql_lines("body")} AS f FROM (VALUES {_VALUES}) AS t(license, body)) GROUP BY 1),
d AS (SELECT doc_id, text, {_sql_lines("text")} AS lines FROM documents),
f AS (SELECT doc_id, text, {_sql_whole("lines")} AS form FROM d),
h AS (SELECT doc_id, text, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM f),
u AS (SELECT DISTINCT doc_id, trim(regexp_replace(line, ' {{2,}}', ' ', 'g'), ' ') AS form FROM (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line FROM d)),
l AS (SELECT u.doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS line_licenses FROM u JOIN k ON sha256(u.form) = k.digest WHERE u.form <> '' GROUP BY 1)
SELECT h.doc_id, length(h.text) AS n_chars, h.digest, k.license, coalesce(l.line_licenses, '') AS line_licenses
FROM h LEFT JOIN k ON h.digest = k.digest LEFT JOIN l ON h.doc_id = l.doc_id""",
}
