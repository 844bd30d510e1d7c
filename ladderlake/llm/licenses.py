"""License scans by canonical digests, by DataFrame functions alone.

A text is brought to a canonical form, without case, punctuation, copyright lines and differences
of spelling, and its digest is joined to those of known licences. Whole documents, their single lines
and runs of their paragraphs are looked up as entire texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import c

#: Permissive licences as published, and usual notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def _gnu(name: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""


KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC), ("ISC", "Licensed under the ISC License."),
    ("BSD-2-Clause", _BSD2 + _BSD), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD2 + _BSD),
    ("BSD-3-Clause", _BSD2 + _BSD3 + _BSD), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD2 + _BSD3 + _BSD), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("proprietary", "All rights reserved."),
    ("Zlib", _ZLIB), ("Unlicense", _UNLICENSE), ("MIT-0", _MIT.split("\n")[0].replace(", subject to the following conditions:", ".") + "\n\n" + _MIT.split("\n\n")[-1]),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies.", ".")), ("Apache-2.0", _APACHE), ("MPL-2.0", _MPL),
    ("GPL-3.0-or-later", _gnu("GNU General Public License", "3")), ("GPL-2.0-or-later", _gnu("GNU General Public License", "2")), ("LGPL-3.0-or-later", _gnu("GNU Lesser General Public License", "3")), ("AGPL-3.0-or-later", _gnu("GNU Affero General Public License", "3")),
]
#: Names whose SPDX tags are known besides those of KNOWN, which the SQL reads.
SPDX = ["0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "PSF-2.0", "Python-2.0", "Unlicense", "WTFPL", "Zlib", "ZPL-2.1"]
TAGS = [(name, f"SPDX-License-Identifier: {name}") for name in SPDX]
#: Spellings that count as one, applied to words in lower case.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("whilst", "while"), ("favour", "favor"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("https", "http"), ("v 2 0", "version 2 0")]
#: A copyright line, behind comment marks or not: the word, or a sign for it, and then a sign, a year, a holder in brackets or, in lower case alone, a name.
_COPYRIGHT = r"(?m)^[ \t#*/;%-]*(((copyright|Copyright|COPYRIGHT|\([cC]\)|©)[ \t]*(\([cC]\)|©|[0-9]|<|\[|by ))|((copyright|Copyright)[ \t]+[A-Z]))[^\n]*$"
_PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ“”‘’–—", "abcdefghijklmnopqrstuvwxyz      "
#: Digests of the canonical forms of whole licences that are too long to stand here; tests work them out anew where the texts are at hand.
DIGESTS = {
    "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6": "Apache-2.0",
    "de5e8896b763918701eb91e7bf8bf81f20a97c9f8dd1cacc44519e47d3462bf8": "Artistic-1.0-Perl",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60": "GFDL-1.2",
    "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826": "GFDL-1.3",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b": "MPL-1.1",
    "9672a697b80e59f5b1b0201e64d65dee8762b193cdd934dc5bcf2b57350a2ead": "MPL-2.0",
}


def folded(text: Column) -> Column:
    """Lower case, no copyright lines, words with one space between them, line breaks kept; null of null."""
    x = F.translate(F.regexp_replace(text, _COPYRIGHT, " "), _UPPER, _LOWER)
    return F.regexp_replace(F.regexp_replace(x, _PUNCTUATION, " "), " +", " ")


def _spelt(x: Column) -> Column:
    """One spelling for all, of folded text without line breaks."""
    x = F.concat(F.lit(" "), F.trim(x), F.lit(" "))
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(x)


def _joined(x: Column) -> Column:
    """Folded text on one line."""
    return _spelt(F.regexp_replace(F.translate(x, "\n", " "), " +", " "))


def canonical(text: Column) -> Column:
    """A whole text in canonical form; null of null."""
    return _joined(folded(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def _paragraphs(x: Column) -> Column:
    """Of folded text, what stands between blank lines."""
    return F.filter(F.split(x, r"\n[ ]*\n"), lambda p: F.trim(F.translate(p, "\n", " ")) != "")


def known(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN + TAGS, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """(kind, digest, license, of, place, n) of known licences.

    kind 0: a whole text, once, with the least name. kind 2: the paragraph number place of n of
    the text whose digest is of, for texts of several paragraphs.
    """
    rows = spark.createDataFrame(texts, "license string, text string").withColumn("folded", folded(F.col("text")))
    rows = rows.select("license", F.sha2(_joined(F.col("folded")), 256).alias("of"), F.transform(_paragraphs(F.col("folded")), lambda p: F.sha2(_joined(p), 256)).alias("parts"))
    long = spark.createDataFrame([(n, d, []) for d, n in digests.items()], "license string, of string, parts array<string>")
    rows = rows.unionByName(long).groupBy("of").agg(F.min("license").alias("license"), F.min_by("parts", "license").alias("parts"))
    whole = rows.select(F.lit(0).alias("kind"), F.col("of").alias("digest"), "license", "of", F.lit(0).alias("place"), F.lit(1).alias("n"))
    parts = rows.filter(F.size("parts") > 1).select("license", "of", F.size("parts").alias("n"), F.posexplode("parts").alias("place", "digest"))
    return whole.unionByName(parts.withColumn("kind", F.lit(2)))


def scan(docs: DataFrame, licenses: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, license, line_licenses, block_licenses) of each row of docs.

    license is that of the whole text, or null. line_licenses names those of its single lines,
    block_licenses those whose paragraphs all stand in it one after another, each in order, with
    commas. A null text has null, null and nothing; an empty one the digest of nothing, which no
    licence has. Repeated rows get a row each, other columns are left aside.

    Each text is brought to canonical form once. Its digests meet the known ones in a hash join, and
    only what is found, and one row for each text, is grouped. licenses is joined by whatever way its size allows.
    """
    rows = docs.select(c(key).alias("key"), F.xxhash64(c(text)).alias("mark"), folded(c(text)).alias("folded"))
    one = lambda kind, place, d: F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("place"), d.alias("digest"))
    sha = lambda x: F.sha2(x, 256)
    lines = F.transform(F.filter(F.array_distinct(F.split("folded", "\n")), lambda x: F.trim(x) != ""), lambda x: one(1, F.lit(0), sha(_spelt(x))))
    parts = F.transform(_paragraphs(F.col("folded")), lambda x, i: one(2, i, sha(_joined(x))))
    several = F.when(F.col("folded").rlike(r"\n[ ]*\n"), parts).otherwise(F.array().cast("array<struct<kind:int,place:int,digest:string>>"))
    units = F.concat(F.array(one(0, F.lit(0), sha(_joined(F.col("folded"))))), F.coalesce(lines, F.array().cast("array<struct<kind:int,place:int,digest:string>>")), F.coalesce(several, F.array().cast("array<struct<kind:int,place:int,digest:string>>")))
    found = rows.select("key", "mark", F.explode(units).alias("u")).select("key", "mark", "u.kind", F.col("u.place").alias("at"), "u.digest")
    names = licenses.select(F.col("kind").alias("l_kind"), F.col("digest").alias("l_digest"), "license", "of", "place", "n")
    met = found.join(names, F.expr("digest = l_digest AND l_kind = IF(kind = 2, 2, 0)"), "left").filter("kind = 0 OR license IS NOT NULL")
    named = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    # a block: all n paragraphs at one distance from its start
    starts = met.groupBy("key", "mark", "kind", "of", F.when(F.col("kind") == 2, F.col("at") - F.col("place")).alias("start")).agg(F.countDistinct("place").alias("seen"), F.first("n").alias("n"), F.first("license").alias("license"), F.max(F.when(F.col("kind") == 0, F.col("digest"))).alias("digest"), F.count(F.when(F.col("kind") == 0, 1)).alias("copies"))
    out = starts.filter("kind < 2 OR seen = n").groupBy("key", "mark").agg(F.max("digest").alias("digest"), F.max(F.when(F.col("kind") == 0, F.col("license"))).alias("license"), named(F.when(F.col("kind") == 1, F.col("license"))).alias("line_licenses"), named(F.when(F.col("kind") == 2, F.col("license"))).alias("block_licenses"), F.sum("copies").alias("copies"))
    return out.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(F.col("key").alias(key), "digest", "license", "line_licenses", "block_licenses")


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents, of their lines and of their blocks of paragraphs."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known(spark))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _folded_sql(x: str) -> str:
    x = f"translate(regexp_replace({x}, {_quoted(_COPYRIGHT)}, ' ', 'g'), {_quoted(_UPPER)}, {_quoted(_LOWER)})"
    return f"regexp_replace(regexp_replace({x}, {_quoted(_PUNCTUATION)}, ' ', 'g'), ' +', ' ', 'g')"


def _spelt_sql(x: str) -> str:
    out = f"' ' || trim({x}) || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"sha256(trim({out}))"


def _joined_sql(x: str) -> str:
    return _spelt_sql(f"regexp_replace(replace({x}, chr(10), ' '), ' +', ' ', 'g')")


_PARTS = "list_filter(string_split_regex(f, '\\n[ ]*\\n'), lambda p: trim(replace(p, chr(10), ' ')) <> '')"
OP3_SQL = f"""
WITH texts AS (
  SELECT l, {_folded_sql('t')} AS f FROM (VALUES {', '.join(f'({_quoted(n)}, {_quoted(t)})' for n, t in KNOWN + TAGS)}) AS k(l, t)
), named AS (
  SELECT digest, min(license) AS license, arg_min(f, license) AS f
  FROM (SELECT {_joined_sql('f')} AS digest, l AS license, f FROM texts UNION ALL SELECT d, l, NULL FROM (VALUES {', '.join(f'({_quoted(d)}, {_quoted(n)})' for d, n in DIGESTS.items())}) AS k(d, l)) GROUP BY 1
), parts AS (
  SELECT digest AS owner, license, unnest(parts) AS part, unnest(range(len(parts))) AS place, len(parts) AS n FROM (SELECT *, {_PARTS} AS parts FROM named) WHERE len(parts) > 1
), known_parts AS (SELECT *, {_joined_sql('part')} AS digest FROM parts),
docs AS (SELECT doc_id, text, {_folded_sql('text')} AS f FROM documents),
lines AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses
  FROM (SELECT doc_id, {_spelt_sql('line')} AS digest FROM (SELECT DISTINCT doc_id, unnest(string_split(f, chr(10))) AS line FROM docs) WHERE trim(line) <> '') JOIN named USING (digest) GROUP BY 1
), doc_parts AS (
  SELECT doc_id, pos, {_joined_sql('part')} AS digest FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS pos FROM (SELECT doc_id, {_PARTS} AS parts FROM docs WHERE regexp_matches(f, '\\n[ ]*\\n')))
), blocks AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS block_licenses FROM (
    SELECT doc_id, owner, license, pos - place AS start FROM doc_parts JOIN known_parts USING (digest) GROUP BY ALL HAVING count(DISTINCT place) = any_value(n)) GROUP BY 1
)
SELECT d.doc_id, d.digest, license, coalesce(line_licenses, '') AS line_licenses, coalesce(block_licenses, '') AS block_licenses
FROM (SELECT doc_id, {_joined_sql('f')} AS digest FROM docs) d LEFT JOIN named USING (digest) LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN blocks ON blocks.doc_id = d.doc_id
"""
