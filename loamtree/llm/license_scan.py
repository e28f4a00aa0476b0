"""Licences by canonical digests, in DataFrame operations only."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .license_digests import FULL

#: Spellings that count as one, applied in this order to words with one space or line end between them. A space in them is any such gap.
SPELLINGS = [
    ("licence", "license"), ("https", "http"), ("copyright holder", "copyright owner"), ("centre", "center"), ("organisation", "organization"),
    ("favour", "favor"), ("fulfil ", "fulfill "), ("non commercial", "noncommercial"), ("sub license", "sublicense"), ("merchantibility", "merchantability"),
]

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

#: Whole texts of short licences, then notices that stand for a licence when they fill a line or a document.
KNOWN = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AS_IS),
    ("BSD-2-Clause", _BSD_2 + " " + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + " " + _BSD_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>'),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "MPL-2.0", "Unlicense", "BSL-1.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "AGPL-3.0-or-later")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

#: Lines that only state who holds the copyright; lines that begin with the word as part of a sentence, which a mark keeps from being taken for such; and what separates words within a line.
COPYRIGHT = r"^[\t #*/;-]*(?:copyright|\(c\)|©)[^\n]*$"
SENTENCE = r"^([\t #*/;-]*)(copyrights?[ \t]+(?:notices?|holders?|owners?|laws?|licen[cs]es?|licen[cs]ed|statements?|disclaimers?|interests?|protection|status|treat(?:y|ies)|permissions?|and|or|in|is|are|on|to|of|for|the|this|that|as|by|with)\b)"
BETWEEN = r"[^\p{L}\p{N}\n]+"


def _gap(old: str, new: str, group: str) -> tuple[str, str]:
    """A spelling with a space as a pattern and its replacement, which keeps the gap."""
    return old.replace(" ", "([ \n]+)"), new.replace(" ", group)


def canonical(text):
    """Lower case, no copyright lines, each run of other characters one space, and one spelling; line ends stay. Only \\n ends a line."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?md)" + SENTENCE, "$1\x01$2")
    text = F.regexp_replace(F.regexp_replace(text, "(?md)" + COPYRIGHT, ""), BETWEEN, " ")
    for old, new in SPELLINGS:
        text = F.regexp_replace(text, *_gap(old, new, "$1")) if " " in old else F.replace(text, F.lit(old), F.lit(new))
    return text


def joined(text):
    """A canonical text as one line."""
    return F.trim(F.regexp_replace(text, "[ \n]+", " "))


#: In canonical texts: lines that only name a short licence or reserve rights, and places where a licence names its owner.
TITLES = r"^ *(?:all rights reserved|(?:the )?(?:mit|isc|zlib|0bsd|unlicense|boost software license version 1 0(?: august 17th 2003)?|(?:(?:new|modified|simplified|revised|zero clause|[023] clause) )?bsd(?: (?:zero|[023]) clause)?)(?: license)?(?: (?:mit|isc|zlib|0bsd))?) *$"
OWNERS = [
    ("neither the names? of .{1,120}? nor the names of (?:its|their) contributors", "neither the name of the copyright owner nor the names of its contributors"),
    ("this software is provided by .{1,120}? as is and any express", "this software is provided by the copyright owners and contributors as is and any express"),
    ("in no event shall .{1,120}? be liable for any direct indirect", "in no event shall the copyright owner or contributors be liable for any direct indirect"),
]

#: Neighbouring paragraphs that are tried as one text; the longest short licence, Zlib, has six.
PARAGRAPHS = 8


def bare(text):
    """A canonical text as one line, without title and rights lines and with one wording for its owner."""
    text = joined(F.regexp_replace(text, "(?md)" + TITLES, ""))
    for old, new in OWNERS:
        text = F.regexp_replace(text, old, new)
    return text


def paragraphs(text, lengths):
    """Runs of up to PARAGRAPHS neighbouring paragraphs of a canonical text, each as one line, of one of the lengths. A run that is a single line is not among them."""
    parts = F.filter(F.split(text, "\n(?: *\n)+"), lambda x: joined(x) != "")
    run = lambda i, k: F.trim(F.array_join(F.slice(parts, i + 1, k), "\n"), F.lit(" \n"))
    runs = lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(PARAGRAPHS), F.size(parts) - i)), lambda k: run(i, k))
    wrapped = F.filter(F.flatten(F.transform(parts, runs)), lambda x: F.contains(x, F.lit("\n")))
    return F.filter(F.transform(wrapped, joined), lambda x: F.array_contains(lengths, F.length(x)))


def bare_digests(spark: SparkSession, known=None) -> DataFrame:
    """bare_digest, license of each known text and of the full licences in FULL; of equal texts the first name in order."""
    rows = spark.createDataFrame(known or KNOWN, "license string, text string").select(F.sha2(bare(canonical(F.col("text"))), 256).alias("bare_digest"), "license")
    if known is None:
        rows = rows.unionByName(spark.createDataFrame(FULL, "license string, bare_digest string"))
    return rows.groupBy("bare_digest").agg(F.min("license").alias("license"))


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """digest, license, chars of each known text, canonicalised like any document; of equal texts the first name in order."""
    rows = spark.createDataFrame(known or KNOWN, "license string, text string").withColumn("line", joined(canonical(F.col("text"))))
    return rows.groupBy(F.sha2("line", 256).alias("digest")).agg(F.min("license").alias("license"), F.max(F.length("line")).alias("chars"))


def license_scan(docs: DataFrame, known=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, canonical_sha256, license, notices, n_notices.

    license: the known licence that the whole document is, whatever title and
    rights lines it has and whatever owner it names, or null. notices: the
    licences, sorted and joined by commas, whose canonical text a whole line of
    the document is, or a run of its paragraphs; n_notices counts these.

    The known digests are a table as long as the parameter `known`, whatever
    the corpus, and so are broadcast. A line is hashed only if a known text has
    its length. Null and empty texts match nothing; repeated rows give a row
    each; no rows give no rows; other columns are ignored.
    """
    table = F.broadcast(known_digests(docs.sparkSession, known))
    lengths = F.array(*[F.lit(n) for n in sorted({r.chars for r in known_digests(docs.sparkSession, known).collect()})])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("text"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.array_contains(lengths, F.length(x)))
    hashes = F.sha2(joined(F.col("text")), 256).alias("canonical_sha256"), F.sha2(bare(F.col("text")), 256).alias("bare_digest")
    rows = rows.select("row", "doc_id", *hashes, F.explode_outer(F.concat(lines, paragraphs(F.col("text"), lengths))).alias("line"))
    rows = rows.withColumn("digest", F.sha2("line", 256)).join(table.select("digest", F.col("license").alias("notice")), "digest", "left")
    per_doc = rows.groupBy("row", "doc_id", "canonical_sha256", "bare_digest").agg(
        F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"), F.count("notice").alias("n_notices")
    )
    whole = F.broadcast(bare_digests(docs.sparkSession, known))
    return per_doc.join(whole, "bare_digest", "left").select("doc_id", "canonical_sha256", "license", "notices", "n_notices")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_canonical(text: str) -> str:
    marked = f"regexp_replace(lower(coalesce({text}, '')), '(?m){SENTENCE}', '{chr(92)}1' || chr(1) || '{chr(92)}2', 'g')"
    out = f"regexp_replace(regexp_replace({marked}, '(?m){COPYRIGHT}', '', 'g'), '{BETWEEN}', ' ', 'g')"
    for old, new in SPELLINGS:
        pattern, kept = _gap(old, new, chr(92) + "1")
        out = f"regexp_replace({out}, '{pattern}', '{kept}', 'g')" if " " in old else f"replace({out}, '{old}', '{new}')"
    return out


def _sql_joined(text: str) -> str:
    return f"trim(regexp_replace({text}, '[ \\n]+', ' ', 'g'))"


def _sql_bare(text: str) -> str:
    out = _sql_joined(f"regexp_replace({text}, '(?m){TITLES}', '', 'g')")
    for old, new in OWNERS:
        out = f"regexp_replace({out}, '{old}', '{new}', 'g')"
    return out


_VALUES = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
_FULL = ", ".join(f"('{name}', '{digest}')" for name, digest in FULL)
OP9_SQL = f"""
WITH given(license, text) AS (VALUES {_VALUES}),
canon AS (SELECT license, {_sql_canonical('text')} AS t FROM given),
known AS (SELECT line, sha256(line) AS digest, min(license) AS license FROM (SELECT license, {_sql_joined('t')} AS line FROM canon) GROUP BY 1),
bare AS (SELECT bare_digest, min(license) AS license FROM (SELECT license, sha256({_sql_bare('t')}) AS bare_digest FROM canon UNION ALL SELECT * FROM (VALUES {_FULL})) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS n, doc_id, {_sql_canonical('text')} AS t FROM documents),
parts AS (SELECT n, list_filter(regexp_split_to_array(t, '\\n(?: *\\n)+'), lambda x: {_sql_joined('x')} <> '') AS p FROM docs),
spans AS (SELECT n, p, i, unnest(range(1, least({PARAGRAPHS}, len(p) - i) + 1)) AS k FROM (SELECT n, p, unnest(range(len(p))) AS i FROM parts)),
lines AS (
  SELECT n, trim(unnest(string_split(t, chr(10)))) AS line FROM docs
  UNION ALL SELECT n, {_sql_joined('run')} FROM (SELECT n, trim(array_to_string(p[i + 1:i + k], chr(10)), ' ' || chr(10)) AS run FROM spans) WHERE contains(run, chr(10))),
found AS (SELECT n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices FROM lines JOIN known USING (line) GROUP BY n),
whole AS (SELECT n, doc_id, sha256({_sql_joined('t')}) AS canonical_sha256, sha256({_sql_bare('t')}) AS bare_digest FROM docs)
SELECT doc_id, canonical_sha256, license, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM whole LEFT JOIN bare USING (bare_digest) LEFT JOIN found USING (n)
"""
