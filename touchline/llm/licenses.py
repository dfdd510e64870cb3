"""Licence texts by digests of a canonical form (operator 5). DataFrame operations only.

canonical() lowers case, drops copyright lines, makes every run of other characters than letters and digits one blank, and writes words that
count as equal in one way. The digest of a whole text is looked up by a hash join among the digests of known licences; so are those of its
lines that speak of a licence, since a notice is often one line of a document.

A null text counts as empty; an empty canonical form matches nothing. Every row gives one row, repeated rows too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# The wording of public licences and of their usual notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: (licence, text); several texts may stand for one licence.
KNOWN = (
    ("MIT", MIT),
    ("MIT", "The MIT License\n" + MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", ZERO_BSD),
    ("BSD-2-Clause", BSD_HEAD + BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_HEAD + BSD_END),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", BSD_HEAD + BSD_NAMES + BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_HEAD + BSD_NAMES + BSD_END),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n" + ZLIB),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
)

#: Spellings that count as the second one; in canonical text, whole words or parts of them, one after the other.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("acknowledgement", "acknowledgment"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("whilst", "while"),
    ("favour", "favor"),
    ("programme", "program"),
    ("copyright owner", "copyright holder"),
    ("merchantibility", "merchantability"),
    ("https", "http"),
)
#: A line that names holders: from its start, "copyright", "(c)" or the sign before a year or a name, or "all rights reserved".
COPYRIGHT_LINE = r"(^|\n)[ \t*#/]*(portions )?(copyright[ \t]*(\(c\)|©|[0-9])|\(c\)|©|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    out = F.translate(text, UPPER, UPPER.lower())
    out = F.regexp_replace(out, COPYRIGHT_LINE, "\n")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(one))
    return out


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """l_digest, l_license: a constant table, each digest once."""
    texts = F.array(*(F.struct(F.lit(i).alias("license"), F.lit(t).alias("text")) for i, t in KNOWN))
    return spark.range(1).select(F.inline(texts)).select(digest(F.col("text")).alias("l_digest"), F.col("license").alias("l_license")).distinct()


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, digest, license_id (of the whole text, or null), notice_ids (of lines, in order, comma-joined), n_notices (lines)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # a notice names a licence in one of two spellings, whatever its case
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, UPPER, UPPER.lower()).rlike("licen[cs]e"))
    units = F.concat(F.array(F.struct(F.lit(True).alias("l_whole"), digest(text).alias("l_digest"))), F.transform(lines, lambda x: F.struct(F.lit(False).alias("l_whole"), digest(x).alias("l_digest"))))
    rows = docs.select("doc_id", units.alias("l_units")).withColumn("l_row", F.monotonically_increasing_id())
    looked = rows.select("l_row", "doc_id", F.inline("l_units")).join(F.broadcast(known_digests(docs.sparkSession)), "l_digest", "left")
    notice = ~F.col("l_whole") & F.col("l_license").isNotNull()
    found = looked.groupBy("l_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(F.when(F.col("l_whole"), F.col("l_digest"))).alias("digest"),
        F.max(F.when(F.col("l_whole"), F.col("l_license"))).alias("license_id"),
        F.array_join(F.sort_array(F.collect_set(F.when(notice, F.col("l_license")))), ",").alias("notice_ids"),
        F.count(F.when(notice, 1)).alias("n_notices"),
    )
    return found.drop("l_row")


def _sql_canonical(text: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"trim(regexp_replace(regexp_replace(translate({text}, '{UPPER}', '{UPPER.lower()}'), {quoted(COPYRIGHT_LINE)}, chr(10), 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for spelling, one in SPELLINGS:
        out = f"replace({out}, {quoted(spelling)}, {quoted(one)})"
    return out


def sql() -> str:
    values = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in KNOWN)
    return f"""
with known as (select distinct sha256({_sql_canonical("t")}) as d, i from (values {values}) k(i, t)),
docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
whole as (select r, doc_id, sha256({_sql_canonical("text")}) as digest from docs),
lines as (select r, unnest(string_split(text, chr(10))) as x from docs),
notices as (select r, i from (select r, sha256({_sql_canonical("x")}) as d from lines
  where regexp_matches(translate(x, '{UPPER}', '{UPPER.lower()}'), 'licen[cs]e')) join known using (d)),
counted as (select r, count(*) as n_notices, string_agg(distinct i, ',' order by i) as notice_ids from notices group by r)
select doc_id, digest, i as license_id, coalesce(notice_ids, '') as notice_ids, coalesce(n_notices, 0) as n_notices
from whole left join known on known.d = digest left join counted using (r)
"""
