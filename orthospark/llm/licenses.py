"""Licence scan by canonical digests, in DataFrame operations alone.

A text is normalised (lower case; lines that are copyright notices dropped; equivalent spellings made one; all but letters and digits to
single spaces) and its SHA-256 is looked up in a table of known licences by a hash join.  Whole texts are looked up, and
in the same way each line on its own, so a document that only states its licence in a line is found too.

Short licences are kept as texts, long ones as digests of their canonical texts.  A table of known texts may be given
instead; its size is checked before it is broadcast, and a larger one is joined by a shuffle.  Only lines that match travel from the lines' join.

Defined cases: a null text has a null digest and no licence; texts without letters or digits share the digest of the
empty text, which is no licence; equal known texts count once, under their least name; repeated rows and rows with a null
id each get a row of their own; an empty table stays empty; other columns, whatever their names, are not read; a very
long text costs what its length does.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most known texts that are broadcast, a digest and a name each.
BROADCAST_ROWS = 10_000
# Equivalent spellings, and licence texts and statements by SPDX identifier.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("organisation", "organization"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("favour", "favor"),
    ("whilst", "while"), ("cancelled", "canceled"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("version 2.0", "version 2"), ("version 3.0", "version 3"), ("http://", "https://"),
]
#: Spellings of several words, as they are after normalisation.
ACROSS = [tuple(re.sub(r"[^a-z0-9]+", " ", x).strip() for x in pair) for pair in SPELLINGS if re.search(r"\w\W+\w", pair[0])]
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
KNOWN = [
    ("BSD-2-Clause", _BSD2 + _BSD), ("BSD-3-Clause", _BSD2 + _BSD3 + _BSD), ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD2 + _BSD), ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD2 + _BSD3 + _BSD), ("BSD-2-Clause", "All rights reserved.\n" + _BSD2 + _BSD), ("BSD-3-Clause", "All rights reserved.\n" + _BSD2 + _BSD3 + _BSD), ("Zlib", _ZLIB), ("Unlicense", _UNLICENSE),
    ("MIT", _MIT), ("MIT", "The MIT License\n" + _MIT), ("MIT", "MIT License\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]
# Digests of long licences' canonical texts, as canonical() makes them, by SPDX identifier and part: the
# whole text, or its terms alone; with the Free Software Foundation's address of before 2005, or its web address.
KNOWN_DIGESTS = [
    ("Apache-2.0", "whole", "6cc33dbbc1dad8866cf91611a3b0f9fbb649c9280dbff0ef6142b785c156c15f"),
    ("Apache-2.0", "terms", "44aa64dba73e6f6dff106d18bfe4994d01c435c8f5b5373685b9c41375af5bb2"),
    ("Artistic-1.0-Perl", "whole", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", "whole", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("CC0-1.0", "whole", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", "whole", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.2-only", "whole, old address", "4bec76f27f2bbbf8f4f9d121d330eb3657cb4297ef50f8ead8668e0f46ba1d78"),
    ("GFDL-1.2-only", "whole, web address", "bf49ff693f93d17e0148808337c41e7ef385693d88672a6380baf34e28ca3454"),
    ("GFDL-1.3-only", "whole", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0-only", "whole", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0-only", "terms", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0-only", "whole, old address", "a87d2335c7c408f93c15dd6892a723a61b2645ff1ad65619233239cce6bd570d"),
    ("GPL-1.0-only", "terms, old address", "ac9f80a0d38a1e001427acb1e9fa5f9a23aee35e40ee2759901306fd4e382697"),
    ("GPL-1.0-only", "terms, web address", "be47459d4de292dd05ccf79373129bc9009f77c758ff5cf61b6ac7aaf7a8e885"),
    ("GPL-2.0-only", "whole", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0-only", "terms", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0-only", "whole, old address", "58f387b55eb95a9c5a6ef16e9064e1bfa9420a69181c677ee6eddf6ed1397cfd"),
    ("GPL-2.0-only", "terms, old address", "b1abfb46077acd6c0450274e16fe4cb4610ec546c090c5977a069c5f74340774"),
    ("GPL-2.0-only", "terms, web address", "01fb54bbeecb4129fbe6ad8f9e17f75e0e6746efafca1b4fc03d2a5b9d8059ae"),
    ("GPL-3.0-only", "whole", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0-only", "terms", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0-only", "whole", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0-only", "terms", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0-only", "whole, old address", "084782a05c82d5e85c704f06bab601971e84b3b9b90a51c95ffcff2b342d9cf2"),
    ("LGPL-2.0-only", "terms, old address", "5ce88337a2fce97b0f2b6aac63afc49927c0dc31e15bf530a83e603e1d298d8b"),
    ("LGPL-2.0-only", "terms, web address", "d6ef0358155ba2bbfe03a0ad7bd0c8f55b38c0b2d8a92c13bacb4a3631a294fa"),
    ("LGPL-2.1-only", "whole", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1-only", "terms", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1-only", "whole, old address", "bd06b7347431b0fc243c0e32d1668ab362329b4a591386570abd310334f6fbdb"),
    ("LGPL-2.1-only", "terms, old address", "a5ac783c64dc7fa3fe7b641692ee7b8da491bd87f613c9bb99618a9469e71c47"),
    ("LGPL-2.1-only", "terms, web address", "75fd50abdf9b6ede6e1241986dd3e5850aa7c83b83892f5bce9e206765724836"),
    ("LGPL-3.0-only", "whole", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "whole", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "whole", "ecd87af8e219e6fdcd08397cc8b2afc91204e42601d38d172066e24a8b8c444e"),
]
#: A line that is a copyright notice.
#: it names a year, a sign, a holder or a template's place for one; other lines that begin with the word are part of a text.
COPYRIGHT = r"(?m)^[^\p{L}\n]*(copyright\b[^\n]*\b(19|20)[0-9]{2}|copyright[ \t:]*(\(c\)|©|[<\[{])|copyright +(by |holders?:)|\(c\)[ \t]*[0-9<\[{]|©)[^\n]*$"


def canonical_lines(text: Column) -> Column:
    """Normalised, with the line feeds kept."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def one_line(lines: Column) -> Column:
    """The whole text of normalised lines; spellings of several words are made one across lines too."""
    out = F.trim(F.regexp_replace(lines, r"[ \n]+", " "))
    for a, b in ACROSS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical(text: Column) -> Column:
    return one_line(canonical_lines(text))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license), one row a digest; known: (license, text), in place of the texts and digests kept here."""
    texts = spark.createDataFrame(KNOWN, "license string, text string") if known is None else known
    rows = texts.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license")
    if known is None:
        rows = rows.unionByName(spark.createDataFrame([(digest, name) for name, _, digest in KNOWN_DIGESTS], "digest string, license string"))
    rows = rows.groupBy("digest").agg(F.min("license").alias("license"))
    return F.broadcast(rows) if texts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, digest, license, n_license_lines, line_licenses): of the whole text, and of its lines.

    A text is normalised once; it and its lines are looked up in one join, and only matches and whole texts go on.
    """
    digests = known_digests(docs.sparkSession, known)
    lined = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), canonical_lines(F.col(text)).alias("lines"))
    whole = one_line(F.col("lines"))
    parts = lined.select("row", "id", F.posexplode(F.coalesce(F.concat(F.array(whole), F.split("lines", "\n")), F.array(F.lit(None).cast("string")))).alias("part", "line"))
    parts = parts.select("row", "id", (F.col("part") == 0).alias("whole"), F.sha2(F.trim("line"), 256).alias("digest"))
    found = parts.join(digests, "digest", "left").where("whole or license is not null").withColumn("license", F.when(F.col("digest") != F.sha2(F.lit(""), 256), F.col("license")))
    line = ~F.col("whole")
    rows = found.groupBy("row").agg(
        F.min("id").alias(id), F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"), F.max(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.count_if(line & F.col("license").isNotNull()).alias("n_license_lines"), F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("license")))), ",").alias("line_licenses"),
    )
    return rows.drop("row")


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_canonical_lines(text: str) -> str:
    out = f"regexp_replace(lower({text}), {sql_text(COPYRIGHT)}, '', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, {sql_text(a)}, {sql_text(b)})"
    return rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


def oracle_sql() -> str:
    known = ", ".join(f"({sql_text(a)}, {sql_text(b)})" for a, b in KNOWN)
    digests = ", ".join(f"({sql_text(digest)}, {sql_text(name)})" for name, _, digest in KNOWN_DIGESTS)

    def canon(x: str) -> str:
        out = rf"trim(regexp_replace({x}, '[ \n]+', ' ', 'g'))"
        for a, b in ACROSS:
            out = f"replace({out}, {sql_text(a)}, {sql_text(b)})"
        return out

    return f"""with known as (select digest, min(license) as license from (select sha256({canon(sql_canonical_lines("t"))}) as digest, l as license from (values {known}) k(l, t) union all select d, l from (values {digests}) k(d, l)) group by 1),
lined as (select doc_id, {sql_canonical_lines("text")} as lines from documents),
whole as (select doc_id, sha256({canon("lines")}) as digest from lined),
found as (select doc_id, count(*) as n, string_agg(distinct license, ',' order by license) as names
  from (select doc_id, sha256(trim(unnest(string_split(lines, chr(10))))) as digest from lined) join known using (digest) group by doc_id)
select doc_id, digest, license, cast(coalesce(n, 0) as bigint) as n_license_lines, coalesce(names, '') as line_licenses
from whole left join known using (digest) left join found using (doc_id)"""
