"""License scans by canonical digests, in DataFrame operations only.

A text is brought to a canonical form: lower case, copyright lines dropped, equivalent spellings made
equal, everything but letters and digits turned into single blanks.  The MD5 digest of the whole canonical
text is hash-joined to the digests of known licences.  Single lines are looked up in the same way, as texts
of their own, among known notices, so a notice inside a document is found too.

Short licences are known by their texts, long ones by the digests of their canonical texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

#: Known digests that are broadcast at most.
BROADCAST_KNOWN = 100_000
# Spellings that licence texts use for each other, as (found, canonical).
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("http://", "https://"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("acknowledgement", "acknowledgment"),
    ("&", " and "),
)
# Fixed patterns: lines that only name the holder of the rights.
COPYRIGHT_LINES = r"(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|[0-9\[<])|\(c\)|©|all rights reserved)[^\n]*$"

# Public licence texts.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE_END = "\n\nFor more information, please refer to <https://unlicense.org>"
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
TEXTS = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("0BSD", ZERO_BSD),
    ("0BSD", "BSD Zero Clause License\n\n" + ZERO_BSD),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n\n" + ZLIB),
    ("Unlicense", UNLICENSE),
    ("Unlicense", UNLICENSE + UNLICENSE_END),
    ("BSL-1.0", BOOST),
)
# Digests of the canonical whole texts of longer licences, as published; some without the appendix on their use.
DIGESTS = (
    ("Apache-2.0", "16c1fd29efd0316e809be11009ec6338"),
    ("Apache-2.0", "b077fc82de9eb1202a0cd4fc03c75caa"),
    ("Apache-2.0", "60afddab44c379b64da974d4c3578db3"),
    ("Artistic-1.0-Perl", "01297679267ad921516667ccd889865e"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GFDL-1.2", "fc8fd4dca9351a1b1ba045c2a7d3d70f"),
    ("GFDL-1.3", "3564867804d3e20f9506651fedbca0e9"),
    ("GPL-1.0", "738cc3b112640d95d4cd79a58967ecea"),
    ("GPL-2.0", "5e39ace6e62f5a7fe9c17b4da986ad8c"),
    ("GPL-2.0", "68380dbeadb093b94ecf563db7312db7"),
    ("GPL-3.0", "5eaa767cc0a56c87c3852144458a3bf1"),
    ("GPL-3.0", "444f95dc767ede978b60cfb20fbd0bca"),
    ("LGPL-2.0", "74cf7fcef3b29a39165a795b2cad3a3a"),
    ("LGPL-2.1", "f998bc436710cfece156aaa84fd26dd4"),
    ("LGPL-2.1", "3054b3781b1af43f906dc753acad15ee"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "b7edc06df79bc44a04f12befb8111960"),
    ("MPL-2.0", "9b1d85516abd3488bbbcfee82900e077"),
)
# Names by which one-line notices call a licence.
NAMES = (
    ("MIT", "MIT License"),
    ("ISC", "ISC License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
)
FORMS = ("Released under {}", "Licensed under {}", "This work is licensed under {}", "License: {}", "Released under {} license")


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, letters and digits in words with single blanks."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINES, "")
    for found, kept in SPELLINGS:
        out = F.replace(out, F.lit(found), F.lit(kept))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def _notices() -> list[tuple[str, str]]:
    return [(spdx, form.format(the + name)) for spdx, name in NAMES for form in FORMS for the in ("", "the ")]


def known(spark: SparkSession, rows: list[tuple[str, str]], digests: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(license_id, digest) of known texts, one row per digest."""
    found = spark.createDataFrame(rows, "license_id string, text string").select("license_id", F.md5(canonical(F.col("text"))).alias("digest"))
    if digests:
        found = found.unionByName(spark.createDataFrame(list(digests), "license_id string, digest string"))
    return found.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per document: doc_id, text_digest, license_id (whole text; null if none), notices (known one-line notices, sorted, comma-separated).

    Null texts count as empty; an empty canonical text is no licence.  ``texts`` adds (licence, text) pairs.
    Repeated rows each give a row; other columns are not read.
    """
    spark = docs.sparkSession
    workspace = Workspace(spark, "licenses")
    whole = known(spark, [*TEXTS, *_notices(), *(texts or [])], DIGESTS).where(F.col("digest") != F.md5(F.lit("")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # The canonical form of every notice has "licen" or "released", and no step of it joins letters, so its line has
    # them too, whatever stands between words: other lines need no digest.
    likely = F.filter(F.split(text, "\n"), lambda x: F.lower(x).contains("licen") | F.lower(x).contains("released"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.md5(canonical(text)).alias("text_digest"), F.array_distinct(F.transform(likely, lambda x: F.md5(canonical(x)))).alias("lines"))
    # Digests only: from here on no text is read or moved, and row numbers are fixed.
    rows = workspace.stage(rows, "digests")
    lines = rows.select("row", F.explode("lines").alias("digest")).join(_small(known(spark, _notices())), "digest")
    notices = lines.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    met = rows.join(_small(whole.withColumnRenamed("digest", "text_digest")), "text_digest", "left").join(notices, "row", "left")
    return met.select("doc_id", "text_digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def _small(table: DataFrame) -> DataFrame:
    """To be broadcast if it is as small as lists of licences are (about 50 bytes a row)."""
    return F.broadcast(table) if table.count() <= BROADCAST_KNOWN else table


#: The same scan in SQL, stated apart: canonical texts by nested replacements, whole texts by their digests as first
#: computed, notices by a pattern over canonical lines instead of digests.
ORACLE = r"""
with line as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as raw from documents),
plain as (
  select doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(lower(raw), '(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|[0-9\[<])|\(c\)|©|all rights reserved)[^\n]*$', '', 'g'),
    'licence', 'license'), 'sub-license', 'sublicense'), 'sub license', 'sublicense'), 'non-commercial', 'noncommercial'), 'http://', 'https://'), 'copyright owner', 'copyright holder'), 'per cent', 'percent'), 'acknowledgement', 'acknowledgment'), '&', ' and '),
    '[^\p{L}\p{N}]+', ' ', 'g')) as l from line),
named as (select doc_id, regexp_extract(l, '^(released under|licensed under|this work is licensed under|license) (the )?(.+)$', 3) as rest, l from plain where l ~ '^(released under|licensed under|this work is licensed under|license) .*$'),
names(spdx, name) as (values ('MIT', 'mit license'), ('ISC', 'isc license'), ('Apache-2.0', 'apache license version 2 0'), ('Apache-2.0', 'apache license 2 0'), ('GPL-2.0', 'gnu general public license version 2'), ('GPL-3.0', 'gnu general public license version 3'),
  ('LGPL-3.0', 'gnu lesser general public license version 3'), ('AGPL-3.0', 'gnu affero general public license version 3'), ('MPL-2.0', 'mozilla public license 2 0'), ('BSD-2-Clause', 'bsd 2 clause license'), ('BSD-3-Clause', 'bsd 3 clause license'), ('CC0-1.0', 'cc0 1 0'),
  ('CC-BY-4.0', 'cc by 4 0'), ('CC-BY-SA-4.0', 'cc by sa 4 0'), ('CC-BY-NC-4.0', 'cc by nc 4 0'), ('CC-BY-ND-4.0', 'cc by nd 4 0'), ('CC-BY-NC-SA-4.0', 'cc by nc sa 4 0')),
hit as (select doc_id, string_agg(distinct spdx, ',' order by spdx) as notices from named join names on rest = name or (starts_with(l, 'released') and rest = name || ' license') group by 1),
doc as (
  select doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(lower(coalesce(text, '')), '(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|[0-9\[<])|\(c\)|©|all rights reserved)[^\n]*$', '', 'g'),
    'licence', 'license'), 'sub-license', 'sublicense'), 'sub license', 'sublicense'), 'non-commercial', 'noncommercial'), 'http://', 'https://'), 'copyright owner', 'copyright holder'), 'per cent', 'percent'), 'acknowledgement', 'acknowledgment'), '&', ' and '),
    '[^\p{L}\p{N}]+', ' ', 'g')) as c from documents),
whole(spdx, digest) as (values ('MIT', '90a17991c3ba7b04d183a6467fbe3449'), ('MIT', '04ddd61083899c2a5ef03d9fe09b79c9'), ('MIT', '66dd1caf442553ce09fa72a9da2e8c0e'), ('ISC', 'b6ab23f33a368e7f225abed7065c8009'), ('ISC', '63179b48dd80764d198b18b1a4a65df0'),
  ('0BSD', 'fa9583358e39e30cc008a801c940fa8c'), ('0BSD', '350f087c09f773dbf1e95772b1c826a7'), ('BSD-2-Clause', 'b0538ec125cafeeb58bf11083985630b'), ('BSD-2-Clause', '7156097767f5afef1724228b3dfb48fe'), ('BSD-3-Clause', 'dfd9463b7bcad50bb1270be3d6bf0c2a'), ('BSD-3-Clause', 'c245a9d439da9a8ea626ab19c280d998'),
  ('Zlib', '6df2a895c31891fec159c01a49b2d3cf'), ('Zlib', 'c8509dae8dc0557bb29ef1c77b16975c'), ('Apache-2.0', '16c1fd29efd0316e809be11009ec6338'), ('Apache-2.0', 'b077fc82de9eb1202a0cd4fc03c75caa'), ('Apache-2.0', '60afddab44c379b64da974d4c3578db3'), ('Artistic-1.0-Perl', '01297679267ad921516667ccd889865e'),
  ('CC0-1.0', '93a180096f6cfcf2c0dd24f75c2eec48'), ('GFDL-1.2', 'fc8fd4dca9351a1b1ba045c2a7d3d70f'), ('GFDL-1.3', '3564867804d3e20f9506651fedbca0e9'), ('GPL-1.0', '738cc3b112640d95d4cd79a58967ecea'), ('GPL-2.0', '5e39ace6e62f5a7fe9c17b4da986ad8c'), ('GPL-2.0', '68380dbeadb093b94ecf563db7312db7'),
  ('GPL-3.0', '5eaa767cc0a56c87c3852144458a3bf1'), ('GPL-3.0', '444f95dc767ede978b60cfb20fbd0bca'), ('LGPL-2.0', '74cf7fcef3b29a39165a795b2cad3a3a'), ('LGPL-2.1', 'f998bc436710cfece156aaa84fd26dd4'), ('LGPL-2.1', '3054b3781b1af43f906dc753acad15ee'), ('LGPL-3.0', 'b31b7335bc37919e8cdd79154e04d88d'),
  ('MPL-1.1', 'b7edc06df79bc44a04f12befb8111960'), ('MPL-2.0', '9b1d85516abd3488bbbcfee82900e077'), ('Unlicense', '3c0fa66ce452e1674dc40c0df1dd055a'), ('Unlicense', '243d95b52f77dc596a0b9d0b9ba09bb5'), ('BSL-1.0', 'ac2afa4a98b996b77ea9e51a8c904ee1'))
select doc.doc_id, md5(c) as text_digest, coalesce(whole.spdx, alone.spdx) as license_id, coalesce(notices, '') as notices
from doc left join whole on md5(c) = digest left join hit on doc.doc_id = hit.doc_id
left join (select doc_id, min(spdx) as spdx from (select doc_id, regexp_extract(c, '^(released under|licensed under|this work is licensed under|license) (the )?(.+)$', 3) as rest, c from doc) q
  join names on rest = name or (starts_with(c, 'released') and rest = name || ' license') group by 1) alone on alone.doc_id = doc.doc_id
"""


def oracle() -> str:
    return ORACLE
