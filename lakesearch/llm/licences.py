"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form (case, punctuation, white space, copyright lines, equivalent spellings) and the
SHA-256 of the whole of it is looked up among the digests of known licences and notices.  The units looked up are the
whole text and each of its lines, so a one-line notice inside a document is found too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known texts (fixed values, public licence texts and customary notices): id, text.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]
#: Equivalent spellings, as whole words after lower-casing and removal of punctuation (fixed values).
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("favour", "favor"), ("v", "version"), ("ver", "version"), ("https", "http")]
#: Marks that begin a line of copyright; such lines don't count.
_COPYRIGHT = "^[\\s*/#;-]*(copyright\\b|\\(c\\)\\s*(copyright|by\\b|<|\\d{4})|©|all rights reserved)"
#: Known digests up to which their table may be broadcast (about 100 bytes each); beyond it Spark chooses the join.
SMALL = 100_000
_OTHER = "[^\\p{L}\\p{N}]+"


def canonical(line: Column) -> Column:
    """One line in canonical form: lower case, copyright lines empty, everything but letters and digits to single spaces,
    equivalent spellings to one; a space stands before and after each word (the empty line: one space)."""
    low = F.lower(line)
    out = F.when(low.rlike(_COPYRIGHT), F.lit(" ")).otherwise(F.concat(F.lit(" "), F.regexp_replace(low, _OTHER, "  "), F.lit(" ")))
    # two spaces between words, so that one replacement doesn't take the space that the next one needs
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b} "))
    return F.concat(F.lit(" "), F.regexp_replace(F.trim(out), " +", " "), F.lit(" "))


def digest(lines: Column) -> Column:
    """SHA-256 of the canonical lines of one unit, joined; null where no line has a word left."""
    whole = F.regexp_replace(F.trim(F.array_join(lines, "")), " +", " ")
    return F.when(whole != "", F.sha2(whole, 256))


def known_digests(spark, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, license) for each known text."""
    texts = spark.createDataFrame(known, "license string, text string")
    return texts.select(digest(F.transform(F.split("text", "\n"), canonical)).alias("digest"), "license").dropDuplicates(["digest"])


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``text_digest`` of the whole canonical text (null without words),
    ``text_license`` whose text the whole is (else null), ``n_license_lines`` and ``line_licenses`` (the licences whose
    texts are whole lines, each once, sorted, joined by commas; empty if none).

    Null and empty texts have no units.  Rows with equal ids stay apart.  ``known`` (digest, license; few rows, one for
    each digest) defaults to ``known_digests``; it is broadcast up to ``SMALL`` rows."""
    known = known_digests(docs.sparkSession) if known is None else known
    known = F.broadcast(known) if known.limit(SMALL + 1).count() <= SMALL else known
    lines = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), canonical).alias("lines"))
    units = lines.select("row", "doc_id", digest(F.col("lines")).alias("text_digest"), F.transform(F.filter("lines", lambda x: x != "  "), lambda x: F.sha2(F.trim(x), 256)).alias("of_lines"))
    # the whole text first, then each line; one task holds all units of a row, so the shuffle sees one row for each
    each = units.select("row", "doc_id", "text_digest", F.posexplode(F.concat(F.array("text_digest"), "of_lines")).alias("unit", "digest"))
    found = each.join(known, "digest", "left")
    in_line = (F.col("unit") > 0) & F.col("license").isNotNull()
    out = found.groupBy("row", "doc_id", "text_digest").agg(F.max(F.when(F.col("unit") == 0, F.col("license"))).alias("text_license"), F.count_if(in_line).alias("n_license_lines"), F.array_join(F.array_sort(F.collect_set(F.when(in_line, F.col("license")))), ",").alias("line_licenses"))
    return out.drop("row")


def _sql() -> str:
    low = "lower(line)"
    out = f"CASE WHEN regexp_matches({low}, '{_COPYRIGHT}') THEN ' ' ELSE ' ' || regexp_replace({low}, '{_OTHER}', '  ', 'g') || ' ' END"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b} ')"
    canon = f"' ' || regexp_replace(trim({out}), ' +', ' ', 'g') || ' '"
    known = ", ".join("({}, '{}', '{}')".format(k, i, t.replace("'", "''")) for k, (i, t) in enumerate(KNOWN))
    return f"""
WITH known AS (SELECT * FROM (VALUES {known}) t(k, license, text)),
texts AS (SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'k', k, text FROM known),
lines AS (SELECT kind, id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT kind, id, string_split(text, chr(10)) AS l FROM texts)),
canon AS (SELECT kind, id, i, {canon} AS line FROM lines),
whole AS (SELECT kind, id, regexp_replace(trim(string_agg(line, '' ORDER BY i)), ' +', ' ', 'g') AS text FROM canon GROUP BY kind, id),
digests AS (SELECT kind, id, CASE WHEN text <> '' THEN sha256(text) END AS digest FROM whole),
table_ AS (SELECT d.digest, min_by(k.license, k.k) AS license FROM digests d JOIN known k ON d.id = k.k WHERE d.kind = 'k' GROUP BY d.digest),
hits AS (SELECT c.id, t.license FROM canon c JOIN table_ t ON sha256(trim(c.line)) = t.digest WHERE c.kind = 'd' AND c.line <> '  '),
by_doc AS (SELECT id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM hits GROUP BY id)
SELECT d.id AS doc_id, d.digest AS text_digest, t.license AS text_license, coalesce(b.n, 0) AS n_license_lines, coalesce(b.names, '') AS line_licenses
FROM digests d LEFT JOIN table_ t ON d.digest = t.digest LEFT JOIN by_doc b ON b.id = d.id WHERE d.kind = 'd'
"""


SQL = _sql()
