"""Licences by the digest of their canonical text.

A text is normalised and hashed; the hash is joined to the digests of known
texts. Normalising drops case, punctuation, spaces and line breaks, reads
equivalent spellings alike, and drops copyright lines, the line that reserves
all rights and the licences' own title lines, in known texts as in documents.
Units that are looked up: the whole document, each line (one-line notices are
entire texts of their own), and each run of as many paragraphs as a known text
has, so that a licence is found after an introduction, wrapped at any width or
behind comment signs.

The verdict is of one row: a row carries its number with its units, which are
joined to the known digests and grouped again where they are, so that neither
the rows nor their texts meet anything by their ids.

Defined cases: a null or empty text has no licence; a unit that is empty once
normalised matches nothing, so neither does a title alone; repeated rows, rows
that share an id and rows without one have results of their own; several known
names for one digest are all reported; an empty table gives an empty table.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import col

# Public licence texts and customary one-line notices.
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License");"""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)

#: Public texts of full length, one file each; of those with an appendix, the terms alone are known as well.
LONG = (("Apache-2.0", "Apache-2.0"), ("CC0-1.0", "CC0-1.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"))
TERMS_END = "END OF TERMS AND CONDITIONS"

# Title lines of licences.
TITLES = (
    "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "ISC License", "The ISC License", "ISC License (ISC)", "BSD Zero Clause License", "Zero-Clause BSD",
    "zlib License", "The zlib License", "BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", "BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License",
    "The Unlicense", "Apache License", "Version 2.0, January 2004", "http://www.apache.org/licenses/", "GNU GENERAL PUBLIC LICENSE", "Version 2, June 1991", "Version 3, 29 June 2007",
    "GNU LESSER GENERAL PUBLIC LICENSE", "Version 2.1, February 1999", "Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0", "Creative Commons Legal Code", "CC0 1.0 Universal",
)

# Spellings and the ones they are read as; words written apart are read as one anyway.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"), ("labour", "labor"), ("merchantibility", "merchantability"), ("organisation", "organization"),
    ("organised", "organized"), ("owner", "holder"), ("owners", "holders"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("https", "http"),
)
NOT_WORD = r"[^\p{L}\p{N}]+"
#: A copyright line, behind any comment sign; not a line of terms that happens to begin with the word. The words of the line on rights.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}(©]*(copyright[^\p{L}\p{N}]*(\(c\)|©|\d{4}|by[^\p{L}\p{N}]|$)|\(c\)[^\p{L}\p{N}]*(copyright|\d{4})|©)"
RIGHTS = "allrightsreserved"
WHOLE, LINE, PART = 0, 1, 2


def squeezed(title: str) -> str:
    return "".join(c for c in title.lower() if c.isalnum())


DROPPED = (RIGHTS, *dict.fromkeys(map(squeezed, TITLES)))
VARIANT = r"(^|[^\p{L}\p{N}])(" + "|".join(a for a, _ in SPELLINGS) + r")([^\p{L}\p{N}]|$)"


def long_texts() -> list[tuple[str, str]]:
    """(license, text) of the public texts that come with the library."""
    out = []
    for name, file in LONG:
        text = resources.files("ledgerlens.llm").joinpath("licenses", f"{file}.txt").read_text("utf-8")
        out.append((name, text))
        if TERMS_END in text:
            out.append((name, text[:text.index(TERMS_END) + len(TERMS_END)]))
    return out


def all_known() -> list[tuple[str, str]]:
    return [*KNOWN, *long_texts()]


def canonical_line(line: Column) -> Column:
    """The words of one line, run together; null for a line without words, empty for one that is dropped."""
    low = F.lower(line)
    words = F.split(low, NOT_WORD)
    alike = F.create_map(*[F.lit(x) for pair in SPELLINGS for x in pair])
    read = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(alike, w), w)), "")
    plain = F.when(low.rlike(VARIANT), read).otherwise(F.regexp_replace(low, NOT_WORD, ""))
    return F.when(~low.rlike(r"[\p{L}\p{N}]"), None).when(low.rlike(COPYRIGHT_LINE) | plain.isin(*DROPPED), "").otherwise(plain)


def canonical_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), canonical_line)


def paragraphs(lines: Column) -> Column:
    """Canonical paragraphs of canonical lines: lines without words part them."""
    return F.filter(F.split(F.array_join(F.transform(lines, lambda x: F.coalesce(x, F.lit("\n"))), ""), "\n+"), lambda x: x != "")


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """``digest``, ``license``, ``parts`` (number of paragraphs) of known texts; give a DataFrame of ``license``, ``text`` for a table of any size."""
    if isinstance(texts, DataFrame):
        frame = texts
    else:
        rows = F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("text")) for a, b in texts or all_known()])
        frame = spark.range(1, numPartitions=1).select(F.inline(rows))
    canon = frame.select("license", paragraphs(canonical_lines(F.col("text"))).alias("p")).where("size(p) > 0")
    return canon.select(F.sha2(F.array_join("p", ""), 256).alias("digest"), "license", F.size("p").alias("parts")).distinct()


def units(docs: DataFrame, sizes: list[int], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``row``, ``doc``, ``unit`` (kind, place and digest): what is looked up of each row, one row without a unit for those that have none.

    ``sizes`` are the numbers of paragraphs that known texts have.
    """
    lines = docs.select(F.monotonically_increasing_id().alias("row"), col(doc).alias("doc"), canonical_lines(col(text)).alias("lines"))
    parted = lines.withColumn("p", paragraphs(F.col("lines")))

    def unit(kind: int, at: Column, words: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), F.sha2(words, 256).alias("digest"))

    def runs(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size("p") - n + 1), lambda i: unit(PART, i, F.array_join(F.slice(F.col("p"), i, n), "")))
        return F.when(F.size("p") > n, each)  # a run of all paragraphs is the whole

    whole = F.when(F.size("p") > 0, F.array(unit(WHOLE, F.lit(0), F.array_join("p", ""))))
    numbered = F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))), lambda s: F.length(s["x"]) > 0)
    single = F.transform(numbered, lambda s: unit(LINE, s["i"], s["x"]))
    none = F.array().cast("array<struct<kind:int,at:int,digest:string>>")
    every = F.concat(*[F.coalesce(x, none) for x in (whole, single, *map(runs, sizes))])
    return parted.select("row", "doc", F.explode_outer(every).alias("unit"))


def scan(docs: DataFrame, known: DataFrame | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc``, ``whole_license``, ``line_licenses``, ``part_licenses`` (sorted names, comma-joined), ``n_lines_matched``."""
    table = known_digests(docs.sparkSession) if known is None else known
    sizes = sorted(r["parts"] for r in table.select("parts").distinct().collect())  # as many as there are lengths of licences
    table = table.groupBy("digest").agg(F.array_sort(F.collect_set("license")).alias("names"))
    if known is None:  # the built-in list is short and fixed, so a broadcast of it is bounded
        table = F.broadcast(table)
    met = units(docs, sizes, doc, text).select("row", "doc", "unit.kind", "unit.at", "unit.digest").join(table, "digest", "left")

    def named(kind: int) -> Column:
        found = F.flatten(F.collect_set(F.when((F.col("kind") == kind), F.col("names"))))
        return F.array_join(F.array_sort(F.array_distinct(found)), ",")

    # a row's units are all in one task until here, so that grouping sends one row on
    out = met.groupBy("row").agg(
        F.first("doc").alias("doc"), named(WHOLE).alias("whole_license"), named(LINE).alias("line_licenses"), named(PART).alias("part_licenses"),
        F.count_if((F.col("kind") == LINE) & F.col("names").isNotNull()).alias("n_lines_matched"))
    return out.select(F.col("doc").alias(doc), "whole_license", "line_licenses", "part_licenses", "n_lines_matched")
