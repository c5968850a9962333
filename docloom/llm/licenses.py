"""License scan by canonical digest lookup: case, punctuation, copyright lines
and equivalent spellings are normalised, and the digests of entire texts are
hash-joined to those of known licences.  DataFrame functions only.

Looked up are each document's whole text and each of its lines as a text of
its own (one-line notices).  Canonical form: A-Z lower-cased; copyright lines
removed; runs of ASCII characters other than a-z and 0-9 become one blank;
words of ``SPELLINGS`` replaced; blanks trimmed at both ends.

Defined results: null counts as empty text, whose digest is that of '' and
matches nothing; empty lines match nothing; a line or text that several known
licences share reports each (lines) or the first by id (whole text); repeated
rows and null ids keep rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import APACHE_2, CC0_1, GPL_2, GPL_3, LGPL_3, LGPL_21, MPL_2, UNLICENSE
from .tables import ascii_lower

# Equivalent spellings
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense",
    "sub license": "sublicense", "organisation": "organization", "organisations": "organizations",
    "merchantibility": "merchantability", "acknowledgement": "acknowledgment", "favour": "favor",
    "initialise": "initialize", "utilisation": "utilization", "whilst": "while", "per cent": "percent",
    "copyright holder": "copyright owner", "copyright holders": "copyright owners", "noncommercial": "non commercial"}

# Patterns (the same in Java and RE2)
COPYRIGHT_LINE = r"(^|\n)[ \t]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[]|by )|\(c\)|©)[^\n]*"
OTHER = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _bsd(text: str, *titles: str) -> list[str]:
    """With and without a title, the line kept of a copyright notice, and numbers."""
    plain = re.sub(r"(?m)^[1-3]\. ", "", text)
    return [title + rights + x for title in ("", *titles) for rights in ("", "All rights reserved.\n") for x in (text, plain)]


def _editions(text: str) -> list[str]:
    """With and without the appendix after the terms, and with newer links."""
    mark = "END OF TERMS AND CONDITIONS"
    cut = [text[:text.index(mark) + len(mark)]] if mark in text else []
    return list(dict.fromkeys(y for x in (text, *cut) for y in (x, x.replace("http://", "https://"))))


# Whole texts; a text that doesn't tell "only" from "or later" has the "only" id
_WHOLE = {
    "MIT": [title + _MIT for title in ("", "MIT License\n", "The MIT License\n", "The MIT License (MIT)\n")],
    "ISC": [title + _ISC for title in ("", "ISC License\n", "The ISC License\n")], "Zlib": [_ZLIB, "zlib License\n" + _ZLIB],
    "BSD-2-Clause": _bsd(_BSD + _BSD_AS_IS, "BSD 2-Clause License\n", "The 2-Clause BSD License\n", 'BSD 2-Clause "Simplified" License\n'),
    "BSD-3-Clause": _bsd(_BSD + _BSD_NAME + _BSD_AS_IS, "BSD 3-Clause License\n", "The 3-Clause BSD License\n",
                         'BSD 3-Clause "New" or "Revised" License\n'),
    "Apache-2.0": _editions(APACHE_2), "GPL-2.0-only": _editions(GPL_2), "GPL-3.0-only": _editions(GPL_3),
    "LGPL-2.1-only": _editions(LGPL_21), "LGPL-3.0-only": _editions(LGPL_3), "MPL-2.0": _editions(MPL_2),
    "CC0-1.0": _editions(CC0_1), "Unlicense": _editions(UNLICENSE)}

# Ids known by their SPDX line
_GNU = ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
SPDX = ("MIT", "ISC", "Zlib", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0",
        "CC-BY-NC-4.0", "CC0-1.0", *(f"{x}-only" for x in _GNU), *(f"{x}-or-later" for x in _GNU))

# Known licence texts and notices (SPDX id, text)
KNOWN = (
    *((k, t) for k, texts in _WHOLE.items() for t in texts), *((k, f"SPDX-License-Identifier: {k}") for k in SPDX),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."), ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Released under CC0 1.0."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."))


def canonical_lines(text: Column) -> Column:
    """``text`` normalised, its line breaks kept; one blank at most in a row."""
    x = ascii_lower(F.coalesce(text.cast("string"), F.lit("")))
    x = F.regexp_replace(x, COPYRIGHT_LINE, "$1")
    # two blanks between words, so that neighbours never share one
    x = F.concat(F.lit(" "), F.replace(F.regexp_replace(x, OTHER, "  "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        x = F.replace(x, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.regexp_replace(x, " +", " ")


def whole(lines: Column) -> Column:
    """Canonical lines as one canonical text."""
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def digest(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """The built-in table: license, text."""
    rows = [F.struct(F.lit(k).alias("license"), F.lit(t).alias("text")) for k, t in KNOWN]
    return spark.range(1).select(F.inline(F.array(*rows)))


def scan_licenses(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, digest (of the whole canonical text), license (of the whole text,
    or null) and line_licenses (sorted ids of the lines' licences).

    The whole text and its lines are exploded as units, with the number of the
    row they came from, and meet the known digests in one join; of the units
    only the whole texts and the hits are grouped by row."""
    table = (known.select("license", digest(whole(canonical_lines(F.col("text")))).alias("digest"))
             .where(F.col("digest") != digest(F.lit(""))).distinct())
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), canonical_lines(F.col(text)).alias("lines"))
    units = rows.select("row", "key", F.posexplode(F.concat(F.array(whole(F.col("lines"))), F.split("lines", "\n"))).alias("pos", "unit"))
    units = units.select("row", "key", (F.col("pos") == 0).alias("entire"), digest(F.trim("unit")).alias("digest"))
    met = units.join(table, "digest", "left").where(F.col("entire") | F.col("license").isNotNull())
    return (met.groupBy("row", "key")
            .agg(F.max(F.when(F.col("entire"), F.col("digest"))).alias("digest"),
                 F.min(F.when(F.col("entire"), F.col("license"))).alias("license"),
                 F.array_sort(F.collect_set(F.when(~F.col("entire"), F.col("license")))).alias("line_licenses"))
            .select(F.col("key").alias(key), "digest", "license", "line_licenses"))
