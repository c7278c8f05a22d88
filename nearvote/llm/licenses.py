"""License scans: canonical digests of whole texts, hash-joined to known licences.

A text is reduced to a canonical form: lower case, equivalent spellings made one,
copyright lines dropped, everything but letters and digits turned into single spaces.
Its SHA-256 is hash-joined to the digests of known texts. Lines are put into the same
form and looked up among the notices of one line, which stand in longer documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearvote.llm import common

# Equivalent spellings, as in published licence matching guidelines (pattern, common form).
SPELLINGS = (
    ("https?://", ""),
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("copyright holders?", "copyright owner"),
    ("&", " and "),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

""" + _ISC.split("\n\n")[1]
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""

# Whole licences (licence, text, titles that may stand above it).
WHOLE = (
    ("MIT", _MIT, ("MIT License", "The MIT License", "The MIT License (MIT)")),
    ("ISC", _ISC, ("ISC License", "The ISC License")),
    ("0BSD", _ZERO, ("Zero-Clause BSD", "BSD Zero Clause License")),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL, ("BSD 2-Clause License",)),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL, ("BSD 3-Clause License",)),
    ("Zlib", _ZLIB, ("zlib License", "The zlib License")),
    ("BSL-1.0", _BOOST, ("Boost Software License - Version 1.0 - August 17th, 2003",)),
    ("Unlicense", _UNLICENSE, ("The Unlicense",)),
)
# Notices of one line (licence, text).
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)
# Digests of the canonical forms of long licences (licence, digest), as Debian's
# common-licenses has their texts.
DIGESTS = (
    ("Apache-2.0", "4a0b5a7831e63e1ffbd7a198ec456bccf641ded314e1fac6acdf940a4e7b13ed"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5893357b481dbf1e53b02ebe43d52d2ceedcb31157e52634b179abb890f4a5ca"),
    ("GFDL-1.3", "d86fc0703b79e57971515193404e6fc8bb40a9bb3b1cc201a8c9a12a19908941"),
    ("GPL-1.0", "596622575bcd3d827e7f6bce1f02e32bed2edeb0e9d8ce0d39441ba10031d1aa"),
    ("GPL-2.0", "632eed5ccd9536a119e4736f4111f5ea096d69650e17f4a3fcacb4d273e39aec"),
    ("GPL-3.0", "312e7dfaa25a705106713eca7447b020a39141aec2dbe3138a6a7d0e87382425"),
    ("LGPL-2.0", "87c83ddf13b8d772a493615bbfb7368fb6c87b179e064f6b4573dd9008cbd283"),
    ("LGPL-2.1", "4b7fd8442d92b28972b9aee4eb75166ac0ea6267095bdcdbe488d5f54b725b71"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "e285f80aaf81d67143c0dc64cc084fdf2f0c560c2985326ec64d652ae51923af"),
    ("MPL-2.0", "b59ad31436b35a95a00cff48e84c1f014339f59fac784c1935fc6f7dc34abf70"),
)

#: Known texts: (licence, text). Whole licences with and without a title, and notices.
KNOWN = tuple((name, body) for name, text, titles in WHOLE for body in (text, *(f"{title}\n\n{text}" for title in titles))) + NOTICES


#: Most known texts and digests (about 200 bytes each) that are broadcast.
MAX_BROADCAST = 1 << 16


@dataclass(frozen=True)
class LicenseConfig:
    """Known texts, known digests of whole texts, and the notices that are looked for line by line."""

    known: tuple[tuple[str, str], ...] = KNOWN
    digests: tuple[tuple[str, str], ...] = DIGESTS
    notices: tuple[tuple[str, str], ...] = NOTICES
    #: A line of fewer canonical characters is not looked up.
    shortest: int = 8


# What may stand before a line in a comment, and lines that only claim a copyright: with a mark, a
# year or a placeholder, or with a name ("Copyright Jane Doe"). Where "Copyright" is part of a
# term of the licence itself, TERMS makes it small first.
_MARGIN = r"(^|\n)[ \t#*;/%!-]*"
TERMS = r"Copyright([ \t]+(?:Licen[cs]e|Notice|Holder|Owner|Law|Act|Statement))"
CLAIM = _MARGIN + r"(?:(?:[Cc]opyright|COPYRIGHT|\([cC]\)|©)[ \t:]*(?:\([cC]\)|©|[0-9<{]|\[)[^\n]*|Copyright[ \t:]+(?:by[ \t]+)?[A-Z][a-z][^\n]*)"
RESERVED = _MARGIN + r"all rights reserved\.?[ \t]*"


def _plain(text: Column) -> Column:
    """A text without claims, in common spellings; its line breaks are kept."""
    form = F.regexp_replace(F.coalesce(text, F.lit("")), TERMS, "copyright$1")
    form = F.lower(F.regexp_replace(form, CLAIM, "$1"))
    form = F.regexp_replace(form, RESERVED, "$1")
    for pattern, common_form in SPELLINGS:
        form = F.regexp_replace(form, pattern, common_form)
    return form


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def canonical(text: Column) -> Column:
    """Canonical form of a text; null and texts without letters or digits become ''."""
    return _words(_plain(text))


def canonical_lines(text: Column) -> Column:
    """Canonical form of every line; '' for lines without letters or digits. No rule looks beyond a line."""
    return F.transform(F.split(_plain(text), "\n", -1), _words)


def joined(lines: Column) -> Column:
    """Canonical form of a text from those of its lines."""
    return F.array_join(F.filter(lines, lambda line: line != ""), " ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, config: LicenseConfig) -> DataFrame:
    """(digest, license): one row per distinct canonical text of the catalogue."""
    texts = spark.createDataFrame(list(config.known), "license string, body string").select(digest(F.col("body")).alias("digest"), "license")
    if config.digests:
        texts = texts.union(spark.createDataFrame(list(config.digests), "license string, digest string").select("digest", "license"))
    return texts.groupBy("digest").agg(F.min("license").alias("license"))


def read_digests(spark: SparkSession, path: str) -> tuple[tuple[str, str], ...]:
    """(licence, digest) of a folder of licence texts, each file named by its licence; for ``LicenseConfig.digests``."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1).alias("license"), digest(F.col("value")).alias("digest"))
    return tuple((r["license"], r["digest"]) for r in files.orderBy("license").collect())  # a catalogue, not a corpus


def scan_licenses(docs: DataFrame, config: LicenseConfig = LicenseConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license, n_lines, line_licenses of every row.

    ``license`` is the known licence that the whole text equals in canonical form, else
    null; ``n_lines`` counts its lines that equal a known notice, ``line_licenses`` names
    those licences, sorted and comma-joined ('' for none). Null and empty texts have the
    digest of '' and no licence. Rows that repeat an id are reported one by one.
    """
    known = known_digests(docs.sparkSession, config)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("body"))
    forms = rows.select("doc_id", canonical_lines(F.col("body")).alias("forms"))
    lines = F.filter("forms", lambda x: F.length(x) >= config.shortest)
    digested = forms.select("doc_id", F.sha2(joined(F.col("forms")).cast("binary"), 256).alias("digest"), F.transform(lines, lambda x: F.sha2(x.cast("binary"), 256)).alias("lines"))
    # A catalogue of any size may be configured; a larger one is joined by a shuffle, for which
    # digests of texts that many rows share are the engine's skew join's.
    small = len(config.known) + len(config.digests) <= MAX_BROADCAST
    matched = digested.join(F.broadcast(known) if small else known.hint("shuffle_hash"), "digest", "left")
    # Notices are lines of longer documents: their digests are constants of the plan.
    names = F.create_map(*(x for name, body in config.notices for x in (digest(F.lit(body)), F.lit(name))))
    hits = F.filter(F.transform("lines", lambda d: names[d]), lambda x: x.isNotNull())
    return matched.select(
        "doc_id",
        "digest",
        "license",
        F.size(hits).cast("long").alias("n_lines"),
        F.array_join(F.array_sort(F.array_distinct(hits)), ",").alias("line_licenses"),
    )
