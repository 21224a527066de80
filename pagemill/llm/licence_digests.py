"""Licence scans by canonical digests.

A text is brought to a canonical form (lower case, no copyright statements, equivalent spellings made one, punctuation and
white space folded; terms behind a statement on its line stay) and its SHA-256 is joined by equality to the digests of known licences. The same lookup over
single lines finds licence notices inside other texts. Known licences are a fixed small table, so the joins are
broadcast and nothing is shuffled; the whole text is always digested.

Defined results: a null text counts as empty; a text whose canonical form is empty has the digest of the empty string and
no licence; repeated rows get equal results; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and notices as published, without titles and copyright lines.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
    "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
    "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
    "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
    "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would "
    "be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed "
    "or altered from any source distribution."
)
# SHA-256 of the canonical forms of published licence texts too long to stand here, whole and (where they have an
# appendix) up to the end of their terms.
PUBLISHED = {
    "Apache-2.0": ("4f1eb3db712f18c5575314f703fa33be14d644a2dcf0430b55f27941ec398cec", "eba09ec9194590d52417962821b1442923fe20c4948e560c7aa66c0ae9963672"),
    "Artistic-1.0": ("e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GFDL-1.2": ("15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",),
    "GFDL-1.3": ("2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",),
    "GPL-1.0": ("490a17f9c44b8e7737e6d5b52eebf4c3610f67ee98c4ad515329fa012eebe42d", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    "GPL-2.0": ("2d0b5e012e036a2690fe078a56f4c6dabcb7e2c352ef799e5e2074dab15ef4ae", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    "GPL-3.0": ("d83c17395c9a12cd395b7344eeb0d7e93e4ce5c7e6565e5590ba6d2df2f9e9e1", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    "LGPL-2.0": ("61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    "LGPL-2.1": ("4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("f1daf3234686278093cf1137babd0598754ada714f0fc44e06e080008f7c6b38",),
    "MPL-2.0": ("4cabe7a78fd77da2d52b1a2929bf10219e45cfc14279d76a49774370a74b3d17",),
}
# Names by which notices call licences.
NAMED = {
    "MIT": ("MIT License", "MIT licence terms", "Expat License"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "Modified BSD License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL, version 2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL, version 3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero 1.0"),
}
NOTICES = ("Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This software is licensed under the {}.")
# Creative Commons clauses, their full names, and versions.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
COMMONS_VERSIONS = ("2.0", "2.5", "3.0", "4.0")


def _licences() -> dict[str, tuple[str, ...]]:
    """Texts and notices by licence: whole texts, also under a title or after "All rights reserved.", and a notice for each name."""
    whole = {
        "MIT": (_MIT, "MIT License\n" + _MIT, "The MIT License (MIT)\n" + _MIT),
        "ISC": (f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}",),
        "0BSD": (f"{_ISC_GRANT}. {_ISC_DISCLAIMER}",),
        "BSD-2-Clause": (_BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_END,),
        "BSD-3-Clause": (_BSD_HEAD + _BSD_1 + _BSD_2 + _BSD_3 + _BSD_END,),
        "Zlib": (_ZLIB,),
    }
    out = {name: (*texts, *[f"All rights reserved.\n{t}" for t in texts]) for name, texts in whole.items()}
    for name, called in NAMED.items():
        out[name] = (*out.get(name, ()), *[form.format(c) for form in NOTICES for c in called])
    for clause, full in COMMONS.items():
        for version in COMMONS_VERSIONS:
            spelled = tuple(f"This work is licensed under a Creative Commons {full} {version} {kind}License." for kind in ("", "International "))
            out[f"CC-{clause}-{version}"] = (*[form.format(f"CC {clause} {version}") for form in NOTICES], *spelled)
    return out | {"all-rights-reserved": ("All rights reserved.",)}


LICENCES = _licences()
# How terms begin where they stand on one line behind a copyright statement.
TERMS = (
    "all rights|permission (is|to)|licen[sc]ed|released under|distributed under|redistribution and|everyone is|this (software|work|program|library|file|source)|the (software|mit|bsd|apache)|"
    "you may|use of this|provided"
)
# Words whose full stop ends no sentence, single letters aside.
SHORT = r"\b(inc|ltd|corp|co|llc|jr|sr|al|dr|st|[a-z])\. "
#: A copyright statement at the start of a line: mark, year and holder, up to the terms or the next sentence on the line (group 5) or the line's end.
STATEMENT = rf"^[^\p{{L}}\p{{N}}©]*(copyright|copr|©|c\)) *[^\p{{L}}\n]*((19|20)[0-9][0-9]|©|by |c\))((?:[^\n.]|\.[^\n ])*?)((?:\b(?:{TERMS})\b|\. )[^\n]*|\.)?\z"
# Spellings taken as equal, applied in this order to lower-case text.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"),
    ("favour", "favor"), ("honour", "honor"), ("organisation", "organization"), ("copyright owner", "copyright holder"), ("&", " and "), ("(c)", " copyright "), ("©", " copyright "), ("https://", "http://"),
)


def canonical(text: Column) -> Column:
    """The form that is digested."""
    lines = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), lambda line: F.regexp_replace(F.regexp_replace(line, SHORT, "$1 "), STATEMENT, "$5"))
    out = F.array_join(lines, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, licences: dict[str, tuple[str, ...]] = LICENCES, published: dict[str, tuple[str, ...]] = PUBLISHED) -> DataFrame:
    """(digest, licence_id) of the known texts and digests; of two with one digest the first name in order counts."""
    rows = [(name, text) for name, texts in licences.items() for text in texts]
    table = spark.createDataFrame(rows, "licence_id string, text string").select(digest(F.col("text")).alias("digest"), "licence_id")
    given = spark.createDataFrame([(d, name) for name, digests in published.items() for d in digests], "digest string, licence_id string")
    return table.unionByName(given).groupBy("digest").agg(F.min("licence_id").alias("licence_id"))


def scan(docs: DataFrame, *carried: Column, text: str = "text", licences: dict[str, tuple[str, ...]] = LICENCES) -> DataFrame:
    """`carried` columns, the text's digest, licence_id (null for none) and notices: the licences that single lines name,
    sorted. Lines of every length count, also one that is the text itself."""
    names = [f"carried_{i}" for i in range(len(carried))]
    table = known(docs.sparkSession, licences)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    told = F.array_distinct(F.transform(F.filter(lines, lambda line: line != ""), digest))
    rows = docs.select(*[c.alias(n) for c, n in zip(carried, names, strict=True)], digest(F.col(text)).alias("digest"), told.alias("line_digests"))
    pairs = {r["digest"]: r["licence_id"] for r in table.collect()}
    by_digest = F.create_map(*[F.lit(x) for pair in sorted(pairs.items()) for x in pair])
    held = F.filter("line_digests", lambda d: d.isin(*sorted(pairs)))
    notices = F.array_sort(F.array_distinct(F.transform(held, lambda d: F.element_at(by_digest, d))))
    return rows.join(F.broadcast(table), "digest", "left").select(*names, "digest", "licence_id", notices.alias("notices"))
