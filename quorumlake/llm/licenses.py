"""Licence scans by canonical digest, with DataFrame functions only.

Case, punctuation, copyright lines and equivalent spellings are normalised, and
the digest of the entire text is joined with those of known licences.
"""

from __future__ import annotations

from functools import reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line that starts as a copyright notice and bears a year, a sign or a reservation of rights.
COPYRIGHT_LINE = r"(^|\n)[ \t*#/>-]*(copyright|\(c\)|©|&copy;)[^\n]*([0-9][0-9][0-9][0-9]|\(c\)|©|<year>|\[year\]|all rights reserved)[^\n]*"
RESERVED_LINE = r"(^|\n)[ \t*#/>-]*all rights reserved[. \t]*(\n|$)"
#: Lines that name a holder without a year, at the end of a paragraph; words that go on with a sentence are no holder.
YEARLESS_LINES = (
    r"((^|\n)[ \t*#/>-]*(copyright|©|&copy;)[ \t]+"
    r"(?!(holders?|owners?|notices?|licen[sc]es?|laws?|and|or|in|on|of|to|by|is|are|for|the|this|that|act|treat(y|ies)|rights?|interests?|statements?|protection|permission|status|infringement)\b)"
    r"[^\n]*)+(?=\s*$|\n[ \t*#/>-]*(\n|$))"
)
#: Spellings and wordings that count as one.
EQUIVALENT = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("recognised", "recognized"),
    ("fulfilment", "fulfillment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("judgement", "judgment"),
    ("per cent", "percent"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("http", "https"),
)

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Fixed values: (name, title, text) of public licences.
KNOWN = (
    (
        "MIT",
        "MIT License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        "ISC License",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.
"""
        + _WARRANTY,
    ),
    (
        "0BSD",
        "Zero-Clause BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _WARRANTY,
    ),
    ("BSD-2-Clause", "BSD 2-Clause License", f"{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", "BSD 3-Clause License", f"{_BSD_HEAD}\n{_BSD_THIRD}\n{_BSD_TAIL}"),
    (
        "Zlib",
        "zlib License",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
)


#: Further headings of texts in KNOWN.
HEADINGS = {
    "BSD-2-Clause": ("The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License"),
    "MIT": ("Expat License",),
}
#: Whole texts in the folder license_texts, by name; GPL and LGPL texts don't say whether later versions count.
LONG_TEXTS = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense")
#: The part behind it shows how to apply the licence, and copies often leave it out.
TERMS_END = "END OF TERMS AND CONDITIONS"
#: Standard notices that stand for the whole text.
NOTICES = (
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    *(
        (
            f"{short}-{version}.0-or-later",
            f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software
Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>.""",
        )
        for short, name, version in (("GPL", "GNU General Public License", 3), ("LGPL", "GNU Lesser General Public License", 3), ("AGPL", "GNU Affero General Public License", 3))
    ),
)


def canonical(text: Column) -> Column:
    """Normalised text: lower case, no copyright lines, words of a-z and 0-9 with single spaces, equivalent spellings made one."""
    plain = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.regexp_replace(plain, "\r\n?", "\n")
    for pattern in (COPYRIGHT_LINE, RESERVED_LINE, YEARLESS_LINES):
        plain = F.regexp_replace(plain, pattern, "\n")
    spaced = F.concat(F.lit(" "), F.regexp_replace(plain, "[^a-z0-9]+", " "), F.lit(" "))
    return F.trim(F.regexp_replace(reduce(lambda x, pair: F.replace(x, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), EQUIVALENT, spaced), " +", " "))


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of all texts that come with the library, without and with their usual headings."""
    out = []
    for name, title, text in KNOWN:
        titles = [x for t in (title, *HEADINGS.get(name, ())) for x in (t, f"The {t}", f"{t} ({name})", f"The {t} ({name})")]
        out += [(name, text), *((name, f"{t}\n\n{text}") for t in titles)]
    for name in LONG_TEXTS:
        text = (files(__package__) / "license_texts" / f"{name}.txt").read_text("utf-8")
        out.append((name, text))
        if TERMS_END in text:
            terms = text[: text.index(TERMS_END)]
            out += [(name, terms), (name, terms + TERMS_END)]
    return out + list(NOTICES)


def digests_of(known: DataFrame) -> DataFrame:
    """(digest, license) of known (license, text); of texts that count as one, the smallest name."""
    return known.select(F.sha2(canonical(F.col("text").cast("string")), 256).alias("digest"), F.col("license").cast("string").alias("license")).groupBy("digest").agg(F.min("license").alias("license"))


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license) of the library's own texts; a fixed, short table."""
    return digests_of(spark.createDataFrame(known_texts(), "license string, text string"))


def scan_licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(id_col, digest, license), one row per input row; license is null if the whole text is no known licence.

    A null or empty text has the digest of the empty text. known (license, text)
    adds licences, whose names come first; texts that are null or have no word add
    none. The library's own table is fixed and short, so it is broadcast. Equal
    texts and repeated rows get equal results; no rows give no rows.
    """
    digests = documents.select(F.col(id_col), F.sha2(canonical(F.col(text_col).cast("string")), 256).alias("digest"))
    found = digests.join(F.broadcast(known_digests(documents.sparkSession)), "digest", "left")
    if known is not None:
        more = digests_of(known.where(canonical(F.col("text").cast("string")) != "")).withColumnRenamed("license", "__more")
        found = found.join(more, "digest", "left").withColumn("license", F.coalesce("__more", "license"))
    return found.select(id_col, "digest", "license")
