"""Licence scan by canonical digest: whole texts, normalised, hash-joined to the digests of known licences."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that count as equal (variant, canonical).
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

#: Short licences whole as they are published, and notices that stand for one. Longer ones, whole as they are
#: published, are the files of known_licenses.
SHORT = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: Titles that a published text may open with, beside the text without one.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: Fixed value: many published texts are used with what follows this line or without it.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of every known text: short ones with each title and with none, the files, and these up to their end of terms."""
    out = list(SHORT)
    for license_id, text in SHORT:
        if len(text) > 300:
            out += [(license_id, f"{title}\n\n{text}") for title in TITLES.get(license_id, ())]
    for path in sorted((Path(__file__).parent / "known_licenses").glob("*.txt")):
        text = path.read_text()
        out.append((path.stem, text))
        if END_OF_TERMS in text:
            out += [(path.stem, text[: text.index(END_OF_TERMS)]), (path.stem, text[: text.index(END_OF_TERMS) + len(END_OF_TERMS)])]
    return out


#: Statements of copyright, in lower case, of which the canonical form has none. The first four are gone wherever lines
#: break; the last takes a whole line that opens with the word and a sign or year, or with a sign (and, for "(c)", a year).
#: A line that merely begins with the word, as a wrapped text may have it, is none, nor is the third point of a list.
STATEMENTS = (
    r"all\s+rights\s+reserved\.?",
    r"(copyright\s+)?(\(c\)|©)\s+[0-9][0-9,\s-]*\s+free\s+software\s+foundation,?\s+inc\.?(\s+<[^>]*>)?",
    r"copyright\s+(\(c\)\s+)?[<\[{](year|yyyy)[>\]}]\s+[<\[{][^>\]}]*[>\]}]",
    r"copyright\s+\(c\)\s+((year|19yy|19xx)\s+(your\s+name|<?name\s+of\s+author>?)|_+\s+_+)\.?",
    r"(?m)^[^\p{L}\p{N}\n]*(copyright[^\p{L}\p{N}\n]+(by[^\p{L}\p{N}\n][^\n]*)?[12][0-9][0-9][0-9]|copyright[^\p{L}\p{N}\n]*(\(c\)|©)|\(c\)[^\p{L}\p{N}\n]*[12][0-9][0-9][0-9]|©)[^\n]*",
)


def canonical(text: Column) -> Column:
    """Lower case, without statements of copyright; every run of other than letters and digits is one space; one spelling each.

    Any kind of line end counts. A null is empty. The whole text is taken, however long."""
    c = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    for pattern in STATEMENTS:
        c = F.regexp_replace(c, pattern.replace("(?m)", "(?md)").replace(r"\s", r"[ \t\n\f]"), " ")
    # two spaces between words, so that a spelling next to another keeps a space of its own
    c = F.concat(F.lit(" "), F.regexp_replace(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")), " ", "  "), F.lit(" "))
    for variant, one in EQUIVALENT:
        c = F.replace(c, F.lit(f" {variant} ".replace(" ", "  ")[1:-1]), F.lit(f" {one} ".replace(" ", "  ")[1:-1]))
    return F.replace(F.trim(c), F.lit("  "), F.lit(" "))


def known_digests(spark, known=None) -> DataFrame:
    """(license_digest, license_id) of each known text; of two licences with one canonical text the smaller id."""
    pairs = F.array(*(F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("license_text")) for i, t in known or known_texts()))
    texts = spark.range(1).select(F.inline(pairs))
    return texts.select(F.sha2(canonical(F.col("license_text")), 256).alias("license_digest"), "license_id").groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=None) -> DataFrame:
    """A row for each row of docs: its id, canonical_digest, license_id (null if no known text) and is_license.

    Only entire texts count: a licence within a longer text is not found. Null and empty texts have the digest of the
    empty text and no licence. Repeated rows and null ids stay rows of their own; other columns are ignored. known: pairs
    of license id and text instead of known_texts(); either is a list of the driver, so its size is known and its digests
    may be broadcast up to 100,000; the texts of docs are never shuffled."""
    known = known or known_texts()
    rows = docs.select(F.col(id_col), F.sha2(canonical(F.col(text_col)), 256).alias("canonical_digest"))
    lookup = known_digests(docs.sparkSession, known)
    lookup = F.broadcast(lookup) if len(known) <= 100_000 else lookup
    joined = rows.join(lookup, rows["canonical_digest"] == lookup["license_digest"], "left")
    return joined.select(F.col(id_col), "canonical_digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def plain_canonical(text: str | None) -> str:
    """The canonical form word by word in Python: what tests and the oracle hold the columns against."""
    import regex

    c = regex.sub(r"\r\n?", "\n", (text or "").lower())
    for pattern in STATEMENTS[:-1]:
        c = regex.sub(pattern.replace(r"\s", r"[ \t\n\f]"), " ", c)
    lines = [x for x in c.split("\n") if not regex.match(STATEMENTS[-1].removeprefix("(?m)"), x)]
    found = regex.findall(r"[\p{L}\p{N}]+", "\n".join(lines))
    for variant, one in EQUIVALENT:
        parts, out, i = variant.split(), [], 0
        while i < len(found):
            hit = found[i : i + len(parts)] == parts
            out += one.split() if hit else [found[i]]
            i += len(parts) if hit else 1
        found = out
    return " ".join(found)


def oracle(known=None) -> str:
    """The same for DuckDB over the table documents: words as a list, known digests as values that Python made."""
    import hashlib

    digests: dict[str, str] = {}
    for license_id, text in known or known_texts():
        digest = hashlib.sha256(plain_canonical(text).encode()).hexdigest()
        digests[digest] = min(license_id, digests.get(digest, license_id))
    c = "regexp_replace(lower(coalesce(text, '')), '\\r\\n?', chr(10), 'g')"
    for pattern in STATEMENTS:
        c = "regexp_replace({}, '{}', ' ', 'g')".format(c, pattern.replace(r"\s", r"[ \t\n\f]").replace("\\n", "\\x0A"))
    c = f"' ' || array_to_string(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}]+'), '  ') || ' '"
    for variant, one in EQUIVALENT:
        c = "replace({}, ' {} ', ' {} ')".format(c, variant.replace(" ", "  "), one.replace(" ", "  "))
    rows = ", ".join(f"('{d}', '{i}')" for d, i in sorted(digests.items()))
    return f"""
    WITH known AS (SELECT * FROM (VALUES {rows}) k(d, license_id)),
    docs AS (SELECT doc_id, sha256(array_to_string(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}]+'), ' ')) AS canonical_digest FROM documents)
    SELECT doc_id, canonical_digest, license_id, license_id IS NOT NULL AS is_license FROM docs LEFT JOIN known ON d = canonical_digest
    """
