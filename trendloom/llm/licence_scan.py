"""Licence texts by canonical digests, with DataFrame functions only.

A text is put into canonical form (lower case, copyright lines away, equivalent spellings as one, punctuation and white
space as single spaces), hashed whole and joined to the digests of known licences.

Defined results: a null or empty text, or one without a letter or digit, has a null digest and matches nothing; repeated
rows are looked up one by one, however many they are; an empty table gives no rows; other columns are ignored; texts are hashed whole. Where two
known licences have the same canonical form the first name is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known digests that are broadcast at most, of about 100 bytes each.
BROADCAST_ROWS = 200_000

# fixed values: equivalent spellings, as (pattern, replacement) on lower-case text; the same in Spark and DuckDB
SPELLINGS = (
    (r"licence", "license"),
    (r"(organ|author|recogn)is(e|ed|es|ing|ation)\b", r"$1iz$2"),
    (r"https://", "http://"),
    (r"&", " and "),
    (r"\bsub-license", "sublicense"),
    (r"\bnon-", "non"),
    (r"copyright (owner|holder)s?\b", "copyright holder"),
)
# of each spelling, strings of which a text that it changes has one: others need no pass of it
NEEDED = (("licence",), ("organis", "authoris", "recognis"), ("https://",), ("&",), ("sub-license",), ("non-",), ("copyright ",))
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(copyright[ \t]*(\(c\)|©)?|\(c\)|©)[ \t]*[0-9<\[{][^\n]*$"
RESERVED_LINE = r"(?m)^[ \t*#/;-]*all rights reserved\.?[ \t]*$"

# fixed values: texts of public licences
LICENCES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}
# fixed values: title lines that stand before a licence's text in many copies
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"),
    "Unlicense": ("The Unlicense",),
    "Zlib": ("zlib License", "The zlib/libpng License"),
}
# fixed values: digests of the canonical forms of longer public licence texts, whole and up to the end of their terms
DIGESTS = {
    "Apache-2.0": ("6ed31aab79be61ef3197a09ceec1934e9c9c99181c892d83a2af9d37096fbb4e", "f01b0685ee07aaeac9f18bf843c6c1ef9c939b5a7e3add0e6f0cd14352fc1477",),
    "Artistic-1.0": ("6af159a51212f3411b1e32eadc0440ba44a8f00111dd1b1786dbbe3486c79ab3",),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GFDL-1.2": ("f09d868220258c835b9348956de1db733edeba8357c27ed127935a2a664a48c7", "d2de41f78fbb7fa1b50ec20e3e5e400f6ffc0404352296de2818cda0722eba8b",),
    "GFDL-1.3": ("1ac19e04729a8d10da8a7868e60e7e0716b435c7c4726266dcea0ef04f2e10cd", "36ea1c73ef2572444dde652ed4904bd9a5d41f91b984c64d2b712e8362408811",),
    "GPL-1.0": ("b0b451371aa8b1fca2656e1c4adfd20298318818523446f7571338a5b932e23f", "59967477eafa5c999df136ce4729e98a72b0bde54cf327c732f475447201a313",),
    "GPL-2.0": ("c683128a79af968653f7a06709159e41adcfcb00ca1e8ab9ffa1d516dcf82123", "393d838a3fcdf4be802c0512341c9f00cc4c10adb56ebbf01687ff37049a19dd",),
    "GPL-3.0": ("ddbb62fb23d9487ee72673ed0bbcc3366b0624ce9ed3afbc7183586793e2f33a", "5a2a6aae036c121a65d207e9eb8ba9d60688f9f9c7c1a4089838710b428f1055",),
    "LGPL-2.0": ("0d5018d68c237045d8157a13086008a15e1e1b1e648c44d1a134b6162e472e89", "d5f3a7e7e4fbffa630628799c3078b9131d0226d4699e50782e97fee7295f0ae",),
    "LGPL-2.1": ("3380e877bb4517fa7c690361a3aa70de8179a65475a7f2a267cf51d1b2a55b88", "420d1dabf52ebc461a594c91c16e3dc9db40771bb679724eb4738248683ea3d4",),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("cbf655202fd8f29740e68b83df374d3f05f751c47cadc486986f8beadf230efa", "091cc447c6a549b189faa50c4875b009ba0a1e74ec0c0c880416855dbddb72dd",),
    "MPL-2.0": ("a1cefb162c09e7d1885eb8ae45993861b4e6772a4d401876ce07722374a92c9b", "fc35b4b9a8e190516371ae51559b5934080dbed4dc4a11ba5f77b156a9b846bb",),
}


def canonical(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), r"\r\n?", "\n")
    for pattern in (COPYRIGHT_LINE, RESERVED_LINE):
        t = F.regexp_replace(t, pattern, " ")
    t = F.regexp_replace(t, r"[ \t\n]+", " ")
    for (pattern, to), strings in zip(SPELLINGS, NEEDED, strict=True):
        t = _changed(t, strings, pattern, to)
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def _changed(text: Column, strings: tuple[str, ...], pattern: str, to: str) -> Column:
    """``regexp_replace`` for texts with one of the strings; the text is computed once."""

    def rule(t: Column) -> Column:
        has = F.contains(t, F.lit(strings[0]))
        for x in strings[1:]:
            has = has | F.contains(t, F.lit(x))
        return F.when(has, F.regexp_replace(t, pattern, to)).otherwise(t)

    return F.get(F.transform(F.array(text), rule), F.lit(0))


def digest(text: Column) -> Column:
    t = canonical(text)
    return F.when(t != "", F.sha2(t, 256))


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of all texts in this module, with and without title lines."""
    return sorted([*LICENCES.items(), *((name, f"{title}\n\n{LICENCES[name]}") for name, titles in TITLES.items() for title in titles)])


def known_licences(spark, licences: dict[str, str] | None = None) -> DataFrame:
    """(digest, licence), one row for each canonical form: of the texts given, or of this module's texts and digests."""
    texts = spark.createDataFrame(known_texts() if licences is None else sorted(licences.items()), "licence string, text string")
    rows = texts.select("licence", digest(F.col("text")).alias("digest")).filter("digest is not null")
    if licences is None:
        rows = rows.union(spark.createDataFrame([(name, d) for name, ds in DIGESTS.items() for d in ds], "licence string, digest string"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, digest, licence (null if none), is_licence. ``known`` has digest and licence, each digest once.

    Known digests are broadcast where their counted number is small. Beyond that, rows without a digest stay out of the
    shuffle, and a digest that very many rows have is a skewed key of a left join, which adaptive execution splits."""
    known = known_licences(docs.sparkSession) if known is None else known
    own = docs.select(F.col(id_col), digest(F.col(text_col)).alias("digest"))
    columns = [id_col, "digest", "licence", F.col("licence").isNotNull().alias("is_licence")]
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return own.join(F.broadcast(known), "digest", "left").select(*columns)
    found = own.filter("digest is not null").join(known, "digest", "left")
    none = own.filter("digest is null").withColumn("licence", F.lit(None).cast("string"))
    return found.select(*columns).unionByName(none.select(*columns))


def oracle_sql() -> str:
    """The same in DuckDB."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def form(x: str) -> str:
        t = f"regexp_replace(lower({x}), '\\r\\n?', chr(10), 'g')"
        for pattern in (COPYRIGHT_LINE, RESERVED_LINE):
            t = f"regexp_replace({t}, {quoted(pattern)}, ' ', 'g')"
        t = f"regexp_replace({t}, '[ \\t\\n]+', ' ', 'g')"
        for pattern, to in SPELLINGS:
            t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(to.replace('$', chr(92)))}, 'g')"
        return f"trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in known_texts())
    digests = ", ".join(f"({quoted(k)}, {quoted(d)})" for k, ds in DIGESTS.items() for d in ds)
    return f"""with texts as (select licence, sha256(c) digest from (select licence, {form("t")} c from (values {values}) v(licence, t)) where c <> '' union all select * from (values {digests}) w(licence, digest)),
known as (select digest, min(licence) licence from texts group by 1),
own as (select doc_id, case when c <> '' then sha256(c) end digest from (select doc_id, {form("text")} c from documents))
select doc_id, own.digest as digest, licence, licence is not null as is_licence from own left join known on own.digest = known.digest"""
