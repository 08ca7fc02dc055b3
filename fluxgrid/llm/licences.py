"""Licence scans: canonical texts hashed and joined to known licence digests, with DataFrame functions only.

A canonical text is in lower case, without copyright lines, punctuation and comment marks, with equivalent
spellings made one and single spaces.  Whole texts and, as notices, single lines are looked up by digest.  Short
licences and notices are known by their words, long ones by the digest of their canonical text.  A line that ends
in "All rights reserved" is a notice of its own and no part of the whole text.

Cases: null and empty texts have the digest of the empty text and match nothing; very long texts are
digested whole; every input row gives one result row, repeated ids and rows included; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.llm.common import id_text

#: (pattern, replacement) in order, valid for Java and RE2; they run on lower-case text.
STEPS = (
    (r"(?m)^[^\n]*all rights reserved[^\p{L}\p{N}\n]*$", "all rights reserved"),
    (r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b[^\n]*(?:\(c\)|©|[0-9][0-9][0-9][0-9])|\(c\)|©)[^\n]*$", ""),
    (r"[^\p{L}\p{N}\n]+", " "),
    (r"\b(sub|)licenc(e|ed|es|ing)\b", "${1}licens${2}"),
    (r"\b(author|organ|recogn|util|initial|summar|custom|special)is(e|ed|es|er|ers|ing|ation|ations)\b", "${1}iz${2}"),
    (r"\b(judg|acknowledg)ement(s?)\b", "${1}ment${2}"),
    (r"\b(fav|hon|col|behavi|lab|endeav)our", "${1}or"),
    (r"\bhttps\b", "http"),
    (r"\bcopyright owner\b", "copyright holder"),
    (r"\bnon commercial\b", "noncommercial"),
    (r"\bsub licens", "sublicens"),
    (r"\bper cent\b", "percent"),
)
#: Steps from a canonical text with lines to one line.
JOIN = ((r"(?m)^all rights reserved$", ""), (r"[ \n]+", " "))

# Public licence texts and notices by SPDX identifier.
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so"""
MIT_KEEP = """, subject to the following conditions: The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software"""
MIT_TAIL = """. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
MIT = MIT_GRANT + MIT_KEEP + MIT_TAIL
GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted"""
NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KEEP_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:"""
BSD_CLAUSES = (
    """Redistributions of source code must retain the above copyright notice, this list of conditions and the
    following disclaimer.""",
    """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
    following disclaimer in the documentation and/or other materials provided with the distribution.""",
    """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
    promote products derived from this software without specific prior written permission.""",
)
BSD_TAIL = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that
you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered
from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
author or authors of this software dedicate any and all copyright interest in the software to the public domain.
We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties
to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software
and this entire statement, including the above license grant, this restriction and the following disclaimer, must
be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless
such copies or derivative works are solely in the form of machine-executable object code generated by a source
language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND
NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY
DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def bsd(clauses: int, marks: tuple[str, ...]) -> str:
    """Text with so many clauses, each behind its mark."""
    return " ".join([BSD_HEAD, *[f"{m} {c}" for m, c in zip(marks, BSD_CLAUSES[:clauses])], BSD_TAIL])


#: (licence, titles that may stand before the text, forms of the text)
WHOLE = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"), (MIT,)),
    ("MIT-0", ("MIT No Attribution", "MIT-0"), (MIT_GRANT + MIT_TAIL,)),
    ("ISC", ("ISC License", "The ISC License"), (GRANT + KEEP_NOTICE + " " + NO_WARRANTY,)),
    ("0BSD", ("Zero-Clause BSD", "BSD Zero Clause License"), (GRANT + ". " + NO_WARRANTY,)),
    *[
        (f"BSD-{n}-Clause", (f"BSD {n}-Clause License", f"The {n}-Clause BSD License", f"The BSD {n}-Clause License", name), forms)
        for n, name in ((2, "Simplified BSD License"), (3, "New BSD License"))
        for forms in [tuple(bsd(n, m) for m in (("1.", "2.", "3."), ("*", "*", "*"), ("(a)", "(b)", "(c)")))]
    ],
    ("Zlib", ("zlib License", "The zlib License", "zlib/libpng License"), (ZLIB,)),
    *[("Unlicense", ("The Unlicense", "Unlicense"), (UNLICENSE + end,)) for end in ("", " For more information, please refer to <https://unlicense.org>", " For more information, please refer to <https://unlicense.org/>")],
    ("BSL-1.0", ("Boost Software License - Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"), (BOOST,)),
)
#: (licence, how a notice calls it)
NAMES = (
    ("MIT", "the MIT License"), ("Apache-2.0", "the Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"),
    ("GPL-2.0", "the GNU General Public License, version 2"), ("GPL-3.0", "the GNU General Public License, version 3"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"), ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"), ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    ("BSD-2-Clause", "the BSD 2-Clause License"), ("BSD-3-Clause", "the BSD 3-Clause License"), ("ISC", "the ISC License"),
    ("Unlicense", "the Unlicense"), ("Zlib", "the zlib License"), ("BSL-1.0", "the Boost Software License, Version 1.0"), ("CC0-1.0", "CC0 1.0"),
    *[(f"CC-{k}-{v}", f"CC {k} {v}") for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")],
)
VERBS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This software is licensed under")
#: SPDX identifiers of lines, without and with the endings of the GNU licences.
SPDX = sorted({k for k, _ in NAMES} | {k for k, *_ in WHOLE})
KNOWN = (
    *[(k, f"{title} {text}") for k, titles, texts in WHOLE for text in texts for title in ("", *titles)],
    *[(k, f"{verb} {name}.") for k, name in NAMES for verb in VERBS],
    *[(k, f"SPDX-License-Identifier: {k}{end}") for k in SPDX for end in (("", "-only", "-or-later") if "GPL" in k else ("",))],
)
# SHA-256 of canonical texts of long public licences, whole and up to the end of their terms.
DIGESTS = (
    ("LicenseRef-All-Rights-Reserved", "2dbf9640a42c64e0012c55205e2158a6d895645a1f6934972c619f70b637cf4d"),
    ("Apache-2.0", "84ed161685d232dab5187a7a7101279668d583e8fcead2d41433e4fd4a1dbe68"),
    ("Apache-2.0", "0b8c1a9e0ec99ab3b27e123e667fe4843df4dd7e6c667ccdc634dd6878c5dd6c"),
    ("Apache-2.0", "67e6c9864a42fc797b7f0244a9e5402dbe5d51fd1cbfdbca4f454f8892ab077d"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-1.1", "fb84cdb331a381edd811d3017d5400ac2c74d9d8470038f79413ac78b10c2a59"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("MPL-2.0", "2cec6f733aa157c2d0b72e9669f75ca354f332218fcb5a3a885931f385272a04"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.2", "1dbd72b6f124a1058e786b52a9d4afe44543b834a3aa44faf6c18b747c9de8e2"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GFDL-1.3", "911b9e1b02471fa9b19ec482d019380acd7e0fef00ffbd4395e8813b06533fe7"),
)


def canonical_lines(text: Column) -> Column:
    """Canonical text that still has its line breaks."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, new.replace("${1}", "$1").replace("${2}", "$2"))
    return out


def one_line(text: Column) -> Column:
    """Words of a canonical text, one space between."""
    for pattern, new in JOIN:
        text = F.regexp_replace(text, pattern, new)
    return F.btrim(text)


def digest(canonical: Column) -> Column:
    """Digest of a canonical text."""
    return F.sha2(canonical, 256)


def known_digests(spark: SparkSession, known=KNOWN, digests=DIGESTS) -> DataFrame:
    """known (digest), licence of the known texts; a digest has one licence."""
    pairs = lambda rows, name: F.array(*[F.struct(F.lit(k).alias("licence"), F.lit(t).alias(name)) for k, t in rows])
    texts = spark.range(1).select(F.inline(pairs(known, "text")))
    rows = texts.select("licence", digest(one_line(canonical_lines(F.col("text")))).alias("known"))
    if digests:
        rows = rows.union(spark.range(1).select(F.inline(pairs(digests, "known"))))
    return rows.groupBy("known").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, licence (whole text, null if unknown), notices (licences of single lines), n_notices.

    One row for each row of ``docs``; lines are matched by a hash join and counted per document before the
    shuffle, so no text moves.
    """
    table = known_digests(docs.sparkSession) if known is None else known
    if known is None:
        table = F.broadcast(table)  # a fixed table of a few rows
    rows = id_text(docs, id_col, text_col).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", canonical_lines(F.col("text")).alias("text")
    )
    units = rows.select(
        "row",
        "doc_id",
        F.posexplode(F.concat(F.array(one_line(F.col("text"))), F.split("text", "\n"))).alias("line", "text"),
    )
    found = (
        units.withColumn("text", F.when(F.col("line") == 0, F.col("text")).otherwise(F.btrim("text")))
        # of the lines only those with text can match; the whole text always stays
        .where((F.col("line") == 0) | (F.col("text") != ""))
        .select("row", "doc_id", "line", digest(F.col("text")).alias("digest"))
        .join(table, F.col("digest") == F.col("known"), "left")
        .where((F.col("line") == 0) | F.col("licence").isNotNull())
    )
    whole, notice = F.col("line") == 0, (F.col("line") > 0) & F.col("licence").isNotNull()
    return (
        found.groupBy("row", "doc_id")
        .agg(
            F.max(F.when(whole, F.col("digest"))).alias("digest"),
            F.max(F.when(whole, F.col("licence"))).alias("licence"),
            F.collect_set(F.when(notice, F.col("licence"))).alias("set"),
            F.count(F.when(notice, F.lit(1))).alias("n_notices"),
        )
        .select("doc_id", "digest", "licence", F.array_join(F.sort_array("set"), ",").alias("notices"), "n_notices")
    )


def sql() -> str:
    """The scan of ``documents`` in SQL."""
    def canon(text: str) -> str:
        out = f"lower(coalesce({text}, ''))"
        for pattern, new in STEPS:
            new = new.replace("${1}", "\\1").replace("${2}", "\\2")
            out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
        return out

    def line(text: str) -> str:
        for pattern, new in JOIN:
            text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
        return f"trim({text})"

    quoted = lambda rows: ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in rows)
    return f"""
    WITH known AS (
      SELECT known, min(licence) AS licence FROM (
        SELECT sha256({line(canon("t"))}) AS known, l AS licence FROM (VALUES {quoted(KNOWN)}) AS v(l, t)
        UNION ALL SELECT d, l FROM (VALUES {quoted(DIGESTS)}) AS w(l, d)) GROUP BY 1
    ), base AS (SELECT row_number() OVER () AS rid, doc_id, {canon("text")} AS text FROM documents
    ), split AS (SELECT rid, trim(unnest(string_split(text, chr(10)))) AS text FROM base
    ), notes AS (
      SELECT rid, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n
      FROM split JOIN known ON sha256(split.text) = known WHERE split.text <> '' GROUP BY rid
    )
    SELECT doc_id, sha256({line("base.text")}) AS digest, known.licence AS licence,
      coalesce(notes.notices, '') AS notices, coalesce(notes.n, 0)::BIGINT AS n_notices
    FROM base LEFT JOIN known ON sha256({line("base.text")}) = known.known LEFT JOIN notes USING (rid)"""
