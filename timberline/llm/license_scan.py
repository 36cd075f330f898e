"""Licence scan: Dice coefficient of word bigrams against licence templates."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices and texts of well-known licences as their publishers word them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"),
    # Openings of the long licences, by which windows find their whole texts.
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
]

#: Least Dice coefficient of a match.
THRESHOLD = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _places(words: Column) -> Column:
    """Hashed bigram at each word but the last; none for fewer than two words."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                      F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _prepared(spark, templates, threshold: float) -> list[dict]:
    """Bigrams, size bounds and keys of each template (a fixed, short list).

    A text of A bigrams sharing o with a template of B has Dice 2o / (A + B); at the
    threshold t that asks for A between B t/(2-t) and B (2-t)/t, and for o of at least
    B t/(2-t), so that any B - o + 1 of the template's bigrams must hold a shared one:
    those, of the longest words, are its keys.
    """
    df = spark.createDataFrame(list(templates), "license string, text string")
    words = _words(F.col("text"))
    rows = df.select("license", words.alias("w"), _places(words).alias("places")).collect()
    out = []
    for r in rows:
        pairs = dict(zip(r["places"], zip(r["w"], r["w"][1:])))
        b = len(pairs)
        least = math.ceil(b * threshold / (2 - threshold) - 1e-9)
        by_length = sorted(pairs, key=lambda h: -len(pairs[h][0]) - len(pairs[h][1]))
        out.append({"license": r["license"], "places": r["places"], "grams": list(pairs), "keys": by_length[: b - least + 1],
                    "lo": least, "hi": math.floor(b * (2 - threshold) / threshold + 1e-9)})
    return out


def _longs(values) -> Column:
    """A constant array, as one small expression."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _known(templates: list[dict]) -> Column:
    """The templates as one constant array of structs."""
    return F.array(*[
        F.struct(
            F.lit(t["license"]).alias("license"), _longs(t["places"]).alias("places"), _longs(t["grams"]).alias("grams"),
            _longs(t["keys"]).alias("keys"), F.lit(t["lo"]).alias("lo"), F.lit(t["hi"]).alias("hi"),
        )
        for t in templates
    ])


def _dice(grams: Column, template: Column) -> Column:
    """Dice coefficient of a set of bigrams and a template, rounded; 0 outside the size bounds."""
    size = F.size(grams)
    value = 2.0 * F.size(F.array_intersect(grams, template["grams"])) / (size + F.size(template["grams"]))
    return F.when(size.between(template["lo"], template["hi"]), F.round(value, 6)).otherwise(F.lit(0.0))


def _best(found: Column, licenses: list[str], threshold: float) -> Column:
    """Of (license, dice, word) the best of each licence at the threshold or above; ties to the first word."""
    names = F.array(*[F.lit(k) for k in licenses])
    best = F.transform(names, lambda k: F.struct(
        k.alias("license"),
        F.array_max(F.transform(F.filter(found, lambda x: (x["license"] == k) & (x["dice"] >= threshold)),
                                lambda x: F.struct(x["dice"].alias("dice"), (-x["word"]).alias("back")))).alias("top"),
    ))
    return F.filter(best, lambda x: x["top"].isNotNull())


def _unit_matches(unit: Column, known: Column, licenses: list[str], threshold: float) -> Column:
    """(license, top) of a line or whole text as a set of bigrams."""
    return _let(
        F.array_distinct(_places(unit)),
        lambda grams: _best(
            F.transform(
                F.filter(known, lambda t: F.size(grams).between(t["lo"], t["hi"]) & F.arrays_overlap(grams, t["keys"])),
                lambda t: F.struct(t["license"].alias("license"), _dice(grams, t).alias("dice"), F.lit(0).alias("word")),
            ),
            licenses,
            threshold,
        ),
    )


def _window_matches(places: Column, known: Column, every: Column, licenses: list[str], threshold: float) -> Column:
    """(license, top) of the windows of a text that a shared bigram aligns with a template."""
    hits = F.filter(
        F.transform(places, lambda h, p: F.struct(h.alias("h"), p.alias("p"))), lambda x: F.array_contains(every, x["h"])
    )

    def starts(t: Column, hits: Column) -> Column:
        own = F.transform(t["places"], lambda h, q: F.struct(h.alias("h"), q.alias("q")))
        shared = F.filter(hits, lambda x: F.array_contains(t["grams"], x["h"]))
        return F.array_distinct(F.flatten(F.transform(
            shared, lambda x: F.transform(F.filter(own, lambda y: y["h"] == x["h"]), lambda y: x["p"] - y["q"])
        )))

    def windows(t: Column, hits: Column) -> Column:
        return F.transform(starts(t, hits), lambda s: _let(
            F.slice(places, F.greatest(s, F.lit(0)) + 1, F.size(t["places"]) + F.least(s, F.lit(0))),
            lambda w: F.struct(t["license"].alias("license"), _dice(F.array_distinct(w), t).alias("dice"),
                               F.greatest(s, F.lit(0)).alias("word")),
        ))

    held = F.filter(known, lambda t: F.arrays_overlap(places, t["keys"]))
    return _let(hits, lambda h: _let(
        F.filter(F.flatten(F.transform(held, lambda t: windows(t, h))), lambda x: x["dice"] >= threshold),
        lambda found: _best(found, licenses, threshold),
    ))


def scan(
    docs: DataFrame,
    templates=TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Licence notices in texts: among their lines, as whole texts, and in word windows.

    Texts are normalised (A-Z in lower case; words are runs of digits, letters a-z and
    non-ASCII characters) and compared by the Dice coefficient of their sets of word
    bigrams. A window has the words of one template and lies so that a bigram which the
    text shares with the template stands at its place there (cut at the text's ends); so
    notices are found that are wrapped over lines or share a line with other text. Only
    DataFrame functions, one pass, no shuffle: a few key bigrams of each template, without
    which the threshold can't be reached, leave few texts for the comparison, and size
    bounds few templates.

    Returns id, line (from 0; -1 for a whole text of several lines, -2 for a window), word
    (a window's first, from 0; else null), license, dice (rounded to 6 digits) for each
    licence reached, by its best template. Of the windows only the best of each licence
    counts (the first of equal ones), and only if no line and not the whole text reaches
    that licence. Null and empty texts and texts of one word match nothing; repeated rows
    give repeated results; null ids keep theirs; an empty table gives no rows.
    """
    prepared = _prepared(docs.sparkSession, templates, threshold)
    licenses = list(dict.fromkeys(t["license"] for t in prepared))
    known = _known(prepared)
    least = min(t["lo"] for t in prepared)
    keys = _longs(sorted({k for t in prepared for k in t["keys"]}))
    every = _longs(sorted({h for t in prepared for h in t["grams"]}))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.filter(F.exists(F.array(_words(text)), lambda w: F.arrays_overlap(_places(w), keys)))
    lines = F.split(text, "\n", -1)
    units = F.concat(
        F.transform(lines, lambda u, at: F.struct(at.alias("line"), _words(u).alias("words"))),
        F.when(F.size(lines) > 1, F.array(F.struct(F.lit(-1).alias("line"), _words(text).alias("words")))).otherwise(
            F.array().cast("array<struct<line:int,words:array<string>>>")
        ),
    )

    def matches(units: Column) -> Column:
        return F.flatten(F.transform(
            F.filter(units, lambda u: F.size(u["words"]) > least),
            lambda u: F.transform(_unit_matches(u["words"], known, licenses, threshold), lambda m: F.struct(
                u["line"].alias("line"), F.lit(None).cast("int").alias("word"), m["license"].alias("license"), m["top"]["dice"].alias("dice")
            )),
        ))

    def others(found: Column) -> Column:
        windows = _let(_words(text), lambda w: _let(
            _places(w), lambda places: _window_matches(places, known, every, licenses, threshold)
        ))
        return F.concat(found, F.transform(
            F.filter(windows, lambda m: ~F.exists(found, lambda f: f["license"] == m["license"])),
            lambda m: F.struct(F.lit(-2).alias("line"), (-m["top"]["back"]).alias("word"), m["license"].alias("license"), m["top"]["dice"].alias("dice")),
        ))

    return rows.select(F.col(id_col).alias("id"), F.explode(_let(matches(units), others)).alias("m")).select(
        F.col("id").alias(id_col), "m.line", "m.word", "m.license", "m.dice"
    )


def scan_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The scan for DuckDB: every unit, and every window that a shared bigram aligns, against every template."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quote(k)}, {quote(t)})" for i, (k, t) in enumerate(templates))
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
    dice = "round(2.0::DOUBLE * o / (a + b), 6)"
    return f"""
WITH templates(t, license, body) AS (VALUES {values}),
texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
lines AS (SELECT r, doc_id, body, string_split(body, chr(10)) AS parts FROM texts),
units AS (
  SELECT r, doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS unit FROM lines
  UNION ALL SELECT r, doc_id, -1, body FROM lines WHERE len(parts) > 1),
words AS (SELECT r, doc_id, line, {words.format('unit')} AS w FROM units),
grams AS (
  SELECT DISTINCT r, doc_id, line, unnest(list_zip(w[1:-2], w[2:])) AS g FROM words WHERE len(w) > 1),
sizes AS (SELECT r, line, count(*) AS a FROM grams GROUP BY ALL),
twords AS (SELECT t, license, {words.format('body')} AS w FROM templates),
tplaces AS (SELECT t, license, len(w) AS n, unnest(range(len(w) - 1)) AS q, unnest(list_zip(w[1:-2], w[2:])) AS g FROM twords),
tgrams AS (SELECT DISTINCT t, license, g FROM tplaces),
tsizes AS (SELECT t, count(*) AS b FROM tgrams GROUP BY t),
shared AS (SELECT r, doc_id, line, t, license, count(*) AS o FROM grams JOIN tgrams USING (g) GROUP BY ALL),
found AS (
  SELECT r, doc_id, line, license, max({dice}) AS dice FROM shared JOIN sizes USING (r, line) JOIN tsizes USING (t)
  WHERE {dice} >= {threshold} GROUP BY ALL),
whole AS (SELECT r, doc_id, {words.format('body')} AS w FROM texts),
places AS (
  SELECT r, doc_id, unnest(range(len(w) - 1)) AS p, unnest(list_zip(w[1:-2], w[2:])) AS g FROM whole WHERE len(w) > 1),
starts AS (SELECT DISTINCT r, t, n, p - q AS s FROM places JOIN tplaces USING (g)),
inside AS (
  SELECT x.r, x.t, x.s, p.doc_id, p.g FROM starts x JOIN places p ON p.r = x.r AND p.p >= x.s AND p.p <= x.s + x.n - 2),
windows AS (
  SELECT i.r, i.doc_id, i.t, i.s, count(DISTINCT i.g) AS a, count(DISTINCT k.g) AS o
  FROM inside i LEFT JOIN tgrams k ON k.t = i.t AND k.g = i.g GROUP BY ALL),
tops AS (
  SELECT r, doc_id, license, greatest(s, 0) AS word, {dice} AS dice
  FROM windows JOIN tsizes USING (t) JOIN (SELECT t, license FROM templates) USING (t) WHERE {dice} >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY r, license ORDER BY {dice} DESC, greatest(s, 0)) = 1)
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(NULL AS INTEGER) AS word, license, dice FROM found
UNION ALL
SELECT doc_id, -2, CAST(word AS INTEGER), license, dice FROM tops
WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.r = tops.r AND f.license = tops.license)
"""
