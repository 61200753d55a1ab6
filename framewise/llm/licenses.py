"""Licence scan: Dice coefficient over word bigrams, in DataFrame functions.

A document is compared in two ways.  Unit by unit: the whole text, its
paragraphs (parted by blank lines) and its lines.  And by word windows, which
find a licence inside a longer file however it is broken into paragraphs: runs
of as many words as the template has, starting at each bigram that the template
has too (fewer words at the end of the text).  Units and windows are normalised
to lower-case words, and their sets of word bigrams are compared with the
template's.

A Dice coefficient of at least t needs set sizes within a factor (2 - t) / t,
which drops most templates, and most units, before any set is compared.  A
window needs at least t n / (2 - t) of the template's n bigrams: a template of
which the whole text holds fewer is dropped, and a start is dropped unless so
many of the text's hits follow within the window.  Everything stays in one row
per document: no join, no shuffle, no Python.

Templates come as (id, text); there may be at most ``MOST_TEMPLATES``, since
they are part of the plan.

Defined cases: NULL or empty texts and units of fewer than two words match
nothing; repeated units count once; templates with equal scores are all
reported; a template's windows are reported by the best one (the first of
equals); repeated rows are separate; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words: lower-case ASCII letters, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_TEMPLATES = 1000
UNIT_MATCHES = "array<struct<unit:string,license:string,dice:double>>"

# Licences, their short forms and notices (fixed values).
WARRANTY = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
            "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
            "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
            "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
            "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
            "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
                   "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                   "See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
            "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
            "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
            "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
            "IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
            "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
            "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
            "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
            "THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
                     "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
                     "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + WARRANTY),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
                     "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
                     "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
                     "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission. " + WARRANTY),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                 "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
                 "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                  "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                  "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
                  "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of "
                  "the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
                  "relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS "
                  "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
                  "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY "
                  "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
                  "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
             "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
             "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
             "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
             "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
             "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
             "altered from any source distribution."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
                "https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]


def template_rows(templates: Sequence[tuple[str, str]], threshold: float) -> list[dict]:
    """Template bigrams, number of words, and the set sizes that can reach
    ``threshold``."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    out = []
    for name, text in templates:
        found = re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)}))
        grams = sorted({f"{a} {b}" for a, b in zip(found, found[1:])})
        if grams:
            n = len(grams)
            out.append({"id": name, "n": n, "words": len(found), "lo": math.ceil(threshold * n / (2 - threshold) - 1e-9),
                        "hi": math.floor((2 - threshold) * n / threshold + 1e-9), "grams": grams})
    return out


def _words(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _sequence(found: Column) -> Column:
    """Bigrams of a word array, in order and with repeats."""
    n = F.greatest(F.size(found) - 1, F.lit(0))
    return F.zip_with(F.slice(found, 1, n), F.slice(found, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def _dice(grams: Column, t: Column) -> Column:
    return F.lit(2.0) * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["n"])


def _in_units(rows: list[dict], threshold: float) -> Column:
    """Matches of ``units`` with ``held``: a unit's bigrams are the text's."""
    low, high = min((r["lo"] for r in rows), default=1), max((r["hi"] for r in rows), default=0)
    # a unit's words bound its bigrams from above; then the set itself is held against the bounds
    sets = F.filter(F.transform(F.filter(F.transform(F.col("units"), lambda u: F.struct(u.alias("unit"), _words(u).alias("words"))),
                                         lambda u: F.size(u["words"]) > F.lit(low)),
                                lambda u: F.struct(u["unit"].alias("unit"), F.array_distinct(_sequence(u["words"])).alias("grams"))),
                    lambda u: F.size(u["grams"]).between(low, high))

    def against(u: Column) -> Column:
        near = F.filter(F.col("held"), lambda t: F.size(u["grams"]).between(t["lo"], t["hi"]))
        return F.filter(F.transform(near, lambda t: F.struct(u["unit"].alias("unit"), t["id"].alias("license"), _dice(u["grams"], t).alias("dice"))),
                        lambda m: m["dice"] >= threshold)

    found = F.flatten(F.transform(sets, against))
    return F.when(F.size("held") > 0, found).otherwise(F.from_json(F.lit("[]"), UNIT_MATCHES))


def _in_windows(threshold: float) -> Column:
    """From ``held`` (templates with enough bigrams in the text), ``words`` and
    ``seq``: each template's best window."""
    seq = F.col("seq")
    placed = F.transform(F.col("held"), lambda t: F.struct(t.alias("t"), F.filter(
        F.transform(seq, lambda g, i: F.when(F.array_contains(t["grams"], g), i)), lambda i: i.isNotNull()).alias("hits")))
    started = F.transform(placed, lambda x: F.struct(x["t"].alias("t"), F.filter(
        x["hits"], lambda p, j: F.get(x["hits"], j + x["t"]["lo"] - 1) <= p + x["t"]["words"] - 2).alias("starts")))
    best = F.transform(started, lambda x: F.struct(x["t"].alias("t"), F.array_max(F.transform(x["starts"], lambda p: F.struct(
        _dice(F.array_distinct(F.slice(seq, p + 1, x["t"]["words"] - 1)), x["t"]).alias("dice"), (-p).alias("back")))).alias("w")))
    found = F.filter(best, lambda x: x["w"]["dice"] >= threshold)
    return F.transform(found, lambda x: F.struct(
        (-x["w"]["back"]).cast("long").alias("start"), x["t"]["words"].cast("long").alias("n_words"), x["t"]["id"].alias("license"),
        x["w"]["dice"].alias("dice"), F.array_join(F.slice(F.col("words"), 1 - x["w"]["back"], x["t"]["words"]), " ").alias("unit")))


def license_matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Per document row: doc_id, n_units (distinct units compared), matches, an
    array of (unit, license, dice) with dice at least ``threshold``, and
    windows, an array of (start, n_words, license, dice, unit): each template's
    best window, ``start`` counted in words from 0, ``unit`` its normalised
    words."""
    rows = template_rows(templates, threshold)
    known = F.from_json(F.lit(json.dumps(rows)), "array<struct<id:string,n:int,words:int,lo:int,hi:int,grams:array<string>>>")
    every = F.from_json(F.lit(json.dumps(sorted({g for r in rows for g in r["grams"]}))), "array<string>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    units = F.array_distinct(F.concat(F.array(text), F.split(text, r"\n[ \t\r]*\n"), F.split(text, r"\n")))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), units.alias("units"), _words(text).alias("words"))
    grams = read.withColumn("seq", _sequence(F.col("words")))
    some = grams.withColumn("some", F.array_intersect("seq", every))
    least = min((r["lo"] for r in rows), default=1)
    # the guard saves most texts the templates; it also names ``some`` twice, so that the optimizer keeps it a
    # column of its own instead of computing it again for every template
    held = some.withColumn("held", F.when(F.size("some") >= least, F.filter(
        known, lambda t: F.size(F.array_intersect(F.col("some"), t["grams"])) >= t["lo"])).otherwise(F.slice(known, 1, 0)))
    return held.select("doc_id", F.size("units").cast("long").alias("n_units"), _in_units(rows, threshold).alias("matches"),
                       _in_windows(threshold).alias("windows"))
