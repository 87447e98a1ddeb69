"""Licence scans by the Dice coefficient over word bigrams, in DataFrame functions only.

Units of a text are its lines, its paragraphs and the whole. A unit is lower-cased, all but letters and digits become
spaces, and its set of word bigrams is compared with each template's: 2 * common / (unit + template). At a threshold t a
unit of n bigrams can only match templates of n * t / (2 - t) to n * (2 - t) / t bigrams, so most units and most templates
of the others are skipped without looking at a bigram; a unit must also hold one of the few bigrams of some template that
no match can do without. All of it is one projection: no shuffle, no join, rows stay as they are.

scan_license_windows also compares every run of consecutive words, over line and paragraph ends, so a licence of several
paragraphs inside a longer file and a notice inside a longer line are found.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
SLACK = 1e-9  # for bounds that meet a whole number
# Names and standard wording of public licences and notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-text": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "All-Rights-Reserved": "All rights reserved.",
}


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    out = {}
    for name, text in templates.items():
        words = re.sub(r"[\W_]+", " ", text.lower()).split()
        out[name] = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
    return out


def needed_bigrams(bigrams: dict[str, list[str]], threshold: float) -> list[str]:
    """A set of which every match holds at least one: of each template, its rarest bigrams among the templates, as many
    as a match may lack and one more."""
    times: dict[str, int] = {}
    for own in bigrams.values():
        for b in own:
            times[b] = times.get(b, 0) + 1
    out: dict[str, None] = {}
    for own in bigrams.values():
        least = math.ceil(threshold * len(own) / (2 - threshold) - SLACK)  # common bigrams of any match
        for b in sorted(own, key=lambda b: times[b])[: len(own) - max(1, least) + 1]:
            out[b] = None
    return list(out)


def license_hits(text: Column, templates: dict[str, str], threshold: float = THRESHOLD) -> Column:
    """All matches of a text: array of (dice, license, unit), one for each unit and template."""
    bigrams = template_bigrams(templates)
    low, high = threshold / (2 - threshold) - SLACK, (2 - threshold) / threshold + SLACK
    largest, smallest = max(map(len, bigrams.values())), min(map(len, bigrams.values()))
    most, least = int(largest * high) + 1, max(1, int(smallest * low))
    known = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(len(own)).alias("n"), F.array(*map(F.lit, own)).alias("own")) for name, own in bigrams.items()])
    needed = F.array(*map(F.lit, needed_bigrams(bigrams, threshold)))

    whole = F.coalesce(text, F.lit(""))
    paragraphs = F.filter(F.split(whole, r"\n[\x20\t\r]*\n"), lambda p: F.instr(p, "\n") > 0)
    units = F.array_distinct(F.concat(F.split(whole, "\n"), paragraphs, F.array(whole)))

    def words(unit: Column) -> Column:
        return F.split(F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " ")), " ")

    def pairs(w: Column) -> Column:
        return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))

    # Before bigrams are made: there are no more distinct ones than words, and no fewer than distinct words but one, as each
    # word other than the first ends one. So long units are looked at further only if they repeat few words.
    few = lambda w: (F.size(w) <= most + 1) | (F.size(F.array_distinct(w)) <= most + 1)
    long_enough = F.filter(F.transform(units, lambda u: F.struct(u.alias("unit"), words(u).alias("words"))), lambda u: (F.size(u["words"]) > least) & few(u["words"]))
    sized = F.transform(long_enough, lambda u: F.struct(u["unit"].alias("unit"), pairs(u["words"]).alias("own")))
    able = F.filter(sized, lambda u: (F.size(u["own"]) >= least) & (F.size(u["own"]) <= most) & F.arrays_overlap(u["own"], needed))
    scored = F.transform(
        able,
        lambda u: F.transform(
            F.filter(known, lambda t: (F.size(u["own"]) >= t["n"] * low) & (F.size(u["own"]) <= t["n"] * high)),
            lambda t: F.struct((2.0 * F.size(F.array_intersect(u["own"], t["own"])) / (F.size(u["own"]) + t["n"])).alias("dice"), t["license"].alias("license"), u["unit"].alias("unit")),
        ),
    )
    return F.filter(F.flatten(scored), lambda h: h["dice"] >= threshold)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Adds license_hits, license (of the highest Dice; ties: the first name), dice (0 without a hit) and n_hits.

    Whole texts of any length are scanned; null texts have no hits. Rows and other columns stay; columns that have one of
    the new names are replaced.
    """
    docs = docs.drop("license_hits", "license", "dice", "n_hits")
    found = docs.withColumn("license_hits", license_hits(F.col(text), templates or TEMPLATES, threshold))
    best = F.array_min(F.transform("license_hits", lambda h: F.struct((-h["dice"]).alias("d"), h["license"].alias("license"))))
    return found.withColumn("__best", best).select("*", F.col("__best.license").alias("license"), F.coalesce(-F.col("__best.d"), F.lit(0.0)).alias("dice"), F.size("license_hits").cast("long").alias("n_hits")).drop("__best")


def window_hits(text: Column, templates: dict[str, str], threshold: float = THRESHOLD) -> Column:
    """The best run of words for each template: array of (dice, license).

    Runs are all of consecutive words with at most n * (2 - t) / t bigrams, of a template's n. The best of them starts and
    ends with a bigram of the template, as others could be cut off, so only such runs are compared, and only in texts
    that hold as many of its bigrams as any match must.
    """
    bigrams = template_bigrams(templates)
    every = F.array(*map(F.lit, dict.fromkeys(b for own in bigrams.values() for b in own)))
    least, most = lambda n: max(1, math.ceil(threshold * n / (2 - threshold) - SLACK)), lambda n: int(n * (2 - threshold) / threshold + SLACK)
    known = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(len(own)).alias("n"), F.lit(least(len(own))).alias("least"), F.lit(most(len(own))).alias("most"), F.array(*map(F.lit, own)).alias("own")) for name, own in bigrams.items()])
    w = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    pairs = F.transform(F.array(w), lambda v: F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    held = F.transform(pairs, lambda p: F.struct(p.alias("p"), F.array_intersect(p, every).alias("seen")))

    def best(p: Column, t: Column, marks: Column) -> Column:
        def dice(a: Column, b: Column) -> Column:
            run = F.slice(p, a, b - a + 1)
            return 2.0 * F.size(F.array_intersect(run, t["own"])) / (F.size(F.array_distinct(run)) + t["n"])

        ends = lambda a, k: F.filter(F.slice(marks, k + t["least"], t["most"]), lambda b: b - a < t["most"])
        return F.array_max(F.transform(marks, lambda a, k: F.array_max(F.transform(ends(a, k), lambda b: dice(a, b)))))

    def found(d: Column) -> Column:
        able = F.filter(known, lambda t: F.size(F.array_intersect(t["own"], d["seen"])) >= t["least"])
        at = lambda t: F.filter(F.sequence(F.lit(1), F.size(d["p"])), lambda i: F.array_contains(t["own"], F.element_at(d["p"], i)))
        marked = F.transform(able, lambda t: F.struct(t.alias("t"), at(t).alias("marks")))
        return F.transform(marked, lambda m: F.struct(best(d["p"], m["t"], m["marks"]).alias("dice"), m["t"]["license"].alias("license")))

    return F.filter(F.flatten(F.transform(held, found)), lambda h: h["dice"] >= threshold)


def scan_license_windows(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Adds license, dice and n_hits as scan_licenses does, over its units and all runs of words; n_hits counts licences."""
    docs = docs.drop("license", "dice", "n_hits")
    templates = templates or TEMPLATES
    units = F.transform(license_hits(F.col(text), templates, threshold), lambda h: F.struct(h["dice"].alias("dice"), h["license"].alias("license")))
    found = docs.withColumn("__hits", F.concat(units, window_hits(F.col(text), templates, threshold)))
    best = F.array_min(F.transform("__hits", lambda h: F.struct((-h["dice"]).alias("d"), h["license"].alias("license"))))
    names = F.array_distinct(F.transform("__hits", lambda h: h["license"]))
    found = found.select(*[F.col(f"`{c}`") for c in docs.columns], best.alias("__best"), F.size(names).cast("long").alias("n_hits"))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__best.license").alias("license"), F.coalesce(-F.col("__best.d"), F.lit(0.0)).alias("dice"), "n_hits")


def sql(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in SQL, every unit against every template."""
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in templates.items())
    spaced = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return rf"""
WITH names(license, body) AS (VALUES {values}),
known AS (SELECT license, {pairs.format("w")} AS own FROM (SELECT license, string_split({spaced.format("body")}, ' ') AS w FROM names)),
whole AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
units AS (
  SELECT DISTINCT r, u FROM (
    SELECT r, unnest(string_split(t, chr(10))) AS u FROM whole
    UNION ALL SELECT r, unnest(list_filter(regexp_split_to_array(t, '\n[\x20\t\r]*\n'), lambda p: contains(p, chr(10)))) FROM whole
    UNION ALL SELECT r, t FROM whole)),
sized AS (SELECT r, {pairs.format("w")} AS own FROM (SELECT r, string_split({spaced.format("u")}, ' ') AS w FROM units)),
scored AS (
  SELECT r, license, 2.0::DOUBLE * len(list_intersect(s.own, k.own)) / (len(s.own) + len(k.own)) AS dice
  FROM sized s JOIN known k ON len(s.own) BETWEEN len(k.own) * {threshold / (2 - threshold) - SLACK}::DOUBLE AND len(k.own) * {(2 - threshold) / threshold + SLACK}::DOUBLE),
hits AS (SELECT * FROM scored WHERE dice >= {threshold}::DOUBLE),
best AS (SELECT r, first(license ORDER BY dice DESC, license) AS license, max(dice) AS dice, count(*) AS n_hits FROM hits GROUP BY r)
SELECT doc_id, license, coalesce(dice, 0.0) AS dice, coalesce(n_hits, 0) AS n_hits FROM whole LEFT JOIN best USING (r)
"""


def windows_sql(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """scan_license_windows in SQL: the hits of sql(), and runs between any two bigrams of a template."""
    units = sql(templates, threshold).rsplit("best AS (", 1)[0]
    return rf"""{units}
runs AS (SELECT r, {_RUN.format("w")} AS p FROM (SELECT r, string_split(trim(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM whole)),
placed AS (SELECT r, unnest(p) AS b, generate_subscripts(p, 1) AS i FROM runs),
wanted AS (SELECT license, len(own) AS n, unnest(own) AS b FROM known),
marks AS (SELECT r, license, n, i, row_number() OVER (PARTITION BY r, license ORDER BY i) AS k FROM placed JOIN wanted USING (b)),
able AS (
  SELECT x.r, x.license, x.n, x.i AS a, y.i AS z FROM marks x JOIN marks y ON x.r = y.r AND x.license = y.license
  AND y.k - x.k + 1 >= x.n * {threshold / (2 - threshold)}::DOUBLE - {SLACK}::DOUBLE AND y.i - x.i + 1 <= x.n * {(2 - threshold) / threshold}::DOUBLE + {SLACK}::DOUBLE),
compared AS (SELECT able.r, able.license, 2.0::DOUBLE * len(list_intersect(p[a:z], own)) / (len(list_distinct(p[a:z])) + n) AS dice FROM able JOIN runs USING (r) JOIN known USING (license)),
every AS (SELECT r, license, dice FROM hits UNION ALL SELECT r, license, dice FROM compared WHERE dice >= {threshold}::DOUBLE),
best AS (SELECT r, first(license ORDER BY dice DESC, license) AS license, max(dice) AS dice, count(DISTINCT license) AS n_hits FROM every GROUP BY r)
SELECT doc_id, license, coalesce(dice, 0.0) AS dice, coalesce(n_hits, 0) AS n_hits FROM whole LEFT JOIN best USING (r)
"""


_RUN = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
