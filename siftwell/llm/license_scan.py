"""License scans by Dice coefficient over word bigrams [native].

Single units of a text are the whole text, its paragraphs, lines and sentences.  For a
template that no single unit matches, runs are units too: consecutive words across at least
one end of a line or sentence, so a notice in its usual layout (wrapped lines, several
paragraphs) is found wherever it stands in a text.  A run has (2 - least) / least times as
many bigrams as the template at most, repeats counted.  A unit and a template are normalised alike (A-Z lower-cased, all but letters and digits to one blank)
and compared by the Dice coefficient of their sets of word bigrams, 2 |A n B| / (|A| + |B|).

A Dice of ``least`` is reached only if |B| * least / (2 - least) <= |A| <= |B| * (2 - least)
/ least: these size bounds prune templates for a unit.  It also needs so many common
bigrams that any (|B| - that number + 1) bigrams of the template include one of them; texts
without any such bigram of any template are passed by with one pattern search.  Both are
exact: no match of ``least`` or more is lost.  Runs are tried only in texts that hold the
needed number of the template's bigrams, from places with so many of them within reach.

Templates are a short fixed table, so they are literals of the plan; texts never move.

Defined results
- null or empty text, and units of fewer than two words: no match.
- A template adds its best run alone to the matches, and none if a single unit matches it or a
  template that is like it (a Dice of ``least`` or more between them), or if such a template
  has a higher run.
- Of equal scores the first template in the table wins, for a text the highest score.
- One row for each row of the input, repeats and null ids included; other columns are
  ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, LOWER

# Public licence notices.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. "
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
    ),
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. "
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "CC0-1.0-notice": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. "
        "You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>."
    ),
}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def bounds(size: int, least: float) -> tuple[int, int]:
    """Sizes of a unit that can reach ``least`` against a template of ``size`` bigrams."""
    return math.ceil(size * least / (2 - least) - 1e-9), math.floor(size * (2 - least) / least + 1e-9)


def needed(size: int, least: float) -> int:
    """Common bigrams without which no unit reaches ``least`` against ``size`` bigrams."""
    return math.ceil(least / 2 * (bounds(size, least)[0] + size) - 1e-9)


def signature(grams: list[str], least: float) -> list[str]:
    """So many bigrams of a template that any unit that reaches ``least`` holds one of them.

    The rarest-looking (longest) ones, as these pass the fewest texts.
    """
    return sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - needed(len(grams), least) + 1]


def any_of(words: list[str]) -> str:
    """A pattern of letters, digits and blanks that finds any of the words: a tree, so few of them are tried at a place."""
    heads = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    ends = heads.pop("", None) is not None
    branches = [c + any_of(rest) for c, rest in heads.items()]
    tree = branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)})" if branches else ""
    return f"{tree}?" if ends and branches else tree


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " ")


def bigrams(text: Column) -> Column:
    words = F.split(F.trim(normalised(text)), " ")
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(pairs))


def placed_bigrams(text: Column) -> Column:
    """(g, prev, cross) of each bigram in order: itself, where it stood before, whether a line or sentence ends in it."""
    # A word that a line or sentence ends with keeps one line feed.
    lines = F.regexp_replace(F.translate(text, UPPER, LOWER), r"[.!?]\s+", "\n")
    marked = F.regexp_replace(F.regexp_replace(lines, r"[^a-z0-9\n]+", " "), r" ?\n[ \n]*", "\n ")
    words = F.split(F.regexp_replace(marked, r"^[ \n]+|[ \n]+$", ""), " ")
    bare = F.transform(words, lambda w: F.rtrim(w, F.lit("\n")))
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(bare, 1, n), F.slice(bare, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    # Equal bigrams are neighbours once sorted.
    by_gram = F.array_sort(F.transform(pairs, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    before = F.concat(F.array(F.lit(None).cast("struct<g:string,i:int>")), by_gram)
    linked = F.zip_with(by_gram, F.slice(before, 1, F.size(by_gram)), lambda x, y: F.struct(x["i"].alias("i"), x["g"].alias("g"), F.when(x["g"] == y["g"], y["i"]).otherwise(-1).alias("prev")))
    ends = F.transform(F.slice(words, 1, n), lambda w: F.endswith(w, F.lit("\n")))
    return F.zip_with(F.array_sort(linked), ends, lambda x, e: F.struct(x["g"].alias("g"), x["prev"].alias("prev"), e.alias("cross")))


def best_run(placed: Column, own: list[str], length: int, least: float) -> Column:
    """The highest Dice of a run against a template of the bigrams ``own``, ``length`` with repeats; 0 if none."""
    reach, common = bounds(length, least)[1], needed(len(own), least)
    seq = F.transform(placed, lambda x: F.struct(x["prev"].alias("prev"), x["cross"].alias("cross"), x["g"].isin(own).alias("hit")))

    def of_text(seq: Column) -> Column:
        at = F.filter(F.transform(seq, lambda x, i: F.when(x["hit"], i)), lambda i: i.isNotNull())
        return of_places(seq, at)

    def of_places(seq: Column, at: Column) -> Column:
        # The best run starts and ends in the template; as many more of its bigrams must follow within reach.
        after = F.slice(at, common, F.greatest(F.size(at) - common + 1, F.lit(0)))
        starts = F.zip_with(F.slice(at, 1, F.size(after)), after, lambda i, j: F.when(j - i < reach, i))
        return F.coalesce(F.array_max(F.transform(F.filter(starts, lambda i: i.isNotNull()), lambda i: of_start(seq, i))), F.lit(0.0))

    def of_start(seq: Column, i: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            new = x["prev"] < i
            size, shared = s["size"] + new.cast("int"), s["shared"] + (new & x["hit"]).cast("int")
            cross = s["cross"] | x["cross"]
            dice = F.when(x["hit"] & cross, 2.0 * shared / (size + len(own))).otherwise(0.0)
            return F.struct(size.alias("size"), shared.alias("shared"), cross.alias("cross"), F.greatest(s["best"], dice).alias("best"))

        start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("shared"), F.lit(False).alias("cross"), F.lit(0.0).alias("best"))
        return F.aggregate(F.slice(seq, i + 1, F.lit(reach)), start, step, lambda s: s["best"])

    # A transform over one element binds the sequence, so that it is made once.
    return F.transform(F.array(seq), of_text)[0]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, license (null: none), dice, n_matches.

    n_matches: distinct units that match a template.
    """
    templates = TEMPLATES if templates is None else templates
    table = {name: bigrams_of(text) for name, text in templates.items()}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    marks = sorted({g for grams in table.values() for g in signature(grams, least)})
    pattern = f"(?:^| ){any_of(marks)}(?: |$)"
    widest = max(bounds(len(g), least)[1] for g in table.values())

    units = F.array_distinct(F.concat(F.array("t"), F.split("t", r"\n\s*\n"), F.split("t", r"\n"), F.split("t", r"[.!?]\s+|\n")))
    # Texts that no mark is in skip the units, and units that no mark is in or that are too long skip the bigrams.
    units = F.when(normalised(F.col("t")).rlike(pattern), units).otherwise(F.array().cast("array<string>"))
    units = F.filter(units, lambda u: normalised(u).rlike(pattern))

    def matches(grams: Column) -> Column:
        """The best (dice, -place, name) of a unit's bigrams, null below ``least``."""
        found = []
        for place, (name, own) in enumerate(table.items()):
            low, high = bounds(len(own), least)
            shared = F.size(F.array_intersect(grams, F.array(*[F.lit(g) for g in own])))
            dice = 2.0 * shared / (F.size(grams) + len(own))
            found.append(F.when(F.size(grams).between(low, high), F.when(dice >= least - 1e-12, F.struct(dice.alias("dice"), F.lit(-place).alias("place"), F.lit(name).alias("name")))))
        return F.greatest(*found)

    scored = rows.select("doc_id", "t", units.alias("units")).withColumn("marked", F.size("units") > 0)
    scored = scored.withColumn("grams", F.transform("units", bigrams))
    scored = scored.withColumn("grams", F.filter("grams", lambda g: F.size(g).between(1, widest)))
    scored = scored.withColumn("hits", F.filter(F.transform("grams", matches), lambda h: h.isNotNull()))
    # A text without a mark has no run that matches.
    scored = scored.withColumn("all", F.when(F.col("marked"), bigrams(F.col("t"))))
    # Templates that differ by a clause: what matches one of them as a unit is no run of the other.
    alike = {a: [b for b, y in table.items() if 2 * len(set(x) & set(y)) >= least * (len(x) + len(y))] for a, x in table.items()}
    free = lambda name, own: (F.size(F.array_intersect("all", F.array(*[F.lit(g) for g in own]))) >= needed(len(own), least)) & ~F.exists("hits", lambda h: h["name"].isin(alike[name]))
    open_for = [F.when(free(name, own), F.lit(name)) for name, own in table.items()]
    scored = scored.withColumn("open", F.when(F.col("marked"), F.array_compact(F.array(*open_for)))).drop("all")
    scored = scored.withColumn("placed", F.when(F.size("open") > 0, placed_bigrams(F.col("t")))).drop("t")
    runs = []
    for place, (name, own) in enumerate(table.items()):
        dice = F.when(F.array_contains("open", name), best_run(F.col("placed"), own, len(words_of(templates[name])) - 1, least))
        run = F.struct(dice.alias("dice"), F.lit(-place).alias("place"), F.lit(name).alias("name"))
        runs.append(F.filter(F.array(run), lambda r: r["dice"] >= least - 1e-12))
    scored = scored.withColumn("runs", F.when(F.size("open") > 0, F.concat(*runs)).otherwise(F.slice("hits", 1, 0))).drop("placed")
    # A run counts for the best of the templates that are alike.
    pairs = [f"{a}|{b}" for a, others in alike.items() for b in others if a != b]
    if pairs:
        beaten = lambda r: F.exists("runs", lambda h: (h["dice"] > r["dice"]) & F.concat_ws("|", r["name"], h["name"]).isin(pairs))
        scored = scored.withColumn("runs", F.when(F.size("runs") > 0, F.filter("runs", lambda r: ~beaten(r))).otherwise(F.col("runs")))
    scored = scored.withColumn("hits", F.concat("hits", "runs"))
    best = F.array_max("hits")
    return scored.select("doc_id", best["name"].alias("license"), F.coalesce(F.round(best["dice"], 6), F.lit(0.0)).alias("dice"), F.size("hits").cast("long").alias("n_matches"))
