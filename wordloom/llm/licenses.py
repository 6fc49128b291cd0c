"""Licence scan by the Dice coefficient over word bigrams.

A document's units are its lines, its paragraphs (runs of lines without a blank
one, if a text has several lines) and its whole text (if it has several
paragraphs).  The templates are licence statements, notices and texts, and the
paragraphs of those that have several, so a notice laid out in paragraphs inside a
longer document is found paragraph by paragraph.  A unit and a licence template are normalised alike (lower case,
everything but a-z and 0-9 a separator) and compared by their sets of word
bigrams:  ``dice = 2 |A & B| / (|A| + |B|)``.

``dice >= t`` needs ``t / (2 - t) |B| <= |A| <= (2 - t) / t |B|``, so units outside
the widest such range go before any bigram is made, and a unit meets a template
only if the sizes allow it.  Bigrams meet by an equality join with the templates'
bigrams, a fixed list that is broadcast; units and templates are never paired
otherwise.  The same bound gives a few words of which every match must contain
one; texts and units without any go before they are split.

Everything is DataFrame functions.

Defined cases: null, empty and one-word texts have no bigrams and match nothing;
repeated rows give their matches each; equal scores of a unit go to the licence
first by name; null ids are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Function words, poor clues as most texts have them.
COMMON = frozenset("a above all an and any as at be by either express for from if in is it no not of on or other otherwise out that the this to "
                   "under use whether will with without you".split())

# One-line statements, and published notices and texts as their owners ask for them to be given, a blank line between paragraphs.
# Of the GPL family, Apache, MPL and Creative Commons only the notices, not the full licences, are here.
_BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE."]
_HOPE = ("This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
         "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} Public License for more details.")
_FREE = ("This {0} is free software{2} you can redistribute it and/or modify it under the terms of the GNU {1} Public License as published by the Free "
         "Software Foundation{3} either version {4} of the License, or (at your option) any later version.")
_RECEIVED = "You should have received a copy of the GNU {1} Public License along with this {0}. If not, see <https://www.gnu.org/licenses/>."
_WRITE = ("You should have received a copy of the GNU {1} Public License along with this {0}; if not, write to the Free Software Foundation, Inc., "
          "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.")


def _gnu(work: str, name: str, version: str, last: str) -> str:
    old = last is _WRITE
    return "\n\n".join(x.format(work, name, ";" if old else ":", ";" if old else ",", version) for x in (_FREE, _HOPE, last))


TEXTS = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                   "either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
            "Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
            "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
            "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "ISC": ["Released under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
            "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
            "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
            "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "\n\n".join(_BSD[:3] + _BSD[4:])],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "\n\n".join(_BSD)],
    "Zlib": ["Released under the zlib License.",
             "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
             "from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to "
             "alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must "
             "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
             "appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
             "software.\n\n3. This notice may not be removed or altered from any source distribution."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", _gnu("program", "General", "2", _WRITE), _gnu("program", "General", "2", _RECEIVED)],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                "Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that "
                "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
                "GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, "
                "see <https://www.gnu.org/licenses/>."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", _gnu("library", "Lesser General", "3", _RECEIVED), _gnu("program", "Lesser General", "3", _RECEIVED)],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _gnu("program", "Affero General", "3", _RECEIVED)],
    "LGPL-2.1": [_gnu("library", "Lesser General", "2.1", _WRITE), _gnu("library", "Lesser General", "2.1", _RECEIVED)],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                "You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.",
                  "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or "
                  "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
                  "means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
                  "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
                  "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
                  "under copyright law."],
}


def with_paragraphs(texts: Mapping[str, list[str]]) -> dict[str, list[str]]:
    """The texts and, as templates of their own, the paragraphs of those that have several.

    A paragraph that licences share is named after all of them.
    """
    out = {name: list(own) for name, own in texts.items()}
    owners: dict[str, set[str]] = {}
    for name, own in texts.items():
        for text in own:
            parts = text.split("\n\n")
            for part in parts if len(parts) > 1 else []:
                owners.setdefault(part, set()).add(name)
    for part, names in owners.items():
        name = " OR ".join(sorted(names))
        if part not in out.setdefault(name, []):
            out[name].append(part)
    return out


TEMPLATES = with_paragraphs(TEXTS)


def words(text: Column) -> Column:
    """Normalised words: lower-case ASCII letters and digits, everything else separates."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def bigrams(w: Column) -> Column:
    """Set of word bigrams; empty for fewer than two words."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    both = F.arrays_zip(F.slice(w, 1, n).alias("a"), F.slice(w, 2, n).alias("b"))
    pairs = F.transform(both, lambda x: F.concat(x["a"], F.lit(" "), x["b"]))
    return F.when(F.size(w) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def clues(templates: Mapping[str, list[str]], threshold: float) -> list[str]:
    """Words of which every matching unit has one.

    A match shares ``threshold m / (2 - threshold)`` of a template's ``m`` bigrams
    at least.  Words are chosen until, in every template, fewer bigrams than
    that have none of them.
    """
    grams = []
    for text in (x for own in templates.values() for x in own):
        w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
        pairs = set(zip(w, w[1:]))
        grams.append((pairs, math.ceil(threshold * len(pairs) / (2 - threshold) - 1e-9)))
    chosen: set[str] = set()
    while True:
        open_pairs = [p for pairs, need in grams if pairs and sum(not chosen & set(p) for p in pairs) >= max(1, need)
                      for p in pairs if not chosen & set(p)]
        if not open_pairs:
            return sorted(chosen)
        count = Counter(x for p in open_pairs for x in set(p))
        chosen.add(max(count, key=lambda x: (x not in COMMON, min(len(x), 6), count[x], x)))


def template_bigrams(spark: SparkSession, templates: Mapping[str, list[str]] = TEMPLATES) -> DataFrame:
    """``(license, template, m, gram)``: the bigrams of every template; ``m`` is their number."""
    rows = [(name, i, text) for name, texts in templates.items() for i, text in enumerate(texts)]
    t = spark.createDataFrame(rows, "license string, template int, text string")
    t = t.select("license", "template", bigrams(words(F.col("text"))).alias("grams"))
    return t.select("license", "template", F.size("grams").alias("m"), F.explode("grams").alias("gram"))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: Callable[[Column], Column] = F.isnotnull) -> DataFrame:
    """``(row, id, unit, place, body)``: lines, paragraphs and the whole text of wanted texts, numbered from 0."""
    text = F.col("text")
    t = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
                    F.col(f"`{text_col}`").cast("string").alias("text"))
    lines = F.split(text, "\n", -1)
    blocks = F.split(text, "\n[ \t\r]*(?:\n[ \t\r]*)+", -1)
    several = F.size(lines) > 1
    kinds = F.array(F.struct(F.lit("line").alias("unit"), lines.alias("parts")),
                    F.struct(F.lit("paragraph").alias("unit"), F.when(several, F.filter(blocks, lambda b: F.contains(b, F.lit("\n")))).otherwise(
                        F.array().cast("array<string>")).alias("parts")),
                    F.struct(F.lit("text").alias("unit"), F.when(F.size(blocks) > 1, F.array(text)).otherwise(F.array().cast("array<string>")).alias("parts")))
    t = t.where(text.isNotNull() & wanted(text)).select("row", "id", F.explode(kinds).alias("k"))
    return t.select("row", "id", "k.unit", F.posexplode("k.parts").alias("place", "body"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: Mapping[str, list[str]] = TEMPLATES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``(id, unit, place, license, dice)`` of every unit that a template matches, with its best licence."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    grams = template_bigrams(docs.sparkSession, templates)
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    sizes = grams.agg(F.min("m"), F.max("m")).first()
    if sizes[0] is None:
        sizes = (1, 0)
    def hinted(text: Column) -> Column:
        return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(x)) for x in clues(templates, threshold)), F.lit(False))

    u = units(docs, id_col, text_col, hinted).where(hinted(F.col("body")))
    u = u.withColumn("w", words(F.col("body"))).where(F.size("w") > low * sizes[0])
    u = u.select("row", "id", "unit", "place", bigrams(F.col("w")).alias("grams")).withColumn("n", F.size("grams"))
    u = u.where(F.col("n").between(low * sizes[0], high * sizes[1]))
    hits = u.select("row", "id", "unit", "place", "n", F.explode("grams").alias("gram")).join(F.broadcast(grams), "gram") \
        .where((F.col("n") >= low * F.col("m")) & (F.col("n") <= high * F.col("m")))
    scored = hits.groupBy("row", "id", "unit", "place", "license", "template", "n", "m").agg(F.count(F.lit(1)).alias("common")) \
        .withColumn("dice", 2 * F.col("common") / (F.col("n") + F.col("m"))).where(F.col("dice") >= threshold)
    best = scored.groupBy("row", "id", "unit", "place").agg(F.min(F.struct((-F.col("dice")).alias("less"), F.col("license"))).alias("best"))
    return best.select("id", "unit", "place", F.col("best.license").alias("license"), (-F.col("best.less")).alias("dice"))
