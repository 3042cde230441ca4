"""Licence scan: normalised text compared to licence templates by the Dice coefficient over word bigrams.

DataFrame functions only. Units are the whole text, each of its lines, and runs of up to as many paragraphs as the longest
template has (lines between blank ones; lines of signs only count as blank), so notices that are wrapped over lines and
licences of several paragraphs are met in longer files. Where lines that begin with a comment's sign stand next to lines that
don't, paragraphs are also cut between them, so a header in a comment is met although code follows at once. A unit meets only templates whose number of bigrams lies within the bounds that the threshold
allows: an equality join on that number with a table of some hundred rows, built from the templates. No row is shuffled.

Two more bounds prune exactly. Whoever shares enough bigrams with a template holds one of a few of its words (telling()),
so texts and units without any are passed over; and a set has at least as many bigrams as different words less one, so
units of too many words have no bigrams made.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: How a line of a comment begins.
COMMENT = r"^[ \t]*(#|//|/\*|\*|--|;|%|<!--)"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_NOTICE = """, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."""
_ZLIB_TERMS = """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain."""
_UNLICENSE_TERMS = """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
_GPL_WARRANTY = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: Public licence notices and texts. Long licences (Apache, GPL, MPL) are met by the notices that they ask for; any other text may be given to scan().
TEMPLATES = {
    "0BSD": f"{_ISC}.\n\n{_ISC_WARRANTY}",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause-full": f"{_BSD_2}\n\n{_BSD_WARRANTY}",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-3-Clause-full": f"{_BSD_2}\n\n{_BSD_NAMES}\n\n{_BSD_WARRANTY}",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": _GPL,
    "GPL-3.0-or-later-full": f"{_GPL}\n\n{_GPL_WARRANTY}",
    "ISC": f"{_ISC}{_ISC_NOTICE}",
    "ISC-full": f"{_ISC}{_ISC_NOTICE}\n\n{_ISC_WARRANTY}",
    "MIT": "Released under the MIT License.",
    "MIT-full": f"{_MIT}\n\n{_MIT_WARRANTY}",
    "MIT-text": _MIT,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": _UNLICENSE,
    "Unlicense-full": f"{_UNLICENSE}\n\n{_UNLICENSE_TERMS}\n\n{_MIT_WARRANTY}\n\nFor more information, please refer to <https://unlicense.org/>",
    "Zlib": _ZLIB,
    "Zlib-full": f"{_ZLIB}\n\n{_ZLIB_TERMS}",
}


def template_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes of sets that can have this Dice coefficient with a set of n."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def paragraphs(text: str) -> int:
    """Parts between blank lines, where lines of signs only count as blank."""
    return len(re.split(r"\n\n+", re.sub(r" ?\n ?", "\n", re.sub(r"[^a-z0-9\n]+", " ", text.lower())).strip()))


def pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


def telling(templates: list[list[str]], threshold: float) -> set[str]:
    """Words of which every unit that reaches the threshold with some template holds at least one.

    Such a unit shares at least threshold / 2 * (n + least size) of a template's n bigrams; so words that more than the rest
    of the bigrams touch can't all be missing. Few words are chosen, of six letters or more where they do, as these are rarer.
    """
    left = {}
    for i, words in enumerate(templates):
        grams = pairs(words)
        shared = math.ceil(threshold / 2 * (len(grams) + bounds(len(grams), threshold)[0]) - 1e-9)
        left[i] = (grams, len(grams) - shared + 1)  # bigrams still untouched, and how many of them must be touched yet
    out: set[str] = set()
    while left:
        gains: dict[str, int] = {}
        for grams, need in left.values():
            own: dict[str, int] = {}
            for word in (x for gram in grams for x in set(gram)):
                own[word] = own.get(word, 0) + 1
            for word, n in own.items():
                gains[word] = gains.get(word, 0) + min(n, need)
        best = min(gains, key=lambda x: (len(x) < 6, -gains[x], x))
        out.add(best)
        for i, (grams, need) in list(left.items()):
            rest = {x for x in grams if best not in x}
            left[i] = (rest, need - len(grams) + len(rest))
            if left[i][1] <= 0:
                del left[i]
    return out


def any_word(words: set[str]) -> str:
    """A pattern for texts in lower case that hold one of the words, whole; words are told apart letter by letter."""
    def branch(rest: list[str]) -> str:
        by: dict[str, list[str]] = {}
        for x in rest:
            by.setdefault(x[:1], []).append(x[1:])
        return "(?:" + "|".join(c + branch(v) if len(v) > 1 else c + v[0] for c, v in sorted(by.items(), reverse=True)) + ")"

    return f"(?<![a-z0-9]){branch(sorted(words))}(?![a-z0-9])"


def bigrams(words: Column) -> Column:
    """The different word bigrams as 64-bit hashes."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b)))


def by_size(spark: SparkSession, templates: dict[str, str], threshold: float) -> DataFrame:
    """For each number of bigrams the templates that a unit of that number can match."""
    sized = [(name, text, *bounds(len(pairs(w)), threshold)) for name, text in sorted(templates.items()) if len(w := template_words(text)) > 1]
    rows = spark.createDataFrame([(name, " ".join(template_words(text)), lo, hi) for name, text, lo, hi in sized], "template string, text string, lo int, hi int")
    rows = rows.select("template", bigrams(F.split("text", " ")).alias("grams"), F.explode(F.sequence("lo", "hi")).alias("_n"))
    return rows.groupBy("_n").agg(F.collect_list(F.struct("template", "grams")).alias("_templates"))


def _normal(text: Column) -> Column:
    """Words with single spaces, line by line."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " "), r" ?\n ?", "\n"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit, place, template, dice for each unit that reaches the threshold with some template.

    unit and place: text and 0; line and its number from 1; paragraphs and "first-last", from 1, for runs that are not the
    whole text; blocks likewise, for paragraphs also cut where comments begin and end, in texts that have such places. Of several templates the one with the largest coefficient, then the last by name. Null and empty texts and units of a
    single word match nothing; rows that repeat, and those with a null doc_id, match each for itself; no templates or no
    documents, no rows. Texts are taken whole; of a long one the units that may match have their words in memory. Other
    columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    known = [w for w in map(template_words, templates.values()) if len(w) > 1]
    sizes = [bounds(len(pairs(w)), threshold) for w in known]
    least, most = min((x for x, _ in sizes), default=1), max((x for _, x in sizes), default=0)
    pattern = any_word(telling(known, threshold))
    holds = lambda x: x.rlike(pattern)
    texts = docs.select("doc_id", F.lower("text").alias("_lower")).where(holds(F.col("_lower")))
    unit = lambda name, place, text: F.struct(F.lit(name).alias("unit"), place.cast("string").alias("place"), text.alias("text"))
    lines = F.transform(F.split("_normal", "\n"), lambda x, i: unit("line", i + 1, x))
    whole = F.array(unit("text", F.lit(0), F.translate(F.array_join("_parts", " "), "\n", " ")))
    longest = max(map(paragraphs, templates.values()), default=1)

    def runs(parts: str, name: str, most: int) -> list[Column]:
        """Of n paragraphs each, but not the run of all."""
        return [F.expr(f"""CASE WHEN size({parts}) > {n} THEN transform(sequence(1, size({parts}) - {n - 1}), i -> struct('{name}' AS unit, concat(i, '-', i + {n - 1}) AS place, translate(array_join(slice({parts}, i, {n}), ' '), '\n', ' ') AS text)) ELSE array() END""") for n in range(1, most + 1)]

    split = lambda x: F.split(F.regexp_replace(x, "^\n+|\n+$", ""), "\n\n+")
    marked = F.split("_lower", "\n")
    marked = F.array_join(F.transform(marked, lambda x, i: F.when((i > 0) & x.rlike(r"\S") & F.try_element_at(marked, i).rlike(r"\S") & (x.rlike(COMMENT) != F.try_element_at(marked, i).rlike(COMMENT)), F.concat(F.lit("\n"), x)).otherwise(x)), "\n")
    blocks = F.when(marked != F.col("_lower"), split(_normal(marked)))
    rows = texts.select("doc_id", _normal(F.col("_lower")).alias("_normal"), blocks.alias("_blocks")).where("_normal <> ''").select("doc_id", "_normal", split("_normal").alias("_parts"), "_blocks")
    own = F.concat(whole, lines, *runs("_parts", "paragraphs", longest), F.when(F.col("_blocks").isNotNull(), F.concat(*runs("_blocks", "blocks", longest))).otherwise(F.array()))
    units = rows.select("doc_id", F.explode(own).alias("_unit")).select("doc_id", "_unit.*")
    # a set of n bigrams may come from more words if some repeat; it has at least as many as different words less one
    units = units.where(holds(F.col("text")) & (F.octet_length("text") - F.octet_length(F.replace("text", F.lit(" "), F.lit(""))) >= least))
    worded = units.select("doc_id", "unit", "place", F.split("text", " ").alias("_words")).where(F.size(F.array_distinct("_words")) - 1 <= most)
    grams = worded.select("doc_id", "unit", "place", bigrams(F.col("_words")).alias("_grams")).withColumn("_n", F.size("_grams")).where(F.col("_n").between(least, most))
    met = grams.join(F.broadcast(by_size(docs.sparkSession, templates, threshold)), "_n")
    dice = lambda t: F.lit(2.0) * F.size(F.array_intersect("_grams", t["grams"])) / (F.col("_n") + F.size(t["grams"]))
    best = F.array_max(F.transform("_templates", lambda t: F.struct(dice(t).alias("dice"), t["template"].alias("template"))))
    return met.select("doc_id", "unit", "place", best.alias("_best")).where(F.col("_best.dice") >= threshold).select("doc_id", "unit", "place", "_best.template", "_best.dice")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() of all documents with TEMPLATES."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_VALUES = ", ".join(f"('{name}', '{' '.join(template_words(text))}')" for name, text in sorted(TEMPLATES.items()))
_RUNS = " UNION ALL ".join(
    f"SELECT doc_id, '{name}', unnest(list_transform(range(1, len({parts}) - {n - 2}), lambda i: i || '-' || (i + {n - 1}))), unnest(list_transform(range(1, len({parts}) - {n - 2}), lambda i: replace(array_to_string({parts}[i:i + {n - 1}], ' '), chr(10), ' '))) FROM l WHERE len({parts}) > {n}"
    for parts, name in (("parts", "paragraphs"), ("blocks", "blocks")) for n in range(1, 1 + max(map(paragraphs, TEMPLATES.values())))
)
_SQL_NORMAL = r"trim(regexp_replace(regexp_replace({text}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'))"
OP2_SQL = rf"""
WITH t AS (SELECT template, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM (SELECT template, string_split(words, ' ') AS w FROM (VALUES {_VALUES}) AS v(template, words))),
r AS (SELECT doc_id, lower(text) AS low, string_split(lower(text), chr(10)) AS raw FROM documents),
k AS (SELECT doc_id, low, array_to_string(list_transform(raw, lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, '\S') AND regexp_matches(raw[i - 1], '\S') AND regexp_matches(x, '{COMMENT}') <> regexp_matches(raw[i - 1], '{COMMENT}') THEN chr(10) || x ELSE x END), chr(10)) AS marked FROM r),
d AS (SELECT doc_id, low, marked, {_SQL_NORMAL.format(text="low")} AS normal, {_SQL_NORMAL.format(text="marked")} AS cut FROM k),
l AS (SELECT doc_id, string_split(normal, chr(10)) AS lines, regexp_split_to_array(trim(normal, chr(10)), '\n\n+') AS parts, CASE WHEN marked <> low THEN regexp_split_to_array(trim(cut, chr(10)), '\n\n+') END AS blocks, normal FROM d WHERE normal <> ''),
u AS (SELECT doc_id, 'text' AS unit, '0' AS place, replace(normal, chr(10), ' ') AS text FROM l UNION ALL SELECT doc_id, 'line', generate_subscripts(lines, 1)::VARCHAR, unnest(lines) FROM l UNION ALL {_RUNS}),
w AS (SELECT doc_id, unit, place, regexp_split_to_array(text, ' +') AS w FROM u),
g AS (SELECT doc_id, unit, place, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM w WHERE len(w) > 1),
m AS (SELECT g.doc_id, g.unit, g.place, t.template, 2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice FROM g JOIN t ON len(g.grams) BETWEEN len(t.grams) / 2 AND 2 * len(t.grams))
SELECT doc_id, unit, place, template, dice FROM m WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, unit, place ORDER BY dice DESC, template DESC) = 1
"""
