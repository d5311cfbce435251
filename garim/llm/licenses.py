"""Licence scan in DataFrame functions alone: Dice coefficient over word bigrams against templates.

A text's lines, its runs of up to `RUN` sentences, its paragraphs and the whole of it are the units that are
compared; a sentence ends at `.`, `!`, `?`, `;` or `:` before white space. Words are runs of a-z and 0-9 after
lower-casing. With u and t distinct bigrams in a unit and a template, of which s are
shared, Dice is 2 s / (u + t). As s is at most the lesser of both, a template is a candidate for a
unit only while 2 min(u, t) / (u + t) reaches the threshold; other pairs are never compared.
Before that, texts and units without any key bigram are passed over: a template's key bigrams are so many of
its bigrams that a unit without them can't reach the threshold (`key_bigrams`), so no match is lost.

All work stays in the row: no shuffle, no broadcast. Null and empty texts match nothing; equal Dice
values are settled by the unit's kind and place; a repeated row gives its matches again.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICE = 0.8
#: Neighbouring sentences that make one unit, at most.
RUN = 6
_SENTENCE = r"([.!?;:])[ \t\r\n]+"

# Notices and short licence texts in the wording that their stewards publish.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-text": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
UNITS = ("line", "sentences", "paragraph", "text")
#: Words too common to tell a licence by, while others are left.
_PLAIN = frozenset(
    "a all an and any are as at be but by do for from if in is it may mit must no not of on one or other such that the this to under use was with you your".split()
)


def _words(text: str) -> list[str]:
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower())
    return kept.split()


@lru_cache
def templates() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(name, distinct bigrams) of all templates."""
    return tuple((n, tuple(dict.fromkeys(map(" ".join, zip(w, w[1:], strict=False))))) for n, w in ((n, _words(t)) for n, t in TEMPLATES.items()))


@lru_cache
def key_bigrams(least: float = DICE) -> tuple[str, ...]:
    """For each template enough bigrams that a unit without any of them stays below the threshold: it shares at
    most the r others of its t bigrams, and Dice is at most 2 r / (r + t)."""
    use = Counter(b for _, bigrams in templates() for b in bigrams)
    plain = lambda b: sum(w in _PLAIN or len(w) < 3 for w in b.split())
    found: set[str] = set()
    for _, bigrams in sorted(templates(), key=lambda t: len(t[1])):
        order = sorted(bigrams, key=lambda b: (plain(b), b not in found, -use[b], b))
        rest = len(bigrams)
        while 2 * rest / (rest + len(bigrams)) >= least:
            rest -= 1
        found |= set(order[: len(bigrams) - rest])
    return tuple(sorted(found))


@lru_cache
def _key_pattern() -> str:
    """Any key bigram, in lower case; they are told apart by first letter, so most places fail at once."""
    by_letter: dict[str, dict[str, list[str]]] = {}
    for first, second in map(str.split, key_bigrams()):
        by_letter.setdefault(first[0], {}).setdefault(first[1:], []).append(second)
    pairs = lambda rest: "|".join(f"{a}[^a-z0-9]+(?:{'|'.join(b)})" for a, b in rest.items())
    return "(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{pairs(rest)})" for c, rest in by_letter.items()) + ")(?![a-z0-9])"


def _worded(part: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(part), "[^a-z0-9]+", " "))


def _units(text: Column) -> Column:
    """(kind, place, words as one string) of lines, runs of sentences, paragraphs and the whole."""

    def unit(kind: int):
        return lambda part, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), _worded(part).alias("words"))

    def runs(sentences: Column) -> Column:
        n = F.size(sentences)
        count = lambda i: F.least(F.lit(RUN), n - i + 1)
        run = lambda i, k: F.struct(F.lit(1).alias("kind"), (i * RUN + k).alias("place"), F.array_join(F.slice(sentences, i, k), " ").alias("words"))
        return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), count(i)), lambda k: run(i, k)))))

    none = F.array().cast("array<struct<kind:int,place:int,words:string>>")
    lines, paragraphs = F.transform(F.split(text, "\n", -1), unit(0)), F.transform(F.split(text, "\n[ \t\r]*\n", -1), unit(2))
    parts = F.split(F.regexp_replace(text, _SENTENCE, "$1\x01"), "\x01", -1)
    sentences = F.filter(F.transform(parts, _worded), lambda s: s != "")
    whole = F.transform(F.array(text), unit(3))
    # Bound to a variable, so that sentences are worked out once.
    every = F.concat(lines, F.transform(F.array(sentences), lambda s: F.coalesce(runs(s), none))[0], paragraphs, whole)
    return F.filter(every, lambda u: u["words"].rlike(_key_pattern()))


def _most(least: float) -> int:
    """Distinct bigrams that a unit may have and still match the longest template."""
    return math.floor(max(len(b) for _, b in templates()) * (2 / least - 1))


def with_licenses(df: DataFrame, text: str = "text", name: str = "licenses", least: float = DICE) -> DataFrame:
    """df with an array (license_id, dice, n_shared, n_bigrams, unit), at most one entry for each
    template: its best unit, lines before sentences before paragraphs before the whole."""
    top = _most(least)
    none = F.array().cast("array<struct<kind:int,place:int,bigrams:array<string>>>")

    def with_bigrams(u: Column) -> Column:
        words = F.split(u["words"], " ")
        return F.struct(
            u["kind"].alias("kind"),
            u["place"].alias("place"),
            F.array_distinct(F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b))).alias("bigrams"),
        )

    found = df.withColumn("_units", F.when(F.lower(text).rlike(_key_pattern()), F.transform(_units(F.col(text)), with_bigrams)).otherwise(none))
    found = found.withColumn("_units", F.filter("_units", lambda u: (F.size(u["bigrams"]) > 0) & (F.size(u["bigrams"]) <= top)))

    known = F.array(
        *[F.struct(F.lit(n).alias("license_id"), F.array(*[F.lit(b) for b in bigrams]).alias("own"), F.lit(len(bigrams)).alias("n")) for n, bigrams in templates()]
    )

    def best(own_units: Column, t: Column) -> Column:
        size = lambda u: F.size(u["bigrams"])
        fits = F.filter(own_units, lambda u: 2 * F.least(size(u), t["n"]) >= least * (size(u) + t["n"]))
        shared = F.transform(
            fits,
            lambda u: F.struct(u["kind"].alias("kind"), u["place"].alias("place"), size(u).alias("n"), F.size(F.array_intersect(u["bigrams"], t["own"])).alias("shared")),
        )
        scored = F.transform(
            shared,
            lambda u: F.struct((2 * u["shared"] / (u["n"] + t["n"])).alias("dice"), (-u["kind"]).alias("kind"), (-u["place"]).alias("place"), u["shared"].alias("n_shared"), u["n"].alias("n_bigrams")),
        )
        return F.struct(t["license_id"].alias("license_id"), F.array_max(scored).alias("best"))

    # The units are bound to a variable here: a column's expression would be worked out for each template.
    every = F.transform(F.array("_units"), lambda own_units: F.transform(known, lambda t: best(own_units, t)))
    units = F.array(*[F.lit(u) for u in UNITS])
    matched = F.transform(
        F.filter(F.flatten(every), lambda m: m["best"]["dice"] >= least),
        lambda m: F.struct(
            m["license_id"].alias("license_id"), m["best"]["dice"].alias("dice"), m["best"]["n_shared"].cast("long").alias("n_shared"),
            m["best"]["n_bigrams"].cast("long").alias("n_bigrams"), F.element_at(units, 1 - m["best"]["kind"]).alias("unit"),
        ),
    )
    no_match = F.array().cast("array<struct<license_id:string,dice:double,n_shared:bigint,n_bigrams:bigint,unit:string>>")
    return found.withColumn(name, F.when(F.size("_units") > 0, matched).otherwise(no_match)).drop("_units")


def op8(docs: DataFrame) -> DataFrame:
    return with_licenses(docs.select("doc_id", "text")).select("doc_id", F.inline("licenses"))


def oracle() -> str:
    """The same rows for op8 by comparing every unit with every template."""
    rows = ", ".join(f"('{n}', [{', '.join(repr(b) for b in bigrams)}])" for n, bigrams in templates())
    return rf"""
with t(license_id, bigrams) as (values {rows}),
sentences as (
  select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '{_SENTENCE}', '\1' || chr(1), 'g'), chr(1)),
         lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') as s from documents
), parts as (
  select doc_id, 0 as kind, unnest(string_split(text, chr(10))) as part, generate_subscripts(string_split(text, chr(10)), 1) as place from documents
  union all
  select doc_id, 2, unnest(string_split_regex(text, '\n[ \t\r]*\n')), generate_subscripts(string_split_regex(text, '\n[ \t\r]*\n'), 1) from documents
  union all
  select doc_id, 3, text, 1 from documents
  union all
  select doc_id, 1, array_to_string(s[i : i + k - 1], ' '), i * {RUN} + k
  from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from sentences) n, range(1, {RUN} + 1) r(k) where i + k - 1 <= len(s)
), worded as (
  select doc_id, kind, place, string_split(trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')), ' ') as w from parts
), units as (
  select doc_id, kind, place, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from worded where len(w) >= 2
), scored as (
  select doc_id, license_id, kind, place, len(b) as n_bigrams, len(list_intersect(b, bigrams)) as n_shared, len(bigrams) as n from units, t
  where len(b) <= {_most(DICE)} and 2 * least(len(b), len(bigrams)) >= {DICE} * (len(b) + len(bigrams))
), ranked as (
  select *, 2 * n_shared / (n_bigrams + n) as dice,
         row_number() over (partition by doc_id, license_id order by 2 * n_shared / (n_bigrams + n) desc, kind, place) as nth from scored
)
select doc_id, license_id, cast(dice as double) as dice, cast(n_shared as bigint) as n_shared, cast(n_bigrams as bigint) as n_bigrams,
       {list(UNITS)}[kind + 1] as unit
from ranked where nth = 1 and dice >= {DICE}
"""
