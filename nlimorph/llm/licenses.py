"""Operator 6: licence scans, in DataFrame functions only.

Templates are notices, headers, headings and the paragraphs of full licence texts. A document is cut into pieces at line
ends and at ends of sentences; its units are every run of neighbouring pieces, as far as its pairs are no more than the largest bound of a
template, and the whole text. Units and templates are
normalised (lower-cased, all but a-z and 0-9 one space) and compared by the Dice coefficient over their sets of word
pairs. A coefficient of ``least`` needs set sizes within least / (2 - least) of each other, so only units within a
template's bounds meet it. Nothing is shuffled: each row is scanned in place.

Three steps pass over what cannot reach ``least`` and change no result. A unit that reaches it shares two thirds of the
template's pairs (at ``least`` 0.8), so it has one of the template's key words, which touch more than a third of them:
texts without any key word have no hit. Nor have texts that hold less than two thirds of every template's pairs. And a run
that begins or ends in a piece without a pair of any template is less alike than the run without that piece, so runs
begin and end in pieces that have one. The same holds for runs as for texts: one without a key word has no hit, nor has one less than
two thirds of whose pairs (at ``least`` 0.8) are pairs of templates.

Work grows with the length of a text: a run holds at most the pairs of the largest bound, so each piece begins a bounded number of runs,
found by where its words stand; sets of pairs are made one at a time.

Defined results: null or empty text has no unit with a word pair: no hits, null licence and coefficient; n_hits counts
the templates that some unit reaches; ties go to the first licence id; repeated rows give repeated results; null ids
stay null; very long texts are read whole, in time that grows with
their length; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import math
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlimorph.functions.settle import settled

#: Headings, notices, headers and paragraphs by licence id.
TEMPLATES = [
    ("agpl-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Apache License Version 2.0, January 2004"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("bsd-2-clause", "Released under the BSD 2-Clause License."),
    ("bsd-2-clause", "BSD 2-Clause License"),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("bsd-3-clause", "BSD 3-Clause License"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0 Universal)."),
    ("gpl-2.0", "This program is free software licensed under the GNU General Public License, version 2 or later."),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Released under the ISC License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("lgpl-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit", "MIT License"),
    ("mit", "The MIT License (MIT)"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]
PIECE_END = r"\n|[.!?;:][\x20\t\r]"
#: Frequent words, key words only where a template has no others.
FREQUENT = {"by", "copy", "following", "general", "included", "including", "of", "or", "particular", "possible", "provided", "related", "specific", "subject", "the", "this", "to", "under", "with"}


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def pairs_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(size: int, least: float) -> tuple[int, int]:
    """Sizes of a set that can reach ``least`` with one of ``size``."""
    return math.ceil(size * least / (2 - least) - 1e-9), math.floor(size * (2 - least) / least + 1e-9)


def key_words(templates: list[tuple[str, str]], least: float) -> list[str]:
    """Words of which a text needs one to reach any template: words already chosen, then the longest, until too few pairs are left."""
    chosen: set[str] = set()
    for _, text in sorted(templates, key=lambda t: len(t[1])):
        pairs = [p.split(" ") for p in pairs_of(text)]
        enough = len(pairs) - bounds(len(pairs), least)[0] + 1
        mine: set[str] = set()
        for word in sorted({w for p in pairs for w in p}, key=lambda w: (w in FREQUENT, w not in chosen, -len(w), w)):
            if sum(not mine.isdisjoint(p) for p in pairs) >= enough:
                break
            mine.add(word)
        chosen |= mine
    return sorted(chosen)


def _strings(values: list[str]) -> Column:
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _pairs(words: Column) -> Column:
    """Neighbouring words; ``words`` must be a plain column, else each pair evaluates it anew."""
    return F.slice(F.transform(words, lambda w, i: F.concat(w, F.lit(" "), F.coalesce(F.get(words, i + 1), F.lit("")))), 1, F.greatest(F.size(words) - 1, F.lit(0)))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """(id, n_hits, license_id, dice, license_ids) of every row: templates that some unit reaches, the best of them, and all their licences."""
    known = [(name, pairs_of(text)) for name, text in sorted(templates)]
    lowest, most = min(bounds(len(p), least)[0] for _, p in known), max(bounds(len(p), least)[1] for _, p in known)
    keys = _strings(key_words(templates, least))
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), _words(F.col(text_col)).alias("words"))
    has_key = F.arrays_overlap("words", keys)
    words = rows.select("_id", F.when(has_key, F.col("_text")).alias("_text"), F.when(has_key, F.col("words")).alias("words"))
    shared = words.select("_id", "_text", F.array_intersect(_pairs(F.col("words")), _strings(sorted({x for _, p in known for x in p}))).alias("shared"))
    enough = [F.size(F.array_intersect("shared", _strings(p))) >= bounds(len(p), least)[0] for _, p in known]
    able = shared.select("_id", "shared", F.when((F.size("shared") > 0) & functools.reduce(operator.or_, enough), F.col("_text")).alias("_text"))
    split = F.transform(F.split("_text", PIECE_END), _words)
    pieces = able.select("_id", "shared", F.filter(split, lambda w: F.size(w) > 0).alias("pieces"))
    flat = F.struct(F.flatten("pieces").alias("words"), F.flatten(F.transform("pieces", lambda p, k: F.array_repeat(k, F.size(p)))).alias("piece"), F.size("pieces").alias("n"))
    told = settled(pieces, "_flat", flat).select("_id", "shared", "_flat.*")

    begins = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | (F.get("piece", i) != F.get("piece", i - 1)))
    marks = F.struct(_pairs(F.col("words")).alias("pairs"), F.transform("words", lambda w: F.array_contains(keys, w)).alias("key"), F.when(F.size("words") > 0, begins).alias("begins"))
    told = settled(told, "_marks", marks).select("_id", "shared", "piece", "n", "_marks.*")
    told = settled(told, "_hit", F.transform("pairs", lambda p: F.array_contains("shared", p))).withColumnRenamed("_hit", "hit")

    def end(k: Column) -> Column:
        """Behind the last word of a piece."""
        return F.coalesce(F.get("begins", k + 1), F.size("key"))

    def some(flags: str, a: Column, b: Column) -> Column:
        """Whether a flag from a to before b is set."""
        return F.exists(F.slice(flags, a + 1, F.greatest(b - a, F.lit(0))), lambda x: x)

    starts = F.transform("begins", lambda a, k: some("hit", a, F.least(end(k), F.size("hit"))))
    stops = F.transform("begins", lambda a, k: some("hit", F.greatest(a - 1, F.lit(0)), end(k) - 1))
    told = settled(told, "_ends", F.struct(starts.alias("starts"), stops.alias("stops"))).select("_id", "shared", "piece", "n", "pairs", "key", "begins", "_ends.*")

    def reach(k: Column) -> Column:
        """The last piece that a run from piece k can have, or k itself."""
        beyond = F.get("piece", F.get("begins", k) + most + 1)
        return F.greatest(k, F.coalesce(beyond - 1, F.col("n") - 1))

    def runs_from(k: Column) -> Column:
        """Runs of pieces from k that hold a key word, by first pair and number of pairs."""
        a = F.get("begins", k)
        each = F.transform(F.filter(F.sequence(k, reach(k)), lambda j: F.get("stops", j)), lambda j: F.struct(a.alias("at"), (end(j) - a - 1).alias("length")))
        return F.filter(each, lambda u: (u["length"] >= lowest) & (u["length"] <= most) & some("key", u["at"], u["at"] + u["length"] + 1))

    able_starts = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.get("starts", k) & some("key", F.get("begins", k), F.get("begins", k) + most + 1))
    whole = F.struct(F.lit(0).alias("at"), F.size("pairs").alias("length"))
    units = F.when(F.size("pairs") >= lowest, F.concat(F.array(whole), F.flatten(F.transform(able_starts, runs_from))))
    told = settled(told, "_units", units).select("_id", "shared", "pairs", F.col("_units").alias("units"))

    def judged(own: Column) -> Column:
        """Templates that a set of pairs reaches; two thirds of it (at least 0.8) must be pairs of templates."""
        made = []
        for rank, (_, pairs) in enumerate(known):
            low, high = bounds(len(pairs), least)
            dice = F.size(F.array_intersect(own, _strings(pairs))) * 2.0 / (F.size(own) + len(pairs))
            made.append(F.when((F.size(own) >= low) & (F.size(own) <= high) & (dice >= least), F.struct(dice.alias("dice"), F.lit(-rank).alias("rank"))))
        can = (F.size(own) <= most) & (F.size(F.array_intersect(own, F.col("shared"))) >= F.size(own) * (least / (2 - least)) - 1e-9)
        return F.when(can, F.array_compact(F.array(*made))).otherwise(F.array().cast("array<struct<dice:double,rank:int>>"))

    sets = F.transform("units", lambda u: F.flatten(F.transform(F.array(F.array_distinct(F.slice("pairs", u["at"] + 1, u["length"]))), judged)))
    found = settled(told, "hits", F.flatten(sets))
    ranks = F.array_distinct(F.transform("hits", lambda h: h["rank"]))
    names = _strings([name for name, _ in known])
    best = F.array_max("hits")
    licences = F.array_join(F.array_sort(F.array_distinct(F.transform(ranks, lambda r: F.get(names, -r)))), ",")
    return found.select(F.col("_id").alias(id_col), F.coalesce(F.size(ranks), F.lit(0)).cast("long").alias("n_hits"), F.get(names, -best["rank"]).alias("license_id"), best["dice"].alias("dice"), F.when(F.size("hits") > 0, licences).alias("license_ids"))


def scan_sql(templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.8) -> str:
    """The same over ``documents``, as DuckDB SQL: every run between pieces that hold a pair of the template, by joins."""
    most = max(bounds(len(pairs_of(text)), least)[1] for _, text in templates)
    rows = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(sorted(templates)))

    def words(text: str) -> str:
        return f"list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda x: x <> '')"

    def pairs(w: str) -> str:
        return f"list_transform(generate_series(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1])"

    return f"""
with t as (select k, name, list_distinct({pairs("w")}) as b from (select k, name, {words("text")} as w from (values {rows}) v(k, name, text))),
tp as (select k, unnest(b) as pair from t),
u as (select row_number() over () as r, doc_id, text from documents),
s as (select r, unnest(string_split_regex(coalesce(text, ''), '{PIECE_END}')) as piece, generate_subscripts(string_split_regex(coalesce(text, ''), '{PIECE_END}'), 1) as j from u),
w as (select r, j, {words("piece")} as w from s),
f as (select r, flatten(list(w order by j)) as w, flatten(list(list_transform(w, lambda x: j) order by j)) as js from w group by r),
p as (select r, unnest({pairs("w")}) as pair, unnest(generate_series(1, len(w) - 1)) as i, unnest(js[1:len(w) - 1]) as j1, unnest(js[2:]) as j2 from f where len(w) > 1),
m as (select distinct r, k, j1, j2 from p join tp using (pair)),
v as (select r, j, min(i) as a from (select r, i, j1 as j from p) group by r, j),
y as (select r, j, max(i) as z from (select r, i, j2 as j from p) group by r, j),
e as (select distinct a.r, a.k, a.j1 as x, c.j2 as y from m a join m c on a.r = c.r and a.k = c.k and c.j2 >= a.j1 join v on v.r = a.r and v.j = a.j1 join y on y.r = c.r and y.j = c.j2 where y.z - v.a < {most}),
q as (select e.r, e.k, e.x, e.y, count(distinct p.pair) as size, count(distinct case when tp.pair is not null then p.pair end) as same
  from e join p on p.r = e.r and p.j1 >= e.x and p.j2 <= e.y left join tp on tp.k = e.k and tp.pair = p.pair group by all),
whole as (select m.r, m.k, 0, 0, count(distinct p.pair) as size, count(distinct case when tp.pair is not null then p.pair end) as same
  from (select distinct r, k from m) m join p using (r) left join tp on tp.k = m.k and tp.pair = p.pair group by m.r, m.k),
d as (select r, k, max(2.0::double * same / (size + len(b))) as dice from (select * from q union all select * from whole) join t using (k) group by r, k having dice >= {least}),
h as (select r, count(*) as n_hits, max(dice) as dice, arg_min(name, (-dice, name)) as license_id, string_agg(distinct name, ',' order by name) as license_ids from d join t using (k) group by r)
select u.doc_id, coalesce(h.n_hits, 0)::bigint as n_hits, h.license_id, h.dice, h.license_ids from u left join h using (r)"""
