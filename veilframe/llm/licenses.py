"""Licence scanning by the Dice coefficient over word bigrams, in DataFrame operations only.

Texts are normalised (lower case, words of letters and digits, copyright lines' years kept as words) and cut
into units: every line, every run of lines without a blank one, and every run of lines without one that has no word
(as of comment marks alone). A unit matches a template if twice
their shared distinct bigrams, divided by the sum of both counts, reaches ``threshold``. Counts of a and b allow
that only if b * t / (2 - t) <= a <= b * (2 - t) / t, so units out of every template's bounds are never
expanded, and pairs out of bounds never counted; the rest meet in an equi-join on bigrams. Of the templates that a unit
matches the best counts: the highest coefficient, then the larger template, then the one listed first.

A notice inside a longer unit is found by windows over the words of the whole text, whatever lines or marks part
them: from every place where a bigram of the template stands, as many words as the template has. Texts are cut
into pieces by the place where a window starts, overlapping so that each window lies whole in one; of a template, a
piece's best window counts, unless a better one of another licence overlaps it. ``n_units`` counts the
matching lines and blocks, and one for every licence that only windows give.

Any match shares at least b * t / (2 - t) of a template's bigrams. A word that a text lacks costs the template's bigrams that hold it, of
which a bigram holds two and an end word may have but one; so a text that lacks more words than it may lose bigrams, and one
more, is not cut at all: this loses no match.

Defined results: null text is empty; documents without a match have no licences; rows that repeat an id and a text
share their result; null ids are kept. Templates are a bounded list, checked before they are broadcast. Further columns
are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, small, store

THRESHOLD = 0.8

# Notices by which texts name their licence, as their publishers recommend them, and short licences whole.
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {0} of the License, or (at your option) any later version."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _MIT),
    ("MIT", _MIT + ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", _GPL.format("", "3")),
    ("GPL-2.0-or-later", _GPL.format("", "2")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0-or-later", _GPL.format("Affero", "3")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0-or-later", _GPL.format("Lesser", "3")),
    ("LGPL-3.0-or-later", _LGPL.format("3")),
    ("LGPL-2.1-or-later", _LGPL.format("2.1")),
    ("BSD", _BSD),
    ("BSD-2-Clause", _BSD + _BSD_TWO),
    ("BSD-3-Clause", _BSD + _BSD_TWO + _BSD_THIRD),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", _ISC + "."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
]

_ROW = ["doc_id", "doc_key"]
PIECE_WORDS = 4096


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), r"[^\p{L}\p{N}]+"), "")


def bigrams(tokens: Column) -> Column:
    """Distinct pairs of neighbours, space-joined."""
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def templates(spark: SparkSession, rows=None) -> DataFrame:
    """(template, license, grams, n_words, size), from (license, text) rows."""
    listed = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(rows or TEMPLATES)], "template int, license string, text string")
    tokens = words(F.col("text"))
    return listed.select("template", "license", bigrams(tokens).alias("grams"), F.array_distinct(tokens).alias("words"), F.size(tokens).alias("n_words")).withColumn("size", F.size("grams")).where("size > 0")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with one more column, evaluated once a row: a plain column would be repeated in each filter and column that names it."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def least_shared(size: int, threshold: float) -> int:
    """The fewest bigrams that a match shares with a template of ``size`` distinct ones."""
    return max(1, math.ceil(size * threshold / (2 - threshold) - 1e-9))


def _constant(value, kind: str) -> Column:
    """A literal of any type, as one node of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _candidates(present: Column, listed: list, threshold: float) -> Column:
    """The templates of which a text may hold enough, by the words of theirs that it holds."""
    rows = [{"template": r.template, "words": sorted(r.words), "most": r.size - least_shared(r.size, threshold) + 1} for r in listed]
    known = _constant(rows, "array<struct<template:int,words:array<string>,most:int>>")
    return F.transform(F.filter(known, lambda t: F.size(F.array_except(t.words, present)) <= t.most), lambda t: t.template)


def _pairs(tokens: str) -> Column:
    return F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens) - 1), lambda a, b: F.concat(a, F.lit(" "), b))


def windows(texts: DataFrame, listed: list, threshold: float) -> DataFrame:
    """texts(doc_id, doc_key, tokens, candidates) -> (doc_id, doc_key, template, license, b, dice): the best window of each template in each piece, if it matches and no better one of another licence overlaps it."""
    spark = texts.sparkSession
    rows = [(r.template, r.license, r.grams, r.size, r.n_words - 1, least_shared(r.size, threshold)) for r in listed]
    wanted = spark.createDataFrame(rows, "template int, license string, wanted array<string>, b int, span int, least int")
    lap = max(r.n_words for r in listed)
    # A window belongs to the piece of PIECE_WORDS words that it starts in.
    cut = F.transform(F.sequence(F.lit(1), F.size("tokens"), F.lit(PIECE_WORDS)), lambda at: F.struct(((at - 1) / PIECE_WORDS).cast("long").alias("piece"), F.slice("tokens", at, PIECE_WORDS + lap).alias("tokens")))
    pieces = texts.where(F.size("tokens") > 1).select(*_ROW, "candidates", F.explode(cut).alias("p")).select(*_ROW, "candidates", "p.*").where(F.size("tokens") > 1)
    pieces = _once(pieces, "pairs", _pairs("tokens")).drop("tokens").withColumn("template", F.explode("candidates")).drop("candidates")
    met = pieces.join(small(wanted, 8192, len(rows)), "template").where(F.size(F.array_intersect("pairs", "wanted")) >= F.col("least"))
    starts = F.filter(F.sequence(F.lit(1), F.least(F.size("pairs"), F.lit(PIECE_WORDS))), lambda at: F.array_contains("wanted", F.element_at("pairs", at)))

    def dice(at: Column) -> Column:
        own = F.slice("pairs", at, F.col("span"))
        return 2 * F.size(F.array_intersect(own, "wanted")) / (F.size(F.array_distinct(own)) + F.col("b"))

    scored = F.array_max(F.transform("starts", lambda at: F.struct(dice(at).alias("dice"), (-at).alias("before"))))
    best = _once(_once(met, "starts", starts), "best", scored).where(F.col("best.dice") >= threshold)
    first = F.col("piece") * PIECE_WORDS - F.col("best.before")
    found = best.select(*_ROW, "template", "license", "b", F.col("best.dice").alias("dice"), "piece", first.alias("first"), (first + F.col("span")).alias("last"))
    # Matches are few; each meets those of its own and the neighbouring pieces.
    rank = lambda: F.struct("dice", "b", (-F.col("template")).alias("order"))
    here = found.withColumn("rank", rank())
    there = found.select(F.col("doc_id").alias("o_id"), F.col("doc_key").alias("o_key"), F.col("license").alias("o_license"), F.col("first").alias("o_first"), F.col("last").alias("o_last"), rank().alias("o_rank"), F.explode(F.array(*(F.col("piece") + k for k in (-1, 0, 1)))).alias("o_piece")).distinct()
    overlaps = F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("doc_key") == F.col("o_key")) & (F.col("piece") == F.col("o_piece")) & (F.col("first") <= F.col("o_last")) & (F.col("o_first") <= F.col("last"))
    kept = here.join(there.hint("merge"), overlaps & (F.col("license") != F.col("o_license")) & (F.col("o_rank") > F.col("rank")), "left_anti")
    return kept.select(*_ROW, "template", "license", "b", "dice")


def scan(documents: DataFrame, rows=None, threshold: float = THRESHOLD) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_units, licenses, best_license, best_dice), one row per row."""
    spark = documents.sparkSession
    known = templates(spark, rows)
    listed = known.collect()  # the given list
    keyed = documents.select("doc_id", F.xxhash64("text").alias("doc_key"), F.coalesce("text", F.lit("")).alias("text"))
    if not listed:
        return keyed.select("doc_id", F.lit(0).cast("long").alias("n_units"), F.lit("").alias("licenses"), F.lit(None).cast("string").alias("best_license"), F.lit(0.0).alias("best_dice"))
    # A coefficient that is just the threshold must not be lost to rounding.
    lower, upper = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    least, most = min(r.size for r in listed) * lower, max(r.size for r in listed) * upper
    vocabulary = sorted({w for r in listed for w in r.words})
    cut = _once(keyed, "tokens", words(F.col("text")))
    cut = _once(cut, "present", F.array_intersect("tokens", _constant(vocabulary, "array<string>")))
    fewest = min(len(r.words) - (r.size - least_shared(r.size, threshold) + 1) for r in listed)
    texts = _once(cut.where(F.size("present") >= fewest), "candidates", _candidates(F.col("present"), listed, threshold)).where(F.size("candidates") > 0)
    texts = store(texts.select(*_ROW, "text", "tokens", "candidates"), "license_texts")  # units and windows both read these few
    # Lines, and blocks of several lines between blank ones, or between ones without a word.
    blocks = lambda parted: F.filter(F.split("text", parted), lambda b: b.contains("\n"))
    parts = F.concat(F.split("text", r"\n"), blocks(r"\n[ \t\r]*(?:\n[ \t\r]*)+"), blocks(r"\n[^\p{L}\p{N}]*\n"))
    units = texts.select(*_ROW, F.explode_outer(F.array_distinct(parts)).alias("unit"))
    # A word and its gap take at least two characters; shorter units than the lower bound in words are not expanded.
    sized = _once(units.where(F.length("unit") >= 2 * least + 1), "tokens", words(F.col("unit"))).where(F.size("tokens") >= least + 1)
    # Few distinct bigrams may hide in many words, so the upper bound is on distinct bigrams.
    spread = _once(sized, "grams", bigrams(F.col("tokens"))).withColumn("a", F.size("grams")).where(F.col("a").between(least, most))
    spread = spread.select(*_ROW, "a", F.xxhash64("unit").alias("unit"), "grams").select(*_ROW, "a", "unit", F.explode_outer("grams").alias("gram"))
    wanted = known.select("template", "license", F.col("size").alias("b"), F.explode("grams").alias("gram"))
    met = spread.join(small(wanted, 128, sum(r.size for r in listed)), "gram").where(F.col("a").between(F.col("b") * lower, F.col("b") * upper))
    # One row of a unit for each bigram: repeated rows of a document would count twice, hence the distinct.
    shared = met.groupBy(*_ROW, "unit", "a", "template", "license", "b").agg(F.size(F.collect_set("gram")).alias("shared"))
    scored = shared.withColumn("dice", 2 * F.col("shared") / (F.col("a") + F.col("b"))).where(F.col("dice") >= threshold)
    best = scored.groupBy(*_ROW, "unit").agg(F.max(F.struct("dice", "b", (-F.col("template")).alias("order"), "license")).alias("best"))
    best = best.select(*_ROW, "unit", F.col("best.dice").alias("dice"), (-F.col("best.order")).alias("template"), F.col("best.license").alias("license"))
    alone = windows(texts.select(*_ROW, "tokens", "candidates"), listed, threshold).select(*_ROW, F.lit(None).cast("long").alias("unit"), "dice", "template", "license")
    named = best.unionByName(alone).groupBy(*_ROW, "license").agg(F.max(F.struct("dice", (-F.col("template")).alias("order"))).alias("best"), F.count_distinct("unit").alias("units"))
    whole = named.groupBy(*_ROW).agg(
        F.sum(F.greatest("units", F.lit(1))).alias("n_units"), F.array_join(F.array_sort(F.collect_list("license")), ",").alias("licenses"),
        F.max(F.struct("best", "license")).alias("top"),
    )
    whole = whole.select(F.col("doc_id").alias("b_id"), F.col("doc_key").alias("b_key"), "n_units", "licenses", F.col("top.license").alias("best_license"), F.col("top.best.dice").alias("best_dice"))
    out = keyed.select(*_ROW).join(whole, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("doc_key") == F.col("b_key")), "left")
    return out.select("doc_id", F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), F.coalesce("licenses", F.lit("")).alias("licenses"), "best_license", F.round(F.coalesce("best_dice", F.lit(0.0)), 6).alias("best_dice"))


_SQL_WORDS = r"list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_SQL_PAIRS = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"


def sql(rows=None, threshold: float = THRESHOLD) -> str:
    """The same result over the view documents, for DuckDB."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(rows or TEMPLATES))
    return rf"""
        with docs as (select doc_id, coalesce(text, '') as text from documents),
        split as (select template, license, {_SQL_WORDS.format('text')} as w from (values {listed}) v(template, license, text)),
        known as (select template, license, list_distinct({_SQL_PAIRS.format('w')}) as wanted, len(w) - 1 as span, len(list_distinct({_SQL_PAIRS.format('w')})) as b from split),
        grams as (select template, unnest(wanted) as gram from known),
        units as (
            select doc_id, unnest(list_distinct(string_split(text, chr(10)) || list_filter(string_split_regex(text, '\n[ \t\r]*(?:\n[ \t\r]*)+') || string_split_regex(text, '\n[^\p{{L}}\p{{N}}]*\n'), lambda u: contains(u, chr(10))))) as unit
            from docs),
        cut as (select doc_id, unit, {_SQL_WORDS.format('unit')} as w from units),
        own as (select doc_id, unit, list_distinct({_SQL_PAIRS.format('w')}) as own from cut),
        met as (select doc_id, unit, a, template, count(*) as shared from (select doc_id, unit, len(own) as a, unnest(own) as gram from own) join grams using (gram) group by all),
        matched as (select doc_id, unit, template, license, b, 2 * shared / (a + b) as dice from met join known using (template) where 2 * shared / (a + b) >= {threshold}),
        best as (select * from matched qualify row_number() over (partition by doc_id, unit order by dice desc, b desc, template) = 1),
        whole as (select doc_id, {_SQL_PAIRS.format('w')} as p from (select doc_id, {_SQL_WORDS.format('text')} as w from docs)),
        places as (select doc_id, template, gram, pos from (select doc_id, unnest(p) as gram, generate_subscripts(p, 1) as pos from whole) join grams using (gram)),
        enough as (select doc_id, template from places join known using (template) group by doc_id, template having count(distinct gram) * (2 - {threshold}) >= any_value(b) * {threshold} - 1e-6),
        windows as (select doc_id, template, license, b, span, pos, wanted, list_distinct(p[pos:pos + span - 1]) as own from places join enough using (doc_id, template) join known using (template) join whole using (doc_id)),
        rated as (select *, 2 * len(list_intersect(own, wanted)) / (len(own) + b) as dice, (pos - 1) // {PIECE_WORDS} as piece from windows),
        ahead as (select * from rated where dice >= {threshold} qualify row_number() over (partition by doc_id, template, piece order by dice desc, pos) = 1),
        alone as (
            select * from ahead h where not exists (
                select 1 from ahead o where o.doc_id = h.doc_id and abs(o.piece - h.piece) <= 1 and o.license <> h.license and h.pos <= o.pos + o.span and o.pos <= h.pos + h.span
                and (o.dice > h.dice or o.dice = h.dice and (o.b > h.b or o.b = h.b and o.template < h.template)))),
        named as (
            select doc_id, license, max(dice) as dice, arg_min(template, (-dice, template)) as template, count(distinct unit) as units
            from (select doc_id, license, dice, template, unit from best union all select doc_id, license, dice, template, null from alone) group by all)
        select docs.doc_id, cast(coalesce(n, 0) as bigint) as n_units, coalesce(licenses, '') as licenses, best_license, round(coalesce(best_dice, 0.0), 6) as best_dice
        from docs left join (
            select doc_id, sum(greatest(units, 1)) as n, string_agg(license, ',' order by license) as licenses, arg_min(license, (-dice, template)) as best_license, max(dice) as best_dice from named group by doc_id
        ) using (doc_id)
    """
