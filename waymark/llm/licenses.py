"""Operator 8: license scans by diagonal voting.

Every position of every text gives the hash of the words from there on: two words for the base phrases, GRAM words for
the templates, which are notices and whole licenses. Spark joins these to the positions of the templates (a few thousand
rows, broadcast) and aggregates the matches by text, template and offset diagonal. A base phrase is whole on one diagonal.
Neighbouring diagonals of a template merge into overlapping bands; a band with enough votes is verified: the longest run of
its matches in the order of both, with the words that tell a template from its relatives. A band's matches are bounded by
its width and the template, whatever the text. Only matches and one row for each document are shuffled, never texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm.common import blocks, gram_hashes, map_rows, run_hashes, settle

#: Words of a template gram; how many words a span may drift from its template; how much of a template's grams a span must hold in order.
GRAM, GAP, LEAST_SHARE = 4, 12, 0.5

#: The base phrases and their labels.
BASE_PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)

#: What the licenses themselves ask to be stated, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced"),
)

#: Licenses in full, by label.
WHOLE = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("wtfpl", """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO."""),
)

#: Words that tell a template from its relatives: a span must have them, next to each other.
TELLING = {"lgpl": "lesser general", "agpl": "affero general", "cc-by": "attribution 4|by 4", "cc-by-nc": "nc 4", "cc-by-sa": "by sa 4"}

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _grams(column: pa.Array):
    """For each block of texts: first and end row, words of each text, and for each word its text, place, pair hash and gram hash (None: too near the end)."""
    for i, j, block in blocks(column):
        block.data = _LOWER[block.data]
        begins, ends = block.runs(_WORD[block.data])
        text = np.searchsorted(block.offsets, begins, side="right") - 1
        n = np.bincount(text, minlength=len(block))
        place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        hashes = run_hashes(block.data, begins, ends)
        out = []
        for size in (2, GRAM):
            h = np.zeros(len(text), np.int64)
            full = gram_hashes(hashes, size)
            h[: len(full)] = full.view(np.int64)
            out.append(pa.array(h, mask=place + size > n[text]))
        yield i, j, n, text, place, *out


@cache
def _template_rows() -> tuple[list[tuple], list[tuple]]:
    """Rows (hash, template, place, grams of the template) of the base phrases and of the templates."""
    pairs, grams = [], []
    for k, (_, text) in enumerate(BASE_PHRASES):
        ((_, _, _, _, place, pair, _),) = _grams(pa.array([text]))
        rows = [(h, p) for h, p in zip(pair.to_pylist(), place.tolist(), strict=True) if h is not None]
        pairs += [(h, k, p, len(rows)) for h, p in rows]
    for k, (_, text) in enumerate(TEMPLATES + WHOLE):
        ((_, _, _, _, place, _, gram),) = _grams(pa.array([text]))
        rows = [(h, p) for h, p in zip(gram.to_pylist(), place.tolist(), strict=True) if h is not None]
        grams += [(h, len(BASE_PHRASES) + k, p, len(rows)) for h, p in rows]
    return pairs, grams


@cache
def _telling(template: int) -> frozenset[int]:
    """Places of the template's grams that hold its telling words; empty if any will do."""
    label, text = (BASE_PHRASES + TEMPLATES + WHOLE)[template]
    words = re.findall(r"[a-z0-9]+", text.lower())
    wanted = [w.split() for w in TELLING.get(label, "").split("|") if w]
    return frozenset(p for p in range(len(words) - GRAM + 1) for want in wanted if any(words[k : k + len(want)] == want for k in range(p, p + GRAM - len(want) + 1)))


def verified(hits: list[tuple[int, int]], grams: int, telling: frozenset[int]) -> tuple[int, int, float] | None:
    """First word, last gram's word and share of the longest run of hits (place in the text, in the template) in order of both.

    None if it has less than LEAST_SHARE of the template's grams, or none of the telling places.
    """
    hits = sorted(set(hits), key=lambda h: (h[0], -h[1]))
    # tops[k]: the smallest place of the template that a run of k + 1 hits can end with; of hits at one place one counts.
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, (_, a) in enumerate(hits):
        k = bisect_left(tops, a)
        tops[k : k + 1], ends[k : k + 1] = [a], [i]
        back.append(ends[k - 1] if k else -1)
    run, i = [], ends[-1] if ends else -1
    while i >= 0:
        run.append(hits[i])
        i = back[i]
    if len(run) < LEAST_SHARE * grams or (telling and not any(a in telling for _, a in run)):
        return None
    return run[-1][0], run[0][0], len(run) / grams


def _positions(spark: SparkSession, rows: list[tuple], key: str, name: str) -> DataFrame:
    made = spark.createDataFrame(rows, f"{key} long, template int, place int, grams int")
    return F.broadcast(made.groupBy(key).agg(F.collect_list(F.struct("template", "place", "grams")).alias(name)))


def _labels(column: str) -> F.Column:
    names = [label for label, _ in BASE_PHRASES + TEMPLATES + WHOLE]
    return F.get(F.array(*[F.lit(x) for x in names]), F.col(column))


def spans(docs: DataFrame) -> DataFrame:
    """Verified spans of each text: row, doc_id, template, n_words, first and last gram's word, share of the template.

    A row with a null template for each text comes with them. `row` tells repeated ids apart. Base phrases are whole
    (share 1) or not there; a template's span holds at least LEAST_SHARE of its grams in order.
    """
    spark = docs.sparkSession

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        row, doc = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        for i, j, n, text, place, pair, gram in _grams(batch.column(2)):
            none = pa.nulls(j - i, pa.int64())
            which = pa.array(np.concatenate([np.arange(i, j), i + text]))
            parts.append([pa.array(row).take(which), doc.take(which), pa.array(np.concatenate([n, np.full(len(text), -1)])), pa.array(np.concatenate([np.full(j - i, -1), place])), pa.concat_arrays([none, pair]), pa.concat_arrays([none, gram])])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(list(c)) for c in zip(*parts, strict=True)], ["row", "doc_id", "n_words", "place", "pair", "gram"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grams = map_rows(rows, work, "row long, doc_id long, n_words long, place long, pair long, gram long")
    pairs, longer = _template_rows()
    met = grams.join(_positions(spark, pairs, "pair", "by_pair"), "pair", "left").join(_positions(spark, longer, "gram", "by_gram"), "gram", "left")
    empty = F.expr("cast(array() as array<struct<template: int, place: int, grams: int>>)")
    hits = met.where("n_words >= 0 or by_pair is not null or by_gram is not null").select("row", "doc_id", "n_words", "place", F.explode_outer(F.concat(F.coalesce("by_pair", empty), F.coalesce("by_gram", empty))).alias("at"))
    hits = hits.select("row", "doc_id", "n_words", F.col("at.template").alias("template"), F.col("at.grams").alias("grams"), "place", (F.col("place") - F.col("at.place")).alias("diagonal"))
    # A diagonal holds each place of its template once at most; a text's own row has no template. Written once, so texts are read once.
    voted = settle(hits.groupBy("row", "doc_id", "template", "grams", "diagonal").agg(F.max("n_words").alias("n_words"), F.collect_set("place").alias("places")))
    is_base, votes = F.col("template") < len(BASE_PHRASES), F.size("places")
    # A base phrase stands where all its pairs follow one another, on a diagonal of their own.
    whole = voted.where(F.col("template").isNull() | (is_base & (votes >= F.col("grams"))))
    whole = whole.select("row", "doc_id", "template", "n_words", F.array_min("places").alias("first"), F.array_max("places").alias("last"), F.least(F.lit(1.0), votes / F.col("grams")).alias("share"))
    # A span drifts by up to GAP words: its diagonals are all in one of two bands of twice that width, which overlap by half.
    band = F.floor(F.col("diagonal") / GAP)
    bands = voted.where(~is_base).select("row", "doc_id", "template", "grams", "diagonal", "places", F.explode(F.array(band, band - 1)).alias("band"))
    keys = ["row", "doc_id", "template", "grams", "band"]
    many = bands.groupBy(*keys).agg(F.collect_list(F.struct("diagonal", "places")).alias("diagonals"), F.sum(votes).alias("votes")).where(F.col("votes") >= LEAST_SHARE * F.col("grams"))

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for r in batch.to_pylist():
            span = verified([(p, p - d["diagonal"]) for d in r["diagonals"] for p in d["places"]], r["grams"], _telling(r["template"]))
            if span:
                found.append((r["row"], r["doc_id"], r["template"], -1, *span, r["band"]))
        return pa.RecordBatch.from_pylist([dict(zip(kinds.names, x, strict=True)) for x in found], schema=kinds)

    kinds = pa.schema(list(zip([*whole.columns, "band"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()], strict=True)))
    spans = map_rows(many, verify, "row long, doc_id long, template int, n_words long, first long, last long, share double, band long")
    # The same span may be in two bands that follow each other: the one with the larger share stays, of equals the first.
    near = Window.partitionBy("row", "template").orderBy("band")
    beside = lambda c, step: F.when(F.abs(F.lag("band", step).over(near) - F.col("band")) == 1, F.lag(c, step).over(near))
    less = F.coalesce(beside("share", 1) >= F.col("share"), F.lit(False)) | F.coalesce(beside("share", -1) > F.col("share"), F.lit(False))
    return whole.unionByName(spans.withColumn("_less", less).where("not _less").drop("band", "_less"))


def license_report(docs: DataFrame) -> DataFrame:
    """For every text: n_words, n_base, first_word, last_word, base_labels, labels and score (0 to 1).

    n_base counts the places of base phrases, first_word and last_word are the smallest and largest of their first
    words; labels adds those of the templates; score is the largest share of a phrase or template that was found. A
    null text counts as empty; repeated rows and ids each have their own row. Texts are scanned whole, however long; an
    empty table gives no rows, columns of other names aren't looked at.
    """
    found = spans(docs).withColumns({"label": _labels("template"), "base": F.col("template") < len(BASE_PHRASES)})
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return (
        found.groupBy("row", "doc_id")
        .agg(
            F.max("n_words").alias("n_words"), F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
            joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.coalesce(F.max(F.when(F.col("template").isNotNull(), F.col("share"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
