"""License scans by diagonal voting: k-gram hashes of texts meet those of templates, and votes are counted by offset.

Every rolling k-gram of a text's words is joined with the positions of the template grams. A match at word p
of the text and word a of the template votes for the diagonal p - a: a copy of the template puts all its
votes on one diagonal, a copy with words put in or left out on neighbouring ones. Votes are aggregated by
diagonal, neighbouring diagonals are merged, and a span is verified by the words that its
matches cover in the order of both sides.

A diagonal has at most as many votes as its template has words, and a merged one as many more as ``SLACK`` diagonals
can hold, so no group grows with a text. The templates are fixed and are broadcast; texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gram_hashes, id_key, list_array, materialize, small_batches, text_slices, word_bounds, word_hashes

GRAM = 3
#: Templates of fewer words must be met whole; the others to this part, with neighbours up to SLACK diagonals away.
WHOLE, PART, SLACK = 20, 0.8, 8

#: The base phrases and their labels.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: Short mentions and standard notices of public licenses.
TEMPLATES = [
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd-2", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-3", "SPDX-License-Identifier: BSD-3-Clause"),
    ("gpl-2", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0"),
    ("mpl-2", "SPDX-License-Identifier: MPL-2.0"),
    ("mit", "licensed under the terms of the MIT license"),
    ("gpl-2", "GNU General Public License, version 2"),
    ("gpl-3", "GNU General Public License, version 3"),
    ("gpl-2", "GNU General Public License v2"),
    ("gpl-3", "GNU General Public License v3"),
    ("lgpl-2.1", "GNU Lesser General Public License, version 2.1"),
    ("lgpl-3", "GNU Lesser General Public License, version 3"),
    ("agpl-3", "GNU Affero General Public License, version 3"),
    ("mpl-2", "Mozilla Public License, version 2.0"),
    ("bsd-2", "2-clause BSD license"),
    ("bsd-3", "3-clause BSD license"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA"),
    ("cc-by", "Creative Commons Attribution 4.0 International"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial"),
    ("cc0", "CC0 1.0 Universal"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "bsd-2",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
    ),
    (
        "bsd-3",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "lgpl-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "agpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]

#: Bytes of words as themselves, A-Z in lower case, every other byte as a blank.
_WORD = np.full(256, 32, np.uint8)
for _range in (range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100)):
    _WORD[list(_range)] = list(_range)
_WORD[0x41:0x5B] = np.arange(0x61, 0x7B)
#: The gram that every text has once, before its first word: it carries the text's own row through the join.
_ROW = -(2**63)


def _grams(data: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of words of each text, its rolling gram hashes one text after another, and how many each has."""
    start, end, first = word_bounds(_WORD[data], offsets)
    n = np.diff(first)
    h = gram_hashes(word_hashes(_WORD[data], start, end), gram).view(np.int64)
    stop = np.repeat(first[1:], n)[: len(h)]
    return n, h[np.arange(len(h)) + gram <= stop], np.maximum(n - gram + 1, 0)


def _rows(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried, key, print_ = (batch.column(batch.schema.get_field_index(c)) for c in ("carried", "dk", "th"))
            for lo, hi, data, offsets in text_slices(batch):
                n, h, size = _grams(data, offsets, gram)
                lists = list_array(np.insert(h, np.cumsum(size) - size, _ROW), size + 1, pa.int64())
                columns = [carried[lo:hi], key[lo:hi], print_[lo:hi], pa.array(n.astype(np.int64)), lists]
                yield pa.record_batch(columns, names=["carried", "dk", "th", "n_words", "grams"])

    return run


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], exact: int, gram: int = GRAM) -> DataFrame:
    """(gram, t, at, size, whole): each gram of each template, and the row mark as template -1. The first ``exact`` templates must be met whole."""
    rows = [(_ROW, -1, 0, 0, True)]
    for t, (_, text) in enumerate(templates):
        data = np.frombuffer(text.encode(), np.uint8)
        n, h, _ = _grams(data, np.array([0, len(data)]), gram)
        if n[0] < gram:
            raise ValueError(f"a template needs {gram} words: {text!r}")
        rows += [(g, t, at, int(n[0]), t < exact or int(n[0]) < WHOLE) for at, g in enumerate(h.tolist())]
    return spark.createDataFrame(rows, "gram long, t int, at int, size int, whole boolean")


def votes(docs: DataFrame, templates: DataFrame, gram: int = GRAM) -> DataFrame:
    """Written rows (carried, dk, th, n_words, p, t, at, size, whole): the matches of every text, and one row of template -1 for each row of ``docs``."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flat = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("carried"), id_key().alias("dk"), F.xxhash64(text).alias("th"), text.alias("text"))
    kind = flat.schema["carried"].dataType.simpleString()
    grams = flat.mapInArrow(_rows(gram), f"carried {kind}, dk long, th long, n_words long, grams array<bigint>")
    each = grams.select("carried", "dk", "th", "n_words", F.posexplode("grams").alias("p", "gram"))
    met = each.join(F.broadcast(templates), "gram")
    own = F.col("t") == -1
    return materialize(met.select(F.when(own, F.col("carried")).alias("carried"), "dk", "th", "n_words", (F.col("p") - 1).alias("p"), "t", "at", "size", "whole"), "votes")


def _covered(hits: Column, gram: int) -> Column:
    """How many words the matches (p, a), sorted, cover in the order of both sides."""
    none = F.struct(F.lit(0).alias("n"), F.lit(-gram).alias("a"), F.lit(-gram).alias("p"))

    def step(acc: Column, hit: Column) -> Column:
        fresh = F.least(F.lit(gram), hit["a"] - acc["a"], hit["p"] - acc["p"])
        later = F.struct((acc["n"] + fresh).alias("n"), hit["a"].alias("a"), hit["p"].alias("p"))
        return F.when(fresh > 0, later).otherwise(acc)

    return F.aggregate(hits, none, step, lambda acc: acc["n"])


def verified(matches: DataFrame, gram: int = GRAM, part: float = PART, slack: int = SLACK) -> DataFrame:
    """(dk, th, t, start, end, n, likeness): spans of ``votes`` rows, in words, end exclusive, that hold a template.

    n is the words that matches cover in order, likeness their share of the longer of template and span. A template to be met whole gives each place where it
    stands; any other gives the spans of likeness ``part`` or more, of which several may lie around one copy.
    """
    key = ["dk", "th", "t", "size", "whole"]
    diagonals = matches.where("t >= 0").groupBy(*key, (F.col("p") - F.col("at")).alias("diagonal")).agg(F.sort_array(F.collect_set("at")).alias("ats"))
    whole = diagonals.where("whole").where(F.size("ats") == F.col("size") - gram + 1)
    exact = whole.select("dk", "th", "t", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("size")).alias("end"), F.col("size").alias("n"), F.lit(1.0).alias("likeness"))
    near = Window.partitionBy(*key).orderBy("diagonal").rangeBetween(0, slack)
    hit = F.transform("ats", lambda a: F.struct((F.col("diagonal") + a).alias("p"), a.alias("a")))
    merged = diagonals.where("not whole").withColumn("hits", F.sort_array(F.flatten(F.collect_list(hit).over(near))))
    merged = merged.where(F.size("hits") * gram >= F.col("size") * part)
    spans = merged.select("dk", "th", "t", "size", F.col("hits")[0]["p"].alias("start"), (F.element_at("hits", -1)["p"] + gram).alias("end"), _covered(F.col("hits"), gram).alias("n"))
    like = F.least(F.lit(1.0), F.col("n") / F.greatest("size", F.col("end") - F.col("start")))
    return exact.unionByName(spans.select("dk", "th", "t", "start", "end", "n", like.alias("likeness")).where(F.col("likeness") >= part))


def best_spans(spans: DataFrame) -> DataFrame:
    """Spans without those that overlap a better one: of more covered words, then of greater likeness, then earlier, then of the lesser template."""
    block = 256
    order = F.struct(-F.col("n"), -F.col("likeness"), "start", "t", "end")
    touched = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)))
    ranked = materialize(spans.distinct().withColumn("order", order), "spans")
    left = ranked.withColumn("block", touched)
    right = left.select("dk", "th", "block", F.col("start").alias("s"), F.col("end").alias("e"), F.col("order").alias("o"))
    on = (left["dk"] == right["dk"]) & (left["th"] == right["th"]) & (left["block"] == right["block"]) & (right["s"] < left["end"]) & (right["e"] > left["start"]) & (right["o"] < left["order"])
    beaten = left.join(right.hint("merge"), on, "left_semi").select("dk", "th", "order").distinct()
    return ranked.join(beaten.hint("merge"), ["dk", "th", "order"], "left_anti").drop("order")


def license_spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """(carried, n_words, places, spans) for every row; carried is a struct of all columns but text.

    ``places`` (start, end, label, likeness) are the places of the phrases, all of them; ``spans``, likewise, those where a
    template was verified and no better one overlaps. Both are sorted, with starts and ends in words. A null, empty
    or blank text has no words and empty lists; rows that repeat an id and a text find the same; an empty table gives
    no rows; columns of ``docs`` may have any names.
    """
    spark = docs.sparkSession
    every = [*phrases, *templates]
    grams = template_grams(spark, every, len(phrases))
    met = votes(docs, grams)
    found = verified(met)
    base, more = found.where(F.col("t") < len(phrases)), found.where(F.col("t") >= len(phrases))
    labels = F.array(*(F.lit(label) for label, _ in every))
    kept = base.withColumn("base", F.lit(True)).unionByName(best_spans(more).withColumn("base", F.lit(False)))
    span = F.struct("start", "end", F.element_at(labels, F.col("t") + 1).alias("label"), "likeness")
    lists = kept.groupBy("dk", "th").agg(
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("places"),
        F.sort_array(F.collect_list(F.when(~F.col("base"), span))).alias("spans"),
    )
    none = F.array().cast(lists.schema["places"].dataType)
    rows = met.where("t = -1").select("carried", "dk", "th", "n_words").join(lists.hint("merge"), ["dk", "th"], "left")
    return rows.select("carried", "n_words", F.coalesce("places", none).alias("places"), F.coalesce("spans", none).alias("spans"))


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    """Base places and labels of every document, the labels of all templates, and the greatest likeness.

    A null or empty text has no words and places, nulls for the first and last, empty labels and a score of 0. Repeated rows each
    give a row; an empty table gives none.
    """
    found = license_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    every = F.concat("places", "spans")
    starts = F.transform("places", lambda s: s["start"].cast("long"))
    return found.select(
        "carried.doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(F.col("places")).alias("base_labels"),
        names(every).alias("labels"),
        F.coalesce(F.array_max(F.transform(every, lambda s: s["likeness"])), F.lit(0.0)).alias("score"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )


__all__ = ["PHRASES", "TEMPLATES", "best_spans", "license_spans", "op12_license_scan", "template_grams", "verified", "votes"]
