"""License scan (op 7), in DataFrame functions only.

Words are runs of letters and digits, lower case; shingles are word pairs. Texts are read in windows of 12
shingles every 4, templates in pieces of at most 9, so every piece lies whole in a window. A window's MinHash signature has ``BANDS`` values (bands of one row): a template of only four shingles
meets its window with odds of 1 - (2/3)^16 = 0.998, one of nine with 1 - (1/4)^16. Templates found
that way, if the window holds half of the piece, are verified by exact shingle containment around the window. Where templates share what they found
(versions and variants of a license), the best contained one stays, of those the longest.

Null or short texts hold no license. Rows with one doc_id and text give one result. Null doc_id is
kept as null. Very long texts are read whole. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import common as C

# Public license notices by SPDX identifier.
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD2 = (
    BSD + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
BSD3 = (
    BSD2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission."
)
CC = "This work is licensed under a Creative Commons {} International License."
LATER = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software "
    "Foundation; either version {} of the License, or (at your option) any later version."
)
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("AGPL-3.0", LATER.format("Affero General Public License", "3")),
    ("BSD", BSD),  # the sentence that the variants share, where no clauses follow
    ("BSD-2-Clause", BSD2),
    ("BSD-3-Clause", BSD3),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("CC-BY-4.0", CC.format("Attribution 4.0")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", CC.format("Attribution-NonCommercial 4.0")),
    ("CC-BY-NC-ND-4.0", CC.format("Attribution-NonCommercial-NoDerivatives 4.0")),
    ("CC-BY-NC-SA-4.0", CC.format("Attribution-NonCommercial-ShareAlike 4.0")),
    ("CC-BY-ND-4.0", CC.format("Attribution-NoDerivatives 4.0")),
    ("CC-BY-SA-4.0", CC.format("Attribution-ShareAlike 4.0")),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain worldwide."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", LATER.format("General Public License", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", LATER.format("General Public License", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
WIDTH, STRIDE, PIECE, BANDS = 12, 4, 9, 16


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hashes of word pairs, in order. ``words`` must be a column of its own, as it is read per pair."""
    last = F.size(words) - 2
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))


def _flip(mark: int):
    return lambda x: x.bitwiseXOR(F.lit(mark))


def signature(shingles: Column) -> list[Column]:
    """Least hash under each of the permutations (xor with fixed values)."""
    marks = [((k + 1) * C.BASE & C.MASK) - (1 << 63) for k in range(BANDS)]
    return [F.array_min(F.transform(shingles, _flip(m))) for m in marks]


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """``doc_id, license, containment, first_word`` for each license that a text holds."""
    spark = docs.sparkSession
    own = spark.createDataFrame(TEMPLATES if templates is None else templates, "license string, notice string")
    own = own.select("license", "notice", words_of(F.col("notice")).alias("words")).select("license", "notice", shingles_of(F.col("words")).alias("whole"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("whole") - PIECE, F.lit(0)), F.lit(STRIDE))
    numbered = [F.xxhash64("license", "notice").alias("notice_id")]
    own = own.select(*numbered, "license", "whole")
    pieces = own.filter(F.size("whole") > 0).select("notice_id", "whole", F.explode(F.array_distinct(F.concat(starts, F.array(F.greatest(F.size("whole") - PIECE, F.lit(0)))))).alias("piece_at"))
    pieces = pieces.select("notice_id", "piece_at", F.slice("whole", F.col("piece_at") + 1, PIECE).alias("piece"))
    pieces = pieces.select("notice_id", "piece_at", "piece", F.array(*signature(F.col("piece"))).alias("v"))
    # As many rows as bands and template pieces: bounded by the list of templates, not by the data.
    pieces = C.stored(pieces.select("notice_id", "piece_at", "piece", F.posexplode("v").alias("band", "v")), "license-bands")
    keyed = C.text_keys(docs)
    texts = keyed.select("k1", "k2", words_of(F.col("text")).alias("words")).select("k1", "k2", shingles_of(F.col("words")).alias("own"))
    at = F.when(F.size("own") > 0, F.sequence(F.lit(0), F.greatest(F.size("own") - 1, F.lit(0)), F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))
    # Values that no template has are dropped while they are still an array; windows left without any give no row.
    known = [r.v for r in pieces.select("v").distinct().collect()]
    windows = F.transform(at, lambda i: F.struct((i / STRIDE).cast("int").alias("window"), F.slice("own", i + 1, WIDTH).alias("w")))
    valued = F.transform(windows, lambda x: F.struct(x.window.alias("window"), x.w.alias("w"), F.filter(F.array(*signature(x.w)), lambda v: v.isin(known)).alias("v")))
    found = texts.select("k1", "k2", F.explode(F.filter(valued, lambda x: F.size(x.v) > 0)).alias("x"))
    found = found.select("k1", "k2", "x.window", "x.w", F.explode("x.v").alias("v")).join(F.broadcast(pieces.drop("band")), "v")
    # A piece counts where its window holds half of it: checked in the same row, before any exchange.
    found = found.filter(F.size(F.array_intersect("piece", "w")) >= F.size(F.array_distinct("piece")) * 0.5)
    found = found.select("k1", "k2", "notice_id", "piece_at", "window").distinct()
    found = C.stored(found, "license-candidates")
    # Around the window: as much as the template holds on both sides of the piece.
    begin = F.greatest(F.col("window") * STRIDE - F.col("piece_at") - WIDTH, F.lit(0))
    texts = keyed.dropDuplicates(["k1", "k2"]).join(found.select("k1", "k2").distinct(), ["k1", "k2"])
    texts = texts.select("k1", "k2", words_of(F.col("text")).alias("words")).select("k1", "k2", shingles_of(F.col("words")).alias("own"))
    found = found.join(texts, ["k1", "k2"]).join(F.broadcast(own), "notice_id")
    around = F.slice("own", begin + 1, F.size("whole") + 3 * WIDTH)
    matched = F.array_intersect("whole", around)
    found = found.select(
        "k1", "k2", "license", "whole", matched.alias("matched"), (F.size(matched) / F.size(F.array_distinct("whole"))).alias("containment"),
        (begin + F.array_position(around, F.element_at(F.array_intersect(around, "whole"), 1)) - 1).alias("first_word"),
    )
    found = found.filter(F.col("containment") >= least).distinct()

    def beaten(x):
        """Another template at this place holds all that ``x`` shares with the text, and is better contained, or as well and longer."""

        def beats(y):
            near = (y.first_word <= x.first_word + F.size(x.whole)) & (x.first_word <= y.first_word + F.size(y.whole))
            better = F.struct(y.containment, F.size(y.whole)) > F.struct(x.containment, F.size(x.whole))
            return near & better & (F.size(F.array_except(x.matched, y.whole)) == 0)

        return beats

    hit = F.struct("license", "whole", "matched", "containment", "first_word")
    found = found.groupBy("k1", "k2").agg(F.collect_list(hit).alias("hits"))
    best = F.filter("hits", lambda x: ~F.exists("hits", beaten(x)))
    found = found.select("k1", "k2", F.explode(best).alias("x")).select("k1", "k2", "x.license", "x.containment", "x.first_word")
    found = found.groupBy("k1", "k2", "license").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"))
    return found.select(C.doc_id_of(F.col("k1")).alias("doc_id"), "license", "containment", F.col("first_word").cast("long").alias("first_word"))
