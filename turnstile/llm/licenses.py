"""License scans: MinHash bands over overlapping windows, then exact containment.

DataFrame operations only. Texts and templates are lower-cased words
(``[0-9a-z]+``) and shingles of ``SHINGLE`` words; a template of fewer words is one
shingle of its own length and matches wherever these words follow each other.

Templates are dealt by length into classes. A class cuts a text into windows of
``2 * stride`` shingles, each overlapping the next by half, so that any passage
of a template's length lies in one window. Of a window only shingles that stand
in some template of its class are signed: the rest can't add to containment.
``BANDS`` bands of one MinHash each retrieve templates: a pair of similarity s
meets with probability ``1 - (1 - s) ** BANDS``, over 0.999 from s = 0.1 on. What
meets is verified: the share of the template's shingles in the window must reach
``LEAST``.

Before that, texts without any marker word are left out. Markers are chosen so
that more than ``1 - LEAST`` of each template's shingles hold one, so a text
without them can't reach ``LEAST`` for any template.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
LEAST = 0.8
BANDS = 64

#: Fixed texts of common notices.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-line": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_words(text: str) -> list[str]:
    return re.findall("[0-9a-z]+", text.lower())


def template_shingles(text: str) -> list[str]:
    words = template_words(text)
    n = max(1, len(words) - SHINGLE + 1)
    return list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(n)))


def stride_of(text: str) -> int:
    """A template's class: the power of two that holds its shingles; 0 is for short notices."""
    words = template_words(text)
    if len(words) < SHINGLE:
        return 0
    return max(8, 1 << (len(words) - SHINGLE).bit_length())


def markers(templates: dict[str, str] = TEMPLATES) -> list[str]:
    """Words of which every text with a template has at least one, rarest-looking (longest) first."""
    chosen: list[str] = []
    for text in templates.values():
        shingles = template_shingles(text)
        words = sorted(set(template_words(text)), key=lambda w: (w not in chosen, -len(w), w))
        own: list[str] = []
        while sum(any(w in s.split() for w in own) for s in shingles) <= (1 - LEAST) * len(shingles):
            own.append(words[len(own)])
        chosen += [w for w in own if w not in chosen]
    return [w for w in chosen if not any(o != w and o in w for o in chosen)]


def _template_tables(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """One row per template and shingle hash; their number is that of the given texts' words."""
    rows = [(name, stride_of(text), len(template_shingles(text)), s) for name, text in templates.items() for s in template_shingles(text)]
    table = spark.createDataFrame(rows, "license string, stride int, n_shingles int, shingle string")
    return table.select("license", "stride", "n_shingles", F.xxhash64("shingle").alias("h"))


def _signature(h: Column) -> list[Column]:
    return [F.min(F.xxhash64(h, F.lit(b))).alias(f"b{b}") for b in range(BANDS)]


def find_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document and license found: ``doc_id``, ``license``, ``n_shared``, ``containment``.

    ``containment`` is the best window's share of the template's shingles, and
    ``n_shared`` their number.

    Null and empty texts have no license. A null id stays null. Rows with one id
    and one text give one result. Other columns are not read. An empty table
    gives an empty table. A very long text with a marker word is one value, and so
    is the list of its shingles.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    signed = _template_tables(spark, templates)
    # One pass over the raw text; only what passes is lower-cased and cut into words.
    marked = docs.where(F.col(text_col).rlike("(?i)" + "|".join(markers(templates))))
    text = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    some = marked.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), text.alias("t"))

    # Shingles of the text at their places: of the usual length, and of each short template's.
    words = F.filter(F.split("t", "[^0-9a-z]+"), lambda w: w != "")
    cut = some.withColumn("w", words)

    def running(n: int) -> DataFrame:
        places = F.sequence(F.lit(1), F.size("w") - (n - 1))
        shingles = F.when(F.size("w") >= n, F.transform(places, lambda i: F.xxhash64(F.concat_ws(" ", F.slice("w", i, n)))))
        return cut.select("doc_id", "key", F.posexplode(shingles).alias("at", "h"), F.lit(n < SHINGLE).alias("short"))

    lengths = {min(SHINGLE, len(template_words(text))) for text in templates.values()}
    known = signed.select("stride", "h").distinct()
    rows = reduce(DataFrame.unionByName, map(running, sorted(lengths))).join(F.broadcast(known), "h").where(F.col("short") == (F.col("stride") == 0))
    at = F.when(F.col("stride") == 0, F.col("at")).otherwise(F.floor(F.col("at") / F.greatest("stride", F.lit(1))))
    window = F.explode(F.when(F.col("stride") == 0, F.array(at)).otherwise(F.array(at - 1, at)))
    windows = rows.select("doc_id", "key", "stride", window.alias("window"), "h")
    # A window's set is at most its class's shingles, a fixed number.
    own = windows.groupBy("doc_id", "key", "stride", "window").agg(F.collect_set("h").alias("own"), *_signature(F.col("h")))
    bands = F.posexplode(F.array(*[F.col(f"b{b}") for b in range(BANDS)])).alias("band", "low")
    theirs = signed.groupBy("license", "stride", "n_shingles").agg(F.collect_set("h").alias("theirs"), *_signature(F.col("h")))
    theirs = theirs.select("license", "stride", "n_shingles", "theirs", bands)
    met = own.select("doc_id", "key", "stride", "window", "own", bands).join(F.broadcast(theirs), ["stride", "band", "low"])
    met = met.withColumn("n_shared", F.size(F.array_intersect("own", "theirs")).cast("long"))
    good = met.where(F.col("n_shared") >= F.lit(LEAST) * F.col("n_shingles"))
    best = good.groupBy("doc_id", "key", "license").agg(F.max("n_shared").alias("n_shared"), F.max("n_shingles").alias("n"))
    return best.select("doc_id", "license", "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))
