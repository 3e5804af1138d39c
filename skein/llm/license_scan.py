"""License scans: min-hash bands over overlapping text windows retrieve templates, exact shingle containment verifies; DataFrame
functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Wordings of public license notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

SHINGLE = 5
#: Bands of one min-hash each. A window around a template of which four fifths of the shingles are there has a Jaccard similarity of
#: about 0.55 with it or more, so it shares none of twelve bands with probability below 0.0001.
BANDS = 12
NUM, DEN = 4, 5
WORD = r"[\p{L}\p{N}]+"


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def shape(n: int) -> tuple[int, int]:
    """Stride and words of the windows for templates of n words: every run of n words lies in one."""
    stride = max(1, n // 4)
    return stride, n + stride - 1


def triggers(templates: dict[str, str]) -> list[str]:
    """Words of which any run of text that contains NUM/DEN of a template's shingles has one: per template as many words, longest
    first, as leave less than that part of its shingles without one."""
    chosen: list[str] = []
    for text in templates.values():
        own = words(text)
        n = min(SHINGLE, len(own))
        shingles = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for w in [*chosen, *sorted(set(own), key=lambda w: (-len(w), w))]:
            if DEN * sum(not set(s) & set(chosen) for s in shingles) < NUM * len(shingles):
                break
            if w not in chosen:
                chosen.append(w)
    return sorted(chosen)


def _shingle_hashes(ws: Column) -> Column:
    """Hashes of all runs of SHINGLE words; of fewer, but not none, the one run of all."""
    size = F.size(ws)
    return F.when(size == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - SHINGLE + 1)), lambda i: F.xxhash64(F.slice(ws, i, SHINGLE))))


def _signature(shingles: Column) -> Column:
    return F.array(*[F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(b)))) for b in range(BANDS)])  # noqa: B023


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, n_licenses int, licenses array<string>, best double, spans array<struct<license, start, words, containment>>) for each
    distinct (doc_id, text) of docs: the templates of which a window of the text contains four fifths of the five-word
    shingles or more, by name, with the window (from 0, in words) that contains most, the first such.

    Words are lower-cased runs of letters and digits. Windows have the template's length and a quarter more, and go on by a
    quarter. Windows without any trigger word are not made: none of them can reach four fifths. Templates are code, a fixed few, and
    sent to all tasks. Null, empty and wordless texts have no license; rows that repeat doc_id and text give one row; an
    empty table none; further columns are ignored.
    """
    spark = docs.sparkSession
    rare = triggers(templates)
    rows = spark.createDataFrame([(name, words(t)) for name, t in templates.items()], "license string, ws array<string>")
    known = rows.select("license", F.size("ws").alias("cls"), F.array_distinct(_shingle_hashes(F.col("ws"))).alias("want"))
    bands = known.select("license", "cls", "want", F.posexplode(_signature(F.col("want"))).alias("band", "h"))

    keyed = docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"), "text")
    hit = keyed.where(F.col("text").rlike("(?iu)" + "|".join(rare)))
    split = hit.select("doc_id", "th", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("ws"))
    at = split.withColumn("at", F.array_compact(F.transform("ws", lambda w, i: F.when(w.isin(*rare), i)))).where(F.size("at") > 0)
    at = at.withColumn("sh", _shingle_hashes(F.col("ws"))).select("doc_id", "th", "at", "sh")
    classes = sorted({len(words(t)) for t in templates.values()})
    starts = []
    for n in classes:
        stride, width = shape(n)
        first = lambda p: F.greatest(F.lit(0), F.ceil((p - width + 1) / stride).cast("int"))  # noqa: B023, E731
        grid = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(first(p), F.floor(p / stride).cast("int")))))  # noqa: B023
        starts.append(F.transform(grid, lambda k: F.struct(F.lit(n).alias("cls"), (k * stride).alias("start"), F.lit(width).alias("width"))))  # noqa: B023
    windows = at.withColumn("w", F.explode(F.concat(*starts))).select(
        "doc_id", "th", "w.cls", "w.start", "w.width", F.array_distinct(F.slice("sh", F.col("w.start") + 1, F.greatest(F.lit(1), F.col("w.width") - SHINGLE + 1))).alias("own")
    ).where(F.size("own") > 0)
    met = windows.withColumn("sig", _signature(F.col("own"))).select("*", F.posexplode("sig").alias("band", "h")).join(F.broadcast(bands), ["cls", "band", "h"])
    share = F.size(F.array_intersect("own", "want"))
    good = met.where(DEN * share >= NUM * F.size("want")).select("doc_id", "th", "license", F.struct((-share / F.size("want")).alias("less"), F.col("start"), F.col("width")).alias("found"))
    best = good.groupBy("doc_id", "th", "license").agg(F.min("found").alias("found"))
    spans = best.select("doc_id", "th", F.struct("license", F.col("found.start").alias("start"), F.col("found.width").alias("words"), (-F.col("found.less")).alias("containment")).alias("span"))
    every = keyed.select("doc_id", "th", F.lit(None).cast(spans.schema["span"].dataType).alias("span")).unionByName(spans)
    out = every.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    return out.select("doc_id", F.size("spans").alias("n_licenses"), F.transform("spans", lambda s: s["license"]).alias("licenses"), F.array_max(F.transform("spans", lambda s: s["containment"])).alias("best"), "spans")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
