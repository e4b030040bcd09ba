"""Licence scans: text units against licence templates by the Dice coefficient over word bigrams.

Units are the lines of a text, its paragraphs (blocks between blank lines) and the whole text, normalised to lower-case
words of letters and digits. Dice of at least t between sets of a and b bigrams needs t / (2 - t) <= a / b <= (2 - t) / t,
so units outside the bounds of all templates are dropped before any bigram is made, units that share no bigram with any
template next, and the rest meets only the templates whose size bounds it fits. All of it is row-wise DataFrame work: no
shuffle, no join, and a document never leaves its row.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonnage.llm.common import bound

SIMILARITY = 0.8

# fixed values: usual short notices and the opening of usual licence texts
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT notice": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
_FOUND = "array<struct<license:string,dice:double,unit:string>>"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    """Distinct hashes of adjacent words; none for fewer than two words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b)))


def _known(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, list[int]]]:
    """Templates with their bigrams, by name; those of fewer than two words can't be compared and are left out."""
    rows = json.dumps([{"name": n, "text": t} for n, t in sorted(templates.items())])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<name:string,text:string>>")))
    made = table.select("name", _bigrams(_words(F.col("text"))).alias("bigrams")).collect()
    return sorted((r.name, r.bigrams) for r in made if r.bigrams)


def scanned(documents: DataFrame, templates: dict[str, str] = TEMPLATES, similarity: float = SIMILARITY, column: str = "__licenses") -> DataFrame:
    """`documents` with an array column of (license, dice, unit): for each unit that reaches `similarity` with some template,
    the most similar one (ties: first by name), in text order; equal units count once."""
    known = _known(documents.sparkSession, templates)
    if not known:
        return documents.withColumn(column, F.array().cast(_FOUND))
    low, high = similarity / (2 - similarity), (2 - similarity) / similarity
    table = F.from_json(F.lit(json.dumps([{"name": n, "bigrams": b} for n, b in known])), "array<struct<name:string,bigrams:array<bigint>>>")
    every = F.from_json(F.lit(json.dumps(sorted({x for _, b in known for x in b}))), "array<bigint>")
    least = math.ceil(min(len(b) for _, b in known) * low - 1e-9)
    most = math.floor(max(len(b) for _, b in known) * high + 1e-9)

    text = F.coalesce(F.col("text"), F.lit(""))
    blocks = F.when(text.rlike(r"\n\s*\n"), F.split(text, r"\n\s*\n")).otherwise(F.array(text))
    units = F.array_distinct(F.concat(F.split(text, "\n"), blocks, F.array(text)))
    worded = F.transform(units, lambda u: F.struct(u.alias("unit"), _words(u).alias("words")))
    # distinct bigrams are at most words - 1; repeated words only lower the number
    sized = F.filter(worded, lambda x: F.size(x["words"]) > least)
    paired = F.transform(sized, lambda x: F.struct(x["unit"].alias("unit"), _bigrams(x["words"]).alias("bigrams")))
    met = F.filter(paired, lambda x: F.size(x["bigrams"]).between(least, most) & F.arrays_overlap(x["bigrams"], every))

    def best(x: Column) -> Column:
        own = F.size(x["bigrams"])
        fit = F.filter(table, lambda t: (own >= low * F.size(t["bigrams"]) - 1e-9) & (own <= high * F.size(t["bigrams"]) + 1e-9))
        dice = lambda t: 2.0 * F.size(F.array_intersect(x["bigrams"], t["bigrams"])) / (own + F.size(t["bigrams"]))
        ranked = F.transform(fit, lambda t: F.struct((-dice(t)).alias("less"), t["name"].alias("name")))
        first = F.array_min(ranked)
        return F.struct(first["name"].alias("license"), (-first["less"]).alias("dice"), x["unit"].alias("unit"))

    return documents.withColumn(column, F.filter(F.transform(met, best), lambda x: x["dice"] >= similarity - 1e-9).cast(_FOUND))


def licenses(documents: DataFrame, templates: dict[str, str] = TEMPLATES, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_units (that match), license and dice of its best match, licenses (all, sorted by name).

    Null and empty texts match nothing; very long texts are compared unit by unit, whole; repeated rows get equal rows.
    """
    rows = scanned(bound(documents, doc_id="doc_id", text="text"), templates, similarity)
    found = F.col("__licenses")
    top = F.array_min(F.transform(found, lambda x: F.struct((-x["dice"]).alias("less"), x["license"].alias("license"))))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["license"]))), ", ")
    return rows.select("doc_id", F.size(found).cast("bigint").alias("n_units"), top["license"].alias("license"), (-top["less"]).alias("dice"), names.alias("licenses"))
