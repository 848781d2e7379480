"""License scans with DataFrame operations only.

Templates are licence statements. TF-IDF vectors take their document frequencies from the
templates, where common words count as in all; a token that no template has weighs most. Units of every whole text, its lines and the
windows of ``WINDOW`` lines or fewer (statements wrap), and the whole text of files named like a
licence are compared by sparse cosine with all templates. By Cauchy and Schwarz a cosine is at
most the norm of the template's tokens that a unit holds. So a template's commonest words may be
left out as long as their norm is below ``SIMILAR``, and only units with one of the others are
scored; no other unit can reach the threshold. A unit is scored in its own row, without a shuffle.

A file without a licence of its own inherits that of the nearest directory above it whose licence
file (LICENSE, LICENCE, COPYING or NOTICE) has one. Directories are resolved once each, by joins of
paths with their ancestors, and files join their own directory.

Edge cases: null and empty texts have no licence of their own but inherit; a null path has no
directory; of equal scores the licence first by name stands, of several licence files in one
directory the best score; rows that share a path are one file with the best score of all its rows,
repeated in the result; texts of any length are read whole, in time that grows with n log n of
their tokens; names of other columns do not matter, as only ``keep`` is returned; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, text_of

SIMILAR = 0.6
WINDOW = 3
_WORD = "[a-z0-9.]*[a-z0-9]"

# Common English words, which weigh as if all templates had them.
COMMON = "a all an and any are as at be but by can for from has have if in is it its may no not of on or other such than that the this to under use used which will with without you"

# Licence names and their usual statements.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)


def _tokens(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


class Weights:
    """TF-IDF of the templates: idf, unit vectors and the tokens one of which a match must have."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, similar: float = SIMILAR):
        bags = [_tokens(t) for _, t in templates]
        df: dict[str, int] = {}
        for bag in bags:
            for w in set(bag):
                df[w] = df.get(w, 0) + 1
        common = dict.fromkeys(COMMON.split(), 1.0)
        self.idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()} | common
        self.unknown = math.log(1 + len(bags)) + 1
        self.vectors: list[tuple[str, dict[str, float]]] = []
        self.needed: set[str] = set()
        for (name, _), bag in zip(templates, bags, strict=True):
            raw = {w: bag.count(w) * self.idf[w] for w in bag}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            self.vectors.append((name, {w: x / norm for w, x in raw.items()}))
            left = 0.0
            for w in sorted(raw, key=lambda w: (w not in common, len(w), w)):
                left += (raw[w] / norm) ** 2
                if math.sqrt(left) >= similar - 1e-9:
                    self.needed.add(w)


def directory(path: Column) -> Column:
    """All before the last slash; empty at the top, null for a null path."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), ""))


def _is_license_file(path: Column) -> Column:
    return F.coalesce(path.rlike("(?i)(^|/)(licen[cs]e|copying|notice)([.][a-z]+)?$"), F.lit(False))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def best_match(tokens: Column, weights: Weights) -> Column:
    """One struct(s, license), in an array, of the template with the greatest cosine; s is its negative."""
    names = [name for name, _ in weights.vectors]
    values = {w: [x, *[x * vector.get(w, 0.0) for _, vector in weights.vectors]] for w, x in weights.idf.items()}
    table = F.from_json(F.lit(json.dumps(values)), "map<string,array<double>>")
    square = lambda x: x * x
    start = F.struct(F.lit("").alias("token"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))

    def count(s: Column, t: Column) -> Column:
        # Equal tokens follow one another in sorted order.
        more = F.struct(s["token"].alias("token"), (s["n"] + 1).alias("n"), s["sum"].alias("sum"))
        return F.when(t == s["token"], more).otherwise(F.struct(t.alias("token"), F.lit(1.0).alias("n"), (s["sum"] + square(s["n"])).alias("sum")))

    def total(entries: Column, value) -> Column:
        return F.aggregate(entries, F.lit(0.0), lambda s, e: s + value(e))

    def counted(tokens: Column) -> Column:
        squares = F.aggregate(F.sort_array(tokens), start, count, lambda s: s["sum"] + square(s["n"]))
        known = F.transform(F.array_intersect(tokens, F.array(*[F.lit(w) for w in sorted(weights.idf)])), lambda t: F.struct(
            (F.size(tokens) - F.size(F.array_remove(tokens, t))).cast("double").alias("n"), F.try_element_at(table, t).alias("v")))
        return F.struct(squares.alias("squares"), known.alias("known"))

    def weighed(b: Column) -> Column:
        # All tokens weigh as unknown ones but the known, which weigh what the templates give them.
        others = square(F.lit(weights.unknown)) * (b["squares"] - total(b["known"], lambda e: square(e["n"])))
        return F.struct(F.sqrt(others + total(b["known"], lambda e: square(e["n"] * e["v"][0]))).alias("norm"), b["known"].alias("known"))

    def part(k: int):
        return lambda e: e["n"] * e["v"][k]

    def least(b: Column) -> Column:
        return F.array_min(F.array(*[F.struct((-F.round(total(b["known"], part(k + 1)) / b["norm"], 6)).alias("s"), F.lit(name).alias("license")) for k, name in enumerate(names)]))

    # Each step binds what the next one uses often, so that it is computed once.
    return F.transform(F.transform(F.transform(F.array(tokens), counted), weighed), least)


def _windows(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("lines") - n + 1), lambda k: F.flatten(F.slice("lines", k, n)))


def own_licenses(files: DataFrame, weights: Weights) -> DataFrame:
    """path, license and score of the files with a statement that matches a template."""
    needed = F.array(*[F.lit(w) for w in sorted(weights.needed)])
    rows = files.where("path is not null").select("path", F.lower("text").alias("text"))
    rows = rows.where(F.arrays_overlap(_words(F.col("text")), needed))
    rows = rows.select("path", F.transform(F.split("text", "\n"), _words).alias("lines"))
    none = F.array().cast("array<array<string>>")
    units = [F.col("lines")]
    for n in range(2, WINDOW + 1):
        units.append(F.when(F.size("lines") >= n, _windows(n)).otherwise(none))
    units.append(F.when(_is_license_file(F.col("path")) & (F.size("lines") > WINDOW), F.array(F.flatten("lines"))).otherwise(none))
    rows = rows.select("path", F.explode(F.concat(*units)).alias("unit")).where(F.arrays_overlap("unit", needed))
    scored = rows.select("path", F.explode(best_match(F.col("unit"), weights)).alias("b")).where(F.col("b.s") <= -SIMILAR)
    return scored.groupBy("path").agg(F.min("b").alias("b")).select("path", "b.license", (-F.col("b.s")).alias("score"))


def nearest(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """directory, license and from_directory: the nearest licensed directory at or above each."""
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    rows = directories.select("directory", F.posexplode(F.when(F.col("directory") == "", F.array(F.lit(""))).otherwise(above)).alias("depth", "up"))
    met = rows.join(licensed.select(F.col("directory").alias("up"), "license"), "up")
    last = F.max(F.struct("depth", "up", "license"))
    return met.groupBy("directory").agg(last.alias("x")).select("directory", F.col("x.license").alias("license"), F.col("x.up").alias("from_directory"))


def scan(files: DataFrame, path: str | Column = "path", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, path, license, score, basis (own, inherited or none) and from_directory of every file."""
    prepare(files.sparkSession)
    at = F.col(path) if isinstance(path, str) else path
    rows = files.select(*[F.col(k).alias(f"k_{k}") for k in keep], at.alias("path"), text_of(text).alias("text"))
    own = cut(own_licenses(rows.select("path", "text"), Weights()))
    named = own.where(_is_license_file(F.col("path"))).withColumn("directory", directory(F.col("path")))
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("license"), F.col("path")))
    licensed = cut(named.groupBy("directory").agg(best.alias("b")).select("directory", "b.license"))
    places = rows.drop("text").withColumn("directory", directory(F.col("path")))
    found = cut(nearest(places.select("directory").where("directory is not null").distinct(), licensed))
    joined = places.join(own.select("path", F.col("license").alias("own"), "score"), "path", "left").join(found, "directory", "left")
    return joined.select(
        *[F.col(f"k_{k}").alias(k) for k in keep], "path", F.coalesce("own", "license").alias("license"), "score",
        F.when(F.col("own").isNotNull(), "own").when(F.col("license").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.when(F.col("own").isNull(), F.col("from_directory")).alias("from_directory"))
