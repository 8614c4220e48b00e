"""Licence scan: TF-IDF cosine of headers, lines and licence files to templates, then inheritance by path joins.

A passage is a line, the header of a file (what stands before its first blank line), or the whole of a
licence file. Each different passage is a sparse vector over all its words, scored once however often it
is copied; a word's inverse document frequency comes from the files of the whole corpus that hold it.
Passages that mention a licence have a score; of the others those that reach the threshold, and only
those are left unscored that provably cannot. A file's own licence is that of its best passage. A file
without one takes the licence of the licence file in the nearest directory above it: each directory
meets its ancestors in one join on paths, and files meet their directory in another.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeharbor.llm.common import ascii_lower, written

NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPLv3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0"],
}
SENTENCES = (
    "Licensed under {}.", "Released under the {}.", "This work is licensed under a {}.", "This file is licensed under the {}, see the LICENSE file for details.",
    "This project is licensed under the terms of the {}.",
)
OWN_WORDS = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted."],
    "GPL-3.0": ["it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
                "You should have received a copy of the GNU General Public License along with this program."],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
TEMPLATES = {
    name: [f"SPDX-License-Identifier: {name}", *(s.format(n) for n in names for s in SENTENCES), *OWN_WORDS.get(name, [])] for name, names in NAMES.items()
}
#: A passage mentions a licence if it holds one of these, in any case; it has a score below the threshold, too.
MENTIONS = ("licen", "spdx", "permission is hereby", "redistribution and use")
STOP = set("a an and any are by for in is of or the this to use with without work".split())
THRESHOLD = 0.6
FREQUENT = 1000  # words that the bound knows by name; it leaves out nothing, whatever their number
ADDED = ("own_license", "own_score", "license", "inherited_from", "levels_up")
LICENCE_FILE = r"(?i)(^|/)(LICEN[SC]E|COPYING|NOTICE)([.-][^/]*)?$"


def words(text: str) -> list[str]:
    """Lower-case runs of ASCII letters and digits, dots kept inside, without stop words."""
    found = re.findall(r"[a-z0-9]+(?:\.[a-z0-9]+)*", text.lower())
    return [w for w in found if w not in STOP]


def _words(line: Column) -> Column:
    found = F.regexp_extract_all(ascii_lower(line), F.lit(r"([a-z0-9]++(?:\.[a-z0-9]++)*)"), 1)
    return F.filter(found, lambda w: ~w.isin(sorted(STOP)))


def _mentions(lowered: Column) -> Column:
    return reduce(or_, [F.contains(lowered, F.lit(m)) for m in MENTIONS])


class Bound(NamedTuple):
    """Weights of the template words, the most frequent words, and the least weight of any that is neither."""

    idf: dict[str, float]
    frequent: list[str]
    least: float

    def reaches(self, ws: Column, hits: Column, threshold: float) -> Column:
        """False only for words whose cosine to no template can be `threshold`; hits are those of templates.

        With t the part of the vector on template words and r the rest, a cosine is at most |t| / |(t, r)|.
        A frequent word weighs at least 1 and any other at least `least`, wherever it stands.
        """
        goal = threshold - 1e-6  # scores are rounded
        if goal <= 0:
            return F.lit(True)
        weights = F.map_from_arrays(F.array(*map(F.lit, self.idf)), F.array(*map(F.lit, self.idf.values())))
        each = F.transform(F.array_distinct(hits), lambda w: F.pow(F.size(F.filter(hits, lambda h: h == w)) * weights[w], F.lit(2.0)))
        room = F.aggregate(each, F.lit(0.0), lambda total, x: total + x) * ((1 / goal**2 - 1) * (1 + 1e-9))
        others = F.size(ws) - F.size(hits)
        rare = F.size(F.filter(ws, lambda w: ~w.isin([*self.idf, *self.frequent])))
        return (room >= others) & (room >= others + rare * (self.least**2 - 1))


def _passages(text: Column, path: Column, bound: Bound, threshold: float) -> Column:
    """The passages of a text that may count, as their words and whether they mention a licence."""
    lowered = ascii_lower(F.coalesce(text.cast("string"), F.lit("")))
    lines = F.split(lowered, "\n")
    header = F.split(lowered, r"\n[ \t\r]*\n", 2)[0]
    header = F.when(F.contains(header, F.lit("\n")), F.array(header))
    whole = F.when(path.rlike(LICENCE_FILE), F.array(lowered))
    none = F.array().cast("array<string>")
    found = F.concat(lines, F.coalesce(header, none), F.coalesce(whole, none))
    found = F.transform(found, lambda passage: F.struct(_words(passage).alias("ws"), _mentions(passage).alias("says")))
    found = F.transform(found, lambda x: F.struct(x["ws"].alias("ws"), x["says"].alias("says"), F.filter(x["ws"], lambda w: w.isin(sorted(bound.idf))).alias("hits")))
    return F.filter(found, lambda x: (F.size(x["hits"]) > 0) & (x["says"] | bound.reaches(x["ws"], x["hits"], threshold)))


def document_frequencies(files: DataFrame, text: str) -> DataFrame:
    """(w, df): how many of the files hold each word.

    Words are counted per task first; what is shuffled are distinct words.
    """
    held = files.select(F.explode(F.array_distinct(_words(F.coalesce(F.col(text).cast("string"), F.lit(""))))).alias("w"))
    return held.groupBy("w").agg(F.count("*").alias("df"))


def _weight(n: int, df: Column) -> Column:
    return F.log(F.lit(float(n + 1)) / (df + 1)) + 1


def bound_of(frequencies: DataFrame, n: int, vectors: list[tuple[str, list[str]]]) -> Bound:
    """From as many rows as templates have words, and those of the FREQUENT words in most files."""
    terms = sorted({w for _, ws in vectors for w in ws})
    known = {r["w"]: r["df"] for r in frequencies.filter(F.col("w").isin(terms)).collect()}
    most = frequencies.orderBy(F.desc("df"), "w").limit(FREQUENT + 1).collect()
    idf = {t: math.log((n + 1) / (known.get(t, 0) + 1)) + 1 for t in terms}
    least = math.log((n + 1) / (most[FREQUENT]["df"] + 1)) + 1 if len(most) > FREQUENT else 1.0
    return Bound(idf, [r["w"] for r in most[:FREQUENT]], least)


def scores(passages: DataFrame, frequencies: DataFrame, n: int, vectors: list[tuple[str, list[str]]], idf: dict[str, float]) -> DataFrame:
    """(k, best): struct(score, at, name) of the template with the largest cosine to passages(k, ws).

    Templates are words and counts in the plan.
    """
    terms = list(idf)
    units = []
    for _, ws in vectors:
        raw = {w: ws.count(w) * idf[w] for w in set(ws)}
        size = math.sqrt(sum(raw[w] ** 2 for w in sorted(raw)))
        units.append({w: v / size for w, v in raw.items()})
    rows = passages.select("k", F.explode("ws").alias("w")).groupBy("k", "w").agg(F.count("*").alias("tf"))
    rows = rows.join(frequencies, "w").select("k", "w", (F.col("tf") * _weight(n, F.col("df"))).alias("v"))
    weights = F.map_from_arrays(F.array(*map(F.lit, terms)), F.array(*[F.array(*[F.lit(u.get(t, 0.0)) for u in units]) for t in terms]))
    rows = rows.withColumn("t", F.when(F.col("w").isin(terms), weights[F.col("w")]))
    dots = [F.sum(F.col("v") * F.get("t", i)).alias(f"d{i}") for i in range(len(units))]
    summed = rows.groupBy("k").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"), *dots)
    # the largest cosine; among equals the first template
    each = [F.struct(F.round(F.coalesce(F.col(f"d{i}"), F.lit(0.0)) / F.col("size"), 6).alias("score"), F.lit(-i).alias("at"), F.lit(name).alias("name")) for i, (name, _) in enumerate(vectors)]
    return summed.select("k", F.greatest(*each).alias("best")).filter("best.score > 0")


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None, path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The files, without their text, with own_license, own_score, license, inherited_from, levels_up.

    own_score is the best cosine of a passage of the file that mentions a licence or reaches the threshold
    (null without one that shares a word with a template), own_license its template's name from the threshold on. A file without one inherits from
    the nearest directory, its own first, whose licence file has one; of several in a directory the best
    score, then the smallest path, counts. Columns of the input with the name of an added one are left
    out, others may have any name. Null and empty texts have no passage; a null path inherits nothing.
    Repeated rows stay; an empty table gives no rows.
    """
    templates = templates or TEMPLATES
    others = [c for c in files.columns if c not in (path, text, *ADDED)]
    kept = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    vectors = [(name, words(t)) for name, ts in sorted(templates.items()) for t in ts]
    n, counted = files.count(), written(document_frequencies(files, text))
    bound = bound_of(counted, n, vectors)
    named = F.transform(
        _passages(F.col(text), F.col(path), bound, threshold),
        lambda x: F.struct(F.xxhash64(x["ws"], F.lit(1)).alias("a"), F.xxhash64(x["ws"], F.lit(2)).alias("b"), x["ws"].alias("ws"), x["says"].alias("says")))
    base = written(files.select(
        kept.alias("o"), F.col(path).alias("p"), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1).alias("dir"), named.alias("passages"), F.monotonically_increasing_id().alias("row")))
    found = base.filter(F.size("passages") > 0).select("row", F.explode("passages").alias("x")).select("row", F.struct("x.a", "x.b").alias("k"), "x.ws", "x.says")
    passages = written(found.groupBy("k").agg(F.first("ws").alias("ws")))
    wanted = passages.select(F.explode(F.array_distinct("ws")).alias("w")).distinct()
    scored = written(scores(passages, counted.join(wanted, "w", "left_semi"), n, vectors, bound.idf))
    best = found.select("row", "k", "says").join(scored, "k").filter(F.col("says") | (F.col("best.score") >= threshold))
    best = best.groupBy("row").agg(F.max("best").alias("best"))
    rows = base.select("o", "p", "dir", "row").join(best, "row", "left").select(
        "o", "p", "dir", F.when(F.col("best.score") >= threshold, F.col("best.name")).alias("own_license"), F.col("best.score").alias("own_score"))
    rows = written(rows)
    # one row per directory with a licence file
    given = rows.filter(F.col("own_license").isNotNull() & F.col("p").rlike(LICENCE_FILE))
    given = given.groupBy(F.col("dir").alias("up")).agg(F.min(F.struct(-F.col("own_score"), "p", F.col("own_license").alias("lic"))).alias("g")).select("up", "g.lic")
    # every directory and those above it, nearest first
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("levels"), F.array_join(F.slice(parts, 1, F.size(parts) - i), "/").alias("up")))
    dirs = rows.filter("p IS NOT NULL").select("dir").distinct().select("dir", F.inline(above))
    nearest = dirs.join(given, "up").groupBy("dir").agg(F.min(F.struct("levels", "up", "lic")).alias("near"))
    own = F.col("own_license")
    return rows.join(nearest, "dir", "left").select(
        *[F.col(f"o.c{i}").alias(c) for i, c in enumerate(others)], F.col("p").alias(path), "own_license", "own_score", F.coalesce(own, F.col("near.lic")).alias("license"),
        F.when(own.isNull(), F.col("near.up")).alias("inherited_from"), F.when(own.isNull(), F.col("near.levels")).alias("levels_up"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """doc_id, path, text: documents laid out as a tree by source, language and id.

    One document in ten is a licence file, at one of three depths.
    """
    key, source, lang = F.coalesce("doc_id", F.lit(0)), F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    spot = F.concat(F.lit("d"), F.pmod(key, F.lit(64)).cast("string"))
    name = key.cast("string")
    deep = F.concat_ws("/", F.lit(""), source, lang, spot, F.concat(name, F.lit(".txt")))
    licence = F.concat(F.lit("LICENSE."), name)
    level = F.pmod(F.floor(key / 10), F.lit(3))
    at = F.when(level == 0, F.concat_ws("/", F.lit(""), source, licence)).when(level == 1, F.concat_ws("/", F.lit(""), source, lang, licence))
    path = F.when(F.pmod(key, F.lit(10)) == 0, at.otherwise(F.concat_ws("/", F.lit(""), source, lang, spot, licence))).otherwise(deep)
    return docs.select("doc_id", path.alias("path"), F.col("text").cast("string").alias("text"))
