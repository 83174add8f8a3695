"""Licences of files by sparse TF-IDF cosine, and inheritance by directory.

Headers and whole licence files are compared to templates as TF-IDF vectors of
words and pairs of neighbouring words, so that a version or a family's name
counts.  A header is a line that mentions a licence or copyright, or a paragraph
of several lines that holds one, as notices are wrapped.  Lines of over ``WRAPPED``
characters are not wrapped; such a line is a header by itself only.  The best template of
cosine ``LEAST`` or more, and ``MARGIN`` above that of any other licence, names
the licence; the reservation of all rights does so only where no other licence
is found, as it stands in many notices.  Files without one inherit from the
licence file in the nearest ancestor directory, found by joining the distinct
directories' ancestor paths with the directories that have a licence file.

Terms are lower-cased runs of letters and digits.  The inverse document
frequencies are those of the templates: terms of all templates weigh little, a
term in none of them weighs most and counts in the norm of a header, so other
words lower the score.

Texts are read once, into a table with a row for each file.  Cases: null and
empty texts have no header and may inherit; of several headers, or licence files
in a directory, the best score wins, then the name, then the path; rows that
repeat a path, with one text or several, are files of their own; a null id stays
null; a text of any length is read by lines and paragraphs; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, let

LEAST = 0.6
MARGIN = 0.02

#: A line is a header if it matches this, in either case.
HEADER = r"(?i)licen[cs]e|copyright|spdx|public domain|all rights reserved|creative commons"

#: Lines without a letter or digit end a paragraph.
BLANK_LINES = r"(?:\n[^\p{L}\p{N}\n]*)+\n"

#: Lines of a wrapped paragraph have so many characters at most.
WRAPPED = 160

RESERVED = "proprietary"

# Templates: fixed texts.  Public notices and short licences, whole.
AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_TWO = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
APACHE_AS_IS = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GNU_FREE = "This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
GNU_HOPE = "This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
FREED = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."

#: Licences of the GNU family: (identifier, name, version, what it covers).
GNU = [
    ("GPL-2.0", "General Public License", "2", "program"), ("GPL-3.0", "General Public License", "3", "program"),
    ("LGPL-2.1", "Lesser General Public License", "2.1", "library"), ("LGPL-3.0", "Lesser General Public License", "3", "library"),
    ("AGPL-3.0", "Affero General Public License", "3", "program"),
]

NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", MIT_GRANT),
    ("MIT", " ".join(["MIT License Copyright (c)", MIT_GRANT, MIT_NOTICE, AS_IS])),
    ("ISC", ISC_GRANT),
    ("ISC", " ".join(["ISC License Copyright (c)", ISC_GRANT, ISC_AS_IS])),
    ("ISC", "Released under the ISC License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", f"{APACHE_NOTICE} {APACHE_AS_IS}"),
    ("BSD-2-Clause", " ".join(["Copyright (c) All rights reserved.", BSD_HEAD, BSD_ONE, BSD_TWO, BSD_AS_IS])),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License."),
    ("BSD-3-Clause", " ".join(["Copyright (c) All rights reserved.", BSD_HEAD, BSD_ONE, BSD_TWO, BSD_THREE, BSD_AS_IS])),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    *[(i, GNU_FREE.format(thing=t, name=n, version=v)) for i, n, v, t in GNU],
    *[(i, f"{GNU_FREE} {GNU_HOPE}".format(thing=t, name=n, version=v)) for i, n, v, t in GNU],
    *[(i, f"This work is licensed under the GNU {n}, version {v}.") for i, n, v, _ in GNU],
    *[(i, f"GNU {n} Version {v}") for i, n, v, _ in GNU],
    ("MPL-2.0", MPL_NOTICE),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("Unlicense", FREED),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License (CC BY 4.0)."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License (CC BY-SA 4.0)."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License (CC BY-NC 4.0)."),
    ("CC0-1.0", "Dedicated to the public domain under the Creative Commons Zero license (CC0 1.0)."),
    (RESERVED, "Copyright. All rights reserved."),
]

#: Each licence has its identifier line as a template, too.
TEMPLATES = NOTICES + [(i, f"SPDX-License-Identifier: {i}") for i in dict.fromkeys(i for i, _ in NOTICES) if i != RESERVED]


def terms_of(text: str) -> list[str]:
    """The words of a text, and their neighbouring pairs joined by a space."""
    words = [t for t in re.split(r"[^\w]+|_", text.lower()) if t]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def idf(templates: list[tuple[str, str]]) -> tuple[dict[str, float], float]:
    """The weight of each template term, and that of any other term."""
    df = Counter(t for _, text in templates for t in set(terms_of(text)))
    n = len(templates)
    return {t: math.log((1 + n) / (0.5 + k)) for t, k in df.items()}, math.log((1 + n) / 1.5)


def template_vectors(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(term, idf, weights): the unit weight of the term in each template that has it, as (template, licence, weight)."""
    weight, _ = idf(templates)
    rows: dict[str, list[tuple[int, str, float]]] = {t: [] for t in weight}
    for k, (name, text) in enumerate(templates):
        tf = Counter(terms_of(text))
        norm = math.sqrt(sum((n * weight[t]) ** 2 for t, n in tf.items()))
        for t, n in tf.items():
            rows[t].append((k, name, n * weight[t] / norm))
    data = [(t, weight[t], v) for t, v in sorted(rows.items())]
    return spark.createDataFrame(data, "term string, idf double, weights array<struct<template:int,license:string,weight:double>>")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def terms(text: Column) -> Column:
    """The words of a text, and their neighbouring pairs joined by a space."""
    pairs = lambda ws: F.transform(F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.concat(F.get(ws, i), F.lit(" "), w))
    return let(words(text), lambda ws: F.concat(ws, pairs(ws)))


def paragraphs(text: Column) -> Column:
    """The paragraphs of wrapped lines that hold a header."""
    wrapped = F.regexp_replace(text, f"[^\\n]{{{WRAPPED + 1},}}", "")
    return F.filter(F.split(wrapped, BLANK_LINES, -1), lambda x: F.contains(x, F.lit("\n")) & x.rlike(HEADER))


def headers(text: Column) -> Column:
    """The lines that are headers, and the paragraphs of several lines that hold one, once each."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(HEADER))
    return F.when(text.rlike(HEADER), F.array_distinct(F.concat(lines, paragraphs(text)))).otherwise(F.array().cast("array<string>"))


def scanned(files: DataFrame) -> DataFrame:
    """(file, path, is_file, parts, extra): each file once, with (whole, terms) of its headers and, if it is a licence file, its whole text."""
    text = F.coalesce("text", F.lit(""))
    named = F.element_at(F.split("path", "/", -1), -1).rlike(r"(?i)^(licen[cs]e|copying)(\..*)?$") | F.coalesce("is_license_file", F.lit(False))
    part = lambda whole: lambda t: F.struct(F.lit(whole).alias("whole"), terms(t).alias("terms"))
    whole = F.when(named, F.transform(F.array(text), part(True))).otherwise(F.array())
    parts = F.concat(whole, F.transform(headers(text), part(False)))
    rows = files.select(*[c for c in files.columns if c not in ("text", "is_license_file")], F.coalesce("is_license_file", F.lit(False)).alias("is_file"), parts.alias("parts"))
    return checkpointed(rows.withColumn("file", F.monotonically_increasing_id()))


def scored(files: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(file, path, whole, license, score): the best licence of each part, at LEAST or more and MARGIN above the next."""
    vectors = template_vectors(files.sparkSession, templates)
    _, other = idf(templates)
    opened = files.where(F.size("parts") > 0).select("file", "path", F.posexplode("parts").alias("part", "s"))
    tf = opened.select("file", "path", "part", F.col("s.whole").alias("whole"), F.explode("s.terms").alias("term")).groupBy("file", "path", "part", "whole", "term").count()
    # The templates are a list that a person wrote.
    weighed = tf.join(F.broadcast(vectors), "term", "left").withColumn("w", F.col("count") * F.coalesce("idf", F.lit(other)))
    keys = ["file", "path", "part", "whole"]
    # One pass gives norms and products: the products of a part are in rows of a template, its norm in the row without one.
    rows = F.concat(F.array(F.struct(F.lit(None).cast("int").alias("template"), F.lit(None).cast("string").alias("license"), (F.col("w") * F.col("w")).alias("x"))), F.coalesce(F.transform("weights", lambda v: F.struct(v["template"].alias("template"), v["license"].alias("license"), (F.col("w") * v["weight"]).alias("x"))), F.array()))
    sums = weighed.select(*keys, F.explode(rows).alias("r")).groupBy(*keys, "r.template", "r.license").agg(F.sum("r.x").alias("x"))
    by_part = sums.groupBy(*keys).agg(F.max(F.when(F.col("template").isNull(), F.sqrt("x"))).alias("norm"), F.collect_list(F.when(F.col("template").isNotNull(), F.struct("license", "x"))).alias("hits"))  # a hit for each template at most
    best = by_part.select(*keys, F.explode("hits").alias("hit"), "norm").groupBy(*keys, "hit.license").agg(F.round(F.max(F.col("hit.x") / F.col("norm")), 6).alias("score"))
    top = best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "license"))).alias("ranked"))  # a row for each licence at most
    first, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    found = top.select("file", "path", "whole", first["license"].alias("license"), (-first["s"]).alias("score"), F.coalesce(-second["s"], F.lit(0.0)).alias("next"))
    return found.where((F.col("score") >= LEAST) & (F.col("score") - F.col("next") >= MARGIN)).drop("next")


def ranked() -> list[Column]:
    """The order of licences that are found: others before the reservation of rights, the best score, the least name."""
    return [(F.col("license") == RESERVED).alias("reserved"), (-F.col("score")).alias("s"), F.col("license")]


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(directory: Column) -> Column:
    """The directory and all above it, the root ('') last."""
    names = F.split(directory, "/", -1)
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.sequence(F.size(names), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(names, 1, k), "/")), F.array(F.lit(""))))


def licensed(files: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Each (path, text, is_license_file) row's path and further columns, license, score, how, from_path.

    ``how`` is header, file or inherited; null, as license, where there is none.
    Further columns must not have the names of the result.
    """
    extra = [c for c in files.columns if c not in ("path", "text", "is_license_file")]
    packed = [F.struct(*[F.col(f"`{c}`") for c in extra]).alias("extra")] if extra else []
    rows = scanned(files.select("path", "text", "is_license_file", *packed))
    hits = checkpointed(scored(rows, templates or TEMPLATES))
    own = hits.groupBy("file").agg(F.min(F.struct(*ranked())).alias("o"))
    given = hits.where("whole").groupBy(parent(F.col("path")).alias("above")).agg(F.min(F.struct(*ranked(), "path")).alias("g"))
    placed = rows.drop("parts").withColumn("dir", parent(F.col("path")))
    dirs = placed.select("dir").distinct().select("dir", F.posexplode(ancestors(F.col("dir"))).alias("up", "above"))
    nearest = dirs.join(given, "above").groupBy("dir").agg(F.min(F.struct("up", "g")).alias("n"))
    joined = placed.join(own, "file", "left").join(nearest, "dir", "left")
    has = F.col("o").isNotNull()
    return joined.select(
        *(["extra.*"] if extra else []), "path", F.coalesce("o.license", "n.g.license").alias("license"), (-F.coalesce("o.s", "n.g.s")).alias("score"),
        F.when(has & F.col("is_file"), "file").when(has, "header").when(F.col("n").isNotNull(), "inherited").alias("how"),
        F.when(~has, F.col("n.g.path")).alias("from_path"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree.

    A document lies in source, source/lang or source/lang/block by its id modulo
    3, with 1,000 ids to a block; without an id, in the first.  It is its
    directory's licence file if at least half of its words are in header lines,
    or in such paragraphs.
    """
    text = F.coalesce("text", F.lit(""))
    depth = F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(0))
    source, lang = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    path = F.concat_ws("/", source, F.when(depth > 0, lang), F.when(depth > 1, F.floor(F.col("doc_id") / 1000).cast("string")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(HEADER))
    words_in = lambda xs: F.size(words(F.array_join(xs, "\n")))
    mostly = 2 * F.greatest(words_in(lines), words_in(paragraphs(text))) >= F.size(words(text))
    is_file = F.when(text.rlike(HEADER), mostly).otherwise(F.lit(False))
    return docs.select("doc_id", path.alias("path"), text.alias("text"), is_file.alias("is_license_file"))


def digest(docs: DataFrame) -> DataFrame:
    """The licence of each document, by its path."""
    return licensed(document_files(docs)).select("doc_id", "path", "license", "score", "how", "from_path")
