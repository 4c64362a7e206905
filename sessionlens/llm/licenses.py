"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# Notices, titles and texts that licence families ask files to carry, and their SPDX names.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This program is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "BSD-2-Clause": "Use of this source code is governed by the BSD 2-Clause License",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license, redistribution and use in source and binary forms are permitted",
    "ISC": "Licensed under the ISC License",
    "Unlicense": "This is free and unencumbered software released into the public domain, see the Unlicense",
    "CC0-1.0": "Dedicated to the public domain under Creative Commons CC0 1.0 Universal",
    "CC-BY-4.0": "Licensed under CC BY 4.0, Creative Commons Attribution International",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0, Creative Commons Attribution ShareAlike International",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
}
TITLES = {
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "MIT": "MIT License",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "MPL-2.0": "Mozilla Public License Version 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "ISC": "ISC License",
    "Unlicense": "The Unlicense http://unlicense.org",
    "CC0-1.0": "Creative Commons CC0 1.0 Universal",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International",
}
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."
TEXTS = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": 'MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _AS_IS + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "GPL-3.0": _FREE.format(kind="", n=3),
    "GPL-2.0": _FREE.format(kind="", n=2),
    "LGPL-3.0": _FREE.format(kind="Lesser ", n=3),
    "AGPL-3.0": _FREE.format(kind="Affero ", n=3),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause": "Copyright (c) All rights reserved. " + _BSD + _BSD_END,
    "BSD-3-Clause": "Copyright (c) All rights reserved. " + _BSD + _NAME + _BSD_END,
    "ISC": 'ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: licence -> the texts that stand for it.
TEMPLATES: dict[str, tuple[str, ...]] = {k: tuple(dict.fromkeys([v, f"SPDX-License-Identifier: {k}", TITLES[k], *([TEXTS[k]] if k in TEXTS else [])])) for k, v in NOTICES.items()}
#: Terms of a line: letters, or a number with its dotted parts.
TERM = r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*"
#: Terms that ordinary prose is full of; the search for a signature takes them last.
COMMON = frozenset("a all an and any are at be but can data direct do either even by code file following for form free from holder however i if in including into is it its kind later list met may means must name names no non nor not notice of on one or other program person provided see shall so source style subject terms that the this to under universal use used v version was with without work you".split())
#: The commonest of all, which come after even those.
COMMONEST = frozenset("a and as i in is it of that the to was".split())
#: What parts the blocks of a text: lines without a letter or digit, such as blank or bare comment lines.
BLOCK_END = r"\n(?:[^a-zA-Z0-9\n]*\n)+"
#: File names that hold the licence of their directory.
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([-.].*)?$"


def template_vectors(templates: dict[str, tuple[str, ...]]) -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """Unit TF-IDF vectors as (licence, number of its text, term, weight), the idf of each term, and that of unseen terms; tf is 1 + ln n."""
    bags = {(k, i): Counter(re.findall(TERM, t.lower())) for k, texts in templates.items() for i, t in enumerate(texts)}
    df = Counter(t for bag in bags.values() for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for (k, i), bag in bags.items():
        own = {t: (1 + math.log(n)) * idf[t] for t, n in bag.items()}
        norm = math.sqrt(sum(w * w for w in own.values()))
        rows += [(k, i, t, w / norm) for t, w in own.items()]
    return rows, idf, math.log(1 + len(bags)) + 1


def signature(rows: list[tuple[str, int, str, float]], threshold: float) -> list[str]:
    """Terms of which every text holds one whose cosine to some template reaches the threshold.

    A text without those of a template's terms whose squares sum to over 1 - threshold^2 stays below it by Cauchy's
    inequality. Of the sets that do, one with few common words and short numbers is taken.
    """
    out: set[str] = set()
    of: dict[tuple[str, int], list[tuple[float, str]]] = {}
    for k, i, t, w in rows:
        of.setdefault((k, i), []).append((w, t))
    for terms in of.values():
        got = 0.0
        for w, t in sorted(terms, key=lambda x: (x[1] in COMMONEST, x[1] in COMMON or len(x[1]) < 4 and x[1][0].isdigit(), -x[0], x[1])):
            if got > 1 - threshold * threshold + 1e-9:
                break
            out.add(t)
            got += w * w
    return sorted(out)


def units(text: Column) -> Column:
    """The distinct parts of a text that may be a notice: its lines, its blocks of lines, and the whole."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, BLOCK_END), F.array(text)))


def any_of(words: list[str]) -> str:
    """A pattern of any of the words, as a tree of their letters, so that few are tried at a place."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words):
        heads.setdefault(w[:1], []).append(w[1:])
    return "|".join(re.escape(h) + (f"(?:{any_of(rest)})" if any(rest) else "") for h, rest in heads.items())


def may_match(value: Column, idf: dict[str, float], unseen: float, threshold: float) -> Column:
    """Whether the terms of a part that templates have may be `threshold` of its length; if not, no cosine reaches that.

    Of a part's vector, only known terms meet a template. Its d known terms, n with repeats, have squares of at most
    d * (1 + ln(n / d))^2 of the largest idf together, as (1 + ln n)^2 is concave; each distinct unknown term has the square of its idf at least.
    """
    least = threshold * threshold
    distinct = lambda x: F.size(F.array_distinct(x))

    def holds(terms: Column, known: Column) -> Column:
        d = F.greatest(distinct(known), F.lit(1))
        most = max(idf.values(), default=0.0) ** 2 * d * F.pow(1 + F.log(F.size(known) / d), F.lit(2))
        return (distinct(terms) - distinct(known)) * unseen**2 * least <= (1 - least) * most

    # arrays of one element name a value, so that it is worked out once
    named = lambda x, of: F.exists(F.array(x), of)
    terms = F.regexp_extract_all(F.lower(value), F.lit(f"({TERM})"), F.lit(1))
    return named(terms, lambda t: named(F.filter(t, lambda x: x.isin(*idf)), lambda known: (F.size(known) > 0) & holds(t, known)))


def notice_scores(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, path_col: str = "path", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """`(path, license, score)`: for each file the licence of the template nearest to any of its lines, blocks or its whole text, where the cosine reaches `threshold`.

    Comment signs are no terms, so headers count as their words. Parts without any term that a match must hold (`signature`),
    or with too many terms that no template has (`may_match`), are passed over in their own row, which loses none. Each row's text is scored by itself, equal rows as one, and the best of a path counts. Ties go to the smaller licence name. Null paths and texts give no row.
    Only the template table, whose size is the templates' own, is broadcast.
    """
    spark = files.sparkSession
    rows, idf, unseen = template_vectors(templates)
    vectors = F.broadcast(spark.createDataFrame(rows, "license string, nth int, term string, weight double"))
    known = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    lowest = threshold - 1e-6  # scores are rounded
    must = rf"(?i)(?<![a-z])(?:{any_of(signature(rows, lowest))})(?![a-z])"
    body = F.col(text_col)
    fits = lambda x: x.rlike(must) & may_match(x, idf, unseen, lowest)
    found = files.where(body.rlike(must) & F.col(path_col).isNotNull()).select(F.col(path_col).alias("path"), F.xxhash64(body).alias("text"), F.posexplode(F.filter(units(body), fits)).alias("part", "value"))
    bag = ["path", "text", "part"]
    # the empty term, once a row, tells how many equal rows a bag holds
    terms = found.select(*bag, F.explode(F.array_append(F.regexp_extract_all(F.lower("value"), F.lit(f"({TERM})"), F.lit(1)), F.lit(""))).alias("term"))
    counts = materialize(terms.groupBy(*bag, "term").agg(F.count(F.lit(1)).cast("double").alias("n")), "terms")
    times = F.max(F.when(F.col("term") == "", F.col("n"))).over(Window.partitionBy(*bag))
    weighed = counts.withColumn("n", F.col("n") / times).where("term <> ''").join(known, "term", "left").withColumn("w", (1 + F.log("n")) * F.coalesce("idf", F.lit(unseen)))
    norms = weighed.groupBy(*bag).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(vectors, "term").groupBy(*bag, "license", "nth").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = dots.join(norms, bag).select("path", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    top = cosine.groupBy("path").agg(F.max("score").alias("top"))
    return cosine.join(top, "path").where("score = top").groupBy("path").agg(F.min("license").alias("license"), F.max("score").alias("score"))


def scan_licenses(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, path_col: str = "path", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """Per row of `files`: `path, license, score, how, from_dir`, with how one of header, inherited, none.

    A file's own notice wins; else that of the nearest directory above it that holds a licence file
    (`LICENCE_FILE`) with a notice, up to the top of a relative or an absolute tree (both are '' in from_dir). Of several such files in a directory the smallest path speaks. Directories
    meet their ancestors once each, before files join, so a hot directory is one row. Null paths give none;
    repeated rows are kept, with equal results; rows that share a path share their notices; an empty table gives no rows; other columns are ignored.
    """
    own = materialize(notice_scores(files, templates, path_col, text_col, threshold), "notices")
    parent = lambda p: F.regexp_replace(p, "/?[^/]*$", "")
    rooted = F.col("path").startswith("/").alias("rooted")
    base = F.regexp_extract("path", "[^/]*$", 0)
    holders = own.where(base.rlike(LICENCE_FILE)).select("*", rooted, parent(F.col("path")).alias("dir"))
    by_dir = holders.groupBy("dir", "rooted").agg(F.min(F.struct("path", "license", "score")).alias("h")).select(F.col("dir").alias("above"), "rooted", "h.license", "h.score")
    rows = files.select(F.col(path_col).alias("path")).select("path", rooted, parent(F.col("path")).alias("dir"))
    parts = F.split("dir", "/")
    ups = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), lambda x: x != "")
    dirs = rows.where("dir IS NOT NULL").select("dir", "rooted").distinct().withColumn("above", F.explode(ups))
    near = dirs.join(by_dir, ["above", "rooted"]).groupBy("dir", "rooted").agg(F.max_by(F.struct("above", "license", "score"), F.length("above")).alias("near"))
    top = F.broadcast(by_dir.where("above = ''").select("rooted", F.struct("above", "license", "score").alias("top")))  # two rows at most
    out = rows.join(own, "path", "left").join(near, ["dir", "rooted"], "left").join(top, "rooted", "left").withColumn("near", F.coalesce("near", "top"))
    how = F.when(F.col("license").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select("path", F.coalesce("license", "near.license").alias("license"), F.coalesce("score", "near.score").alias("score"), how.alias("how"), F.when(how == "inherited", F.col("near.above")).alias("from_dir"))
