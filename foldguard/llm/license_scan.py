"""Licence scan by TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

Sentences that hold a licence word are compared with templates as sparse vectors: terms are rows, weights of template terms a
small table of fixed size, dot products and norms aggregates. Headers and licence files, which wrap their sentences, are read as
terms without line ends and comment signs: a phrase that tells the licence and its version apart picks windows of terms, and the
windows are compared in the same way. A header counts before single sentences. Files without a statement of their own take the licence of the
nearest directory above them that has a licence file; directories, not files, are joined with their ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licence identifiers and the statements they are recognised by.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("all-rights-reserved", "All rights reserved"),
)
#: A sentence without any of these is no statement about a licence.
LICENCE_WORDS = "licen[cs]e[ds]?|copyright|rights|permission|redistribution"
LICENCE_FILES = "(?i)^(licen[cs]es?|copying|notice|copyright)([.].*)?$"

_GNU = "is free software you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version"
_GNU_ONLY = "you can redistribute it and/or modify it under the terms of the GNU {} Public License version {} as published by the Free Software Foundation"
_GNU_FILE = "GNU {} PUBLIC LICENSE Version {} Copyright (C) {} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_PHRASE = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_NAMES = "neither the names? .{1,80} nor the names of"
_BSD_ADVERTISING = "all advertising materials"


def _gnu() -> list[tuple[str, str, str, str, str]]:
    out = []
    for name, kind, version, dated, year in (
        ("GPL-2.0", "General", "2", "2, June 1991", "1989, 1991"),
        ("GPL-3.0", "General", "3", "3, 29 June 2007", "2007"),
        ("LGPL-2.1", "Lesser General", "2.1", "2.1, February 1999", "1991, 1999"),
        ("LGPL-3.0", "Lesser General", "3", "3, 29 June 2007", "2007"),
        ("AGPL-3.0", "Affero General", "3", "3, 19 November 2007", "2007"),
    ):
        gnu, number = f"gnu {kind.lower()} public license", version.replace(".", "[.]")
        out += [
            (name, _GNU.format(kind, version), f"{gnu} as published by the free software foundation (?:either )?version {number}", "", ""),
            (name, _GNU_ONLY.format(kind, version), f"{gnu} version {number} as published by the free software foundation", "", ""),
            (name, _GNU_FILE.format(kind, dated, year), f"{gnu} version " + dated.lower().replace(",", "").replace(".", "[.]"), "", ""),
        ]
    return out


#: Headers and the text or head of licence files, the phrase of lower-case terms that picks a window, what the
#: terms from there on must hold, and what they must not.
HEADERS = (
    *_gnu(),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "licensed under the apache license version 2[.]0 the license", "", ""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "apache license version 2[.]0 january 2004", "", ""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "subject to the terms of the mozilla public license v 2[.]0", "", ""),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software", "mozilla public license version 2[.]0 1 definitions", "", ""),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "", ""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that", "", ""),
    ("BSD-2-Clause", _BSD, _BSD_PHRASE, "", f"{_BSD_NAMES}|{_BSD_ADVERTISING}"),
    ("BSD-3-Clause", _BSD, _BSD_PHRASE, _BSD_NAMES, _BSD_ADVERTISING),
)
#: Fixed value: a text without any of these holds no header.
HEADER_WORDS = "(?i)permission|redistribut|gnu|mozilla|apache"
HEADER_REACH = 200  # what must or must not follow a phrase is looked for among so many terms

TERM = "[A-Za-z0-9]+(?:[.+-][A-Za-z0-9]+)*"
MIN_COSINE = 0.7


def template_weights(templates: Sequence[tuple] = TEMPLATES) -> tuple[list[tuple[int, str, str, float]], float]:
    """Rows ``(template, licence, term, weight)`` with unit length per template, and the idf of terms that no template has."""
    terms = [[t.lower() for t in re.findall(TERM, x[1])] for x in templates]
    idf = term_idf(templates)
    rows = []
    for i, (x, ts) in enumerate(zip(templates, terms, strict=True)):
        counts = Counter(ts)
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in counts.items()))
        rows += [(i, x[0], t, n * idf[t] / norm) for t, n in sorted(counts.items())]
    return rows, math.log(1 + len(terms)) + 1


def term_idf(templates: Sequence[tuple] = TEMPLATES) -> dict[str, float]:
    terms = [{t.lower() for t in re.findall(TERM, x[1])} for x in templates]
    found = Counter(t for ts in terms for t in ts)
    return {t: math.log((1 + len(terms)) / (1 + n)) + 1 for t, n in found.items()}


def _cosines(terms: DataFrame, templates: Sequence[tuple]) -> DataFrame:
    """``doc_id, place, template, licence, cosine`` of the terms (``doc_id, place, term``) of each place."""
    spark: SparkSession = terms.sparkSession
    rows, unknown_idf = template_weights(templates)
    weights = spark.createDataFrame(rows, "template int, licence string, term string, weight double")
    idf = spark.createDataFrame(list(term_idf(templates).items()), "term string, idf double")
    counted = terms.groupBy("doc_id", "place", "term").agg(F.count(F.lit(1)).alias("tf"))
    # Templates are a fixed list: both tables are small whatever the input.
    sized = counted.join(F.broadcast(idf), "term", "left").withColumn("size", F.col("tf") * F.coalesce("idf", F.lit(unknown_idf)))
    norms = sized.groupBy(F.col("doc_id").alias("of_doc"), F.col("place").alias("of_place")).agg(F.sqrt(F.sum(F.col("size") * F.col("size"))).alias("norm"))
    dots = sized.join(F.broadcast(weights), "term").groupBy("doc_id", "place", "template", "licence").agg(F.sum(F.col("size") * F.col("weight")).alias("dot"))
    return dots.join(norms, [F.col("doc_id").eqNullSafe(F.col("of_doc")), F.col("place") == F.col("of_place")]).select(
        "doc_id", "place", "template", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")
    )


def header_cosines(files: DataFrame) -> DataFrame:
    """``doc_id, licence, cosine`` of each window that a header's phrase picks, with that header."""
    known = []
    for i, (_, text, phrase, needs, lacks) in enumerate(HEADERS):
        terms = [t.lower() for t in re.findall(TERM, text)]
        found = re.search(rf"(?<!\S){phrase}(?!\S)", " ".join(terms))
        before, within = len(" ".join(terms)[: found.start()].split()), len(found[0].split())
        values = {"header": i, "phrase": rf"(?<!\S)({phrase})(?!\S)", "before": before, "after": len(terms) - before - within, "needs": needs, "lacks": lacks or "(?!)"}
        known.append(F.struct(*[F.lit(v).alias(k) for k, v in values.items()]))
    said = files.filter(F.col("text").rlike(HEADER_WORDS)).select(
        "doc_id", F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(f"({TERM})"), F.lit(1)), " ").alias("said")
    )
    met = said.select("doc_id", "said", F.explode(F.array(*known)).alias("h")).select("doc_id", "said", "h.*").filter("said RLIKE phrase")
    parts = met.withColumns({"parts": F.split("said", F.col("phrase")), "hits": F.regexp_extract_all("said", F.col("phrase"), F.lit(1))}).drop("said")

    def near(text, count):
        return F.call_function("substring_index", F.trim(text), F.lit(" "), count)

    windows = F.transform(
        "hits",
        lambda hit, k: F.struct(
            F.concat_ws(" ", near(F.get("parts", k), -F.col("before")), hit, near(F.get("parts", k + 1), F.col("after"))).alias("window"),
            near(F.get("parts", k + 1), F.lit(HEADER_REACH)).alias("follows"),
        ),
    )
    each = parts.select("doc_id", "header", "needs", "lacks", F.posexplode(windows).alias("k", "w")).filter("w.follows RLIKE needs AND NOT w.follows RLIKE lacks")
    place = F.struct("header", "k").alias("place")
    terms = each.select("doc_id", place, F.explode(F.split("w.window", " ")).alias("term")).filter("term != ''")
    return _cosines(terms, HEADERS).filter("place.header = template").select("doc_id", "licence", "cosine")


def own_licences(files: DataFrame) -> DataFrame:
    """``doc_id, own_licence, own_cosine`` of files with a statement; headers go first, then the nearest template wins, ties by its name."""
    ended = F.regexp_replace(F.coalesce("text", F.lit("")), r"([.!?])[\x20\x09-\x0D]+", "$1\n")
    sentences = files.select("doc_id", F.posexplode(F.split(ended, "\n")).alias("place", "sentence"))
    sentences = sentences.filter(F.col("sentence").rlike(rf"(?i)(^|[^A-Za-z])({LICENCE_WORDS})([^A-Za-z]|$)"))
    terms = sentences.select("doc_id", "place", F.explode(F.regexp_extract_all("sentence", F.lit(f"({TERM})"), F.lit(1))).alias("raw"))
    lines = _cosines(terms.select("doc_id", "place", F.lower("raw").alias("term")), TEMPLATES).select("doc_id", "licence", "cosine", F.lit(1).alias("kind"))
    scored = header_cosines(files).withColumn("kind", F.lit(0)).unionByName(lines)
    best = scored.filter(F.col("cosine") >= MIN_COSINE).groupBy("doc_id").agg(F.min(F.struct("kind", (-F.col("cosine")).alias("minus"), "licence")).alias("best"))
    return best.select("doc_id", F.col("best.licence").alias("own_licence"), (-F.col("best.minus")).alias("own_cosine"))


def license_scan(files: DataFrame) -> DataFrame:
    """One row per file: ``doc_id, path, licence, cosine, inherited_from``.

    ``files`` has ``doc_id, path, text``; ``doc_id`` tells files apart (rows that repeat one share their statements). The
    licence is the file's own, else that of the nearest directory at or above its own with a licence file
    (``inherited_from``, the root being the empty path), else NULL. Of several licence files of a directory the one
    nearest to its template counts, ties by licence name. Absolute paths begin at the same root as others. Null texts state nothing; a NULL path is in no directory and
    inherits nothing. An empty table gives no rows; other columns are not read.
    """
    slim = files.select("doc_id", F.regexp_replace("path", "/+", "/").alias("path"), "text")
    own = own_licences(slim).withColumnRenamed("doc_id", "of_doc")
    known = slim.join(own, F.col("doc_id").eqNullSafe(F.col("of_doc")), "left").select(
        "doc_id", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "own_licence", "own_cosine"
    )
    by_dir = known.filter(F.col("name").rlike(LICENCE_FILES) & F.col("own_licence").isNotNull()).groupBy("dir").agg(
        F.min(F.struct((-F.col("own_cosine")).alias("minus"), F.col("own_licence").alias("licence"))).alias("best")
    )
    by_dir = by_dir.select(F.col("dir").alias("above"), F.col("best.licence").alias("licence"))
    dirs = known.select("dir").filter("dir IS NOT NULL").distinct()
    depth = F.size(F.split("dir", "/"))  # an absolute path has an empty part in front, which counts
    steps = F.transform(F.sequence(F.lit(0), depth), lambda d: F.call_function("substring_index", F.col("dir"), F.lit("/"), d))
    # substring_index(…, 0) is the empty path: the root.
    above = dirs.select("dir", F.posexplode(F.array_distinct(steps)).alias("depth", "above")).join(by_dir, "above")
    nearest = above.groupBy("dir").agg(F.max(F.struct("depth", "above", "licence")).alias("near")).select(
        F.col("dir").alias("near_dir"), F.col("near.above").alias("near_above"), F.col("near.licence").alias("near_licence")
    )
    joined = known.join(nearest, F.col("dir") == F.col("near_dir"), "left")
    has_own = F.col("own_licence").isNotNull()
    return joined.select(
        "doc_id", "path",
        F.coalesce("own_licence", "near_licence").alias("licence"),
        "own_cosine",
        F.when(~has_own, F.col("near_above")).alias("inherited_from"),
    ).withColumnRenamed("own_cosine", "cosine")
