"""License scan: sparse TF-IDF cosine to templates, then inheritance from ancestor directories.

Two kinds of templates: whole license texts (``license_texts``) and notices, the sentences by which
a file says what license it is under. Vectors have a weight (1 + log count) * idf for each term. Document
frequencies are counted over all texts for all terms, those outside the templates too; a term that is in less than one
of ``RARE`` texts weighs like one that is in just so many, so only the frequent terms need to be known
in a task: ``RARE`` times the mean number of distinct terms of a text at most, whatever the corpus.

A file is a licence file if its whole text is close to a whole license text, or if it is called
LICENSE, COPYING and the like and a part of it is close to any template. A line or paragraph of another file that is close to
a notice is a header, and is passed on to no other file.

A text is compared only if it has one of the anchor terms of a template: those that are left when the most
frequent terms that together could not lift any template over the threshold are taken away, so
the shortcut loses nothing (a cosine is at most the root of the share of the template's norm that the text's terms
cover).

A file without a license of its own takes that of the nearest ancestor directory with a licence file:
distinct directories are joined with those that have one, by each of their ancestor paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.common import arrow_map, arrow_schema, texts, written

#: A term in less than one of so many texts weighs like one in just so many; terms a task counts before it sends them on.
RARE, HELD = 100, 1 << 18
#: What licence files are called.
LICENCE_FILE = re.compile(r"(?:.*/)?(?:(?:un)?licen[cs]es?|copying|copyright|(?:mit|bsd|apache|l?gpl)[-_]?licen[cs]e)(?:[._-][^/]*)?", re.I)

# Usual notices of public licenses, (license, text).
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
)

#: ASCII letters to lower case, other ASCII but digits and the line feed to spaces.
_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 or b == 10 else 32 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def whole_texts() -> tuple[tuple[str, str], ...]:
    """(license, whole text) of each file of ``license_texts``."""
    folder = Path(__file__).with_name("license_texts")
    return tuple((p.stem, p.read_text()) for p in sorted(folder.glob("*.txt")))


class Weights:
    """The idf of terms under document frequencies."""

    def __init__(self, frequency: dict[bytes, int], n_docs: int) -> None:
        """frequency: of all terms that are in one of ``RARE`` texts or more; of others it may be missing."""
        of = lambda f: math.log((1 + n_docs) / (1 + max(f, n_docs / RARE))) + 1
        self.rare = of(0)
        self.idf = {t: of(f) for t, f in frequency.items() if f * RARE > n_docs}

    def vector(self, words: list[bytes]) -> dict[bytes, float]:
        get, rare, log = self.idf.get, self.rare, math.log
        return {t: (1 + log(n)) * get(t, rare) for t, n in Counter(words).items()}


class Index:
    """Template vectors, and the terms without which no text comes near them."""

    def __init__(self, templates, weights: Weights, threshold: float) -> None:
        self.weights, self.threshold = weights, threshold
        self.names = [name for name, _ in templates]
        self.posting: dict[bytes, list[tuple[int, float]]] = {}
        self.anchors: set[bytes] = set()
        for i, (_, text) in enumerate(templates):
            vector = weights.vector(terms(text.encode()))
            norm = math.sqrt(sum(w * w for w in vector.values()))
            for t, w in vector.items():
                self.posting.setdefault(t, []).append((i, w / norm))
            covered = 0.0
            for t in sorted(vector, key=lambda t: (weights.idf.get(t, weights.rare), t)):
                covered += (vector[t] / norm) ** 2
                if covered >= threshold**2 * (1 - 1e-9):
                    self.anchors.add(t)

    def best(self, words: list[bytes]) -> tuple[float, str | None]:
        """The largest cosine and its license, of equal ones the first template's; 0 and None below the threshold."""
        if self.anchors.isdisjoint(words):
            return 0.0, None
        vector = self.weights.vector(words)
        score: dict[int, float] = {}
        for t in vector.keys() & self.posting.keys():
            for i, v in self.posting[t]:
                score[i] = score.get(i, 0.0) + vector[t] * v
        norm = math.sqrt(sum(w * w for w in vector.values()))
        i = min(score, key=lambda i: (-round(score[i] / norm, 12), i))
        found = min(1.0, score[i] / norm)
        return (found, self.names[i]) if found >= self.threshold else (0.0, None)


class Scanner:
    def __init__(self, notices, wholes, frequency: dict[bytes, int], n_docs: int, threshold: float, file_threshold: float) -> None:
        weights = Weights(frequency, n_docs)
        self.wholes = Index(wholes, weights, file_threshold)
        self.notices = Index(notices, weights, threshold)
        self.parts = Index((*notices, *wholes), weights, threshold)

    def scan(self, text: bytes, path: str | None) -> tuple[str | None, float, str]:
        """(license, cosine, "file", "header" or "none")."""
        data = text.translate(_TERMS)
        words = data.split()
        found, name = self.wholes.best(words)
        if name is not None:
            return name, found, "file"
        called = path is not None and LICENCE_FILE.fullmatch(path) is not None
        index = self.parts if called else self.notices
        if index.anchors.isdisjoint(words):
            return None, 0.0, "none"
        parts = [*data.split(b"\n"), *(p for p in re.split(rb"\n[ \n]*\n", data) if b"\n" in p)]
        if called:
            parts.append(data)
        found, name = max((index.best(p.split()) for p in parts), key=lambda x: x[0])
        return (name, found, "file" if called else "header") if name is not None else (None, 0.0, "none")


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[dict[bytes, int], int]:
    """In how many texts each term is, for terms in one of ``RARE`` texts or more; how many texts there are."""
    kind = T.StructType([T.StructField("t", T.BinaryType()), T.StructField("n", T.LongType())])
    target = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], schema=target)
        for b in (x.slice(i, 512) for x in batches for i in range(0, x.num_rows, 512)):
            for t in texts(b):
                found.update(set(terms(t)))
            found[b""] += b.num_rows
            if len(found) > HELD:
                yield out()
                found.clear()
        if found:
            yield out()

    summed = docs.select(F.col(text_col).alias("text")).mapInArrow(run, kind).groupBy("t").agg(F.sum("n").alias("n"))
    total = docs.count()
    often = summed.filter((F.col("n") * RARE > total) & (F.length("t") > 0))
    return {bytes(r.t): r.n for r in often.toLocalIterator()}, total  # RARE times the mean distinct terms of a text at most


def directory(path: Column) -> Column:
    """The directory of a path; the root is the empty string. Null for null."""
    return F.when(path.isNull(), F.lit(None).cast("string")).when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan_licenses(
    files: DataFrame,
    *,
    id_col: str = "doc_id",
    path_col: str = "path",
    text_col: str = "text",
    notices=NOTICES,
    wholes=None,
    threshold: float = 0.7,
    file_threshold: float = 0.8,
) -> DataFrame:
    """The license of every file. wholes: (license, whole text), those of ``license_texts`` if not given.

    Returns the id, path, license (null: none known), score (the cosine by which the file has a license of its own;
    0 if it has none: lower cosines are not told), origin ("file", "header", "inherited" or "none") and license_path (the licence
    file that a license is inherited from), one row for each row of files. Of several licence files in a directory the
    closest to a template (to nine digits) counts, of these the first by path. A null text counts as empty, a null path
    neither inherits nor passes on; repeated rows are scanned like others. Other columns are
    ignored. An empty table gives an empty table.
    """
    src = files.select(F.col(id_col).alias("_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    frequency, n_docs = document_frequencies(src, "text")
    scanner = Scanner(notices, whole_texts() if wholes is None else wholes, frequency, n_docs, threshold, file_threshold)

    def each(b: pa.RecordBatch) -> dict:
        got = [scanner.scan(t, p) for t, p in zip(texts(b), b.column(1).to_pylist(), strict=True)]
        return {"_id": b.column(0), "path": b.column(1)} | {n: [g[i] for g in got] for i, n in enumerate(("license", "score", "origin"))}

    kind = T.StructType([src.schema["_id"], src.schema["path"], T.StructField("license", T.StringType())])
    kind = kind.add("score", T.DoubleType()).add("origin", T.StringType())
    own = written(arrow_map(src, each, kind)).withColumn("_dir", directory(F.col("path")))
    best = F.min_by(F.struct("license", F.col("path").alias("license_path")), F.struct(-F.round("score", 9), F.col("path")))
    with_file = own.filter("origin = 'file' AND path IS NOT NULL").groupBy(F.col("_dir").alias("_holder")).agg(best.alias("_given"))
    dirs = own.filter("path IS NOT NULL").select("_dir").distinct()
    parts = F.split("_dir", "/")
    ancestor = lambda n: F.struct(n.alias("deep"), F.array_join(F.slice(parts, 1, n), "/").alias("above"))
    above = dirs.select("_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), ancestor)).alias("_a"))
    above = above.select("_dir", "_a.deep", "_a.above")
    nearest = above.join(with_file, F.col("above") == F.col("_holder")).groupBy("_dir").agg(F.max_by("_given", "deep").alias("_given"))
    nearest = nearest.select(F.concat("_dir", F.lit("")).alias("_of"), "_given")  # hides how it is dealt: a directory may hold very many files
    out = own.join(nearest, F.col("_dir") == F.col("_of"), "left")
    takes = F.col("license").isNull() & F.col("_given").isNotNull()
    return out.select(
        F.col("_id").alias(id_col),
        "path",
        F.when(takes, F.col("_given.license")).otherwise(F.col("license")).alias("license"),
        "score",
        F.when(takes, "inherited").otherwise(F.col("origin")).alias("origin"),
        F.when(takes, F.col("_given.license_path")).alias("license_path"),
    )
