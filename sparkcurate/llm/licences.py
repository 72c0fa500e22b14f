"""Licence scan: TF-IDF cosine to templates, then inheritance by directory.

A task weighs lines, paragraphs and runs of a template's length against a fixed set of templates.
A unit is given a name only if it holds the marks that tell the licence from its relatives (kind,
version); texts without the marks of any licence are skipped, and so are texts without key terms:
the heaviest ones, chosen so that the others alone cannot reach the least cosine.

A file is a licence file by its name, or if matching units make up half of its words. Files
without a licence of their own take that of the nearest ancestor directory that holds a
licence file. Directories are few compared with files: the distinct ones are exploded into
their ancestors, joined with the licensed directories, and the deepest hit joins back as one
row per directory, so the adaptive skew join splits a directory with a third of all files.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.session import materialise

LEAST = 0.6
TERM = re.compile(r"[^\W_]+")
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_CC = ((), ("SA",), ("NC",), ("ND",), ("NC", "SA"), ("NC", "ND"))
_LONG = {"SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
_SPDX = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0")
_SPDX += tuple("-".join(("CC-BY", *kinds, v)) for kinds in _CC for v in ("4.0", "3.0"))


def _creative(kinds: tuple[str, ...], version: str) -> list[tuple[str, str]]:
    """Short and long notice of a Creative Commons licence."""
    name, long = "-".join(("CC-BY", *kinds, version)), "-".join(("Attribution", *[_LONG[k] for k in kinds]))
    return [(name, f"Licensed under CC {'-'.join(('BY', *kinds))} {version}."), (name, f"This work is licensed under a Creative Commons {long} {version} International License.")]


#: Short notices and opening sentences of well-known public licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    *[t for kinds in _CC for version in ("4.0", "3.0") for t in _creative(kinds, version)],
    *[(name, f"SPDX-License-Identifier: {name}") for name in _SPDX],
)


def _marks() -> dict[str, list[tuple[str, ...]]]:
    """Terms in sequence that tell a licence from its relatives: of each tuple, one must be there."""
    gnu = {"GPL": "gnu general public", "AGPL": "affero general public", "LGPL": "lesser general public"}
    out = {
        "MIT": [("mit license", "mit licence", "license mit", "licence mit", "permission is hereby granted free of charge", "identifier mit")],
        "Apache-2.0": [("apache",), ("version 2", "apache 2", "license 2", "licence 2", "v 2", "v2")],
        "LGPL-2.0": [("library general public", "lgpl 2 0")],
        "MPL-2.0": [("mozilla public", "mpl"), ("2 0",)],
        "BSD": [("redistribution and use in source and binary forms",)],
        "BSD-2-Clause": [("redistributions in binary form", "bsd 2 clause")],
        "BSD-3-Clause": [("neither the name", "bsd 3 clause")],
        "CC0-1.0": [("cc0",)],
    }
    for name, version in (("GPL", "2.0"), ("GPL", "3.0"), ("AGPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0")):
        digits = version.removesuffix(".0").replace(".", " ")
        out[f"{name}-{version}"] = [(gnu[name], f"identifier {name.lower()}"), (f"version {digits}", f"v{digits}", f"v {digits}", f"license {digits}", f"{name.lower()} {digits}")]
    for kinds in _CC:
        for version in ("4.0", "3.0"):
            short = " ".join(("by", *kinds)).lower()
            longs = [" ".join(("attribution", *[x[k] for k in kinds])).lower() for x in (_LONG, {"SA": "Share Alike", "NC": "Non Commercial", "ND": "No Derivatives"}, {"SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivs"})]
            out["-".join(("CC-BY", *kinds, version))] = [tuple(dict.fromkeys(f"{x} {version.replace('.', ' ')}" for x in (short, *longs)))]
    return out


MARKS = _marks()
#: A text with such a sequence is not of this licence.
NEVER = {"BSD": ("redistributions in binary form",), "BSD-2-Clause": ("neither the name",)}
FILE_NAME = r"(?i)^(un)?(licen[cs]e|copying|notice)([.\-_].*)?$"


class Scanner:
    """Sparse TF-IDF vectors of the templates; their number bounds its size."""

    def __init__(self, templates=TEMPLATES, least: float = LEAST):
        counts = [Counter(TERM.findall(text.lower())) for _, text in templates]
        seen = Counter(t for c in counts for t in c)
        self.names, self.least = [name for name, _ in templates], least
        self.unknown = math.log(1 + len(counts)) + 1
        self.idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in seen.items()}
        self.texts = [TERM.findall(text.lower()) for _, text in templates]
        self.vectors: list[dict[str, float]] = []
        self.postings: dict[str, list[tuple[int, float]]] = {}
        self.key: set[str] = set()
        for i, c in enumerate(counts):
            weights = {t: n * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.vectors.append({t: w / norm for t, w in weights.items()})
            rest = 1.0
            for t, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
                if math.sqrt(max(0.0, rest)) >= least - 1e-9:
                    self.key.add(t)
                rest -= (w / norm) ** 2
                self.postings.setdefault(t, []).append((i, w / norm))

    def weigh(self, terms: list[str]) -> tuple[float, str | None]:
        """Best cosine and its licence; ties go to the smaller name."""
        counts = Counter(terms)
        size, dots = 0.0, Counter()
        for t, n in counts.items():
            w = n * self.idf.get(t, self.unknown)
            size += w * w
            for i, x in self.postings.get(t, ()):
                dots[i] += w * x
        if not dots:
            return 0.0, None
        score, name = min((-d, self.names[i]) for i, d in dots.items())
        return -score / math.sqrt(size), name

    def cosine(self, terms: list[str], i: int) -> float:
        """Cosine of terms to one template."""
        size = dot = 0.0
        for t, n in Counter(terms).items():
            w = n * self.idf.get(t, self.unknown)
            size += w * w
            dot += w * self.vectors[i].get(t, 0.0)
        return dot / math.sqrt(size) if size else 0.0

    def windows(self, line: str, terms: list[str], i: int):
        """Starts of runs of a template's length around its rarest mark; of a template without
        marks, all over the terms."""
        size = len(self.texts[i])
        step, last = max(1, size // 8), max(0, len(terms) - size)
        places = None
        for group in MARKS.get(self.names[i], ()):
            found = [m.start() for mark in group for m in re.finditer(f"(?= {mark} )", line)]
            places = found if places is None or len(found) < len(places) else places
        if places is None:
            return range(0, last + 1, step)
        starts, at, seen = set(), 0, 0
        for place in sorted(places):
            seen, at = seen + line.count(" ", at, place), place
            starts.update(min(last, max(0, seen - back)) for back in range(0, size, step))
        return sorted(starts)

    def scan(self, text: str | None) -> tuple[str | None, float, float]:
        """Licence, cosine and the share of words in matching units of one text. Units are lines,
        paragraphs and, in longer ones, runs of a template's length; all hold the licence's marks."""
        lowered = (text or "").lower()
        every = TERM.findall(lowered)
        line = f" {' '.join(every)} "
        holds = lambda name, part: all(any(f" {m} " in part for m in group) for group in MARKS.get(name, ()))
        likely = {n for n in set(self.names) if holds(n, line) and not any(f" {m} " in line for m in NEVER.get(n, ()))}
        if not likely or self.key.isdisjoint(every):
            return None, 0.0, 0.0
        ours = [i for i, n in enumerate(self.names) if n in likely]
        spans, at = [], 0
        for paragraph in re.split(r"\n\s*\n", lowered):
            start = at
            for part in paragraph.split("\n"):
                spans.append((at, at := at + len(TERM.findall(part))))
            spans.append((start, at))
        best, inside = (0.0, None), bytearray(len(every))
        runs = [(i, start, min(len(every), start + len(self.texts[i]))) for i in ours for start in self.windows(line, every, i)]
        for i, start, end in [*((i, *s) for s in dict.fromkeys(spans) for i in ours), *runs]:
            unit = every[start:end]
            if not unit or not holds(self.names[i], f" {' '.join(unit)} "):
                continue
            score = self.cosine(unit, i)
            if score >= self.least:
                best = max(best, (score, self.names[i]), key=lambda w: (w[0], w[1] or ""))
                inside[start:end] = b"\1" * (end - start)
        return best[1], best[0], sum(inside) / len(every)


def folder(path: Column) -> Column:
    """Directory of a path, without the last ``/``; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """``files[key]`` with ``path``, ``licence``, ``similarity`` (of the file's own text),
    ``is_licence_file``, ``inherited_from`` (a directory, where the licence is inherited), one row
    per row of ``files``.

    Null and empty texts hold no licence of their own but inherit one. A null path has no
    directory and inherits nothing. Of several licence files in a directory the one of the
    highest cosine counts, then the smallest name. Repeated rows stay repeated. Other columns
    are not read.
    """
    scanner = Scanner(templates, least)

    @F.arrow_udf("struct<licence:string,similarity:double,share:double>")
    def weigh(texts: pa.Array) -> pa.Array:
        found = list(zip(*[scanner.scan(t.as_py()) for t in texts])) or [[], [], []]
        kinds = pa.string(), pa.float64(), pa.float64()
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], ["licence", "similarity", "share"])

    rows = files.select(F.col(f"`{key}`").alias("key"), F.col(f"`{path}`").alias("path"), weigh(F.col(f"`{text}`").cast("string")).alias("w"))
    named = F.coalesce(F.regexp_extract("path", "([^/]*)$", 1).rlike(FILE_NAME), F.lit(False))
    whole = F.col("w.licence").isNotNull() & (named | (F.col("w.share") >= 0.5)) & F.col("path").isNotNull()
    rows = materialise(rows.select("key", "path", folder(F.col("path")).alias("dir"), "w.licence", "w.similarity", whole.alias("is_licence_file")), "scanned")
    licensed = rows.filter("is_licence_file").groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "licence")).alias("best"))
    licensed = licensed.select(F.col("dir").alias("ancestor"), F.col("best.licence").alias("from_dir"))
    needy = rows.filter("licence is null and path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    ancestors = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("ancestor")))).alias("a")
    near = needy.select("dir", ancestors).select("dir", "a.depth", "a.ancestor").join(licensed, "ancestor")
    near = near.groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "from_dir")).alias("n")).select("dir", F.col("n.ancestor").alias("inherited_from"), "n.from_dir")
    out = rows.join(materialise(near, "near"), "dir", "left")
    taken = F.col("licence").isNull()
    return out.select(
        F.col("key").alias(key),
        "path",
        F.coalesce("licence", "from_dir").alias("licence"),
        F.when(~taken, F.col("similarity")).alias("similarity"),
        "is_licence_file",
        F.when(taken, F.col("inherited_from")).alias("inherited_from"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Documents laid out as source/lang/doc_id; short notices are their directory's licence files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", path.alias("path"), "text"))
