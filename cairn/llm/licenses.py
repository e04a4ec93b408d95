"""Licence scans: TF-IDF cosine of passages to licence templates, then inheritance down directories.

Every line of a file, and runs of 3, 8 and 20 lines from a line that resembles a template, are compared with
each template by sparse TF-IDF cosine. Document frequencies of the templates' words come from all files; other
words weigh as much as the templates' median word. Lines are screened by an upper bound of the cosine,
so what remains is scored exactly. A file's licence is its most similar passage at ``LEAST`` or more (on ties the
longer, then the earlier passage, then the template's name).

Notices that share their lines with other words are found by word windows from every word, inside lines and across
them: of each template's length and, for templates of ``WHOLE`` words or more, of the ``CUTS`` of it. A window must hold
the template's words among ``NAMES``. It gives the licence where it is more similar than every run of lines and names another
licence; where both name the same, the run of lines is reported. In a file without such a passage, the longest (then the first)
title or SPDX tag of ``TITLES`` that stands in it word for word gives the licence, at a cosine of 1, and before a bare "all rights
reserved"; a copyright line without those words names no licence.

A file named like a licence file, or mostly made of licence text, speaks for its directory: files without a licence of
their own take that of their nearest ancestor directory that has one (of several files there the most similar,
then the first path). Directories are joined by path, each once; a directory that holds a third of all files is split by the join.

Null texts count as empty and have no licence; a null path stands in no directory and inherits nothing. Repeated
rows get the same result each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import textvec as V
from cairn.llm.common import freeze

LEAST = 0.7
SCREEN = 0.25
SPANS = (1, 3, 8, 20)
WHOLE = 12
CUTS = (0.75, 0.5)
MOSTLY = 0.5
FILE_NAMES = r"(?i)^(un)?licen[cs]e|^copying|^copyright|^notice"

# Notices and opening passages of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("proprietary", "All rights reserved."),
)

RESERVED = "proprietary"
# Words that tell licences apart.
NAMES = """license apache mit bsd gnu lesser affero mozilla eclipse cc0 cc creative commons attribution
sharealike noncommercial noderivatives sa nc nd 2 3 4""".split()
# Licences by name.
TITLES = (
    *(("Apache-2.0", t) for t in ("Apache License 2.0", "Apache License Version 2.0", "Apache License v2.0", "Apache License v 2.0", "Apache 2.0 License")),
    *(("MIT", t) for t in ("MIT License", "MIT Licence")),
    *(("BSD", t) for t in ("BSD License", "BSD 2-Clause", "BSD 3-Clause", "BSD-style license")),
    *((f"GPL-{v}.0", t + v) for v in "23" for t in ("GNU General Public License version ", "GNU General Public License v", "GNU GPL version ", "GNU GPL v", "GPL version ", "GPL v", "GPLv")),
    *(("LGPL", t) for t in ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPLv2", "LGPLv3")),
    *(("AGPL-3.0", t) for t in ("GNU Affero General Public License", "GNU AGPL", "AGPLv3")),
    *((f"{short}-2.0", f"{name} Public License{v}2.0") for short, name in (("MPL", "Mozilla"), ("EPL", "Eclipse")) for v in (" ", " version ", " v", " v ")),
    ("ISC", "ISC License"),
    ("Unlicense", "The Unlicense"),
    ("CC0-1.0", "CC0 1.0"),
    *(
        (f"CC-BY{short}-4.0", title)
        for short, name in (("", ""), ("-SA", "-ShareAlike"), ("-NC", "-NonCommercial"), ("-ND", "-NoDerivatives"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives"))
        for title in (f"CC BY{short} 4.0", f"Creative Commons Attribution{name} 4.0")
    ),
    *(
        (name, f"SPDX-License-Identifier: {tag}")
        for name, tags in {
            "BSD": ("BSD-2-Clause", "BSD-3-Clause", "0BSD"), "LGPL": ("LGPL-2.0", "LGPL-2.1", "LGPL-3.0"), "Apache-2.0": ("Apache-2.0",), "MIT": ("MIT",), "GPL-2.0": ("GPL-2.0",), "GPL-3.0": ("GPL-3.0",),
            "AGPL-3.0": ("AGPL-3.0",), "MPL-2.0": ("MPL-2.0",), "EPL-2.0": ("EPL-2.0",), "ISC": ("ISC",), "Unlicense": ("Unlicense",), "CC0-1.0": ("CC0-1.0",),
        }.items()
        for tag in tags
    ),
    (RESERVED, "All rights reserved"),
)


class Index(NamedTuple):
    names: list[str]
    vocabulary: np.ndarray
    idf: np.ndarray  # of the vocabulary, and last of any other word
    rows: np.ndarray  # template x word, of norm 1
    sizes: list[list[int]]  # words of each template's windows
    keys: list[np.ndarray]  # words each template's windows must hold
    titles: list[tuple[str, np.ndarray]]


def _words(text: str) -> np.ndarray:
    return V.words(next(V.slices(pa.array([text.lower()])))).hashes


def _frequencies(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in V.slices(batch.column(0)):
                w = V.words(part)
                at = np.minimum(np.searchsorted(vocabulary, w.hashes), len(vocabulary) - 1)
                known = vocabulary[at] == w.hashes
                pairs = np.unique(V.owners(w.offsets)[known] * len(vocabulary) + at[known])
                seen += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(seen)], names=["word", "files"])

    return run


def build(texts: DataFrame, templates=TEMPLATES) -> Index:
    """Weights from the document frequency of the templates' words over all of ``texts(text)``, lower-case."""
    words = [_words(t) for _, t in templates]
    vocabulary = np.unique(np.concatenate(words))
    count, seen = texts.count(), np.zeros(len(vocabulary))
    for r in texts.mapInArrow(_frequencies(vocabulary), "word long, files long").groupBy("word").agg(F.sum("files").alias("files")).collect():
        seen[r.word] = r.files
    idf = np.log((count + 1) / (seen + 1)) + 0.1
    rows = np.zeros((len(words), len(vocabulary)))
    for i, own in enumerate(words):
        np.add.at(rows[i], np.searchsorted(vocabulary, own), 1)
    rows *= idf
    sizes = [[len(own), *(int(np.ceil(len(own) * cut)) for cut in CUTS if len(own) >= WHOLE)] for own in words]
    names = _words(" ".join(NAMES))
    return Index(
        [n for n, _ in templates], vocabulary, np.append(idf, np.median(idf)), rows / np.linalg.norm(rows, axis=1, keepdims=True),
        sizes, [np.intersect1d(own, names) for own in words], [(n, _words(t)) for n, t in TITLES],
    )


def cosines(words: np.ndarray, index: Index, seen: np.ndarray) -> np.ndarray:
    """Cosine of one passage to each template; ``seen`` is the place of each of its words in the vocabulary."""
    known, times = np.unique(seen[seen < len(index.vocabulary)], return_counts=True)
    other = np.unique(words[seen == len(index.vocabulary)], return_counts=True)[1]
    a = times * index.idf[known]
    norm = np.sqrt((a**2).sum() + (other**2).sum() * index.idf[-1] ** 2)
    return index.rows[:, known] @ a / norm if norm else np.zeros(len(index.names))


def _best_window(words: np.ndarray, seen: np.ndarray, index: Index, template: int, least: float) -> tuple | None:
    """``(cosine, words, -first word)`` of the window of one text that is most similar to a template, if ``least`` or more."""
    n, best = len(words), None
    weight = index.idf[seen]
    dots = np.concatenate(([0.0], np.cumsum((np.append(index.rows[template], 0.0) * index.idf)[seen])))
    mass = np.concatenate(([0.0], np.cumsum(weight**2)))
    longest = max(index.sizes[template])
    words, weight = np.append(words, np.zeros(longest, np.uint64)), np.append(weight, np.zeros(longest))
    for size in index.sizes[template]:
        ends = np.minimum(np.arange(n) + size, n)
        dot = dots[ends] - dots[:-1]
        # Each word counted apart gives too small a norm here too.
        likely = np.flatnonzero(dot >= (least - 1e-6) * np.sqrt(np.maximum(mass[ends] - mass[:-1], 0)))
        for some in np.array_split(likely, len(likely) * size // (1 << 20) + 1):
            for key in index.keys[template]:
                holds = np.concatenate(([0], np.cumsum(words[:n] == key)))
                some = some[holds[ends[some]] > holds[some]]
            if not len(some):
                continue
            place = some[:, None] + np.arange(size)
            place = np.take_along_axis(place, np.argsort(words[place], axis=1), axis=1).ravel()
            own = words[place]
            new = np.concatenate(([True], own[1:] != own[:-1]))
            new[::size] = True
            runs = np.flatnonzero(new)
            squares = (np.diff(np.append(runs, len(own))) * weight[place[runs]]) ** 2
            found = np.round(dot[some] / np.sqrt(np.add.reduceat(squares, np.flatnonzero(runs % size == 0))), 12)
            k = int(found.argmax())
            entry = (float(found[k]), int(ends[some[k]] - some[k]), -int(some[k]))
            if found[k] >= least and (best is None or entry > best):
                best = entry
    return best


def _titles(w: V.Words, owner: np.ndarray, index: Index) -> dict[int, tuple]:
    """Of each text that holds a title ``(not a bare notice of rights, words, -first word, licence)`` of the longest."""
    starts = {int(first): np.flatnonzero(w.hashes == first) for first in {own[0] for _, own in index.titles}}
    out: dict[int, tuple] = {}
    for name, own in index.titles:
        at = starts[int(own[0])]
        at = at[at + len(own) <= len(w.hashes)]
        for k in range(1, len(own)):
            at = at[w.hashes[at + k] == own[k]]
        for i in at[owner[at] == owner[at + len(own) - 1]]:
            text, entry = int(owner[i]), (name != RESERVED, len(own), -int(i), name)
            out[text] = max(out.get(text, entry), entry)
    return out


def _embedded(w: V.Words, seen: np.ndarray, owner: np.ndarray, line: np.ndarray, first_line: np.ndarray, index: Index, least: float, out: list[tuple | None]) -> None:
    """Enter in ``out`` the passages inside and across lines."""

    def entry(name: str, cosine: float, a: int, b: int) -> tuple:
        text = owner[a]
        return name, cosine, int(line[a] - first_line[text]) + 1, int(line[b - 1] - first_line[text]) + 1, float(b - a) / float(w.offsets[text + 1] - w.offsets[text])

    # A window is at most as similar as all the template's words in its text would be alone.
    present = np.zeros((len(out), len(index.vocabulary) + 1), np.float32)
    present[owner, seen] = 1
    reach = present[:, :-1] @ (index.rows**2).T.astype(np.float32) >= least**2 - 1e-4
    reach[:, [n == RESERVED for n in index.names]] = False
    for text in np.flatnonzero(reach.any(axis=1)):
        a, b = w.offsets[text], w.offsets[text + 1]
        old = out[text] if out[text] and out[text][0] != RESERVED else None
        if old and old[1] >= 1:
            continue
        found = [(best, index.names[t]) for t in np.flatnonzero(reach[text]) if (best := _best_window(w.hashes[a:b], seen[a:b], index, t, least))]
        if found:
            (cosine, size, first), name = max(found)
            if old is None or cosine > old[1] and name != old[0]:
                out[text] = entry(name, cosine, a - first, a - first + size)
    for text, (named, size, first, name) in _titles(w, owner, index).items():
        if out[text] is None or named and out[text][0] == RESERVED:
            out[text] = entry(name, 1.0, -first, -first + size)


def best_passages(part: V.Slice, index: Index, least: float = LEAST) -> list[tuple | None]:
    """For each text the ``(licence, cosine, first line, last line, share of the text's words)`` of its best passage."""
    w = V.words(part)
    texts = len(part.offsets) - 1
    out: list[tuple | None] = [None] * texts
    n = len(w.hashes)
    if not n:
        return out
    vocabulary = index.vocabulary
    seen = np.minimum(np.searchsorted(vocabulary, w.hashes), len(vocabulary) - 1)
    seen = np.where(vocabulary[seen] == w.hashes, seen, len(vocabulary))
    owner = V.owners(w.offsets)
    breaks = np.flatnonzero(part.data == 10)
    line = np.searchsorted(breaks, w.starts) + owner  # every text begins a line
    heads = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    ends = np.append(heads[1:], n)
    # Each word counted apart gives too small a norm, so this cosine is an upper bound.
    known = np.flatnonzero(seen < len(vocabulary))
    first_line = np.searchsorted(breaks, part.offsets[:-1]) + np.arange(texts)
    if not len(known):
        _embedded(w, seen, owner, line, first_line, index, least, out)
        return out
    scale = np.vstack([(index.rows * index.idf[:-1]).T, np.zeros(len(index.names))])
    at = np.searchsorted(heads, known, "right") - 1
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    dots = np.add.reduceat(scale[seen[known]], first, axis=0).max(axis=1)
    norms = np.sqrt(np.add.reduceat(index.idf[seen] ** 2, heads))
    lines = at[first]
    for i in lines[dots / norms[lines] >= SCREEN]:
        text = int(owner[heads[i]])
        for span in SPANS:
            j = i
            while j + 1 < len(heads) and owner[heads[j + 1]] == text and line[heads[j + 1]] - line[heads[i]] < span:
                j += 1
            if span > 1 and line[heads[j]] - line[heads[i]] < span // 2:
                break
            a, b = heads[i], ends[j]
            found = cosines(w.hashes[a:b], index, seen[a:b])
            k = max(range(len(found)), key=lambda t: (found[t], index.names[t]))
            if found[k] >= least:
                top, last = int(line[heads[i]] - first_line[text]), int(line[heads[j]] - first_line[text])
                entry = (index.names[k], round(float(found[k]), 12), top + 1, last + 1, float(b - a) / float(w.offsets[text + 1] - w.offsets[text]))
                old = out[text]
                if old is None or (entry[1], entry[3] - entry[2], -entry[2], entry[0]) > (old[1], old[3] - old[2], -old[2], old[0]):
                    out[text] = entry
    _embedded(w, seen, owner, line, first_line, index, least, out)
    return out


OWN = "id long, path string, license string, similarity double, first_line long, last_line long, share double"


def scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per row of ``files``: id, path, license, similarity, first_line, last_line, license_file, inherited_license, inherited_from, effective_license."""
    text = F.coalesce(F.lower(F.col(text_col).cast("string")), F.lit(""))
    index = files.sparkSession.sparkContext.broadcast(build(files.select(text.alias("text")), templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch.column(2)):
                found = [f or (None,) * 5 for f in best_passages(part, index.value, least)]
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(part.first, len(found)).columns[:2], *[pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]],
                    names=[f.split()[0] for f in OWN.split(", ")],
                )

    slash = lambda c: F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(c, r"^/+|/+$", ""), "/+", "/"))
    own = files.select(F.col(id_col).cast("long").alias("id"), slash(path.cast("string")).alias("path"), text.alias("text")).mapInArrow(run, OWN)
    own = own.withColumn("directory", F.regexp_replace("path", r"/[^/]*$", "")).withColumn(
        "license_file", F.col("license").isNotNull() & (F.coalesce(F.regexp_extract("path", r"[^/]*$", 0).rlike(FILE_NAMES), F.lit(False)) | (F.col("share") >= MOSTLY))
    )
    own = freeze(own)
    spoken = own.filter("license_file AND directory IS NOT NULL").groupBy("directory").agg(
        F.min(F.struct((-F.col("similarity")).alias("_s"), "path", F.col("license").alias("l"))).alias("_best")
    ).select(F.col("directory").alias("ancestor"), F.col("_best.l").alias("inherited_license"))
    # The ancestors of each directory, itself first: '', '/a', '/a/b' for '/a/b'.
    names = F.split("directory", "/")
    above = own.filter("directory IS NOT NULL").select("directory").distinct().withColumn("_depth", F.explode(F.sequence(F.lit(1), F.size(names)))).withColumn(
        "ancestor", F.array_join(F.slice(names, F.lit(1), F.col("_depth")), "/")
    )
    nearest = freeze(
        above.join(spoken, "ancestor").groupBy("directory").agg(F.max(F.struct("_depth", "ancestor", "inherited_license")).alias("_near")).select(
            "directory", F.col("_near.ancestor").alias("inherited_from"), F.col("_near.inherited_license").alias("inherited_license")
        )
    )
    out = own.join(nearest, "directory", "left")
    none = F.col("license").isNull()
    return out.select(
        "id", "path", "license", "similarity", "first_line", "last_line", "license_file", F.when(none, F.col("inherited_license")).alias("inherited_license"),
        F.when(none & F.col("inherited_license").isNotNull(), F.concat("inherited_from", F.lit("/"))).alias("inherited_from"), F.coalesce("license", "inherited_license").alias("effective_license"),
    )
