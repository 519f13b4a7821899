"""Licence scan: TF-IDF cosine of every part of a text to licence templates, then inheritance by path.

A file's own licence is the one with the template of highest cosine to any unit of it, if that reaches
``Scan.least``. Units are lines, paragraphs (runs of lines with words), comment blocks and the whole file;
templates are short notices, standard file headers and whole licence texts. Vectors are sparse: words of a unit
against words of a template. Inverse document frequencies come from the whole corpus, for the templates' words;
a word no template has weighs as much as the rarest, so that prose around a notice lowers its cosine.

A licence file speaks for its directory. A file without a licence of its own inherits from the nearest
directory above it that has one: each directory is joined with the directories on its path, and
the deepest match stays. Only distinct directories are joined in this way; files then look up theirs.

Texts are looked at in one pass per step, without a shuffle of texts. Templates are a parameter and small;
directories with very many files are split by adaptive execution in the last join.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import stored, texts_of

#: Short notices by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "EPL-2.0": "Licensed under the Eclipse Public License, version 2.0.",
}
_GNU = (
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the {2} "
    "as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
)
#: Standard headers of source files: of those in several paragraphs the one that names the licence.
HEADERS = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at",
        'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE '
        "file distributed with this work for additional information regarding copyright ownership. The ASF licenses this "
        'file to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at",
    ),
    "GPL-2.0": (_GNU.format("program", ";", "GNU General Public License", ";", "2"),),
    "GPL-3.0": (_GNU.format("program", ":", "GNU General Public License", ",", "3"),),
    "LGPL-2.0": (_GNU.format("library", ";", "GNU Library General Public License", ";", "2"),),
    "LGPL-2.1": (_GNU.format("library", ";", "GNU Lesser General Public License", ";", "2.1"),),
    "LGPL-3.0": (_GNU.format("library", ":", "GNU Lesser General Public License", ",", "3"),),
    "AGPL-3.0": (_GNU.format("program", ":", "GNU Affero General Public License", ",", "3"),),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "https://www.boost.org/LICENSE_1_0.txt)",
    ),
    "CC-BY-4.0": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this "
        "license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, "
        "Mountain View, CA 94042, USA.",
    ),
}
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|--|;|%|<!--|\"\"\"|dnl\b|rem\b)", re.IGNORECASE)


@dataclass(frozen=True)
class Scan:
    least: float = 0.75


def standard() -> dict[str, tuple[str, ...]]:
    """Notices, headers and whole texts by SPDX identifier."""
    found = {n: (t, *HEADERS.get(n, ())) for n, t in TEMPLATES.items()} | {n: h for n, h in HEADERS.items() if n not in TEMPLATES}
    for file in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        found[file.stem] = (*found.get(file.stem, ()), file.read_text(encoding="utf-8"))
    return found


def forms(templates: dict[str, str | tuple[str, ...]]) -> list[tuple[str, str]]:
    """(name, template), in order of names."""
    return [(n, t) for n in sorted(templates) for t in ([templates[n]] if isinstance(templates[n], str) else templates[n])]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def units(text: str) -> Iterator[list[str]]:
    """Words of the lines, of paragraphs and comment blocks of more than one line, and of the whole text.

    A line without words ends a paragraph, also one of comment marks only; a comment block ends at the first line
    that is no comment.
    """
    paragraph: list[list[str]] = []
    block: list[list[str]] = []
    whole: list[list[str]] = []
    longest = 1
    for line in [*text.split("\n"), ""]:
        words = words_of(line)
        if not _COMMENT.match(line):
            if len(block) > 1 and (words or len(block) != len(paragraph)):
                yield [w for ws in block for w in ws]
            block = []
        elif words:
            block.append(words)
        if words:
            yield words
            paragraph.append(words)
            whole.append(words)
        else:
            if len(paragraph) > 1:
                yield [w for ws in paragraph for w in ws]
            longest = max(longest, len(paragraph))
            paragraph = []
    if len(whole) > longest:
        yield [w for ws in whole for w in ws]


class Matcher:
    """Templates as weighted vectors of length 1, by word."""

    def __init__(self, templates: dict[str, str | tuple[str, ...]], seen: dict[str, int], documents: int):
        listed = forms(templates)
        self.names = [n for n, _ in listed]
        counts = [Counter(words_of(t)) for _, t in listed]
        known = {w for c in counts for w in c}
        self.weight = {w: math.log((1 + documents) / (1 + seen.get(w, 0))) + 1 for w in known}
        self.rarest = math.log(1 + documents) + 1
        self.postings: dict[str, list[tuple[int, float]]] = {w: [] for w in known}
        for k, c in enumerate(counts):
            v = {w: n * self.weight[w] for w, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            for w, x in v.items():
                self.postings[w].append((k, x / norm))
        self.highest = {w: max(x for _, x in p) for w, p in self.postings.items()}

    def unit(self, words: list[str], above: float = 0.0) -> dict[int, float]:
        """Cosines to the templates that share words; none, if none can lie above ``above``."""
        total = shared = bound = 0.0
        held = []
        for w, n in Counter(words).items():
            x = self.weight.get(w)
            if x is None:
                total += (n * self.rarest) ** 2
            else:
                x *= n
                shared += x * x
                bound += x * self.highest[w]
                held.append((w, x))
        norm = math.sqrt(total + shared)
        if not held or min(bound, math.sqrt(shared)) <= above * norm:
            return {}
        dots: dict[int, float] = {}
        for w, x in held:
            for k, y in self.postings[w]:
                dots[k] = dots.get(k, 0.0) + x * y
        return {k: dots[k] / norm for k in sorted(dots)}

    def best(self, text: str) -> tuple[str | None, float]:
        """The name of the closest template, the first by name of equal ones, and the cosine."""
        found, name, cache = 0.0, None, set()
        for words in units(text):
            if len(words) < 64:  # lines that come again
                key = tuple(words)
                if key in cache:
                    continue
                cache.add(key)
            for k, value in self.unit(words, found).items():
                if value > found + 1e-12:
                    found, name = value, self.names[k]
        return name, found


def frequencies(files: DataFrame, templates: dict[str, str | tuple[str, ...]], text: str = "text") -> tuple[dict[str, int], int]:
    """In how many texts each word of the templates occurs, and how many texts there are."""
    wanted = frozenset(w for _, t in forms(templates) for w in words_of(t))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        total = 0
        for batch in batches:
            for t in texts_of(batch["text"]):
                seen.update(wanted.intersection(words_of(t)))
                total += 1
        yield pd.DataFrame([*seen.items(), ("", total)], columns=["word", "n"])

    texts = files.select(F.col(f"`{text}`").cast("string").alias("text"))
    rows = texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}  # as many as the templates have words
    return found, found.pop("", 0)


def matched(
    files: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, scan: Scan = Scan(), text: str = "text"
) -> DataFrame:
    """``files``, stored, with ``own`` (SPDX) and ``cosine`` in place of the text.

    A null or empty text has no licence of its own and a cosine of 0. Without ``templates``, the standard ones count.
    """
    templates = standard() if templates is None else templates
    matcher = Matcher(templates, *frequencies(files, templates, text))

    @F.pandas_udf("name string, cosine double")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([matcher.best(t) for t in texts_of(texts)], columns=["name", "cosine"])

    kept = [f"`{c}`" for c in files.columns if c != text]
    rows = files.select(*kept, match(F.col(f"`{text}`").cast("string")).alias("m"))
    return stored(
        rows.select(
            *kept, F.when(F.col("m.cosine") >= scan.least, F.col("m.name")).alias("own"), F.round("m.cosine", 6).alias("cosine")
        ),
        "own-licences",
    )


def scanned(
    files: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, scan: Scan = Scan(), path: str = "path",
    text: str = "text", is_licence_file: str = "is_licence_file",
) -> DataFrame:
    """Per file: ``path``, ``own`` (SPDX) and its ``cosine``, ``licence`` in force, ``origin`` (own, directory or
    none) and ``directory`` that it comes from. Repeated rows are each returned; an empty table gives no rows."""
    speaks = F.coalesce(F.col(f"`{is_licence_file}`"), F.lit(False)).alias("speaks")
    return inherited(matched(files.select(F.col(f"`{path}`").alias("path"), speaks, F.col(f"`{text}`").alias("text")), templates, scan))


def inherited(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The licences in force of ``matched`` rows with ``path`` and ``speaks``; ``keys`` are columns to carry.

    A null path has no directory and inherits nothing. Where several licence files of a directory disagree the highest
    cosine decides, then the smallest path.
    """
    home = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).when(F.col("path").isNotNull(), "")
    rows = rows.withColumn("home", home)
    speaking = rows.where(F.col("speaks") & F.col("own").isNotNull() & F.col("home").isNotNull())
    declared = speaking.groupBy("home").agg(F.min_by("own", F.struct(-F.col("cosine"), F.col("path"))).alias("licence"))
    declared = stored(declared.withColumnRenamed("home", "directory"), "declared")
    # Each directory with itself and all above it.
    parts = F.split("home", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    homes = rows.select("home").distinct().where(F.col("home").isNotNull())
    homes = homes.select("home", F.explode(F.array_distinct(above)).alias("directory"))
    nearest = homes.join(declared, "directory").groupBy("home").agg(
        F.max_by(F.struct("directory", "licence"), F.length("directory")).alias("near")
    )
    nearest = stored(nearest.select("home", "near.directory", F.col("near.licence").alias("inherited")), "nearest")
    final = rows.join(nearest, "home", "left")
    return final.select(
        *keys, "path", "own", "cosine", F.coalesce("own", "inherited").alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "directory").otherwise("none").alias("origin"),
        F.when(F.col("own").isNull(), F.col("directory")).alias("directory"),
    )
