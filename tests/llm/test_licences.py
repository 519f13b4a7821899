"""Licence scan: inheritance in the registered query, templates, ids."""

from pathlib import Path

import pyspark
import pytest

from tripledger.llm import licences, queries

SMALL = "/root/testdata/sf0.001"


def test_licence_files_of_the_given_tables_speak_for_their_part(spark):
    found = queries.op4_licence_scan(spark, SMALL).collect()
    assert len(found) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    own: dict[str, set] = {}
    for r in found:
        if r.origin == "own":
            own.setdefault(r.path.rpartition("/")[0], set()).add(r.licence)
    heirs = [r for r in found if r.origin == "directory"]
    assert own and heirs and all(r.licence in own[r.directory] and r.path.startswith(r.directory + "/") for r in heirs)
    assert not any(r.path.startswith(d + "/") for r in found if r.origin == "none" for d in own)


GPL3_HEADER = """#!/usr/bin/env python
# frobnicate - does things to widgets
# Copyright (C) 2019  A. Person
#
# This file is part of Frobnicate.
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
import os
print(os.getcwd())
"""
APACHE_HEADER = """/*
 * Copyright 2021 The Frobnicate Authors
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     https://www.apache.org/licenses/LICENSE-2.0
 */
int main(void) { return 0; }
"""
HEAD = "Copyright (c) 2011-2020, Some Holder <holder@example.org>\nAll rights reserved.\n\n"


def whole(name):
    return licences.standard()[name][-1]


def test_headers_and_whole_texts_are_named():
    matcher = licences.Matcher(licences.standard(), {"the": 900, "of": 900, "and": 900, "to": 800, "is": 800}, 1000)
    assert matcher.best(GPL3_HEADER)[0] == "GPL-3.0"
    assert matcher.best(GPL3_HEADER.replace("version 3", "version 2"))[0] == "GPL-2.0"
    assert matcher.best(GPL3_HEADER.replace("GNU General", "GNU Affero General"))[0] == "AGPL-3.0"
    lesser = GPL3_HEADER.replace("GNU General", "GNU Lesser General").replace("program", "library")
    assert matcher.best(lesser.replace("version 3", "version 2.1"))[0] == "LGPL-2.1"
    assert matcher.best(APACHE_HEADER)[0] == "Apache-2.0"
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "Unlicense", "BSL-1.0", "GPL-3.0", "AGPL-3.0",
                 "LGPL-3.0", "GPL-2.0", "LGPL-2.1", "MPL-2.0", "Apache-2.0", "CC0-1.0"):
        text = HEAD + whole(name)
        commented = "".join(f" * {line}\n" for line in text.split("\n"))
        for form in (text, " ".join(text.split()), f"/*\n{commented} */\nint a, b;\n\nint c() {{ return a + b; }}\n"):
            found, cosine = matcher.best(form)
            assert (found, cosine >= 0.75) == (name, True), (name, found, cosine, form[:80])
    # A holder other than the usual one, as the first BSD texts have it.
    regents = whole("BSD-3-Clause").replace("the copyright holder nor the names of its", "the University nor the names of its")
    assert matcher.best(HEAD + regents.replace("COPYRIGHT HOLDERS", "REGENTS").replace("COPYRIGHT HOLDER", "REGENTS"))[0] == "BSD-3-Clause"
    assert matcher.best("It was a bright cold day in April,\nand the clocks were striking thirteen.")[1] < 0.75
    assert matcher.best("You must obtain a licence to fish here from the warden.")[1] < 0.75


def test_the_scan_takes_headers_and_texts_by_itself(spark):
    rows = [("LICENSE", HEAD + whole("BSD-2-Clause"), True), ("src/a.py", GPL3_HEADER, False), ("src/b.py", "plain", False)]
    found = licences.scanned(spark.createDataFrame(rows, "path string, text string, is_licence_file boolean")).collect()
    assert {r.path: (r.licence, r.origin) for r in found} == {
        "LICENSE": ("BSD-2-Clause", "own"), "src/a.py": ("GPL-3.0", "own"), "src/b.py": ("BSD-2-Clause", "directory"),
    }


REAL = {"AnchorJS": "MIT", "bootstrap": "MIT", "d3.min.js": "ISC", "jquery": "MIT", "json-formatter": "Apache-2.0", "mustache": "MIT",
        "cloudpickle": "BSD-3-Clause", "join": "BSD-3-Clause", "py4j": "BSD-3-Clause", "sbt-launch-lib": "BSD-3-Clause"}


@pytest.mark.parametrize("file", REAL)
def test_licence_files_that_come_with_spark(file):
    place = Path(pyspark.__file__).parent / "licenses" / f"LICENSE-{file}.txt"
    if not place.exists():
        pytest.skip("not in this distribution")
    matcher = licences.Matcher(licences.standard(), {}, 1000)
    found, cosine = matcher.best(place.read_text(errors="replace"))
    assert found == REAL[file] and cosine >= 0.75


def test_the_scan_carries_ids_of_any_kind(spark, tmp_path):
    rows = [(-5, "Released under the MIT License."), (-7, "plain"), (None, "plain"), (None, "Released under the MIT License."), (3, None)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in rows], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op4_licence_scan(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.licence, r.origin) for r in found), key=str) == sorted(
        [(-5, "MIT", "own"), (-7, "MIT", "directory"), (None, None, "none"), (None, "MIT", "own"), (3, None, "none")], key=str
    )
