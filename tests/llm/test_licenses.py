"""License scans on headers as they stand in files: wrapped, indented, commented."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from storelens.llm import licenses

MIT = '''MIT License

Copyright (c) 2025 A Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
'''
APACHE = '''   Copyright [yyyy] [name of copyright owner]

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
'''
ASF = '''# Licensed to the Apache Software Foundation (ASF) under one or more
# contributor license agreements.  See the NOTICE file distributed with
# this work for additional information regarding copyright ownership.
# The ASF licenses this file to You under the Apache License, Version 2.0
# (the "License"); you may not use this file except in compliance with
# the License.  You may obtain a copy of the License at
#
#    http://www.apache.org/licenses/LICENSE-2.0
'''
GPL = '''    Copyright (C) <year>  <name of author>

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
'''
BSD2 = '''Copyright (c) Donald Stufft and individual contributors.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

    1. Redistributions of source code must retain the above copyright notice,
       this list of conditions and the following disclaimer.

    2. Redistributions in binary form must reproduce the above copyright
       notice, this list of conditions and the following disclaimer in the
       documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
'''
ENDORSE = '''3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE'''
BSD3 = BSD2.replace("THIS SOFTWARE", ENDORSE, 1)
NAMED = BSD3.replace("the copyright holder nor", "Example University nor")


def commented(text):
    return "/*\n" + "".join(f" * {line}".rstrip() + "\n" for line in text.splitlines()) + " */\n"


def test_real_headers(spark):
    texts = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0": GPL, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "BSD": NAMED}
    rows = [(k, form(t)) for k, t in enumerate(texts.values()) for form in (str, commented, lambda t: t.replace("\n", "\r\n"), lambda t: f"Words before.\n{t}\nWords after.")]
    rows.append((6, ASF))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = [*texts, "Apache-2.0"]
    assert sorted((r.doc_id, r.license, r.n_matches) for r in got) == sorted((i, names[i], 1) for i, _ in rows)
    rules = {"mit-full-text", "apache-2-full-header", "apache-2-asf-header", "gpl-3-header", "bsd-2-rights-text", "bsd-3-rights-text", "bsd-rights-text"}
    assert {r.rule_id for r in got} == rules


COMMON = Path("/usr/share/common-licenses")
WHOLE = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def unwrapped(text):
    return "\n".join(" ".join(p.split()) for p in text.replace("\f", "\n").split("\n\n"))


@pytest.mark.skipif(not COMMON.exists(), reason="needs the system's license texts")
def test_whole_texts(spark):
    """Installed license texts, as they are and unwrapped, behind a very long text, and twice in one."""
    names = [n for n in WHOLE if (COMMON / n).exists()]
    rows, expected = [], {}
    for k, name in enumerate(names):
        text = (COMMON / name).read_text(errors="replace")
        for j, form in enumerate((text, unwrapped(text), "Some words of prose. " * 20_000 + "\n" + text)):
            rows.append((10 * k + j, form))
            expected[10 * k + j] = {WHOLE[name]}
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect():
        if r.rule_id.endswith(("-license", "-text")):
            got.setdefault(r.doc_id, set()).add(r.license)
    assert got == expected


def test_order_with_others_between_agrees_with_sql(spark):
    s = licenses.SENTENCES
    texts = [f"{s['gpl-3-title']}\n\nx. y. {s['gpl-3-copyleft']}.", f"{s['gpl-3-copyleft']}. {s['gpl-3-title']}.", f"{s['lgpl-2.1-free']}.\n\n2.\n{s['lgpl-warranty']}.", f"{s['mpl-2-form']}. 2.0. {s['mpl-2-copy']}. " * 3, s["gpl-2-title"] + ".\n", s["cc-by-4-notice"]]
    texts += texts[:1]  # a repeated row
    got = sorted(map(tuple, licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    assert [(i, r, n) for i, r, _, n, _ in got] == [(0, "gpl-3-license", 1), (2, "lgpl-2.1-header", 1), (3, "mpl-2-header", 3), (5, "cc-by-4-notice", 1), (6, "gpl-3-license", 1)]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    assert sorted(duckdb.sql(licenses.oracle()).fetchall()) == got


def test_plain_rights(spark):
    texts = ["Some prose here. All rights reserved. More prose.", "Line\nall rights\nRESERVED\nline", "We hold that all rights reserved here are ours.", "All rights reserved under copyright law.", "A. All rights reserved! B\nAll rights reserved"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(0, "rights-reserved", "proprietary", 1, 2), (1, "rights-reserved", "proprietary", 1, 2), (3, "all-rights-reserved", "proprietary", 1, 1), (4, "rights-reserved", "proprietary", 2, 2)]


def test_lines_stay_sentences(spark):
    """Joining wrapped lines loses no sentence that ends with its line."""
    texts = ["A title\nReleased under the MIT License\nAnother line", "Licensed under the Apache License, Version 2.0\n(see the file)", "x \x01\x02 <3> y. Licensed under CC BY 4.0"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.rule_id, r.first_sentence) for r in got) == [(0, "mit-released", 2), (1, "apache-2", 1), (2, "cc-by-4", 2)]


PROBES = {
    "SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: GPL-2.0-or-later\nint main;": "GPL-2.0",
    GPL.replace("General Public License as", "Affero General Public License as").replace("GNU\n    General", "GNU General"): "AGPL-3.0",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": "ISC",
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.": "Unlicense",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/": "EPL-2.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported License.": "CC-BY-NC-ND-3.0",
    "Licensed under the MIT licence": "MIT",
    "This software is licensed under the Apache License 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "This project is released under the terms of the BSD 3-Clause License!": "BSD-3-Clause",
    "# This file is distributed under\n# the GNU Lesser General\n# Public License v3.0": "LGPL-3.0",
    "available under GPLv3": "GPL-3.0",
}


def test_everyday_notices(spark):
    rows = [(100 * k + j, form(t)) for k, t in enumerate(PROBES) for j, form in enumerate((str, commented, lambda t: f"Some prose before.\n\n{t}\n\nMore of it behind."))]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.n_matches))
    assert got == {100 * k + j: [(license, 1)] for k, license in enumerate(PROBES.values()) for j in range(3)}


def test_pages_that_speak_of_licenses_hold_none(spark):
    """Sentences with a license's name in them, and its sentences far apart, are not the license."""
    s = licenses.SENTENCES
    filler = "This is a sentence of the page. " * (licenses.GAP + 5)
    texts = [
        "The software was once licensed under the MIT License but is not any more.", "We looked at permission notices. Is it licensed under the terms? Ask your copyright lawyer.",
        "He was released under the terms of the agreement.", "Their SPDX-License-Identifier: MIT line was wrong.", "This program is available under the counter.", f"{s['gpl-3-title']}.\n{filler}\n{s['gpl-3-copyleft']}.",
        "Permission is hereby granted to enter. All rights are reserved.", "under the CC licence umbrella", "",
    ]
    assert licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() == []


def test_sql_agrees_on_single_lines(spark):
    texts = [t for t in PROBES if "\n" not in t] + [f"{t}\n{t} x. {t}" for t in PROBES if "\n" not in t] + ["Licensed under the MIT license. SPDX-License-Identifier: MIT. licensed under MIT.\n5.\nAll rights reserved."]
    got = sorted(map(tuple, licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    assert sorted(duckdb.sql(licenses.oracle()).fetchall()) == got and len(got) > 20


def test_lines_without_stops_stay_cheap(spark):
    """Thousands of lines that begin as known sentences do, without a stop: each join ends where no known sentence is as long."""
    text = "\n".join(["this software is a word of many"] * 5000 + ["licensed", "under the", "mit license"])
    (r,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.rule_id, r.n_matches, r.first_sentence) == ("mit-licensed", 1, 5001)
