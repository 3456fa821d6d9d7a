"""License scans by sentence rules, in DataFrame functions only.

A text is cut once into sentences, and these into their lines; each is normalised (lower case, runs of other characters than
a-z and 0-9 as one blank, "licence" as "license"). A sentence is looked up in a table from normalised known sentences to
identifiers. A line end ends a sentence as well, but a known one may be wrapped over any number of lines: from each line that begins as a
known sentence does, lines are joined up to the sentence's end, and the longest join that is known counts as one sentence.
So the cost of a text is one lookup per sentence, however many sentences are known.

The sequence of identifiers is matched against ordered rules; each is a sequence of neighbouring sentences, or of sentences
in an order with at most ``GAP`` others between, and what an earlier rule has matched is not matched again by a later one. Sentences that
are notices in themselves are counted last: some known ones, SPDX lines, and a way to say it (``WAY``) with a license's name behind it, which is
looked up in turn.
Blank lines (also those of a comment) and numbers of list items are counted as sentences but do not part neighbours.

A text without any of the sentences' signal words cannot match and is dropped by a substring test first.

Defined cases: null and blank texts match nothing; a rule that matches more than once is one row with its
number of matches; repeated rows give repeated results; extra columns are ignored; whole texts are scanned.
The SQL takes each line for itself: it does not know sentences that are wrapped over lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import slim

#: Known sentences by identifier.
SENTENCES = {
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "The software is provided \"as is\", without warranty of any kind",
    "apache-2": "Licensed under the Apache License, Version 2.0",
    "apache-2-you": "You may not use this file except in compliance with the License",
    "apache-2-copy": "You may obtain a copy of the License at",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but without any warranty",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc0": "This work is dedicated to the public domain under the CC0 license",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted under this license",
    "rights": "All rights reserved under copyright law",
    # as the licenses' own texts and notices have them
    "mit-grant-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-as-is-full": "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "apache-2-full": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-2-asf": "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "gpl-3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-warranty-full": "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "rights-plain": "All rights reserved",
    "bsd-endorse-university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    # the licenses' whole texts: titles, and sentences that only one of them has
    "gpl-1-title": "GNU General Public License Version 1, February 1989",
    "gpl-1-mercy": "The license agreements of most software companies try to keep users at the mercy of those companies",
    "gpl-2-title": "GNU General Public License Version 2, June 1991",
    "gpl-2-applies": "This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it",
    "gpl-3-title": "GNU General Public License Version 3, 29 June 2007",
    "gpl-3-copyleft": "The GNU General Public License is a free, copyleft license for software and other kinds of works",
    "lgpl-2-title": "GNU Library General Public License Version 2, June 1991",
    "lgpl-2-applies": "This license, the Library General Public License, applies to some specially designated Free Software Foundation software, and to any other libraries whose authors decide to use it",
    "lgpl-2.1-title": "GNU Lesser General Public License Version 2.1, February 1999",
    "lgpl-2.1-applies": "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it",
    "lgpl-3-title": "GNU Lesser General Public License Version 3, 29 June 2007",
    "lgpl-3-incorporates": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below",
    "lgpl-2-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "lgpl-2.1-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl-3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose",
    "gfdl-1.2-title": "GNU Free Documentation License Version 1.2, November 2002",
    "gfdl-1.3-title": "GNU Free Documentation License Version 1.3, 3 November 2008",
    "gfdl-kind": "This License is a kind of \"copyleft\", which means that derivative works of the document must themselves be free in the same sense",
    "apache-2-license": "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document",
    "apache-2-licensor": "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License",
    "mpl-1.1-title": "Mozilla Public License Version 1.1",
    "mpl-1.1-use": "\"Commercial Use\" means distribution or otherwise making the Covered Code available to a third party",
    "mpl-2-title": "Mozilla Public License Version 2.0",
    "mpl-2-contributor": "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software",
    "mpl-2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl-2-copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "cc-no-firm": "Creative Commons Corporation is not a law firm and does not provide legal services",
    "cc0-title": "CC0 1.0 Universal",
    "cc-by-4-title": "Creative Commons Attribution 4.0 International Public License",
    "cc-by-4-agree": "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License (\"Public License\")",
    "cc-by-sa-4-title": "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    "cc-by-sa-4-agree": "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License (\"Public License\")",
    "cc-by-4-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "agpl-3-title": "GNU Affero General Public License Version 3, 19 November 2007",
    "agpl-3-copyleft": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
    "agpl-3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "bsl-1-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-1-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "bsl-1-notice": "Distributed under the Boost Software License, Version 1.0",
    "bsl-1-notice-file": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "epl-2-title": "Eclipse Public License - v 2.0",
    "epl-2-program": "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")",
    "epl-2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
    "epl-2-notice-https": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-1-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "zlib-permission": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "artistic-1-title": "The \"Artistic License\"",
    "artistic-1-package": "\"Package\" refers to the collection of files distributed by the Copyright Holder, and derivatives of that collection of files created through textual modification",
}
#: Licenses by the names that notices call them; those of Creative Commons are made by rule below.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License 2.0", "Apache License v2.0", "Apache License, Version 2.0", "Apache 2.0 License", "Apache 2.0", "Apache Software License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "BSD": ["BSD License"],
    "GPL-2.0": ["GNU General Public License v2.0", "GNU General Public License v2", "GNU General Public License, version 2", "GNU GPL v2", "GPL v2", "GPLv2", "GNU GPLv2"],
    "GPL-3.0": ["GNU General Public License v3.0", "GNU General Public License v3", "GNU General Public License, version 3", "GNU GPL v3", "GPL v3", "GPLv3", "GNU GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1", "LGPL v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3", "LGPL v3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3", "AGPL v3", "AGPLv3", "GNU AGPLv3"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0"],
    "ISC": ["ISC License"],
    "Unlicense": ["Unlicense"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License - v 2.0"],
    "Zlib": ["zlib License"],
}
#: Identifiers that an SPDX line may name.
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC0-1.0 EPL-1.0 EPL-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Python-2.0 Unlicense WTFPL Zlib".split()
#: Parts of the Creative Commons licenses' names.
PARTS = {"": "", "-SA": "-ShareAlike", "-NC": "-NonCommercial", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}
for _short, _long in PARTS.items():
    for _version, _port in (("4.0", "International"), ("3.0", "Unported")):
        NAMES[f"CC-BY{_short}-{_version}"] = [f"Creative Commons Attribution{_long} {_version} {_port} License", f"Creative Commons Attribution{_long} {_version} License", f"CC BY{_short} {_version}"]
THINGS, HOW = "software project program library work code file package document dataset".split(), "licensed released distributed available".split()
#: A way to say it, in a normal sentence; its group is the license's name.
WAY = f"^(?:this (?:{'|'.join(THINGS)}) is )?(?:{'|'.join(HOW)}) under (?:the terms of )?(?:the |an? )?(.+)$"


#: Rules in the order in which they are tried: longer ones first; ``...`` stands for at most GAP sentences between.
GAP = 40
RULES = [
    ("gpl-1-license", "GPL-1.0", ["gpl-1-title", ..., "gpl-1-mercy"]),
    ("gpl-2-license", "GPL-2.0", ["gpl-2-title", ..., "gpl-2-applies"]),
    ("gpl-3-license", "GPL-3.0", ["gpl-3-title", ..., "gpl-3-copyleft"]),
    ("lgpl-2-license", "LGPL-2.0", ["lgpl-2-title", ..., "lgpl-2-applies"]),
    ("lgpl-2.1-license", "LGPL-2.1", ["lgpl-2.1-title", ..., "lgpl-2.1-applies"]),
    ("lgpl-3-license", "LGPL-3.0", ["lgpl-3-title", ..., "lgpl-3-incorporates"]),
    ("gfdl-1.2-license", "GFDL-1.2", ["gfdl-1.2-title", ..., "gfdl-kind"]),
    ("gfdl-1.3-license", "GFDL-1.3", ["gfdl-1.3-title", ..., "gfdl-kind"]),
    ("apache-2-license", "Apache-2.0", ["apache-2-license", ..., "apache-2-licensor"]),
    ("mpl-1.1-license", "MPL-1.1", ["mpl-1.1-title", ..., "mpl-1.1-use"]),
    ("mpl-2-license", "MPL-2.0", ["mpl-2-title", ..., "mpl-2-contributor"]),
    ("cc0-license", "CC0-1.0", ["cc0-title", ..., "cc-no-firm"]),
    ("cc-by-sa-4-license", "CC-BY-SA-4.0", ["cc-by-sa-4-title", ..., "cc-by-sa-4-agree"]),
    ("cc-by-4-license", "CC-BY-4.0", ["cc-by-4-title", ..., "cc-by-4-agree"]),
    ("agpl-3-license", "AGPL-3.0", ["agpl-3-title", ..., "agpl-3-copyleft"]),
    ("unlicense-text", "Unlicense", ["unlicense-free", ..., "unlicense-anyone"]),
    ("bsl-1-license", "BSL-1.0", ["bsl-1-title", ..., "bsl-1-grant"]),
    ("epl-2-license", "EPL-2.0", ["epl-2-title", ..., "epl-2-program"]),
    ("agpl-3-header", "AGPL-3.0", ["agpl-3-free", "gpl-warranty-full"]),
    ("artistic-1-license", "Artistic-1.0", ["artistic-1-title", ..., "artistic-1-package"]),
    ("bsd-3-university-rights-text", "BSD-3-Clause", ["rights-plain", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-university"]),
    ("bsd-3-university-text", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-university"]),
    ("lgpl-2-header", "LGPL-2.0", ["lgpl-2-free", "lgpl-warranty"]),
    ("lgpl-2.1-header", "LGPL-2.1", ["lgpl-2.1-free", "lgpl-warranty"]),
    ("lgpl-3-header", "LGPL-3.0", ["lgpl-3-free", "lgpl-warranty"]),
    ("mpl-2-header", "MPL-2.0", ["mpl-2-form", ..., "mpl-2-copy"]),
    ("mpl-2-header-https", "MPL-2.0", ["mpl-2-form", ..., "mpl-2-copy-https"]),
    ("bsd-3-rights-text", "BSD-3-Clause", ["rights-plain", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd-2-rights-text", "BSD-2-Clause", ["rights-plain", "bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("bsd-rights-text", "BSD", ["rights-plain", "bsd-grant", "bsd-source", "bsd-binary"]),
    ("bsd-text", "BSD", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("mit-full-text", "MIT", ["mit-grant-full", "mit-notice", "mit-as-is-full"]),
    ("mit-text", "MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("apache-2-header", "Apache-2.0", ["apache-2", "apache-2-you", "apache-2-copy"]),
    ("gpl-header", "GPL", ["gpl-free", "gpl-warranty"]),
    ("apache-2-full-header", "Apache-2.0", ["apache-2-full", "apache-2-copy"]),
    ("apache-2-asf-header", "Apache-2.0", ["apache-2-asf", "apache-2-copy"]),
    ("gpl-3-header", "GPL-3.0", ["gpl-3-free", "gpl-warranty-full"]),
    ("gpl-2-header", "GPL-2.0", ["gpl-2-free", "gpl-warranty-full"]),
    ("mit-short-text", "MIT", ["mit-grant", "mit-notice"]),
    ("mit-full-short-text", "MIT", ["mit-grant-full", "mit-notice"]),
    ("mit-grant", "MIT", ["mit-grant-full"]),
    ("apache-2-full", "Apache-2.0", ["apache-2-full"]),
    ("apache-2-asf", "Apache-2.0", ["apache-2-asf"]),
    ("gpl-3-free", "GPL-3.0", ["gpl-3-free"]),
    ("gpl-2-free", "GPL-2.0", ["gpl-2-free"]),
    ("bsd-rights-grant", "BSD", ["rights-plain", "bsd-grant"]),
    ("bsd-grant", "BSD", ["bsd-grant"]),
    ("agpl-3-free", "AGPL-3.0", ["agpl-3-free"]),
    ("isc-grant", "ISC", ["isc-grant"]),
    ("isc-grant-and", "ISC", ["isc-grant-and"]),
    ("0bsd-grant", "0BSD", ["0bsd-grant"]),
    ("unlicense-free", "Unlicense", ["unlicense-free"]),
    ("bsl-1-notice", "BSL-1.0", ["bsl-1-notice"]),
    ("bsl-1-notice-file", "BSL-1.0", ["bsl-1-notice-file"]),
    ("bsl-1-grant", "BSL-1.0", ["bsl-1-grant"]),
    ("epl-2-notice", "EPL-2.0", ["epl-2-notice"]),
    ("epl-2-notice-https", "EPL-2.0", ["epl-2-notice-https"]),
    ("epl-1-notice", "EPL-1.0", ["epl-1-notice"]),
    ("zlib-permission", "Zlib", ["zlib-permission"]),
    ("mit-released", "MIT", ["mit-released"]),
    ("mit-licensed", "MIT", ["mit-licensed"]),
    ("apache-2", "Apache-2.0", ["apache-2"]),
    ("gpl-3", "GPL-3.0", ["gpl-3"]),
    ("gpl-free", "GPL", ["gpl-free"]),
    ("lgpl-2-free", "LGPL-2.0", ["lgpl-2-free"]),
    ("lgpl-2.1-free", "LGPL-2.1", ["lgpl-2.1-free"]),
    ("lgpl-3-free", "LGPL-3.0", ["lgpl-3-free"]),
    ("cc-by-4-notice", "CC-BY-4.0", ["cc-by-4-notice"]),
    ("cc-by-nc-4", "CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("cc-by-4", "CC-BY-4.0", ["cc-by-4"]),
    ("cc0", "CC0-1.0", ["cc0"]),
    ("bsd", "BSD", ["bsd-redistribute"]),
    ("all-rights-reserved", "proprietary", ["rights"]),
    ("rights-reserved", "proprietary", ["rights-plain"]),
]
#: Each rule holds at least one sentence with one of these words; notices that have none say "released under" or the like.
SIGNALS = ["licens", "licenc", "permission", "copyright", "warranty", "reserved", "redistribut", "creative commons", "unencumbered"]
END = r"[.!?]+(?:[ \t\r\n]+|$)|[\r\n]+"
OTHER = "[^a-z0-9]+"
#: Marks of a sentence's end and of a line's end in a normalised text.
STOP, LINE = "\x01", "\x02"


def normal(sentence: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).replace("licence", "license").split())


#: Every known sentence, by identifier, and the numbers that stand for them; notices of one license have one number.
KNOWN = SENTENCES | {f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in SPDX}
NUMBER = {k: i for i, k in enumerate([*KNOWN, *[f"notice-{x.lower()}" for x in NAMES]])}
#: Lookups by normal sentence, and by normal name.
BY_SENTENCE = {normal(x): str(NUMBER[k]) for k, x in KNOWN.items()}
BY_NAME = {normal(x): str(NUMBER[f"notice-{license.lower()}"]) for license, names in NAMES.items() for x in names}
#: Rules of one sentence need no order among each other.
ORDERED = [r for r in RULES if len(r[2]) > 1]
SINGLE = {ids[0]: (rule, license) for rule, license, ids in RULES if len(ids) == 1}
SINGLE |= {f"spdx-{x.lower()}": (f"spdx-{x.lower()}", x.removesuffix("-only").removesuffix("-or-later")) for x in SPDX}
SINGLE |= {f"notice-{x.lower()}": (f"notice-{x.lower()}", x) for x in NAMES}


def code(sentence: str) -> str:
    return f"<{NUMBER[sentence]}>"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _row(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {_quoted(x)}" for k, x in fields.items()) + ")"


def _literal(kind: str, *parts: str) -> Column:
    """A table of constants as one expression: parsed in one go, which is much faster than a call for each constant."""
    return F.expr(f"{kind}({', '.join(parts)})")


def _beginnings() -> str:
    """A pattern for how known sentences begin: two words, or one that fills its line."""
    firsts: dict[str, set[str]] = {x: {"under"} for x in HOW} | {"this": set(THINGS)}
    for s in BY_SENTENCE:
        first, second, *_ = *s.split(), ""
        firsts.setdefault(first, set()).add(second)
    return "^(?:" + "|".join(f"{a}(?: (?:{'|'.join(sorted(b - {''}))})\\b|$)" for a, b in sorted(firsts.items())) + ")"


def _lookup(sentence: Column, tables: tuple[Column, Column]) -> Column:
    """The number of a normal sentence; NULL if it is unknown."""
    return F.coalesce(F.element_at(tables[0], sentence), F.element_at(tables[1], F.regexp_extract(sentence, WAY, 1)))


MOST_LETTERS = max(map(len, BY_SENTENCE))
MOST_WORDS = max(s.count(" ") + 1 for s in BY_SENTENCE)


def _longest_known(lines: Column, at: Column, tables: tuple[Column, Column]) -> Column:
    """The longest join of lines from ``at`` on that is a known sentence, as (lines, number); NULL for none.

    A line has a word at least, so as many lines are tried as the longest known sentence has words; longer joins than it end the search.
    """

    def add(state: Column, j: Column) -> Column:
        text = F.when(state["text"] == "", F.get(lines, j)).otherwise(F.concat(state["text"], F.lit(" "), F.get(lines, j)))

        def step(t: Column) -> Column:
            listed = (j == F.size(lines) - 1) & F.rlike(F.get(lines, j), F.lit("[a-z0-9] [0-9]+$"))  # a list's number may follow at the end
            hit = F.coalesce(_lookup(t, tables), F.when(listed, _lookup(F.regexp_replace(t, " [0-9]+$", ""), tables)))
            found = F.when(hit.isNotNull(), F.struct((j + 1).cast("int").alias("next"), hit.alias("number"))).otherwise(state["found"])
            over = (F.length(t) > MOST_LETTERS + 12) | (F.get(lines, j) == "")
            return F.when(over, F.struct(F.lit("").alias("text"), F.lit(True).alias("over"), state["found"].alias("found"))).otherwise(F.struct(t.alias("text"), F.lit(False).alias("over"), found.alias("found")))

        return F.when(state["over"], state).otherwise(let(text, step))

    none = F.lit(None).cast("struct<next:int,number:string>")
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("over"), none.alias("found"))
    last = F.least(F.size(lines) - 1, at + MOST_WORDS)
    return F.aggregate(F.sequence(at, last), start, add, lambda state: state["found"])


def _codes(sentence: Column, tables: tuple[Column, Column]) -> Column:
    """The lines of a sentence as an array of ``<number``, ``<`` for unknown and '' for blank ones and list numbers; joined lines are one."""

    def walk(lines: Column) -> Column:
        def add(state: Column, i: Column) -> Column:
            line = F.get(lines, i)
            found = F.when(F.rlike(line, F.lit(_beginnings())), _longest_known(lines, i, tables))
            plain = F.when(F.rlike(line, F.lit("^[0-9]*$")), F.lit("")).otherwise(F.lit("<"))

            def put(hit: Column) -> Column:
                return F.struct(F.array_append(state["out"], F.coalesce(F.concat(F.lit("<"), hit["number"]), plain)).alias("out"), F.coalesce(hit["next"], (i + 1).cast("int")).alias("next"))

            return F.when(i < state["next"], state).otherwise(let(found, put))

        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("next"))
        return F.aggregate(F.sequence(F.lit(0), F.size(lines) - 1), start, add, lambda state: state["out"])

    return let(F.split(sentence, LINE, -1), walk)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sequence(low: Column) -> Column:
    """``<place:number>`` for a known sentence, ``<>`` for another, nothing for a blank one or a number."""
    stops, lines = END.rsplit("|", 1)
    marked = F.regexp_replace(F.regexp_replace(F.translate(low, STOP + LINE, "  "), stops, STOP), lines, LINE)
    marked = F.trim(F.regexp_replace(F.regexp_replace(marked, f"[^a-z0-9{STOP}{LINE}]+", " "), f" ?([{STOP}{LINE}]) ?", "$1"))
    tables = tuple(_literal("map", *[_quoted(x) for pair in known.items() for x in pair]) for known in (BY_SENTENCE, BY_NAME))
    pieces = F.flatten(F.transform(F.split(F.replace(marked, F.lit("licence"), F.lit("license")), STOP, -1), lambda x: _codes(x, tables)))
    place = lambda c, i: F.when(c == "", c).when(c == "<", F.lit("<>")).otherwise(F.concat(F.lit("<"), (i + 1).cast("string"), F.lit(":"), F.substring(c, 2, 9), F.lit(">")))
    return F.array_join(F.transform(pieces, place), "")


def _rule(sentences: list) -> str:
    """A pattern over the identifiers; its group is the number of the first sentence."""
    codes = [f"(?:<[^>]*>){{0,{GAP}}}?" if k is ... else code(k).replace("<", "<[0-9]+:") for k in sentences]
    return "".join(codes).replace("<[0-9]+:", "<([0-9]+):", 1)


FOUND = "struct<rule_id:string,license:string,n_matches:bigint,first_sentence:bigint>"


def _matches(sequence: Column) -> Column:
    """All rules' matches: ordered rules one after the other, each on what the earlier ones left; then single sentences."""
    rules = _literal("array", *[_row(rule=rule, license=license, pattern=_rule(ids), first=code(ids[0])[1:]) for rule, license, ids in ORDERED])

    def apply(state: Column, r: Column) -> Column:
        n = F.regexp_count(state["left"], r["pattern"]).cast("long")
        hit = F.struct(r["rule"].alias("rule_id"), r["license"].alias("license"), n.alias("n_matches"), F.call_function("regexp_extract", state["left"], r["pattern"], F.lit(1)).try_cast("long").alias("first_sentence"))
        after = F.struct(F.regexp_replace(state["left"], r["pattern"], F.lit("<>")).alias("left"), F.array_append(state["found"], hit).alias("found"))
        return F.when(F.rlike(state["left"], r["pattern"]), after).otherwise(state)

    start = F.struct(sequence.alias("left"), F.array().cast(f"array<{FOUND}>").alias("found"))
    maybe = F.filter(rules, lambda r: F.contains(sequence, F.concat(F.lit(":"), r["first"])))
    single = _literal("map", *[x for k, (rule, license) in SINGLE.items() for x in (_quoted(str(NUMBER[k])), _row(rule_id=rule, license=license))])

    def add_single(state: Column) -> Column:
        places, numbers = (F.regexp_extract_all(state["left"], F.lit("<([0-9]+):([0-9]+)>"), F.lit(k)) for k in (1, 2))

        def one(c: Column) -> Column:
            r = F.element_at(single, c)
            return F.struct(r["rule_id"].alias("rule_id"), r["license"].alias("license"), F.size(F.filter(numbers, lambda x: x == c)).cast("long").alias("n_matches"), F.get(places, (F.array_position(numbers, c) - 1).cast("int")).cast("long").alias("first_sentence"))

        return F.concat(state["found"], F.transform(F.filter(F.array_distinct(numbers), lambda c: F.element_at(single, c).isNotNull()), one))

    return F.aggregate(maybe, start, apply, add_single)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, rule_id, license, n_matches, first_sentence`` (from 1) for every row of ``docs`` (doc_id, text)."""
    low = F.lower("text")
    said = lambda x: F.contains(x, F.lit("under")) & F.rlike(x, F.lit(f"(?:{'|'.join(HOW)})[^a-z0-9]+under"))
    signal = lambda x: reduce(Column.__or__, [*[F.contains(x, F.lit(w)) for w in SIGNALS], said(x)])
    rows = slim(docs, "doc_id", "text").where(F.exists(F.array(low), signal))  # in lower case once, not once for each word
    # one text at a time becomes a row of identifiers; the filter on these must not work them out a second time
    rows = rows.select("doc_id", F.explode(F.filter(F.array(_sequence(low)), lambda x: F.contains(x, F.lit(":")))).alias("sequence"))
    return rows.select("doc_id", F.explode(_matches(F.col("sequence"))).alias("m")).select("doc_id", "m.*")


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows) + ")"


def oracle() -> str:
    """The same rows in SQL."""
    known = f"known AS (SELECT * FROM {_values(BY_SENTENCE.items())} t(x, number))"
    names = f"called AS (SELECT * FROM {_values(BY_NAME.items())} t(x, number))"
    single = f"single AS (SELECT * FROM {_values((str(NUMBER[k]), *r) for k, r in SINGLE.items())} t(number, rule_id, license))"
    steps = [known, names, single, f"""piece AS (SELECT nr, doc_id, unnest(list_transform(list_transform(regexp_split_to_array(text, {_quoted(END)}),
      lambda s: replace(trim(regexp_replace(lower(s), {_quoted(OTHER)}, ' ', 'g')), 'licence', 'license')), lambda x, i: {{'x': x, 'i': i}}), recursive := true)
      FROM (SELECT row_number() OVER () AS nr, doc_id, text FROM documents WHERE text IS NOT NULL)),
    q0 AS (SELECT nr, any_value(doc_id) AS doc_id, string_agg(CASE WHEN coalesce(known.number, called.number) IS NOT NULL THEN '<' || i || ':' || coalesce(known.number, called.number) || '>' WHEN regexp_matches(piece.x, '^[0-9]*$') THEN '' ELSE '<>' END, '' ORDER BY i) AS s
      FROM piece LEFT JOIN known ON known.x = piece.x LEFT JOIN called ON called.x = regexp_extract(piece.x, {_quoted(WAY)}, 1)
      GROUP BY nr HAVING count(known.number) + count(called.number) > 0)"""]
    picks = []
    for k, (rule, license, sentences) in enumerate(ORDERED):
        pattern = _quoted(_rule(sentences))
        steps.append(f"q{k + 1} AS MATERIALIZED (SELECT nr, doc_id, regexp_replace(s, {pattern}, '<>', 'g') AS s FROM q{k})")
        picks.append(f"""SELECT doc_id, '{rule}' AS rule_id, '{license}' AS license, CAST(len(regexp_extract_all(s, {pattern})) AS BIGINT) AS n_matches,
      CAST(regexp_extract(s, {pattern}, 1) AS BIGINT) AS first_sentence FROM q{k} WHERE regexp_matches(s, {pattern})""")
    last = f"(SELECT nr, doc_id, unnest(regexp_extract_all(s, '<([0-9]+):[0-9]+>', 1)) AS place, unnest(regexp_extract_all(s, '<[0-9]+:([0-9]+)>', 1)) AS number FROM q{len(ORDERED)})"
    picks.append(f"SELECT any_value(doc_id) AS doc_id, rule_id, license, count(*) AS n_matches, min(CAST(place AS BIGINT)) AS first_sentence FROM {last} JOIN single USING (number) GROUP BY nr, rule_id, license")
    return "WITH " + ",\n".join(steps) + "\n" + "\nUNION ALL ".join(picks)
