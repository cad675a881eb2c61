"""License scan: known licence sentences, then ordered rules over their identifiers.

A text is cut into pieces at stops and line breaks, and known licence sentences, normalised, are followed word by
word over as many pieces as they span, so that wrapped ones are found; what is left is a sequence of identifiers
(0: unknown).  List numbers before a known sentence are passed over.  Rules are sequences of identifiers in order of precedence: a rule
matches where its identifiers follow one another, and claims those sentences, so that a later rule cannot
use them again.  A rule's last sentences may be optional.

Defined results: null and empty texts match nothing; repeated sentences match again; of rules that fit the same
sentences the first in order claims them; rows with a null doc_id keep it; repeated rows are scanned each; a text of any
length is scanned whole; columns other than doc_id and text are not read, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices by identifier, whole, without their last stop.
SENTENCES = {
    1: 'Licensed under the Apache License, Version 2.0 (the "License")',
    2: "you may not use this file except in compliance with the License",
    3: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    4: "Released under the MIT License",
    5: 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    6: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    7: 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    8: "This work is licensed under the GNU General Public License, version 3",
    9: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    10: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    11: "See the GNU General Public License for more details",
    16: "All rights reserved",
    17: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    18: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    19: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    20: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    21: "Licensed under the MIT License",
    22: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    23: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    24: 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    25: "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    26: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    27: 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    28: "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    29: 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    30: "See the License for the specific language governing permissions and limitations under the License",
    31: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    32: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    33: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    34: "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    35: "See the GNU Lesser General Public License for more details",
    36: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    37: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    38: "See the GNU Affero General Public License for more details",
    39: "You should have received a copy of the GNU General Public License along with this program",
    40: "You should have received a copy of the GNU Lesser General Public License along with this library",
    41: "You should have received a copy of the GNU Affero General Public License along with this program",
    42: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    43: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    44: "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    45: "This is free and unencumbered software released into the public domain",
    46: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    47: "This software is provided 'as-is', without any express or implied warranty",
    48: "In no event will the authors be held liable for any damages arising from the use of this software",
    49: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    50: "Distributed under the Boost Software License, Version 1.0",
    51: "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    52: "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    53: "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    54: "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    55: "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    56: "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    57: "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    58: "Mozilla Public License Version 2.0",
    59: "Eclipse Public License - v 2.0",
    60: "Eclipse Public License - v 1.0",
}
#: Further wordings by identifier.
WORDINGS = [
    (1, "Licensed under the Apache License, Version 2.0"),
    (3, "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (7, 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'),
    (20, "Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (25, "IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"),
    (26, "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    (31, "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    (42, "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    (60, "Eclipse Public License v1.0"),
]
#: Fixed values: (rule, licence, identifiers in order, how many of the last are optional), by precedence.
RULES = [
    ("apache-notice", "Apache-2.0", (1, 2, 3, 29, 30), 3),
    ("mit-text", "MIT", (5, 6, 7, 23), 2),
    ("gpl3-notice", "GPL-3.0", (9, 10, 11, 39), 3),
    ("gpl2-notice", "GPL-2.0", (32, 10, 11, 39), 3),
    ("lgpl21-notice", "LGPL-2.1", (33, 34, 35, 40), 3),
    ("lgpl3-notice", "LGPL-3.0", (36, 10, 35), 2),
    ("agpl3-notice", "AGPL-3.0", (37, 10, 38, 41), 3),
    ("bsd3-text", "BSD-3-Clause", (17, 18, 19, 20, 24, 25), 2),
    ("bsd2-text", "BSD-2-Clause", (17, 18, 19, 24, 25), 2),
    ("isc-text", "ISC", (26, 27, 28), 2),
    ("0bsd-text", "0BSD", (31, 27, 28), 2),
    ("zlib-text", "Zlib", (47, 48, 49), 0),
    ("unlicense-text", "Unlicense", (45, 46), 1),
    ("apache-line", "Apache-2.0", (1,), 0),
    ("apache-title", "Apache-2.0", (57,), 0),
    ("mit-line", "MIT", (4,), 0),
    ("mit-line-2", "MIT", (21,), 0),
    ("gpl3-line", "GPL-3.0", (8,), 0),
    ("gpl3-title", "GPL-3.0", (52,), 0),
    ("gpl2-title", "GPL-2.0", (53,), 0),
    ("lgpl3-title", "LGPL-3.0", (54,), 0),
    ("lgpl21-title", "LGPL-2.1", (55,), 0),
    ("agpl3-title", "AGPL-3.0", (56,), 0),
    ("mpl-line", "MPL-2.0", (22, 42), 1),
    ("mpl-title", "MPL-2.0", (58,), 0),
    ("epl2-line", "EPL-2.0", (43,), 0),
    ("epl1-line", "EPL-1.0", (44,), 0),
    ("epl2-title", "EPL-2.0", (59,), 0),
    ("epl1-title", "EPL-1.0", (60,), 0),
    ("boost-line", "BSL-1.0", (50,), 0),
    ("cc0-line", "CC0-1.0", (51,), 0),
]
#: Elements of Creative Commons licences in their order, and their names; their versions; tags of others.
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"4.0": " International", "3.0": " Unported"}
TAGS = ["Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "Unlicense", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-1.0", "EPL-2.0", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]


def _further() -> None:
    """Sentences and rules of Creative Commons notices and of licence tags, from their lists."""
    for version, area in CC_VERSIONS.items():
        for code, name in CC.items():
            number, licence = len(SENTENCES) + 100, f"CC-{code}-{version}"
            SENTENCES[number] = f"Licensed under CC {code} {version}"
            WORDINGS.extend((number, f"This work is licensed under {x}") for x in (f"CC {code} {version}", f"a Creative Commons {name} {version}{area} License", f"the Creative Commons {name} {version}{area} License"))
            RULES.append((f"cc-{code.lower()}-{version}-line", licence, (number,), 0))
    for tag in TAGS:
        number = len(SENTENCES) + 100
        SENTENCES[number] = f"SPDX-License-Identifier: {tag}"
        RULES.append((f"tag-{tag.lower()}", tag.removesuffix("-only").removesuffix("-or-later"), (number,), 0))
    RULES.append(("reserved-line", "Proprietary", (16,), 0))


_further()

#: A sentence ends at a stop before white space, or with its line; a comma or parenthesis does not end it.
END = re.compile(r"[.;:!?](?=\s)|[\r\n]+")
DROP = re.compile(r"[^0-9a-z]+")
#: The number or letter of a list's entry: a piece of its own before a stop, the beginning of a piece before a parenthesis.
LABEL = re.compile(r"[0-9]{1,3}|[a-z]|[ivx]{1,5}")
LABELLED = re.compile(rf"\W*(?:{LABEL.pattern})\)\s", re.IGNORECASE)
FIELDS = "doc_id long, rule string, license string, first_sentence int, n_sentences int, n_known int"


def normal(sentence: str) -> str:
    """Lower-case words and numbers with single spaces; all else separates."""
    return DROP.sub(" ", sentence.lower()).strip()


def sentence_table(sentences: dict[int, str] = SENTENCES, wordings=WORDINGS) -> dict:
    """Known sentences as a tree of words; the empty word leads to the identifier of the sentence that ends there."""
    root: dict = {}
    for i, s in [*sentences.items(), *((i, s) for i, s in wordings if i in sentences)]:
        node = root
        for word in normal(s).split():
            node = node.setdefault(word, {})
        node[""] = i
    return root


def cut(text: str) -> list[tuple[str, str]]:
    """Pieces of a text, normalised and as they stand; those of no word are left out."""
    return [(n, s) for s in END.split(text) if (n := normal(s))]


def longest(parts: list[str], i: int, table: dict, skip: int = 0) -> tuple[int, int]:
    """Identifier and pieces of the longest known sentence that is pieces i and on without the first words; (0, 0) if none is."""
    node, best = table, (0, 0)
    for n in range(i, len(parts)):
        for word in parts[n].split()[skip if n == i else 0 :]:
            node = node.get(word)
            if node is None:
                return best
        if "" in node:
            best = node[""], n + 1 - i
    return best


def identify(text: str, table: dict) -> list[int]:
    """The identifier sequence of a text: of a known sentence's pieces the first has the identifier, others have -1."""
    pieces = cut(text)
    parts = [n for n, _ in pieces]
    out, i = [], 0
    while i < len(parts):
        known, n = longest(parts, i, table)
        if not known and LABELLED.match(pieces[i][1]):
            known, n = longest(parts, i, table, 1)
        elif not known and LABEL.fullmatch(parts[i]) and longest(parts, i + 1, table)[0]:
            known, n = -1, 1
        out += [known] + [-1] * (n - 1)
        i += max(n, 1)
    return out


def apply_rules(ids: list[int], rules=RULES) -> list[tuple[str, str, int, int]]:
    """(rule, licence, first sentence, sentences) of all matches; earlier rules claim sentences first."""
    at = [(k, x) for k, x in enumerate(ids) if x >= 0]
    free, out = [x > 0 for _, x in at], []
    if not any(free):
        return []
    for rule, licence, seq, optional in rules:
        k = 0
        while k < len(at):
            n = 0
            while n < len(seq) and k + n < len(at) and free[k + n] and at[k + n][1] == seq[n]:
                n += 1
            if n >= len(seq) - optional and n:
                out.append((rule, licence, at[k][0], n))
                free[k : k + n] = [False] * n
                k += n
            else:
                k += 1
    return sorted(out, key=lambda m: (m[2], m[0]))


def scan(docs: DataFrame, sentences: dict[int, str] = SENTENCES, rules=RULES) -> DataFrame:
    """A row for every licence rule matched in a document, with the sentence numbers (from 0) it claims."""
    table = sentence_table(sentences)
    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def work(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = identify(text.as_py() or "", table)
                rows += [(doc.as_py(), *m, sum(x > 0 for x in ids)) for m in apply_rules(ids, rules)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, FIELDS)
