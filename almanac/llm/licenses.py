"""License scans: normalised sentences become known sentence ids; sequences of ids are matched by ordered rules.

Main path: DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import set_aside

_FREE = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation"
_LATER = "either version {} of the License, or (at your option) any later version"
_BASIS = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS'
_KIND = "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"
_COPY = "You may obtain a copy of the License at"
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"

#: Wordings of the licenses, by a key. A sentence ends at ; and : too. Its id is its place, from 1.
KNOWN = {
    "apache": "Licensed under the Apache License, Version 2.0",
    "apache-the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": _COPY,
    "apache-basis": f"{_BASIS}, {_KIND}",
    "apache-short": _BASIS,
    "apache-one": f"{_COPY} http://www.apache.org/licenses/LICENSE-2.0 {_BASIS}, {_KIND}",
    "apache-one-2": f"{_COPY} https://www.apache.org/licenses/LICENSE-2.0 {_BASIS}, {_KIND}",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "asf": 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License")',
    "apache-title": "Apache License Version 2.0, January 2004",
    "mit": "Released under the MIT License",
    "mit-by": "Licensed under the MIT License",
    "mit-project": "This project is licensed under the MIT License",
    "mit-title": "The MIT License",
    "mit-title-2": "MIT License",
    "mit-title-3": "The MIT License (MIT)",
    "mit-short": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-name-short": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "bsd-liable": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES",
    "gpl-3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-line": "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License",
    "program": "This program is free software",
    "library": "This library is free software",
    "gpl": _FREE.format(_GPL),
    "gpl-2-only": _FREE.format(_GPL + " version 2"),
    "gpl-2": f"{_FREE.format(_GPL)}, {_LATER.format('2')}",
    "gpl-3": f"{_FREE.format(_GPL)}, {_LATER.format('3')}",
    "lgpl": _FREE.format(_LGPL),
    "lgpl-3": f"{_FREE.format(_LGPL)}, {_LATER.format('3')}",
    "agpl": _FREE.format(_AGPL),
    "agpl-3": f"{_FREE.format(_AGPL)}, {_LATER.format('3')}",
    "later-2": _LATER.format("2"),
    "later-2.1": _LATER.format("2.1"),
    "later-3": _LATER.format("3"),
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-see": "See the GNU General Public License for more details",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl-copy-2": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost": "Boost Software License - Version 1.0",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "public": "This work is dedicated to the public domain",
    "reserved": "All rights reserved",
    "gpl-3-title": "GNU General Public License Version 3, 29 June 2007",
    "gpl-2-title": "GNU General Public License Version 2, June 1991",
    "lgpl-3-title": "GNU Lesser General Public License Version 3, 29 June 2007",
    "lgpl-2.1-title": "GNU Lesser General Public License Version 2.1, February 1999",
    "agpl-3-title": "GNU Affero General Public License Version 3, 19 November 2007",
    "mpl-title": "Mozilla Public License Version 2.0",
    "epl-title": "Eclipse Public License - v 2.0",
    "cc0-title": "CC0 1.0 Universal",
    "cc0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0-mark": "This work is marked with CC0 1.0 Universal",
    "cc-by-title": "Attribution 4.0 International",
    "cc-by-sa-title": "Attribution-ShareAlike 4.0 International",
    "cc-by-nc-title": "Attribution-NonCommercial 4.0 International",
    "cc-by-the": "This work is licensed under the Creative Commons Attribution 4.0 International License",
    "cc-by-sa-the": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-the": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "bsd-name-university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "spdx": "SPDX-License-Identifier",
}
#: Identifiers that follow the tag. One with "only" or "or later" names the license without it.
SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "MPL-2.0", "EPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later",
)
KNOWN |= {f"spdx-{name}": name for name in SPDX}


def plain(sentence: str) -> str:
    """What normalise() makes of an ASCII sentence."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


SENTENCES = tuple(map(plain, KNOWN.values()))
#: Ordered: the first whose sequence occurs without gaps among the document's known sentences decides. Tags come first.
RULES = (
    *((re.sub("-(only|or-later)$", "", name).lower(), ("spdx", f"spdx-{name}")) for name in SPDX),
    ("apache-2.0", ("apache-the", "apache-use", "apache-copy")),
    ("apache-2.0", ("asf", "apache-use")),
    ("apache-2.0", ("apache-copy", "apache-basis", "apache-see")),
    ("apache-2.0", ("apache-use", "apache-copy", "apache-short")),
    ("apache-2.0", ("apache-one", "apache-see")),
    ("apache-2.0", ("apache-one-2", "apache-see")),
    ("apache-2.0", ("apache",)),
    ("apache-2.0", ("apache-title",)),
    ("mit", ("mit-grant", "mit-notice")),
    ("mit", ("mit-title", "mit-short")),
    ("mit", ("mit-short", "mit-notice")),
    ("mit", ("mit-notice", "mit-as-is", "mit-liable")),
    ("mit", ("mit",)),
    ("mit", ("mit-by",)),
    ("mit", ("mit-project",)),
    ("agpl-3.0", ("agpl-3",)),
    ("agpl-3.0", ("agpl", "later-3")),
    ("agpl-3.0", ("agpl-3-title",)),
    ("lgpl-3.0", ("lgpl-3",)),
    ("lgpl-3.0", ("lgpl", "later-3")),
    ("lgpl-2.1", ("lgpl", "later-2.1")),
    ("lgpl-3.0", ("lgpl-3-title",)),
    ("lgpl-2.1", ("lgpl-2.1-title",)),
    ("gpl-3.0", ("gpl-3-work",)),
    ("gpl-3.0", ("gpl-3",)),
    ("gpl-3.0", ("gpl", "later-3")),
    ("gpl-3.0", ("gpl-3-title",)),
    ("gpl-2.0", ("gpl-2",)),
    ("gpl-2.0", ("gpl", "later-2")),
    ("gpl-2.0", ("gpl-2-only",)),
    ("gpl-2.0", ("gpl-2-title",)),
    ("gpl", ("gpl-line",)),
    ("gpl", ("gpl",)),
    ("gpl", ("gpl-hope", "gpl-see")),
    ("bsd-3-clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-name")),
    ("bsd-3-clause", ("bsd-use", "bsd-name")),
    ("bsd-3-clause", ("bsd-use", "bsd-name-short")),
    ("bsd-3-clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-name-university")),
    ("bsd-2-clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("bsd", ("bsd-use",)),
    ("bsd", ("bsd-style",)),
    ("mpl-2.0", ("mpl", "mpl-copy")),
    ("mpl-2.0", ("mpl", "mpl-copy-2")),
    ("mpl-2.0", ("mpl",)),
    ("mpl-2.0", ("mpl-title",)),
    ("isc", ("isc",)),
    ("isc", ("isc-2",)),
    ("zlib", ("zlib",)),
    ("bsl-1.0", ("boost",)),
    ("epl-2.0", ("epl",)),
    ("epl-2.0", ("epl-title",)),
    ("cc0-1.0", ("cc0",)),
    ("cc0-1.0", ("cc0-title",)),
    ("cc0-1.0", ("cc0-mark",)),
    ("unlicense", ("unlicense",)),
    ("cc-by-nc-4.0", ("cc-by-nc",)),
    ("cc-by-nc-4.0", ("cc-by-nc-work",)),
    ("cc-by-nc-4.0", ("cc-by-nc-the",)),
    ("cc-by-nc-4.0", ("cc-by-nc-title",)),
    ("cc-by-sa-4.0", ("cc-by-sa",)),
    ("cc-by-sa-4.0", ("cc-by-sa-work",)),
    ("cc-by-sa-4.0", ("cc-by-sa-the",)),
    ("cc-by-sa-4.0", ("cc-by-sa-title",)),
    ("cc-by-4.0", ("cc-by",)),
    ("cc-by-4.0", ("cc-by-work",)),
    ("cc-by-4.0", ("cc-by-the",)),
    ("cc-by-4.0", ("cc-by-title",)),
    ("public-domain", ("public",)),
    ("all-rights-reserved", ("reserved",)),
)
SEQUENCES = tuple((name, tuple(list(KNOWN).index(k) + 1 for k in keys)) for name, keys in RULES)
#: A copyright line is a sentence of its own; semicolons that begin a line mark a comment.
COPYRIGHT, COMMENT = r"(^|\n)([^A-Za-z0-9\n]*(?i:copyright) [^\n]*)", r"(^|\n)[\x20\x09]*;+"
#: In paragraphs lines are joined; a line without a letter or digit ends one. Otherwise every line is one.
PARAGRAPH_END = r"[.!?:;]+[\x20\x09-\x0D]+|\n[^A-Za-z0-9\n]*\n"
LINE_END = r"[.!?:;]+[\x20\x09-\x0D]+|[\x0A\x0D]+"


def normalise(sentence: Column) -> Column:
    """Lower case; every run of characters other than a-z and 0-9 becomes one space; trimmed. So comment marks and quotes don't count."""
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sentences_of(text: Column, end: str) -> Column:
    return F.filter(F.transform(F.split(text, end), normalise), lambda s: s != "")


def scan(docs: DataFrame, text: str = "text", sentences: tuple[str, ...] = SENTENCES, rules: tuple = SEQUENCES) -> DataFrame:
    """docs plus n_sentences (long), sentence_ids and line_ids (array<int>, known sentences in text order), license and rule_no (first rule that fits, from 1, else null), licenses (array, all that fit, by rule order).

    A sentence ends at one of . ! ? : ; before white space, at a copyright line, or at the end of a paragraph: lines are
    joined, whatever comment marks they begin with. For notices without a full stop, line_ids are those of a reading in which
    every line end ends a sentence; a rule fits if either reading has its sequence. Sentences without a letter or digit
    aren't counted. Null and empty texts have none. All work is per row: no shuffle, and repeated rows get equal results.
    Sentences are looked up in a table that is part of the plan (a set test, then the place in a list), so it's meant for up
    to some hundreds. Columns of docs named like the added ones are replaced, no others clash.
    """
    added = ("n_sentences", "sentence_ids", "line_ids", "license", "rule_no", "licenses")
    docs, (text,), back = set_aside(docs, {"_s", "_l", "_q", "_f"}, text)
    keep = [c for c in docs.columns if c not in added]
    known = F.array(*[F.lit(s) for s in sentences])
    ids = lambda found: F.transform(F.filter(found, lambda s: s.isin(*sentences)), lambda s: F.array_position(known, s).cast("int"))
    raw = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    joined = F.regexp_replace(F.regexp_replace(raw, COMMENT, "$1"), COPYRIGHT, "$1\n$2\n")
    d = docs.select(*keep, F.inline(F.array(F.struct(sentences_of(joined, PARAGRAPH_END).alias("_s"), sentences_of(raw, LINE_END).alias("_l")))))
    d = d.select(*keep, F.inline(F.array(F.struct(F.size("_s").cast("long").alias("n_sentences"), ids(F.col("_s")).alias("sentence_ids"), ids(F.col("_l")).alias("line_ids")))))
    commas = lambda c: F.concat(F.lit(","), F.array_join(c, ","), F.lit(","))
    d = d.withColumn("_q", F.concat(commas("sentence_ids"), F.lit(" "), commas("line_ids")))
    fits = [F.when(F.col("_q").contains("," + ",".join(map(str, seq)) + ","), F.struct(F.lit(k).alias("no"), F.lit(name).alias("name"))) for k, (name, seq) in enumerate(rules, 1)]
    d = d.withColumn("_f", F.array_compact(F.array(*fits)))
    return d.select(*keep, "n_sentences", "sentence_ids", "line_ids", F.get("_f", F.lit(0))["name"].alias("license"), F.get("_f", F.lit(0))["no"].alias("rule_no"), F.array_distinct(F.transform("_f", lambda x: x["name"])).alias("licenses")).transform(back)
