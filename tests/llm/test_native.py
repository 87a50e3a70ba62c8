"""Quality rules, license scans, WARC archives and URL filters on small tables."""

import base64
import gzip
import hashlib
import random
import re

from pyspark.sql import functions as F

from almanac.llm import licenses, quality, urlfilter, warc


def measured(t):
    t = t or ""
    w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if x]
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for x in wins:
        seen[x] = seen.get(x, 0) + 1
    cov = {i + j for i, x in enumerate(wins) if seen[x] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if any(c not in " \t\v\f\r" for c in x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(cov)


def test_measurements(spark):
    rnd = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x\ny\nx\n \n", "a a a a a a a a", "é日本 🎉 #$|", "one\x0btwo\x0cthree\xa0four"]
    texts += ["".join(rnd.choice(["a ", "b ", "c\n", "d", "# ", "  "]) for _ in range(rnd.randint(0, 400))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r.doc_id: tuple(r[c] for c in quality.MEASURES) for r in quality.measure(df).collect()}
    assert got == {i: measured(t) for i, t in enumerate(texts)}
    plan = quality.judge(quality.ledger(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_policies_and_ablations(spark):
    good = " ".join(f"w{i}" for i in range(30))
    texts = [good, "few words", good + " ####" * 60, ("long" * 30 + " ") * 3 + good[:0] + " ".join("y" * 60 + str(i) for i in range(12)), None]
    rows = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.kept for r in quality.judge(rows).orderBy("doc_id").collect()] == [True, False, False, False, False]
    assert [r.kept for r in quality.judge(rows, "base").orderBy("doc_id").collect()][0] is True
    ab = {r.rule: (r.failed, r.only_by_it) for r in quality.ablations(rows).collect()}
    assert ab["too_few_words"] == (2, 2) and ab["overlong_words"] == (1, 1)
    assert {r.failed for r in quality.ablations(rows.limit(0)).collect()} == {0}


MIT = """MIT License

Copyright (c) 2020 Some One

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
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE = """Copyright 2019 The Authors
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
BSD = """Copyright (c) 2001, The Board
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
NAME = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_whole_licenses_wrapped_and_commented(spark):
    """Each text as it is, in comments of five kinds, on one line, and with Windows line ends."""
    whole = {"mit": MIT, "gpl-3.0": GPL, "apache-2.0": APACHE, "bsd-3-clause": BSD.format(NAME), "bsd-2-clause": BSD.format("")}
    rows = []
    for name, t in whole.items():
        lines = t.split("\n")
        forms = [t, "/*\n" + "".join(f" * {x}\n" for x in lines) + " */\nint x;\n", *("".join(f"{m} {x}\n" for x in lines) for m in ("//", "#", "--", ";;")), " ".join(t.split()), t.replace("\n", "\r\n"), "Some words before.\n\n" + t + "\n\nAnd words behind"]
        rows += [(name, x) for x in forms]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, name string, text string")
    wrong = [(r.name, r.license, r.text[:60]) for r in licenses.scan(df).where("license is null or license <> name").collect()]
    assert not wrong


def test_tags_titles_and_short_notices(spark):
    texts = {
        "// SPDX-License-Identifier: MIT\npackage a\n": "mit", "# SPDX-License-Identifier: Apache-2.0": "apache-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */\r\nint x;": "gpl-2.0", "-- SPDX-License-Identifier: LGPL-3.0-or-later\n\nselect 1": "lgpl-3.0",
        "    GNU GENERAL PUBLIC LICENSE\n    Version 3, 29 June 2007\n\n Everyone may copy.": "gpl-3.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions": "mpl-2.0",
        "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n": "cc0-1.0", "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n": "bsd", "Words. This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa-4.0",
        BSD.format(NAME.replace("copyright holder", "University")): "bsd-3-clause", "We like MIT.\nMIT\nApache-2.0": None, "SPDX-License-Identifier: Unheard-Of": None, "The CC0 1.0 Universal idea": None,
    }
    df = spark.createDataFrame(list(texts.items()), "text string, name string")
    wrong = [(r.text[:50], r.license) for r in licenses.scan(df).collect() if r.license != r.name]
    assert not wrong


def test_licenses(spark):
    texts = [
        "Text. Licensed under the Apache License, Version 2.0.", "released UNDER the MIT license\nAll rights reserved.", "The MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. More.",
        "We talk about the MIT license here.", None, "", "All rights reserved. Licensed under CC BY-NC 4.0.", "word. " * 50_000 + "All rights reserved",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, license string")
    got = {r.doc_id: (r.n_sentences, r.license, list(r.licenses)) for r in licenses.scan(df).collect()}
    both, none = (2, "apache-2.0", ["apache-2.0"]), (0, None, [])
    assert got == {0: both, 1: (1, "mit", ["mit", "all-rights-reserved"]), 2: (2, "mit", ["mit"]), 3: (1, None, []), 4: none, 5: none, 6: (2, "cc-by-nc-4.0", ["cc-by-nc-4.0", "all-rights-reserved"]), 7: (50_001, "all-rights-reserved", ["all-rights-reserved"]), 8: both}
    assert licenses.scan(df.limit(0)).collect() == []
    plan = licenses.scan(df)._jdf.queryExecution()
    assert "Python" not in plan.executedPlan().toString() and "INSET" in plan.optimizedPlan().toString()
    assert len(set(licenses.SENTENCES)) == len(licenses.SENTENCES)


def test_warc(spark, tmp_path):
    pages = [(1, "http://a", "same"), (5, "http://b", "same"), (9, "http://c\r\nX: 1", "same"), (2, None, None), (3, "http://d", ""), (4, "http://e", "a\r\n\r\nWARC/1.1\r\nß"), (None, "http://f", "same"), (9, "http://c", "same")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload_digest string").repartition(3)
    path = f"{tmp_path}/w"
    out = warc.roundtrip(df, path=path)
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()), key=repr)
    refer = {1: 9, 5: 9, 2: 3}
    want = [(i, len((h or "").encode()), sha(h), "revisit" if i in refer else "response", refer.get(i)) for i, _, h in pages]
    assert got == sorted(want, key=repr)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    assert raw.count(b"WARC-Type: response") == 5 and raw.endswith(b"\r\n\r\n")
    ids = re.findall(rb"WARC-Record-ID: <urn:uuid:[0-9a-f-]{36}>", raw)
    assert len(set(ids)) == len(pages) and len(re.findall(rb"WARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", raw)) == len(pages)
    # Files by size: payloads of up to 3 bytes, of up to 10, and longer ones, of which each has a file of its own.
    warc.write_archives(df, f"{tmp_path}/s", files=((3, 2), (10, 5), (1 << 62, 1)))
    again = warc.read_resolved(spark, f"{tmp_path}/s").select(*out.columns).collect()
    assert sorted(again, key=repr) == sorted(out.collect(), key=repr)
    big = warc.roundtrip(df, min_bytes=3, path=f"{tmp_path}/v")
    assert big.where("page_id = 2").first().record_type == "response"
    assert warc.roundtrip(df.limit(0), path=f"{tmp_path}/u").collect() == []


def test_hosts_of_many_labels(spark):
    long = "http://" + "a." * 20_000 + "example.com/en/"
    df = spark.createDataFrame([(1, long), (2, "http://.../x"), (3, "http:///fr/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in urlfilter.judge_urls(df, urlfilter.rules_table(spark)).orderBy("page_id").collect()] == [("example.com/en/", "block"), (None, "allow"), (None, "allow")]
    anywhere = spark.createDataFrame([("block", "", "/fr/")], "action string, host string, path string")
    assert [r.verdict for r in urlfilter.judge_urls(df, anywhere).orderBy("page_id").collect()] == ["allow", "allow", "block"]


def test_ledger_can_be_filtered(spark):
    rows = [(i, " ".join(f"w{i * j % 50}" for j in range(300)), "s") for i in range(60)] + [(90, "", "s"), (90, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = quality.judge(quality.ledger(df))
    assert judged.where("kept and n_words > 20").count() == sum(r.kept and r.n_words > 20 for r in judged.collect())
    assert quality.measure(df.limit(0)).where("n_words = 0").collect() == [] and judged.where("doc_id = 90").count() == 2


def test_urls(spark):
    urls = {
        "http://WWW.Example.com/en/x?q": ("www.example.com", "/en/x", "www.example.com/en/", "allow"), "https://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"), "https://example.com/en": ("example.com", "/en", "com/", "allow"),
        "http://x.net/fr/y#z": ("x.net", "/fr/y", "net/fr/", "block"), "http://x.net/de/": ("x.net", "/de/", None, "allow"), "http://notcom/": ("notcom", "/", None, "allow"), "http://a.com": ("a.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://?x": ("", "", None, "allow"), "http://com/a://b.net/fr/": ("com", "/a://b.net/fr/", "com/", "allow"), "http://u\nv.com/\n": ("u\nv.com", "/\n", "com/", "allow"),
    }
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(list(urls) * 2)], "page_id long, url string, host string, short string")
    rules = urlfilter.rules_table(spark)
    got = urlfilter.judge_urls(df, rules)
    assert [c for c in got.columns if c not in ("page_id", "url", "short")] == ["host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == 2 * len(urls)
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in rows} == urls
    assert urlfilter.judge_urls(df.limit(0), rules).collect() == []
    assert {r.verdict for r in urlfilter.judge_urls(df, rules.limit(0), default="block").collect()} == {"block"}
    tie = spark.createDataFrame([("allow", "a.b", "/c"), ("block", "a.b", "/c"), ("allow", "b", "")], "action string, host string, path string")
    one = spark.createDataFrame([(1, "http://x.a.b/cd"), (2, "http://b"), (3, "http://c.b/c")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in urlfilter.judge_urls(one, tie, "none").orderBy("page_id").collect()] == [("a.b/c", "block"), ("b", "allow"), ("b", "allow")]
