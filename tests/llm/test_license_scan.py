import duckdb

from quillon.llm.license_scan import CUES, OP6_SQL, RULES, SENTENCES, op6_license_scan, scan_licenses


def test_cues_and_rules():
    assert all(any(c in s for c in CUES) for s in SENTENCES.values())
    assert all(i in SENTENCES for _, seq in RULES for i in seq) and len(set(SENTENCES.values())) == len(SENTENCES)


def test_rules(spark):
    rows = [
        (1, "Text.\nReleased under the MIT License.\nMore"), (2, "x. Licensed under the Apache License, Version 2.0. y"), (3, "we like the MIT License"),
        (4, "\n".join(SENTENCES[i] + "." for i in (501, 502, 503, 504))), (5, "\n".join([SENTENCES[501], "1. " + "x", SENTENCES[502], SENTENCES[503]])),
        (6, SENTENCES[203].upper() + ".\n" + SENTENCES[205] + "\n" + SENTENCES[204]), (7, None), (8, ""), (9, "* Licensed under CC BY-NC 4.0.\r\n* Released under the MIT License!"), (None, "Released under the MIT License"),
        (10, SENTENCES[203] + ": " + SENTENCES[204] + ". " + SENTENCES[205]),
    ]
    got = {r.doc_id: list(r.licenses) for r in scan_licenses(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, licenses int")).collect()}
    assert got == {1: ["MIT"], 2: ["Apache-2.0"], 3: [], 4: ["BSD-3-Clause"], 5: ["BSD-2-Clause"], 6: [], 7: [], 8: [], 9: ["CC-BY-NC-4.0", "MIT"], None: ["MIT"], 10: ["MIT"]}


def test_query(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in op6_license_scan(spark, sf).collect())
    assert got == sorted(con.sql(OP6_SQL).fetchall()) and any(r[3] for r in got)


MIT = """The MIT License
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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
APACHE = """Copyright 2020 The Authors
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_wrapped(spark):
    texts = {"MIT": (MIT, [203, 204, 205]), "BSD-2-Clause": (BSD2, [501, 502, 503]), "BSD-3-Clause": (BSD3, [501, 502, 503, 504]), "Apache-2.0": (APACHE, [102, 103, 104, 105, 106]), "GPL-3.0-or-later": (GPL.format(":", ",", 3), [302, 304, 305]), "GPL-2.0-or-later": (GPL.format(";", ";", 2), [303, 304, 305])}
    marked = lambda t, mark: "\n".join((mark + " " + x).rstrip() for x in t.split("\n"))
    forms = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: "/*\n" + marked(t, " *") + "\n */\nint main;", *(lambda t, m=m: "code\n" + marked(t, m) for m in ("#", "//", "--", ";;", "dnl", "REM")), lambda t: t.replace("\n   ", " ").replace("\n", "\n    ")]
    rows = [(f"{name} {k}", form(t)) for name, (t, _) in texts.items() for k, form in enumerate(forms)]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for k, r in got.items():
        name = k.split()[0]
        assert (list(r.licenses), list(r.sentence_ids)) == ([name], texts[name][1]), k


def test_not_across_paragraphs(spark):
    rows = [(1, "released under\n\nthe MIT License"), (2, "we released under\nthe MIT License"), (3, "released under\nthe MIT License"), (4, "released under the MIT\nlicense, not")]
    assert {r.doc_id: list(r.licenses) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: [], 2: [], 3: ["MIT"], 4: []}
