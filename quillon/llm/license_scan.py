"""License scans by sentence rules."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Known licence sentences, normalised (lower case, runs of letters and digits with one space between), by identifier.
SENTENCES = {
    101: "licensed under the apache license version 2 0",
    102: "licensed under the apache license version 2 0 the license",
    103: "you may not use this file except in compliance with the license",
    104: "you may obtain a copy of the license at",
    105: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    106: "see the license for the specific language governing permissions and limitations under the license",
    107: "spdx license identifier apache 2 0",
    201: "released under the mit license",
    202: "licensed under the mit license",
    203: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    204: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    205: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    206: "spdx license identifier mit",
    301: "this work is licensed under the gnu general public license version 3",
    302: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    303: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    304: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    305: "see the gnu general public license for more details",
    306: "spdx license identifier gpl 3 0 only",
    307: "this work is licensed under the gnu general public license version 2",
    401: "licensed under cc by nc 4 0",
    402: "licensed under cc by 4 0",
    403: "licensed under cc by sa 4 0",
    404: "this work is licensed under a creative commons attribution 4 0 international license",
    405: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    501: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    502: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    503: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    504: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
}
#: A licence and the sequences of sentences, in order and next to each other among the known ones, that state it.
RULES = (
    ("Apache-2.0", (101,)), ("Apache-2.0", (107,)), ("Apache-2.0", (102, 103)), ("Apache-2.0", (103, 104)), ("Apache-2.0", (105, 106)),
    ("MIT", (201,)), ("MIT", (202,)), ("MIT", (206,)), ("MIT", (203, 204, 205)),
    ("GPL-3.0", (301,)), ("GPL-3.0", (306,)), ("GPL-3.0-or-later", (302, 304, 305)), ("GPL-2.0-or-later", (303, 304, 305)), ("GPL-2.0", (307,)),
    ("CC-BY-NC-4.0", (401,)), ("CC-BY-NC-4.0", (405,)), ("CC-BY-4.0", (402,)), ("CC-BY-4.0", (404,)), ("CC-BY-SA-4.0", (403,)),
    ("BSD-3-Clause", (501, 502, 503, 504)), ("BSD-2-Clause", (501, 502, 503)),
)
#: Every known sentence has one of these; a text without any of them needs no splitting.
CUES = ("licen", "warrant", "permission", "copyright", "redistribution", "free software")


KNOWN = {s: i for i, s in SENTENCES.items()}
#: All beginnings of known sentences, by whole words.
BEGINNINGS = frozenset(s[:at] for s in KNOWN for at in [*(m.start() for m in re.finditer(" ", s)), len(s)])
CUT, OTHER = re.compile(r"(?<=[.!?:;])[ \t\r]+"), re.compile(r"[^a-z0-9]+")
#: Comment marks that are words.
MARK = re.compile(r"[^a-z0-9]*(?:dnl|rem)(?![a-z0-9])")


def known_sentences(text: str) -> list[int]:
    """Identifiers of the known sentences of a lower-case text, in order.

    Pieces are lines, cut after . ! ? : or ; where white space follows, without marks. A known sentence is one piece, or
    several that follow each other (a wrapped sentence, or one with a colon in it), but never goes across an empty line.
    Of those that begin with the same piece the longest counts.
    """
    out, pieces = [], []

    def end_paragraph() -> None:
        at = 0
        while at < len(pieces):
            own, end, hit, to = pieces[at], at + 1, None, at + 1
            while own in BEGINNINGS:
                if own in KNOWN:
                    hit, to = KNOWN[own], end
                if end == len(pieces):
                    break
                own, end = f"{own} {pieces[end]}", end + 1
            if hit is not None:
                out.append(hit)
            at = to
        pieces.clear()

    for line in text.split("\n"):
        mark = MARK.match(line)
        own = [x for x in (OTHER.sub(" ", x).strip(" ") for x in CUT.split(line[mark.end() :] if mark else line)) if x]
        if not own:
            end_paragraph()
        pieces += own
    end_paragraph()
    return out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def sentence_ids(texts: pa.Array) -> pa.Array:
    return pa.array([[] if t is None else known_sentences(t) for t in texts.to_pylist()], pa.list_(pa.int32()))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs with sentence_ids (identifiers of the known licence sentences, in order) and licenses (sorted names of the
    licences whose rule occurs in that sequence).

    Each row's sentences become identifiers, whether on one line or wrapped, also in comments; a rule holds where its
    identifiers follow each other. Unknown sentences between known ones don't break a rule; a known one does. Texts with
    a cue go to Python; no shuffle. OP6_SQL takes every line by itself, so it lacks what spans pieces (wrapped notices).
    A rule that is the beginning of a longer one that also holds isn't reported (BSD-2-Clause in BSD-3-Clause).
    Null and empty text: two empty arrays. Clashing columns are replaced; all rows are kept.
    """
    own = [c for c in docs.columns if c.lower() not in ("sentence_ids", "licenses")]
    low = F.lower("text")
    cue = low.contains(CUES[0])
    for c in CUES[1:]:
        cue = cue | low.contains(c)
    rows = docs.select(*own, sentence_ids(F.when(cue, low)).alias("sentence_ids"))
    line = F.concat(F.lit(" "), F.array_join(F.transform("sentence_ids", lambda i: i.cast("string")), " "), F.lit(" "))
    at = lambda seq: line.contains(" " + " ".join(map(str, seq)) + " ")
    longer = lambda seq: [s for _, s in RULES if len(s) > len(seq) and s[: len(seq)] == seq]
    names = []
    for name, seq in RULES:
        holds = at(seq)
        for s in longer(seq):
            holds = holds & ~at(s)
        names.append(F.when(holds, F.lit(name)))
    return rows.withColumn("licenses", F.when(F.size("sentence_ids") > 0, F.array_sort(F.array_distinct(F.array_compact(F.array(*names))))).otherwise(F.array().cast("array<string>")))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join(F.transform("sentence_ids", lambda i: i.cast("string")), " ").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    known = ", ".join(f"({i}, '{s}')" for i, s in SENTENCES.items())
    case = []
    for name, seq in RULES:
        own = " ".join(map(str, seq))
        more = [" ".join(map(str, s)) for _, s in RULES if len(s) > len(seq) and s[: len(seq)] == seq]
        case.append(f"SELECT '{name}' AS name, ' {own} ' AS has, '{' ' + more[0] + ' ' if more else '#'}' AS hasnot")
    return f"""
WITH known(id, s) AS (VALUES {known}),
rules AS ({' UNION ALL '.join(case)}),
cut AS (SELECT doc_id, string_split(regexp_replace(lower(text), '([.!?:;])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS ss FROM documents),
sent AS (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS pos FROM cut),
hit AS (SELECT doc_id, pos, id FROM (SELECT doc_id, pos, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'), ' ') AS s FROM sent) JOIN known USING (s)),
seq AS (SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids, count(*) AS n FROM hit GROUP BY doc_id),
lic AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses
        FROM seq JOIN rules ON contains(' ' || ids || ' ', has) AND NOT contains(' ' || ids || ' ', hasnot) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN seq USING (doc_id) LEFT JOIN lic USING (doc_id)
"""


OP6_SQL = _sql()
