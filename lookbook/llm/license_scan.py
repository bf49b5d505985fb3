"""Licence recognition by sentence rules.

Texts are cut into pieces and normalised (lower case, runs of other than letters and digits become one space). A known
sentence is one piece or several in a row: lines of a wrapped text and halves at a colon or semicolon are put together.
Known sentences have identifiers; a licence rule is an ordered sequence of identifiers that must stand next to each other,
where empty pieces and bare list numbers don't count. The matching of rules is relational: each known sentence of a text,
joined with the rules that use its identifier, points at the sentence where that rule would start; a rule matches where all
its places point at the same start. Matches that lie within a longer match are dropped.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Known sentences of public licences and notices, normalised.
SENTENCES = {
    "apache-short": "licensed under the apache license version 2 0",
    "apache-1": "licensed under the apache license version 2 0 the license",
    "apache-2": "you may not use this file except in compliance with the license",
    "apache-3": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "mit-short": "released under the mit license",
    "mit-short-b": "licensed under the mit license",
    "mit-1": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-2": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-2": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-0": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-1": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-2": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-3": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "reserved": "all rights reserved",
    "apache-4": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-3": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-2": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd-1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-1": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-2s": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "lgpl21-1": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-1": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3-1p": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-2": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "unlicense-1": "this is free and unencumbered software released into the public domain",
    "unlicense-2": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-1": "this software is provided as is without any express or implied warranty",
    "zlib-2": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-3": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsd4-3": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "artistic-1": "this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0",
    "perl-1": "this library is free software you can redistribute it and or modify it under the same terms as perl itself",
    "epl-1": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "boost-1": "distributed under the boost software license version 1 0",
    "wtfpl-1": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd-long": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "cc-by-nc-sa-long": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "cc-by-nc-nd-long": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
}
#: Ordered rules.
RULES = [
    ("apache-2.0", "short notice", ["apache-short"]), ("apache-2.0", "header", ["apache-1", "apache-2", "apache-3"]), ("apache-2.0", "whole header", ["apache-1", "apache-2", "apache-3", "apache-4"]),
    ("mit", "short notice", ["mit-short"]), ("mit", "short notice b", ["mit-short-b"]), ("mit", "text", ["mit-1", "mit-2", "as-is"]), ("mit", "whole text", ["mit-1", "mit-2", "as-is", "mit-3"]),
    ("gpl-3.0", "short notice", ["gpl3-short"]), ("gpl-3.0-or-later", "header", ["gpl-1", "gpl-2"]), ("gpl-2.0-or-later", "header", ["gpl2-1", "gpl-2"]), ("gpl-2.0-only", "header", ["gpl2-only", "gpl-2"]), ("gpl-3.0-only", "header", ["gpl3-only", "gpl-2"]),
    ("lgpl-2.1-or-later", "header", ["lgpl21-1", "lgpl-2"]), ("lgpl-3.0-or-later", "header", ["lgpl3-1", "lgpl-2"]), ("lgpl-3.0-or-later", "header b", ["lgpl3-1p", "gpl-2"]), ("agpl-3.0-or-later", "header", ["agpl-1", "gpl-2"]),
    ("bsd-2-clause", "text", ["bsd-0", "bsd-1", "bsd-2"]), ("bsd-3-clause", "text", ["bsd-0", "bsd-1", "bsd-2", "bsd-3"]), ("bsd-4-clause", "text", ["bsd-0", "bsd-1", "bsd-2", "bsd4-3"]),
    ("isc", "text", ["isc-1", "isc-2"]), ("0bsd", "text", ["0bsd-1", "isc-2"]), ("zlib", "text", ["zlib-1", "zlib-2", "zlib-3"]), ("unlicense", "text", ["unlicense-1", "unlicense-2"]), ("mpl-2.0", "header", ["mpl-1", "mpl-2"]), ("mpl-2.0", "header s", ["mpl-1", "mpl-2s"]),
    ("artistic-2.0", "notice", ["artistic-1"]), ("artistic-1.0-perl or gpl-1.0-or-later", "notice", ["perl-1"]), ("epl-2.0", "notice", ["epl-1"]), ("bsl-1.0", "notice", ["boost-1"]), ("wtfpl", "notice", ["wtfpl-1"]),
    ("cc-by-nc-4.0", "short notice", ["cc-by-nc"]), ("cc-by-4.0", "short notice", ["cc-by"]), ("cc-by-sa-4.0", "short notice", ["cc-by-sa"]), ("cc0-1.0", "waiver", ["cc0"]), ("proprietary", "reserved", ["reserved"]),
    ("cc-by-4.0", "notice", ["cc-by-long"]), ("cc-by-sa-4.0", "notice", ["cc-by-sa-long"]), ("cc-by-nc-4.0", "notice", ["cc-by-nc-long"]), ("cc-by-nd-4.0", "notice", ["cc-by-nd-long"]), ("cc-by-nc-sa-4.0", "notice", ["cc-by-nc-sa-long"]), ("cc-by-nc-nd-4.0", "notice", ["cc-by-nc-nd-long"]),
]
#: Identifiers of licences that tags in source files name; each gives a sentence and a rule.
TAGS = (
    "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later "
    "MPL-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause ISC 0BSD Zlib Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 EPL-2.0 BSL-1.0 Artistic-2.0 WTFPL"
).split()
SENTENCES |= {f"spdx-{tag.lower()}": f"SPDX-License-Identifier: {tag}".lower().replace("-", " ").replace(":", "").replace(".", " ") for tag in TAGS}
RULES += [(tag.lower(), "spdx", [f"spdx-{tag.lower()}"]) for tag in TAGS]
#: A piece ends at a closing mark before a blank, or at a line end.
CUT = re.compile(r"[.!?;:]+[ \t\r]+|\n")
_OTHER, _LIST_NUMBER = re.compile(r"[\W_]+"), re.compile(r"[0-9]{1,2}|[a-z]|[ivx]{1,4}")
_LEAD = re.compile(r"\A\s*\(?(?:[0-9]{1,2}|[a-zA-Z])\)\s+")
_FIRST_WORD = re.compile(r"[^\W_]+")
#: Known sentences by each run of words that they begin with: a piece is looked up here.
_STARTS: dict[str, list[str]] = defaultdict(list)
for _sid, _sentence in SENTENCES.items():
    _words = _sentence.split(" ")
    for _n in range(1, len(_words) + 1):
        _STARTS[" ".join(_words[:_n])].append(_sid)
_FIRST_WORDS = frozenset(s for s in _STARTS if " " not in s)


def normalise(piece: str) -> str:
    return _OTHER.sub(" ", piece.lower()).strip()


def _ends(pieces: list[str], at: int, text: str) -> dict[str, int]:
    """The known sentences that begin with piece ``at``, which is ``text``, and the piece after each."""
    found, open_, k = {}, _STARTS.get(text, ()), at + 1
    while open_:
        found |= {sid: k for sid in open_ if SENTENCES[sid] == text}
        open_ = [sid for sid in open_ if len(SENTENCES[sid]) > len(text)]
        while k < len(pieces) and not (more := normalise(pieces[k])):
            k += 1
        if k == len(pieces) or not open_:
            break
        text, k = f"{text} {more}", k + 1
        open_ = [sid for sid in open_ if SENTENCES[sid] == text or SENTENCES[sid].startswith(text + " ")]
    return found


def known_sentences(text: str | None) -> list[tuple[int, int, str]]:
    """(piece, sentence, sid): where a known sentence begins, and its number for adjacency.

    Numbers count sentences: pieces of one known sentence share a number; empty pieces and list numbers have none.
    """
    out, number, inside, pieces = [], 0, 0, CUT.split(text or "")
    for at, piece in enumerate(pieces):
        raw = _LEAD.sub("", piece)
        first = _FIRST_WORD.search(raw)
        if first is None:
            continue
        found = _ends(pieces, at, normalise(raw)) if first[0].lower() in _FIRST_WORDS else {}
        if at < inside and not found:
            continue
        if not found and len(raw) < 12 and _LIST_NUMBER.fullmatch(normalise(raw)):
            continue
        number += at >= inside
        out += [(at, number, sid) for sid in found]
        inside = max([inside, *found.values()])
    return out


def _tables(spark: SparkSession) -> DataFrame:
    """Rule places: fixed, some dozens of rows."""
    places = [(i, lic, name, len(ids), k, sid) for i, (lic, name, ids) in enumerate(RULES) for k, sid in enumerate(ids)]
    return spark.createDataFrame(places, "rule_id int, license string, rule string, places int, place int, sid string")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, license, rule, first_sentence, n_sentences) of every match; first_sentence counts pieces from 0, empty ones too.

    A match within a longer match of the text is dropped; equal notices at two places are two rows. Null and empty texts
    match nothing; rows that repeat a doc_id count once a place; rows without doc_id are left out; an empty table gives no
    rows. Only known sentences are shuffled. Texts may be of any length; columns besides doc_id and text, of any name, are not read.
    """

    def scan(batches):
        for pdf in batches:
            rows = [(i, *hit) for i, text in zip(pdf["doc_id"], pdf["text"], strict=True) for hit in known_sentences(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "at", "number", "sid"])

    named = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    hits = named.mapInPandas(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, at int, number int, sid string").distinct()
    starts = hits.join(F.broadcast(_tables(docs.sparkSession)), "sid").withColumn("first", F.col("number") - F.col("place"))
    full = starts.groupBy("doc_id", "rule_id", "license", "rule", "places", "first").agg(F.count_distinct("place").alias("n"), F.min("at").alias("at")).where("n = places")
    before = Window.partitionBy("doc_id").orderBy("first", F.desc("places"), "rule_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("first") + F.col("places")).over(before)
    kept = full.withColumn("reach", reach).where("reach is null or first + places > reach")
    return kept.select("doc_id", "license", "rule", F.col("at").cast("long").alias("first_sentence"), F.col("places").cast("long").alias("n_sentences"))
