"""Operator 7: licence recognition by known sentences and rules over their sequence.

Texts are normalised and known licence sentences are sought between their limits: end
punctuation, blank lines, web addresses and single line breaks.  A single line break may also
stand inside a sentence, with comment marks before the next line, so that wrapped texts and
notices of one line are both known.  The identifiers that a text says, in order, are matched
with rules.  A rule holds when its identifiers occur in its order, whatever licence sentences
stand between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, as published.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0",
    2: "Licensed under the Apache License, Version 2.0 (the \"License\")",
    3: "you may not use this file except in compliance with the License",
    4: "You may obtain a copy of the License at",
    5: "Released under the MIT License",
    6: "Licensed under the MIT License",
    7: "This project is licensed under the MIT License",
    8: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    9: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    10: "This work is licensed under the GNU General Public License, version 3",
    11: "Licensed under the GNU General Public License, version 3",
    12: "Licensed under the GNU General Public License, version 2",
    13: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    14: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    15: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    16: "Licensed under CC BY-NC 4.0",
    17: "Licensed under CC BY 4.0",
    18: "Licensed under CC BY-SA 4.0",
    19: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    20: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    21: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    22: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    23: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    24: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    25: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    26: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    27: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    28: "If a copy of the MPL was not distributed with this file, You can obtain one at",
    29: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    30: "SPDX-License-Identifier: Apache-2.0",
    31: "SPDX-License-Identifier: MIT",
    32: "SPDX-License-Identifier: GPL-3.0-or-later",
    33: "SPDX-License-Identifier: BSD-3-Clause",
}
# Identifier sequences and the SPDX name they stand for.
RULES = (
    ("Apache-2.0", (1,)), ("Apache-2.0", (2, 3, 4)), ("Apache-2.0", (30,)),
    ("BSD-2-Clause", (22, 23, 24)), ("BSD-3-Clause", (22, 23, 24, 25)), ("BSD-3-Clause", (33,)),
    ("CC-BY-4.0", (17,)), ("CC-BY-4.0", (19,)), ("CC-BY-NC-4.0", (16,)), ("CC-BY-NC-4.0", (20,)),
    ("CC-BY-SA-4.0", (18,)), ("CC-BY-SA-4.0", (21,)),
    ("GPL-2.0", (12,)), ("GPL-2.0-or-later", (14, 15)), ("GPL-3.0", (10,)), ("GPL-3.0", (11,)), ("GPL-3.0-or-later", (13, 15)), ("GPL-3.0-or-later", (32,)),
    ("ISC", (26,)), ("LGPL-2.1-or-later", (29,)), ("MIT", (5,)), ("MIT", (6,)), ("MIT", (7,)), ("MIT", (8, 9)), ("MIT", (31,)),
    ("MPL-2.0", (27, 28)),
)
MORE_SPECIFIC = (("BSD-2-Clause", "BSD-3-Clause"),)   # the first is not reported beside the second
LIMIT = r"[.!?]*\s*\n\s*|[.!?]+\s+"
# Applied in this order: marks before a line, limits that no sentence goes across (an empty line each), the rest of what is no word.
NORMAL = (
    (r"(^|\n)[^a-z0-9\n]*(?:(?:rem|dnl)[^\S\n][^a-z0-9\n]*)?", "$1"),
    (r"[.!?]+\s+|\s+[^a-z0-9\s]*(?=https?://)", "\n\n"),
    (r"[^a-z0-9\n]+", " "),
    (r" ?\n ?", "\n"),
)
HINT = "(?i)licen|permission|redistribut|copyright|MPL"   # every known sentence has one of them


def pieces(text: str) -> list[str]:
    """A known sentence may itself hold a limit; then its first piece stands for it."""
    import re
    out = [" ".join(re.sub("[^a-z0-9]+", " ", p.lower()).split()) for p in re.split(LIMIT, text)]
    return [p for p in out if p]


def _known() -> dict[str, int]:
    return {pieces(s)[0]: k for k, s in sorted(SENTENCES.items(), reverse=True)}


def known_pattern() -> str:
    """Of known sentences between limits, the longest; words are parted by a space or one line break."""
    return r"(?<![^\n])(?:" + "|".join(s.replace(" ", r"[ \n]") for s in sorted(_known(), key=len, reverse=True)) + r")(?![^\n])"


def rule_pattern(ids: tuple[int, ...]) -> str:
    return "," + ",(?:[0-9]+,)*".join(str(i) for i in ids) + ","


def recognise(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_sentences (known ones it says), sentence_ids, licences.

    docs: doc_id, text; other columns are not read.  sentence_ids lists the identifiers in
    text order, joined by commas; licences the SPDX names of the rules that hold, sorted and
    joined by semicolons.  Both are empty and the count 0 for NULL, empty and other texts.
    Repeated rows give equal results; each text is read whole and alone, without a shuffle.
    """
    table = F.create_map(*[F.lit(x) for pair in _known().items() for x in pair])
    text = F.coalesce(F.col("text"), F.lit(""))
    normal = F.lower(text)
    for pattern, by in NORMAL:
        normal = F.regexp_replace(normal, pattern, by)
    said_here = F.regexp_extract_all(F.trim(normal), F.lit(known_pattern()), F.lit(0))
    found = F.transform(said_here, lambda s: F.element_at(table, F.translate(s, "\n", " ")))
    ids = F.when(text.rlike(HINT), found).otherwise(F.expr("CAST(array() AS array<int>)"))
    rows = docs.select("doc_id", ids.alias("ids"))
    joined = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), joined.alias("sentence_ids"))
    said = F.concat(F.lit(","), "sentence_ids", F.lit(","))

    def named(name: str) -> Column:
        rules = [said.rlike(rule_pattern(ids)) for other, ids in RULES if other == name]
        out = rules[0]
        for rule in rules[1:]:
            out = out | rule
        return out
    names = sorted({name for name, _ in RULES})
    holds = {n: named(n) for n in names}
    for less, more in MORE_SPECIFIC:
        holds[less] = holds[less] & ~holds[more]
    licences = F.array_join(F.array_compact(F.array(*[F.when(holds[n], F.lit(n)) for n in names])), ";")
    return rows.withColumn("licences", F.when(F.col("n_sentences") > 0, licences).otherwise(F.lit("")))


def sql() -> str:
    """The same in DuckDB's SQL, for texts that hold each sentence in one line."""
    pairs = ", ".join(f"'{k}': {v}" for k, v in _known().items())
    names = sorted({name for name, _ in RULES})

    def named(name: str) -> str:
        return "(" + " OR ".join(f"regexp_matches(',' || sentence_ids || ',', '{rule_pattern(ids)}')" for n, ids in RULES if n == name) + ")"
    holds = {n: named(n) for n in names}
    for less, more in MORE_SPECIFIC:
        holds[less] = f"({holds[less]} AND NOT {holds[more]})"
    cases = ", ".join(f"CASE WHEN {holds[n]} THEN '{n}' END" for n in names)
    return rf"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]*\s*\n\s*|[.!?]+\s+'),
    lambda x: MAP {{{pairs}}}[trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))]), lambda i: i IS NOT NULL) AS ids FROM documents),
j AS (SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids FROM s)
SELECT doc_id, n_sentences, sentence_ids, array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ';') AS licences FROM j
"""
