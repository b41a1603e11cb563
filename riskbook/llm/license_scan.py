"""License scans: passages of a text compared to licence templates by the Dice coefficient over word bigrams.

DataFrame functions only. Passages are the lines and the sentences of lines, and, where a paragraph (text without a blank
line) has several lines, the paragraph and those of its sentences that go over a line break: licence texts are often
wrapped. A passage is normalised (lower case, everything but letters and digits becomes one space) and its distinct word
bigrams are counted. With a bigrams in a passage and b in a template, the Dice coefficient is at most 2 min(a, b) / (a + b);
so only templates with a between b t / (2 - t) and b (2 - t) / t are candidates at threshold t. Candidates meet the passage
in a hash join of bigrams with the templates' (a fixed list of some hundred rows), which counts the shared ones; no passage
is compared with a template it shares nothing with.

Before all that, texts go that can't have a match: a passage at threshold t shares b t / (2 - t) of a template's b bigrams at
least, so it has one of any set of words that stand in more than the other bigrams. `key_words` picks such a set.

Defined results. Null or empty texts, and texts without a passage of two words: no row. The best passage of a template
counts; of equals, the smallest. Repeated rows of a doc_id: counted as one document, n_passages adds up. A null doc_id: a
document of its own. Empty table: no row. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statements by which texts name their licence, and paragraphs of licence texts.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "MIT-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "You may not use this file except in compliance with the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "BSD-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "CC0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "All-rights-reserved": "Copyright, all rights reserved, no part may be reproduced without permission.",
}
ROOM = 1e-6  # in the bounds, for rounding


def template_bigrams(templates: dict[str, str]) -> list[tuple[str, str, int]]:
    """(licence, bigram, number of the licence's bigrams) of normalised templates."""
    rows = []
    for name, text in templates.items():
        words = re.sub(r"[^\w]+|_", " ", text.lower()).split()
        pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
        rows += [(name, pair, len(pairs)) for pair in pairs]
    return rows


def key_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Few words, long ones where there are, of which a passage has one at least if it matches a template: without them, too
    few bigrams are left to share."""
    open_ = {}
    for name, text in templates.items():
        pairs = {tuple(p.split(" ")) for _, p, _ in template_bigrams({name: text})}
        open_[name] = pairs, len(pairs) * threshold / (2 - threshold) - ROOM
    chosen: list[str] = []
    while open_ := {n: (left, need) for n, (pairs, need) in open_.items() if len(left := {p for p in pairs if not set(p) & set(chosen)}) >= need}:
        worth: dict[str, float] = {}
        for left, need in open_.values():
            for word in {w for p in left for w in p}:  # its share of what has to go, but no more than all of that
                worth[word] = worth.get(word, 0.0) + min(1.0, sum(word in p for p in left) / (len(left) - need + 1))
        chosen.append(max(worth, key=lambda w: (len(w) > 5, worth[w], w)))
    return sorted(w for w in chosen if not any(v != w and v in w and len(v) > 3 for v in chosen))


#: Sentences of a line, and of what column p holds.
LINES = "flatten(transform(split(text, '\\\\n'), l -> if(l rlike '[.!?][ \\\\t]+[^ \\\\t]', concat(array(l), split(regexp_replace(l, '([.!?])[ \\\\t]+', '$1\\n'), '\\\\n')), array(l))))"
PARAGRAPHS = "flatten(transform(filter(split(text, '\\\\n[ \\\\t\\\\r]*\\\\n'), q -> contains(q, '\\n')), q -> filter(array_distinct(concat(array(q), split(regexp_replace(q, '([.!?])[ \\\\t\\\\r\\\\n]+', '$1\\u0001'), '\\u0001'))), s -> contains(s, '\\n'))))"


def license_matches(docs: DataFrame, threshold: float = 0.8, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, licence, dice (that of the best passage), n_passages, passage (the best one's text)."""
    rows = template_bigrams(templates)
    sizes = [n for _, _, n in rows]
    low, high = min(sizes) * threshold / (2 - threshold) - ROOM, max(sizes) * (2 - threshold) / threshold + ROOM
    known = docs.sparkSession.createDataFrame(rows, "licence string, bigram string, b int")
    known = known.select("licence", "b", F.expr("xxhash64(split(bigram, ' ')[0], split(bigram, ' ')[1])").alias("bigram"))
    # Each step is made inside a generator, so that it is made once and not wherever it is used.
    texts = docs.where("text is not null").select("doc_id", F.monotonically_increasing_id().alias("row"), "text", F.explode(F.array(F.lower("text"))).alias("low"))
    able = F.lit(False)
    for word in key_words(templates, threshold):
        alone = F.col("low").rlike(f"(?<![\\p{{L}}\\p{{N}}]){word}(?![\\p{{L}}\\p{{N}}])") if len(word) < 4 else F.lit(True)  # short ones stand in many words
        able = able | F.contains("low", F.lit(word)) & alone
    words = r"split(trim(regexp_replace(lower(p), '[^\\p{L}\\p{N}]+', ' ')), ' ')"
    passages = texts.where(able).select("doc_id", "row", F.posexplode(F.expr(f"transform(concat({LINES}, {PARAGRAPHS}), p -> struct(p AS passage, {words} AS w))")).alias("no", "x"))
    sized = passages.select("doc_id", "row", "no", "x.passage", "x.w").where((F.size("w") >= 2) & (F.size("w") > low))
    # bigrams by their 64-bit hashes: sets of numbers are made fast
    pairs = F.expr("array_distinct(zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (x, y) -> xxhash64(x, y)))")
    sized = sized.select("doc_id", "row", "no", "passage", F.explode(F.array(pairs)).alias("pairs")).withColumn("a", F.size("pairs")).where(F.col("a").between(low, high))
    fits = F.col("a").between(F.col("b") * threshold / (2 - threshold) - ROOM, F.col("b") * (2 - threshold) / threshold + ROOM)
    shared = sized.select("doc_id", "row", "no", "passage", "a", F.explode("pairs").alias("bigram")).join(F.broadcast(known), "bigram").where(fits)
    scored = shared.groupBy("doc_id", "row", "no", "passage", "licence", "a", "b").agg(F.count(F.lit(1)).alias("shared"))
    scored = scored.withColumn("dice", F.round(2 * F.col("shared") / (F.col("a") + F.col("b")), 6)).where(F.col("dice") >= threshold)
    best = scored.groupBy("doc_id", "licence").agg(F.max("dice").alias("dice"), F.count(F.lit(1)).alias("n_passages"), F.min_by("passage", F.struct(-F.col("dice"), "passage")).alias("passage"))
    return best.select("doc_id", "licence", "dice", "n_passages", "passage")


def oracle(threshold: float = 0.8, templates: dict[str, str] = TEMPLATES) -> str:
    """DuckDB SQL for license_matches over the documents view."""
    values = ", ".join("('%s', '%s', %d)" % row for row in template_bigrams(templates))
    return f"""
WITH known(licence, bigram, b) AS (VALUES {values}),
docs AS (SELECT doc_id, text, row_number() OVER () AS row FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, row, unnest(string_split(text, chr(10))) AS line FROM docs),
paragraphs AS (SELECT doc_id, row, unnest(string_split_regex(text, '\\n[ \\t\\r]*\\n')) AS q FROM docs),
parts AS (SELECT doc_id, row, CASE WHEN regexp_matches(line, '[.!?][ \\t]+[^ \\t]') THEN list_prepend(line, string_split(regexp_replace(line, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))) ELSE [line] END AS ps FROM lines
  UNION ALL SELECT doc_id, row, list_filter(list_distinct(list_prepend(q, string_split(regexp_replace(q, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)))), lambda s: contains(s, chr(10))) FROM paragraphs WHERE contains(q, chr(10))),
passages AS (SELECT doc_id, passage, row_number() OVER () AS no FROM (SELECT doc_id, unnest(ps) AS passage FROM parts)),
worded AS (SELECT *, string_split(trim(regexp_replace(lower(passage), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM passages),
paired AS (SELECT doc_id, no, passage, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS pairs FROM worded WHERE len(w) >= 2),
shared AS (SELECT p.doc_id, p.no, p.passage, k.licence, p.a, k.b, count(*) AS shared
  FROM (SELECT doc_id, no, passage, len(pairs) AS a, unnest(pairs) AS bigram FROM paired) p JOIN known k USING (bigram) GROUP BY ALL),
scored AS (SELECT *, round(2.0 * shared / (a + b), 6) AS dice FROM shared)
SELECT doc_id, licence, max(dice) AS dice, count(*) AS n_passages, first(passage ORDER BY dice DESC, passage) AS passage
FROM scored WHERE dice >= {threshold} GROUP BY doc_id, licence"""
