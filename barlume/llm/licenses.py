"""License scan by diagonal voting.

Templates (short phrases, notices and whole license texts, fixed below) and documents are cut into
rolling word 2-grams; all of a document's 2-gram hashes meet the template positions in an equality
join. A hit at document word p and template word t votes for the diagonal p - t. An undisturbed copy
puts all its votes on one diagonal; inserted or missing words move the rest to a neighbour. So a copy
is a peak: a diagonal with more votes than any other up to a third of the template's length away
(``SLACK`` at least; of equals the first). Neighbours that near to a peak, and to no nearer one, are merged
into it where they vote for ``VOTES`` positions or more that the peak lacks. Peaks never chain, so a copy spans
less than twice its template and copies that follow each other stay apart. A phrase stands where its
diagonal has every vote; a notice or text stands where peak and neighbours cover at least ``COVER`` of its
2-grams, which is then its score. Everything is native.

The templates are a fixed list, so the joined side is small whatever the corpus.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Defined results: a null
or empty text has no words, places or labels and score 0; rows stay one to one, rows that repeat
an id and text included; other columns are ignored.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: phrase -> label; fixed values of the contract.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: label -> notices and texts in a license's own wording (public license texts).
NOTICES = {
    "apache": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "gpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0"],
    "cc0": ["to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "proprietary": ["all rights reserved no part of this publication may be reproduced distributed or transmitted in any form"],
}
#: label -> whole texts (public license texts, without the line of the holder).
TEXTS = {
    "mit": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
        KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
        AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.
    """,
    "isc": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
        AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN
        NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
        OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
    """,
    "bsd": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY
        THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
    """,
    "zlib": """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be
        plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered
        from any source distribution.
    """,
    "unlicense": """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate
        any and all copyright interest in the software to the public domain.
    """,
    "apache": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
        in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
    """,
    "gpl": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program.
    """,
}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
SLACK = 3
VOTES = 3
COVER = 0.6


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, is a base phrase, words)."""
    rows = [(label, True, phrase.split()) for phrase, label in PHRASES.items()]
    rows += [(label, False, notice.split()) for label, notices in NOTICES.items() for notice in notices]
    rows += [(label, False, [w for w in re.split(NOT_WORD, text.lower()) if w]) for label, text in TEXTS.items()]
    return [(i, *r) for i, r in enumerate(rows)]


def slack(words: list[str], base: bool) -> int:
    """How far a diagonal may be from the peak it belongs to."""
    return 0 if base else max(SLACK, (len(words) - K + 1) // 3)


def _positions(spark: SparkSession) -> DataFrame:
    """The templates' 2-grams as a literal table."""
    rows = ", ".join(
        f"({i}, '{label}', {base}, {len(w) - K + 1}, {slack(w, base)}, {t}, '{w[t]}', '{w[t + 1]}')" for i, label, base, w in templates() for t in range(len(w) - K + 1)
    )
    return spark.sql(f"SELECT xxhash64(t0, t1) AS gram, t0, t1, template, label, base, grams, slack, tpos FROM VALUES {rows} AS t(template, label, base, grams, slack, tpos, t0, t1)")


def words(text: Column) -> Column:
    """The words of the text with A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), NOT_WORD), "")


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_hash, n_words, pos and the matched template position): every hit, and one row without
    one (null template) for every row of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("doc_hash"), words(text).alias("w"))
    pairs = F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    itself = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    grams = rows.select("doc_id", "doc_hash", F.size("w").alias("n_words"), F.posexplode(F.concat(itself, pairs)).alias("at", "g"))
    grams = grams.select("doc_id", "doc_hash", "n_words", (F.col("at") - 1).alias("pos"), F.col("g.a").alias("a"), F.col("g.b").alias("b"), F.xxhash64("g.a", "g.b").alias("h"))
    met = grams.join(F.broadcast(_positions(docs.sparkSession)), (F.col("h") == F.col("gram")) & (F.col("a") == F.col("t0")) & (F.col("b") == F.col("t1")), "left")
    return met.where(F.col("template").isNotNull() | (F.col("pos") < 0)).drop("a", "b", "h", "gram", "t0", "t1")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, labels, score): places is array<struct<start, end, label, base, score>> in words."""
    hits = votes(docs, id_col, text_col)
    key = ["doc_id", "doc_hash"]
    known = [F.first(c).alias(c) for c in ("label", "base", "grams", "slack")]
    diagonal = hits.groupBy(*key, "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"),
        *known,
        F.count_if(F.col("template").isNull()).alias("copies"),  # rows that repeat id and text
        F.collect_set("tpos").alias("seen"),
    )
    diagonal = diagonal.where(F.col("template").isNull() | F.col("base") | (F.size("seen") >= VOTES))
    # peaks: every window below is one document's diagonals of one template
    one = Window.partitionBy(*key, "template")
    scaled = F.col("diagonal") / F.greatest("slack", F.lit(1))  # so that one range frame fits templates of all lengths
    near = one.orderBy(scaled).rangeBetween(-1, 1)
    size = F.struct(F.size("seen").alias("votes"), (-F.col("diagonal")).alias("first"))
    peak = F.coalesce(F.col("base"), F.lit(True)) | (F.max(size).over(near) == size)
    marked = diagonal.withColumn("peak", F.when(peak, F.col("diagonal")))
    row = one.orderBy("diagonal")
    back = F.last("peak", ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.first("peak", ignorenulls=True).over(row.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    gap = lambda c: F.coalesce(F.abs(F.col("diagonal") - F.col(c)), F.lit(1 << 30))
    marked = marked.withColumns({"back": back, "ahead": ahead})
    marked = marked.withColumn("of", F.when(gap("ahead") < gap("back"), F.col("ahead")).otherwise(F.col("back")))
    marked = marked.where(F.col("template").isNull() | (F.abs(F.col("diagonal") - F.col("of")) <= F.col("slack")))
    merged = marked.groupBy(*key, "template", "of").agg(
        F.max("n_words").alias("n_words"),
        F.max("copies").alias("copies"),
        *known[:3],
        F.first(F.when(F.col("peak").isNotNull(), F.col("seen")), ignorenulls=True).alias("own"),
        F.collect_list(F.when(F.col("peak").isNull(), F.struct("diagonal", "seen"))).alias("others"),
    )
    more = F.transform("others", lambda x: F.struct(x["diagonal"].alias("diagonal"), F.array_except(x["seen"], F.col("own")).alias("seen")))
    merged = merged.withColumn("others", F.filter(more, lambda x: F.size(x["seen"]) >= VOTES))
    merged = merged.withColumns(
        {
            "votes": F.size(F.array_distinct(F.concat("own", F.flatten(F.transform("others", lambda x: x["seen"]))))),
            "start": F.array_min(F.concat(F.array(F.col("of") + F.array_min("own")), F.transform("others", lambda x: x["diagonal"] + F.array_min(x["seen"])))),
            "end": F.array_max(F.concat(F.array(F.col("of") + F.array_max("own")), F.transform("others", lambda x: x["diagonal"] + F.array_max(x["seen"])))) + K,
        }
    ).withColumn("score", F.col("votes") / F.col("grams"))
    stands = F.when(F.col("base"), F.col("votes") == F.col("grams")).otherwise(F.col("score") >= COVER)
    place = F.when(stands, F.struct("start", "end", "label", "base", "score"))
    out = merged.groupBy(*key).agg(F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.array_sort(F.collect_list(place)).alias("places"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "places",
        F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )
