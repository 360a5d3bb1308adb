"""License scans by diagonal voting (native).

All rolling word 3-gram hashes of every text are joined with the positions of the same grams in fixed templates. A hit
votes for the diagonal (text position - template position). Votes are added up by document, template and diagonal;
neighbouring diagonals (small insertions or deletions) merge into one span; a span is verified by the share of the
template's grams it covers, each counted once, and by comparing the words themselves. A text has as many spans of a
template as it has places of it, and each is judged where it lies. The table of templates is fixed
(under two thousand rows), so its broadcast does not grow with the data, and only hits shuffle.

Defined cases: a null text is empty (no words, no labels, score 0); repeated rows are scanned as separate documents; an
empty table gives an empty result; a text with under three words has no gram and so no place.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonorant.llm.common import ascii_lower, documents, lighten

GRAM = 3

# The base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Passages of public licenses; each is one template of the label before it.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
    # Whole texts, from their first granting sentence on.
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details"),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so"),
]

#: The gram that stands for the document itself, so that one without hits stays; a real gram's hash may equal it unharmed.
_MARK = 0
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of the lower-cased text, as an array."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD), lambda w: w != "")


def template_grams(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """gram hash, gram text, template, label, tpos, n_grams, base for each position of each template."""
    every = [(label, text, True) for text, label in BASE_PHRASES.items()] + [(label, text, False) for label, text in templates]
    rows = [(-1, "", False, -1, 0, *[""] * GRAM)]  # joins each document's own mark
    for i, (label, text, base) in enumerate(every):
        w = text.split()
        rows += [(i, label, base, p, len(w) - GRAM + 1, *w[p : p + GRAM]) for p in range(len(w) - GRAM + 1)]
    names = [f"t{k}" for k in range(GRAM)]
    kinds = [("template", pa.int32()), ("label", pa.string()), ("base", pa.bool_()), ("tpos", pa.int32()), ("n_grams", pa.int32()), *((n, pa.string()) for n in names)]
    # From Arrow it is a local relation; from rows, executors would start Python workers to read it.
    df = spark.createDataFrame(pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds]))
    return df.withColumn("gram", F.when(F.col("template") < 0, F.lit(_MARK)).otherwise(F.xxhash64(*names)))


def license_scan(docs: DataFrame, slack: int = 3, share: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each row of docs (doc_id, text).

    slack: how far apart the diagonals of one span may be; share: of a template's grams that a span must cover.
    """
    spark = docs.sparkSession
    w = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), words(F.col("text")).alias("w"))
    n = F.size("w")
    rolling = F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(GRAM)]))
    grams = F.concat(F.array(F.lit(_MARK).cast("bigint")), F.when(n >= GRAM, rolling).otherwise(F.array().cast("array<bigint>")))
    placed = w.select("doc_id", "_row", "w", F.posexplode(grams).alias("at", "gram")).withColumn("pos", F.col("at") - 1)
    hits = placed.join(F.broadcast(template_grams(spark)), "gram")
    # Inside when(), the comparison of words stays a check of the few hits and does not become a join key.
    same = reduce(lambda a, b: a & b, [F.get("w", F.col("pos") + k) == F.col(f"t{k}") for k in range(GRAM)])
    ok = F.when(F.col("pos") < 0, F.col("template") < 0).when(F.col("template") < 0, F.lit(False)).otherwise(same)
    hits = hits.where(ok).select("doc_id", "_row", n.cast("long").alias("n_words"), "template", "label", "base", "n_grams", "pos", "tpos")
    diagonals = hits.groupBy("doc_id", "_row", "n_words", "template", "label", "base", "n_grams", (F.col("pos") - F.col("tpos")).alias("diag")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("tpos").alias("covered")
    )
    exact = F.col("base") & (F.col("votes") == F.col("n_grams"))
    # Neighbouring diagonals close to each other in the text merge: a gap between diagonals starts a run, a gap in the
    # text starts a span within it. What lies after such a gap ends after all before it, so the run's end is the span's.
    doc = ["doc_id", "_row", "n_words"]
    one = [*doc, "template", "label", "base", "n_grams"]
    by_diag = Window.partitionBy(*one).orderBy("diag")
    in_run = Window.partitionBy(*one, "run").orderBy("diag")
    runs = diagonals.withColumn("exact", exact).withColumn("gap", (F.col("diag") - F.lag("diag").over(by_diag) > slack).cast("int"))
    runs = runs.withColumn("run", F.sum(F.coalesce("gap", F.lit(0))).over(by_diag))
    end = F.max("hi").over(in_run.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("apart", F.coalesce((F.col("lo") > end + GRAM + slack).cast("int"), F.lit(0))).withColumn("part", F.sum("apart").over(in_run))
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("covered"))))
    spans = runs.groupBy(*one, "run", "part").agg(
        covered.alias("covered"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.count(F.when(F.col("exact"), 1)).alias("places"), F.min(F.when(F.col("exact"), F.col("diag"))).alias("first"), F.max(F.when(F.col("exact"), F.col("diag"))).alias("last"),
    )
    # Every span that covers enough is a candidate; those that overlap in the text, directly or in a chain, are one heap.
    spans = spans.withColumn("cover", F.when(F.col("n_grams") > 0, F.col("covered") / F.col("n_grams")).otherwise(F.lit(0.0)))
    spans = spans.withColumn("enough", ~F.col("base") & (F.col("template") >= 0) & (F.col("cover") >= share))
    by_place = Window.partitionBy(*doc).orderBy("lo", "hi", "template")
    reach = F.max(F.when(F.col("enough"), F.col("hi"))).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.coalesce((F.col("enough") & (F.col("lo") > reach)).cast("int"), F.lit(0))).withColumn("heap", F.sum("fresh").over(by_place))
    placed_base = F.col("base") & (F.col("places") > 0)
    heaps = spans.groupBy(*doc, "heap").agg(
        F.sum(F.when(F.col("base"), F.col("places")).otherwise(0)).alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"),
        F.collect_set(F.when(placed_base, F.col("label"))).alias("base_labels"),
        F.collect_list(F.when(F.col("enough"), F.struct("cover", "lo", "hi", "label", "template"))).alias("all"),
        F.max(F.when(placed_base, 1.0).when(~F.col("base"), F.col("cover")).otherwise(0.0)).alias("score"),
    )
    # A span stands if no better one of another template lies on the same words.
    stands = F.filter("all", lambda s: ~F.exists("all", lambda o: (o["template"] != s["template"]) & (o["cover"] > s["cover"]) & (o["lo"] <= s["hi"]) & (s["lo"] <= o["hi"])))
    by_doc = heaps.withColumn("spans", stands).groupBy(*doc).agg(
        F.sum("n_base").alias("n_base"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.max("score").alias("score"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("base_labels")))).alias("base_labels"), F.flatten(F.collect_list("spans")).alias("spans"),
    )
    return by_doc.select(
        "doc_id", "n_words", F.col("n_base").cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union("base_labels", F.transform("spans", lambda s: s["label"]))), ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.sort_array(F.transform("spans", lambda s: F.struct(s["lo"].alias("start"), (s["hi"] + GRAM).alias("end"), s["label"].alias("label")))).alias("spans"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lighten(spark)
    return license_scan(documents(spark, sf_dir)).drop("spans")


def brute_base(text: str | None) -> tuple[int, int, int | None, int | None, str]:
    """n_words, n_base, first_word, last_word, base_labels of one text, by plain scanning; for tests."""
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    found = [(i, label) for p, label in BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))
