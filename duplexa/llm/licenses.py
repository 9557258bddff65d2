"""License scans by diagonal voting.

All rolling word k-gram hashes of all documents are joined to the positions of the same grams in license templates. A match votes for its diagonal, the offset of document position against template position; neighbouring
diagonals (words put in or left out) are merged, and a span counts once its grams, compared as words, cover enough of the template. Phrases of a few words use grams of PHRASE_GRAM words and have to stand
word for word; longer texts use grams of TEXT_GRAM words and may be altered.

The template table is part of the library and of fixed size, so it is broadcast. A document's grams are one array that the join explodes; one reserved key makes each document a row of its own, so a single
shuffle of matches and documents is all that moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import slices

PHRASE_GRAM = 2
TEXT_GRAM = 5
#: Diagonals at most so far apart are one span.
NEIGHBOURS = 6
#: Share of a template's words that a span has to cover.
COVERED = 0.6

#: Phrases of the base rule, and their labels, unless others are given.
BASE_PHRASES = (("mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Phrases of the base rule of the query op1_license_scan; there a mere "mit license" is a further phrase.
QUERY_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Further phrases that name a license.
PHRASES = (
    ("licensed under the mit", "mit"),
    ("apache 2 0 license", "apache-2"),
    ("apache license 2 0", "apache-2"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2", "mpl-2"),
    ("bsd 2 clause", "bsd-2"),
    ("bsd 3 clause", "bsd-3"),
    ("isc license", "isc"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("cc0 1 0 universal", "cc0"),
)
#: The wording of well-known license notices.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd-2", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The key that each document has once.
_DOCUMENT = 0


def _grams(text: str, k: int) -> tuple[list[int], list[str], int]:
    """Keys and wording of a text's grams, and its number of words."""
    offsets, data = K.text_bytes(pa.array([text]))
    start, end, hashes, begins = K.words(offsets, data, K.WORDY, K.FOLDED)
    words = [bytes(data[a:b]).decode().lower() for a, b in zip(start, end, strict=True)]
    return K.windows(hashes, begins, k)[0].view(np.int64).tolist(), [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)], len(words)


def templates(spark: SparkSession, base: tuple = BASE_PHRASES, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """key, template, label, base (whether of the base rule), exact (whether all words must stand), k, words (how many), place and gram, and the row of the reserved key."""
    rows = [(_DOCUMENT, -1, None, False, False, 0, 0, 0, "")]
    all_ = [(t, label, True, True) for t, label in base] + [(t, label, False, True) for t, label in phrases] + [(t, label, False, False) for label, t in notices]
    for i, (text, label, is_base, exact) in enumerate(all_):
        k = PHRASE_GRAM if exact else TEXT_GRAM
        keys, grams, n = _grams(text, k)
        rows += [(key, i, label, is_base, exact, k, n, place, gram) for place, (key, gram) in enumerate(zip(keys, grams, strict=True))]
    return spark.createDataFrame(rows, "key long, template int, label string, base boolean, exact boolean, k int, words int, place int, gram string")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, body (the text's bytes, A-Z as a-z), at (byte starts of its words, and their end) and keys: the reserved key, then those of PHRASE_GRAM, then those of TEXT_GRAM words."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                offsets, data = K.text_bytes(batch.column("text"))
                start, end, hashes, begins = K.words(offsets, data, K.WORDY, K.FOLDED)
                two, at2 = K.windows(hashes, begins, PHRASE_GRAM)
                five, at5 = K.windows(hashes, begins, TEXT_GRAM)
                n = np.diff(begins)
                ends = np.zeros(len(n) + 1, np.int32)
                np.cumsum(1 + np.diff(at2) + np.diff(at5), out=ends[1:])
                keys = np.full(ends[-1], _DOCUMENT, np.int64)
                for values, at, shift in ((two, at2, 1), (five, at5, 1 + np.diff(at2))):
                    keys[np.arange(len(values)) + np.repeat(ends[:-1] + shift - at[:-1], np.diff(at))] = values.view(np.int64)
                owner = np.repeat(np.arange(len(n)), n)
                begin, stop = (pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array((x - offsets[owner]).astype(np.int32))) for x in (start, end))
                body = lower[data[offsets[0] : offsets[-1]]].tobytes()
                bodies = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(body)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), bodies, begin, stop, pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))], names=["doc_id", "n_words", "body", "begin", "stop", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, body binary, begin array<int>, stop array<int>, keys array<long>")


def votes(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), n_words, and for each gram that stands as in a template: template, its columns, place, pos (the word it starts at) and diagonal; besides a row with template -1 for each document.

    Rows of the same id and text vote once; copies says how many there are. They are put together on the map side already, so copies of one document never meet in a task.
    """
    met = _keyed(docs).withColumn("row", F.xxhash64("body")).select("doc_id", "row", "n_words", "body", "begin", "stop", F.posexplode("keys").alias("at", "key")).join(F.broadcast(table), "key")
    before_five = 1 + F.greatest(F.col("n_words") - PHRASE_GRAM + 1, F.lit(0))
    pos = F.when(F.col("k") == PHRASE_GRAM, F.col("at") - 1).otherwise(F.col("at") - before_five).cast("long")
    first, last = F.get("begin", F.col("pos").cast("int")), F.get("stop", (F.col("pos") + F.col("k") - 1).cast("int"))
    wording = F.regexp_replace(F.decode(F.substring(F.col("body"), first + 1, last - first), "UTF-8"), _BETWEEN, " ")
    # a key may come from grams of the other size, or by chance: the words decide
    in_range = (F.col("pos") >= 0) & F.when(F.col("k") == PHRASE_GRAM, F.col("at") < before_five).otherwise(F.col("at") >= before_five)
    right = F.when(F.col("template") < 0, F.col("at") == 0).when(in_range, wording == F.col("gram")).otherwise(False)
    return met.withColumn("pos", pos).where(right).groupBy("doc_id", "row", "n_words", "template", "label", "base", "exact", "k", "words", "place", "pos").agg(F.count("*").alias("copies")).withColumn("diagonal", F.col("pos") - F.col("place"))


def spans(found: DataFrame, neighbours: int = NEIGHBOURS, covered: float = COVERED) -> DataFrame:
    """doc_id, row, n_words and verified spans: template, label, base, start and end (words, end exclusive) and share of the template covered; a row without template for each document, with the number of its copies."""
    key = ["doc_id", "row", "n_words", "template", "label", "base", "exact", "k", "words"]
    order = Window.partitionBy("doc_id", "row", "template").orderBy("diagonal", "pos")
    apart = F.col("diagonal") - F.lag("diagonal").over(order)
    new = F.when(F.col("exact"), apart > 0).otherwise(apart > neighbours)
    merged = found.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = merged.groupBy(*key, "span").agg(F.min("pos").alias("start"), (F.max("pos") + F.first("k")).alias("end"), F.countDistinct("place").alias("n"), F.max("copies").alias("copies"))
    share = F.least(F.lit(1.0), (F.col("n") + F.col("k") - 1) / F.col("words"))
    verified = F.when(F.col("exact"), F.col("n") + F.col("k") - 1 == F.col("words")).otherwise((share >= covered) & (F.col("end") - F.col("start") <= 2 * F.col("words")))
    return out.where((F.col("template") < 0) | verified).select("doc_id", "row", "n_words", F.when(F.col("template") >= 0, F.col("template")).alias("template"), "label", "base", "start", "end", F.when(F.col("template") >= 0, share).otherwise(0.0).alias("share"), "copies")


def scan(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base (all places of base phrases), first_word, last_word, base_labels, labels and score (the largest share of a template that is covered), a row for each row of docs.

    Null and empty texts have no words. Rows that repeat an id with another text are scanned one by one, those that repeat id and text once, and each gets its row. Other columns are ignored.
    """
    base = F.when(F.col("base"), F.col("start"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    table = templates(docs.sparkSession) if table is None else table
    return (
        spans(votes(docs, table))
        .groupBy("doc_id", "row", "n_words")
        .agg(F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"), joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("share").alias("score"), F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"))
        .withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .drop("row", "copies")
    )
