"""License scans by diagonal voting.

All rolling word k-grams of every text are hashed and joined to the k-gram positions of license templates.
A match votes for its offset diagonal: document position less template position. Votes are counted for each
document, template and diagonal; neighbouring diagonals, which differ by inserted or dropped words,
are merged; a merged run is a span if its verified k-grams cover enough of the template.

Most k-grams match nothing, so the task that hashes them keeps only those whose hash occurs in a template (a
filter of a few hundred numbers) and hands them to the join with their words, which verify the match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.decontaminate import WORD_BYTES, words_of
from foliant.llm.jaccard_join import word_hashes

K = 3
#: Part of a template's words that a span must cover: of a notice, and of a template of LONG words or more.
MIN_COVER = 0.85
LONG_COVER = 0.7
LONG = 40
#: Diagonals at most so far apart are merged.
MAX_SHIFT = 4

#: Phrases that always count, with their labels.
BASE_PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: Notices of common licenses, with their labels.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("licensed under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution sharealike 4 0 international", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution 4 0 international", "cc-by"),
    # whole texts and headers
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal "
        "in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
        "of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
        "notice and this permission notice appear in all copies",
        "isc",
    ),
    (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary "
        "form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
        "provided with the distribution",
        "bsd",
    ),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or "
        "conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
        "software foundation either version 3 of the license or at your option any later version",
        "gpl-3",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
        "software foundation either version 2 of the license or at your option any later version",
        "gpl-2",
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the "
        "free software foundation",
        "lgpl",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("boost software license version 1 0", "bsl-1"),
    ("eclipse public license v 2 0", "epl-2"),
    ("creative commons attribution sharealike 3 0 unported license", "cc-by-sa"),
    ("creative commons attribution noncommercial sharealike 4 0 international", "cc-by-nc-sa"),
    ("creative commons attribution noderivatives 4 0 international", "cc-by-nd"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
]


def gram_hashes(text: bytes | None, k: int = K) -> np.ndarray:
    words = word_hashes(text, WORD_BYTES)
    last = len(words) - k + 1
    if last < 1:
        return np.empty(0, np.uint64)
    total = np.zeros(last, np.uint64)
    for i in range(k):
        total = (total ^ words[i : i + last]) * np.uint64(0x9FB21C651E98DF25)
        total ^= total >> np.uint64(29)
    return total


def template_grams(base: list = BASE_PHRASES, templates: list = TEMPLATES, k: int = K) -> list[tuple]:
    """(hash, gram, template, label, is_base, n_grams, n_words, place) of every k-gram of every template."""
    rows = []
    for number, (phrase, label) in enumerate([*base, *templates]):
        words = words_of(phrase.encode())
        if len(words) < k:
            raise ValueError(f"shorter than {k} words: {phrase}")
        for place, h in enumerate(gram_hashes(phrase.encode(), k)):
            gram = b" ".join(words[place : place + k]).decode()
            rows.append((int(h.view(np.int64)), gram, number, label, number < len(base), len(words) - k + 1, len(words), place))
    return rows


def _grams(known: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, places, hashes, grams = [], [], [], []
            for x in batch.column("bytes"):
                text = x.as_py()
                found = gram_hashes(text, k)
                at = np.flatnonzero(known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found)
                words = words_of(text) if len(at) or len(found) == 0 else None
                counts.append(len(words) if words is not None else len(found) + k - 1)
                places.append(at)
                hashes.append(found[at].view(np.int64))
                grams.append([b" ".join(words[i : i + k]).decode() for i in at])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(places, pa.list_(pa.int64())),
                    pa.array(hashes, pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.string())),
                ],
                ["row", "doc_id", "n_words", "at", "hash", "gram"],
            )

    return run


def scan(docs: DataFrame, base: list = BASE_PHRASES, templates: list = TEMPLATES, k: int = K, min_cover: float = MIN_COVER) -> DataFrame:
    """Spans: row, doc_id, n_words, template, label, is_base, start, cover; one row with nulls for a text without any.

    row tells rows apart that share a doc_id. Null and empty texts have no words and no spans.
    """
    spark = docs.sparkSession
    rows = template_grams(base, templates, k)
    known = np.unique(np.array([r[0] for r in rows], np.int64).view(np.uint64))
    table = spark.createDataFrame(rows, "hash long, gram string, template int, label string, is_base boolean, n_grams int, size int, place int")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("bytes"))
    grams = texts.mapInArrow(_grams(known, k), f"row long, doc_id {kind}, n_words long, at array<long>, hash array<long>, gram array<string>")
    votes = grams.select("row", "doc_id", "n_words", F.explode_outer(F.arrays_zip("at", "hash", "gram")).alias("g"))
    votes = votes.select("row", "doc_id", "n_words", "g.at", "g.hash", "g.gram").join(F.broadcast(table), ["hash", "gram"], "left")
    who = ["row", "doc_id", "n_words", "template", "label", "is_base", "n_grams", "size"]
    diagonals = votes.groupBy(*who, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.array_sort(F.collect_set("place")).alias("places"))
    shift = F.col("diagonal") - F.lag("diagonal").over(Window.partitionBy("row", "template").orderBy("diagonal"))
    # a base phrase stands word by word on one diagonal
    apart = F.when(F.col("is_base") | F.coalesce(shift > MAX_SHIFT, F.lit(True)), 1).otherwise(0)
    run = F.sum("apart").over(Window.partitionBy("row", "template").orderBy("diagonal").rowsBetween(Window.unboundedPreceding, 0))
    merged = diagonals.withColumn("apart", apart).withColumn("run", run)
    merged = merged.groupBy(*who, "run").agg(F.min("diagonal").alias("start"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (k - 1))))))
    found = merged.withColumn("cover", covered / F.col("size"))
    enough = F.when(F.col("is_base"), F.size("places") == F.col("n_grams")).otherwise(F.col("cover") >= F.when(F.col("size") >= LONG, F.least(F.lit(LONG_COVER), F.lit(min_cover))).otherwise(F.lit(min_cover)))
    hit = lambda c: F.when(enough, F.col(c)).alias(c)
    return found.select("row", "doc_id", "n_words", hit("template"), hit("label"), hit("is_base"), hit("start"), "cover")


def licenses(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base, first_word, last_word and base_labels tell of the base phrases; labels has those of the templates
    too; score is the largest part of a template that is covered. Without matches, as in null and empty texts: 0,
    nulls, empty strings, 0. Texts of any length are hashed whole. Repeated rows and rows without id each get a row;
    an empty table gives none; templates that are covered alike all count. Other columns are ignored.
    """
    base = F.coalesce("is_base", F.lit(False))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        scan(docs, **options).groupBy("row", "doc_id", "n_words")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            names(F.when(base, F.col("label"))).alias("base_labels"),
            names(F.col("label")).alias("labels"),
            F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        ).drop("row")
    )
