"""License scans by diagonal voting.

All rolling word 2-grams of a text are hashed and joined to the positions of 2-grams in templates;
hits whose words differ are dropped.  A hit votes for the diagonal place - template position.  A
phrase stands wherever its diagonal has every vote.  For longer notices, diagonals up to MERGE apart
(words put in or left out) are merged, and the span is verified: a notice counts if enough of its
2-grams, each compared word by word and counted once, stand within a span not much longer than it.

DataFrame functions only.  Templates are a parameter of bounded size and are broadcast.  Every row
adds one marker to its 2-grams, so rows without hits survive the inner join and carry n_words; row
numbers keep repeated ids apart.  Null and empty texts have no words.  Extra columns are ignored.
Whole texts are scanned, however long.  An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, text_rows

_DELIMITER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: The customary notices of well-known licences.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License"),
    ("artistic", "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License"),
    ("wtfpl", "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
]

#: Diagonals merged to either side, the share of votes a notice needs, and how much longer its span may be.
MERGE, SHARE, STRETCH = 3, 0.6, 1.5
#: Overlapping notices whose scores differ by no more all stay.
CLOSE = 0.02


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_DELIMITER, text.lower()) if w]


def template_grams(spark: SparkSession, phrases: dict[str, str], notices: list[tuple[str, str]]) -> tuple[DataFrame, list[tuple[str, bool, int]]]:
    """(hash, first, second, template, at) of every template 2-gram; per template: label, is a phrase, 2-grams."""
    about, rows = [], []
    for label, text, phrase in [*((v, k, True) for k, v in phrases.items()), *((a, b, False) for a, b in notices)]:
        words = template_words(text)
        rows += [(a, b, len(about), i) for i, (a, b) in enumerate(zip(words, words[1:]))]
        about.append((label, phrase, len(words) - 1))
    grams = spark.createDataFrame(rows, "first string, second string, template int, at int")
    return grams.select(F.xxhash64("first", "second").alias("hash"), "*"), about


def _words(text: Column) -> Column:
    # the Kelvin sign is the one other character whose lower case is an ASCII letter
    lower = F.lower(F.replace(text, F.lit("K"), F.lit("°")))
    return F.filter(F.split(lower, _DELIMITER, -1), lambda w: w != "")


def votes(docs: DataFrame, grams: DataFrame, n_phrases: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_words, template (null: the row's marker), diagonal, votes, the notice's places, first and last place."""
    rows = text_rows(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", _words(F.col("text")).alias("words"))
    n = F.greatest(F.size("words") - 1, F.lit(0))
    hashes = F.zip_with(F.slice("words", 1, n), F.slice("words", 2, n), lambda a, b: F.xxhash64(a, b))
    # the marker's place is behind every 2-gram; its hash is null and meets the marker's template by coalesce
    marker = F.lit(-1).cast("long")
    # hashed in a step of its own: only then is the explosion compiled together with the join, and words aren't
    # copied (outer: the array is never empty, and no filter is inferred that would hash twice)
    exploded = rows.select("row", "doc_id", "words", F.concat(hashes, F.array(marker)).alias("hashes")).select("row", "doc_id", "words", F.posexplode_outer("hashes").alias("place", "hash"))
    is_marker = F.col("place") == F.greatest(F.size("words") - 1, F.lit(0))
    lookup = grams.select(F.col("hash").alias("t_hash"), "first", "second", "template", "at").unionByName(
        grams.sparkSession.range(1).select(marker.alias("t_hash"), F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("second"), F.lit(None).cast("int").alias("template"), F.lit(0).alias("at"))
    )
    hits = exploded.join(F.broadcast(lookup), F.col("hash") == F.col("t_hash"))
    same = (F.get("words", F.col("place")) == F.col("first")) & (F.get("words", F.col("place") + 1) == F.col("second"))
    hits = hits.where(F.when(F.col("template").isNull(), is_marker).otherwise(~is_marker & same))
    hits = hits.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "template", (F.col("place") - F.col("at")).alias("diagonal"), "place")
    at = F.col("place") - F.col("diagonal")
    return hits.groupBy("row", "doc_id", "n_words", "template", "diagonal").agg(F.count("*").alias("votes"), F.collect_set(F.when(F.col("template") >= n_phrases, at)).alias("ats"), F.min("place").alias("low"), F.max("place").alias("high"))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: label, first and last word and score of every phrase and notice found, at most one per diagonal.
    """
    grams, about = template_grams(docs.sparkSession, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    found = votes(docs, grams, sum(phrase for _, phrase, _ in about), id_col, text_col)
    label, is_phrase, total = (F.element_at(F.array(*(F.lit(a[k]) for a in about)), F.col("template") + 1) for k in range(3))
    near = Window.partitionBy("row", "doc_id", "n_words", "template").orderBy("diagonal").rangeBetween(-MERGE, MERGE)
    merged = found.select(
        "row", "doc_id", "n_words", "template", "diagonal", "votes", "low", "high",
        F.size(F.array_distinct(F.flatten(F.collect_list("ats").over(near)))).alias("verified"), F.min("low").over(near).alias("all_low"), F.max("high").over(near).alias("all_high"),
    )
    known = F.col("template").isNotNull()
    share = F.when(F.coalesce(is_phrase, F.lit(False)), F.col("votes") / total).otherwise((F.col("verified") / total))
    fits = F.col("all_high") - F.col("all_low") + 1 <= STRETCH * total
    merged = merged.select("row", "doc_id", "n_words", "diagonal", "low", "high", label.alias("label"), is_phrase.alias("phrase"), F.when(known, share).otherwise(F.lit(0.0)).alias("share"), fits.alias("fits"))
    base = F.col("phrase") & (F.col("share") >= 1.0)
    notice = ~F.col("phrase") & (F.col("share") >= SHARE) & F.col("fits")
    at = F.when(base, F.col("diagonal").cast("long"))
    span = F.struct(F.col("diagonal").cast("long").alias("first"), (F.col("high") + 1).cast("long").alias("last"), "label", F.col("share").alias("score"))
    out = merged.groupBy("row", "doc_id", "n_words").agg(
        F.count(at).alias("n_base"),
        F.min(at).alias("first_word"),
        F.max(at).alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base"),
        F.collect_list(F.when(base, span)).alias("phrases"),
        F.collect_list(F.when(notice, span)).alias("notices"),
        F.max(F.when(F.col("phrase") & ~base, F.lit(0.0)).otherwise(F.when(F.col("phrase") | F.col("fits"), F.col("share")).otherwise(F.lit(0.0)))).alias("score"),
    )
    # notices of one family share most words: of those that overlap the best stays
    better = lambda s, t: (t["score"] > s["score"] + CLOSE) & (t["first"] < s["last"]) & (s["first"] < t["last"])
    out = out.withColumn("notices", F.filter("notices", lambda s: ~F.exists("notices", lambda t: better(s, t))))
    labels = F.array_sort(F.array_union("base", F.transform("notices", lambda s: s["label"])))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score", F.array_sort(F.concat("phrases", "notices")).alias("spans"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).drop("spans")
