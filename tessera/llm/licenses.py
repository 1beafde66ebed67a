"""License scans by diagonal voting, with DataFrame functions only.

Templates are short phrases and whole notices. All rolling word pairs of a document, hashed, meet
the hashed pairs of the templates in a broadcast join (the templates are constants of this module,
so the table has a fixed size); the words themselves are compared too, so a hash can't lie. Votes
are counted by diagonal, the document position less the template position. A phrase is found where
all its pairs vote for one diagonal. For a notice neighbouring diagonals are merged, which bridges
words that were put in or left out: the diagonals are cut into cells of ``DRIFT`` percent of the
template's words, and every two cells next to each other form a bundle. A bundle's width is bounded
however the votes lie, and votes that drift by less than a cell always share a bundle. A bundle whose
votes name enough different template positions is verified: the longest chain of votes that goes
forward in document and template alike must hold enough of the template's pairs. Repeated text thus
counts once, and text out of order doesn't count. Of overlapping spans of one notice the best stays.

Defined results: a null text has no words, hence 0 words, no place, empty labels and score 0. Rows
are told apart by their place in the scan, so repeated or null identifiers stay separate rows. Other
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and the labels they stand for.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# The standard wording of well-known notices.
NOTICES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
]

#: Percent of a notice's word pairs that must be there in order, and the width of a cell of diagonals in percent of its words.
COVER, DRIFT = 60, 25
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def template_rows(phrases=None, notices=None) -> list[tuple]:
    """Word pairs of the templates: t, label, phrase, pairs and need (of the template), cell, tpos, tw0, tw1."""
    rows, n = [], 0
    for phrase, source in ((True, [(x, y) for y, x in (PHRASES if phrases is None else phrases)]), (False, NOTICES if notices is None else notices)):
        for label, text in source:
            w = [x for x in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if x]
            pairs = len(w) - 1
            need, cell = (pairs, 1) if phrase else (-(-COVER * pairs // 100), max(1, DRIFT * len(w) // 100))
            rows += [(n, label, phrase, pairs, need, cell, i, w[i], w[i + 1]) for i in range(pairs)]
            n += 1
    return rows


def templates(spark, phrases=None, notices=None) -> DataFrame:
    kind = "t int, label string, phrase boolean, pairs int, need int, cell int, tpos int, tw0 string, tw1 string"
    return spark.createDataFrame(template_rows(phrases, notices), kind).withColumn("th", F.xxhash64("tw0", "tw1"))


#: Longest chain of votes forward in both texts, by the least template position that ends a chain of each length: n, start, stop.
#: Votes come by document position, those of one position from the last template position to the first.
CHAIN = """aggregate(
    votes,
    named_struct('ends', cast(array() as array<struct<tpos:int,start:int>>), 'n', 0, 'start', 0, 'stop', 0),
    (a, v) -> element_at(transform(array(size(filter(a.ends, e -> e.tpos < v.tpos))), k -> element_at(transform(array(if(k = 0, v.pos, a.ends[k - 1].start)), s -> named_struct(
        'ends', concat(slice(a.ends, 1, k), array(named_struct('tpos', v.tpos, 'start', s)), slice(a.ends, k + 2, size(a.ends))),
        'n', greatest(a.n, k + 1), 'start', if(k + 1 > a.n, s, a.start), 'stop', if(k + 1 > a.n, v.pos + 2, a.stop))), 1)), 1)
)"""

#: Spans by template and place; one that overlaps the span before it stays in its stead only where its chain is longer.
APART = """aggregate(
    found,
    cast(array() as array<struct<t:int,start:int,stop:int,n:int,label:string>>),
    (a, x) -> if(size(a) = 0 or element_at(a, -1).t <> x.t or element_at(a, -1).stop <= x.start, concat(a, array(x)),
        if(x.n > element_at(a, -1).n, concat(slice(a, 1, size(a) - 1), array(x)), a))
)"""


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", phrases=None, notices=None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    known = F.broadcast(templates(docs.sparkSession, phrases, notices))
    d = docs.select(docs[doc_id].alias("doc_id"), words(docs[text]).alias("w")).withColumn("row", F.monotonically_increasing_id())
    pairs = d.select("row", "doc_id", F.size("w").alias("n_words"), F.posexplode_outer(F.arrays_zip(F.col("w").alias("w0"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))").alias("w1"))).alias("pos", "pair"))
    pairs = pairs.select("row", "doc_id", "n_words", "pos", F.col("pair.w0").alias("w0"), F.col("pair.w1").alias("w1")).withColumn("h", F.xxhash64("w0", "w1"))
    # a document's first pair stays without a hit too, so that each document keeps a row
    votes = pairs.join(known, (F.col("h") == F.col("th")) & (F.col("w0") == F.col("tw0")) & (F.col("w1") == F.col("tw1")), "left").where(F.col("t").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    cell = F.floor((F.col("pos") - F.col("tpos")) / F.col("cell"))
    votes = votes.select("row", "doc_id", "n_words", "t", "label", "phrase", "pairs", "need", F.when(F.col("t").isNotNull(), F.struct("pos", "tpos")).alias("vote"), cell.alias("own")).repartition("row")
    # a phrase has one diagonal in a cell and stays by itself; the cells of a notice meet their neighbours
    bundled = votes.withColumn("bundle", F.explode(F.when(~F.coalesce("phrase", F.lit(True)), F.array(F.col("own") - 1, F.col("own"))).otherwise(F.array("own"))))
    whole = ["row", "doc_id", "n_words"]
    bundles = bundled.groupBy(*whole, "t", "label", "phrase", "pairs", "need", "bundle").agg(F.collect_list("vote").alias("votes"))
    enough = F.size(F.array_distinct(F.transform("votes", lambda v: v["tpos"]))) >= F.col("need")
    ordered = F.array_sort("votes", lambda x, y: F.when(x["pos"] != y["pos"], x["pos"] - y["pos"]).otherwise(y["tpos"] - x["tpos"]))
    chains = bundles.withColumn("votes", F.when(enough, ordered)).withColumn("c", F.expr(CHAIN))
    good = F.coalesce(F.col("c.n") >= F.col("need"), F.lit(False))
    span = F.struct("t", "c.start", "c.stop", "c.n", "label")
    base = good & F.col("phrase")
    out = chains.groupBy(*whole).agg(
        F.collect_list(F.when(base, span)).alias("base"),
        F.array_sort(F.collect_list(F.when(good & ~F.col("phrase"), span))).alias("found"),
        F.coalesce(F.max(F.when(good, F.col("c.n") / F.col("pairs"))), F.lit(0.0)).alias("score"),
    )
    out = out.withColumn("spans", F.concat("base", F.expr(APART))).withColumn("starts", F.transform("base", lambda x: x["start"]))

    def joined(spans: str) -> Column:
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))))

    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        joined("base").alias("base_labels"), joined("spans").alias("labels"), "score",
        F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["label"].alias("label")))).alias("spans"),
    )
