"""License scan by diagonal voting, in DataFrame functions only.

Every rolling word k-gram hash of a text is joined to the places of the same k-gram in a small
table of templates. A match votes for a diagonal (place in the text minus place in the template).
Votes are counted by diagonal; neighbouring diagonals of a template are merged, so that a few
inserted or missing words do not split a match. A merged span is verified: of each place of the
template the vote nearest to the span's main diagonal counts, once, and only in the order of the
template and without large holes in the text; the share of the template's k-grams that is left must be high
enough. A phrase stands word for word where one diagonal has a vote from every k-gram.

Phrases are matched by pairs of words, templates by three, so that the commonest pairs of words of a
language vote for nothing.

Words: texts with A-Z lower-cased, runs of ASCII digits and letters and of all characters beyond ASCII.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldproof.sources.tables import stored

#: Words of a k-gram of phrases and of templates.
K_PHRASE, K_TEMPLATE = 2, 3
#: Rows of a template table that may be broadcast.
BROADCAST_ROWS = 200_000

# Base phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Passages of public license texts and of the notices that point to them.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache"),
    ("subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "apache"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("may be used to endorse or promote products derived from this software without specific prior written permission", "bsd"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("you should have received a copy of the gnu general public license along with this program if not see", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("you should have received a copy of the gnu lesser general public license along with this library if not see", "lgpl"),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("this work is licensed under the creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike license", "cc-by-sa"),
    ("this work is licensed under the creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "zlib"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
]

_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), _SEP), "")


def template_table(spark, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row for each k-gram place of each phrase (base) and template of at least k words."""
    rows = []
    for n, (text, label) in enumerate([*phrases, *templates]):
        w, k = text.split(), K_PHRASE if n < len(phrases) else K_TEMPLATE
        rows += [(n, label, n < len(phrases), len(w) - k + 1, i, w[i : i + k]) for i in range(len(w) - k + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, size int, place int, t array<string>").withColumn("h", F.xxhash64("t"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None, gap: int = 3, least: float = 0.6) -> DataFrame:
    """Licenses of every whole text: one row for each input row.

    Rows: id_col, n_words, n_base (places where a base phrase stands word for word), first_word and
    last_word (smallest and largest start of those), base_labels, labels (base ones and those of
    templates of which merged diagonals, at most ``gap`` words apart, hold at least ``least`` of the
    k-grams, each once and in order), score (largest such share; 1 with a base phrase), spans (label, first and last
    word, share of each verified template span, by place). Labels are distinct, sorted, comma-joined.

    ``templates`` is a table as ``template_table`` makes it (size: k-grams of the template, t: its words); one with over
    BROADCAST_ROWS rows is joined by a shuffle. Null or empty texts: 0 words, no places (null), empty labels, score 0. Repeated
    rows are scanned one by one: rows are told apart by a row number, never joined by id. Other columns are ignored.
    An empty table gives no rows.
    """
    table = template_table(docs.sparkSession) if templates is None else templates
    few = templates is None or table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), _words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("w"))
    n = F.size("w")
    # one row for each word that begins a k-gram, with the words of the longest one
    tail = [F.slice("w", i + 1, F.greatest(n - i, F.lit(0))).alias(f"w{i}") for i in range(K_TEMPLATE)]
    starts = words.select("row", "id", n.cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip(*tail)).alias("pos", "g"))
    grams = starts.select("row", "id", "n_words", "pos", F.explode(F.array(*(F.array(*(F.col(f"g.w{i}") for i in range(k))) for k in (K_PHRASE, K_TEMPLATE)))).alias("w"))
    grams = grams.withColumn("h", F.xxhash64("w"))
    votes = grams.join(table.hint("broadcast" if few else "shuffle_hash"), "h", "left").where("template is not null or ((pos is null or pos = 0) and size(w) = 2)")
    real = F.col("template").isNotNull() & (F.col("w") == F.col("t"))
    votes = votes.select("row", "id", "n_words", *(F.when(real, F.col(c)).alias(c) for c in ("template", "label", "base", "size", "place", "pos")), F.when(real, F.col("pos") - F.col("place")).alias("diagonal"))
    by = ["row", "id", "n_words", "template", "label", "base", "size"]
    # written once: phrases and templates go on from here in different ways
    diagonals = stored(votes.groupBy(*by, "diagonal").agg(F.count("pos").alias("votes"), F.min("pos").alias("lo"), F.collect_list(F.struct("place", "pos")).alias("at")))
    # neighbouring diagonals of one template in one text; base phrases stay on one diagonal
    ordered = Window.partitionBy("row", "template").orderBy("diagonal", "lo")
    near = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(ordered) <= gap) & (F.col("lo") - F.lag("lo").over(ordered) <= F.col("size") + gap), F.lit(False)) & ~F.col("base")
    merged = diagonals.withColumn("group", F.sum((~near).cast("int")).over(ordered))
    # the main diagonal of a group has most votes; of each place the vote nearest to it is taken
    group = Window.partitionBy("row", "template", "group")
    main = F.max(F.struct("votes", -F.col("diagonal"))).over(group)
    aimed = merged.withColumn("main", -main["col2"])
    off = F.abs(F.col("v.pos") - F.col("v.place") - F.col("main"))
    # a phrase has a row for each diagonal, a template for each place
    base = aimed.where("base is null or base").select(*by, "diagonal", "votes", F.lit(None).cast("array<struct<place:int,pos:int>>").alias("chain"))
    places = aimed.where("not base").select(*by, "group", "main", F.explode("at").alias("v")).groupBy(*by, "group", "v.place").agg(F.min_by("v.pos", F.struct(off, "v.pos")).alias("pos"))
    chains = places.groupBy(*by, "group").agg(F.array_sort(F.collect_list(F.struct("place", "pos"))).alias("chain")).select(*by, F.lit(None).cast("int").alias("diagonal"), F.lit(None).cast("long").alias("votes"), "chain")
    # in the order of the template, and no further apart than there, but for ``gap`` words
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))

    def step(acc: Column, x: Column) -> Column:
        follows = (x["pos"] > acc["hi"]) & (x["pos"] - acc["hi"] <= x["place"] - acc["place"] + gap)
        took = lambda n, lo: F.struct(n.alias("n"), x["place"].alias("place"), lo.alias("lo"), x["pos"].alias("hi"))
        return F.when(acc["n"] == 0, took(F.lit(1), x["pos"])).when(follows, took(acc["n"] + 1, acc["lo"])).otherwise(acc)

    spans = base.unionByName(chains).withColumn("c", F.aggregate("chain", start, step))
    share = F.col("c.n") / F.col("size")
    is_base = F.coalesce(F.col("base") & (F.col("votes") == F.col("size")), F.lit(False))
    verified = F.col("c").isNotNull() & (share >= least)
    label_list = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy("row", "id", "n_words").agg(
        F.coalesce(F.sum(is_base.cast("long")), F.lit(0)).alias("n_base"),
        F.min(F.when(is_base, F.col("diagonal").cast("long"))).alias("first_word"),
        F.max(F.when(is_base, F.col("diagonal").cast("long"))).alias("last_word"),
        label_list(F.when(is_base, F.col("label"))).alias("base_labels"),
        label_list(F.when(is_base | verified, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(is_base, F.lit(1.0)).when(verified, share)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(verified, F.struct(F.col("c.lo").alias("first"), (F.col("c.hi") + F.lit(K_TEMPLATE - 1)).alias("last"), "label", F.round(share, 6).alias("share"))))).alias("spans"),
    )
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
