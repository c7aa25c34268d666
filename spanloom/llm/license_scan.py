"""License scans by diagonal voting.

All rolling three-word grams of a document meet the grams of license templates in a join. A match
at document place p and template place t votes for the diagonal p - t; a copied passage lines its
votes up on one diagonal, and small insertions or deletions move them to a neighbouring one, so
diagonals close together merge. The words around the strongest diagonal of a merged one are then
aligned with the template's: that gives the span in the document, from its first to its last word, and
verifies how much of the span and of the template agree. Of spans over the same words the best aligned wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import UPPER, WORD, join_same, materialize, shingle_hashes, text_key, words

# Phrases of the base labels, and notices and passages of public licenses. A notice names its
# license in few words, each of which tells, so it is found whole or not at all; of a passage some words may differ.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
NOTICES = [
    ("afl-3.0", "Licensed under the Academic Free License version 3.0"),
    ("agpl-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("artistic-2.0", "the terms of the Artistic License 2.0"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-3.0", "Licensed under CC BY 3.0"),
    ("cc-by-sa-3.0", "Licensed under CC BY-SA 3.0"),
    ("cc0-1.0", "Released under CC0 1.0"),
    ("cddl-1.0", "the terms of the Common Development and Distribution License, Version 1.0"),
    ("ecl-2.0", "Licensed under the Educational Community License, Version 2.0"),
    ("epl-1.0", "the terms of the Eclipse Public License v1.0"),
    ("epl-2.0", "the terms of the Eclipse Public License 2.0"),
    ("eupl-1.2", "Licensed under the EUPL, Version 1.2"),
    ("gfdl-1.3", "under the terms of the GNU Free Documentation License, Version 1.3"),
    ("gpl-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl-2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1"),
    ("lgpl-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3"),
    ("mit", "Released under the MIT License"),
    ("mpl-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ms-pl", "Licensed under the Microsoft Public License"),
    ("ms-rl", "Licensed under the Microsoft Reciprocal License"),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("osl-3.0", "Licensed under the Open Software License version 3.0"),
    ("postgresql", "Released under the PostgreSQL License"),
    ("php-3.01", "This source file is subject to version 3.01 of the PHP license"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("wtfpl-2.0", "under the terms of the Do What The Fuck You Want To Public License, Version 2"),
    ("zpl-2.1", "This software is subject to the provisions of the Zope Public License, Version 2.1"),
]
PASSAGES = [
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("ncsa", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
]
# What is asked of a template's words: its share with the span.
WHOLE, MOST = 1.0, 0.8
TEMPLATES = [(label, text, WHOLE) for label, text in NOTICES] + [(label, text, MOST) for label, text in PASSAGES]
K = 3
WORDS = re.compile(WORD)
LOWER = str.maketrans(UPPER, UPPER.lower())
HERE = -6148914691236517206


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``(h, tid, t, gram, len)`` for each place of each template; the list is part of the program, so
    its size is known where it is broadcast."""
    rows = [(i, text) for i, (_, text, _) in enumerate(templates)]
    w = spark.createDataFrame(rows, "tid int, text string").select("tid", words(F.col("text")).alias("w"))
    at = w.where(F.size("w") >= K).select("tid", "w", F.posexplode_outer(shingle_hashes("w", K)).alias("t", "h"))
    return at.select("h", "tid", "t", F.slice("w", F.col("t") + 1, K).alias("gram"), F.size("w").alias("len"))


def _places(w: str, p: list[str], label: str) -> Column:
    def here(i: Column) -> Column:
        return reduce(lambda x, j: x & F.coalesce(F.get(w, i + j) == p[j], F.lit(False)), range(len(p)), F.lit(True))

    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - len(p), F.lit(0)))
    return F.transform(F.filter(starts, here), lambda i: F.struct(F.lit(label).alias("label"), i.alias("at")))


def _base_places(w: str, phrases) -> Column:
    """Array of (label, start) for each place where a phrase's words stand consecutively."""
    return F.concat(*[_places(w, phrase.split(), label) for phrase, label in phrases])


def _votes(docs: DataFrame, templates, phrases, pad: int) -> DataFrame:
    """One row per document, template and diagonal with votes: ``ts`` (template places), ``n`` votes, ``ctx``
    (the words the diagonal puts the template on and ``pad`` more at each end) and ``ctx_at``, where those
    begin. Under template -1 each document's own row has ``n_words``, ``base`` and the number of copies ``n``."""
    last = sorted({p.split()[-1] for p, _ in phrases})
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    maybe = F.lower("text").rlike("|".join(last))
    d = d.select("doc_id", text_key(F.col("text")).alias("tk"), maybe.alias("maybe"), words(F.col("text")).alias("w"))
    none = F.array().cast("array<struct<label:string,at:int>>")
    d = d.select("doc_id", "tk", "w", F.when(F.col("maybe"), _base_places("w", phrases)).otherwise(none).alias("base"))
    # Place -1 stands for the document. Hashes are made of the exploded places, which stays in generated code.
    at = d.select("doc_id", "tk", "w", "base", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("w") - K, F.lit(-1)))).alias("p"))
    is_here = F.col("p") < 0
    gram = F.xxhash64(*[F.get("w", F.col("p") + j) for j in range(K)])
    at = at.withColumn("h", F.when(is_here, F.lit(HERE)).otherwise(gram))
    grams = template_grams(docs.sparkSession, templates)
    here = docs.sparkSession.range(1).select(
        F.lit(HERE).alias("h"), F.lit(-1).alias("tid"), F.lit(0).alias("t"), F.array().cast("array<string>").alias("gram"), F.lit(0).alias("len")
    )
    hits = at.join(F.broadcast(grams.union(here)), "h").where(is_here | (F.slice("w", F.col("p") + 1, K) == F.col("gram")))
    diag = F.when(is_here, F.lit(0)).otherwise(F.col("p") - F.col("t"))
    begin = F.greatest(diag - pad, F.lit(0))
    hits = hits.select(
        "doc_id", "tk", "tid", diag.alias("diag"), "t", F.when(~is_here, begin).alias("ctx_at"),
        F.when(~is_here, F.slice("w", begin + 1, diag + F.col("len") + pad - begin)).alias("ctx"),
        F.when(is_here, F.size("w")).alias("n_words"), F.when(is_here, F.col("base")).alias("base"),
    )
    # A diagonal has one context, whichever of its votes brings it.
    return hits.groupBy("doc_id", "tk", "tid", "diag").agg(
        F.collect_set("t").alias("ts"), F.first("ctx").alias("ctx"), F.first("ctx_at").alias("ctx_at"),
        F.first("n_words").alias("n_words"), F.first("base").alias("base"), F.count("*").alias("n"),
    )


def align(ctx: list[str], template: list[str]) -> tuple[float, int, int]:
    """How much of a span and of the template agree (twice the words they share in order, by the words of
    both), and the span: first and last word plus one in ``ctx``."""
    blocks = [b for b in SequenceMatcher(None, ctx, template, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return 0.0, 0, 0
    first, end = blocks[0].a, blocks[-1].a + blocks[-1].size
    return 2 * sum(b.size for b in blocks) / (end - first + len(template)), first, end


def _verified(templates) -> Column:
    """Struct (share, first, last) of a row's ``ctx`` aligned with its template ``tid``; null if ``try`` is false."""
    texts = [WORDS.findall(text.translate(LOWER)) for _, text, _ in templates]

    @F.pandas_udf("share double, first int, last int")
    def of(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ctx, tid, wanted in rows:
            out = [align(list(c), texts[t]) if ok else (None, None, None) for c, t, ok in zip(ctx, tid, wanted)]
            out = pd.DataFrame(out, columns=["share", "first", "last"])
            yield out.astype({"share": "float64", "first": "Int32", "last": "Int32"})

    return of("ctx", "tid", "try")


def license_spans(
    docs: DataFrame, templates=TEMPLATES, phrases=BASE, least_votes: float = 0.4, gap: int = 2, pad: int = 8
) -> DataFrame:
    """``doc_id, tk, tid, label, votes`` (share of the template's grams on the merged diagonal), ``share``,
    ``first_word`` and ``last_word`` of each merged diagonal. Diagonals with votes of less than ``least_votes``
    are not aligned and have no share. ``asked`` is the share that the template asks for. Each document's own row, under ``tid`` -1, has ``n_words, base`` and
    ``copies``."""
    spark = docs.sparkSession
    votes = _votes(docs, templates, phrases, pad)
    by_diag = Window.partitionBy("doc_id", "tk", "tid").orderBy("diag")
    votes = votes.withColumn("new", F.coalesce((F.col("diag") - F.lag("diag").over(by_diag) > gap).cast("int"), F.lit(0)))
    votes = votes.withColumn("run", F.sum("new").over(by_diag))
    merged = votes.groupBy("doc_id", "tk", "tid", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("covered"),
        F.max_by(F.struct("ctx", "ctx_at"), F.struct(F.size("ts"), -F.col("diag"))).alias("best"),
        F.first("n_words", ignorenulls=True).alias("n_words"),
        F.first("base", ignorenulls=True).alias("base"),
        F.sum("n").alias("copies"),
    )
    sizes = template_grams(spark, templates).groupBy("tid").agg(F.countDistinct("t").alias("grams"))
    names = spark.createDataFrame([(i, x, y) for i, (x, _, y) in enumerate(templates)], "tid int, label string, asked double")
    # Both lists are part of the program.
    merged = merged.join(F.broadcast(sizes.join(names, "tid")), "tid", "left").withColumn("votes", F.col("covered") / F.col("grams"))
    merged = merged.select("*", "best.ctx", "best.ctx_at", F.coalesce(F.col("votes") >= least_votes, F.lit(False)).alias("try"))
    merged = merged.withColumn("x", _verified(templates))
    return merged.select(
        "doc_id", "tk", "tid", "label", "asked", "grams", "votes", F.col("x.share").alias("share"), (F.col("ctx_at") + F.col("x.first")).alias("first_word"),
        (F.col("ctx_at") + F.col("x.last") - 1).alias("last_word"), "n_words", "base", "copies",
    )


def winning(spans: DataFrame) -> DataFrame:
    """``doc_id, tk, label`` of the spans that have the share their template asks for and no better one over any
    of their words: better is the greater share, then the longer template, then the first in the list. So a license
    whose notice has another's words in it is one license."""
    good = spans.where((F.col("tid") >= 0) & (F.col("share") >= F.col("asked")))
    rank = F.struct("share", "grams", (-F.col("tid")).alias("first"), "first_word")
    of_word = good.select("doc_id", "tk", "label", rank.alias("rank"), F.explode(F.sequence("first_word", "last_word")).alias("word"))
    # No more spans are over one word than there are templates, a few places each.
    best = F.max("rank").over(Window.partitionBy("doc_id", "tk", "word"))
    of_word = of_word.withColumn("best", F.col("rank") == best)
    return of_word.groupBy("doc_id", "tk", "label", "rank").agg(F.bool_and("best").alias("wins")).where("wins").select("doc_id", "tk", "label")


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=BASE, **how) -> DataFrame:
    """Per document: ``doc_id, n_words, n_base`` (places of base phrases), ``first_word`` and
    ``last_word`` (their smallest and largest start, else null), ``base_labels``, ``labels`` (base
    ones and those of ``winning`` spans), and ``score``: 1 with a base phrase, else the best share of a span, or of
    votes where too few were cast to verify one.

    Null has no words, and texts of fewer than three words no grams, but base phrases are found in
    any. Rows of one doc_id with different texts are judged apart, identical rows all come back.
    Templates of fewer than three words are ignored. Other columns are ignored.
    """
    spans = materialize(license_spans(docs, templates, phrases, **how), "op9-spans")
    own = F.col("tid") == -1
    out = spans.groupBy("doc_id", "tk").agg(
        F.max(F.when(own, F.col("n_words"))).cast("long").alias("n_words"),
        F.first(F.when(own, F.col("base")), ignorenulls=True).alias("base"),
        F.max(F.when(own, F.col("copies"))).alias("copies"),
        F.coalesce(F.max(F.when(~own, F.coalesce("share", "votes"))), F.lit(0.0)).alias("best"),
    )
    won = winning(spans).groupBy("doc_id", "tk").agg(F.collect_set("label").alias("more"))
    out = join_same(out, won, ["doc_id", "tk"]).withColumn("more", F.coalesce("more", F.array().cast("array<string>")))
    labels = F.array_distinct(F.col("base.label"))
    starts = F.col("base.at")
    n_base = F.size("base").cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, "more")), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.col("best")).alias("score"),
        F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)).cast("int"))).alias("copy"),
    ).drop("copy")
