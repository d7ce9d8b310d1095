"""License scans by diagonal voting.

Templates are phrases and license texts as word lists. All rolling hashes of ``K`` words of every
text are joined by Spark to the templates' K-gram positions. A hit votes for its diagonal, the
text position minus the template position: an unbroken copy has all its votes on one diagonal, a
copy with words added or left out on neighbouring ones. Votes are aggregated by diagonal,
diagonals at most ``GAP`` apart are merged, and the span they cover is verified word by word. A
phrase counts where its words stand consecutively; a license text is found where the merged
diagonals cover ``COVER`` of its K-grams and the span holds that share of its words; one of
``WHOLE`` words or fewer must be there whole.

Everything is DataFrame and SQL functions. The templates are a fixed list, so their side of the
join is a bounded broadcast; hashes that are in no template leave before rows are made of them,
which is that join's own condition. Votes are counted by (row, template, diagonal): the key holds
the row, so a passage in many texts makes no hot key.

Nulls and empty texts have no words and score 0; equal rows are found each for itself; ties of
spans do not matter to the result; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsmood.llm.words import pick, written

K = 3
GAP = 2
COVER = 0.8
WHOLE = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels of the contract.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# End of the fixed values.

#: Sentences by which licenses are granted, as their publishers word them.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
)


def words_of(text: Column) -> Column:
    """Words of a text in lower case. Letters beyond ASCII are lower-cased, too: no template has
    any, and the word boundaries do not move."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _gram(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(K)])


def templates(spark: SparkSession, phrases=PHRASES, texts=TEXTS) -> DataFrame:
    """``template, label, base, goal`` (words), one row each."""
    rows = [(i, label, i < len(phrases), text.split()) for i, (label, text) in enumerate((*phrases, *texts))]
    if any(len(r[3]) < K for r in rows):
        raise ValueError(f"a template needs {K} words")
    return spark.createDataFrame(rows, "template int, label string, base boolean, goal array<string>")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases=PHRASES, texts=TEXTS, gap: int = GAP, cover: float = COVER, whole: int = WHOLE) -> DataFrame:
    """One row per document row: ``doc_id, n_words, spans`` (array of ``label, base, first, last,
    score``: word places of phrases and found license texts, ends included) and ``score``, the
    highest share of a template's K-grams on merged diagonals."""
    spark = docs.sparkSession
    known = templates(spark, phrases, texts)
    at = F.explode(F.sequence(F.lit(0), F.size("goal") - K))
    places = known.select("template", at.alias("place"), "goal").select("template", "place", _gram(F.col("goal"), F.col("place")).alias("gram"))
    grams = sorted({r.gram for r in places.select("gram").collect()})  # of the fixed list

    rows = pick(docs, doc_id, text)
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), rows[doc_id].alias("doc_id"), words_of(rows[text]).alias("words"))
    starts = F.when(F.size("words") >= K, F.sequence(F.lit(0), F.size("words") - K)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("hits", F.filter(starts, lambda i: _gram(F.col("words"), i).isin(grams)))
    rows = rows.select(
        "_row",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.when(F.size("hits") > 0, F.col("words")).alias("words"),
        F.when(F.size("hits") > 0, F.transform("hits", lambda i: F.struct(i.alias("at"), _gram(F.col("words"), i).alias("gram")))).alias("hits"),
    )
    rows = written(rows, "licenses")  # fixes the row ids

    votes = (
        rows.where("hits IS NOT NULL")
        .select("_row", F.explode("hits").alias("h"))
        .select("_row", "h.at", "h.gram")
        .join(F.broadcast(places), "gram")
        .groupBy("_row", "template", (F.col("at") - F.col("place")).alias("diagonal"))
        .agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), (F.max("at") + K - 1).alias("last"))
    )
    by_diagonal = Window.partitionBy("_row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > gap).cast("int")
    runs = (
        votes.withColumn("run", F.coalesce(F.sum(apart).over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
        .groupBy("_row", "template", "run")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"),
            F.collect_list("diagonal").alias("diagonals"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
        )
        .join(F.broadcast(known), "template")
    )
    checked = runs.join(rows.where("hits IS NOT NULL").select("_row", "words"), "_row")
    exact = F.filter(
        "diagonals", lambda d: (d >= 0) & (F.slice(F.col("words"), F.greatest(d, F.lit(0)) + 1, F.size("goal")) == F.col("goal"))
    )
    share = F.col("votes") / (F.size("goal") - K + 1)
    span = F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + 1)
    held = F.size(F.array_intersect(span, F.col("goal"))) / F.size(F.array_distinct("goal"))
    found = F.struct(
        "label", F.lit(False).alias("base"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), share.alias("score")
    )
    phrase = F.transform(
        exact,
        lambda d: F.struct(
            F.col("label"), F.lit(True).alias("base"), d.cast("long").alias("first"), (d + F.size("goal") - 1).cast("long").alias("last"), F.lit(1.0).alias("score")
        ),
    )
    enough = F.when(F.size("goal") <= whole, 1.0).otherwise(cover)
    text_spans = F.when((share >= enough) & (held >= enough), F.array(found)).otherwise(F.array().cast(_SPANS))
    found_in = checked.select("_row", F.when(F.col("base"), phrase).otherwise(text_spans).alias("spans"), F.when(F.col("base"), F.when(F.size(exact) > 0, 1.0).otherwise(0.0)).otherwise(share).alias("share"))
    found_in = found_in.groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.max("share").alias("score"))
    return rows.join(found_in, "_row", "left").select(
        F.col("doc_id").alias(doc_id), "n_words", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


_SPANS = "array<struct<label:string,base:boolean,first:long,last:long,score:double>>"
