"""License scans by diagonal voting, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import row_key

#: Fixed values of the contract: what stands between words, and the base phrases with their labels.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Openings of public license texts, as (label, text), for the labels that the method adds.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike international license"),
)
K = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS), lambda w: w != "")


def gram_hash(grams: list[Column]) -> Column:
    return F.xxhash64(*grams)


def template_grams(docs: DataFrame, phrases=BASE_PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """A row for each word k-gram of each template: a constant of the library, a few hundred rows, so it can be broadcast."""
    rows = []
    for number, (text, label, base) in enumerate([*((t, name, True) for t, name in phrases), *((t, name, False) for name, t in notices)]):
        w = text.split()
        if len(w) < k:
            raise ValueError(f"a template needs {k} words: {text}")
        rows += [(number, label, base, i, len(w) - k + 1, w[i : i + k]) for i in range(len(w) - k + 1)]
    table = docs.sparkSession.createDataFrame(rows, "_template int, _label string, _base boolean, _place int, _grams int, _gram array<string>")
    return table.withColumn("_hash", gram_hash([F.col("_gram")[i] for i in range(k)]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=BASE_PHRASES, notices=NOTICES, k: int = K, coverage: float = 0.5, drift: int = 3) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row.

    Every rolling k-gram of words is hashed and joined to the places of the templates' k-grams. A match votes for the
    diagonal (place in the text less place in the template). Diagonals at most `drift` apart are merged, as an inserted or a
    missing word shifts the rest. Each match compares the words themselves, so hashes decide nothing. A base phrase stands
    where one diagonal has all its k-grams; a notice is found where merged diagonals hold at least `coverage` of its k-grams.
    score is 1 with a base phrase, else the largest share of any notice, 0 if none.

    Null and empty texts have no words. Rows that repeat both id and text are scanned as one and counted. Extra columns are ignored. The only
    shuffles carry one light row per document and the few matches; templates are constants, so their broadcast doesn't grow.
    """
    templates = template_grams(docs, phrases, notices, k)
    w = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_key"), words(F.col(text_col)).alias("_words")).withColumn("_n", F.size("_words").cast("long"))
    n = F.size("_words")
    # The first element stands for the document itself, so that one without any match keeps its row.
    # A row has its own k words only, so a long text costs no more for each of its words than a short one.
    kind = "struct<h:bigint,w:array<string>>"
    gram = lambda i: F.struct(gram_hash([F.element_at("_words", (i + j).cast("int")) for j in range(k)]).alias("h"), F.slice("_words", i, k).alias("w"))
    rolled = F.concat(F.array(F.lit(None).cast(kind)), F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), gram)).otherwise(F.array().cast(f"array<{kind}>")))
    grams = w.select("_id", "_key", "_n", F.posexplode(rolled).alias("_pos", "_g"))
    found = (
        grams.join(F.broadcast(templates), F.col("_g.h") == F.col("_hash"), "left")
        .filter((F.col("_pos") == 0) | (F.col("_g.w") == F.col("_gram")))
        .select("_id", "_key", "_n", (F.col("_pos") - 1).cast("long").alias("_pos"), "_template", "_label", "_base", "_place", "_grams")
    )
    diagonals = found.groupBy("_key", "_id", "_n", "_template", "_label", "_base", "_grams", (F.col("_pos") - F.col("_place")).alias("_diagonal")).agg(F.collect_set("_place").alias("_places"), F.count("*").alias("_rows"))
    # Merged within a document and template only; each diagonal's votes are the template's places that it matches.
    by = Window.partitionBy("_key", "_template").orderBy("_diagonal")
    merged = (
        diagonals.withColumn("_new", F.when(F.col("_diagonal") - F.lag("_diagonal").over(by) <= F.when(F.col("_base"), 0).otherwise(drift), 0).otherwise(1))
        .withColumn("_island", F.sum("_new").over(by))
        .groupBy("_key", "_id", "_n", "_template", "_label", "_base", "_grams", "_island")
        .agg(F.min("_diagonal").alias("_start"), F.max("_rows").alias("_rows"), F.size(F.array_distinct(F.flatten(F.collect_list("_places")))).alias("_votes"))
        .withColumn("_share", F.col("_votes") / F.col("_grams"))
    )
    base = F.col("_base") & (F.col("_votes") == F.col("_grams"))
    notice = ~F.col("_base") & (F.col("_share") >= coverage)
    names = lambda what: F.array_join(F.array_sort(F.collect_set(F.when(what, F.col("_label")))), ",")
    return (
        merged.groupBy("_key", "_id", F.col("_n").alias("n_words"))
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("_start"))).alias("first_word"),
            F.max(F.when(base, F.col("_start"))).alias("last_word"),
            names(base).alias("base_labels"),
            names(base | notice).alias("labels"),
            F.coalesce(F.max(F.when(base, F.lit(1.0)).when(~F.col("_base"), F.col("_share"))), F.lit(0.0)).alias("score"),
            # What stands for the document itself was counted once for each row that repeats.
            F.max(F.when(F.col("_template").isNull(), F.col("_rows"))).alias("_copies"),
        )
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
        .select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )
