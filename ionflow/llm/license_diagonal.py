"""License scan by diagonal voting, in DataFrame functions only.

All rolling word 3-grams of every text are hashed and joined to the places
where the templates have them; equal words give a hit with an offset diagonal,
document place minus template place. Hits are counted by diagonal. A base
phrase stands where one diagonal has all its grams. Notices, which may have
words added, dropped or changed, merge neighbouring diagonals; a merged span
is verified by the share of the notice's words that it covers.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case;
null counts as empty. Rows that repeat a doc_id are rows of their own (equal
rows have equal results); other columns are ignored; an empty table gives no
rows. Joins are on the words themselves after the hash, so collisions do not
count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

GRAM = 3
#: Offsets of merged diagonals differ by at most this from one to the next.
DRIFT = 3
#: Share of a notice's words that a span must cover.
COVER = 0.75
# Base phrases and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Well-known license notices, as words.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
)
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same words before A-Z are put in lower case.
_RAW_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Each gram of each template: bounded by the lists above."""
    rows = []
    for tid, (label, text) in enumerate([*phrases, *notices]):
        w = text.split()
        for k in range(len(w) - GRAM + 1):
            rows.append(f"({tid}, '{label}', {str(tid < len(phrases)).lower()}, {len(w)}, {k}, '{w[k]}', '{w[k + 1]}', '{w[k + 2]}')")
    out = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(template, label, base, n_template, place, t0, t1, t2)")
    return out.withColumn("h", F.xxhash64("t0", "t1", "t2"))


def scan(spark: SparkSession, docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> tuple[DataFrame, DataFrame]:
    """One row per document, and the verified spans (doc_id, tag, label, base, first, last, cover)."""
    raw = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = raw.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    # lower() is far cheaper than translate(). Beyond A-Z it changes words that no template has, but
    # for the Kelvin sign, which it would make a k, and no word's bounds.
    text = F.lower(F.replace("text", F.lit("\u212a"), F.lit("\u00c0")))
    words = docs.select("doc_id", "tag", F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("w"))
    zipped = F.arrays_zip(F.col("w").alias("w0"), F.expr("slice(w, 2, size(w))").alias("w1"), F.expr("slice(w, 3, size(w))").alias("w2"))
    grams = words.select("doc_id", "tag", F.posexplode(zipped).alias("pos", "g")).select("doc_id", "tag", "pos", F.col("g.w0").alias("w0"), F.col("g.w1").alias("w1"), F.col("g.w2").alias("w2"))
    tpl = F.broadcast(templates(spark, phrases, notices))
    same = (F.xxhash64("w0", "w1", "w2") == F.col("h")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))
    hits = grams.join(tpl, same).select("doc_id", "tag", "template", "label", "base", "n_template", "place", (F.col("pos") - F.col("place")).alias("diagonal"))
    by = ["doc_id", "tag", "template", "label", "base", "n_template"]
    votes = hits.groupBy(*by, "diagonal").agg(F.collect_set("place").alias("places"))
    line = W.partitionBy("doc_id", "tag", "template").orderBy("diagonal")
    far = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > DRIFT, F.lit(True))
    votes = votes.withColumn("span", F.sum(far.cast("int")).over(line))
    spans = votes.groupBy(*by, "span").agg(F.min("diagonal").alias("diagonal"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (GRAM - 1))))))
    spans = spans.withColumn("cover", covered / F.col("n_template"))
    spans = spans.withColumn("found", F.when(F.col("base"), F.size("places") == F.col("n_template") - (GRAM - 1)).otherwise(F.col("cover") >= COVER))
    place = F.when(F.col("base") & F.col("found"), F.col("diagonal"))
    per = spans.groupBy("doc_id", "tag").agg(
        F.count(place).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base") & F.col("found"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("found"), F.col("label")))), ",").alias("labels"),
        F.max(F.when(~F.col("base") | F.col("found"), F.col("cover"))).alias("score"),
    )
    light = docs.select("doc_id", "tag", F.regexp_count("text", F.lit(_RAW_WORD)).cast("long").alias("n_words")).alias("d")
    per = per.alias("p")
    out = light.join(per, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.tag") == F.col("p.tag")), "left").select(
        "d.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    found = spans.where("found").select("doc_id", "tag", "label", "base", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("n_template") - 1).alias("last"), "cover")
    return out, found
