"""Licence scans by diagonal voting, with DataFrame functions alone.

Every text's rolling two-word hashes are joined to the positions of those word pairs in licence templates. A pair at
word p of a text and word t of a template votes for diagonal p - t. Votes are summed by diagonal; neighbouring
diagonals (words put in or left out) are merged into spans, of a bounded width; a span counts if enough of the template's
own pairs are really there, in their order. Work grows with a text's length alone, and templates may have any. Pairs are compared as words after the hash join, so no hash collision votes.

The base phrases are templates that need every pair on one diagonal: each such diagonal is one place.

Defined cases: a null text is empty; a text without words has n_words 0 and no label; equal rows are each returned;
null ids are ids; a very long text is exploded to rows of two words each; an empty table gives no row; other columns are
never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import folded, read

#: What parts words: ASCII other than digits and letters (letters are folded before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Usual licence notices with their labels.
NOTICES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights", "cc0-1.0"),
)
#: Diagonals at most so far apart are merged; share of a notice's pairs that a span must have.
NEAR, SHARE = 3, 0.8


def words(text: Column) -> Column:
    return F.array_remove(F.split(folded(text), BETWEEN), "")


def templates(spark: SparkSession) -> DataFrame:
    """hash, first, second, template, at, pairs, label, base: a row for each pair of each template, and one of nulls. A fixed small table."""
    rows = []
    for base, group in ((True, PHRASES), (False, NOTICES)):
        for phrase, label in group:
            own = phrase.split(" ")
            rows += [(own[t], own[t + 1], f"{label}: {phrase}", t, len(own) - 1, label, base) for t in range(len(own) - 1)]
    names, kinds = ("first", "second", "template", "at", "pairs", "label", "base"), ("string", "string", "string", "int", "int", "string", "boolean")
    values = [F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(r, names, kinds, strict=True)]) for r in [*rows, (None,) * len(names)]]
    found = spark.range(1).select(F.inline(F.array(*values)))
    return found.withColumn("_hash", F.when(F.col("first").isNotNull(), F.xxhash64("first", "second")))


def _votes(docs: DataFrame) -> DataFrame:
    """doc_id, text's hash and length, and a row for every pair of words that a template has, and one more for each text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text"), words(F.col("text")).alias("_words"))
    base = base.withColumn("n_words", F.size("_words"))
    pair = lambda a, b: F.struct(F.xxhash64(a, b).alias("hash"), a.alias("one"), b.alias("two"))
    pairs = F.when(F.col("n_words") > 1, F.zip_with(F.slice(F.col("_words"), 1, F.col("n_words") - 1), F.slice(F.col("_words"), 2, F.col("n_words")), pair))
    # The text's own row: nulls after its last pair. A row has its two words, never the whole text.
    none = F.lit(None).cast("struct<hash:bigint,one:string,two:string>")
    each = base.select("doc_id", "_text", "n_words", F.posexplode(F.concat(F.coalesce(pairs, F.array().cast("array<struct<hash:bigint,one:string,two:string>>")), F.array(none))).alias("pos", "_pair"))
    joined = each.join(F.broadcast(templates(docs.sparkSession)), F.col("_pair.hash").eqNullSafe(F.col("_hash")))
    right = F.col("first").isNull() | ((F.col("_pair.one") == F.col("first")) & (F.col("_pair.two") == F.col("second")))
    return joined.filter(right).select("doc_id", "_text", "n_words", "template", "label", "base", "pairs", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))


def in_order(hits: Column) -> Column:
    """How many of (at, pos), in order of ``at``, are one after the other in the text too: the pairs that a span verifies."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("at"), F.lit(-1).alias("pos"))
    go = lambda s, h: (h["at"] > s["at"]) & (h["pos"] > s["pos"])
    step = lambda s, h: F.when(go(s, h), F.struct((s["n"] + 1).alias("n"), h["at"].alias("at"), h["pos"].alias("pos"))).otherwise(s)
    return F.aggregate(F.array_sort(hits), start, step, lambda s: s["n"])


def spans(docs: DataFrame) -> DataFrame:
    """A row for each text (template null) and each verified span: doc_id, _text, n_words, copies, template, label, base,
    first (the word where the template would begin), share."""
    key = ["doc_id", "_text", "n_words"]
    # Equal rows vote together; how many they are is the count of the texts' own rows. A diagonal has each of a template's
    # places once.
    diagonals = _votes(docs).groupBy(*key, "template", "label", "base", "pairs", "diagonal").agg(F.count("*").alias("votes"), F.collect_set("at").alias("ats"))
    per = Window.partitionBy(*key, "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(per)
    # A base place stands alone; of a notice, near diagonals are one span, anew at least every template's length of them.
    opens = F.when(F.col("base") | F.col("base").isNull() | gap.isNull() | (gap > NEAR), 1).otherwise(0)
    merged = diagonals.withColumn("_opens", opens).withColumn("_chain", F.sum("_opens").over(per.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy(*key, "template", "_chain")
    merged = merged.withColumn("_span", F.floor((F.col("diagonal") - F.min("diagonal").over(chain)) / (2 * F.col("pairs"))))
    hits = F.transform("ats", lambda a: F.struct(a.alias("at"), (F.col("diagonal") + a).alias("pos")))
    found = merged.groupBy(*key, "template", "label", "base", "pairs", "_chain", "_span").agg(
        F.min("diagonal").alias("first"), F.flatten(F.collect_list(hits)).alias("_hits"), F.max("votes").alias("copies")
    )
    share = F.when(F.col("template").isNotNull(), in_order(F.col("_hits")) / F.col("pairs"))
    return found.withColumn("share", share).filter(F.col("template").isNull() | (F.col("share") >= F.when(F.col("base"), 1.0).otherwise(SHARE))).drop("_chain", "_span", "_hits")


def licences(docs: DataFrame) -> DataFrame:
    """The contract's row for every row of ``docs``."""
    base = F.col("base") & F.col("template").isNotNull()
    per_text = spans(docs).groupBy("doc_id", "_text", "n_words").agg(
        F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("_base"),
        F.collect_set("label").alias("_all"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    once = per_text.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return once.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(F.array_sort("_all"), ",").alias("labels"), "score",
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(read(spark, sf_dir, "documents"))

