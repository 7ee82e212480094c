"""License scans by diagonal voting, with DataFrame operations only.

Every run of ``K`` consecutive words of a text is joined by hash to the places where
the same run stands in a template. Each match votes for its diagonal, text position
minus template position; neighbouring diagonals merge into one band, which tolerates
inserted or missing words. The words of each matching run are compared as well, so a
vote is never a hash collision. A band is verified by the different template places that
it holds, each counted once: at least ``MIN_SHARE`` of the template's runs, and among them
the run that names the licence, where the template has one. Such a band gives the
template's label. The template table is a constant of the library, so the join to it is
the only one that may broadcast by its nature.

Defined results: null and empty texts have no words and no labels; of repeated rows
each gets its own result; votes belong to a text and its id, so rows without an id and rows
that share one are judged each by its own text; an empty table gives an empty one; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stockline.llm.store import ascii_lower, text_or_empty

K = 3
BAND = 2          # diagonals at most this far apart are one band
MIN_SHARE = 0.5

# What tells rows apart: the id and 96 bits of hashes of the text.
ROW = ["doc_id", "text_hash", "text_hash_2"]

NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases of the base scan.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices as the licences ask for them, and common one-line forms; with the run that tells
# a licence from others of like wording, or none.
TEMPLATES = [
    ("mit", "Released under the MIT License", "the mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", None),
    ("apache", "Licensed under the Apache License, Version 2.0", "the apache license"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", None),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "general public license"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "general public license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", None),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", "mozilla public license"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "by nc 4"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "attribution noncommercial 4"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "attribution 4 0"),
]


def words(column: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(column), NON_WORD), "")


def _grams(array: str) -> Column:
    """``array<struct<pos, gram>>`` of all runs of K words."""
    w = F.col(array)

    def one(i: Column) -> Column:
        return F.struct(i.alias("pos"), F.concat_ws(" ", *(F.get(w, i + j) for j in range(K))).alias("gram"))

    return F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(0), F.size(w) - K), one))


def template_runs(spark: SparkSession) -> DataFrame:
    """``label, template, n_runs, core, t_pos, gram`` of all templates; fewer than 64 runs each."""
    rows = spark.createDataFrame([(i, *row) for i, row in enumerate(TEMPLATES)], "template int, label string, text string, core string")
    rows = rows.withColumn("w", words(F.col("text"))).withColumn("runs", _grams("w"))
    return rows.select("template", "label", F.size("runs").alias("n_runs"), "core", F.inline("runs").alias("t_pos", "gram"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), F.hash(text_or_empty()).alias("text_hash_2"), words(text_or_empty()).alias("w"))


def votes(docs: DataFrame) -> DataFrame:
    """Merged bands that name their licence: ``ROW, label, template, share, first_word, last_word``."""
    runs = _rows(docs).select(*ROW, F.inline(_grams("w")).alias("pos", "gram"))
    templates = template_runs(docs.sparkSession).withColumn("h", F.xxhash64("gram")).withColumnRenamed("gram", "t_gram")
    hits = runs.withColumn("h", F.xxhash64("gram")).join(F.broadcast(templates), "h").where("gram = t_gram")
    diagonals = hits.groupBy(*ROW, "template", "label", "n_runs", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.expr("bit_or(shiftleft(1L, t_pos))").alias("places"), F.max(F.coalesce(F.col("core") == F.col("gram"), F.lit(True))).alias("named"),
        F.min("pos").alias("low"), F.max("pos").alias("high"))
    order = Window.partitionBy(*ROW, "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > BAND).cast("int"), F.lit(0))
    bands = diagonals.withColumn("fresh", fresh).withColumn("band", F.sum("fresh").over(order))
    return bands.groupBy(*ROW, "template", "label", "n_runs", "band").agg(
        F.bit_count(F.expr("bit_or(places)")).alias("votes"), F.max("named").alias("named"), F.min("low").alias("first_word"),
        F.max(F.col("high") + K - 1).alias("last_word")).where("named").select(
        *ROW, "label", "template", (F.col("votes") / F.col("n_runs")).alias("share"), "first_word", "last_word")


def _stands_at(w: Column, i: Column, phrase: str) -> Column:
    out = F.lit(True)
    for j, word in enumerate(phrase.split()):
        out = out & F.coalesce(F.get(w, i + j) == word, F.lit(False))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    The score is the largest share of a template found in one band; a base phrase
    alone counts as one half.
    """
    w = F.col("w")

    def places(phrase: str) -> Column:
        # Only texts that hold the phrase's last word are searched word by word.
        some = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: _stands_at(w, i, phrase))
        return F.when(F.array_contains(w, phrase.split()[-1]), some).otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))

    found = _rows(docs).select(*ROW, F.size("w").cast("long").alias("n_words"), *(places(p).alias(label) for p, label in PHRASES.items()))
    everywhere = F.flatten(F.array(*PHRASES.values()))
    base = found.select(
        *ROW, "n_words", F.size(everywhere).cast("long").alias("n_base"),
        F.array_min(everywhere).cast("long").alias("first_word"), F.array_max(everywhere).cast("long").alias("last_word"),
        F.array_compact(F.array(*(F.when(F.size(label) > 0, F.lit(label)) for label in PHRASES.values()))).alias("base"))
    # No more labels than the templates have, whatever the text.
    method = votes(docs).groupBy(*ROW).agg(
        F.collect_set(F.when(F.col("share") >= MIN_SHARE, F.col("label"))).alias("more"), F.max("share").alias("share"))
    method = method.withColumnsRenamed({name: f"found_{name}" for name in ROW})
    same = [F.col(name).eqNullSafe(F.col(f"found_{name}")) for name in ROW]
    return base.join(method, same, "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.expr("CAST(array() AS ARRAY<STRING>)")))), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"))
