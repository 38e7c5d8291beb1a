"""License scan by diagonal voting; DataFrame functions only.

Every rolling pair of words of a text is joined to the places of that pair in the templates. A match votes for the
diagonal "place in the text less place in the template"; words put in or left out move a match to a near diagonal, so
each diagonal is merged with those NEAR words before and behind it. Such a band is a span of bounded width, and its
votes are verified along the text: a vote counts if its place in the template lies behind all those before it, so a
pair of the template counts once at most and in its order. A span counts if enough of the template is covered. The join
compares the words themselves besides their hash; a short phrase is found just where all its pairs vote for one
diagonal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.exact_dedup import LOWER, UPPER, lower_ascii
from tessera.llm.shared import read

#: Base phrases: each place where these words stand consecutively counts.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: Opening or notice lines of public licences, as words.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
]
#: Words by which the diagonals of a span differ from its own; part of a template that must be covered; least votes of a template.
NEAR, COVER, LEAST = 2, 0.75, 3
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _pairs() -> list[tuple[int, str, bool, int, int, str, str]]:
    """(template, label, is a base phrase, pairs in it, place, word, next word). Template 0 is the mark that every text ends with."""
    out = [(0, "", False, 0, 0, "", "")]
    for i, (label, words) in enumerate([*PHRASES, *TEMPLATES], 1):
        w = words.split()
        out += [(i, label, i <= len(PHRASES), len(w) - 1, k, w[k], w[k + 1]) for k in range(len(w) - 1)]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of docs.

    docs has doc_id (long) and text (string); other columns are not read, and a result row stands for each row, also
    where a doc_id repeats or is null. Null and empty texts have no words: counts of 0, null places, empty labels and
    a score of 0. The score is the part of the best template that is covered, 1 where a base phrase stands.
    """
    spark = docs.sparkSession
    fields = "template int, label string, base boolean, pairs int, place int, t_word string, t_next string"
    # A few hundred constant rows.
    templates = F.broadcast(spark.createDataFrame(_pairs(), fields).withColumn("h", F.xxhash64("t_word", "t_next")))
    words = F.filter(F.split(lower_ascii("text"), SEPARATORS), lambda x: x != "")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("w"))
    # Two empty words end each text, so that template 0 keeps a row of those without a match.
    marked = texts.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.concat("w", F.array(F.lit(""), F.lit(""))).alias("w"))
    zipped = marked.select("row", "doc_id", "n_words", F.posexplode(F.arrays_zip(F.col("w").alias("word"), F.slice("w", 2, F.size("w")).alias("next"))).alias("pos", "pair"))
    rolling = zipped.select("row", "doc_id", "n_words", "pos", F.col("pair.word").alias("word"), F.col("pair.next").alias("next"))
    rolling = rolling.withColumn("h", F.xxhash64("word", "next"))
    votes = rolling.join(templates, (rolling.h == templates.h) & (rolling.word == templates.t_word) & (rolling.next == templates.t_next))
    # All that follows is by row: one exchange, of the votes alone.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    votes = votes.select("row", "doc_id", "n_words", "template", "pos", "place").repartition(n, "row")
    bands = F.sequence(F.col("pos") - F.col("place") - F.col("near"), F.col("pos") - F.col("place") + F.col("near"))
    kinds = F.broadcast(spark.createDataFrame(sorted({(t, label, base, n, 0 if base or not t else NEAR) for t, label, base, n, *_ in _pairs()}), "template int, label string, base boolean, pairs int, near int"))
    banded = votes.join(kinds, "template").withColumn("band", F.explode(bands))
    keys = ["row", "doc_id", "n_words", "template", "label", "base", "pairs", "band"]
    # Votes at one place of a text count once: that of the largest place in the template comes first.
    before = Window.partitionBy(*keys).orderBy("pos", F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    verified = banded.withColumn("counts", F.col("place") > F.coalesce(F.max("place").over(before), F.lit(-1)))
    spans = verified.groupBy(*keys).agg(F.count(F.when(F.col("counts"), 1)).alias("votes"))
    whole = F.col("base") & (F.col("votes") == F.col("pairs"))
    cover = F.when(F.col("base"), F.when(whole, 1.0).otherwise(0.0)).otherwise(F.coalesce(F.try_divide(F.col("votes"), F.col("pairs")), F.lit(0.0)))
    spans = spans.withColumn("cover", F.when(F.col("template") == 0, 0.0).otherwise(cover))
    found = whole | (~F.col("base") & (F.col("cover") >= COVER) & (F.col("votes") >= LEAST))
    at = F.col("band").cast("long")
    joined = lambda keep: F.array_join(F.sort_array(F.collect_set(F.when(keep, F.col("label")))), ",")
    out = spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(whole, 1)).alias("n_base"),
        F.min(F.when(whole, at)).alias("first_word"),
        F.max(F.when(whole, at)).alias("last_word"),
        joined(whole).alias("base_labels"),
        joined(found).alias("labels"),
        F.max("cover").alias("score"),
    )
    return out.drop("row")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


_VALUES = ", ".join(f"({t}, '{label}', {base}, {n}, {k}, '{a}', '{b}')" for t, label, base, n, k, a, b in _pairs())
ORACLE = rf"""
WITH t(template, label, base, pairs, place, word, next) AS (VALUES {_VALUES}),
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
pairs AS (SELECT r, unnest(list_zip(range(0, len(w) - 1), w[1:len(w) - 1], w[2:])) AS p FROM docs WHERE len(w) > 1),
votes AS (
  SELECT r, template, label, base, pairs AS n, p[1] AS pos, place, unnest(range(p[1] - place - CASE WHEN base THEN 0 ELSE {NEAR} END, p[1] - place + CASE WHEN base THEN 1 ELSE {NEAR} + 1 END)) AS band
  FROM pairs JOIN t ON p[2] = word AND p[3] = next),
counted AS (
  SELECT *, place > coalesce(max(place) OVER (PARTITION BY r, template, band ORDER BY pos, place DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS counts FROM votes),
spans AS (SELECT r, label, base, n, band AS place, count(*) FILTER (WHERE counts) AS votes FROM counted GROUP BY r, template, label, base, n, band),
covers AS (
  SELECT *, base AND votes = n AS whole, CASE WHEN base THEN CASE WHEN votes = n THEN 1.0 ELSE 0.0 END ELSE CAST(votes AS DOUBLE) / n END AS cover FROM spans)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) FILTER (WHERE whole) AS n_base,
  CAST(min(place) FILTER (WHERE whole) AS BIGINT) AS first_word, CAST(max(place) FILTER (WHERE whole) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE whole), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE whole OR NOT base AND cover >= {COVER} AND votes >= {LEAST}), '') AS labels,
  CAST(coalesce(max(cover), 0) AS DOUBLE) AS score
FROM docs LEFT JOIN covers USING (r) GROUP BY r, doc_id, w
"""
