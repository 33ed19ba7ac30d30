"""Operator 6, license scan by a positional rare-token index. DataFrame expressions only.

Licence templates are indexed by their words: word -> (template, place). Of each file and template the words that both
have are ranked by IDF (over all files: the fewest files first), and the TOP highest are looked up; a posting puts its
template at the word's place less the template's, and a template is a candidate where enough looked-up words agree on
one such start. A candidate counts if the file has the template's mandatory phrase. No template takes lookups from
another, so a file with many licences keeps all its labels. Base phrases are matched besides, in every file.

The templates are fixed values, so the index is of fixed size and is broadcast. Texts are read once: files without any
mandatory phrase, which can have no label, write their counts and no places, and only files with one reach a shuffle.
Files are told apart by a number given when they are written.

Defined results: null is the empty text; words are runs of ASCII letters and digits and of all characters past ASCII,
A-Z lower-cased; places count words from 0; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

TOP, AGREE = 16, 3

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, text of a template, phrase that a file must have.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("lgpl-3", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3", "gnu lesser general public license"),
    ("agpl-3", "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    ("bsl-1", "distributed under the boost software license version 1 0", "boost software license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
]

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN = "\u212a"  # the one character past ASCII whose lower case is in ASCII


def postings() -> list[tuple[str, int, int]]:
    """word, template, place of every word of the templates."""
    return [(w, t, q) for t, (_, text, _) in enumerate(TEMPLATES) for q, w in enumerate(text.split())]


def needed() -> list[tuple[int, str, int, int]]:
    """template, label, the words that must agree, the words that can."""
    rows = []
    for t, (label, text, _) in enumerate(TEMPLATES):
        size = min(TOP, len(set(text.split())))
        rows.append((t, label, min(AGREE, size), size))
    return rows


def _phrase_starts(phrase: str) -> Column:
    """Places where a phrase's words stand one after another, found from its last word on."""
    words = phrase.split()
    last = len(words) - 1
    ends = F.filter(F.transform("words", lambda w, i: F.when(w == words[last], i - last)), lambda s: s >= 0)
    return F.when(F.contains("line", F.lit(f" {phrase} ")), F.filter(ends, lambda s: F.forall(F.array(*(F.get("words", s + k) == w for k, w in enumerate(words))), lambda ok: F.coalesce(ok, F.lit(False)))))


def read_files(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (a number of the row), n_words, base (places), base_labels, keys (templates whose phrase is there),
    known (template words that are there), hits (all their places, in files with a key)."""
    vocabulary = F.array(*(F.lit(w) for w in sorted({w for w, _, _ in postings()})))
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.lower(F.replace(text, F.lit(KELVIN), F.lit("ж")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("key"), F.regexp_extract_all(plain, F.lit(WORDS), F.lit(0)).alias("words"))
    rows = rows.withColumn("line", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    none = F.expr("cast(array() as array<int>)")
    keys = F.array_compact(F.array(*(F.when(F.contains("line", F.lit(f" {key} ")), F.lit(t)) for t, (_, _, key) in enumerate(TEMPLATES))))
    starts = rows.select("doc_id", "key", "words", keys.alias("keys"), *(F.coalesce(_phrase_starts(p), none).alias(f"b{k}") for k, p in enumerate(BASE)))
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains(F.col("known"), h["w"]))
    label_list = F.array(*(F.when(F.size(f"b{k}") > 0, F.lit(x)) for k, x in enumerate(BASE.values())))
    known = starts.withColumn("known", F.array_intersect(vocabulary, "words"))
    hits = F.coalesce(F.when(F.size("keys") > 0, places), F.expr("cast(array() as array<struct<w:string,i:int>>)"))
    return known.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), F.flatten(F.array(*(f"b{k}" for k in range(len(BASE))))).alias("base"), F.array_compact(label_list).alias("base_labels"), "keys", "known", hits.alias("hits"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, base (places of base phrases), base_labels, labels (both sorted arrays), score.
    score: the share of a template's looked-up words that agree, of the best template; 1 with a base phrase; else 0."""
    spark = docs.sparkSession
    files = materialize(read_files(docs, id_col, text_col), "license")
    # one number for each word of the templates
    seen = files.select(F.explode("known").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("files")).collect()
    counts = {r["w"]: r["files"] for r in seen}
    index = F.broadcast(spark.createDataFrame([(w, t, q, counts.get(w, 0)) for w, t, q in postings()], "word string, template int, place int, files bigint"))
    bounds = F.broadcast(spark.createDataFrame(needed(), "template int, label string, least int, most int"))
    held = files.where(F.size("keys") > 0).select("key", "keys", F.explode("hits").alias("h"))
    met = held.join(index, F.col("h.w") == F.col("word")).where(F.array_contains("keys", F.col("template")))
    rank = F.dense_rank().over(W.partitionBy("key", "template").orderBy("files", "word"))
    chosen = met.select("key", "template", "word", (F.col("h.i") - F.col("place")).alias("start"), rank.alias("rank")).where(F.col("rank") <= TOP)
    agreed = chosen.groupBy("key", "template", "start").agg(F.size(F.collect_set("word")).alias("agree"))
    verified = agreed.join(bounds, "template").where("agree >= least")
    named = verified.groupBy("key").agg(F.collect_set("label").alias("more"), F.max(F.col("agree") / F.col("most")).alias("cover"))
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.expr("cast(array() as array<string>)"))))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0)))
    return files.select("doc_id", "key", "n_words", "base", "base_labels").join(named, "key", "left").select("doc_id", "n_words", "base", F.array_sort("base_labels").alias("base_labels"), labels.alias("labels"), score.alias("score"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base").cast("long").alias("first_word"), F.array_max("base").cast("long").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


OP6_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
phrases(phrase, label) AS (VALUES {_values(BASE.items())}),
base AS (
  SELECT rid, s - 1 AS s, label FROM (SELECT rid, w, phrase, label, len(string_split(phrase, ' ')) AS size, unnest(range(1, len(w) - len(string_split(phrase, ' ')) + 2)) AS s FROM docs, phrases)
  WHERE array_to_string(w[s : s + size - 1], ' ') = phrase),
based AS (SELECT rid, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word FROM base GROUP BY rid),
postings(word, template, place) AS (VALUES {_values(postings())}),
needed(template, label, least_, most_) AS (VALUES {_values(needed())}),
mandatory(template, phrase) AS (VALUES {_values((t, key) for t, (_, _, key) in enumerate(TEMPLATES))}),
every AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
hits AS (SELECT * FROM every WHERE word IN (SELECT word FROM postings)),
files AS (SELECT word, count(DISTINCT rid) AS files FROM hits GROUP BY word),
keyed AS (SELECT d.rid, y.template FROM docs d JOIN mandatory y ON contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || y.phrase || ' ')),
ranked AS (SELECT rid, template, word, row_number() OVER (PARTITION BY rid, template ORDER BY files, word) AS k FROM (SELECT DISTINCT k.rid, k.template, h.word FROM keyed k JOIN hits h USING (rid) JOIN postings p ON p.template = k.template AND p.word = h.word) JOIN files USING (word)),
met AS (
  SELECT h.rid, p.template, h.i - p.place AS start, count(DISTINCT h.word) AS agree
  FROM hits h JOIN ranked r ON h.rid = r.rid AND h.word = r.word AND r.k <= {TOP} JOIN postings p ON p.word = h.word AND p.template = r.template GROUP BY ALL),
verified AS (SELECT m.rid, n.label, m.agree / n.most_ AS cover FROM met m JOIN needed n USING (template) WHERE m.agree >= n.least_),
covers AS (SELECT rid, max(cover) AS cover FROM verified GROUP BY rid),
labelled AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION SELECT rid, label FROM verified) GROUP BY rid),
base_labelled AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT rid, label FROM base) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base, CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
       coalesce(bl.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(c.cover, 0.0) END::DOUBLE AS score
FROM docs d LEFT JOIN based b USING (rid) LEFT JOIN base_labelled bl USING (rid) LEFT JOIN labelled l USING (rid) LEFT JOIN covers c USING (rid)
"""
