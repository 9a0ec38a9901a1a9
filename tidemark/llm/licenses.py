"""License scans by an exact set-similarity join of text blocks with templates, in DataFrame functions only.

Text loses ASCII case and falls into words.  A block is ``2 * STRIDE`` words from each multiple of
``STRIDE`` on, so that any run of ``STRIDE`` words stands whole in a block.  A template meets a block
where the block holds at least ``threshold`` of the template's distinct words.  The join:

* *Order.*  Template words are ordered by the number of documents that hold them, counted over all
  documents, rarest first.  Words in no template can't add to an overlap and are left out of the sets.
* *Prefix.*  A template of n words that asks for an overlap of o has its first n - o + 1 words as its
  prefix: a block without any of these can't meet it.  Blocks are joined with prefixes by the word.
* *Length.*  A block with fewer than o template words is left.
* *Position.*  Where the joined word is the i-th of the template and the j-th of the block, at most
  min(n - i, size - j) words can be common; fewer than o end there.  A pair counts at its first common
  word only, so that it comes once.
* The rest is verified by the intersection.

A phrase is a template of threshold 1 whose words have to stand consecutively besides: its places
are looked for in the blocks that hold all its words, and belong to the block in whose first half
they start.

Texts aren't shuffled: blocks without a prefix word are dropped inside their row, candidates meet the
templates (a parameter of at most ``MOST_WORDS`` words, so their prefixes are sent to all tasks), and
one row a document and candidate, without texts, is aggregated by the row's key, partly before the shuffle.

Defined cases: a null or empty text has no words, no places and score 0; rows with equal doc_id each
give a row, null ids too; labels that two templates share count once; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: What words are after A-Z became a-z: digits, letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between the starts of blocks; no template is longer.
STRIDE = 64
#: Words in all templates together.
MOST_WORDS = 100_000
#: Percent of a template's words that a block has to hold.
THRESHOLD = 80


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    percent: int = THRESHOLD
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.translate(str.maketrans(UPPER, LOWER)))

    @property
    def least(self) -> int:
        """Distinct words that a block has to hold."""
        return -(-self.percent * len(set(self.words)) // 100)


#: The phrases asked for, with their labels (fixed values).
PHRASES = (
    Template("mit", "mit license", 100, True),
    Template("apache", "apache license", 100, True),
    Template("gpl", "general public license", 100, True),
)
#: The usual notices by which licenses are given (fixed values).
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    Template("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def in_order(docs: DataFrame, templates: tuple[Template, ...]) -> list[str]:
    """All words of the templates, those of the fewest documents first."""
    known = sorted({w for t in templates for w in t.words})
    held = docs.select(F.explode(F.array_intersect(_strings(known), words_of(F.col("text")))).alias("word"))
    # at most MOST_WORDS rows
    counts = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}
    return sorted(known, key=lambda w: (counts.get(w, 0), w))


def _index(spark: SparkSession, templates: tuple[Template, ...], order: list[str]) -> tuple[DataFrame, list[str]]:
    """(template, label, phrase, token, i, of, least, wanted) for each word of each prefix, and all prefix words."""
    rank = {w: k for k, w in enumerate(order)}
    rows, prefix = [], set()
    for k, t in enumerate(templates):
        words = sorted(set(t.words), key=rank.get)
        for i, token in enumerate(words[: len(words) - t.least + 1]):
            prefix.add(token)
            wanted = _strings(t.words if t.phrase else [])
            rows.append(F.struct(F.lit(k).alias("template"), F.lit(t.label).alias("label"), F.lit(t.phrase).alias("phrase"), F.lit(token).alias("token"), F.lit(i).alias("i"), _strings(words).alias("of"), F.lit(t.least).alias("least"), wanted.alias("wanted")))
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows))), sorted(prefix)


def _checked(templates: tuple[Template, ...]) -> None:
    if not templates:
        raise ValueError("no templates")
    if sum(len(t.words) for t in templates) > MOST_WORDS:
        raise ValueError(f"the templates have more than {MOST_WORDS} words")
    for t in templates:
        if not 0 < len(t.words) <= STRIDE or not 0 < t.percent <= 100 or t.phrase and t.percent < 100:
            raise ValueError(f"a template has 1 to {STRIDE} words and asks for 1 to 100 percent of them, a phrase for all: {t.label}")


def find_blocks(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES) -> DataFrame:
    """row, doc_id, n_words, block, label, phrase, share, starts of every block that meets a template.

    A document that meets none has one row with a null block.  ``row`` is a key of the input's rows,
    ``share`` the part of the template's words that the block holds, ``starts`` a phrase's places (in words of the text).
    """
    _checked(templates)
    order = in_order(docs, templates)
    index, prefix = _index(docs.sparkSession, templates, order)
    rare = lambda w: w.isin(prefix)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words")).withColumn("row", F.monotonically_increasing_id())
    last = F.floor((F.size("words") - 1) / STRIDE).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.struct(k.alias("block"), F.slice("words", k * STRIDE + 1, 2 * STRIDE).alias("w")))
    blocks = F.when(F.exists("words", rare), F.filter(blocks, lambda b: F.exists(b["w"], rare)))
    rows = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode_outer(blocks).alias("b"))
    rows = rows.select("row", "doc_id", "n_words", "b.block", "b.w", F.array_intersect(_strings(order), F.col("b.w")).alias("held"))
    seeds = F.filter(F.transform("held", lambda t, j: F.struct(t.alias("token"), j.alias("j"))), lambda s: rare(s["token"]))
    rows = rows.select("*", F.explode_outer(seeds).alias("s")).select("row", "doc_id", "n_words", "block", "w", "held", "s.token", "s.j")

    rows = rows.join(F.broadcast(index), "token", "left")
    n, size = F.size("of"), F.size("held")
    possible = (size >= F.col("least")) & (F.least(n - F.col("i"), size - F.col("j")) >= F.col("least"))
    rows = rows.withColumn("common", F.when(possible, F.array_intersect("of", "held")))
    met = (F.size("common") >= F.col("least")) & (F.get("common", F.lit(0)) == F.col("token"))
    begin = F.filter(F.sequence(F.lit(0), F.least(F.lit(STRIDE), F.size("w")) - 1), lambda p: F.slice("w", p + 1, F.size("wanted")) == F.col("wanted"))
    starts = F.transform(begin, lambda p: (p + F.col("block") * STRIDE).cast("long"))
    rows = rows.withColumn("starts", F.when(met & F.col("phrase"), starts))
    met = met & (~F.col("phrase") | (F.size("starts") > 0))
    keep = lambda c: F.when(met, c)
    return rows.select(
        "row", "doc_id", "n_words", keep(F.col("block")).alias("block"), keep(F.col("label")).alias("label"), keep(F.col("phrase")).alias("phrase"),
        keep(F.size("common") / n).alias("share"), keep(F.col("starts")).alias("starts"),
    )


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    Base columns are those of phrases; ``score`` is the greatest share of a template of ``labels`` that a block holds (0 without labels).
    """
    said = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = find_blocks(docs, templates).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.coalesce(F.sum(F.size("starts")), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.array_min("starts")).alias("first_word"),
        F.max(F.array_max("starts")).alias("last_word"),
        said(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"),
        said(F.col("label")).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return found.drop("row")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEMPLATES = ", ".join(f"({k}, '{t.label}', {_listed(t.words)}, {t.percent}, {str(t.phrase).lower()})" for k, t in enumerate(PHRASES + NOTICES))
ORACLE_SQL = rf"""
WITH t AS (SELECT *, list_distinct(words) AS s FROM (VALUES {_TEMPLATES}) AS v(template, label, words, percent, phrase)),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT row, k, list_distinct(w[{STRIDE} * k + 1 : {STRIDE} * k + {2 * STRIDE}]) AS s FROM d, unnest(range(0, 1 + greatest(len(w) - 1, 0) // {STRIDE})) AS u(k)),
met AS (SELECT row, label, len(list_intersect(t.s, b.s)) / len(t.s) AS share FROM b JOIN t ON NOT phrase AND 100 * len(list_intersect(t.s, b.s)) >= percent * len(t.s)),
places AS (SELECT row, label, i FROM d CROSS JOIN t, unnest(range(0, greatest(len(w) - len(t.words) + 1, 0))) AS u(i) WHERE phrase AND w[i + 1] = t.words[1] AND w[i + 1 : i + len(t.words)] = t.words),
p AS (SELECT row, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY 1),
every AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT * FROM met UNION ALL SELECT row, label, 1.0 FROM places) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_base, CAST(p.a AS BIGINT) AS first_word, CAST(p.z AS BIGINT) AS last_word,
  coalesce(p.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, CAST(coalesce(every.score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN p USING (row) LEFT JOIN every USING (row)
"""
