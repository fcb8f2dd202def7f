"""License scans [native]: diagonal voting.

The rolling word 3-gram hashes of every text are joined with the positions of the same 3-grams in license templates (a
fixed table, so it is broadcast). Each hit votes for a diagonal, its word position less the template position. A
template found whole puts all its 3-grams on one diagonal. Text with words added or missing spreads over neighbouring
diagonals: those are merged when they lie within SLACK of each other, and the merged span is a license when it covers
at least COVER of the template's 3-grams and is at most STRETCH times its length. Where a chain of neighbours covers enough
but is too long (a beginning that stands there several times, say), the same is asked of each part of it that is a run of
diagonals, single ones included, and of parts that overlap the best one is found. Joined words are compared as words, so a
hash collision is no hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import stable, text_or_empty, written
from skein.llm.license_texts import TEXTS

#: Base phrases: fixed values of the contract.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

#: Templates of the method: license texts, the sentences that they begin with, and lines that name them.
TEMPLATES = [
    *TEXTS,
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
]

GRAM, SLACK, COVER, STRETCH = 3, 4, 0.6, 1.5


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of ASCII letters, digits and all non-ASCII characters.

    lower() also changes non-ASCII letters, which stays without effect as templates are ASCII; the two letters that it
    would turn to ASCII are replaced by others first.
    """
    plain = F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı")))
    return F.array_remove(F.split(plain, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def grams(w: str) -> Column:
    """Array of structs of the GRAM words that start at each position."""
    n = F.greatest(F.size(w) - (GRAM - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(w, F.lit(k + 1), n).alias(f"w{k}") for k in range(GRAM)])


def _positions(rows: DataFrame, ids: list[str], name: str) -> DataFrame:
    """ids, position and words of each gram, with their hash."""
    cols = [f"w{k}" for k in range(GRAM)]
    out = rows.select(*ids, F.posexplode(grams("w")).alias(name, "g")).select(*ids, name, *[F.col("g").getField(c).alias(c) for c in cols])
    return out.withColumn("h", F.xxhash64(*cols))


def template_table(spark: SparkSession, templates: list[tuple[str, str]], base: int) -> DataFrame:
    """tid, label, base, n_grams, tpos, w0.., h: as many rows as the templates have grams."""
    table = F.array(*[F.struct(F.lit(i).alias("tid"), F.lit(label).alias("label"), F.lit(i < base).alias("base"), F.lit(t).alias("t")) for i, (label, t) in enumerate(templates)])
    rows = spark.range(1).select(F.inline(table)).withColumn("w", words(F.col("t")))
    rows = rows.withColumn("n_grams", F.size("w") - (GRAM - 1))
    return _positions(rows, ["tid", "label", "base", "n_grams"], "tpos")


def spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None, text_col: str = "text", base: list[tuple[str, str]] | None = None) -> DataFrame:
    """The spans found: rid, tid, label, base, first_word, last_word (inclusive), coverage.

    rid is monotonically_increasing_id() of docs, which has to be a scan (common.stable). Base phrases give one span for each place where they stand whole.
    """
    base = BASE if base is None else base
    table = template_table(docs.sparkSession, [*base, *(TEMPLATES if templates is None else templates)], len(base))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), words(text_or_empty(text_col)).alias("w")).where(F.size("w") >= GRAM)
    d, t = _positions(rows, ["rid"], "pos").alias("d"), F.broadcast(table).alias("t")
    same = F.col("d.h") == F.col("t.h")
    for k in range(GRAM):
        same = same & (F.col(f"d.w{k}") == F.col(f"t.w{k}"))
    hits = d.join(t, same).select("d.rid", "t.tid", "t.label", "t.base", "t.n_grams", "t.tpos", "d.pos", (F.col("d.pos") - F.col("t.tpos")).alias("diag"))
    key = ["rid", "tid", "label", "base", "n_grams"]
    votes = hits.groupBy(*key, "diag").agg(F.collect_set("tpos").alias("seen"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    votes = written(votes, "license-votes")  # texts are taken apart once
    whole = votes.where("base AND size(seen) = n_grams").select(*key[:4], F.col("first").alias("first_word"), (F.col("last") + GRAM - 1).alias("last_word"), F.lit(1.0).alias("coverage"))

    own = W.partitionBy("rid", "tid").orderBy("diag")
    far = (F.col("diag") - F.lag("diag").over(own) > SLACK) | (F.col("first") - F.lag("last").over(own) > F.col("n_grams") + SLACK)
    chained = votes.where("NOT base").withColumn("new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("chain", F.sum("new").over(own))
    merged = chained.groupBy(*key, "chain").agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    merged = merged.where(F.col("n") >= F.ceil(F.col("n_grams") * COVER))
    found = merged.where(_short()).unionByName(_parts(chained, merged.where(~_short()), key))
    return whole.unionByName(found.select(*key[:4], F.col("first").alias("first_word"), (F.col("last") + GRAM - 1).alias("last_word"), (F.col("n") / F.col("n_grams")).alias("coverage")))


def _short() -> Column:
    return F.col("last") - F.col("first") + GRAM <= (F.col("n_grams") + GRAM - 1) * STRETCH


def _parts(chained: DataFrame, long: DataFrame, key: list[str]) -> DataFrame:
    """key, chain, n, first, last of the licenses inside chains that are too long: runs of the chain's diagonals that cover enough
    and are short enough, without those that overlap a better one (of more coverage, then fewer words, then earlier).

    A diagonal's 3-grams lie within the template's length of it, so the diagonals of a short run are no farther apart than STRETCH
    and once more that length; each diagonal begins a window of that width, and the runs are its beginnings.
    """
    inside = chained.join(long.select("rid", "tid", "chain"), ["rid", "tid", "chain"], "left_semi")
    width = (F.col("n_grams") + GRAM) * (STRETCH + 1)
    a, b = inside.select("rid", "tid", "chain", F.col("diag").alias("from")).alias("a"), inside.alias("b")
    same = (F.col("a.rid") == F.col("b.rid")) & (F.col("a.tid") == F.col("b.tid")) & (F.col("a.chain") == F.col("b.chain"))
    pairs = a.join(b, same & F.col("b.diag").between(F.col("from"), F.col("from") + width)).select("from", "b.*")
    upto = W.partitionBy("rid", "tid", "chain", "from").orderBy("diag").rowsBetween(W.unboundedPreceding, 0)
    runs = pairs.select(
        *key, "chain", F.size(F.array_distinct(F.flatten(F.collect_list("seen").over(upto)))).alias("n"), F.min("first").over(upto).alias("first"), F.max("last").over(upto).alias("last"),
    ).where((F.col("n") >= F.ceil(F.col("n_grams") * COVER)) & _short()).distinct()
    better = F.struct(-F.col("y.n"), F.col("y.last") - F.col("y.first"), F.col("y.first")) < F.struct(-F.col("x.n"), F.col("x.last") - F.col("x.first"), F.col("x.first"))
    overlap = (F.col("x.rid") == F.col("y.rid")) & (F.col("x.tid") == F.col("y.tid")) & (F.col("x.first") < F.col("y.last") + GRAM) & (F.col("y.first") < F.col("x.last") + GRAM)
    return runs.alias("x").join(runs.alias("y"), overlap & better, "left_anti")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases, first_word and last_word are their smallest and largest start (null if
    none). base_labels and labels are distinct, sorted and comma-joined, empty if none. score is the largest coverage
    of a span. Null text counts as empty; rows that repeat an id are judged one by one; other columns are ignored. An empty
    table gives an empty result.
    """
    docs = stable(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.size(words(text_or_empty(text_col))).cast("long").alias("n_words"))
    only = F.col("base")
    per = spans(docs, text_col=text_col).groupBy("rid").agg(
        F.count(F.when(only, 1)).alias("n_base"), F.min(F.when(only, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(only, F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(only, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"),
    )
    return rows.join(per, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
