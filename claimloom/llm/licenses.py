"""License scans by diagonal voting.

The hashes of all K-word windows of every text are joined to the positions that they
have in templates (a table of a few hundred rows, broadcast). A hit at text
position p and template position q votes for diagonal p - q. A phrase is found where
one diagonal has a vote for every window of the phrase. A longer template is found
where neighbouring diagonals, merged over small insertions and deletions, cover
enough of its words within a span not much longer than the template. Only hits are
shuffled; a text without hits costs one small row.

Cases: a null text has no words. Phrases and templates have K words or more. Rows
that repeat an id with another text are judged apart; rows equal in id and text get
equal results. A null id is an id like any other. Texts of any length are read whole.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.common import small_batches, worker, written
from claimloom.llm.kernel import ALNUM, LOWER, prefix_sums, rolled, slices, span_hashes, spans, word_hashes

K = 3
#: Diagonals this far apart belong to one occurrence.
SLACK = 4
#: The part of a template's words that an occurrence covers, and how long its span may be in template lengths.
COVER, STRETCH = 0.75, 1.5

#: Phrases and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Phrases that the scan labels of its own, and passages of public licenses and notices, and their labels.
MORE_PHRASES = [
    ("gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license", "mpl"),
    ("creative commons zero", "cc0"),
]
TEMPLATES = [
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]


def template_positions(spark: SparkSession, base: list[tuple[str, str]], phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """A row for each window of each template: its hash, template, position, and the template's facts."""
    rows = []
    for t, (text, label) in enumerate([*base, *phrases, *templates]):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, bounds = spans(data, np.array([0, len(data)]), ALNUM)
        if len(starts) < K:
            raise ValueError(f"a template needs {K} words: {text}")
        grams = rolled(word_hashes(data, starts, ends), K).view(np.int64).tolist()
        rows += [(g, t, q, label, len(starts), t < len(base) + len(phrases), t < len(base)) for q, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template int, q int, label string, words int, exact boolean, base boolean")


def _words(batches, grams: bool):
    """doc_id, rid, a hash of the whole text, n_words and, if asked for, the hashes of all windows."""
    for b in batches:
        whole, counts, lists, sizes = [], [], [], []
        for _, _, data, offs in slices(b.column(2)):
            low = LOWER[data]
            starts, ends, bounds = spans(low, offs, ALNUM)
            whole.append(span_hashes(prefix_sums(data), offs[:-1], offs[1:]))
            counts.append(np.diff(bounds))
            if grams:
                sums = prefix_sums(low)
                at = rolled(span_hashes(sums, starts, ends), K)
                n = np.maximum(counts[-1] - (K - 1), 0)
                inside = np.repeat(bounds[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                lists.append(at[inside])
                sizes.append(n)
        join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        cols = [b.column(0), b.column(1), pa.array(join(whole, np.uint64).view(np.int64)), pa.array(join(counts, np.int64))]
        names = ["doc_id", "rid", "whole", "n_words"]
        if grams:
            ends = np.concatenate([[0], np.cumsum(join(sizes, np.int64))]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(ends, join(lists, np.uint64).view(np.int64)))
            names.append("grams")
        yield pa.RecordBatch.from_arrays(cols, names=names)


def scan(docs: DataFrame, base=PHRASES, phrases=MORE_PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row for each document: doc_id, whole, n_words; one row for each verified place: doc_id, whole, label, base, first_word, last_word, coverage).

    whole, a hash of the whole text, tells rows of one id apart.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = rows.mapInArrow(worker(lambda b: _words(b, False)), f"doc_id {kind}, rid long, whole long, n_words long").drop("rid")

    grams = rows.mapInArrow(worker(lambda b: _words(b, True)), f"doc_id {kind}, rid long, whole long, n_words long, grams array<long>")
    each = grams.select("doc_id", "rid", "whole", F.posexplode("grams").alias("p", "gram"))
    hits = each.join(F.broadcast(template_positions(spark, base, phrases, templates)), "gram")
    facts = ["label", "words", "exact", "base"]
    votes = hits.groupBy("doc_id", "rid", "whole", "template", (F.col("p") - F.col("q")).alias("diagonal")).agg(
        *[F.first(f).alias(f) for f in facts], F.count("*").alias("votes"), F.min("p").alias("first_word"), (F.max("p") + (K - 1)).alias("last_word"), F.collect_list("q").alias("at")
    )
    votes = written(votes, "votes")  # phrases and templates both follow from them
    places = votes.where(F.col("exact") & (F.col("votes") == F.col("words") - (K - 1))).select("doc_id", "rid", "whole", "label", "base", "first_word", "last_word", F.lit(1.0).alias("coverage"))

    one = Window.partitionBy("rid", "doc_id", "whole", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(one) > SLACK, F.lit(True))
    numbered = votes.where("not exact").withColumn("cluster", F.sum(apart.cast("int")).over(one))
    merged = numbered.groupBy("doc_id", "rid", "whole", "template", "cluster").agg(
        *[F.first(f).alias(f) for f in facts], F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.flatten(F.collect_list("at")).alias("at")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda q: F.sequence(q, q + (K - 1)))))) / F.col("words")
    verified = merged.withColumn("coverage", covered).where((F.col("coverage") >= COVER) & (F.col("last_word") - F.col("first_word") + 1 <= F.col("words") * STRETCH))
    found = places.unionByName(verified.select(*places.columns))
    return texts, found


def summary(texts: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    base = F.col("base")
    by_row = found.groupBy("doc_id", "rid", "whole").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word").cast("long"))).alias("last_word"),
        labels(F.when(base, F.col("label"))).alias("base_labels"),
        labels("label").alias("labels"),
        F.max("coverage").alias("score"),
    )
    by_text = by_row.dropDuplicates(["doc_id", "whole"]).withColumnsRenamed({"doc_id": "f_id", "whole": "f_whole"})
    joined = texts.join(by_text, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("whole") == F.col("f_whole")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
