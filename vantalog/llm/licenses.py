"""License scan by diagonal voting (operator 1).

All rolling word k-gram hashes of every text are joined in Spark to the positions of the same k-grams in license
templates. A hit at word p of a text and q of a template votes for the diagonal p - q; votes are aggregated by
diagonal, neighbouring diagonals (words inserted or left out) are merged, and the span is verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_RE, WordHashes, alnum_words, batches, doc_key, lower_ascii, texts

#: Phrases that count wherever their words stand consecutively, and the label of each.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices of common licenses, as published, and their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
)

PHRASE_K, TEMPLATE_K = 2, 5
_MIX = 0x9E3779B97F4A7C15
_BLOCK = 4096


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling polynomial hash of every run of k word hashes; 0 stands for no run and is never a hash."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    acc = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = acc * np.uint64(_MIX) + words[j : j + n]
    return np.where(acc == 0, np.uint64(1), acc).view(np.int64)


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """h, tid, label, phrase, k, tpos, gram, grams: one row per k-gram of each template. The templates are parameters of the job, so the table is as small as they are."""
    hashes, rows = WordHashes(), []
    for tid, (label, text, phrase) in enumerate([(b, a, True) for a, b in phrases] + [(a, b, False) for a, b in templates]):
        words, k = alnum_words(text.encode()), PHRASE_K if phrase else TEMPLATE_K
        found = gram_hashes(hashes.of(words), k).tolist()
        rows += [(h, tid, label, phrase, k, q, b" ".join(words[q : q + k]).decode(), len(found)) for q, h in enumerate(found)]
    return spark.createDataFrame(rows, "h long, tid int, label string, phrase boolean, k int, tpos int, gram string, grams int")


def _rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each text: its words joined by spaces, where each starts, and the hashes of all runs of both lengths that start in the block."""
    hashes, more = WordHashes(), max(PHRASE_K, TEMPLATE_K) - 1
    for batch in batches(rows, 2 << 20):
        out = []
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            words = alnum_words(text)
            if len(words) < PHRASE_K:
                continue
            key, ids = xxhash.xxh64_intdigest(text, 42), hashes.of(words)
            key -= (key >> 63) << 64
            for base in range(0, len(words), _BLOCK):
                part, own = words[base : base + _BLOCK + more], ids[base : base + _BLOCK + more]
                starts = np.zeros(len(part) + 1, np.int32)
                np.cumsum(np.fromiter(map(len, part), np.int32, len(part)) + 1, out=starts[1:])
                grams = np.zeros((2, min(_BLOCK, len(words) - base)), np.int64)
                for i, k in enumerate((PHRASE_K, TEMPLATE_K)):
                    h = gram_hashes(own, k)[: grams.shape[1]]
                    grams[i, : len(h)] = h
                out.append((doc, key, base, b" ".join(part), starts, grams.ravel()))
        if out:
            names = ["doc_id", "doc_key", "base", "block", "starts", "hashes"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([_lists(c, t) if pa.types.is_list(t) else pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _lists(arrays, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays), kind.value_type))


def spans(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, least: float = 0.8, shift: int = 5) -> DataFrame:
    """Verified spans: doc_id, doc_key, tid, label, phrase, first, last (words), coverage (share of the template's k-grams found on the merged diagonals).

    ``docs`` needs doc_id (long) and text; other columns are ignored. Null and empty texts give no spans; rows equal in
    doc_id and text give theirs once. A phrase counts only in full and never merges with its neighbour; a template
    counts from a coverage of ``least`` on diagonals at most ``shift`` words apart.
    """
    templates_df = template_grams(docs.sparkSession, phrases, templates)
    blocks = docs.select("doc_id", "text").mapInArrow(_rows, "doc_id long, doc_key long, base int, block binary, starts array<int>, hashes array<long>")
    grams = blocks.select("doc_id", "doc_key", "base", "block", "starts", (F.size("hashes") / 2).cast("int").alias("n"), F.posexplode("hashes").alias("i", "h"))
    hits = grams.join(F.broadcast(templates_df), "h").withColumn("p", F.col("i") - F.when(F.col("phrase"), 0).otherwise(F.col("n")))
    start, end = F.get("starts", F.col("p")), F.get("starts", F.col("p") + F.col("k"))
    hits = (
        hits.where(F.substring("block", start + 1, end - start - 1).cast("string") == F.col("gram"))
        .select("doc_id", "doc_key", "tid", "label", "phrase", "k", "grams", "tpos", (F.col("base") + F.col("p")).alias("pos"))
        .distinct()
    )
    of = ["doc_id", "doc_key", "tid", "label", "phrase", "k", "grams"]
    votes = hits.groupBy(*of, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("found"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    along = Window.partitionBy("doc_id", "doc_key", "tid").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(along) > F.when(F.col("phrase"), 0).otherwise(shift)
    merged = votes.withColumn("new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("group", F.sum("new").over(along))
    found = merged.groupBy(*of, "group").agg(F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n"), F.min("first").alias("first"), F.max(F.col("last") + F.col("k") - 1).alias("last"))
    coverage = F.col("n") / F.col("grams")
    return found.where(coverage >= F.when(F.col("phrase"), 1.0).otherwise(least)).select("doc_id", "doc_key", "tid", "label", "phrase", F.col("first").cast("long"), F.col("last").cast("long"), coverage.alias("coverage"))


def scan(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the best coverage of a verified span, 0 without one. Texts without spans have empty label strings and
    null first_word and last_word; null texts count as empty. An empty table gives an empty result.
    """
    labels = lambda which: F.array_join(F.array_sort(F.collect_set(which)), ",")
    base = F.when(F.col("phrase"), F.col("first"))
    found = (
        spans(docs, **options)
        .groupBy(F.col("doc_id").alias("_doc"), F.col("doc_key").alias("_key"))
        .agg(F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"), labels(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), labels(F.col("label")).alias("labels"), F.max("coverage").alias("score"))
    )
    rows = docs.select("doc_id", doc_key(F.col("text")).alias("_k"), F.coalesce(F.regexp_count(lower_ascii(F.col("text")), F.lit(ALNUM_RE)), F.lit(0)).cast("long").alias("n_words"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_k") == F.col("_key")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
