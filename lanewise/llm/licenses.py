"""License scan by diagonal voting.

Every run of GRAM words of every text is hashed. A run that also stands in a template meets the template's positions in a Spark
join; the difference of the two positions is the diagonal, and a copied stretch of a template votes for one diagonal again and
again. Votes are summed per document, template and diagonal; diagonals a few words apart, which an inserted or dropped word
causes, are merged when their places are near one another, whatever other diagonals lie between; a merged stretch counts when it
holds enough of its template's runs, each counted once.

Beside the method's spans stand the base phrases, all places where their words follow one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import materialize
from lanewise.llm.hashing import NOT_ALNUM, grams, hash_words, runs, words

GRAM = 3
# Diagonals so many words apart or less, at places so many words apart or less, belong to one stretch.
DRIFT, GAP = 4, 24
# A stretch is verified when it holds this share of its template's runs.
COVERAGE = 0.6
# Score of a document that has a base phrase but no verified stretch.
PHRASE_SCORE = 0.5

# Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Template texts of public licenses, by label.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
    "required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS "
    "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version.",
    "mit-line": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the Software), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
}


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _template_grams(text: str) -> np.ndarray:
    h = hash_words(text.encode(), NOT_ALNUM)
    return _signed(grams(h, np.array([0, len(h)]), GRAM)[0])


def _lists(values: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(values, kind))


def _scan(docs: DataFrame, templates: dict[str, str], phrases: dict[str, str]) -> DataFrame:
    """A row per document: word count, base places with the phrase's number, and the runs that stand in some template."""
    wanted = np.unique(np.concatenate([_template_grams(t) for t in templates.values()])).view(np.uint64)
    sieve = np.zeros(1 << 16, bool)
    sieve[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
    wanted = np.sort(wanted)
    looked_for = [hash_words(p.encode(), NOT_ALNUM) for p in phrases]
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base_at", pa.list_(pa.int64())),
                        ("base_kind", pa.list_(pa.int32())), ("at", pa.list_(pa.int64())), ("gram", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, off, data in runs(batch):
                h, rows, _, _ = words(off, data, NOT_ALNUM)
                g, begin = grams(h, rows, GRAM)
                at = np.flatnonzero(sieve[(g & np.uint64(0xFFFF)).astype(np.int64)])
                if len(at):
                    place = np.minimum(np.searchsorted(wanted, g[at]), len(wanted) - 1)
                    at = at[wanted[place] == g[at]]
                cut = np.searchsorted(at, begin)
                owner = np.repeat(np.arange(len(rows) - 1), np.diff(cut))
                found, kind = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
                for k, phrase in enumerate(looked_for):
                    hit = np.flatnonzero(h[:len(h) - len(phrase) + 1] == phrase[0]) if len(h) >= len(phrase) else at[:0]
                    for i, x in enumerate(phrase[1:], 1):
                        hit = hit[h[hit + i] == x]
                    hit = hit[np.searchsorted(rows, hit, "right") == np.searchsorted(rows, hit + len(phrase) - 1, "right")]
                    found.append(hit)
                    kind.append(np.full(len(hit), k, np.int32))
                place, kind = np.concatenate(found), np.concatenate(kind)
                order = np.argsort(place, kind="stable")
                place, kind = place[order], kind[order]
                base = np.searchsorted(place, rows)
                mine = np.repeat(np.arange(len(rows) - 1), np.diff(base))
                yield pa.record_batch([
                    batch.column("doc_id").slice(first, len(off) - 1).cast(pa.int64()), pa.array(np.diff(rows), pa.int64()),
                    _lists(place - rows[mine], base, pa.int64()), _lists(kind, base, pa.int32()),
                    _lists(at - begin[owner], cut, pa.int64()), _lists(_signed(g[at]), cut, pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        task, "doc_id long, n_words long, base_at array<long>, base_kind array<int>, at array<long>, gram array<long>")


def stretches(votes: list[tuple[int, int, int, list[int]]]) -> list[tuple[int, int, int]]:
    """(first place, last place, distinct runs held) of what the votes (diagonal, low, high, held) of a template join to.

    Any two diagonals within DRIFT link when their places are within GAP. A diagonal stands once, so it has 2 * DRIFT links at most.
    """
    at = {v[0]: i for i, v in enumerate(votes)}
    up = list(range(len(votes)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, (diagonal, low, high, _) in enumerate(votes):
        for j in (at[d] for d in range(diagonal + 1, diagonal + DRIFT + 1) if d in at):
            if votes[j][1] - high <= GAP and low - votes[j][2] <= GAP:
                up[root(j)] = root(i)
    out: dict[int, list] = {}
    for i, (_, low, high, held) in enumerate(votes):
        own = out.setdefault(root(i), [low, high, set()])
        own[0], own[1] = min(own[0], low), max(own[1], high)
        own[2].update(held)
    return sorted((low, high, len(held)) for low, high, held in out.values())


def spans(hits: DataFrame, templates: dict[str, str], by: tuple[str, ...] = ("row",)) -> DataFrame:
    """Verified stretches: `by`, label, first_word, end_word (exclusive), coverage. `hits` has `by`, at and gram, a row each."""
    spark = hits.sparkSession
    places = [(int(g), label, i, len(own)) for label, text in sorted(templates.items())
              for own in [_template_grams(text)] for i, g in enumerate(own)]
    template = spark.createDataFrame(places, "gram long, label string, template_at long, template_grams long")
    # The templates are fixed text: a few hundred rows.
    met = hits.join(F.broadcast(template), "gram").withColumn("diagonal", F.col("at") - F.col("template_at"))
    # Sums of votes; the places a diagonal has are its template's runs at most, so the list is as short as the template.
    votes = met.groupBy(*by, "label", "diagonal", "template_grams").agg(
        F.min("at").alias("low"), F.max("at").alias("high"), F.collect_set("template_at").alias("held"))
    # A template whose votes are too few in all has no stretch; the votes of the others are as many as the document's hits.
    mine = votes.groupBy(*by, "label", "template_grams").agg(
        F.collect_list(F.struct("diagonal", "low", "high", "held")).alias("votes"),
        F.size(F.array_distinct(F.flatten(F.collect_set("held")))).alias("held")).filter(F.col("held") >= COVERAGE * F.col("template_grams"))
    kind = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("low", "high", "held")]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("low", "high", "held"), x, strict=True)) for x in stretches([(v["diagonal"], v["low"], v["high"], v["held"]) for v in own])]
                     for own in batch.column("votes").to_pylist()]
            schema = pa.list_(pa.struct([(c, pa.int64()) for c in ("low", "high", "held")]))
            yield pa.record_batch([*batch.columns[:-1], pa.array(found, schema)], names=[*batch.schema.names[:-1], "found"])

    mine = mine.select(*by, "label", "template_grams", "votes")
    merged = mine.mapInArrow(task, T.StructType([*mine.schema.fields[:-1], T.StructField("found", kind)]))
    merged = merged.select(*by, "label", "template_grams", F.explode("found").alias("x"))
    return merged.withColumn("coverage", F.col("x.held") / F.col("template_grams")).filter(F.col("coverage") >= COVERAGE).select(
        *by, "label", F.col("x.low").alias("first_word"), (F.col("x.high") + GRAM).alias("end_word"), "coverage")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the verified spans.

    Only doc_id and text are read. A null or empty text has no words: counts are 0, places null, labels empty, score 0. Rows
    that share a doc_id are scanned one by one; an empty table gives no rows. A text without any hit costs one pass and no
    shuffled row; hits are far fewer than words, and a document's hits are split by template before they are sorted.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    rows = materialize(_scan(docs, templates, phrases).withColumn("row", F.monotonically_increasing_id()), "license-hits")
    hits = rows.filter(F.size("at") > 0).select("row", F.explode(F.arrays_zip("at", "gram")).alias("x")).select("row", "x.*")
    found = spans(hits, templates).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("first_word", "end_word", "label", "coverage"))).alias("spans"),
        F.max("coverage").alias("coverage"))
    names = F.array(*map(F.lit, phrases.values()))
    base = F.transform("base_kind", lambda k: F.element_at(names, k + 1))
    own = F.coalesce(F.transform("spans", lambda x: x["label"]), F.array().cast("array<string>"))
    n = F.size("base_at").cast("long")
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words", n.alias("n_base"), F.array_min("base_at").alias("first_word"), F.array_max("base_at").alias("last_word"),
        _joined(base).alias("base_labels"), _joined(F.concat(base, own)).alias("labels"),
        F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(n > 0, PHRASE_SCORE).otherwise(0.0)).alias("score"), "spans")
