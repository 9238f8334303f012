"""License scans by diagonal voting.

Every run of k words of a document is hashed, and the hashes meet those of the templates' positions in a join. A run at
word i of the document that stands at word j of a template votes for the diagonal i - j; votes are added up by diagonal,
diagonals of one template that lie no further apart than a word inserted or lost here and there are merged, and what
has enough votes is verified on the words themselves: the longest common subsequence of the template and the words
around the diagonals, as a share of the template, must reach SIMILAR. Short phrases are templates, too, of runs of two
words; they must stand there word for word.

Documents are read once for the runs and once more for the words of those that have candidates: these are sent to all
tasks where they are at most SENT spans, and meet the documents in a join by id and hash of the text beyond that. The
templates are a parameter of at most POSITIONS words. Every document gives one row, with or without licenses.

Words are runs of ASCII letters, digits and all characters beyond ASCII, in lower case. Null texts are empty; empty
texts have no words, null first and last words, no labels and the score 0. Equal phrases in one place count once for
each phrase; ties need no order, as all spans that reach the threshold are kept. Repeated rows give a row each, an
empty table an empty result; texts are scanned whole whatever their length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.arrowtext import Rolling, buffers, folded, mixed, slices, words
from framelake.session import staged

PHRASE_RUN, TEXT_RUN = 2, 4
#: Share of a text template's words that votes must cover to be looked at, and that must stand in the document in order.
LOOKED_AT, SIMILAR = 0.3, 0.8
SENT, POSITIONS = 1 << 18, 1 << 16
#: Text bytes whose runs are made at once: they take some 60 times as much memory.
AT_ONCE = 1 << 20


class Template(NamedTuple):
    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[bytes]:
        data = folded(np.frombuffer(self.text.encode(), np.uint8))
        return data.tobytes().split()

    @property
    def run(self) -> int:
        return PHRASE_RUN if self.base else TEXT_RUN

    @property
    def apart(self) -> int:
        """How far diagonals of one occurrence may lie apart."""
        return 0 if self.base else max(1, min(8, len(self.words) // 5))


#: The phrases, and statements and openings of public licenses.
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("mit", "released under the MIT License"),
    Template("mit", "licensed under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    Template("apache", "licensed under the Apache License, Version 2.0"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("gpl", "licensed under the GNU General Public License, version 3"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by", "licensed under CC BY 4.0 Creative Commons Attribution"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form or by any means"),
)
SPAN = "struct<template:int,label:string,base:boolean,first:long,last:long,score:double>"


def runs(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, row: np.ndarray, ks: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each k (index of the first word, hash) of the runs of k words that lie in one row."""
    word = Rolling(data).of(lo, hi)
    for k in ks:
        n = max(0, len(word) - k + 1)
        inside = np.flatnonzero(row[:n] == row[k - 1 : k - 1 + n])
        h = np.full(len(inside), k, np.uint64)
        for j in range(k):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + word[inside + j])
        yield inside, h.view(np.int64)


def _positions(templates: tuple[Template, ...]) -> list[tuple[int, int, int]]:
    """(run, template, position)"""
    out = []
    for t, template in enumerate(templates):
        data = folded(np.frombuffer(template.text.encode(), np.uint8))
        lo, hi, row = words(data, np.array([0, len(data)]))
        if len(lo) < template.run:
            raise ValueError(f"a template needs {template.run} words: {template.text!r}")
        for at, h in runs(data, lo, hi, row, (template.run,)):
            out += [(g, t, i) for i, g in zip(at.tolist(), h.tolist(), strict=True)]
    if len(out) > POSITIONS:
        raise ValueError(f"templates of more than {POSITIONS} words")
    return out


def _read(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("digest"), text.alias("text"))


def _runs_of(read: DataFrame) -> DataFrame:
    """row, at, run for each run of words; doc for one more row of each document, with at -1."""
    kind = read.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        begin = TaskContext.get().partitionId() << 40
        for batch in slices(batches, limit=AT_ONCE):
            n = batch.num_rows
            data, at = buffers(batch.column("text"))
            data = folded(data)
            lo, hi, row = words(data, at)
            first = np.searchsorted(row, np.arange(n + 1))
            doc = pa.StructArray.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(np.diff(first))], ["doc_id", "digest", "n_words"])
            each = pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), doc)
            names = ["row", "at", "run", "doc"]
            yield pa.RecordBatch.from_arrays([pa.array(begin + np.arange(n)), pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n, np.int64)), each], names)
            for i, h in runs(data, lo, hi, row, (PHRASE_RUN, TEXT_RUN)):
                none = pa.ListArray.from_arrays(pa.array(np.zeros(len(i) + 1, np.int32)), doc.slice(0, 0))
                yield pa.RecordBatch.from_arrays([pa.array(begin + row[i]), pa.array((i - first[row[i]]).astype(np.int32)), pa.array(h), none], names)
            begin += n

    return read.mapInArrow(hashed, f"row long, at int, run long, doc array<struct<doc_id:{kind},digest:long,n_words:long>>")


def common(template: list[bytes], text: list[bytes]) -> tuple[int, int, int]:
    """(length, first, last): the longest common subsequence, and the places in text between which one lies."""

    def longest(a: list[bytes], b: list[bytes]) -> tuple[int, int]:
        number = {w: i for i, w in enumerate(set(b))}
        other = np.array([number[w] for w in b])
        row = np.zeros(len(b) + 1, np.int32)
        for w in a:
            new = row.copy()
            np.maximum(new[1:], row[:-1] + (other == number.get(w, -1)), out=new[1:])
            row = np.maximum.accumulate(new)
        return int(row[-1]), int(row.argmax()) - 1

    n, last = longest(template, text)
    if not n:
        return 0, 0, -1
    _, back = longest(template[::-1], text[: last + 1][::-1])
    return n, last - back, last


def _verified(templates: tuple[Template, ...]) -> object:
    spelled = [t.words for t in templates]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=AT_ONCE):
            data, at = buffers(batch.column("text"))
            data = folded(data)
            lo, hi, row = words(data, at)
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out = []
            for i, found in enumerate(batch.column("found").to_pylist()):
                spans = []
                for c in found:
                    t, want = templates[c["template"]], spelled[c["template"]]
                    a, b = max(0, c["lo"] - t.apart), min(int(first[i + 1] - first[i]), c["hi"] + t.apart)
                    text = [data[x:y].tobytes() for x, y in zip(lo[first[i] + a : first[i] + b], hi[first[i] + a : first[i] + b], strict=True)]
                    n, left, right = common(want, text)
                    if n == len(want) == len(text) if t.base else n >= SIMILAR * len(want) and right - left < 2 * len(want):
                        spans.append({"template": c["template"], "label": t.label, "base": t.base, "first": a + left, "last": a + right, "score": n / len(want)})
                out.append(spans)
            kind = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(out, kind)], ["doc_id", "digest", "spans"])

    return verify


def candidates(voted: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """row, template, lo, hi: merged diagonals with enough votes, as the words lo .. hi - 1 that the template would cover."""
    facts = voted.sparkSession.createDataFrame([(t, len(x.words), x.apart, (len(x.words) - x.run + 1) if x.base else max(1, int(LOOKED_AT * len(x.words)) - x.run + 1)) for t, x in enumerate(templates)], "template int, length int, apart int, enough int")
    own = Window.partitionBy("row", "template").orderBy("diagonal")
    near = voted.join(F.broadcast(facts), "template").withColumn("new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own) > F.col("apart"), F.lit(True)).cast("int"))
    merged = near.withColumn("island", F.sum("new").over(own)).groupBy("row", "template", "island", "length", "enough")
    merged = merged.agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("lo"), (F.max("diagonal") + F.first("length")).alias("hi"))
    return merged.where("votes >= enough").select("row", "template", "lo", "hi")


def scanned(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, sent: int = SENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (verified) of each row of docs."""
    spark, read = docs.sparkSession, _read(docs)
    at_template = spark.createDataFrame(_positions(templates), "run long, template int, position int")
    met = _runs_of(read).join(F.broadcast(at_template), "run", "left").where("at < 0 OR template IS NOT NULL")
    diagonal = (F.col("at") - F.col("position")).alias("diagonal")
    votes = met.groupBy("row", "template", diagonal).agg(F.count("*").alias("votes"), F.first("doc", ignorenulls=True).alias("doc"))
    votes = staged(votes, "license-votes")
    about = votes.where("template IS NULL").select("row", F.explode("doc").alias("d")).select("row", "d.*")
    found = candidates(votes.where("template IS NOT NULL").select("row", "template", "diagonal", "votes"), templates)
    found = found.groupBy("row").agg(F.collect_list(F.struct("template", "lo", "hi")).alias("found")).join(about, "row")
    # rows of one id and text have the same candidates
    found = staged(found.groupBy("doc_id", "digest").agg(F.min_by("found", "row").alias("found")), "license-candidates")
    n = found.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0]
    few = (F.broadcast(found) if n <= sent else found).withColumnsRenamed({"doc_id": "own_id", "digest": "own_digest"})
    texts = read.join(few, read["doc_id"].eqNullSafe(few["own_id"]) & (read["digest"] == few["own_digest"])).select("doc_id", "digest", "text", "found")
    kind = read.schema["doc_id"].dataType.simpleString()
    verified = texts.mapInArrow(_verified(templates), f"doc_id {kind}, digest long, spans array<{SPAN}>").dropDuplicates(["doc_id", "digest"])
    verified = verified.withColumnsRenamed({"doc_id": "own_id", "digest": "own_digest"})
    all_rows = about.join(verified, about["doc_id"].eqNullSafe(verified["own_id"]) & (about["digest"] == verified["own_digest"]), "left")
    spans = F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))
    base = F.filter(spans, lambda s: s.base)
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda s: s.label))), ",")
    start = F.transform(base, lambda s: s.first)
    return all_rows.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        labels(base).alias("base_labels"), labels(spans).alias("labels"), F.coalesce(F.array_max(F.transform(spans, lambda s: s.score)), F.lit(0.0)).alias("score"), spans.alias("spans"),
    )
