"""Licenses named or quoted in texts, found by votes on diagonals.

Every run of GRAM words of a text is hashed and joined to the places of the same run in the templates. A text word at
place d that meets template word t votes for the diagonal d - t: the place where the template would begin. Votes are added up by diagonal,
diagonals that lie close together are merged to one place (words put in or left out move a quotation to the next
diagonals), and places with votes enough are verified on the words themselves.

A phrase (base template) counts where all its words stand on one diagonal. A longer template counts where at least SHARE of its
words lie in runs of GRAM equal words; each vote covers GRAM words at most, so a place with fewer than SHARE / GRAM votes a
template word cannot count, and none that could is left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Powers, binary_column, mix, prepare, slices, spread, stage, word_hashes, words_of

GRAM = 3
SHARE = 0.7
#: Grams of one row of hashes; longer texts take several rows.
ROW_GRAMS = 1 << 15
#: Diagonals verified at once.
BLOCK = 4096
#: Template positions that are broadcast (24 bytes each); more are joined by shuffling the grams.
BROADCAST_POSITIONS = 1_000_000
#: Bytes outside words, and the table that lower-cases A-Z.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

#: Phrases that name a license, and its label. Fixed values.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

#: Notices and texts of public licenses, without names and years, and their labels. Fixed values.
TEMPLATES = [
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
]


def words(text: str) -> list[bytes]:
    """The words of a text: runs of digits, letters and all beyond ASCII, with A-Z lower-cased."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    s, e, _ = words_of(data, np.array([0, len(data)]), OUTSIDE)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist())]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of GRAM words of lower-cased texts, where each text's begin (n + 1 offsets), and how many words each has."""
    n = len(offsets) - 1
    s, e, doc = words_of(data, offsets, OUTSIDE)
    h = word_hashes(data, s, e)
    k = max(0, len(h) - GRAM + 1)
    run = np.zeros(k, U64)
    for i in range(GRAM):
        run += h[i : i + k] * Powers.upto(GRAM + 1)[0][i]
    whole = np.flatnonzero(doc[:k] == doc[GRAM - 1 : GRAM - 1 + k])
    sizes = np.bincount(doc[whole], minlength=n)
    return mix(run[whole]).view(np.int64), np.concatenate([[0], np.cumsum(sizes)]), np.bincount(doc, minlength=n)


@dataclass
class Template:
    label: str
    words: list[bytes]
    base: bool

    @property
    def slack(self) -> int:
        """Diagonals this close together are one place."""
        return 0 if self.base else max(2, len(self.words) // 10)

    @property
    def need(self) -> int:
        """The least votes of a place that can count."""
        return len(self.words) - GRAM + 1 if self.base else math.ceil(SHARE * len(self.words) / GRAM)


def templates(phrases: list[tuple[str, str]], texts: list[tuple[str, str]]) -> list[Template]:
    out = [Template(label, words(t), base) for base, given in ((True, phrases), (False, texts)) for label, t in given]
    if any(len(t.words) < GRAM for t in out):
        raise ValueError(f"a template has at least {GRAM} words")
    return out


def _hashed(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int64()), ("grams", pa.list_(pa.int64()))])
    for whole in batches:
        for batch in slices(whole, "data", 1 << 20):
            data, offsets = binary_column(batch.column("data"))
            value, first, _ = grams(LOWER[data], offsets)
            size = np.diff(first)
            rows = np.repeat(np.arange(len(size)), -(-size // ROW_GRAMS))
            at = (np.arange(len(rows)) - np.searchsorted(rows, rows)) * ROW_GRAMS
            bounds = np.append(first[rows] + at, len(value)).astype(np.int32)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(at), pa.ListArray.from_arrays(pa.array(bounds), pa.array(value))], schema=schema)


def places(texts: DataFrame, known: list[Template]) -> DataFrame:
    """texts(doc_id, th, data) -> doc_id, th, found: per text that has any, its places as (template, diagonals)."""
    spark = texts.sparkSession
    cells = []
    for k, t in enumerate(known):
        data = np.frombuffer(b" ".join(t.words), np.uint8)
        cells += [(k, i, int(g)) for i, g in enumerate(grams(data, np.array([0, len(data)]))[0])]
    positions = spark.createDataFrame(cells, "template int, t int, gram long")
    positions = F.broadcast(positions) if len(cells) <= BROADCAST_POSITIONS else positions
    rules = F.create_map(*(F.lit(x) for k, t in enumerate(known) for x in (k, t.slack))), F.create_map(*(F.lit(x) for k, t in enumerate(known) for x in (k, t.need)))
    hashed = texts.mapInArrow(_hashed, "doc_id long, th long, at long, grams array<long>")
    hits = hashed.select("doc_id", "th", "at", F.posexplode("grams").alias("i", "gram")).join(positions, "gram")
    votes = hits.groupBy("doc_id", "th", "template", (F.col("at") + F.col("i") - F.col("t")).alias("diagonal")).agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("doc_id", "th", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(ordered) > rules[0][F.col("template")], F.lit(True))
    merged = votes.withColumn("new", new.cast("int")).withColumn("place", F.sum("new").over(ordered))
    merged = merged.groupBy("doc_id", "th", "template", "place").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
    found = merged.where(F.col("n") >= rules[1][F.col("template")])
    return found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("template", "diagonals")).alias("found"))


def covered(ids: np.ndarray, template: np.ndarray, diagonals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which template words lie in runs of GRAM equal words on one of the diagonals, and the text's words that they meet (flags)."""
    size = len(template)
    got, met = np.zeros(size, bool), np.zeros(len(ids), bool)
    for i in range(0, len(diagonals), BLOCK):
        at = diagonals[i : i + BLOCK, None] + np.arange(size)
        same = (at >= 0) & (at < len(ids))
        same &= ids[np.where(same, at, 0)] == template
        run = same[:, GRAM - 1 :].copy()
        for j in range(GRAM - 1):
            run &= same[:, j : j + run.shape[1]]
        on = np.zeros_like(same)
        for j in range(GRAM):
            on[:, j : j + run.shape[1]] |= run
        got |= on.any(axis=0)
        met[at[on]] = True
    return got, met


SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])
SPANS = "spans array<struct<label: string, first: bigint, last: bigint, share: double>>"


def _verified(known: list[Template]):
    """Texts with places -> what is found in them."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(SPAN))])

    def run(batches):
        vocabulary: dict[bytes, int] = {}
        numbered = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t.words]) for t in known]

        def judge(raw: bytes, s: np.ndarray, e: np.ndarray, found: list[dict]):
            ids = np.array([vocabulary.get(raw[a:b], -1) for a, b in zip(s.tolist(), e.tolist())], np.int64)
            starts, base, spans = [], set(), []
            for place in found:
                k = place["template"]
                t, diagonals = known[k], np.array(place["diagonals"], np.int64)
                if t.base:
                    diagonals = diagonals[(diagonals >= 0) & (diagonals + len(t.words) <= len(ids))]
                    here = diagonals[(ids[diagonals[:, None] + np.arange(len(t.words))] == numbered[k]).all(axis=1)].tolist()
                    starts += here
                    base |= {t.label} if here else set()
                    spans += [(t.label, d, d + len(t.words) - 1, 1.0) for d in here]
                    continue
                got, met = covered(ids, numbered[k], diagonals)
                share = int(got.sum()) / len(t.words)
                if share >= SHARE:
                    on = np.flatnonzero(met)
                    spans.append((t.label, int(on[0]), int(on[-1]), share))
            labels = base | {x[0] for x in spans}
            spans = [dict(zip(("label", "first", "last", "share"), x)) for x in sorted(spans, key=lambda x: (x[1], x[2], x[0], x[3]))]
            return len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max((x["share"] for x in spans), default=0.0), spans

        nothing = (0, None, None, "", "", 0.0, [])
        for whole in batches:
            for batch in slices(whole, "data", 1 << 20):
                data, offsets = binary_column(batch.column("data"))
                data = LOWER[data]
                s, e, doc = words_of(data, offsets, OUTSIDE)
                raw, n = data.tobytes(), np.bincount(doc, minlength=batch.num_rows)
                first = np.concatenate([[0], np.cumsum(n)])
                rows = [nothing if not f else judge(raw, s[first[i] : first[i + 1]], e[first[i] : first[i + 1]], f) for i, f in enumerate(batch.column("found").to_pylist())]
                cells = [pa.array([r[k] for r in rows], t.type) for k, t in enumerate(list(schema)[2:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *cells], schema=schema)

    return run


def scan_licenses(docs: DataFrame, *, phrases: list[tuple[str, str]] = PHRASES, texts: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of `phrases`, first_word and last_word are their least and greatest starts (null if none); labels holds
    those of `texts` too; score is the greatest share of a template that one place holds, 0 if none counts; spans are the
    places (label, first and last word, share). A null text counts as empty; texts without words have no places; a null
    doc_id is carried; repeated rows are judged alike; an empty table gives no rows; other columns are ignored. Texts are
    searched whole. The words of all places of one text are held at once, as the text itself is.
    """
    prepare(docs.sparkSession)
    known = templates(phrases, texts)
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("data"))
    keyed = spread(plain).select("doc_id", F.xxhash64("data").alias("th"), "data")
    found = stage(places(keyed, known), "places").withColumnsRenamed({"doc_id": "of", "th": "hash"})
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("hash")), "left").select("doc_id", "data", "found")
    return joined.mapInArrow(_verified(known), f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, {SPANS}")
