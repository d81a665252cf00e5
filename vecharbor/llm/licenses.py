"""License scans with DataFrame functions only: MinHash bands retrieve, exact shingles verify.

Words of a text are hashed as shingles of five, and each row's shingles are cut in overlapping
windows: of ``2 * STEP`` shingles at every ``STEP``-th one for templates of up to ``STEP``
shingles, and likewise for longer templates with the next power of two as step. So each
occurrence of a template lies whole in a window.

Every window is signed whole. A signature has ``TURNS * BINS`` bands: a turn rotates the 64-bit
shingle hashes by other bits, a hash's leading bits choose its bin, and the least hash of each
bin is that band's value (one-permutation MinHash). A window retrieves a template if they agree
in one band. A shared shingle that is the least of its bin in the template is so in a window of
w shingles with a probability of at least 1 - w / (2 * BINS); in the worst case, a template
of a single shingle amid a window full of others, three turns miss it with a probability of
(64 / 2048) ** 3 = 3e-5, and a template of two shingles with 1e-9.

Retrieved pairs are verified by exact containment: of the template's shingles, the share that a
window of its own class holds. The class is the next power of two s of the template's number of
shingles; windows of 2s shingles begin at every s-th one, and all lie in signed windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

SHINGLE = 5
CONTAINMENT = 0.8
#: Shingles between the beginnings of signed windows, at least.
STEP = 32
TURNS = 3
#: Bands of a turn, as bits of a hash; a turn rotates hashes by so many bits.
BIN_BITS = 10
TURN_BITS = 21

# Notices of public licenses, by SPDX identifier.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _words(text: Column) -> Column:
    """Words in lower case: runs of digits, a-z and what is beyond ASCII (edges may be empty)."""
    return F.split(F.lower(text), r"[^0-9a-z\x{80}-\x{10FFFF}]+")


def _shingles(words: str, size: int) -> Column:
    """Hash of the shingle that begins at each word."""
    return F.expr(
        f"CASE WHEN size({words}) >= {size} THEN transform(sequence(0, size({words}) - {size}), i -> xxhash64("
        + ", ".join(f"{words}[i + {k}]" if k else f"{words}[i]" for k in range(size))
        + ")) ELSE array() END"
    ).cast("array<bigint>")


def _once(value: Column) -> Column:
    """``value`` computed once a row: a generator that the optimizer does not copy into lambdas and filters."""
    return F.explode_outer(F.array(value))


def templates(spark: SparkSession, texts: dict[str, str] | None = None, size: int = SHINGLE) -> DataFrame:
    """(license, shingles, n, s): distinct shingles of each template, their number and its class."""
    rows = spark.createDataFrame(sorted((texts or TEMPLATES).items()), "license string, text string")
    words = rows.select("license", F.filter(_words(F.col("text")), lambda w: w != "").alias("w"))
    hashed = words.select("license", F.array_distinct(_shingles("w", size)).alias("shingles")).where("size(shingles) > 0")
    return hashed.select("license", "shingles", F.size("shingles").alias("n"), F.expr("CAST(pow(2, ceil(log2(size(shingles)))) AS INT)").alias("s"))


def _turned(h: Column, turn: int) -> Column:
    by = turn * TURN_BITS
    return F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by)) if by else h


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS)


def _signature(hashes: Column) -> Column:
    """The least hash of each bin: in order of hashes, the first of each bin."""
    leasts = lambda o: F.filter(o, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(o, i - 1))))
    return F.transform(F.array(F.sort_array(hashes)), leasts)[0]


def _bands(known: DataFrame) -> DataFrame:
    """(step, turn, value, license): the bands of each template."""
    turned = lambda t: F.transform("shingles", lambda h: _turned(h, t))
    turns = F.array(*(F.struct(F.lit(t).alias("turn"), _signature(turned(t)).alias("values")) for t in range(TURNS)))
    rows = known.select("license", F.greatest("s", F.lit(STEP)).alias("step"), F.explode(turns).alias("t"))
    return rows.select("step", "t.turn", F.explode("t.values").alias("value"), "license")


def _retrieved(hashed: DataFrame, step: int, values: dict[int, list[int]]) -> DataFrame:
    """(doc_id, key, step, m, ws, turn, value): windows with bands that a template has too."""
    turned = lambda t: F.transform("h", lambda x: _turned(x, t))
    wide = hashed.select("doc_id", "key", F.array(*(turned(t) for t in range(TURNS))).alias("hs"))
    some = wide.where(F.size(F.get("hs", 0)) > 0).select("doc_id", "key", _once(F.col("hs")).alias("hs"))

    def of_turn(m: Column, t: int) -> Column:
        signed = _signature(F.slice(F.get("hs", t), m * step + 1, F.lit(2 * step)))
        return F.transform(F.filter(signed, lambda x: x.isin(values[t])), lambda x: F.struct(F.lit(t).alias("turn"), x.alias("value")))

    def bands(m: Column) -> Column:
        return F.concat(*(of_turn(m, t) for t in range(TURNS)))

    last = F.floor((F.size(F.get("hs", 0)) - 1) / step).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda m: F.struct(m.alias("m"), bands(m).alias("bands")))
    found = some.select("doc_id", "key", "hs", _once(F.filter(windows, lambda w: F.size(w.bands) > 0)).alias("found"))
    cut = F.transform("found", lambda w: F.struct(w.m.alias("m"), w.bands.alias("bands"), F.slice(F.get("hs", 0), w.m * step + 1, F.lit(2 * step)).alias("ws")))
    rows = found.where(F.size("found") > 0).select("doc_id", "key", F.lit(step).alias("step"), F.explode(cut).alias("w"))
    return rows.select("doc_id", "key", "step", "w.m", "w.ws", F.explode("w.bands").alias("b")).select("doc_id", "key", "step", "m", "ws", "b.turn", "b.value")


def scan(docs: DataFrame, texts: dict[str, str] | None = None, size: int = SHINGLE, least: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, first_word, n_windows) of each notice that a text holds.

    ``containment`` is the best of the windows, ``first_word`` the number of the word (from 0)
    at which the template's first shingle in the first such window begins, ``n_windows`` their
    number. Null and short texts hold nothing. Each row's text is cut in windows by itself; rows
    of one doc_id add up, and rows of equal doc_id and text count once. An empty table gives no
    rows; other columns are not read. Templates of fewer words than a shingle are left out.
    Texts are scanned whole. The bands of the templates (1,024 a turn and template at most) are
    literals of the plan; documents are read once, and only retrieved windows are shuffled.
    """
    known = templates(docs.sparkSession, texts, size)
    bands = _bands(known)
    values: dict[int, dict[int, set[int]]] = {}
    for step, turn, value, _ in bands.collect():
        values.setdefault(step, {}).setdefault(turn, set()).add(value)
    key = unused("key", docs.columns)
    words = docs.select("doc_id", F.xxhash64("text").alias(key), _once(_words(F.col("text"))).alias("w"))
    hashed = words.select("doc_id", F.col(key).alias("key"), _once(_shingles("w", size)).alias("h"))
    found = None
    for step, own in sorted(values.items()):
        rows = _retrieved(hashed, step, {t: sorted(v) for t, v in own.items()})
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = hashed.where("false").selectExpr("doc_id", "key", "0 AS step", "0 AS m", "h AS ws", "0 AS turn", "0L AS value")
    pairs = found.join(F.broadcast(bands), ["step", "turn", "value"]).select("doc_id", "key", "step", "m", "ws", "license")
    return _verified(pairs, known, least).groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"), F.min("p").cast("bigint").alias("first_word"), F.count("*").alias("n_windows")
    )


def _verified(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(doc_id, license, key, k, containment, p): windows of a template's class that hold enough of it.

    A window of the class belongs to the signed window in which it begins.
    """
    once = pairs.dropDuplicates(["doc_id", "key", "step", "m", "license"])
    both = once.join(F.broadcast(known), "license")
    at = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: F.array_contains("shingles", F.get("ws", i)))
    hits = both.select("doc_id", "key", "license", "n", "s", "step", "m", F.transform(at, lambda i: F.struct((i + F.col("m") * F.col("step")).alias("p"), F.get("ws", i).alias("h"))).alias("hits"))
    begins = hits.select("*", F.explode(F.expr("array_distinct(flatten(transform(hits.p, p -> array(CAST(p div s AS INT), CAST(p div s AS INT) - 1))))")).alias("k"))
    own = begins.where(F.greatest(F.floor(F.col("k") * F.col("s") / F.col("step")), F.lit(0)) == F.col("m"))
    inside = own.select("doc_id", "key", "license", "n", "k", F.expr("filter(hits, x -> x.p >= k * s AND x.p < (k + 2) * s)").alias("inside"))
    share = F.size(F.array_distinct("inside.h")) / F.col("n")
    return inside.select("doc_id", "license", "key", "k", share.alias("containment"), F.array_min("inside.p").alias("p")).where(F.col("containment") >= least)
