"""License scans in DataFrame functions only.

A text's 5-word shingles are hashed and cut into overlapping windows; a window's
MinHash values, one for each band, are looked up among those of the templates'
windows. Texts that share a band with a template are verified by the exact share
of the template's shingles that they hold.

Bands have one row, so windows of similarity s share at least one of the six
with probability 1 - (1 - s) ** 6: above 0.9999 at s = 0.8. A template's windows
start at each of its shingles and are so short against it that any full copy of
it holds a window of the text whole, which then meets with certainty.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass

import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import col, table

# Notices of public licenses, as they stand in files and pages.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."),
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

WIDTH, LEAST = 5, 0.8
#: Shingles of a block; windows of two blocks, and of eight at every fourth. A template of fewer than LONG shingles is looked up shingle by shingle.
BLOCK, WIDE, WIDE_STEP, LONG = 4, 8, 4, 11
#: One mask for each band: a window's value is its least hash under the mask.
BANDS = tuple((0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64)) - (1 << 63) for k in range(6))


def kept(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with ``value`` computed once: a generator stops the optimiser from copying it to where it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_shingles(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``_shingles``, the hashes of a text's WIDTH-word shingles in order; none for a text that is null or shorter."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    df = kept(df, F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>")), "_words")
    last = F.size("_words") - F.lit(WIDTH)
    shingle = lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(WIDTH)))
    return kept(df, F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), shingle)).otherwise(F.array().cast("array<bigint>")), "_shingles").drop("_words")


def _least(values: str | Column, at: Column, width: int, mask: int) -> Column:
    """The least masked value of ``width`` places from ``at`` on. Places are read one by one, as Spark's slice copies the whole array."""
    return F.least(*(F.get(values, at + k).bitwiseXOR(F.lit(mask)) for k in range(width)))


def _block_mins(starts: Column, mask: int) -> Column:
    """The least masked hash of each block of shingles."""
    return F.transform(starts, lambda i: _least("_shingles", i * BLOCK, BLOCK, mask))


def _paired(mins: Column) -> Column:
    return F.transform(mins, lambda x, i: F.least(x, F.coalesce(F.get(mins, i + 1), x)))


def _widened(mins: Column) -> Column:
    every = F.sequence(F.lit(0), F.greatest(F.size(mins) - 1, F.lit(0)), F.lit(WIDE_STEP))
    return F.transform(every, lambda i: _least(mins, i, WIDE, 0))


def _tagged(values: Column, scale: int, band: int = 0) -> Column:
    return F.transform(values, lambda x: F.xxhash64(F.lit(100 * scale + band), x))


def with_keys(df: DataFrame) -> DataFrame:
    """``df`` with ``_keys``: a hash of scale, band and MinHash value for each window, and each shingle by itself.

    Blocks' least values are taken first and windows put together from them.
    """
    starts = F.sequence(F.lit(0), F.ceil(F.size("_shingles") / F.lit(BLOCK)).cast("int") - 1)
    df = kept(df, F.struct(*(_block_mins(starts, m).alias(f"b{k}") for k, m in enumerate(BANDS))), "_blocks")
    mins = [F.col(f"_blocks.b{k}") for k in range(len(BANDS))]
    tagged = [_tagged(_paired(m), 1, band) for band, m in enumerate(mins)] + [_tagged(_widened(m), 2, band) for band, m in enumerate(mins)]
    return kept(df, F.concat(_tagged(F.col("_shingles"), 0), *tagged), "_keys").drop("_blocks")


@dataclass(frozen=True)
class Template:
    name: str
    shingles: tuple[int, ...]
    keys: frozenset[int]


def _hashed(*values: bytes) -> int:
    """Spark's xxhash64 of values, given as their bytes."""
    seed = 42
    for value in values:
        seed = xxhash.xxh64_intdigest(value, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def _long(value: int) -> bytes:
    return struct.pack("<q", value)


def template(name: str, notice: str) -> Template:
    """A notice's shingles, and the keys of the windows that lie in it whole."""
    words = [_long(_hashed(w.encode())) for w in regex.findall(r"[\p{L}\p{N}]+", notice.lower())]
    shingles = [_hashed(*words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)]
    if not shingles:
        raise ValueError(f"a notice needs {WIDTH} words: {name}")
    scale = 0 if len(shingles) < LONG else 1 if len(shingles) < (WIDE + WIDE_STEP) * BLOCK else 2
    if scale == 0:
        values = {(0, x) for x in shingles}
    else:
        width = (2 if scale == 1 else WIDE) * BLOCK
        values = {(100 * scale + band, min(x ^ mask for x in shingles[i : i + width])) for i in range(len(shingles) - width + 1) for band, mask in enumerate(BANDS)}
    return Template(name, tuple(dict.fromkeys(shingles)), frozenset(_hashed(struct.pack("<i", tag), _long(x)) for tag, x in values))


def _listed(values: Iterable[int]) -> str:
    return ", ".join(f"{x}L" for x in values)


def scan(docs: DataFrame, id_col: str, text_col: str, notices: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """``(id, license, n_shared, n_shingles, containment)``: a row for each text and notice of which it holds ``least`` of the shingles, the id under the name of ``id_col``.

    Words are runs of letters and digits in lower case; a notice's repeated
    shingles count once. A null, empty or short text holds none; texts are read
    whole; each row is judged by itself, so repeated rows give repeated results
    and null ids stay null. An empty table gives an empty table.
    """
    notices = TEMPLATES if notices is None else notices
    templates = [template(*x) for x in sorted(notices.items())]
    every = sorted(set().union(*(t.keys for t in templates)))
    df = with_shingles(docs.select(col(id_col).alias("_id"), col(text_col).alias("_text")), F.col("_text")).drop("_text")
    df = with_keys(df.where(F.size("_shingles") > 0))
    df = kept(df, F.expr(f"filter(_keys, x -> x IN ({_listed(every)}))"), "_hits").drop("_keys").where(F.size("_hits") > 0)
    array = lambda values: F.expr(f"array({_listed(values)})")
    shared = lambda t: F.size(F.array_intersect(array(t.shingles), "_shingles"))
    judged = [
        F.when(F.arrays_overlap("_hits", array(sorted(t.keys))), F.struct(F.lit(t.name).alias("license"), shared(t).alias("n_shared"), F.lit(len(t.shingles)).alias("n_shingles")))
        for t in templates
    ]
    found = df.select("_id", F.explode(F.array(*judged)).alias("_found")).where("_found IS NOT NULL").select(F.col("_id").alias(id_col), "_found.*")
    share = F.col("n_shared") / F.col("n_shingles")
    return found.withColumn("containment", share).where(F.col("containment") >= least)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices of all documents."""
    return scan(table(spark, sf_dir, "documents"), "doc_id", "text")


def oracle(notices: dict[str, str]) -> str:
    """Every notice against every text, by shingles in full."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in notices.items())
    words = lambda text: f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    shingles = f"list_distinct(list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')))"
    return f"""
WITH notice(license, body) AS (VALUES {values}),
template AS (SELECT license, {shingles} AS t FROM (SELECT license, {words("body")} AS w FROM notice)),
doc AS (SELECT doc_id, {shingles} AS s FROM (SELECT doc_id, {words("text")} AS w FROM documents WHERE text IS NOT NULL)),
piece AS (SELECT doc_id, unnest(s) AS x FROM doc),
part AS (SELECT license, len(t) AS n_shingles, unnest(t) AS x FROM template),
hit AS (SELECT doc_id, license, n_shingles, count(*) AS n_shared FROM piece JOIN part USING (x) GROUP BY ALL)
SELECT doc_id, license, CAST(n_shared AS INTEGER) AS n_shared, CAST(n_shingles AS INTEGER) AS n_shingles, n_shared / n_shingles AS containment
FROM hit WHERE n_shared / n_shingles >= {LEAST}
"""


OP3_SQL = oracle(TEMPLATES)
