"""License scans by conditional compression.

Candidate blocks are the sentences and lines round a word that notices use. Each block is compressed alone and with each
template as zstandard raw dictionary; the share of bytes that a template saves ranks the templates. The best ones are
confirmed word by word: a winner's wording differs from the block in few words, and those are returned. What lies before and
after the winner's words is searched again, until nothing is confirmed: a block has a row for each notice.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, raw_strings

# Wordings of public licence notices; several lines of a licence are alternative wordings.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "Released under the Simplified BSD License."),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Proprietary": ("All rights reserved. No part of this work may be reproduced without written permission.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Words without which no block is a candidate.
HINT = re.compile(r"licen[sc]e|licensing|copyright|copyleft|public domain|all rights reserved|warrant(?:y|ies)|hereby granted|redistribut|spdx|free software|\bCC0\b|\bCC BY", re.IGNORECASE)
SENTENCE = re.compile(r"(?<=[.!?;:])[\x20\t]+(?=[\"'(A-Z0-9])")
WORD = re.compile(r"[\w.+-]*\w")
#: What no notice begins with.
START = re.compile(r"[\s.,;:!?)]*")
#: Lines without a hint that a block may bridge; the least share of words in common.
BRIDGE, LEAST_COMMON = 2, 0.75

FOUND = "doc_id bigint, start bigint, end bigint, license string, reduction double, common double, n_differences bigint, differences string"


def candidate_blocks(text: str) -> list[tuple[int, int]]:
    """start and end (code points) of the blocks: sentences with a hint, joined where at most BRIDGE sentences or lines lie between."""
    if not HINT.search(text):
        return []
    hits, at, number = [], 0, 0
    for line in text.split("\n"):
        if HINT.search(line):
            cuts = [0, *(m.end() for m in SENTENCE.finditer(line)), len(line)]
            for a, b in zip(cuts, cuts[1:]):
                if HINT.search(line, a, b):
                    hits.append((at + a, at + b, number))
                number += 1
        else:
            number += 1
        at += len(line) + 1
    out: list[list[int]] = []
    for a, b, n in hits:
        if out and n - out[-1][2] <= 1 or out and n - out[-1][2] <= 1 + BRIDGE and len(text[out[-1][1] : a].split()) <= 60 and b - out[-1][0] > 200:
            out[-1][1:] = [b, n]
        else:
            out.append([a, b, n])
    return [(a + len(s) - len(s.lstrip()), a + len(s.rstrip())) for a, b, _ in out if (s := text[a:b]).strip()]


def size(data: bytes, dictionary: bytes | None = None) -> int:
    import zstandard as zstd

    primed = {} if dictionary is None else {"dict_data": zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT)}
    return len(zstd.ZstdCompressor(level=19, write_content_size=False, write_checksum=False, **primed).compress(data))


def matched(words: list[str], wanted: list[str]) -> tuple[int, int]:
    """The first and last word that match, as close together as the latest start for this end has them."""
    last = max(m.a + m.size for m in SequenceMatcher(None, words, wanted, autojunk=False).get_matching_blocks() if m.size)
    ahead = [m for m in SequenceMatcher(None, words[:last][::-1], wanted[::-1], autojunk=False).get_matching_blocks() if m.size]
    return last - max(m.a + m.size for m in ahead), last - 1


@lru_cache(maxsize=4096)
def placed(block: str) -> tuple[str, float, float, int, str, int, int] | None:
    """The licence of a block, the share of bytes saved, of words in common, the differences in wording, and where its words lie."""
    data = block.lower().encode("utf-8", "replace")
    alone = size(data)
    ranked = sorted(((alone - size(data, t.lower().encode())) / alone, name, t) for name, ts in TEMPLATES.items() for t in ts)[::-1]
    best = None
    at = [m.span() for m in WORD.finditer(block)]
    words = [block[i:j].lower() for i, j in at]
    there = Counter(words)
    for saved, name, template in ranked:
        wanted = WORD.findall(template.lower())
        if sum((Counter(wanted) & there).values()) < LEAST_COMMON * len(wanted):
            continue  # no order of the words can confirm it
        match = SequenceMatcher(None, words, wanted, autojunk=False)
        same = sum(m.size for m in match.get_matching_blocks())
        common = same / max(1, len(wanted))
        odd = [f"-{' '.join(wanted[k:m])} +{' '.join(words[i:j])}" for op, i, j, k, m in match.get_opcodes() if op != "equal"]
        # A number or a name of the wording that the block lacks makes it another licence.
        telling = {w for w in wanted if any(c.isdigit() for c in w) or w in ("cc", "by", "by-nc", "by-sa", "mit", "gnu", "lesser", "apache", "mozilla", "noncommercial", "sharealike")} - set(words)
        if common >= LEAST_COMMON and not telling:
            key = (common, saved, len(wanted))
            if best is None or key > best[0]:
                best = (key, (name, saved, common, len(odd), "; ".join(odd)), wanted)
    if best is None:
        return None
    first, last = matched(words, best[2])
    return *best[1], at[first][0], at[last][1]


def judged(block: str) -> tuple[str, float, float, int, str] | None:
    """The licence of a block, the share of bytes saved, of words in common, and the differences in wording."""
    found = placed(block)
    return found and found[:5]


def longer(text: str, a: int, b: int) -> int:
    """The end of the sentence after [a, b) on its line, or b."""
    line = text.find("\n", b)
    line = len(text) if line < 0 else line
    rest = len(text[b:line]) - len(text[b:line].lstrip())
    m = SENTENCE.search(text, b + rest, line)
    return b + len(text[b : m.start() if m else line].rstrip())


def scan_text(text: str) -> list[tuple[int, int, str, float, float, int, str]]:
    """start, end, licence, reduction, common, number of differences and differences of each notice."""

    def best(a: int, b: int, extend: bool) -> tuple | None:
        spans = {(a, b), (a, longer(text, a, b) if extend else b)}
        found = [(i, j, *one) for i, j in spans if (one := placed(text[i:j]))]
        return max(found, key=lambda x: (x[4], x[3], -x[1]), default=None)

    def notices(a: int, b: int, extend: bool = True) -> list[tuple]:
        a, b = START.match(text, a, b).end(), a + len(text[a:b].rstrip())
        if a >= b or not HINT.search(text, a, b):
            return []
        found = best(a, b, extend)
        if found is not None:
            i, j, *one, first, last = found
            left, right = notices(i, i + first, False), notices(i + last, j, extend)
            if left or right:  # the span of this one lies between the others
                i, j = left[-1][1] if left else i, right[0][0] if right else j
                i, j = START.match(text, i, j).end(), i + len(text[i:j].rstrip())
                alone = judged(text[i:j])
                one = alone if alone and alone[0] == one[0] else one
            return [*left, (i, j, *one), *right]
        cuts = [a, *(a + m.end() for m in SENTENCE.finditer(text[a:b])), b]
        if len(cuts) == 2:
            return []
        return [x for i, j in zip(cuts, cuts[1:]) for x in notices(i, j, extend)]  # a longer block: each sentence by itself

    out: list[tuple] = []
    for a, b in candidate_blocks(text):
        out += notices(a, b)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """The licence notices in the whole texts of docs (doc_id, text; more columns are ignored): see FOUND.

    start and end are code points, end exclusive. Null or empty texts, and texts without a notice, give no row; rows that
    repeat give theirs each. Of templates alike in words in common, bytes saved and length, the later name wins. An empty
    table gives no rows.
    """
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = raw_strings(batch.column("text"))
            for lo, hi in blocks(offsets, 4 << 20):
                b = batch.slice(lo, hi - lo)
                rows = [(i, *found) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) if t for found in scan_text(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)
