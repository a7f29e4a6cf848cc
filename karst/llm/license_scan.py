"""License scans by conditional compression.

Lines that name a licence, or lie within a few lines of one that does, form candidate blocks.  A block goes on, line by line and both ways, as long as a
leading template makes the longer block smaller still, so a notice may be wrapped at any width.  A block is compressed once
plainly and once with each licence template as raw zstandard dictionary; templates are ranked by the bytes they save.  Winners are
confirmed by wording: the template's words are aligned with the block's, and every word left out, put in or changed is reported.  Short
notices must agree in every word; longer ones may differ in ``LOOSE`` of their words, never in a word with a digit or in a
name (a word with a capital in the template).
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ._work import pick, ship

LOOSE = 0.1
LEAST_SAVED = 6
BLOCK_CHARS = 4000

# Notices as the licences' own texts suggest them, and the best-known permission paragraphs.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD License.",
    ],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
}
MARKS = ["licen", "copyright", "public domain", "creative commons", "redistribut", "permission", "spdx", "waived all"]
_plain = zstandard.ZstdCompressor(level=3)
#: A word may be broken after a hyphen, behind which the next line's comment sign stands.
_BREAK = re.compile(r"\n[ \t*#/;-]*")
_WORD = re.compile(r"[^\W_]+(?:(?:[-.]|-\n[ \t*#/;-]*)[^\W_]+)*")


def words(text: str) -> list[tuple[str, int, int]]:
    return [(_BREAK.sub("", m[0]).lower() if "\n" in m[0] else m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


@lru_cache(maxsize=1)
def _templates() -> list[tuple[str, str, list[str], set[str], zstandard.ZstdCompressor]]:
    out = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            named = {m[0].lower() for m in _WORD.finditer(text) if m.start() and any(c.isupper() for c in m[0])}
            data = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            out.append((name, text, [w for w, _, _ in words(text)], named, zstandard.ZstdCompressor(level=3, dict_data=data)))
    return out


def savings(block: str) -> list[tuple[int, int]]:
    """(bytes saved, template's place) for every template, best first; ties keep the templates' order."""
    data = block.encode()
    plain = len(_plain.compress(data))
    got = [(plain - len(c.compress(data)), k) for k, (*_, c) in enumerate(_templates())]
    return sorted(got, key=lambda x: (-x[0], x[1]))


def align(template: list[str], block: list[str]) -> tuple[int, int, int, list[str]]:
    """(differences, first word, end word, wording) of the block's best place for the template's words."""
    m, n = len(template), len(block)
    cost = [[0] * (n + 1)] + [[i + 1] + [0] * n for i in range(m)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (template[i - 1] != block[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    end = min(range(n + 1), key=lambda j: cost[m][j])
    i, j, said = m, end, []
    while i:
        if j and cost[i][j] == cost[i - 1][j - 1] + (template[i - 1] != block[j - 1]):
            if template[i - 1] != block[j - 1]:
                said.append(f"{template[i - 1]}>{block[j - 1]}")
            i, j = i - 1, j - 1
        elif cost[i][j] == cost[i - 1][j] + 1:
            said.append(f"-{template[i - 1]}")
            i -= 1
        else:
            said.append(f"+{block[j - 1]}")
            j -= 1
    return cost[m][end], j, end, said[::-1]


def _saved(compressor: zstandard.ZstdCompressor, text: str) -> int:
    data = text.encode()
    return len(_plain.compress(data)) - len(compressor.compress(data))


def _extended(text: str, lines: list[tuple[int, int, bool]], first: int, last: int) -> tuple[int, int]:
    """The block of lines first to last, with the lines before and after it that a leading template still compresses (one that it doesn't may lie between)."""
    ranked = [(saved, k) for saved, k in savings(text[lines[first][0] : lines[last][1]]) if saved >= LEAST_SAVED]
    out = [first, last]
    for saved, k in ranked:
        if 2 * saved < ranked[0][0]:
            break
        compressor = _templates()[k][-1]
        for end, step in ((1, 1), (0, -1)):
            span, got, idle = [first, last], saved, 0
            at = span[end] + step
            while idle < 2 and 0 <= at < len(lines) and lines[max(at, last)][1] - lines[min(at, first)][0] <= BLOCK_CHARS:
                new = _saved(compressor, text[lines[min(at, first)][0] : lines[max(at, last)][1]])
                idle = 0 if new > got else idle + 1
                if not idle:
                    got, span[end] = new, at
                at += step
            out = [min(out[0], span[0]), max(out[1], span[1])]
    return out[0], out[1]


def blocks(text: str) -> list[tuple[int, str]]:
    """(place, text) of the candidate blocks: marked lines with those between marks up to three lines apart, extended; in overlapping windows if long."""
    low = text.lower()
    if len(low) != len(text):  # lower-casing changed lengths; marks are plain letters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if not any(m in low for m in MARKS):
        return []
    lines, at = [], 0
    for line in low.split("\n"):
        lines.append((at, at + len(line), any(m in line for m in MARKS)))
        at += len(line) + 1
    marked = [k for k, x in enumerate(lines) if x[2]]
    spans: list[list[int]] = []
    for k in marked:
        if spans and k - spans[-1][1] <= 3:
            spans[-1][1] = k
        else:
            spans.append([k, k])
    whole: list[list[int]] = []
    for first, last in spans:
        first, last = max(first - 1, 0), min(last + 2, len(lines) - 1)
        if lines[last][1] - lines[first][0] <= BLOCK_CHARS:
            first, last = _extended(text, lines, first, last)
        if whole and first <= whole[-1][1]:  # grown together
            whole[-1] = [min(first, whole[-1][0]), max(last, whole[-1][1])]
        else:
            whole.append([first, last])
    out = []
    for first, last in whole:
        a, b = lines[first][0], lines[last][1]
        while b - a > BLOCK_CHARS:
            marks = [x for x in (low.find(m, a, b) for m in MARKS) if x >= 0]
            if not marks:
                a = b
                break
            a = max(a, min(marks) - BLOCK_CHARS // 4)
            out.append((a, text[a : a + BLOCK_CHARS]))
            a += BLOCK_CHARS // 2
        if b > a:
            out.append((a, text[a:b]))
    return out


def scan(text: str) -> list[tuple[str, int, int, int, int, int, str]]:
    """(license, template, saved, from, to, differences, wording) of the notices in a text, in order; places in code points."""
    found: dict[tuple[int, int], tuple] = {}
    for base, block in blocks(text):
        own = words(block)
        plain = [w for w, _, _ in own]
        left = block
        # notices are confirmed one after another; each is taken out before the templates are ranked again
        while True:
            best = None
            for saved, k in savings(left):
                if saved < LEAST_SAVED:
                    break
                name, _, wanted, named, _ = _templates()[k]
                differences, first, end, said = align(wanted, plain)
                strict = [s for s in said if any(c.isdigit() for c in s) or any(w in named for w in re.split(r"[>+-]", s))]
                if end > first and differences <= LOOSE * len(wanted) and not strict and (best is None or (differences, -len(wanted)) < best[0]):
                    best = (differences, -len(wanted)), name, k, saved, first, end, " ".join(said)
            if best is None:
                break
            (differences, _), name, k, saved, first, end, said = best
            a, b = own[first][1], own[end - 1][2]
            found.setdefault((base + a, base + b), (name, k, saved, base + a, base + b, differences, said))
            plain[first:end] = [" "] * (end - first)
            left = left[:a] + " " * (b - a) + left[b:]
    return [found[k] for k in sorted(found)]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for every notice found in ``docs(doc_id, text)``: which licence, where, how many bytes its template saved, and the differences.

    Null and empty texts hold none; long texts are read whole, block by block; of templates that fit equally well the longer, then the first, counts;
    repeated rows are each reported; a null doc_id stays null; other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, license string, template int, saved_bytes int, first_char long, end_char long, differences int, wording string"

    def run(batches):
        for batch in batches:
            out = []
            for i, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                out += [(i.as_py(), *x) for x in scan(text.as_py() or "")]
            if out:
                types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
                names = ["doc_id", "license", "template", "saved_bytes", "first_char", "end_char", "differences", "wording"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return pick(docs, doc_id="long", text="string").mapInArrow(run, schema)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in the whole of ``documents``."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
