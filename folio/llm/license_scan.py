"""License scans by conditional compression, confirmed by wording."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public licence notices as they are commonly written, and the paragraphs that the full texts open with or differ by.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "This work is marked with CC0 1.0 Universal."),
)
#: Words without which no template can match: a block is a candidate if it has one of them.
CUES = r"(?i)licen[cs]e|copyright|permission|redistribution|redistribute|public domain|creative commons|unencumbered|mozilla|eclipse|\bCC0?\b"
#: What tokens() drops between two words: white space, also that of Unicode, and marks.
BETWEEN = r"""[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000.,;:()"'!?\[\]{}<>*#|]+"""
#: The cues for whole texts as they are, where two words may be wrapped: all that is_cue() can find in them, or more.
RAW_CUES = CUES.replace(" ", BETWEEN).replace("(?i)", "(?iu)")
#: The least part of its size that a block must lose.
LEAST_GAIN = 0.2
#: Words that may differ, as a part of the template's; and the same when each word counts the more, the fewer licences use it.
DIFFERENT = 0.2
TELLING = 0.25
#: A notice just behind one of these, or with one of them put in, says the contrary.
NEGATIONS = frozenset(("not", "never", "isn't", "aren't", "cannot", "no"))
#: Words of a block on each side of a cue, and of the stretches that are compressed alone.
REACH = 48
NEAR = 10


def tokens(text: str) -> list[str]:
    return [w for w in (x.strip(".,;:()\"'!?[]{}<>*#|").lower() for x in text.split()) if w]


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    text: bytes


@cache
def templates() -> tuple[Template, ...]:
    return tuple(Template(name, tuple(tokens(text)), " ".join(tokens(text)).encode()) for name, text in TEMPLATES)


@cache
def weights() -> dict[str, float]:
    """How much a word of the templates tells: the logarithm of all licences by those that use it."""
    users: dict[str, set[str]] = {}
    for t in templates():
        for w in t.words:
            users.setdefault(w, set()).add(t.name)
    n = len({t.name for t in templates()})
    return {w: math.log((n + 1) / len(names)) for w, names in users.items()}


@cache
def compressors() -> tuple[zstandard.ZstdCompressor, tuple[zstandard.ZstdCompressor, ...]]:
    """Without a template, and with each as a raw dictionary; without frame fields, which would count for short blocks."""
    how = {"write_content_size": False, "write_checksum": False, "write_dict_id": False, "level": 19}
    with_each = tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(t.text, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **how) for t in templates())
    return zstandard.ZstdCompressor(**how), with_each


def ranked(block: list[str]) -> list[tuple[float, int]]:
    """Templates by how much smaller the block is when compressed behind them, as a part of the smaller of its own
    size and the template's. The few words around a cue are compressed alone too, as in a long block other words
    cover the gain of a short notice; the better gain counts."""
    plain, with_each = compressors()
    near = [block[max(0, i - NEAR) : i + NEAR + 1] for i in range(len(block)) if is_cue(block, i)]
    best = [0.0] * len(with_each)
    for part in {" ".join(x) for x in (block, *near)}:
        text = part.encode()
        size = len(plain.compress(text))
        for i, (c, t) in enumerate(zip(with_each, templates(), strict=True)):
            best[i] = max(best[i], (size - len(c.compress(text))) / min(size, len(t.text)))
    return [(g, -i) for g, i in sorted(((g, -i) for i, g in enumerate(best)), reverse=True) if g >= LEAST_GAIN]


def aligned(template: tuple[str, ...], block: list[str]) -> tuple[int, int, int, list[str], list[str]]:
    """The cheapest way to turn the template into a stretch of the block: number of differing words, the stretch's start
    and end, the differences, and the template's words that differ."""
    m, n = len(template), len(block)
    cost = [[0] * (n + 1)]
    for i in range(1, m + 1):
        row, above = [i] + [0] * n, cost[-1]
        for j in range(1, n + 1):
            row[j] = above[j - 1] if template[i - 1] == block[j - 1] else 1 + min(above[j - 1], above[j], row[j - 1])
        cost.append(row)
    end = min(range(n + 1), key=lambda j: (cost[m][j], j))
    i, j, changes, lost = m, end, [], []
    while i:
        if j and template[i - 1] == block[j - 1] and cost[i][j] == cost[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif j and cost[i][j] == 1 + cost[i - 1][j - 1]:
            changes.append(f"{template[i - 1]}>{block[j - 1]}")
            lost.append(template[i - 1])
            i, j = i - 1, j - 1
        elif cost[i][j] == 1 + cost[i - 1][j]:
            changes.append(f"-{template[i - 1]}")
            lost.append(template[i - 1])
            i -= 1
        else:
            changes.append(f"+{block[j - 1]}")
            j -= 1
    return cost[m][end], j, end, changes[::-1], lost


def says(template: tuple[str, ...], block: list[str], cost: int, start: int, changes: list[str], lost: list[str]) -> bool:
    """Whether the differences leave the notice what it is: few, not in the words that tell licences apart, in no version
    number, and no negation."""
    if cost > DIFFERENT * len(template) or any(c.isdigit() for w in lost for c in w):
        return False
    if sum(weights()[w] for w in lost) > TELLING * sum(weights()[w] for w in template):
        return False
    put_in = {c.rpartition(">")[2].lstrip("+") for c in changes if c[0] != "-"}
    return NEGATIONS.isdisjoint(put_in | set(block[max(0, start - 2) : start]))


def is_cue(words: list[str], i: int) -> bool:
    return bool(re.search(CUES, " ".join(words[i : i + 2])))


def blocks(words: list[str]) -> list[tuple[int, int]]:
    """The stretches of a text's words around its cues, lines and all."""
    out: list[list[int]] = []
    for i in (i for i in range(len(words)) if is_cue(words, i)):
        low, high = max(0, i - REACH), min(len(words), i + REACH + 1)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def confirmed(block: list[str], near: list[str]) -> tuple[str, float, int, str, int, int] | None:
    """The notice in a block, before which the words `near` stand: licence, gain, differing words, differences, start and
    end; the one with most equal words."""
    best, k = None, len(near)
    for gain, i in ranked(block):
        t = templates()[i]
        cost, start, end, changes, lost = aligned(t.words, block)
        if says(t.words, near + block, cost, start + k, changes, lost):
            key = (cost - len(t.words), -gain, i)
            if best is None or key < best[0]:
                best = (key, (t.name, round(gain, 6), cost, " ".join(changes), start, end))
    return best and best[1]


def findings(text: str) -> list[tuple[int, str, float, int, str]]:
    """(first word, licence, gain, differing words, differences) for each notice in a text, in order."""
    words, found = tokens(text), []
    queue = blocks(words)
    while queue:
        low, high = queue.pop(0)
        # A long stretch is looked at in overlapping parts, so that a notice of any template is whole in one of them.
        if high - low > 4 * REACH:
            queue[:0] = [(low, low + 4 * REACH), (low + 2 * REACH, high)]
            continue
        if (got := confirmed(words[low:high], words[max(0, low - 2) : low])) is None:
            continue
        name, gain, cost, changes, start, end = got
        found.append((low + start, name, gain, cost, changes))
        beside = [(low, low + start), (low + end, high)]
        queue[:0] = [(a, b) for a, b in beside if any(is_cue(words, i) for i in range(a, b))]
    return sorted(set(found))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licence notices in every whole text: doc_id, word (the number of its first word, from 0), license, gain, n_different, differences.

    Texts without a cue word are left out before Python. Around each cue, the block of words is compressed with
    each template as a raw dictionary; all that save enough are aligned with the block word by word. A notice
    counts if at most a fifth of the template's words differ, at most a quarter where a word counts the more, the fewer
    licences use it, no word with a digit differs, and it isn't negated. What stands beside a notice in the block is
    looked at again. No shuffle.

    Null and empty texts have no notices. Long texts are read whole, around their cues. Rows that repeat are scanned each; an
    empty table gives an empty result; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, t in enumerate(b.column(1)):
                for f in findings(t.as_py()):
                    rows.append(i), out.append(f)
            word, name, gain, cost, changes = zip(*out, strict=True) if out else ((),) * 5
            yield pa.record_batch({"doc_id": b.column(0).take(pa.array(rows, pa.int64())), "word": pa.array(word, pa.int32()), "license": pa.array(name, pa.string()), "gain": pa.array(gain, pa.float64()), "n_different": pa.array(cost, pa.int32()), "differences": pa.array(changes, pa.string())})

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").rlike(RAW_CUES))
    return chosen.mapInArrow(scan, "doc_id long, word int, license string, gain double, n_different int, differences string")
