"""The training-data operators against brute force, on small tables that hold the hard cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from folio.llm import (
    blocks,
    common,
    exact_dedup,
    kernels,
    language_id,
    license_scan,
    mixing,
    near_dedup,
    packing,
    prefix_join,
    queries,
    substring_dedup,
    suffix_dedup,
    tokens,
    topk,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = " \t\n\x0b\x0c\r"


def corpus(n: int = 120, seed: int = 1) -> list[tuple]:
    """Texts with copies, near copies, a shared passage, repeats inside, other white space, odd characters, nulls and empties."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    out: list[str | None] = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 150))]
        kind = i % 10
        if kind == 1 and out[i - 1]:
            text = out[i - 1].replace(" ", " \n", 3)
        elif kind == 2 and out[i - 2]:
            words = out[i - 2].split()
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif kind in (3, 4):
            text = " ".join(words[:30]) + " " + passage + " " + " ".join(words[30:])
        elif kind == 5:
            text = " ".join(words[:20] * 12)
        elif kind == 6:
            text = rng.choice([None, "", " \t\n", "a b", " x y", "<|endoftext|> hi", "ตัวอย่าง \U0001f600", "1 2 3"])
        else:
            text = rng.choice(SPACES).join(words)
        out.append(text)
    out.append(" ".join(rng.choice(vocabulary) for _ in range(6000)))
    return [(i, t, "xx" if i % 2 else "yy", [None, "b", "a", "é"][i % 4] if i % 3 else "hot", len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3, "doc_id").withColumnRenamed("n_chars", "sha")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def by_id(df, key: str = "doc_id") -> dict:
    return {r[key]: r for r in df.collect()}


# --- 1 -----------------------------------------------------------------------------------------------------------


def test_exact_dedup(docs, rows):
    norm = {i: re.sub(f"[{SPACES}]+", " ", t or "") for i, t, *_ in rows}
    first, size = {}, Counter(norm.values())
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    got = by_id(exact_dedup.exact_dedup(docs))
    assert {i: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for i, r in got.items()} == {i: (first[t], size[t], first[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def test_exact_dedup_ties(spark, empty):
    df = spark.createDataFrame([(None, "x"), (5, "x"), (5, "x"), (7, "x"), (None, None), (3, "")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == 6 and sum(r["kept"] for r in got) == 2
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(5, 4), (3, 2)}
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.keep_first(empty).count() == 0


def test_exact_dedup_is_native(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 2 and 3 -----------------------------------------------------------------------------------------------------


def windows_removed(texts: dict[int, list[bytes]], size: int) -> dict[int, list[bool]]:
    first: dict[tuple, int] = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - size + 1):
            first.setdefault(tuple(texts[i][k : k + size]), i)
    out = {}
    for i, w in texts.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out[i] = gone
    return out


@pytest.mark.parametrize("hash_bits", [64, 9])
def test_substring_dedup(docs, rows, empty, monkeypatch, hash_bits):
    """Nine bits make windows of unequal words share hashes; what goes is the same."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(blocks, "LARGE_BLOCK", 20_000)
    texts = {i: words(t) for i, t, *_ in rows}
    gone = windows_removed(texts, 13)
    got = by_id(substring_dedup.substring_dedup(docs, hash_bits=hash_bits))
    want = {i: (len(w), sum(gone[i]), b" ".join(x for x, g in zip(w, gone[i], strict=True) if not g).decode()) for i, w in texts.items()}
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == want
    for i, r in got.items():
        covered = [False] * r["n_words"]
        for f in r["factors"]:
            covered[f["start"] : f["start"] + f["n_words"]] = [True] * f["n_words"]
            factor, source = texts[i][f["start"] : f["start"] + f["n_words"]], texts[f["reference"]]
            assert f["reference"] < i and f["n_words"] >= 13
            assert all(any(source[p : p + 13] == factor[k : k + 13] for p in range(len(source) - 12)) for k in range(len(factor) - 12))
        assert covered == gone[i]
        if hash_bits == 64:
            assert all(a["start"] + a["n_words"] < b["start"] + b["n_words"] for a, b in zip(r["factors"], r["factors"][1:], strict=False))
    assert sum(r["n_removed"] for r in got.values()) > 500
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short text"), (3, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["n_removed"]) for r in substring_dedup.substring_dedup(df).collect()]
    assert sorted(got, key=str) == [(1, 0), (1, 0), (2, 0), (3, 0), (None, 20)]


@pytest.mark.parametrize("partitions", [1, 3, 4])
def test_substring_dedup_of_ids_repeated_over_blocks(spark, partitions):
    """Words that follow a copied window only in a row of the same identifier stay."""
    w, x = ([f"{c}{i}" for i in range(20)] for c in "wx")
    texts = [(1, w), (5, w + x), (5, w + x), (6, w[8:] + x), (None, w + x), (None, x + w)]
    rows = [(i, " ".join(t)) for i, t in texts]
    seen = defaultdict(lambda: math.inf)
    for i, t in texts:
        for k in range(len(t) - 12):
            seen[tuple(t[k : k + 13])] = min(seen[tuple(t[k : k + 13])], math.inf if i is None else i)
    want = []
    for i, t in texts:
        gone = {j for k in range(len(t) - 12) if seen[tuple(t[k : k + 13])] < (math.inf if i is None else i) for j in range(k, k + 13)}
        want.append((str(i), len(gone), " ".join(x for k, x in enumerate(t) if k not in gone)))
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions))
    assert sorted((str(r["doc_id"]), r["n_removed"], r["kept"]) for r in got.collect()) == sorted(want)


def bytes_removed(texts: dict[int, bytes], size: int) -> dict[int, np.ndarray]:
    seen = Counter(t[k : k + size] for t in texts.values() for k in range(len(t) - size + 1))
    out = {}
    for i, t in texts.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                gone[k : k + size] = True
        out[i] = gone
    return out


@pytest.mark.parametrize(("length", "most"), [(400, suffix_dedup.SORTED), (64, suffix_dedup.SORTED), (64, 3)])
def test_suffix_dedup(docs, rows, length, most):
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    gone = bytes_removed(texts, length)

    def spans(g: np.ndarray) -> list[tuple[int, int]]:
        edge = np.flatnonzero(np.diff(np.r_[0, g.astype(int), 0]))
        return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))

    want = {i: (len(t), spans(gone[i]), np.frombuffer(t, np.uint8)[~gone[i]].tobytes()) for i, t in texts.items()}
    got = by_id(suffix_dedup.suffix_dedup(docs, length, most=most, passage=100))
    assert {i: (r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for i, r in got.items()} == want
    assert {i: [tuple(s) for s in r["passages"]] for i, r in got.items()} == {i: spans(g) for i, g in bytes_removed(texts, 100).items()}


def test_suffix_dedup_deals_hot_anchors(spark):
    """One passage in every document, so each of its anchors occurs as often as there are documents."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(90))
    texts = {i: f"{' '.join(word() for _ in range(rng.randint(0, 9)))} {passage} {' '.join(word() for _ in range(rng.randint(0, 9)))}".encode() for i in range(60)}
    df = spark.createDataFrame([(i, t.decode()) for i, t in texts.items()], "doc_id long, text string").repartition(5)
    want = {i: np.frombuffer(t, np.uint8)[~g].tobytes() for (i, t), g in zip(texts.items(), bytes_removed(texts, 400).values(), strict=True)}
    for most in (suffix_dedup.SORTED, 20, 1):
        assert {i: bytes(r["kept"]) for i, r in by_id(suffix_dedup.suffix_dedup(df, most=most)).items()} == want


def test_suffix_dedup_odd_cases(spark, empty):
    df = spark.createDataFrame([(1, "a" * 1000), (2, "ab" * 250), (3, None), (None, "x" * 399), (5, "y" * 400), (6, "y" * 400)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], sum(s["length"] for s in r["spans"]), len(r["spans"])) for r in suffix_dedup.suffix_dedup(df).collect()}
    assert got == {1: (1000, 1000, 1), 2: (500, 500, 1), 3: (0, 0, 0), None: (399, 0, 0), 5: (400, 400, 1), 6: (400, 400, 1)}
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_merge_gives_sorted_suffixes_and_prefixes():
    rng = random.Random(4)
    runs, everything = [], []
    for k in range(7):
        mine = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30)))
        everything += mine
        runs.append(suffix_dedup.Run(*suffix_dedup.front_coded(mine), k))
    got = [(s, h) for s, h, *_ in suffix_dedup.merged(runs)]
    assert [s for s, _ in got] == sorted(everything)
    assert all(h == kernels.common(a, b) for (a, _), (b, h) in zip(got, got[1:], strict=False))


def merged_parts(texts: list[bytes], lengths: tuple[int, int], bits: int, per_block: int = 40) -> tuple[dict, list]:
    """Each text's removed bytes for each of the lengths, of blocks made and merged without Spark; and the parts' runs."""
    made = []
    for k in range(0, len(texts), per_block):
        raw = b"".join(texts[k : k + per_block])
        offsets = np.cumsum([0, *map(len, texts[k : k + per_block])])
        made.append(SimpleNamespace(number=len(made), offsets=offsets, raw=raw, data=np.frombuffer(raw, np.uint8), ids=np.arange(k, k + len(offsets) - 1)))
    total = Counter()
    for b in made:
        for key, n in zip(*suffix_dedup.anchor_counts(b, min(lengths)), strict=True):
            total[int(key)] += int(n)
    keys = np.array(sorted(k for k, n in total.items() if n > 1), np.uint64)
    counts = np.array([total[int(k)] for k in keys], np.int64)
    runs = pa.concat_tables(suffix_dedup.suffix_runs(b, keys, counts, min(lengths), max(lengths), bits, suffix_dedup.SORTED) for b in made)
    part = runs.column("part").to_numpy()
    parts = [runs.filter(pa.array(part == p)) for p in np.unique(part)]
    spans = [(row, suffix_dedup.merge_part(t, lengths, bits)) for row, t in enumerate(parts)]
    gone = {}
    for b in made:
        mine = [[blocks.decoded(t.column(f"e{k}")[i].as_py(), w) for k, w in enumerate(("u8", "i8", "u1"))] for _, t in spans for i in range(t.num_rows) if t.column("block")[i].as_py() == b.number]
        start, end, kind = (np.concatenate(x) for x in zip(*mine, strict=True)) if mine else np.empty((3, 0), np.int64)
        for q, length in enumerate(lengths):
            on, _ = suffix_dedup.covered(b, start[kind == q].astype(np.int64), end[kind == q])
            gone |= {(int(i), length): on[s:e] for i, s, e in zip(b.ids, b.offsets[:-1], b.offsets[1:], strict=True)}
    return gone, parts


@pytest.mark.parametrize(("bits", "held"), [(0, suffix_dedup.MERGED_BYTES), (3, 2000)])
def test_suffix_parts_merged_some_bytes_at_once(monkeypatch, bits, held):
    """Texts of few letters, zero bytes among them, with passages copied whole and in part."""
    monkeypatch.setattr(suffix_dedup, "MERGED_BYTES", held)
    rng = random.Random(11)
    some = lambda n: bytes(rng.choice(b"\0\0\1a") for _ in range(n))
    passages = [some(rng.randint(30, 160)) for _ in range(9)]
    texts = [b"".join(rng.choice([some(rng.randint(0, 60)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 20) :]]) for _ in range(rng.randint(0, 6))) for _ in range(150)]
    gone, _ = merged_parts(texts, (40, 64), bits)
    for length in (40, 64):
        want = bytes_removed(dict(enumerate(texts)), length)
        assert want and all((gone[i, length] == g).all() for i, g in want.items())


def test_suffix_merge_does_not_work_group_by_group():
    """Three hundred passages, each in two texts: merging their groups takes few calls a suffix and not hundreds a group."""
    rng = random.Random(12)
    passages = [bytes(rng.choice(b"abcdefgh") for _ in range(450)) for _ in range(300)]
    gone, parts = merged_parts([*passages, *passages], (250, 400), 0)
    assert all(g.all() for g in gone.values())
    calls = [0]

    def count(frame: object, event: str, arg: object) -> None:
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        suffix_dedup.merge_part(parts[0], (250, 400), 0)
    finally:
        sys.setprofile(None)
    suffixes = sum(len(x.as_py()) // 4 for x in parts[0].column("size"))
    assert suffixes > 1000 and calls[0] < 40 * suffixes


@pytest.mark.parametrize("steps", [0, 2, suffix_dedup.STEPS])
def test_copies_of_many_groups_at_once(steps):
    """Against each pair of members of a group; members that look further than `steps` are told by distances."""
    rng = random.Random(13)
    members = []
    for g in range(60):
        words = sorted((b"".join(rng.choice([b"a", b"ab"]) for _ in range(9))[: rng.randint(0, 9)], b"".join(rng.choice([b"a", b"ba"]) for _ in range(7))[: rng.randint(0, 7)]) for _ in range(rng.randint(1, 25)))
        members += [(g, *x, rng.random() < 0.1) for x in words]
    group, rights, lefts, several = (list(x) for x in zip(*members, strict=True))
    right = [-1] + [kernels.common(a, b) if g == h else -1 for g, h, a, b in zip(group, group[1:], rights, rights[1:], strict=False)]
    lengths = (8, 10)
    found = suffix_dedup.copied_in_groups(np.array(group), np.array(right), np.array([len(x) for x in rights]), lefts, np.array(several), lengths, steps)
    got, want = set(), set()
    for who, lo, hi, kind in found.T.tolist():
        got |= {(who, d, kind) for d in range(lo, hi + 1)}
    for i, (g, r, x, alone) in enumerate(members):
        for kind, length in enumerate(lengths):
            for d in range(max(0, length - len(r)), len(x) + 1):
                string = lambda m, d=d, length=length: (m[2][:d], m[1][: length - d]) if len(m[2]) >= d and len(m[1]) >= length - d else None
                if alone or any(j != i and m[0] == g and string(m) == string(members[i]) for j, m in enumerate(members)):
                    want.add((i, d, kind))
    assert got == want and want


def test_commons_of_neighbours():
    rng = random.Random(14)
    strings = [bytes(rng.choice(b"\0\0\0a") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    want = [kernels.common(a, b) for a, b in zip(strings, strings[1:], strict=False)]
    assert kernels.commons(strings).tolist() == kernels.commons(strings, 7).tolist() == want
    assert kernels.commons([b"", b""]).tolist() == [0] and not len(kernels.commons([b"a"])) and not len(kernels.commons([]))


# --- 4 -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released under the MIT License.", ["MIT"]),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("x " * 200 + "Licensed under CC BY-NC 4.0. " + "y " * 200 + "This work is licensed under the GNU General Public License, version 3.", ["CC-BY-NC-4.0", "GPL-3.0"]),
        ("This program is free software: you can redistribute it\n# and/or modify it under the terms of the GNU General Public License as published by the\nFree Software Foundation, either version 3 of the License, or (at your option) any later version.", ["GPL-3.0"]),
        ("the license plate of a car and its copyright", []),
        ("Licensed under CC BY-SA 4.0 and Released under the MIT License", ["CC-BY-SA-4.0", "MIT"]),
        ("é" * 3000, []),
        ("This is not licensed under the MIT License.", []),
        ("It was never released under the MIT License, but Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Licensed under the Foo License, Version 2.0.", []),
        ("Licensed under the Foo License.", []),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1"]),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["AGPL-3.0"]),
        ("This file is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
    ],
)
def test_license_findings(text, want):
    assert [f[1] for f in license_scan.findings(text)] == want


def test_license_behind_better_ranked_templates():
    filler = [f"filler{i}" for i in range(15)]
    bsd = "Redistribution and use in source and binary changed with or without changed are permitted provided that the following conditions changed met".split()
    unlisted = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 9 of the License, or (at your option) any later version."
    listed = unlisted.replace("version 9", "version 2.1")
    assert [f[1] for f in license_scan.findings(" ".join([*filler, *bsd, *filler, unlisted]))] == ["BSD"]
    assert [f[1] for f in license_scan.findings(" ".join([*filler, *bsd, *filler, listed]))] == ["BSD", "LGPL-2.1"]
    assert [f[1] for f in license_scan.findings("Licensed under CC BY-NC-ND 4.0.")] == ["CC-BY-NC-ND-4.0"]


def test_license_scan_against_every_template(spark, monkeypatch):
    """Each template as it is and with a word changed, between other words, and texts of the tables: the ranking by size
    loses no notice that aligning every template with every block finds."""
    rng = random.Random(5)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in license_scan.templates():
        assert any(license_scan.is_cue(list(t.words), i) for i in range(len(t.words)))
        for changed in (None, rng.randrange(len(t.words))):
            mine = [f"filler{rng.randrange(99)}" if i == changed else w for i, w in enumerate(t.words)]
            texts.append(" ".join([*(f"before{i}" for i in range(12)), *mine, *(f"after{i}" for i in range(12))]))
    found = [[(f[0], f[1], f[3], f[4]) for f in license_scan.findings(t or "")] for t in texts]
    exact = found[-2 * len(license_scan.templates()) :: 2]
    assert [x[0][1] for x in exact] == [t.name for t in license_scan.templates()]
    monkeypatch.setattr(license_scan, "ranked", lambda block: [(0.0, i) for i in range(len(license_scan.templates()))])
    assert found == [[(f[0], f[1], f[3], f[4]) for f in license_scan.findings(t or "")] for t in texts]
    assert sum(map(len, found)) > 2 * len(license_scan.templates()) * 0.7


def test_license_notices_may_be_wrapped(spark):
    between = ("\n", "  ", "\n# ", "\xa0", "\u2003", "\x1f")
    rows = [(i, f"This is free and unlimited software released into the public{x}domain.".replace("unlimited", "unencumbered")) for i, x in enumerate(between)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["license"]) for r in license_scan.license_scan(df).collect()) == [(i, "Unlicense") for i in range(len(between))]
    two = [f"{a}{x}{b}" for a, b in (("public", "domain"), ("Creative", "Commons")) for x in between]
    found = spark.createDataFrame([(t,) for t in two], "t string").filter(license_scan.F.col("t").rlike(license_scan.RAW_CUES))
    assert found.count() == len(two) and all(license_scan.is_cue(license_scan.tokens(t), 0) for t in two)


def test_license_differences(spark, empty):
    got = license_scan.findings('Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction')
    assert [(f[1], f[3], f[4]) for f in got] == [("MIT", 1, "obtaining>getting")]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (None, "Licensed under CC BY 4.0.")], "doc_id long, text string")
    assert [(r["doc_id"], r["license"], r["n_different"]) for r in license_scan.license_scan(df).collect()] == [(3, "MIT", 0)] * 2 + [(None, "CC-BY-4.0", 0)]
    assert license_scan.license_scan(empty).count() == 0


# --- 5 and 9 -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_vocabulary())


def test_token_counts(docs, rows, library, empty):
    got = by_id(tokens.token_counts(docs, 100))
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows}
    assert {i: r["n_tokens"] for i, r in got.items()} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) and r["n_bytes"] == len((rows[i][1] or "").encode()) for i, r in got.items())
    assert tokens.token_counts(empty).count() == 0


def test_encoder_equals_library_on_every_plain_character(library):
    enc = tokens.encoder(tokens.default_vocabulary())
    for cp in [*range(0x3000), *range(0x4E00, 0x4E80), *range(0xAC00, 0xAC40), 0x1F600, 0x10FFFF, 0xFFFD]:
        s = f"a{chr(cp)}1{chr(cp)} !{chr(cp)}  {chr(cp)}b"
        ids = library.encode(s, add_special_tokens=False).ids
        assert enc.count(s) == len(ids) and enc.encode(s).tolist() == ids, hex(cp)


def test_whole_tokens_are_proved():
    enc = tokens.encoder(tokens.default_vocabulary())
    assert len(enc.whole) > 45_000 and " the" in enc.whole and all(len(x) == 4 for x in enc.whole.values())


def test_packing(docs, rows, library, empty):
    got = packing.pack(docs, 128).toPandas()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in rows}
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("piece")
        assert g["piece"].tolist() == list(range(len(g))) and g["start"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
        assert g["length"].sum() == len(ids[i]) and (g["length"].iloc[1:] == 128).all() and g["length"].max() <= 128
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes())
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 128
    assert set(got["doc_id"]) == set(ids)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("run", [" ", "\n", "a", "!", "\u00e9"])
def test_packing_of_long_runs(spark, library, run):
    """Two million of one character: regex engines that backtrack give up on such runs."""
    text = "a" + run * 2_000_000 + "b"
    ids = [*library.encode(text, add_special_tokens=False).ids, 2]
    got = packing.pack(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, row_no string")).toPandas().sort_values("piece")
    assert got["length"].sum() == len(ids)
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_sequences_round_trip(docs, rows, library):
    places = packing.pack(docs, 128).toPandas()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in rows}
    whole = {r["sequence_id"]: list(r["ids"]) for r in packing.sequences(docs, capacity=128).collect()}
    assert set(whole) == set(places["sequence_id"])
    for r in places.itertuples():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == ids[r.doc_id][r.start : r.start + r.length]


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 50) for _ in range(400)] + [50] * 80
    plan = packing.best_fit_plan(Counter(lengths), 50)
    loads: dict[int, list] = defaultdict(list)
    for (n, rank, seq, offset), nxt in zip(plan.tolist(), [*plan.tolist()[1:], None], strict=True):
        until = nxt[1] if nxt and nxt[0] == n else Counter(lengths)[n]
        for k in range(until - rank):
            loads[seq + k].append((offset, n))
    left: list[int] = []  # plain best fit, one at a time
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(left) if r >= n]
        if fits:
            k = min(fits, key=left.__getitem__)
            left[k] -= n
        else:
            left.append(50 - n)
    assert len(loads) == len(left)
    for x in loads.values():
        x.sort()
        assert [o for o, _ in x] == [0, *np.cumsum([n for _, n in x])[:-1]] and sum(n for _, n in x) <= 50
    assert packing.best_fit_plan({}, 50).shape == (0, 4)


# --- 6 -----------------------------------------------------------------------------------------------------------


def test_language_id(spark, empty):
    rng, letters = random.Random(2), {"aa": "abcd", "bb": "cdef", "cc": "efgh", "dd": "ghij", "ee": "ijkl", "ff": "klmn", "gg": "mnop", "hh": "opqr", "ii": "qrst"}
    make = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(40))
    rows = [(i, make(lang), lang) for i, lang in enumerate(list(letters) * 40)]
    rows += [(9000, None, "aa"), (9001, "123 !", "bb"), (9002, "", None), (9003, make("cc") * 500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df.filter(~language_id.is_held_out()))
    assert model.languages == sorted(letters)
    got = by_id(language_id.identify(df, model))
    held = {r[0] for r in df.filter(language_id.is_held_out()).select("doc_id").collect()}
    assert held == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [got[i]["lang_pred"] == lang for i, _, lang in rows[:-4] if i in held]
    assert len(right) > 50 and np.mean(right) > 0.97
    assert [got[i]["lang_pred"] for i in (9000, 9001, 9002, 9003)] == ["und", "und", "und", "cc"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.keep_identified(df, model).count() == len(rows) - 3
    nothing = language_id.train(empty)
    assert {r["lang_pred"] for r in language_id.identify(df, nothing).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_kept_rows_are_those_identified(spark):
    rows = [(i, x * 30, lang) for i, (x, lang) in enumerate([("abc abd ", "aa"), ("xyz xzz ", "und")] * 40)] + [(900, "12", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    named = {i for i, r in by_id(language_id.identify(df, model)).items() if r["lang_pred"] != "und"}
    assert set(by_id(language_id.keep_identified(df, model))) == named == set(range(0, 80, 2))


def test_language_stage_rejects_what_no_language_owns(spark):
    """A text with letters, half of one language and half of another, goes; a wanted language or a lower score is a parameter."""
    rows = [(i, x * 30, lang) for i, (x, lang) in enumerate([("abc abd ", "aa"), ("xyz xzz ", "bb"), ("mno mnn ", "cc")] * 30)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = [(500, "abc abd " * 20 + "xyz xzz " * 20 + "mno mnn " * 20, None), (501, "qrs tuv " * 20, None), (502, "abc abd " * 20, None), (503, None, None)]
    docs = spark.createDataFrame([*rows, *mixed], "doc_id long, text string, lang string")
    answers = by_id(language_id.identify(docs, model))
    assert answers[500]["lang_pred"] != "und" and answers[500]["score"] < 0.5
    kept = set(by_id(language_id.keep_identified(docs, model)))
    assert kept == {i for i, r in answers.items() if r["lang_pred"] != "und" and r["score"] >= 0.5} and set(range(90)) | {502} <= kept and not kept & {500, 501, 503}
    assert set(by_id(language_id.keep_identified(docs, model, languages=["aa"]))) == {*range(0, 90, 3), 502}
    assert set(by_id(language_id.keep_identified(docs, model, least_score=0))) == set(answers) - {503}


def test_language_sample_is_bounded_whatever_the_ids(spark, monkeypatch):
    """Rows without identifiers are drawn one by one, not all or none."""
    df = spark.range(0, 4000, 1, 4).selectExpr("CAST(NULL AS LONG) AS doc_id", "'abc abd' AS text", "IF(id % 4 = 0, 'aa', 'bb') AS lang")
    seen = spark.sparkContext.accumulator(0)
    whole = language_id.features

    def counted(data, *how):
        seen.add(1)
        return whole(data, *how)

    monkeypatch.setattr(language_id, "features", counted)
    assert language_id.train(df, train_rows=100).languages == ["aa", "bb"]
    assert 140 < seen.value < 260
    monkeypatch.setattr(language_id, "LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than 1"):
        language_id.train(df)


def test_decoding_by_hand():
    """decode() against loops over codewords, bits and features."""
    rng = np.random.default_rng(3)
    for k in (2, 3, 6, 9):
        code = language_id.codewords(k)
        model = language_id.Model([f"l{i}" for i in range(k)], code, rng.normal(size=(1 << language_id.FEATURE_BITS, code.shape[1])), rng.normal(size=code.shape[1]))
        for text in (b"some words here", b"x", b"", bytes(range(256)) * 3):
            counts = language_id.features(np.frombuffer(text, np.uint8))
            total, losses = max(1, int(counts.sum())), []
            for word in code.tolist():
                loss = 0.0
                for j, bit in enumerate(word):
                    margin = (sum(int(counts[f]) * model.weights[f, j] for f in np.flatnonzero(counts)) + model.bias[j]) / total
                    loss += math.log1p(math.exp(-bit * language_id.SCALE * margin))
                losses.append(loss / len(word))
            best = min(range(k), key=lambda i: (round(losses[i], 12), i))
            second = sorted(losses)[1]
            got, score, unsure = model.decode(counts)
            assert got == best and unsure == ((second - losses[best]) / second < language_id.AMBIGUOUS)
            assert score == pytest.approx(1 / sum(math.exp(-(x - losses[best]) * language_id.SCALE) for x in losses))


def test_codewords_differ():
    for k in (2, 3, 5, 7, 8, 40):
        c = language_id.codewords(k).astype(int)
        distances = (c.shape[1] - c @ c.T) // 2
        assert distances[~np.eye(k, dtype=bool)].min() >= (1 if k == 2 else max(2, c.shape[1] // 5) if k > 3 else 2)


def test_features_by_chunks():
    data = np.random.default_rng(0).integers(0, 256, 5000).astype(np.uint8)
    whole = language_id.features(data)
    old, language_id.CHUNK = language_id.CHUNK, 700
    try:
        assert (language_id.features(data) == whole).all()
    finally:
        language_id.CHUNK = old


# --- 7 -----------------------------------------------------------------------------------------------------------


def filled(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    left, total, out = set(range(len(sizes))), share * sum(sizes), [0.0] * len(sizes)
    while left:
        level = total / sum(weights[i] for i in left)
        over = [i for i in left if level * weights[i] > most * sizes[i]]
        if not over:
            for i in left:
                out[i] = level * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            total -= out[i]
            left.remove(i)
    return out


def test_mixing(docs, rows, empty):
    sizes: dict = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = dict(zip(order, filled([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5, 2), strict=True))
    got = by_id(mixing.mix(docs))
    taken: dict = defaultdict(int)
    for i, t, _, s, _ in rows:
        r = got[i]
        assert r["size"] == len(words(t)) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        assert r["taken"] <= 2 * r["size"] and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    longest = defaultdict(int)
    for _, t, _, s, _ in rows:
        longest[s] = max(longest[s], len(words(t)))
    assert all(abs(taken[s] - targets[s]) <= longest[s] / 2 + 1 for s in sizes)
    assert {i: r["taken"] for i, r in by_id(mixing.mix(docs.repartition(7))).items()} == {i: r["taken"] for i, r in got.items()}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    assert mixing.mixed_rows(docs).count() == sum(r["repeats"] for r in got.values())


def test_mixing_without_words(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, " ", "a")], "doc_id long, text string, source string")
    assert {(r["taken"], r["target"]) for r in mixing.mix(df).collect()} == {(0, 0.0)}


def test_mixing_passes_over_long_documents(spark):
    """Documents longer than the fraction, or than what is left of it, don't end it."""
    rows = [(i, "w " * 300, "a") for i in range(400)] + [(1000, "w " * 80_000, "a")] + [(2000 + i, "w " * 9000, "b") for i in range(4)] + [(3000 + i, "w " * 100, "b") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(25, 9), share=1.1).collect()
    for size in {r["source_size"] for r in got}:
        mine = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 150


@pytest.mark.parametrize("least", [40, 100_000])
def test_mixing_deals_null_and_repeated_ids(spark, monkeypatch, least):
    """A third of the rows without identifier and a third with one: their buckets are split, and the sums still are right."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", least)
    sizes, real = [], mixing._bucketed

    def seen(rows, total):
        out = real(rows, total)
        sizes.append(out.groupBy("key", "bucket").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(mixing, "_bucketed", seen)
    rows = [([None, 5, i][i % 3], "w " * (1 + i % 7), "a" if i % 2 else "b") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=1.3).collect()
    assert len(got) == 3000 and sizes[0] <= 5 * least
    for size in {r["source_size"] for r in got}:
        mine = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 4


# --- 8 -----------------------------------------------------------------------------------------------------------


def brute_top(rows, every: int, k: int) -> list[tuple]:
    fine = [(i, np.floor(np.array(v, float) * 256).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(fine):
        if i % every == 0:
            best = sorted((-int(q @ v), j) for other, (j, v) in enumerate(fine) if other != at and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_top_k(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=8) * (1 if i % 5 else 0)).tolist()) for i in range(400)]
    rows += [(1000, None), (1001, [1.0] * 7 + [None]), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (1050, [0.5] * 8), (1051, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k_of_every(df, 50, 5).collect())
    assert got == brute_top(rows, 50, 5)


def test_top_k_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k_of_every(spark.createDataFrame([], schema)).count() == 0
    two = topk.top_k_of_every(spark.createDataFrame([(0, [1.0, 2.0]), (7, [3.0, 4.0])], schema)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in two] == [(0, 1, 7)]


def test_bounds_hold():
    rng = np.random.default_rng(3)
    v, q = rng.integers(-300, 300, (500, 16)).astype(float), rng.integers(-300, 300, (20, 16)).astype(float)
    width = (v.max() - v.min()) / topk.CELLS
    cells = np.clip((v - v.min()) / width, 0, topk.CELLS - 1).astype(np.uint8)
    middle, slack = topk.cell_bounds(cells, v.min(), width, q)
    assert (np.abs(q @ v.T - middle) <= slack[:, None]).all()


def test_top_k_in_many_groups_reads_few_exact_vectors(spark, monkeypatch):
    """Queries and vectors of two lengths in many groups; the candidates are a small part of all pairs."""
    monkeypatch.setattr(topk, "QUERY_BYTES", 256)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=12 if i % 3 else 6).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k_of_every(df, 50, 5).collect())
    assert got == brute_top(rows, 50, 5)
    table = topk.materialize(topk.integer_vectors(df), "vectors")
    assert topk.candidates(table, table.filter("vec_id % 50 = 0"), 5).count() < 60 * 30


def test_top_k_of_many_equal_vectors(spark):
    """A third of the rows are one vector, the best for many queries: ties go by identifier, and only some are candidates."""
    rng = np.random.default_rng(4)
    rows = [(i, [3.0] * 6 if i % 3 == 0 else rng.normal(size=6).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k_of_every(df, 50, 5).collect())
    assert got == brute_top(rows, 50, 5)
    table = topk.materialize(topk.integer_vectors(df), "vectors")
    assert topk.few_of_each(table, 5).count() == 606


def test_top_k_repeated_ids_and_huge_components(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [1e13, 1.0]), (3, [1e13, 0.0]), (4, [])]
    got = topk.top_k_of_every(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0) == [(0, 1, 50), (0, 1, 50), (0, 2, 3), (0, 2, 3), (0, 3, 0), (0, 3, 0)]
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 50][-1] == (3, None)


# --- 10 ----------------------------------------------------------------------------------------------------------


def similar(texts: dict[int, str | None], least: float = 0.8) -> dict[int, int]:
    """The smallest identifier that links lead to, of each document."""
    bags = {}
    for i, t in texts.items():
        w = words(t)
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    root = {i: i for i in texts}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in texts if bags[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = bags[a], bags[b]
            both = sum((x & y).values())
            if both and both >= least * (x.total() + y.total() - both) - 1e-9:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in texts}


def test_near_dedup(docs, rows, empty):
    want = similar({i: t for i, t, *_ in rows})
    got = by_id(near_dedup.near_dedup(docs))
    assert {i: r["group_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (r["group_id"] == i) for i, r in got.items())
    assert len(set(want.values())) < len(want) - 15
    assert near_dedup.near_dedup(empty).count() == 0
    assert sorted(r["doc_id"] for r in near_dedup.keep_one_of_each_group(docs).collect()) == sorted(set(want.values()))


def test_near_dedup_large_groups(spark):
    """Copies of one text with up to seven changes: links form a net, and large buckets hold documents that aren't alike."""
    rng = random.Random(5)
    base, texts = [f"w{rng.randrange(500)}" for _ in range(120)], {}
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts[i + 3] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {i: r["group_id"] for i, r in by_id(near_dedup.near_dedup(df)).items()} == similar(texts)


def test_near_dedup_short_null_and_repeated(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a  b"), (5, "a c"), (6, "one two three four five six"), (6, "one two three four five six"), (None, "a b"), (8, "x x x x x x x x x x x x"), (9, "x x x x x x x x x x x")]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["group_id"]), r["kept"]) for r in got) == sorted(
        [("1", "1", True), ("2", "2", True), ("3", "3", True), ("4", "3", False), ("5", "5", True), ("6", "6", True), ("6", "6", False), ("None", "3", False), ("8", "8", True), ("9", "8", False)]
    )


def test_components_of_a_long_chain(spark, monkeypatch):
    """A chain of 10,000 nodes in rising order, a star and a ring; rounds are counted by the tables they write."""
    written, real = [], near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df, name, **how: (written.append(name), real(df, name, **how))[1])
    chain, star, ring = [(i, i + 1) for i in range(9999)], [(20_000, 20_001 + i) for i in range(500)], [(30_000 + i, 30_000 + (i + 1) % 7) for i in range(7)]
    got = near_dedup.components(spark.createDataFrame([(min(e), max(e)) for e in chain + star + ring], "a long, b long")).collect()
    roots = defaultdict(set)
    for r in got:
        roots[r["root"]].add(r["node"])
    assert sorted(map(len, roots.values())) == [7, 501, 10_000] and len(got) == 10_508
    assert written.count("point") < 20


def test_near_dedup_many_null_ids(spark):
    """A third of the rows without identifier; they are rows like others and meet nothing but their own texts."""
    rng = random.Random(8)
    rows = [(None if i % 3 else i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))) for i in range(6000)]
    rows += [(None, rows[1][1]), (None, rows[1][1] + " more")]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6002 and sum(not r["kept"] for r in got) == 2


def test_bag_minhash_is_unbiased():
    rng, errors = random.Random(3), []
    for _ in range(25):
        x = [rng.choice("abcdefgh") for _ in range(rng.randint(50, 300))]
        y = [c if rng.random() > 0.1 else "q" for c in x]
        bags = []
        for w in (x, y):
            data = np.frombuffer(" ".join(w).encode(), np.uint8)
            bags.append(near_dedup.shingles(data, np.array([0, len(data)])))
        a, b = (Counter(s[1].tolist()) for s in bags)
        exact = sum((a & b).values()) / sum((a | b).values())
        one, two = (near_dedup.bag_minhash(s[0], s[1], 1, 2000)[0] for s in bags)
        errors.append((one == two).mean() - exact)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.02


@pytest.mark.parametrize("holders", [50_000, 3])
def test_prefix_join_finds_all_links(spark, holders):
    rng, base = np.random.default_rng(1), np.random.default_rng(0).integers(0, 1 << 63, 80, dtype=np.uint64)
    bags = {}
    for i in range(60):
        v = base.copy()
        at = rng.choice(80, rng.integers(0, 14), replace=False)
        v[at] = rng.integers(0, 1 << 63, len(at), dtype=np.uint64)
        bags[i] = np.unique(v[: rng.integers(70, 81)])
    df = spark.createDataFrame([(i, i, i % 2 == 0, bytearray(v.tobytes())) for i, v in bags.items()], "node long, root long, probe boolean, bag binary")
    want = set()
    for a in bags:
        for b in bags:
            if a < b and (a % 2 == 0 or b % 2 == 0):
                both = len(np.intersect1d(bags[a], bags[b]))
                if both >= 0.8 * (len(bags[a]) + len(bags[b]) - both) - 1e-9:
                    want.add((a, b))
    old, prefix_join.HOLDERS = prefix_join.HOLDERS, holders
    try:
        found = {(r["a"], r["b"]) for r in prefix_join.candidates(df, 0.8).collect()}
    finally:
        prefix_join.HOLDERS = old
    assert want and want <= found


# --- shared ------------------------------------------------------------------------------------------------------


def test_words_of_kernels(rows):
    import pyarrow as pa

    texts = [t for _, t, *_ in rows]
    seen = []
    for at, offsets, data in kernels.text_groups(pa.array(texts, pa.string()), 3000):
        starts, ends, first = kernels.words(data, offsets)
        raw = data.tobytes()
        for k in range(len(at)):
            seen.append([raw[s:e] for s, e in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)])
    assert seen == [words(t) for t in texts]


def test_no_bytes_at_all(monkeypatch):
    """The first texts that a worker sees may be empty, all of them."""
    monkeypatch.setattr(kernels, "_powers", {})
    assert kernels.prefix(np.empty(0, np.uint8)).tolist() == [0] and len(kernels.powers(0)) == 0


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 200)
    for w in (1, 2, 3, 7, 10, 200, 201):
        assert kernels.sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(200 - w + 1)]


def test_blocks_hold_all_texts(docs, rows):
    found = {}
    for r in blocks.text_blocks(docs, size=2000).toArrow().to_batches():
        for i in range(r.num_rows):
            b = blocks.Block(r, i)
            for k, doc in enumerate(b.ids.tolist()):
                found[doc] = b.raw[b.offsets[k] : b.offsets[k + 1]]
    assert found == {i: (t or "").encode() for i, t, *_ in rows}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_gives_the_same(spark, name):
    from compare import DATA, connection, same_rows

    same_rows(queries.QUERIES[name](spark, str(DATA / "sf0.001")), connection("sf0.001"), queries.SQL[name])


def test_registered_queries_keep_their_contracts(spark):
    sf, n = "/root/testdata/sf0.001", 200
    for name, f in queries.QUERIES.items():
        df = f(spark, sf)
        if name not in ("op4_license_scan", "op8_exact_top_k", "op9_best_fit_packing", "op11_prefix_trie", "op13_conversation_repair"):
            assert df.count() == n, name
        want = [tuple(c.split(" ")) for c in CONTRACTS.get(name, "doc_id bigint").split(", ")]
        assert [c for c in df.dtypes if c[0] in dict(want)] == want, name


def test_stages_go_by_row(spark):
    """Repeated rows, one identifier for different texts, and null identifiers: no text is lost and no row multiplied."""
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(1, "twice the same row", "a"), (1, "twice the same row", "a"), (2, "copy", "a"), (3, "copy", "a"), (3, "good text of a repeated id", "a")]
    rows += [(None, "null one", "b"), (None, "null one", "b"), (None, "null two", "b"), (4, long, "b"), (5, long + " more", "b"), (5, "another text of five", "b"), (None, long + " less", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    exact = corpus_pipeline.drop_exact_copies(spark, df, "")
    kept = [r for i, r in enumerate(rows) if r not in rows[:i] and r != (3, "copy", "a")]
    assert Counter(map(tuple, exact.collect())) == Counter(kept)
    near = corpus_pipeline.drop_near_copies(spark, df, "")
    kept = [r for r in kept if r not in ((5, long + " more", "b"), (None, long + " less", "b"))]
    assert near.columns == df.columns and Counter(map(tuple, near.collect())) == Counter(kept)
    mixed = Counter(map(tuple, corpus_pipeline.mix_sources(spark, df, "").collect()))
    want: Counter = Counter()
    for r in mixing.mix(df.withColumn("n", mixing.row_number(None)), row_col="n").join(df.withColumn("row_no", mixing.row_number(None)).drop("doc_id"), "row_no").collect():
        want[r["doc_id"], r["text"], r["source"]] += r["repeats"]
    assert mixed == +want and any(i is None for i, *_ in mixed)


def test_stages_with_clashing_columns_and_without_rows(spark):
    """Columns named as those the stages put beside, only nulls, and no rows at all."""
    clash = "row_no string, times int, letter string, key string, bucket int, size int"
    rows = [(1, "some plain words", "xx", "a", 3, "r", 1, "l", "k", 2, 9), (1, "some plain words", "xx", "a", 3, "r", 1, "l", "k", 2, 9), (2, "other plain text", "yy", "b", 3, "r", 1, "l", "k", 2, 9)]
    nothing = [(None,) * 11] * 3
    for data, left in ((rows, 2), (nothing, 0), ([], 0)):
        out = spark.createDataFrame(data, f"{DOCS}, {clash}")
        columns = out.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, "")
            assert out.columns == columns
        assert {r["doc_id"] for r in out.collect()} == ({1, 2} if left else set())
        assert corpus_pipeline.pack_sequences(spark, out, "").select("doc_id").distinct().count() == left
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources, corpus_pipeline.pack_sequences):
        assert stage(spark, spark.createDataFrame(nothing, f"{DOCS}, {clash}"), "").count() == {"drop_exact_copies": 1}.get(stage.__name__, 3)


def test_stages_leave_only_what_is_read(spark, tmp_path):
    rows = [(1, "some plain words", "xx", "a", 3), (1, "some plain words", "xx", "a", 3), (2, "other plain text", "yy", "b", 3)]
    docs = spark.createDataFrame(rows, DOCS)
    begun = set(common.made())
    one = corpus_pipeline.drop_exact_copies(spark, docs, "")
    mine = set(common.made()) - begun
    two = corpus_pipeline.drop_near_copies(spark, one, "")
    assert mine and mine <= set(common.made()) and two.count() == 2
    two.write.parquet(f"{tmp_path}/two")
    three = corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{tmp_path}/two"), "")
    assert not mine & set(common.made()) and three.count() > 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a few words", "a"), (None, None, "a"), (7, "more of them", "b"), (7, "more of them", "b")], "doc_id long, text string, source string")
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in tokens.token_counts(df).collect()) == [(0, 0), (0, 11), (7, 12), (7, 12)]
    packed = packing.pack(df).collect()
    assert len({r["row_no"] for r in packed}) == 4 and sorted(r["doc_id"] or 0 for r in packed) == [0, 0, 7, 7]
    # Of 9 words 13.5 are wanted: source a is clamped at 6, b's 7.5 are its 6 and a rest that is nearer to none than to 3.
    assert sorted((r["doc_id"] or 0, r["taken"]) for r in mixing.mix(df).collect()) == [(0, 0), (0, 6), (7, 3), (7, 3)]


CONTRACTS = {
    "op1_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op2_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op3_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_exact_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op11_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op12_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op13_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op9_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
}


def test_held_out_accuracy(spark):
    got = queries.op6_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.filter("held_out").join(truth, "doc_id").toPandas()
    assert len(held) > 200 and (held["lang"] == held["lang_pred"]).mean() > 0.98


def test_pipeline(spark):
    """The stages against brute force on the smallest tables."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs.toPandas()
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = out.toPandas()
        out = stage(spark, out, sf)
        assert out.columns == columns
        after = out.toPandas()
        if name == "language_id":
            answers = language_id.identify(docs, language_id.train(docs.filter(~language_id.is_held_out()))).toPandas()
            assert set(after["doc_id"]) == set(answers[(answers["lang_pred"] != "und") & (answers["score"] >= 0.5)]["doc_id"])
            assert len(after) > 0.9 * len(before)
        elif name == "exact_dedup":
            first: dict = {}
            for r in before.sort_values("doc_id").itertuples():
                first.setdefault(re.sub(f"[{SPACES}]+", " ", r.text or ""), r.doc_id)
            assert sorted(after["doc_id"]) == sorted(first.values())
        elif name == "near_dedup":
            want = similar(dict(zip(before["doc_id"], before["text"], strict=True)))
            assert sorted(after["doc_id"]) == sorted(set(want.values()))
        elif name == "mixing":
            n = {r.doc_id: len(words(r.text)) for r in before.itertuples()}
            assert abs(sum(n[i] for i in after["doc_id"]) / (1.5 * sum(n.values())) - 1) < 0.1
            assert after.groupby("doc_id").size().max() <= 2
    packed = corpus_pipeline.run(spark, sf).toPandas()
    assert not packed.duplicated(["row_no", "piece"]).any() and packed.duplicated(["doc_id", "piece"]).any()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024
    assert set(packed["doc_id"]) <= set(kept["doc_id"])
