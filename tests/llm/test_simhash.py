"""SimHash against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from folio.llm import components, simhash


def brute_fingerprint(text: str | None) -> int:
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(codes: list[int]) -> dict[int, int]:
    """The least position of each code's component."""
    u, left, out = np.array(codes, np.uint64), set(range(len(codes))), {}
    for i in range(len(codes)):
        if i in left:
            left.remove(i)
            front = [i]
            while front:
                x = front.pop()
                out[x] = i
                near = [y for y in np.flatnonzero(np.bitwise_count(u ^ u[x]) <= 3).tolist() if y in left]
                left.difference_update(near)
                front += near
    return out


def clouds(n: int, seed: int = 5) -> list[int]:
    """Codes at random, dense clouds of codes a few bits from one, and chains."""
    rng = random.Random(seed)
    some = lambda k: sum(1 << b for b in rng.sample(range(64), k))
    out = {0}
    base = rng.getrandbits(64)
    often = [1 << b for b in rng.sample(range(64), 12)]
    while len(out) < n // 3:
        out.add(base ^ sum(b for b in often if rng.random() < 0.4) ^ (some(1) if rng.random() < 0.3 else 0))
    while len(out) < n // 2:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.add(x)
            x ^= some(rng.randint(1, 5))
    while len(out) < n:
        out.add(rng.getrandbits(64))
    return sorted(out)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bucket", [60, 8192])
def test_linked(spark, monkeypatch, bucket):
    """Every component is whole, whether large buckets are cut or walked, and links are fewer than all pairs of a cloud."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    codes = clouds(2400)
    table = spark.createDataFrame([(signed(c),) for c in codes], "code long").repartition(4)
    links = simhash.linked(table)
    pairs = [(r["a"], r["b"]) for r in links.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and a != b for a, b in pairs)
    if bucket > len(codes):
        assert len(pairs) < 8 * len(codes)
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    want = brute_groups(codes)
    same: dict = {}
    for i, c in enumerate(codes):
        same.setdefault(roots.get(signed(c), signed(c)), set()).add(want[i])
    assert all(len(x) == 1 for x in same.values()) and len(same) == len(set(want.values()))


def test_thresholds_leave_nothing_out():
    """Thresholds and one more for each partition are over the distance, and the least cost of all that are."""
    rng = np.random.default_rng(0)
    near = np.cumsum(rng.integers(0, 5000, (simhash.PARTS, 4, 50)), 1).astype(float)
    values = [rng.integers(0, 50, 30) for _ in range(simhash.PARTS)]
    got = simhash.allocated(values, near)
    assert (got.sum(1) == simhash.BUDGET).all() and got.min() >= -1
    sent = np.cumsum([len(b) for b in simhash.balls(simhash.WIDTH)]) - 1
    cost = lambda i, ts: sum(near[p][t][values[p][i]] + simhash.PROBE * sent[t] for p, t in enumerate(ts) if t >= 0)
    every = [ts for ts in np.ndindex(5, 5, 5, 5) if sum(ts) - 4 == simhash.BUDGET]
    for i in range(30):
        assert np.isclose(cost(i, got[i].tolist()), min(cost(i, [t - 1 for t in ts]) for ts in every))


def test_neighbourhoods(monkeypatch):
    monkeypatch.setattr(simhash, "WIDTH", 6)
    counts = np.random.default_rng(1).integers(0, 9, 64)
    x = np.arange(64)
    d = np.bitwise_count(x[:, None] ^ x[None, :])
    assert all((simhash.neighbourhoods(counts)[t] == ((d <= t) * counts).sum(1)).all() for t in range(4))


def test_partitions_put_correlated_bits_together(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(400):
        bits = rng.integers(0, 2, 64)
        bits[[40, 50, 60]] = bits[0]
        rows.append((signed(sum(int(b) << i for i, b in enumerate(bits))),))
    parts = simhash.partitions(spark.createDataFrame(rows, "code long"))
    assert sorted(parts.reshape(-1).tolist()) == list(range(64)) and {0, 40, 50, 60} <= set(parts[0].tolist())


def test_simhash(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeÄ") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts: list[str | None] = []
    for i in range(150):
        some = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        if i % 5 == 1:
            some = (texts[i - 1] or "x").split(" ")
            some[len(some) // 2] = "Changed"
        texts.append(rng.choice([None, "", " \n", "one", "One Two", "a\x0bb"]) if i % 10 == 9 else " ".join(some))
    texts += [texts[0].upper().replace("Ä", "Ä"), texts[0], " ".join(rng.choice(words) for _ in range(400_000))]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1), (None, texts[5], "y", 2)]
    got = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string, code string, component_id int").repartition(3))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == len(rows)
    codes = [brute_fingerprint(t) for t in texts]
    group = brute_groups(codes)
    want = sorted((str(i), f"{codes[i if i is not None else 5]:016x}", group[i if i is not None else 5]) for i, *_ in rows)
    assert sorted((str(r[0]), r[1], r[2]) for r in got.collect()) == want


def test_simhash_of_nothing(spark):
    assert simhash.simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = simhash.simhash_dedup(spark.createDataFrame([(4, None), (2, " "), (None, "")], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(4, "0" * 16, 2), (2, "0" * 16, 2), (None, "0" * 16, 2)], key=str)
