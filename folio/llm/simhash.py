"""SimHash near-duplicates: fingerprints within a few bits, found by the generalised pigeonhole principle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import hot_join, materialize
from .components import components, least_of_component

SHINGLE = 3
SEED = 42
DISTANCE = 3
BITS = 64
#: Partitions of the bits, and bits of each; a partition's values are counted exactly, in 2 ** WIDTH cells.
PARTS = 4
WIDTH = BITS // PARTS
#: Thresholds of the partitions sum to this: two fingerprints that differ more in each differ in over DISTANCE bits.
BUDGET = DISTANCE - PARTS + 1
#: Candidates that cost as much to compare as one probe costs to send.
PROBE = 64
#: Fingerprints that one task compares as a bucket; larger buckets are cut by their other bits.
BUCKET = 8192
#: All pairs of a bucket of so many fingerprints are compared at once; in larger ones links are walked from one to the next.
PAIRS = 32
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists, each with the last words of the one before in front, so that no shingle is cut."""
    at, carry = 0, []
    while at < len(text):
        found = SPACE.search(text, at + PIECE)
        end = found.start() if found else len(text)
        words = carry + text[at:end].split()
        if len(words) >= SHINGLE or end == len(text):
            yield words
        carry, at = words[-(SHINGLE - 1) :], end


def hashes(words: list[bytes]) -> np.ndarray:
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes) -> int:
    """A bit is 1 if it is set in over half the XXH64 of the text's shingles; 0 without words."""
    count, n = np.zeros(BITS, np.int64), 0
    for words in words_of(text.lower()):
        if words and (len(words) >= SHINGLE or not n):
            h = hashes(words)
            count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(h)
    return int.from_bytes(np.packbits(2 * count > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and code, the fingerprint as a signed 64-bit number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)], np.uint64)
            yield pa.record_batch({"doc_id": b.column(0), "code": pa.array(codes.view(np.int64))})

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return chosen.mapInArrow(work, "doc_id long, code long")


def bits_of(codes: np.ndarray) -> np.ndarray:
    return np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def partitions(codes: DataFrame) -> np.ndarray:
    """PARTS rows of WIDTH bits: correlated bits are put together, so that partitions tell different things.

    Executors count how often two bits are set together; the driver gets 64 x 64 sums. A partition begins with the first
    free bit and takes the free bit that is most correlated with those it has.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = bits_of(b.column(0).to_numpy()).astype(np.float32)
            sums += x.T @ x
            n += len(x)
        yield pa.record_batch({"cell": pa.array(np.arange(BITS * BITS + 1)), "n": pa.array(np.r_[sums.reshape(-1), n].astype(np.int64))})

    got = codes.select("code").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros(BITS * BITS + 1)
    cells[got["cell"].to_numpy(int)] = got["n"]
    n = max(1.0, cells[-1])
    both = cells[:-1].reshape(BITS, BITS) / n
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    alike = np.abs((both - np.outer(mean, mean)) / np.outer(spread, spread))
    free, out = list(range(BITS)), []
    while free:
        part = [free.pop(0)]
        while len(part) < WIDTH:
            best = max(free, key=lambda b, part=part: (alike[b, part].sum(), -b))
            free.remove(best)
            part.append(best)
        out.append(part)
    return np.array(out)


def values(codes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The numbers that the given bits of each code make."""
    u, out = codes.view(np.uint64), np.zeros(len(codes), np.int64)
    for k, b in enumerate(bits.tolist()):
        out |= ((u >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def neighbourhoods(counts: np.ndarray) -> np.ndarray:
    """From the number of fingerprints of each value, for each radius up to DISTANCE how many are within it."""
    exact = np.zeros((DISTANCE + 1, len(counts)))
    exact[0] = counts
    for k in range(WIDTH):
        flipped = exact[:-1, np.arange(len(counts)) ^ (1 << k)]
        exact[1:] += flipped
    return exact.cumsum(0)


def balls(width: int) -> list[np.ndarray]:
    """For each distance up to DISTANCE the masks of so many of `width` bits."""
    out = [np.zeros(1, np.int64)]
    ones = np.int64(1) << np.arange(width)
    for _ in range(DISTANCE):
        more = np.unique((out[-1][:, None] | ones[None, :]).reshape(-1))
        out.append(more[np.bitwise_count(more.astype(np.uint64)) == len(out)])
    return out


def allocated(values_of: list[np.ndarray], near: np.ndarray) -> np.ndarray:
    """Each fingerprint's thresholds (-1: the partition is left out), which sum to BUDGET at the least estimated cost: the
    fingerprints within them and the probes sent. A dynamic programme over the partitions, for all fingerprints at once."""
    n, low = len(values_of[0]), -PARTS
    sent = np.cumsum([len(b) for b in balls(WIDTH)]) - 1
    width = BUDGET - low + DISTANCE * PARTS + 1
    best, chosen = np.full((width, n), np.inf), []
    best[-low] = 0
    for v, table in zip(values_of, near, strict=True):
        costs = [np.zeros(n), *(table[t][v] + PROBE * sent[t] for t in range(DISTANCE + 1))]
        after, how = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for t, cost in enumerate(costs, -1):
            from_, to = (slice(0, width - t), slice(t, width)) if t >= 0 else (slice(1, width), slice(0, width - 1))
            total = best[from_] + cost
            less = total < after[to]
            after[to] = np.where(less, total, after[to])
            how[to] = np.where(less, t, how[to])
        best = after
        chosen.append(how)
    out, at = np.zeros((n, PARTS), np.int8), np.full(n, BUDGET - low)
    for p in reversed(range(PARTS)):
        out[:, p] = chosen[p][at, np.arange(n)]
        at = at - out[:, p]
    return out


ROWS = "key long, used long, code long, held boolean, asks boolean"


def probes(codes: DataFrame, bits: np.ndarray) -> DataFrame:
    """ROWS: each fingerprint is held under its value of every partition, and asks under those within its thresholds; `used` are
    the partition's bits."""
    masks = [int(np.bitwise_or.reduce(np.uint64(1) << b.astype(np.uint64))) for b in bits]
    masks = np.array(masks, np.uint64).view(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, 1 << WIDTH), np.int64)
        for b in batches:
            x = b.column(0).to_numpy()
            for p in range(PARTS):
                sums[p] += np.bincount(values(x, bits[p]), minlength=1 << WIDTH)
        at = np.flatnonzero(sums)
        yield pa.record_batch({"cell": pa.array(at), "n": pa.array(sums.reshape(-1)[at])})

    got = codes.select("code").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(PARTS << WIDTH, np.int64)
    counts[got["cell"].to_numpy(int)] = got["n"]
    near = codes.sparkSession.sparkContext.broadcast(np.stack([neighbourhoods(c) for c in counts.reshape(PARTS, -1)]).astype(np.float32))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = balls(WIDTH)
        for b in batches:
            x = b.column(0).to_numpy()
            of = [values(x, bits[p]) for p in range(PARTS)]
            most = allocated(of, near.value)
            for p in range(PARTS):
                for t in range(DISTANCE + 1):
                    who = np.flatnonzero(most[:, p] >= t) if t else np.arange(len(x))
                    step = max(1, (1 << 18) // len(ball[t]))
                    for s in range(0, len(who), step):
                        some = who[s : s + step]
                        key = ((of[p][some][:, None] ^ ball[t]) | p << WIDTH).reshape(-1)
                        asks = np.repeat(most[some, p] >= t, len(ball[t]))
                        columns = [key, np.full(len(key), masks[p]), np.repeat(x[some], len(ball[t])), np.full(len(key), t == 0), asks]
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "used", "code", "held", "asks"])

    return codes.select("code").mapInArrow(work, ROWS)


def walked(codes: np.ndarray, held: np.ndarray, asks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join what a bucket's links join, one fewer than it joins: from each fingerprint to what it newly meets."""
    rest = np.ones(len(codes), bool)
    u = codes.view(np.uint64)
    for first in range(len(codes)):
        if not rest[first]:
            continue
        rest[first], front = False, [first]
        while front:
            x = front.pop()
            left = np.flatnonzero(rest & ((held & asks[x]) | (asks & held[x])))
            near = left[np.bitwise_count(u[left] ^ u[x]) <= DISTANCE]
            if len(near):
                rest[near] = False
                front.extend(near.tolist())
                yield np.full(len(near), codes[x]), codes[near]


def compared(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join the fingerprints of each bucket within DISTANCE bits, of which one asks in it and the other is held."""

    def bucket_links(key: np.ndarray, code: np.ndarray, held: np.ndarray, asks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = np.flatnonzero(K.run_starts(key))
        size = np.diff(np.r_[first, len(key)])
        few = (size > 1) & (size <= PAIRS)
        group, place = K.spread(size[few])
        x = first[few][group] + place
        which, k = K.spread(size[few][group] - place - 1)
        a, b = x[which], x[which] + k + 1
        near = ((held[a] & asks[b]) | (held[b] & asks[a])) & (np.bitwise_count((code[a] ^ code[b]).view(np.uint64)) <= DISTANCE)
        yield code[a[near]], code[b[near]]
        for s, n in zip(first[size > PAIRS].tolist(), size[size > PAIRS].tolist(), strict=True):
            yield from walked(code[s : s + n], held[s : s + n], asks[s : s + n])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)]
        for b in batches:
            rows = [np.concatenate([c, b.column(i).to_numpy(zero_copy_only=False)]) for i, c in enumerate(rows)]
            last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            yield from told(*(c[:last] for c in rows))
            rows = [c[last:] for c in rows]
        yield from told(*rows)

    def told(key: np.ndarray, *of: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in bucket_links(key, *of) if len(key) else ():
            on = a != b
            if on.any():
                yield pa.record_batch({"a": pa.array(np.minimum(a, b)[on]), "b": pa.array(np.maximum(a, b)[on])})

    ordered = rows.repartition("key").sortWithinPartitions("key").select("key", "code", "held", "asks")
    return ordered.mapInArrow(work, "a long, b long").distinct()


def cut(rows: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """ROWS of large buckets (sizes: key, used, n) dealt to smaller ones.

    Members of a bucket that are linked differ in DISTANCE of the unused bits at most, so they agree in one of DISTANCE + 1
    parts of those. Bits are dealt to the parts in turn from the most varying, so each part tells members apart as well as
    another. Every cut uses up a part, and a bucket has no more members than its unused bits have values, so cuts end.
    """
    parts = DISTANCE + 1
    bit = lambda k: F.sum(F.shiftrightunsigned("code", k).bitwiseAND(F.lit(1))).alias(f"s{k}")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            used, n = b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
            mean = np.stack([b.column(3 + k).to_numpy() for k in range(BITS)], 1) / np.maximum(n, 1)[:, None]
            taken = bits_of(b.column(1).to_numpy()).astype(bool)
            order = np.argsort(np.where(taken, 1.0, np.abs(mean - 0.5)), axis=1, kind="stable")
            masks = np.zeros((len(n), parts), np.uint64)
            for k in range(BITS):
                one = np.uint64(1) << order[:, k].astype(np.uint64)
                turn = k % (2 * parts)
                p = turn if turn < parts else 2 * parts - 1 - turn
                masks[:, p] |= np.where(used & one, np.uint64(0), one)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * parts, pa.int32()), pa.array(masks.view(np.int64).reshape(-1)))
            yield pa.record_batch({"key": b.column(0), "used": b.column(1), "n": b.column(2), "masks": lists})

    large = hot_join(rows, sizes, ["key", "used"], "n", total)
    sums = large.groupBy("key", "used").agg(F.count("*").alias("n"), *[bit(k) for k in range(BITS)])
    masks = materialize(sums.mapInArrow(deal, "key long, used long, n long, masks array<long>"), "masks")
    told = hot_join(large.drop("n"), masks, ["key", "used"], "n", total).select("key", "used", "code", "held", "asks", F.posexplode("masks").alias("p", "mask"))
    key = F.xxhash64("key", "used", "p", F.col("code").bitwiseAND(F.col("mask")))
    return told.select(key.alias("key"), F.col("used").bitwiseOR(F.col("mask")).alias("used"), "code", "held", "asks")


def linked(codes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column code) of DISTANCE different bits or fewer, as many as join whatever such links
    join."""
    rows = materialize(probes(codes, partitions(codes)), "probes")
    found = []
    while True:
        sizes = materialize(rows.groupBy("key", "used").agg(F.count("*").alias("n"), F.max("asks").alias("asked")).filter("n > 1 AND asked").drop("asked"), "buckets")
        total = sizes.agg(F.sum("n")).first()[0] or 0
        sized = hot_join(rows, sizes, ["key", "used"], "n", total)
        found.append(materialize(compared(sized.filter(F.col("n") <= BUCKET)), "links"))
        large = sizes.filter(F.col("n") > BUCKET)
        if large.isEmpty():
            break
        rows = materialize(cut(rows, large, total), "probes")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that links
    lead to, itself included. Fingerprints of DISTANCE different bits or fewer are linked.

    Texts are lower-cased from A to Z; shingles are of three words, repeats counted, or all words of a shorter text.
    Correlated bits share a partition. Each fingerprint gets thresholds of its own, by a dynamic programme on how many
    others its values meet: a common value is left out if a rare one may be asked more widely. Buckets of over BUCKET
    fingerprints are cut again by their other bits, so that no link is lost for a bucket's size, and every candidate is
    compared. Copies have one fingerprint, so they are one row of all this.

    Null texts and texts without words have fingerprint zero and are linked like others. A null doc_id is never the
    smallest unless there is no other; rows may repeat. Very long texts are read in pieces, one text at a time. An empty
    table gives an empty result. Other columns are not read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(rows.groupBy("code").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "codes")
    named = least_of_component(nodes, "code", "least", components(materialize(linked(nodes), "links")))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    out = hot_join(rows, materialize(named.select("code", "n", F.col("least_of").alias("component_id")), "named"), ["code"], "n", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
