"""An exact similarity join of bags by their rarest values, for what star comparison of large buckets leaves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import shuffle_partitions

#: Cells of the frequency sketch; any order of values gives the same pairs, a good one gives few candidates.
SKETCH_BITS = 18
#: Holders of a value that one task compares; the holders of a more frequent one are dealt to several.
HOLDERS = 50_000
#: Pairs that are looked at at once.
STEP = 1 << 21


def frequencies(bags: DataFrame) -> np.ndarray:
    """How many values fall in each cell of a hash of 2 ** SKETCH_BITS cells: an upper bound of each value's frequency."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for x in b.column(0):
                v = np.frombuffer(x.as_buffer(), np.uint64)
                sums += np.bincount((v >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.record_batch({"cell": pa.array(at), "n": pa.array(sums[at])})

    got = bags.select("bag").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[got["cell"].to_numpy(int)] = got["n"]
    return out


def least_overlap(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    return np.ceil(similarity / (1 + similarity) * (x + y) - 1e-9)


def candidates(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) with different roots, one of them a probe, that may be as similar as asked for.

    members: node, root, probe (boolean) and bag, its values sorted and each once. Two bags of x and y values with
    an overlap of o or more share one of the x - o + 1 first and y - o + 1 first values of any common order. Values
    are ordered from the rarest. What a large group has in common comes late in its members' order, behind their own
    values, so members that differ too much don't meet. Values of more than HOLDERS holders are dealt by node and
    probed everywhere.
    """
    spark = members.sparkSession
    counts = spark.sparkContext.broadcast(frequencies(members))
    bits = int(4 * shuffle_partitions(spark) - 1).bit_length()
    schema = "part int, key binary, node binary, root binary, size binary, place binary, probe binary"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for b in batches:
            held: list[tuple] = []
            for node, root, probe, bag in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                v = np.frombuffer(bag.as_buffer(), np.uint64)
                c = often[(v >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((v, c))[: len(v) - math.ceil(similarity * len(v) - 1e-9) + 1]
                v, salts, place = v[order], c[order] // HOLDERS + 1, np.arange(1, len(order) + 1)
                mine = (K.mix(np.array([node], np.int64).view(np.uint64))[0] % salts.astype(np.uint64)).astype(np.int64)
                held.append((v, mine, node, root, len(v), place, 0, bag_size := len(bag.as_buffer()) // 8))
                if probe:
                    which, salt = K.spread(salts)
                    held.append((v[which], salt, node, root, len(which), place[which], 1, bag_size))
            if not held:
                continue
            n = np.array([h[4] for h in held])
            fill = lambda i, t, n=n, held=held: np.repeat(np.array([h[i] for h in held], t), n)
            key = K.mix(np.concatenate([h[0] for h in held]) + np.concatenate([h[1] for h in held]).astype(np.uint64) * K.GOLDEN)
            columns = [key, fill(2, np.int64), fill(3, np.int64), fill(7, np.int32), np.concatenate([h[5] for h in held]).astype(np.int32), fill(6, np.uint8)]
            order = np.argsort(key, kind="stable")
            columns = [x[order] for x in columns]
            part = (columns[0] >> np.uint64(64 - bits)).astype(np.int32)
            at = np.flatnonzero(K.run_starts(part))
            ends = np.r_[at[1:], len(part)][: len(at)]
            yield pa.RecordBatch.from_arrays([pa.array(part[at]), *[pa.array([x[s:e].tobytes() for s, e in zip(at, ends, strict=True)], pa.binary()) for x in columns]], names=["part", "key", "node", "root", "size", "place", "probe"])

    def meet(table: pa.Table) -> pa.Table:
        get = lambda name, t: np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(name)])
        key, node, root, size, place, probe = get("key", np.uint64), get("node", np.int64), get("root", np.int64), get("size", np.int32).astype(np.int64), get("place", np.int32).astype(np.int64), get("probe", np.uint8) > 0
        _, key = np.unique(key, return_inverse=True)
        order = np.lexsort((size, key))
        order = order[~probe[order]]
        held = (key[order] << 32) | size[order]
        asked = np.flatnonzero(probe)
        # A partner's size is bounded by its similarity, and by how late in the prober's order the value comes.
        low = np.ceil(similarity * size[asked] - 1e-9)
        high = np.minimum(np.floor(size[asked] / similarity + 1e-9), np.floor((size[asked] - place[asked] + 1) * (1 + similarity) / similarity + 1e-9) - size[asked])
        first = np.searchsorted(held, (key[asked] << 32) | low.astype(np.int64), "left")
        last = np.searchsorted(held, (key[asked] << 32) | np.maximum(high, -1).astype(np.int64), "right")
        many = np.where(high >= low, np.maximum(last - first, 0), 0)
        pairs = [np.empty((0, 2), np.int64)]
        cuts = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + STEP, STEP), "left")
        for s, e in zip(cuts[:-1], [*cuts[1:-1], len(many)], strict=True) if len(cuts) > 1 else ():
            which, k = K.spread(many[s:e])
            x, y = asked[s:e][which], order[first[s:e][which] + k]
            o = least_overlap(size[x], size[y], similarity)
            on = (root[x] != root[y]) & (place[x] <= size[x] - o + 1) & (place[y] <= size[y] - o + 1)
            p = np.stack([np.minimum(node[x[on]], node[y[on]]), np.maximum(node[x[on]], node[y[on]])], 1)
            pairs.append(np.unique(p, axis=0))
        out = np.unique(np.concatenate(pairs), axis=0)
        return pa.table({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})

    return members.select("node", "root", "probe", "bag").mapInArrow(emit, schema).groupBy("part").applyInArrow(meet, "a long, b long").distinct()
