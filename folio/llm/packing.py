"""Best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, materialize
from .tokens import default_vocabulary, encoder

CAPACITY = 1024
END = 2


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first is the short one."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, row_no, piece, start, length, ids_crc32, and ids if asked for. Each text is
    encoded once."""
    path = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(path), np.array([end], "<u4")
        for b in batches:
            rows, ids, piece, start, length, crc, own = [], b.column(0), [], [], [], [], []
            for i, text in enumerate(b.column(2)):
                got = np.concatenate([enc.encode(text.as_py() or "").astype("<u4", copy=False), tail])
                for k, (s, n) in enumerate(cut(len(got), capacity)):
                    rows.append(i), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(got[s : s + n]))
                    if with_ids:
                        own.append(got[s : s + n].astype(np.int32))
            at = pa.array(rows, pa.int64())
            more = {"ids": pa.array(own, pa.list_(pa.int32()))} if with_ids else {}
            yield pa.record_batch(
                {"doc_id": ids.take(at), "row_no": b.column(1).take(at), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), **more}
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(encode, "doc_id long, row_no long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best fit over counts: slots (length, first rank, first sequence, offset), sorted by length and rank.

    Lengths go from the longest down. Sequences alike are one group with a range of numbers; all pieces of a
    length take the groups with the least room that is enough, whole groups at a time, splitting the last. What
    is left opens sequences that hold as many pieces of this length as fit. A length adds two groups and one
    split at most, so there are at most 3 * capacity groups and capacity slots in each, however many documents.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    free: list[int] = []
    slots: list[tuple[int, int, int, int]] = []
    opened = 0

    def put(left: int, lo: int, hi: int) -> None:
        if left and hi > lo:
            if left not in room:
                room[left] = []
                insort(free, left)
            room[left].append((lo, hi))

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            k = bisect_left(free, length)
            if k < len(free):
                left = free[k]
                lo, hi = room[left].pop()
                if not room[left]:
                    del room[left], free[k]
                took = min(hi - lo, n - rank)
                slots.append((length, rank, lo, capacity - left))
                rank += took
                put(left, lo + took, hi)
                put(left - length, lo, lo + took)
                continue
            each = capacity // length
            full, rest = divmod(n - rank, each)
            for of, m in ((full, each), (1, rest)):
                if of and m:
                    for i in range(m):
                        slots.append((length, rank, opened, i * length))
                        rank += of
                    put(capacity - m * length, opened, opened + of)
                    opened += of
    return np.array(sorted(slots), np.int64).reshape(-1, 4)


def ranked(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """rows with `rank`, from 0, within their length. A length may have a third of all rows, so it is ranked in buckets."""
    spark = rows.sparkSession
    buckets = F.broadcast(spark.createDataFrame([(k, -(-v // BUCKET_ROWS)) for k, v in counts.items()] or [(0, 1)], "length long, buckets long"))
    rows = rows.join(buckets, "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "row_no"), F.col("buckets"))).drop("buckets")
    upto = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "row_no")
    return rows.join(firsts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.row_number().over(inside) - 1).drop("first", "bucket")


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their place: doc_id, piece, start, length, ids_crc32, row_no, sequence_id, offset, and
    ids if asked for; row_no tells the documents of one identifier apart.

    A document is its ids and the end id; one longer than capacity is cut so that only its first piece is
    shorter. The driver gets the number of pieces of each length (capacity rows at most), plans slots on it, and
    each piece takes the slot of its rank among the pieces of its length. The plan goes to the executors; its
    size is bounded by capacity alone.

    A null or empty text is the end id alone. Repeated rows are packed each. An empty table gives an empty
    result. Other columns are not read.
    """
    table = materialize(pieces(docs, capacity, end, vocabulary, id_col, text_col, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}
    plan = best_fit_plan(counts, capacity)
    by = {int(n): plan[plan[:, 0] == n, 1:] for n in np.unique(plan[:, 0])}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length, rank = f["length"].to_numpy(), f["rank"].to_numpy()
            sequence, offset = np.empty(len(f), np.int64), np.empty(len(f), np.int64)
            for n in np.unique(length):
                at, slots = length == n, by[int(n)]
                k = np.searchsorted(slots[:, 0], rank[at], "right") - 1
                sequence[at], offset[at] = slots[k, 1] + rank[at] - slots[k, 0], slots[k, 2]
            yield f[["doc_id", "piece", "start", "length", "ids_crc32", "row_no", *["ids"] * with_ids]].assign(sequence_id=sequence, offset=offset)

    return ranked(table, counts).mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, row_no long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long")


def sequences(docs: DataFrame, **how) -> DataFrame:
    """The packed sequences: sequence_id, n_pieces, ids. A sequence has capacity ids at most, so a group is small."""
    places = pack(docs, **how, with_ids=True)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return places.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
