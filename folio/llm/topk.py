"""Exact top-k by inner product over a vector-approximation table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, materialize, shuffle_partitions

#: Vectors in a row of the approximation table, and cells of a component, which a byte numbers.
BLOCK, CELLS = 1024, 256
#: Bytes of cells, and of queries, that one task holds.
SCAN_BYTES, QUERY_BYTES = 64 << 20, 16 << 20
#: Bounds that are computed at once.
STEP = 1 << 21
SCALE = 256

BLOCKS = "d int, low double, width double, block long, rows binary, cells binary"
QUERIES = "d int, block long, rows binary, queries binary"
BOUNDS = "query_row long, row_no long, least double, most double"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """row_no, vec_id and v, the components as floor(scale * x); rows null or with null or non-finite components go."""
    x = F.col(vector_col)
    fine = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))), F.lit(False))
    return vectors.filter(fine & F.col(id_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale)))).alias("v")
    )


def matrices(b: pa.RecordBatch, at: int, d: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A batch's vectors (column `at`) by length: the length, places in the batch and a matrix, BLOCK rows at most."""
    lists = b.column(at)
    flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    for n in np.unique(d).tolist():
        mine = np.flatnonzero(d == n)
        for i in range(0, len(mine), BLOCK):
            part = mine[i : i + BLOCK]
            yield n, part, flat[starts[part][:, None] + np.arange(n)]


def approximation(vectors: DataFrame, grid: DataFrame, total: int) -> DataFrame:
    """The vector-approximation table: blocks of vectors of one length, a byte a component, the cell's number in the grid."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, low, width, row = (b.column(k).to_numpy() for k in range(4))
            for n, at, v in matrices(b, 4, d):
                i = at[0]
                cell = np.clip((v - low[i]) / width[i], 0, CELLS - 1).astype(np.uint8)
                yield pa.record_batch([pa.array([x], t) for x, t in zip((n, low[i], width[i], row[i], row[at].tobytes(), cell.tobytes()), (pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["d", "low", "width", "block", "rows", "cells"])

    known = hot_join(vectors, grid, ["d"], "n", total).select("d", "low", "width", "row_no", "v")
    return known.mapInArrow(pack, BLOCKS)


def packed_queries(queries: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(1).to_numpy()
            for n, at, v in matrices(b, 2, b.column(0).to_numpy()):
                yield pa.record_batch([pa.array([x], t) for x, t in zip((n, row[at[0]], row[at].tobytes(), v.astype(float).tobytes()), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["d", "block", "rows", "queries"])

    return queries.select("d", "row_no", "v").mapInArrow(pack, QUERIES)


def cell_bounds(cells: np.ndarray, low: float, width: float, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For queries by vectors, the score of the cell's middle, and for each query by how much the true score may differ."""
    middle = queries @ ((cells + 0.5) * width + low).T
    size = np.abs(queries).sum(1)
    return middle, size * (width / 2 * (1 + 1e-9) + (abs(low) + CELLS * width) * 1e-9)


def scan(blocks: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The vectors whose cells allow them to be among the k best of a query, as far as the blocks of one task tell.

    k vectors surely score the kth greatest lower bound or more, so one whose upper bound is less is none of the k.
    """
    out: list[tuple[np.ndarray, ...]] = []
    if blocks.num_rows and asked.num_rows:
        d = blocks.column("d")[0].as_py()
        q = np.concatenate([np.frombuffer(x.as_py(), float) for x in asked.column("queries")]).reshape(-1, d)
        q_rows = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in asked.column("rows")])
        best = np.full((len(q), k), -np.inf)
        step = max(1, STEP // BLOCK)
        for i in range(blocks.num_rows):
            rows = np.frombuffer(blocks.column("rows")[i].as_py(), np.int64)
            cells = np.frombuffer(blocks.column("cells")[i].as_py(), np.uint8).reshape(-1, d)
            for s in range(0, len(q), step):
                middle, slack = cell_bounds(cells, blocks.column("low")[i].as_py(), blocks.column("width")[i].as_py(), q[s : s + step])
                middle[q_rows[s : s + step, None] == rows[None, :]] = -np.inf
                lower = np.concatenate([best[s : s + step], middle - slack[:, None]], axis=1)
                best[s : s + step] = np.partition(lower, lower.shape[1] - k, axis=1)[:, -k:]
                upper = middle + slack[:, None]
                who, which = np.nonzero((upper >= best[s : s + step].min(1)[:, None]) & (middle > -np.inf))
                out.append((who + s, rows[which], middle[who, which] - slack[who], upper[who, which]))
        who, row, least, most = (np.concatenate(x) for x in zip(*out, strict=True))
        on = most >= best.min(1)[who]
        out = [(q_rows[who[on]], row[on], least[on], most[on])]
    columns = out[0] if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))
    return pa.table(dict(zip(("query_row", "row_no", "least", "most"), map(pa.array, columns), strict=True)))


def candidates(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_row, row_no, least, most: the vectors whose upper bound reaches the kth greatest lower bound of the query.

    The grid of a length is CELLS steps between its least and greatest component. Blocks of the approximation table
    meet blocks of queries in groups of bounded size: each group of queries is sent to each group of blocks.
    """
    sized = materialize(vectors.withColumn("d", F.size("v")).filter("d > 0"), "sized")
    asked = materialize(queries.withColumn("d", F.size("v")).filter("d > 0"), "asked")
    low, high = F.min(F.array_min("v")).cast("double"), F.max(F.array_max("v")).cast("double")
    grid = materialize(sized.groupBy("d").agg(low.alias("low"), F.greatest((high - low) / CELLS, F.lit(1e-9)).alias("width"), F.count("*").alias("n")), "grid")
    asking = asked.groupBy("d").agg(F.count("*").alias("m"))
    total = grid.agg(F.sum("n")).first()[0] or 0
    blocks = materialize(approximation(sized, grid, total), "cells")

    spread = F.least(F.lit(shuffle_partitions(vectors.sparkSession)).cast("long"), F.ceil(F.col("n") / BLOCK))
    vector_groups = F.greatest(F.ceil(F.col("n") * F.col("d") / SCAN_BYTES), spread, F.lit(1).cast("long"))
    query_groups = F.greatest(F.ceil(F.col("m") * F.col("d") * 8 / QUERY_BYTES), F.lit(1).cast("long"))
    plan = materialize(grid.join(asking, "d").select("d", vector_groups.alias("vgs"), query_groups.alias("qgs"), F.col("n").alias("of")), "plan")

    def sides(df: DataFrame, mine: str, own: str, others: str, other: str) -> DataFrame:
        dealt = hot_join(df, plan, ["d"], "of", total).withColumn(mine, F.pmod(F.xxhash64("block"), F.col(own)))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1))).drop("vgs", "qgs", "of")

    left = sides(blocks, "vg", "vgs", "qgs", "qg").groupBy("d", "vg", "qg")
    right = sides(materialize(packed_queries(asked), "queries"), "qg", "qgs", "vgs", "vg").groupBy("d", "vg", "qg")
    bounds = materialize(left.cogroup(right).applyInArrow(lambda a, b: scan(a, b, k), BOUNDS), "bounds")
    kth = F.nth_value("least", k).over(Window.partitionBy("query_row").orderBy(F.desc("least")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return bounds.withColumn("kth", kth).filter(F.col("kth").isNull() | (F.col("most") >= F.col("kth"))).drop("kth")


def few_of_each(vectors: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k + 1 of smallest identifiers: no query has another among its k best, its own row left out.
    The limit is applied before rows are sent, so a vector that a third of all rows have isn't sorted in one task."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row_no"))
    return vectors.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k best vectors of each query: query_id, rank, vec_id, score, ties to the smaller vec_id.

    vectors and queries have row_no, vec_id and v as integer_vectors() makes them and should be materialized; a query
    finds every vector but its own row. Of equal vectors a few are searched (few_of_each()). The approximation table
    are then read by row number in the order of their upper bounds: first the k that may be best, then those whose
    bound reaches the kth score found, so that the kth result is certain; others are never read. What one task holds is
    bounded, and nothing goes through the driver but a count.

    Scores are exact; one that needs more than 64 bits is null and comes last. Vectors of another length than the query's
    are no candidates, and empty ones find and are found by none. Fewer than k candidates give as many ranks. Equal
    vectors tie. An empty table gives an empty result.
    """
    vectors = materialize(few_of_each(vectors, k), "few")
    seen = materialize(candidates(vectors, queries, k), "candidates")
    order = Window.partitionBy("query_row").orderBy(F.desc("most"), "row_no")
    seen = seen.withColumn("turn", F.row_number().over(order))
    asked = queries.select(F.col("row_no").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.select("query_row", "row_no").join(vectors, "row_no").join(asked, "query_row")
        score = F.aggregate(F.zip_with("q", "v", F.try_multiply), F.lit(0).cast("long"), F.try_add)
        return both.select("query_row", "query_id", "vec_id", "row_no", score.alias("score"))

    first = materialize(scored(seen.filter(F.col("turn") <= k)), "first")
    kth = first.groupBy("query_row").agg(F.min("score").alias("kth"))
    more = seen.filter(F.col("turn") > k).join(kth, "query_row").filter(F.col("kth").isNull() | (F.col("most") >= F.col("kth")))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row_no"))
    return first.unionByName(scored(more)).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_of_every(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """top_k() with the rows whose identifier is divisible by `every` as queries, over all rows."""
    table = materialize(integer_vectors(vectors, id_col, vector_col), "vectors")
    return top_k(table, table.filter(F.col("vec_id") % every == 0), k)
