"""Places and running XORs within ordered groups, of which one may own a third of all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import materialize


def scanned(rows: DataFrame, group: str, order: Sequence[str], name: str, xors: Sequence[str] = ()) -> DataFrame:
    """rows with `place`, how many rows of the group come before, and the columns `xors` replaced by their XOR up to the row.

    Rows are dealt by ranges of the group and the order, so a large group is spread over tasks, and each task scans what it
    has with a state of one row. Groups that go over a boundary are then shifted by what the tasks before it have of them:
    of each task only the first and the last group can be such, so those sums have three rows a task at most and are
    broadcast. `group` must not be null; rows that are equal in group and order may come in any order.
    """
    schema = StructType([*rows.schema.fields, StructField("part", IntegerType()), StructField("place", LongType())])
    at, changed = rows.columns.index(group), [rows.columns.index(c) for c in xors]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen, state = TaskContext.get().partitionId(), None, 0, [0] * len(changed)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = b.column(at)
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = keys[0].as_py() != last
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            place = np.where(first >= 0, np.arange(n) - first, np.arange(n) + seen)
            columns = list(b.columns)
            for k, c in enumerate(changed):
                total = np.bitwise_xor.accumulate(b.column(c).to_numpy())
                before = np.where(first > 0, total[np.maximum(first, 1) - 1], np.where(first == 0, 0, state[k]))
                columns[c] = pa.array(total ^ before)
                state[k] = int(columns[c][n - 1].as_py())
            last, seen = keys[n - 1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part, np.int32)), pa.array(place)], names=schema.names)

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    out = materialize(sorted_rows.mapInArrow(walk, schema), name)
    ends = out.groupBy("part").agg(F.min(group).alias("low"), F.max(group).alias("high")).select(F.explode(F.array("low", "high")).alias(group)).distinct()
    totals = [F.max_by(c, "place").alias(f"upto_{c}") for c in xors]
    sums = out.select(group, "part", "place", *xors).join(F.broadcast(ends), group).groupBy(group, "part").agg(F.count("*").alias("n"), *totals)
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(group, "part", F.sum("n").over(before).alias("shift"), *[F.expr(f"bit_xor(upto_{c})").over(before).alias(f"upto_{c}") for c in xors]).filter("shift > 0")
    moved = out.join(F.broadcast(materialize(shifts, f"{name}-shifts")), [group, "part"], "left")
    put = {"place": F.col("place") + F.coalesce("shift", F.lit(0))} | {c: F.col(c).bitwiseXOR(F.coalesce(f"upto_{c}", F.lit(0))) for c in xors}
    return moved.withColumns(put).select(*out.columns)
