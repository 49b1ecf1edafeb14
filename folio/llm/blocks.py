"""Blocks of texts, and an exchange in which blocks learn which of their hashes other blocks have.

A block is a row with some megabytes of compressed texts. For the exchange it sends each part of the hash range a
row with its hashes there, sorted and each once, so that a hash that a third of all documents have is sent once a
block and not once a document. A part sees a hash's entries from all blocks and answers the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize, shuffle_partitions

#: Bytes of text in a block, at least and at most, and parts of the hash range at most.
BLOCK_BYTES, LARGE_BLOCK, PART_BITS = 2 << 20, 16 << 20, 17
#: The place of a null identifier in the order: after all others.
LAST = np.iinfo(np.int64).max

Entries = list[np.ndarray]

#: How rows of a megabyte are written: a page for each, no second compression, and small row groups.
LARGE_ROWS = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4", "parquet.page.row.count.limit": "1", "parquet.block.size": str(16 << 20)}


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int | None = None, level: int = 3) -> DataFrame:
    """block, ids, none, offsets and text (compressed, at the given level), materialized so that block numbers stand. A text of more bytes
    than a block is a block of its own.

    A block sends a row to each part, so blocks grow with the number of parts: rows keep several entries, and what a
    row costs besides them stays small for any corpus.
    """
    size = size or min(LARGE_BLOCK, max(BLOCK_BYTES, 256 << part_bits(docs)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=level).compress
        for b in batches:
            for rows, offsets, data in K.text_groups(b.column(1), size):
                ids = b.column(0).take(pa.array(rows))
                none = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
                ids = ids.fill_null(int(LAST)).to_numpy()
                yield pa.record_batch({"block": [number], "ids": [ids.tobytes()], "none": [none.tobytes()], "offsets": [offsets.astype(np.int64).tobytes()], "text": [pack(data.tobytes())]})
                number += 1

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(chosen.mapInArrow(cut, "block long, ids binary, none binary, offsets binary, text binary"), "blocks", **LARGE_ROWS)


class Block:
    """A block's documents: identifiers, which of them are null, offsets and bytes."""

    def __init__(self, row: pa.Table | pa.RecordBatch, i: int) -> None:
        get = lambda name: row.column(name)[i].as_py()
        self.number, self.ids = get("block"), np.frombuffer(get("ids"), np.int64)
        self.none, self.offsets = np.frombuffer(get("none"), np.uint8), np.frombuffer(get("offsets"), np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(get("text"), max_output_size=max(1, int(self.offsets[-1])))
        self.data = np.frombuffer(self.raw, np.uint8)

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, mask=self.none.astype(bool))


def part_bits(df: DataFrame) -> int:
    """The parts of the hash range, as a power of two: some for each shuffle partition, so that partitions are even."""
    return min(PART_BITS, int(4 * shuffle_partitions(df.sparkSession) - 1).bit_length())


def coded(x: np.ndarray) -> bytes:
    """Values byte by byte, first all lowest bytes and so on: those of small or sorted values then compress to little."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def decoded(x: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def entries_schema(widths: str) -> str:
    return "part int, block long, " + ", ".join(f"e{i} binary" for i in range(len(widths) + 1))


def dealt(block: int, bits: int, keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """A block's entries, sorted by key, as one row for each part."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int32)
    at = np.flatnonzero(K.run_starts(part))
    ends = np.r_[at[1:], len(part)][: len(at)]
    columns = {"part": pa.array(part[at]), "block": pa.array(np.full(len(at), block, np.int64))}
    for i, x in enumerate((keys, *values)):
        columns[f"e{i}"] = pa.array([coded(x[s:e]) for s, e in zip(at, ends, strict=True)], pa.binary())
    return pa.record_batch(columns)


def emitted(blocks: DataFrame, widths: str, bits: int, entries: Callable[[Block], Entries]) -> DataFrame:
    """The entries of all blocks: keys (sorted, each once) and values of numpy types widths."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = Block(b, i)
                yield dealt(block.number, bits, *entries(block))

    return blocks.mapInArrow(emit, entries_schema(widths))


def met(entries: DataFrame, widths: str, answer: Callable[..., tuple[np.ndarray, Entries]], out_widths: str, with_block: bool = False) -> DataFrame:
    """What the parts answer: block and e0, e1, ...

    answer(first, group, *values) gets all entries of a part sorted by key: where each key's run begins, each
    entry's run, the values, and the blocks they are from if asked for; it returns which entries are answered and with
    what besides the key.
    """

    def meet(table: pa.Table) -> pa.Table:
        sizes = np.array([len(x.as_py()) // 8 for x in table.column("e0")], np.int64)
        block = np.repeat(table.column("block").to_numpy(), sizes)
        keys, *values = (np.concatenate([decoded(x.as_py(), t) for x in table.column(f"e{i}")]) for i, t in enumerate(["u8", *widths_of(widths)]))
        order = np.argsort(keys, kind="stable")
        keys, block, values = keys[order], block[order], [v[order] for v in values]
        new = K.run_starts(keys)
        chosen, extra = answer(np.flatnonzero(new), np.cumsum(new) - 1, *values, *[block] * with_block)
        block, out = block[chosen], [keys[chosen], *extra]
        order = np.argsort(block, kind="stable")
        block, out = block[order], [x[order] for x in out]
        at = np.flatnonzero(K.run_starts(block))
        ends = np.r_[at[1:], len(block)][: len(at)]
        columns = {"block": pa.array(block[at], pa.int64())}
        for i, (x, t) in enumerate(zip(out, ["u8", *widths_of(out_widths)], strict=True)):
            columns[f"e{i}"] = pa.array([coded(x[s:e].astype(t, copy=False)) for s, e in zip(at, ends, strict=True)], pa.binary())
        return pa.table(columns)

    schema = "block long, " + ", ".join(f"e{i} binary" for i in range(len(out_widths) + 1))
    return entries.groupBy("part").applyInArrow(meet, schema)


def widths_of(widths: str) -> list[str]:
    return [{"b": "u1", "i": "i4", "l": "i8", "u": "u8"}[w] for w in widths]


def answered(blocks: DataFrame, answers: DataFrame, out_widths: str, work: Callable[..., Iterator[pa.Table] | pa.Table], schema: str) -> DataFrame:
    """work(block, keys, *values) for each block with all answers to it, sorted by key."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.schema([])
        outs = []
        for i in range(left.num_rows):
            parts = [np.concatenate([decoded(x.as_py(), t) for x in right.column(f"e{k}")] or [np.empty(0, t)]) for k, t in enumerate(["u8", *widths_of(out_widths)])]
            order = np.argsort(parts[0], kind="stable")
            outs.append(work(Block(left, i), *(p[order] for p in parts)))
        return pa.concat_tables(outs) if outs else pa.table({}, schema=empty)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def found_in(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of wanted are among the sorted keys, and where."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at
