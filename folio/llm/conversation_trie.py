"""The prefix trie of rebuilt conversations: partial tries merged in rounds, then summed from the leaves up."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize, shuffle_partitions
from .scan import scanned

#: Conversations whose numbers agree but for the last two decimals share the beginning of one of them.
FAMILY = 100
#: A conversation takes fewer turns than this from another.
HEADS = 6
#: Identifiers that one run of an end list spans, so a run has no more members, whatever the data.
RUN = 4096
#: Partial tries that one merge takes in.
FAN_IN_BITS = 3
KEY = ["k1", "k2"]
UP = ["p1", "p2"]


def marked_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, mark (a digest of role and text) and chars; texts stay behind."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    chosen = conversations.filter("conv_id IS NOT NULL")
    return chosen.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(said.cast("binary"), 256)).alias("mark"), F.length(text).cast("long").alias("chars"))


def taken(conv: str) -> Column:
    """How many turns of the family's first conversation stand for a conversation's own."""
    return F.crc32(F.col(conv).cast("string").cast("binary")) % HEADS


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows conv_id, depth, mark, chars of the rebuilt conversations, the root's row with depth 0, and conv_id with `length`."""
    turns = materialize(marked_turns(conversations).withColumn("row_no", F.monotonically_increasing_id()), "turns")
    own = scanned(turns, "conv_id", ["conv_id", "turn", "mark", "row_no"], "placed").select("conv_id", "place", "mark", "chars")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"base": base, "h": taken("conv_id")})
    heads = own.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEADS - 1)).withColumnRenamed("conv_id", "base")
    stock = heads.groupBy("base").agg(F.count("*").alias("stock"))
    got = F.least("h", F.coalesce("stock", F.lit(0)))
    shapes = sizes.join(stock, "base", "left").select("conv_id", "base", "n", "h", got.alias("got"), (got + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    shapes = materialize(shapes, "shapes")
    total = shapes.agg(F.sum("n")).first()[0] or 0
    roots = shapes.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("mark"), F.lit(0).cast("long").alias("chars"))
    # A family has 199 members at most, so no head meets more.
    begun = shapes.filter("got > 0").join(heads, "base").filter("place < got").select("conv_id", (F.col("place") + 1).alias("depth"), "mark", "chars")
    kept = hot_join(own, shapes.select("conv_id", "n", "h", "got"), ["conv_id"], "n", total).filter("place >= h")
    kept = kept.select("conv_id", (F.col("place") - F.col("h") + F.col("got") + 1).alias("depth"), "mark", "chars")
    return roots.unionByName(begun).unionByName(kept), shapes.select("conv_id", "n", "length")


def paths(rows: DataFrame) -> DataFrame:
    """conv_id, depth, chars, part and, of the node that the row is, its key and its parent's.

    A node's key is the XOR of two 64-bit hashes of each of its turns with their depth, so keys of a prefix follow from
    running XORs, in parts; equal keys of different prefixes have a chance of 2 ** -128 a pair. The root's key is zero.
    """
    hashed = lambda seed: F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "mark")).otherwise(F.lit(0).cast("long"))
    rows = materialize(rows.select("conv_id", "depth", "chars", hashed(1).alias("k1"), hashed(2).alias("k2"), hashed(1).alias("p1"), hashed(2).alias("p2")), "rebuilt")
    out = scanned(rows, "conv_id", ["conv_id", "depth"], "paths", KEY)
    return out.withColumns({p: F.col(p).bitwiseXOR(F.col(k)) for p, k in zip(UP, KEY, strict=True)})


def rounds(spark) -> int:
    return math.ceil(max(1.0, math.log2(max(2, shuffle_partitions(spark)))) / FAN_IN_BITS)


def merged(tables: DataFrame, keys: list[str], sums: dict[str, Column], combine: dict[str, Column]) -> DataFrame:
    """Partial tables, one a part, combined locally and merged in rounds: in each, the tables whose numbers agree but for
    FAN_IN_BITS bits become one. A key that all have is one row a table after the first, local, combination."""
    n = rounds(tables.sparkSession)
    out = tables.withColumn("run", F.pmod(F.col("part"), F.lit(1 << n * FAN_IN_BITS)))
    for k in range(n):
        out = out.withColumn("run", F.shiftright("run", FAN_IN_BITS)).groupBy("run", *keys).agg(*[c.alias(name) for name, c in (combine if k else sums).items()])
    return out.drop("run")


def node_table(rows: DataFrame) -> DataFrame:
    """A row for each node: its key, its parent's, depth, chars, conv_id (the smallest member) and n_convs."""
    first = {c: F.min(c) for c in (*UP, "depth", "chars", "conv_id")}
    return merged(rows, KEY, first | {"n_convs": F.count("*")}, first | {"n_convs": F.sum("n_convs")})


def end_lists(ends: DataFrame) -> DataFrame:
    """key and ends_sha256 of the nodes where conversations end (key, conv_id, part).

    Lists are in runs of the identifiers that one multiple of RUN begins; partial runs are merged in rounds. Runs don't
    overlap, so a node's digest is that of its runs in order: a task reads one run at a time and holds nothing else. A
    SHA-256 can't be split, so all runs of a node are read by one task, as text of which RUN members are a row.
    """
    block = ends.select(*KEY, (F.col("conv_id") - F.pmod("conv_id", F.lit(RUN))).alias("block"), "conv_id", "part")
    runs = merged(block, [*KEY, "block"], {"ids": F.collect_list("conv_id")}, {"ids": F.flatten(F.collect_list("ids"))})
    texts = runs.select(*KEY, "block", F.array_join(F.transform(F.array_sort("ids"), lambda i: i.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for b in batches:
            keys, found = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), []
            for key, ids in zip(keys, b.column(2).to_pylist(), strict=True):
                if key == last:
                    sha.update(b"," + ids.encode())
                    continue
                if last is not None:
                    found.append((*last, sha.hexdigest()))
                last, sha = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=[*KEY, "ends_sha256"])
        if last is not None:
            yield pa.record_batch({"k1": pa.array([last[0]], pa.int64()), "k2": pa.array([last[1]], pa.int64()), "ends_sha256": pa.array([sha.hexdigest()])})

    ordered = texts.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids")
    return ordered.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """key, leaves and saved (sums over the subtree) of the nodes that have two members or more.

    Nodes of one member have one leaf below and save nothing, so only the others are summed: in round r every node gives
    what the 2 ** r levels from it down hold to its ancestor 2 ** r levels up, and learns the ancestor twice as far. Rounds
    grow with the logarithm of the deepest shared prefix.
    """
    start = F.col("single") + (F.col("n_children") == 0).cast("long")
    table = nodes.filter("n_convs > 1").select(*KEY, F.when(F.col("depth") > 0, F.col("p1")).alias("p1"), F.when(F.col("depth") > 0, F.col("p2")).alias("p2"), "depth", start.alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    table = materialize(table, "sums")
    deepest = table.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(deepest).bit_length()):
        given = table.filter("p1 IS NOT NULL").groupBy(*UP).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"), F.count("*").alias("n"))
        given = materialize(given.withColumnsRenamed(dict(zip(UP, KEY, strict=True))), "given")
        total = given.agg(F.sum("n")).first()[0] or 0
        far = table.select(*KEY, *UP).join(given.select(*KEY, "n"), KEY).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), "n")
        jumped = hot_join(table.filter("p1 IS NOT NULL"), materialize(far, "far"), UP, "n", total).drop("n").drop(*UP).withColumnsRenamed({"q1": "p1", "q2": "p2"})
        all_rows = jumped.unionByName(table.filter("p1 IS NULL"), allowMissingColumns=True)
        summed = all_rows.join(given.drop("n"), KEY, "left")
        table = materialize(summed.select(*KEY, *UP, "depth", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), "sums")
    return table.select(*KEY, "leaves", "saved")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations, a row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation c takes the first crc32(c) % 6 turns of conversation c - c % 100 (all if it has fewer, none if there is
    no such conversation), then its own turns but for as many; a node is a sequence of first turns (role and text) that
    some have, the root the empty one. Tasks scan conversations in order, combine what they have into partial node tables
    and end lists, which are merged in rounds; sums over subtrees follow from the leaves up.

    Turns go by number, null first; turns of equal number go by the SHA-256 of "<bytes of role>:<role><text>", and turns
    equal in that too are alike. Null roles and texts are empty. Rows without a conv_id are no conversation's and are left
    out. A conversation left without turns is a member of the root alone. Long texts are hashed where they are read. An
    empty table has no nodes. Other columns are not read.
    """
    rows, shapes = rebuilt(conversations)
    path = paths(rows)
    nodes = materialize(node_table(path), "nodes")
    total = shapes.agg(F.sum("length")).first()[0] or 0
    ends = hot_join(path.select("conv_id", "depth", *KEY, "part"), shapes.select("conv_id", "length"), ["conv_id"], "length", total).filter("depth = length")
    lists = end_lists(ends.select(*KEY, "conv_id", "part"))

    children = nodes.filter("depth > 0").groupBy(*UP).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single")).withColumnsRenamed(dict(zip(UP, KEY, strict=True)))
    nodes = nodes.join(children, KEY, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_children", "single")})
    nodes = materialize(nodes.join(lists, KEY, "left"), "nodes")
    out = materialize(nodes.join(rolled_up(nodes), KEY, "left"), "rolled")
    above = out.filter("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size"))
    total = above.agg(F.sum("size")).first()[0] or 0
    below = hot_join(out.filter("depth > 0"), above, UP, "size", total).drop("size")
    tree = below.unionByName(out.filter("depth = 0"), allowMissingColumns=True)
    none = hashlib.sha256(b"").hexdigest()
    return tree.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
