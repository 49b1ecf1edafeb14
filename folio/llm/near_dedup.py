"""Near-duplicate documents: BagMinHash signatures, bands, verified multiset overlap and components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import hot_join, materialize, numbered
from .components import components, looked_up
from .prefix_join import candidates

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4
#: All pairs of a bucket of so many members or fewer are candidates; a larger one is compared with its most central member.
SMALL_BUCKET = 8


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document and the hash of each shingle, sorted by both, and the number of words of each document.

    A document of fewer than n words has one shingle, all its words; one without words has none.
    """
    starts, ends, first = K.words(data, offsets)
    hashes = K.word_hashes(data, starts, ends)
    n_words = np.diff(first)
    long = K.grams(hashes, n)
    doc, place = K.spread(np.maximum(n_words - n + 1, 0))
    got = long[first[:-1][doc] + place]
    few = np.flatnonzero((n_words > 0) & (n_words < n))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            has = n_words[few] > k
            short[has] = K.mix(short[has] * K.GOLDEN + hashes[first[few[has]] + k] + np.uint64(k + 1))
        doc, got = np.concatenate([doc, few]), np.concatenate([got, short])
    order = np.lexsort((got, doc))
    return doc[order], got[order], n_words


def bag_minhash(doc: np.ndarray, shingle: np.ndarray, n_docs: int, size: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (n_docs by size) whose components agree with a chance equal to the multiset Jaccard similarity.

    The counts of a document's shingles are its weights. A shingle's weight axis is cut into the intervals [0, 1),
    [1, 2), [2, 4), [4, 8) and so on, each with a Poisson process in time whose rate is `size` times its length.
    A point has a component and a weight, and counts for a document whose weight of the shingle is above that;
    so an interval that a weight covers in part is thinned, and the parts need no processes of their own. A
    component is the time of its first point. Points come in the order of time, and those after the time by
    which all components are full are never made: about size * ln(size) for a document, however long it is.
    """
    new = K.run_starts(doc, shingle)
    at = np.flatnonzero(new)
    weight = np.diff(np.r_[at, len(doc)])
    doc, shingle = doc[at], shingle[at]
    total = np.bincount(doc, weight, n_docs)
    out = np.full((n_docs, size), np.inf)
    level = np.ceil(np.log2(weight)).astype(int) + 1
    who, j = K.spread(level)
    low = np.where(j > 0, 2.0 ** np.maximum(j - 1, 0), 0.0)
    width = np.where(j > 0, low, 1.0)
    seed = K.mix(shingle[who] + j.astype(np.uint64) * K.GOLDEN)
    of, weight = doc[who], weight[who]
    todo, reach = total > 0, np.log(size) + 4
    while todo.any():
        until = np.where(todo, reach / np.maximum(total, 1), -1.0)
        live = np.flatnonzero(todo[of])
        time, k = np.zeros(len(live)), 0
        while len(live):
            k += 1
            r = K.mix(seed[live] + K.multiple(2 * k))
            time = time - np.log(((r >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / (size * width[live])
            on = time <= until[of[live]]
            live, time = live[on], time[on]
            r = K.mix(seed[live] + K.multiple(2 * k + 1))
            part = ((r >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
            counts = low[live] + width[live] * ((r & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32) < weight[live]
            np.minimum.at(out.reshape(-1), of[live][counts] * size + part[counts].astype(np.int64), time[counts])
        todo &= np.isinf(out).any(1)
        reach *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    x = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    out = np.zeros(x.shape[:2], np.uint64) + K.mix(np.arange(1, bands + 1, dtype=np.uint64) * K.GOLDEN)
    for k in range(rows):
        out = K.mix(out * K.GOLDEN + x[:, :, k])
    return out.view(np.int64)


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()


def signed(docs: DataFrame, id_col: str, text_col: str, row_col: str) -> DataFrame:
    """row_no, doc_id, n_words, words (a digest of the word sequence, null without words) and bands."""

    @K.tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, offsets, data in K.text_groups(b.column(2)):
                doc, shingle, n_words = shingles(data, offsets)
                keys = band_keys(bag_minhash(doc, shingle, len(rows)))
                raw = data.tobytes()
                digest = [_digest(raw[s:e]) if n else None for s, e, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), n_words.tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
                at = pa.array(rows)
                yield pa.record_batch({"row_no": b.column(0).take(at), "doc_id": b.column(1).take(at), "n_words": pa.array(n_words, pa.int64()), "words": pa.array(digest, pa.binary()), "bands": lists})

    chosen = docs.select(F.col(row_col).alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(sign, "row_no long, doc_id long, n_words long, words binary, bands array<long>")


def first_candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes to verify, and the members of large buckets (key, node, leader).

    The leader of a large bucket is the member whose own buckets are largest in sum, as copies are most like what
    they were copied from; of equals the smallest.
    """
    members = nodes.select("node", "n_words", F.posexplode("bands").alias("band", "key")).drop("band")
    buckets = materialize(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    total = buckets.agg(F.sum("n")).first()[0] or 0
    kept = materialize(hot_join(members, buckets, ["key"], "n", total), "members")
    small = kept.filter(F.col("n") <= SMALL_BUCKET).select("key", "node", "n_words")
    other = small.select("key", F.col("node").alias("b"), F.col("n_words").alias("b_words"))
    pairs = small.join(other, "key").filter((F.col("node") < F.col("b")) & alike("n_words", "b_words")).select(F.col("node").alias("a"), "b")
    large = kept.filter(F.col("n") > SMALL_BUCKET).select("key", "node", "n")
    weight = large.groupBy("node").agg(F.sum("n").alias("weight"))
    ranked = large.join(weight, "node")
    leaders = materialize(ranked.groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), "node")).alias("best"), F.first("n").alias("n")).select("key", F.col("best.node").alias("leader"), "n"), "leaders")
    total = leaders.agg(F.sum("n")).first()[0] or 0
    large = materialize(hot_join(large.select("key", "node"), leaders, ["key"], "n", total).select("key", "node", "leader"), "large")
    stars = large.filter(F.col("node") != F.col("leader")).select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
    return pairs.unionByName(stars).distinct(), large


def alike(x: str, y: str, similarity: float = SIMILARITY):
    """Whether two numbers of words allow the similarity at all; texts of fewer words than a shingle are equal or unlike."""
    x, y = (F.greatest(F.col(c) - (SHINGLE - 1), F.lit(1)) for c in (x, y))
    return F.least(x, y) >= F.greatest(x, y) * F.lit(similarity) - F.lit(1e-9)


def bags(docs: DataFrame, nodes: DataFrame, text_col: str, row_col: str) -> DataFrame:
    """The shingles of the given nodes: node and bag, hashes sorted, the kth repetition of one a value of its own.

    A node is a row's number, so a text is met by one node at most, whatever identifiers are null or repeat.
    """

    @K.tidy
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, offsets, data in K.text_groups(b.column(1)):
                doc, shingle, _ = shingles(data, offsets)
                first = np.flatnonzero(K.run_starts(doc, shingle))
                again = np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))
                value = K.mix(shingle + again.astype(np.uint64) * K.GOLDEN)
                value, ends = value[np.lexsort((value, doc))], np.searchsorted(doc, np.arange(len(rows) + 1))
                out = [value[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.record_batch({"node": b.column(0).take(pa.array(rows)), "bag": pa.array(out, pa.binary())})

    texts = docs.select(F.col(row_col).alias("node"), F.col(text_col).cast("string").alias("text"))
    # Joined alike at every size: a table of nodes that just fits a broadcast doesn't foretell what the next larger one takes.
    return nodes.select("node").hint("shuffle_merge").join(texts, "node").select("node", "text").mapInArrow(collect, "node long, bag binary")


def verified(pairs: DataFrame, bag: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose multiset Jaccard similarity is as high as asked for: a, b, overlap, union. The member's bag travels
    to its leader's; a leader of many members is a skewed join key, which adaptive execution splits."""

    @K.tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            overlap, union = [], []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                overlap.append(same), union.append(len(x) + len(y) - same)
            out = pa.record_batch({"a": b.column(0), "b": b.column(1), "overlap": pa.array(overlap, pa.int64()), "union": pa.array(union, pa.int64())})
            yield out.filter(pa.array([s >= similarity * u - 1e-9 for s, u in zip(overlap, union, strict=True)], pa.bool_()))

    second = pairs.join(bag.withColumnRenamed("node", "b").withColumnRenamed("bag", "bag_b"), "b")
    both = second.join(bag.withColumnRenamed("node", "a").withColumnRenamed("bag", "bag_a"), "a")
    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(compare, "a long, b long, overlap long, union long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, row_col: str | None = None) -> DataFrame:
    """A row for each document: doc_id, class_id, group_id, kept, row_no, which is row_col if that is given.

    Documents of the same words are one class, class_id its smallest doc_id. Two classes are linked if the multiset
    Jaccard similarity of their shingles of five words is `similarity` or more; group_id is the smallest doc_id
    that links lead to, and one row of each group, of the smallest doc_id, is kept.

    Classes that share a band of their signatures meet in a bucket. Small buckets give all their pairs. In a
    larger one every member is compared with the most central member. Members that this leaves in another component
    than that one are then joined with all members of such buckets by an exact prefix filter (prefix_join.py), so
    that no link is lost for the size of a bucket. Every candidate is verified on the whole texts. A link of exactly
    0.8 is missed by all bands with a chance of 3 in a million.

    Words are runs of other characters than the six ASCII white spaces, case and punctuation included. Documents
    without words, null texts included, form no group and stay. Texts of fewer than five words are only ever
    equal or unlike. A null doc_id comes after all others; rows go by number, so identifiers may repeat. Very long texts
    are held one at a time. An empty table gives an empty result. Other columns are not read.
    """
    if row_col is None:
        docs, row_col = numbered(docs.select(F.col(id_col), F.col(text_col)))
    rows = materialize(signed(docs, id_col, text_col, row_col), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no", "n_words", "bands")
    classes = rows.filter("words IS NOT NULL").groupBy("words").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    nodes = materialize(classes.select("words", "n", F.col("first.row_no").alias("node"), F.col("first.doc_id").alias("doc_id"), F.col("first.none").alias("none"), F.col("first.n_words").alias("n_words"), F.col("first.bands").alias("bands")), "nodes")

    pairs, large = first_candidates(nodes)
    pairs = materialize(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    bag = materialize(bags(docs, wanted, text_col, row_col), "bags")
    links = materialize(verified(pairs, bag, similarity), "links")
    roots = components(links)

    heads = roots.select(F.col("node").alias("leader"), F.col("root").alias("head"))
    heads = large.select("leader").distinct().join(heads, "leader", "left").select("leader", F.coalesce("head", "leader").alias("head"))
    rooted = materialize(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    tagged = looked_up(rooted, "leader", heads, rooted.count()).select("key", "node", "root", (F.col("root") != F.col("head")).alias("stray"))
    tagged = materialize(tagged, "tagged")
    torn = tagged.groupBy("key").agg(F.max("stray").alias("torn"), F.count("*").alias("n")).filter("torn")
    torn = materialize(torn.select("key", "n"), "torn")
    if not torn.isEmpty():
        total = torn.agg(F.sum("n")).first()[0] or 0
        members = hot_join(tagged, torn, ["key"], "n", total).groupBy("node").agg(F.first("root").alias("root"), F.max("stray").alias("probe"))
        members = materialize(members.join(bag, "node"), "rest")
        more = materialize(candidates(members, similarity).join(pairs, ["a", "b"], "left_anti"), "more")
        if not more.isEmpty():
            links = materialize(links.unionByName(verified(more, members.select("node", "bag"), similarity)), "links")
            roots = components(links)

    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = named.groupBy("root").agg(F.min(F.struct("none", "doc_id", "node")).alias("keep"))
    named = materialize(named.join(firsts, "root").select("words", "n", F.col("doc_id").alias("class_id"), F.col("keep.doc_id").alias("group_id"), F.col("keep.node").alias("keep_row")), "named")
    total = named.agg(F.sum("n")).first()[0] or 0
    out = hot_join(rows.select("row_no", "doc_id", "words").filter("words IS NOT NULL"), named, ["words"], "n", total)
    alone = rows.filter("words IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), F.lit(True).alias("kept"), "row_no")
    return out.select("doc_id", "class_id", "group_id", (F.col("row_no") == F.col("keep_row")).alias("kept"), "row_no").unionByName(alone)


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_dedup() doesn't keep; all columns stay. Rows go by number, so identifiers may repeat or be null."""
    docs, row = numbered(docs)
    dropped = near_dedup(docs, id_col, text_col, row_col=row).filter(~F.col("kept")).select(F.col("row_no").alias(row))
    return docs.join(dropped, row, "left_anti").drop(row)
