"""Substring dedup: documents are parsed into factors of an indexed reference, the passages other documents have."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .blocks import Block, answered, dealt, emitted, found_in, met, part_bits, text_blocks
from .common import hot_join, materialize

#: Words of a window, and of the grams whose least hash in a window is its anchor.
WINDOW = 13
ANCHOR = 4
#: Bits of a window's hash that are used. Fewer give more equal hashes of unequal words, and the same results.
HASH_BITS = 64

#: What blocks send each other: their own claims, requests for passages, passages, and what was settled on whole words.
CLAIMS, REQUEST, PASSAGES, SETTLED = range(4)
MESSAGE = "block long, kind int, other long, a binary, b binary, c binary, d binary"


class Windows:
    """A block's words and, for each window of a document, where it starts, its document, its hash and its anchor."""

    def __init__(self, block: Block, size: int = WINDOW, bits: int = HASH_BITS) -> None:
        starts, ends, self.first = K.words(block.data, block.offsets)
        hashes = K.word_hashes(block.data, starts, ends)
        self.n_words = np.diff(self.first)
        self.doc, place = K.spread(np.maximum(self.n_words - size + 1, 0))
        self.start = self.first[:-1][self.doc] + place
        self.hash = K.grams(hashes, size)[self.start] >> np.uint64(64 - bits) << np.uint64(64 - bits)
        # The least hashes are all small; mixed again they spread over the parts.
        self.anchor = K.mix(K.sliding_min(K.grams(hashes, ANCHOR), size - ANCHOR + 1)[self.start])


def anchors(block: Block, size: int) -> list[np.ndarray]:
    """The index of a reference block: its anchors, and which of them several of its documents have."""
    w = Windows(block, size)
    new = K.run_starts(w.anchor, w.doc)
    anchor, doc = w.anchor[new], w.doc[new]
    order = np.lexsort((doc, anchor))
    anchor, doc = anchor[order], doc[order]
    first = np.flatnonzero(K.run_starts(anchor))
    last = np.r_[first[1:], len(anchor)][: len(first)] - 1
    return [anchor[first], (doc[first] != doc[last]).astype(np.uint8)]


def shared(first: np.ndarray, group: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, list]:
    """The anchors that more than one document has."""
    many = np.diff(np.r_[first, len(group)]) > 1
    many |= np.maximum.reduceat(several, first).astype(bool)
    return many[group], []


def block_windows(block: Block, keys: np.ndarray, size: int, hash_bits: int, bits: int) -> pa.Table:
    """The block's windows at shared anchors, each hash once: the least identifier that has it, whether another has it too,
    and the first word of that document's first such window."""
    w = Windows(block, size, hash_bits)
    on, _ = found_in(keys, w.anchor)
    value, doc, start = w.hash[on], block.ids[w.doc[on]], w.start[on]
    order = np.lexsort((start, doc, value))
    value, doc, start = value[order], doc[order], start[order]
    first = np.flatnonzero(K.run_starts(value))
    last = np.r_[first[1:], len(value)][: len(first)] - 1
    return pa.Table.from_batches([dealt(block.number, bits, value[first], doc[first], (doc[first] != doc[last]).astype(np.uint8), start[first].astype(np.int32))])


def predecessors(first: np.ndarray, group: np.ndarray, least: np.ndarray, several: np.ndarray, place: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, list]:
    """For blocks that may lose windows of a hash: the least identifier that has it, and the block and the window that
    come before this block's in the order of identifiers, or -1. So a block is asked for a window by one other at most."""
    order = np.lexsort((block, least, group))
    of = least[order[first]][group]
    before, at = np.full(len(group), -1, np.int64), np.zeros(len(group), np.int32)
    same = np.flatnonzero(group[order][1:] == group[order][:-1])
    before[order[same + 1]], at[order[same + 1]] = block[order[same]], place[order[same]]
    chosen = (least > of) | (several > 0)
    return chosen, [of[chosen], before[chosen], at[chosen]]


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.diff(np.asarray(x, np.int64), prepend=0).tobytes())


def unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64)) if x else np.empty(0, np.int64)


def messages(rows: list[tuple]) -> pa.Table:
    kinds = {"block": pa.int64(), "kind": pa.int32(), "other": pa.int64()}
    names = [c.split()[0] for c in MESSAGE.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds.get(name, pa.binary())) for k, name in enumerate(names)})


def claims(block: Block, keys: np.ndarray, of: np.ndarray, before: np.ndarray, at: np.ndarray, size: int, hash_bits: int) -> pa.Table:
    """The block's windows that may go, each with the window it is to be compared with, and the requests for those of
    other blocks. A window of the block's own first document that has it is compared with the block before; others with
    that document's."""
    w = Windows(block, size, hash_bits)
    hit, k = found_in(keys, w.hash)
    p, k, doc = w.start[hit], k[hit], w.doc[hit]
    order = np.lexsort((p, block.ids[doc], k))
    lead = np.flatnonzero(K.run_starts(k[order]))
    lead = np.repeat(lead, np.diff(np.r_[lead, len(order)]))
    mine = np.empty(len(p), np.int64)
    mine[order] = order[lead]
    local = block.ids[doc[mine]] != block.ids[doc]
    home, place = np.where(local, block.number, before[k]), np.where(local, p[mine], at[k])
    on = home >= 0
    p, home, place, of = p[on], home[on], place[on], of[k[on]]
    rows = [(block.number, CLAIMS, block.number, packed(p), packed(home), packed(place), packed(of))]
    far = np.stack([home, place])[:, home != block.number]
    far = np.unique(far, axis=1) if far.size else far
    new = np.flatnonzero(K.run_starts(far[0]))
    for s, e in zip(new.tolist(), [*new[1:].tolist(), far.shape[1]], strict=False):
        wanted = far[1, s:e]
        # Windows that share words are of one document; its range is sent once.
        begin = np.flatnonzero(np.r_[True, np.diff(wanted) >= size])
        end = np.r_[begin[1:], len(wanted)] - 1
        rows.append((int(far[0, s]), REQUEST, block.number, packed(wanted[begin]), packed(wanted[end] + size), None, None))
    return messages(rows)


class Words:
    """A block's words, each with a blank behind, and where they start in that."""

    def __init__(self, block: Block) -> None:
        starts, ends, self.first = K.words(block.data, block.offsets)
        self.at = np.r_[0, np.cumsum(ends - starts + 1)]
        o = block.offsets.tolist()
        kept = (b" ".join(block.raw[s:e].split()) for s, e in zip(o, o[1:], strict=False))
        self.raw = b"".join(x + b" " for x in kept if x)


def serve(block: Block, asked: pa.Table) -> pa.Table:
    """The passages that other blocks asked for, and the block's own claims, which go the same way."""
    rows, words = [], None
    for r in asked.to_pylist():
        if r["kind"] == CLAIMS:
            rows.append(tuple(r.values()))
            continue
        words = words or Words(block)
        begin, end = unpacked(r["a"]), unpacked(r["b"])
        text = b"".join(words.raw[s:e] for s, e in zip(words.at[begin].tolist(), words.at[end].tolist(), strict=True))
        ids = block.ids[np.searchsorted(words.first, begin, "right") - 1]
        rows.append((r["other"], PASSAGES, block.number, r["a"], r["b"], packed(ids), zstandard.ZstdCompressor(level=1).compress(text)))
    return messages(rows)


class Reference:
    """The text a block is parsed against: its own words and the passages it was sent, as one string of words."""

    def __init__(self, block: Block, words: Words, sent: list[dict]) -> None:
        n = len(words.at) - 1
        doc = np.repeat(np.arange(len(block.ids)), np.diff(words.first))
        self.homes = {block.number: (np.zeros(1, np.int64), np.array([n]), np.zeros(1, np.int64))}
        text, at, end, owner = [words.raw], [words.at[:-1]], [words.first[1:][doc]], [block.ids[doc]]
        size = len(words.raw)
        for r in sent:
            begin, length = unpacked(r["a"]), unpacked(r["b"])
            length = length - begin
            raw = zstandard.ZstdDecompressor().decompress(r["d"])
            first = n + np.cumsum(length) - length
            self.homes[r["other"]] = (begin, length, first)
            text.append(raw), at.append(size + np.r_[0, np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)[:-1] + 1])
            end.append(np.repeat(first + length, length)), owner.append(np.repeat(unpacked(r["c"]), length))
            n, size = n + int(length.sum()), size + len(raw)
        self.raw, self.at, self.end, self.owner = b"".join(text), np.r_[np.concatenate(at), size], np.concatenate(end), np.concatenate(owner)

    def find(self, home: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where words of other blocks are in this text."""
        out = np.empty(len(home), np.int64)
        order = np.argsort(home, kind="stable")
        new = np.flatnonzero(K.run_starts(home[order]))
        for s, e in zip(new.tolist(), [*new[1:].tolist(), len(order)], strict=False):
            which = order[s:e]
            begin, _, first = self.homes[int(home[which[0]])]
            r = np.searchsorted(begin, place[which], "right") - 1
            out[which] = first[r] + place[which] - begin[r]
        return out


def equal_words(words: Words, ref: Reference, p: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
    """Which windows have the words of those they are compared with. Windows in a row are compared as one string."""
    out = np.zeros(len(p), bool)
    new = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(q) != 1)][: len(p)])
    ends = np.r_[new[1:], len(p)][: len(new)] - 1
    a, b, c, d = (x.tolist() for x in (words.at[p[new]], words.at[p[ends] + size], ref.at[q[new]], ref.at[q[ends] + size]))
    for i, s, e in zip(range(len(new)), new.tolist(), ends.tolist(), strict=True):
        if words.raw[a[i] : b[i]] == ref.raw[c[i] : d[i]]:
            out[s : e + 1] = True
        elif e > s:
            out[s : e + 1] = [words.raw[words.at[x] : words.at[x + size]] == ref.raw[ref.at[y] : ref.at[y + size]] for x, y in zip(p[s : e + 1].tolist(), q[s : e + 1].tolist(), strict=True)]
    return out


def factors(words: Words, ref: Reference, p: np.ndarray, q: np.ndarray, earlier: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """A greedy parse: (window, first word, words) of each factor, the longest stretch of words from a window on that stands
    so in the passage it was paired with. Where that passage isn't of an earlier document (earlier), although an earlier one
    has the window, a factor ends with the last of the windows in a row of which that is known. The next factor begins with
    the first window that isn't whole within the one before, so windows over a boundary are looked at too."""
    stops = words.first.tolist()
    breaks = np.flatnonzero(np.r_[(np.diff(p) != 1) | (np.diff(np.searchsorted(words.first, p, "right")) != 0), True][: len(p)])
    last = p[breaks[np.searchsorted(breaks, np.arange(len(p)))]].tolist()
    stop_of = (np.searchsorted(words.first, p, "right")).tolist()
    starts, refs, k = p.tolist(), q.tolist(), 0
    while k < len(starts):
        x, y, known = starts[k], refs[k], int(words.at[starts[k] + size] - words.at[starts[k]])
        a, b = int(words.at[x]), int(ref.at[y])
        n = K.common(words.raw[a : words.at[stops[stop_of[k]]]], ref.raw[b : ref.at[ref.end[y]]], known)
        length = int(np.searchsorted(words.at, a + n, "right")) - 1 - x
        if not earlier[k]:
            length = min(length, last[k] + size - x)
        yield k, x, length
        k = int(np.searchsorted(p, x + length - size + 1, "left"))


SPANS = "doc_id long, n_words long, n_removed long, n_references long, factors array<struct<start:long,n_words:long,reference:long>>, kept string"


def parse(block: Block, sent: pa.Table, size: int, hash_bits: int) -> pa.Table:
    """The block's documents without the words of their factors, and the hashes that windows of unequal words share."""
    words, rows = Words(block), sent.to_pylist()
    p = q = of = settled = settled_of = disputed = np.empty(0, np.int64)
    ref = Reference(block, words, [r for r in rows if r["kind"] == PASSAGES])
    for r in rows:
        if r["kind"] == CLAIMS:
            p, of = unpacked(r["a"]), unpacked(r["d"])
            q = ref.find(unpacked(r["b"]), unpacked(r["c"]))
        elif r["kind"] == SETTLED:
            settled, settled_of = unpacked(r["a"]), unpacked(r["b"])
    doc_of = lambda x: np.searchsorted(words.first, x, "right") - 1
    alike = equal_words(words, ref, p, q, size)
    if not alike.all():
        w = Windows(block, size, hash_bits)
        disputed = w.hash[np.searchsorted(w.start, p[~alike])].view(np.int64)
    alike &= ~np.isin(p, settled)
    alike &= of < block.ids[doc_of(p)]
    p, q, of = p[alike], q[alike], of[alike]

    earlier = ref.owner[q] < block.ids[doc_of(p)]
    got = [(x, n, int(ref.owner[q[k]] if earlier[k] else of[k])) for k, x, n in factors(words, ref, p, q, earlier, size)]
    copy = settled_of < block.ids[doc_of(settled)] if len(settled) else np.empty(0, bool)
    got = sorted([*got, *((x, size, y) for x, y in zip(settled[copy].tolist(), settled_of[copy].tolist(), strict=True))])
    begin, length, reference = (np.array([g[k] for g in got], np.int64) for k in range(3))
    edge = np.zeros(words.first[-1] + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + length, -1)
    gone = np.cumsum(edge)[:-1] > 0
    # Windows in a row whose first document is the same.
    every, whose = np.r_[p, settled[copy]], np.r_[of, settled_of[copy]]
    order = np.argsort(every)
    every, whose = every[order], whose[order]
    runs = every[np.r_[True, (np.diff(every) != 1) | (np.diff(whose) != 0) | (np.diff(doc_of(every)) != 0)][: len(every)]]

    m, of_doc, n_words = len(block.ids), doc_of(begin), np.diff(words.first)
    n_removed = np.bincount(np.repeat(np.arange(m), n_words), gone, m).astype(np.int64)
    o, f, kept = block.offsets.tolist(), words.first.tolist(), []
    for i, n in enumerate(n_removed.tolist()):
        mine = [] if n == f[i + 1] - f[i] else block.raw[o[i] : o[i + 1]].split()
        kept.append(b" ".join(compress(mine, (~gone[f[i] : f[i + 1]]).tolist()) if n else mine))
    structs = pa.StructArray.from_arrays([pa.array(begin - words.first[:-1][of_doc]), pa.array(length), pa.array(reference)], names=["start", "n_words", "reference"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of_doc, minlength=m))], pa.int32()), structs)
    odd = pa.array([disputed if i == 0 and len(disputed) else None for i in range(m)], pa.list_(pa.int64()))
    return pa.table(
        {"doc_id": block.id_column(), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed), "n_references": pa.array(np.bincount(doc_of(runs), minlength=m), pa.int64()), "factors": lists}
        | {"kept": pa.array(kept, pa.binary()).cast(pa.string()), "disputed": odd}
    )


def settle(blocks: DataFrame, disputed: DataFrame, size: int, hash_bits: int) -> DataFrame:
    """Messages with all windows of the disputed hashes and the least identifier that has their very words: they are grouped
    by the words themselves. Such hashes are few, three million among ten million million windows."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = Block(b, i)
                w = Windows(block, size, hash_bits)
                yield pa.record_batch({"hash": pa.array(w.hash.view(np.int64)), "block": pa.array(np.full(len(w.hash), block.number)), "word": pa.array(w.start)})

    def texts(left: pa.Table, right: pa.Table) -> pa.Table:
        word, out = right.column("word").to_numpy(), {"block": [], "word": [], "id": [], "text": []}
        for i in range(left.num_rows if len(word) else 0):
            block = Block(left, i)
            words = Words(block)
            ids = block.ids[np.searchsorted(words.first, word, "right") - 1]
            for x, y in zip(word.tolist(), ids.tolist(), strict=True):
                out["block"].append(block.number), out["word"].append(x), out["id"].append(y), out["text"].append(words.raw[words.at[x] : words.at[x + size]])
        return pa.table({k: pa.array(v, pa.binary() if k == "text" else pa.int64()) for k, v in out.items()})

    def told(table: pa.Table) -> pa.Table:
        word, first = table.column("word").to_numpy(), table.column("first").to_numpy()
        order = np.argsort(word)
        return messages([(table.column("block")[0].as_py(), SETTLED, -1, packed(word[order]), packed(first[order]), None, None)])

    found = blocks.mapInArrow(places, "hash long, block long, word long").join(disputed, "hash", "left_semi")
    rows = materialize(blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(texts, "block long, word long, id long, text binary"), "texts")
    groups = materialize(rows.groupBy("text").agg(F.min("id").alias("first"), F.count("*").alias("n")), "firsts")
    total = groups.agg(F.sum("n")).first()[0] or 0
    return hot_join(rows, groups, ["text"], "n", total).select("block", "word", "first").groupBy("block").applyInArrow(told, MESSAGE)


def substring_dedup(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = HASH_BITS) -> DataFrame:
    """Removes words in windows of `size` words that also start in an earlier document: doc_id, n_words, n_removed,
    n_references (stretches of windows that the same first document has), factors (first word, words, an earlier document
    that has them) and kept, the words that stay with one blank between.

    The reference is all documents with smaller identifiers, in blocks that are indexed by anchors: of the grams of four
    words in a window the one with the least hash, so equal windows have equal anchors. A block's windows whose anchor
    another document has too are looked up by their hashes in all blocks' indexes. Each block asks the one before it, in
    the order of the identifiers that have the window, for the passages around, so that no block is asked by all others.
    Passages and the block's own documents are then its reference: documents are parsed greedily into the longest factors
    that stand there, and windows over a factor's boundary are looked at too.

    Words are compared, not hashes: each window with the one before it that has its hash. Hashes that unequal words share
    are told, their windows are grouped by their words, and the parse is repeated with what that settles.

    A null text has no words; texts of fewer words than a window lose none. Null identifiers come after all
    others. Rows that repeat an identifier are not earlier than each other and keep their words. A very long text
    is a block of its own, for which a worker needs some 35 times its size. An empty table gives an empty result. Other
    columns are not read.
    """
    # Blocks are written and sent once more, so that what the level saves counts twice.
    blocks = text_blocks(docs, id_col, text_col, level=9)
    bits = part_bits(docs)
    hits = met(emitted(blocks, "b", bits, lambda b: anchors(b, size)), "b", shared, "")
    entries = answered(blocks, hits, "", lambda b, keys: block_windows(b, keys, size, hash_bits, bits), "part int, block long, e0 binary, e1 binary, e2 binary, e3 binary")
    claimed = answered(blocks, met(entries, "lbi", predecessors, "lli", with_block=True), "lli", lambda b, *a: claims(b, *a, size, hash_bits), MESSAGE)

    def joined(rows: DataFrame, work, schema: str) -> DataFrame:
        run = lambda left, right: pa.concat_tables([work(Block(left, i), right) for i in range(left.num_rows)])
        return blocks.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(run, schema)

    served = joined(claimed, serve, MESSAGE)
    parsed = lambda rows: materialize(joined(rows, lambda b, sent: parse(b, sent, size, hash_bits), SPANS + ", disputed array<long>"), "parsed", compression="zstd", **{"parquet.compression.codec.zstd.level": "9"})
    out = parsed(served)
    disputed = out.filter("disputed IS NOT NULL").select(F.explode("disputed").alias("hash")).distinct()
    if not disputed.isEmpty():
        out = parsed(served.unionByName(settle(blocks, materialize(disputed, "disputed"), size, hash_bits)))
    return out.drop("disputed")
