"""Suffix-array dedup: a distributed merge sort of suffixes, whose neighbours' common prefixes tell what is copied."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .blocks import Block, answered, coded, emitted, found_in, met, part_bits, text_blocks
from .common import materialize

LENGTH = 400
#: Bytes of the strings whose copies are told but not removed: those of passages of some 50 words.
PASSAGE = 250
#: Bytes of the grams whose least hash in a string is the string's anchor.
GRAM = 32
#: Suffixes of one anchor that are sorted together; those of a more frequent one are dealt by what is around it.
SORTED = 200_000
#: Suffixes that a member is compared with in each direction before its group is gone through by distances.
STEPS = 32
#: Bytes of suffixes that are merged at once.
MERGED_BYTES = 16 << 20
#: Low bits of a value that hold a position, so that of equal grams the leftmost is the anchor.
PLACE = np.uint64(30)


class Anchors:
    """The anchors of a block: where they are, their hashes, and the first and last start of strings that have them."""

    def __init__(self, block: Block, length: int) -> None:
        data, offsets = block.data, block.offsets
        self.length, n = length, len(data)
        self.at = self.key = self.low = self.high = np.empty(0, np.int64)
        if n < length:
            return
        sums, size = K.prefix(data), n - GRAM + 1
        inverse = K.powers(n + 1, inverse=True)
        gram = K.mix((sums[GRAM:] - sums[:size]) * inverse[:size])
        packed = (gram >> PLACE << PLACE) | np.arange(size, dtype=np.uint64)
        least = K.sliding_min(packed, length - GRAM + 1)
        fits = np.zeros(n + 1, np.int32)
        has = np.diff(offsets) >= length
        np.add.at(fits, offsets[:-1][has], 1)
        np.add.at(fits, offsets[1:][has] - length + 1, -1)
        start = np.flatnonzero(np.cumsum(fits[: len(least)]) > 0)
        at = (least[start] & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
        new = np.flatnonzero(K.run_starts(at))
        if len(new):
            self.at, self.low, self.high = at[new], start[new], start[np.r_[new[1:], len(at)] - 1]
            # The least hashes are all small; mixed again they spread over the parts.
            self.key = K.mix(gram[self.at])


def anchor_counts(block: Block, length: int) -> list[np.ndarray]:
    keys, counts = np.unique(Anchors(block, length).key.astype(np.uint64), return_counts=True)
    return [keys, counts.astype(np.int64)]


def repeated(first: np.ndarray, group: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list]:
    """The anchors that occur more than once anywhere, and how often."""
    total = np.add.reduceat(counts, first)[group] if len(first) else counts
    return total > 1, [total[total > 1]]


class Run:
    """A sorted run of suffixes, front-coded: bytes in common with the one before, and the rest. `lefts` is what stands
    before them, if it is to order equal ones."""

    def __init__(self, shared: np.ndarray, size: np.ndarray, rest: bytes, owner: object, lefts: Sequence[bytes] = ()) -> None:
        self.shared, self.size, self.rest, self.owner, self.lefts, self.i, self.pos, self.now = shared.tolist(), size.tolist(), rest, owner, lefts, 0, 0, b""

    def until(self, end: bytes | None) -> Iterator[tuple[bytes, int]]:
        """The suffixes before `end` (None: all) from where the last call stopped, and their places in the run."""
        while self.i < len(self.shared):
            h, n = self.shared[self.i], self.size[self.i]
            suffix = self.now[:h] + self.rest[self.pos : self.pos + n]
            if end is not None and suffix >= end:
                return
            yield suffix, self.i
            self.now, self.pos, self.i = suffix, self.pos + n, self.i + 1


def front_coded(sorted_suffixes: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    shared, rest, last = [], [], b""
    for s in sorted_suffixes:
        h = K.common(last, s)
        shared.append(h), rest.append(s[h:])
        last = s
    return np.array(shared, np.int32), np.array([len(x) for x in rest], np.int32), b"".join(rest)


def merged(runs: Sequence[Run], end: bytes | None = None) -> Iterator[tuple[bytes, int, Run, int]]:
    """The suffixes before `end` that are left, in order, each with the prefix it has in common with the one before, its
    run and its place there. The sort finds the runs in order and only merges them; prefixes are compared all at once."""
    order = sorted((s, r.lefts[i] if r.lefts else b"", k, i) for k, r in enumerate(runs) for s, i in r.until(end))
    shared = K.commons([s for s, *_ in order]).tolist()
    return ((s, h, runs[k], i) for (s, _, k, i), h in zip(order, [0, *shared], strict=False))


def by_left(lefts: Sequence[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order, in each group, of what stands before the members' anchors, backwards, and the prefix each has in
    common with the one before it in that order (-1: none of its group is)."""
    keys = list(zip(group.tolist(), lefts, strict=True))
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
    shared = np.r_[-1, K.commons([lefts[i] for i in order.tolist()])]
    shared[K.run_starts(group[order])] = -1
    return order, shared


def copied(right: np.ndarray, order: np.ndarray, left: np.ndarray, several: np.ndarray, least: np.ndarray, most: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which strings through one anchor also occur elsewhere: member, and the least and greatest distance from the
    string's start to the anchor.

    Members are in the order of the suffixes at the anchor; `right` has the common prefixes of neighbours, `order` and
    `left` those of what is before it, backwards, and their order. Members have the same string with the anchor at distance d if they are neighbours by
    length - d bytes to the right and also, in the order to the left, by d bytes. That changes at few distances, and
    between them one comparison holds for all.
    """
    g = len(order)
    low, high = int(least.min()), int(most.max())
    cuts = np.unique(np.concatenate([[low], left + 1, length - right]))
    cuts = cuts[(cuts >= low) & (cuts <= high)]
    # `since` holds where a member's current run of copied distances began; a run is given out when it ends.
    groups, was, since, out = np.zeros(g, np.int64), np.zeros(g, bool), np.zeros(g, np.int64), [np.empty((3, 0), np.int64)]

    def close(ended: np.ndarray, last: int) -> None:
        who = np.flatnonzero(ended)
        lo, hi = np.maximum(since[who], least[who]), np.minimum(last, most[who])
        on = lo <= hi
        out.append(np.stack([who[on], lo[on], hi[on]]))

    for d in cuts.tolist():
        groups[order[0]] = 0
        groups[order[1:]] = np.cumsum(left < d)
        both = groups.copy()
        both[1:] += np.cumsum(right < length - d) * g
        place = np.argsort(both, kind="stable")
        first = np.flatnonzero(K.run_starts(both[place]))
        times = np.diff(np.r_[first, g])
        now = several.copy()
        now[place[np.repeat(times > 1, times)]] = True
        close(was & ~now, d - 1)
        since[now & ~was] = d
        was = now
    close(was, high)
    return tuple(np.concatenate(out, axis=1))


def least_in_ranges(x: np.ndarray, most: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives the least of x[first..last], for ranges of up to `most` values."""
    levels = [x]
    while 2 << (len(levels) - 1) <= min(most, len(x)):
        half, last = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.r_[np.minimum(last[:-half], last[half:]), last[-half:]])
    table = np.stack(levels)

    def least(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp(last - first + 1)[1] - 1
        return np.minimum(table[level, first], table[level, last + 1 - (1 << level)])

    return least


def copied_after(right: np.ndarray, rank: np.ndarray, least: Callable, reach: np.ndarray, lengths: Sequence[int], steps: int) -> tuple[list[np.ndarray], np.ndarray]:
    """What copied() tells of all groups at once, from copies behind a member in the order of suffixes: member, least and
    greatest distance, and which of the lengths; and the members that have to look further than `steps`.

    A member and one that has `far` bytes in common with it to the right and `near` to the left have the same string at
    the distances from length - far to near. The further the other is, the less is `far`, so it only tells more if
    `near` is more than before; when no other can have that, as `reach` is the most that any has, the member is done.
    """
    i = np.arange(len(right))
    j, far, best, out = i, np.full(len(i), np.iinfo(np.int64).max), np.full((len(lengths), len(i)), -1), [np.empty((4, 0), np.int64)]
    for step in range(steps + 1):
        inside = j + 1 < len(right)
        i, j = i[inside], j[inside] + 1
        far = np.minimum(far[inside], right[j])
        on = np.zeros(len(i), bool)
        for known, length in zip(best, lengths, strict=True):
            on |= (far + reach[i] >= length) & (known[i] < reach[i])
        on &= far >= 0
        i, j, far = i[on], j[on], far[on]
        if not len(i) or step == steps:
            break
        a, b = rank[i], rank[j]
        near = least(np.minimum(a, b) + 1, np.maximum(a, b))
        for kind, length in enumerate(lengths):
            new = (far + near >= length) & (near > best[kind, i])
            best[kind, i[new]] = near[new]
            out.append(np.stack([i[new], np.maximum(length - far[new], 0), near[new], np.full(int(new.sum()), kind)]))
    return out, i


def copied_in_groups(group: np.ndarray, right: np.ndarray, size: np.ndarray, lefts: Sequence[bytes], several: np.ndarray, lengths: Sequence[int], steps: int = STEPS) -> np.ndarray:
    """copied() of groups that follow each other, for each of the lengths: member, least and greatest distance, and which
    length. `right` is the prefix in common with the member before, -1 for a group's first."""
    order, left = by_left(lefts, group)
    back, n = np.array([len(x) for x in lefts], np.int64), len(group)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    reach = np.maximum(left, np.r_[left[1:], -1])[rank]
    starts = np.flatnonzero(K.run_starts(group))
    ends = np.r_[starts[1:], n]
    least = least_in_ranges(left, int((ends - starts).max()))
    out, far = copied_after(right, rank, least, reach, lengths, steps)
    out_before, far_before = copied_after(np.r_[-1, right[:0:-1]], rank[::-1], least, reach[::-1], lengths, steps)
    for who, lo, hi, kind in out_before:
        out.append(np.stack([n - 1 - who, lo, hi, kind]))
    for kind, length in enumerate(lengths):
        low = np.maximum(length - size, 0)
        who = np.flatnonzero(several & (low <= back))
        out.append(np.stack([who, low[who], back[who], np.full(len(who), kind)]))
    # Members that many others are like to the right and not to the left: their groups are gone through by distances.
    for s in np.unique(starts[np.searchsorted(starts, np.r_[far, n - 1 - far_before], "right") - 1]).tolist():
        e = int(ends[np.searchsorted(starts, s)])
        for kind, length in enumerate(lengths):
            who, lo, hi = copied(right[s + 1 : e], order[s:e] - s, left[s + 1 : e], several[s:e], np.maximum(length - size[s:e], 0), back[s:e], length)
            out.append(np.stack([who + s, lo, hi, np.full(len(who), kind)]))
    return np.concatenate(out, axis=1)


RUN = "part int, block long, shared binary, size binary, rest binary, before binary, before_size binary, times binary, places binary"


def suffix_runs(block: Block, keys: np.ndarray, total: np.ndarray, short: int, length: int, bits: int, most: int) -> pa.Table:
    """The block's run for each part: suffixes at repeated anchors, after a group's hash, with what is before them.

    An anchor is a group. One of more than `most` occurrences is a group for each range of distances from a string's
    start to it, the narrower the more frequent it is, and for each content of what all strings of such distances
    have in common; a group sorts no more bytes than its strings have. Places with the same bytes on both sides are
    one suffix with several places.
    """
    a = Anchors(block, short)
    hit, where = found_in(keys, a.key.astype(np.uint64))
    at, key, far, near = a.at[hit], a.key[hit], (a.at - a.low)[hit], (a.at - a.high)[hit]
    width = np.maximum(1, short // -(-total[where[hit]] // most))
    which, k = K.spread(far // width - near // width + 1)
    from_d = ((near // width)[which] + k) * width[which]
    to_d = from_d + width[which] - 1
    at, key, dealt_out = at[which], key[which], width[which] < short
    if dealt_out.any():
        core = K.text_hash(K.prefix(block.data), (at - from_d)[dealt_out], (at + short - to_d)[dealt_out])
        key[dealt_out] = K.mix(core + from_d[dealt_out].astype(np.uint64) * K.GOLDEN)
    near, far = np.maximum(from_d, near[which]), np.minimum(to_d, far[which])
    ends = np.minimum(at - near + length, block.offsets[np.searchsorted(block.offsets, at, "right")])
    raw, suffixes = block.raw, {}
    for group, place, end, back in zip(key.tolist(), at.tolist(), ends.tolist(), far.tolist(), strict=True):
        suffixes.setdefault((group.to_bytes(8, "big") + raw[place:end], raw[place - back : place][::-1]), []).append(place)
    order = sorted(suffixes)
    part = np.array([int.from_bytes(s[:8], "big") >> (64 - bits) for s, _ in order], np.int64)
    rows: dict[str, list] = {c.split()[0]: [] for c in RUN.split(", ")}
    at = np.flatnonzero(K.run_starts(part)).tolist()
    for s, e in zip(at, [*at[1:], len(order)], strict=False):
        mine = order[s:e]
        shared, size, rest = front_coded([x for x, _ in mine])
        places = [suffixes[x] for x in mine]
        values = (int(part[s]), block.number, shared.tobytes(), size.tobytes(), rest, b"".join(x for _, x in mine), np.array([len(x) for _, x in mine], np.int32).tobytes(), np.array([len(x) for x in places], np.int32).tobytes(), np.array([p for x in places for p in x], np.int64).tobytes())
        for name, v in zip(rows, values, strict=True):
            rows[name].append(v)
    return pa.table({k: pa.array(v, {"part": pa.int32(), "block": pa.int64()}.get(k, pa.binary())) for k, v in rows.items()})


def joined(spans: np.ndarray) -> np.ndarray:
    """Spans (block, start, end, kind) in order of blocks, those that overlap in a block as one of their kind."""
    block, start, end, kind = spans = spans[:, np.lexsort((spans[1], spans[3], spans[0]))]
    if not len(block):
        return spans
    new = K.run_starts(block, kind)
    # Positions in a block are below 1 << 32, so the reach of one block and kind ends before the next one's starts.
    base = np.cumsum(new) << 32
    reach = np.maximum.accumulate(base + end)
    new[1:] |= (base + start)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(new)] - 1
    return np.stack([block[at], start[at], (reach - base)[last], kind[at]])


def merge_part(table: pa.Table, lengths: Sequence[int], bits: int) -> pa.Table:
    """Merges the runs of a part; for each block the starts and ends of bytes in copied strings of each of the lengths,
    and which of them it is. Some megabytes of suffixes, of whole groups, are merged at once."""
    runs, lefts, block, times, places, held = [], [], [], [], [], 0
    for k in range(table.num_rows):
        row = {name: table.column(name)[k].as_py() for name in table.column_names}
        get = lambda name, t=np.int32, row=row: np.frombuffer(row[name], t)
        cut = np.r_[0, np.cumsum(get("before_size"))].tolist()
        mine = [row["before"][s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)]
        runs.append(Run(get("shared"), get("size"), row["rest"], len(lefts), mine))
        lefts += mine
        block.append(np.full(len(mine), row["block"]))
        times.append(get("times").astype(np.int64))
        places.append(get("places", np.int64))
        held += int(get("shared").sum() + get("size").sum())
    block, times, places = (np.concatenate(x) for x in (block, times, places))
    first, low, cuts = np.cumsum(times) - times, int(table.column("part")[0].as_py()) << (64 - bits), held // MERGED_BYTES + 1
    found: list[np.ndarray] = []
    for c in range(1, cuts + 1):
        end = (low + (c << (64 - bits)) // cuts).to_bytes(8, "big") if c < cuts else None
        members = [(len(suffix) - 8, h - 8, run.owner + i) for suffix, h, run, i in merged(runs, end)]
        if not members:
            continue
        size, right, member = np.array(members, np.int64).T
        right[0] = -1
        who, lo, hi, kind = copied_in_groups(np.cumsum(right < 0), np.maximum(right, -1), size, [lefts[m] for m in member.tolist()], times[member] > 1, lengths)
        which, k = K.spread(times[member[who]])
        at = places[first[member[who]][which] + k]
        found.append(np.stack([block[member[who]][which], at - hi[which], at - lo[which] + np.array(lengths)[kind][which], kind[which]]))
    spans = joined(np.concatenate([np.empty((4, 0), np.int64), *found], axis=1))
    starts = np.flatnonzero(K.run_starts(spans[0]))
    ends = np.r_[starts[1:], spans.shape[1]][: len(starts)]
    e = [pa.array([coded(spans[k + 1, s:e].astype(t)) for s, e in zip(starts, ends, strict=True)], pa.binary()) for k, t in enumerate(("u8", "i8", "u1"))]
    return pa.table({"block": pa.array(spans[0, starts], pa.int64()), "e0": e[0], "e1": e[1], "e2": e[2]})


def covered(block: Block, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Which bytes are in [start, end) of any, and the documents' maximal runs of them."""
    edge = np.zeros(len(block.data) + 1, np.int64)
    np.add.at(edge, start.astype(np.int64), 1)
    np.add.at(edge, end, -1)
    on = np.cumsum(edge)[:-1] > 0
    inner = np.zeros(len(on) + 1, bool)
    inner[block.offsets[:-1]] = True
    up = np.flatnonzero(on & (inner[:-1] | ~np.r_[False, on[:-1]])) if len(on) else np.empty(0, np.int64)
    down = np.flatnonzero(on & (inner[1:] | ~np.r_[on[1:], False])) + 1 if len(on) else up
    of = np.searchsorted(block.offsets, up, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(up - block.offsets[of]), pa.array(down - up)], names=["start", "length"])
    return on, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=len(block.ids)))], pa.int32()), spans)


SPANS = "array<struct<start:long,length:long>>"


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", most: int = SORTED, passage: int = PASSAGE) -> DataFrame:
    """Removes every byte in a string of `length` bytes that also starts anywhere else: doc_id, n_bytes, spans (first byte,
    bytes; those removed, as long as they go), kept, the bytes that stay, in which characters may be cut, and passages,
    the spans of bytes in strings of `passage` bytes that also start elsewhere, which are told and not removed.

    Every string has an anchor, its 32-byte gram of the least hash (of its first bytes, if it is the longer of the two
    lengths), so equal strings are equal around equal anchors. Blocks first learn which of their anchors occur more
    than once. They sort the suffixes at those, with a group's hash in front, and send the runs front-coded in parts
    of the hash range. A part merges its runs, some megabytes at once;
    neighbours' common prefixes and those of what stands before the anchors tell, to the byte, which strings have
    copies. Suffixes are as long as the strings at an anchor reach. A group is an anchor; one of more than `most`
    occurrences is dealt to many groups by the bytes around it, which are sorted and merged like others.

    A null text is empty; shorter texts lose nothing. Texts may repeat within themselves. A document of more than a
    gigabyte fails. Rows that repeat are copies of each other. An empty table gives an empty result. Other columns
    are not read.
    """
    blocks = text_blocks(docs, id_col, text_col)
    bits, short, lengths = part_bits(docs), min(passage, length), (passage, length)
    hits = materialize(met(emitted(blocks, "l", bits, lambda b: anchor_counts(b, short)), "l", repeated, "l"), "anchors")
    runs = answered(blocks, hits, "l", lambda b, keys, total: suffix_runs(b, keys, total, short, max(lengths), bits, most), RUN)
    spans = runs.groupBy("part").applyInArrow(lambda t: merge_part(t, lengths, bits), "block long, e0 binary, e1 binary, e2 binary")

    def finish(block: Block, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> pa.Table:
        gone, removed = covered(block, start[kind == 1], end[kind == 1])
        _, told = covered(block, start[kind == 0], end[kind == 0])
        kept = []
        for s, e, n in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), removed.value_lengths().to_pylist(), strict=True):
            kept.append(block.data[s:e][~gone[s:e]].tobytes() if n else block.raw[s:e])
        return pa.table({"doc_id": block.id_column(), "n_bytes": pa.array(np.diff(block.offsets)), "spans": removed, "kept": pa.array(kept, pa.binary()), "passages": told})

    return answered(blocks, spans, "lb", finish, f"doc_id long, n_bytes long, spans {SPANS}, kept binary, passages {SPANS}")
