"""Conversation structure repair: damaged conversations and the cheapest edits that make them well-formed again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize
from .scan import scanned

#: Rows of a conversation that one recursive query advances over; a longer one is cut into pieces, which are joined after.
PIECE = 512
#: Rows that one query is given, in whole pieces.
BATCH_ROWS = 8192
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Grammar of role initials, (s?(ua)+)?. States: nothing yet, after s, after u, after a; nothing and after a may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: (state, initial, next state)
STEPS = [(START, "s", SYSTEM), *((s, "u", USER) for s in (START, SYSTEM, ASSISTANT)), (USER, "a", ASSISTANT)]
NAMES = {"u": "user", "a": "assistant"}
BLANK_CHARACTERS = r"\x20\x09-\x0D"

#: Each recursion advances one row of all pieces at once and keeps, for each state that a piece may be entered in and each
#: that it may have reached, the least cost and of those the ASCII-least audit. Up to two turns are put in before a row: a
#: third would come back to the same state for more.
WALK = f"""
    WITH RECURSIVE
      steps(s, initial, t) AS (VALUES {", ".join(f"({s}, '{c}', {t})" for s, c, t in STEPS)}),
      puts AS (SELECT s, t, {INSERT} AS cost, 'I' AS letters FROM steps WHERE initial <> 's'),
      gaps AS (
        SELECT s, s AS t, 0 AS cost, '' AS letters FROM range(4) AS g(s)
        UNION ALL SELECT * FROM puts
        UNION ALL SELECT a.s, b.t, a.cost + b.cost, 'II' FROM puts a JOIN puts b ON a.t = b.s WHERE a.s <> b.t),
      moves AS (
        SELECT s, NULL AS initial, s AS t, {DELETE} AS cost, 'D' AS letter FROM range(4) AS g(s)
        UNION ALL SELECT s, initial, t, 0, 'K' FROM steps
        UNION ALL SELECT s, NULL, t, {REROLE}, 'R' FROM steps WHERE initial <> 's'),
      edits AS (
        SELECT g.s, m.t, m.initial, m.letter <> 'D' AS stays, CAST(g.cost + m.cost AS BIGINT) AS cost, g.letters || m.letter AS letters
        FROM gaps g JOIN moves m ON g.t = m.s),
      walk AS (
        SELECT piece, entry, CAST(0 AS BIGINT) AS i, entry AS state, {{'cost': CAST(0 AS BIGINT), 'audit': ''}} AS best FROM entries
        UNION ALL
        SELECT w.piece, w.entry, r.i, e.t, min({{'cost': w.best.cost + e.cost + CASE WHEN e.stays AND r.truncated THEN {TRUNCATED} ELSE 0 END, 'audit': w.best.audit || e.letters}})
        FROM walk w JOIN turns r ON r.piece = w.piece AND r.i = w.i + 1 JOIN edits e ON e.s = w.state
        WHERE (e.initial IS NULL OR e.initial = r.initial) AND NOT (e.stays AND r.must_go)
        GROUP BY ALL)
    SELECT w.piece, w.entry, w.state, w.best.cost AS cost, w.best.audit AS audit
    FROM walk w JOIN (SELECT piece, max(i) AS n FROM turns GROUP BY 1) l ON l.piece = w.piece AND l.n = w.i
    ORDER BY 1, 2, 3"""

Paths = dict[tuple[int, int], tuple[int, str]]


def walked(pieces: list[dict]) -> list[Paths]:
    """For each piece (number, first, and turns: initial, must_go, truncated) the best cost and audit by entry and exit state."""
    turns = {"piece": [], "i": [], "initial": [], "must_go": [], "truncated": []}
    entries = {"piece": [], "entry": []}
    for k, p in enumerate(pieces):
        for i, row in enumerate(p["rows"], 1):
            for name, value in zip(turns, (k, i, row["role"][:1], row["fault"] in ("blank", "duplicate"), row["fault"] == "truncated"), strict=True):
                turns[name].append(value)
        for s in range(1 if p["first"] else 4):
            entries["piece"].append(k), entries["entry"].append(s)
    with duckdb.connect(config={"threads": 1, "memory_limit": "512MB"}) as con:
        types = {"piece": pa.int64(), "i": pa.int64(), "entry": pa.int32(), "initial": pa.string(), "must_go": pa.bool_(), "truncated": pa.bool_()}
        con.register("turns", pa.table({k: pa.array(v, types[k]) for k, v in turns.items()}))
        con.register("entries", pa.table({k: pa.array(v, types[k]) for k, v in entries.items()}))
        found = con.execute(WALK).fetchall()
    out: list[Paths] = [{} for _ in pieces]
    for k, entry, state, cost, audit in found:
        out[k][entry, state] = cost, audit
    return out


def closed(state: int, cost: int, audit: str) -> tuple[int, str] | None:
    """cost and audit with the turns put in at the end that the state needs."""
    need = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}[state]
    return cost + need * INSERT, audit + "I" * need


def repaired(rows: list[dict], audit: str, state: int = START) -> Iterator[tuple[int, str, str]]:
    """(row, role, text) of what the edits of the audit leave, row -1 for what they put in, from a grammar state on."""
    i = 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        role = rows[i]["role"] if letter == "K" else "assistant" if state == USER else "user"
        yield (-1, role, "") if letter == "I" else (i, role, rows[i]["text"])
        i += letter != "I"
        state = next(t for s, c, t in STEPS if s == state and c == role[:1])


def digest(turns: Iterator[tuple[int, str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in turns).encode()).hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """name (the identifier as text, a blank if null), turn, role, text, again (the second of a repeated row) and `mark`, by which
    rows of one turn are ordered. The CRC-32 of "conv_id:turn" says what happens to a row."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text, role = told("text"), told("role")
    rows = conversations.select(told("conv_id").alias("name"), F.col("turn").cast("long").alias("turn"), role.alias("r"), text.alias("t"), code.alias("code"))
    mark = F.unhex(F.sha2(F.concat(F.octet_length("r").cast("string"), F.lit(":"), "r", "t").cast("binary"), 256))
    spoilt = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("t", "[.!?]", "")).otherwise(F.col("t"))
    out = rows.filter("code <> 0").select("name", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("r")).alias("role"), spoilt.alias("text"), mark.alias("mark"), (F.col("code") == 3).alias("twice"))
    return out.select("name", "turn", "role", "text", "mark", F.explode(F.when(F.col("twice"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("again"))


def fault() -> Column:
    """blank, truncated or null, by the row alone."""
    last = F.regexp_extract("text", rf"([^{BLANK_CHARACTERS}])[{BLANK_CHARACTERS}]*\z", 1)
    return F.when(~F.col("text").rlike(rf"[^{BLANK_CHARACTERS}]"), "blank").when(~last.isin(".", "!", "?"), "truncated")


COUNTS = ("blank", "duplicate", "truncated", "illegal")
PIECES = (
    "name string, piece long, ended boolean, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "turns long, first_turn long, last_turn long, cost long, audit string, repaired_sha256 string, "
    "paths array<struct<entry:int,state:int,cost:long,audit:string>>"
)


def summed(piece: dict, paths: Paths, size: int) -> dict:
    """A row of PIECES. A piece that is a whole conversation has its result."""
    rows = piece["rows"]
    kinds = [r["fault"] for r in rows]
    initials = [r["role"][:1] for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    out = {"name": piece["name"], "piece": piece["piece"], "ended": piece["first"] and len(rows) < size, "n": len(rows)} | {c: kinds.count(c) for c in COUNTS[:3]}
    out |= {"illegal": illegal(initials), "first": initials[0], "last": initials[-1], "turns": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None}
    if not out["ended"]:
        return out | {"paths": [{"entry": e, "state": s, "cost": c, "audit": a} for (e, s), (c, a) in paths.items()]}
    cost, audit = min(closed(s, *best) for (_, s), best in paths.items())
    return out | {"cost": cost, "audit": audit, "repaired_sha256": digest(repaired(rows, audit))}


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def pieces(placed: DataFrame, size: int) -> DataFrame:
    """PIECES of rows (name, piece, place, turn, role, text, fault), which are dealt by a hash of name and piece. A row without a
    role says that the row of its place repeats an earlier one."""
    names = ["name", "piece", "place", "turn", "role", "text", "fault"]
    schema = [f.split() for f in PIECES.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
        path = pa.list_(pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        out_schema = pa.schema([(c, types.get(t, path)) for c, t in schema])

        def told(some: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([summed(p, w, size) for p, w in zip(some, walked(some), strict=True)], schema=out_schema)

        for b in batches:
            for row in b.to_pylist():
                key = row["name"], row["piece"]
                if not held or (held[-1]["name"], held[-1]["piece"]) != key:
                    if n >= BATCH_ROWS:
                        yield told(held)
                        held, n = [], 0
                    held.append({"name": row["name"], "piece": row["piece"], "first": row["piece"] == 0, "rows": []})
                turns = held[-1]["rows"]
                if row["role"] is not None:
                    turns.append(row)
                    n += 1
                elif turns[-1]["fault"] != "blank":
                    turns[-1]["fault"] = "duplicate"
        if held:
            yield told(held)

    dealt = placed.select(*names).repartition("name", "piece").sortWithinPartitions("name", "piece", "place", F.col("role").isNull())
    return dealt.mapInArrow(work, PIECES)


JOINED = (
    "name string, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, cost long, audit string, "
    "entered array<struct<piece:long,entry:int,audit:string>>"
)


def joined(long: DataFrame) -> DataFrame:
    """JOINED of conversations in several pieces: their pieces in order, with the best cost and audit for each state carried on.

    A piece's row has 16 paths at most, of a letter or so for each of its rows, so a conversation has few rows here.
    """
    schema = [f.split() for f in JOINED.split(", ")]

    def fold(state: dict | None, p: dict) -> dict:
        if state is None:
            state = {c: 0 for c in (*COUNTS, "turns")} | {"name": p["name"], "first_turn": None, "last_turn": None, "last": None, "best": {START: (0, "", ())}}
        for c in COUNTS:
            state[c] += p[c]
        state["illegal"] += state["last"] is not None and illegal([state["last"], p["first"]])
        if p["turns"]:
            state["turns"] += p["turns"] - (state["last_turn"] == p["first_turn"])
            state["first_turn"] = p["first_turn"] if state["first_turn"] is None else state["first_turn"]
            state["last_turn"] = p["last_turn"]
        best: dict[int, tuple] = {}
        for path in p["paths"]:
            if path["entry"] in state["best"]:
                cost, audit, came = state["best"][path["entry"]]
                option = cost + path["cost"], audit + path["audit"], (came, (p["piece"], path["entry"], path["audit"]))
                if path["state"] not in best or option[:2] < best[path["state"]][:2]:
                    best[path["state"]] = option
        return state | {"last": p["last"], "best": best}

    def ended(state: dict) -> dict:
        (cost, audit), came = min((closed(s, cost, audit), came) for s, (cost, audit, came) in state["best"].items())
        steps, rest = [], audit
        while came:
            came, step = came
            steps.append(step)
        steps.reverse()
        tail = rest[sum(len(s[2]) for s in steps) :]
        steps[-1] = (*steps[-1][:2], steps[-1][2] + tail)
        return {c: state[c] for c, _ in schema if c in state} | {"cost": cost, "audit": audit, "entered": [dict(zip(("piece", "entry", "audit"), s, strict=True)) for s in steps]}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "long": pa.int64()}
        entered = pa.list_(pa.struct([("piece", pa.int64()), ("entry", pa.int32()), ("audit", pa.string())]))
        out_schema = pa.schema([(c, types.get(t, entered)) for c, t in schema])
        state = None
        for b in batches:
            for p in b.to_pylist():
                if state is not None and state["name"] != p["name"]:
                    yield pa.RecordBatch.from_pylist([ended(state)], schema=out_schema)
                    state = None
                state = fold(state, p)
        if state is not None:
            yield pa.RecordBatch.from_pylist([ended(state)], schema=out_schema)

    columns = ["name", "piece", "first", "last", *COUNTS, "turns", "first_turn", "last_turn", "paths"]
    return long.select(*columns).repartition("name").sortWithinPartitions("name", "piece").mapInArrow(work, JOINED)


def long_digests(placed: DataFrame, long: DataFrame) -> DataFrame:
    """name and repaired_sha256 of conversations in several pieces. Pieces are repaired apart; their texts are then hashed in
    order, a row at a time, in one task for a conversation, as a SHA-256 can't be split."""
    audits = long.select("name", F.explode("entered").alias("e")).select("name", "e.piece", "e.entry", "e.audit")

    def repair(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(left.to_pylist(), key=lambda r: r["place"])
        out = {"name": [], "piece": [], "i": [], "said": []}
        for a in right.to_pylist():
            for i, (_, role, text) in enumerate(repaired(rows, a["audit"], a["entry"])):
                for c, v in zip(out, (a["name"], a["piece"], i, f"{role}:{text}"), strict=True):
                    out[c].append(v)
        return pa.table({c: pa.array(v, pa.int64() if c in ("piece", "i") else pa.string()) for c, v in out.items()})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for b in batches:
            for name, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name == last:
                    sha.update(b"\n" + said.encode())
                    continue
                if last is not None:
                    yield pa.record_batch({"name": [last], "repaired_sha256": [sha.hexdigest()]})
                last, sha = name, hashlib.sha256(said.encode())
        if last is not None:
            yield pa.record_batch({"name": [last], "repaired_sha256": [sha.hexdigest()]})

    rows = placed.select("name", "piece", "place", "role", "text")
    said = rows.groupBy("name", "piece").cogroup(audits.groupBy("name", "piece")).applyInArrow(repair, "name string, piece long, i long, said string")
    return said.repartition("name").sortWithinPartitions("name", "piece", "i").select("name", "said").mapInArrow(hashed, "name string, repaired_sha256 string")


def repair_conversations(conversations: DataFrame, size: int = PIECE) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Conversations are damaged as the CRC-32 of "conv_id:turn" says, their faults are counted, and the cheapest edits are
    found that keep, rerole, delete and insert turns until the initials of the roles read (s?(ua)+)?. Rows are dealt by a
    hash of conversation and piece; DuckDB walks all pieces of a batch at once, a turn in each recursion, with the least
    cost and audit for each state of the grammar. A conversation of `size` rows or more is walked in pieces from every state,
    and the pieces are joined in order.

    Nulls of role, text, conv_id and turn are a blank where they are read as text; rows whose conv_id is null are one
    conversation. Turns go by number, null first; rows of one turn go by the SHA-256 of "<bytes of role>:<role><text>", and
    a repeated row stands beside its first. A conversation that loses all rows has zeros, an empty audit and the hash of
    an empty text. Long texts are held as one row. An empty table gives an empty result. Other columns are not read.
    """
    rows = damaged(conversations).withColumns({"said": F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), "row_no": F.monotonically_increasing_id()})
    # Equal rows beside each other may be taken in either order.
    placed = scanned(rows, "name", ["name", "turn", "mark", "again", "row_no"], "placed")
    said = placed.groupBy("name", "said").agg(F.min("place").alias("met"), F.count("*").alias("n")).filter("n > 1")
    said = materialize(said, "said")
    total = said.agg(F.sum("n")).first()[0] or 0
    again = hot_join(placed.select("name", "place", "said"), said, ["name", "said"], "n", total).filter("place > met")
    piece = F.floor(F.col("place") / size).alias("piece")
    placed = placed.select("name", "place", piece, "turn", "role", "text", fault().alias("fault"))
    found = materialize(pieces(placed.unionByName(again.select("name", "place", piece), allowMissingColumns=True), size), "pieces")
    short = found.filter("ended")
    long = materialize(joined(found.filter("NOT ended")), "joined")
    results = ["name", *COUNTS, "turns", "first_turn", "last_turn", "cost", "audit", "repaired_sha256"]
    both = short.select(*results)
    if not long.isEmpty():
        whole = placed.join(long.select("name").distinct(), "name", "left_semi")
        both = both.unionByName(long.join(long_digests(whole, long), "name", "left").select(*results))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("name", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    gaps = F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return ids.join(both, "name", "left").select(
        "conv_id", zero(gaps).alias("gaps"), *[zero(F.col(c)).alias(c) for c in (*COUNTS, "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
