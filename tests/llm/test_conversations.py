"""The prefix trie and the repair of conversations against brute force, on tables that hold the hard cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from compare import same_rows

from folio.llm import conversation_repair, conversation_trie, queries

ROWS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def talk(seed: int = 3, n: int = 260) -> list[tuple]:
    """Shared beginnings, whole copies, nulls, blanks, gaps, equal turns, families without a first member and a long conversation."""
    rng = random.Random(seed)
    said = ["Hi.", "Yes!", "And then?", "no end", "", " \t", None, "é 😀.", "ok.\n", "A! b", "x" * 50]
    out = []
    common = [("user", "Hi."), ("assistant", "Yes!"), ("user", "And then?"), ("assistant", "ok.\n")]
    for c in rng.sample([*range(0, 700), *range(-130, -90)], n) + [0, 100]:
        turns = list(common[: rng.randint(0, 4)]) if c % 3 else list(common)
        turns += [(rng.choice(["user", "assistant", "system", "tool", None, "", "user"]), rng.choice(said)) for _ in range(rng.randint(0, 5) if c % 7 else 0)]
        first = rng.choice([0, 0, 0, 5, -2])
        numbers = [first + i + (i > 2) * rng.choice([0, 0, 3]) for i in range(len(turns))]
        if c % 11 == 0 and numbers:
            numbers[-1] = None
        if c % 13 == 0 and len(numbers) > 1:
            numbers[1] = numbers[0]
        if c not in {r[0] for r in out}:
            out += [(c, k, *t) for k, t in zip(numbers, turns, strict=True)]
    out += [(9001, i, rng.choice(["user", "assistant"]), rng.choice(["Hi.", "no end", f"row {i}."])) for i in range(150)]
    out += [(None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (9002, None, None, None), (9002, None, None, None)]
    rng.shuffle(out)
    return out


def mark(role: str, text: str) -> str:
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def in_order(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1], r[2])))


@pytest.fixture(scope="module")
def rows():
    return talk()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], ROWS + ", name long, part string").repartition(3)


def brute_trie(rows: list[tuple]) -> list[tuple]:
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn, role or "", text or ""))
    turns = {c: [r[1:] for r in in_order(x)] for c, x in by.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = turns.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for p, m in members.items():
        children = [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p]
        under = [q for q in members if q[: len(p)] == p]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under) for q in under)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("run", [64, 4096])
def test_trie(table, rows, monkeypatch, run):
    monkeypatch.setattr(conversation_trie, "RUN", run)
    got = conversation_trie.prefix_trie(table)
    assert got.columns == TRIE and {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_of_copies(spark):
    """A third of all conversations are one; its end list is in several runs."""
    rows = [(c, i, "user", f"t{i}") for c in range(0, 900, 3) for i in range(12)] + [(c, 0, "user", str(c)) for c in range(1, 900, 3)]
    got = conversation_trie.prefix_trie(spark.createDataFrame(rows, ROWS).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], ROWS)).count() == 0
    got = conversation_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x"), (1, 0, "user", "x" * 300_000)], ROWS)).collect()
    # crc32("1") % 6 is 1: the only turn is replaced by none.
    assert [tuple(r) for r in got] == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


def hurt(rows: list[tuple]) -> dict:
    """Conversations after damage, in order."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c]
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            after = {1: "", 2: "".join(x for x in text if x not in ".!?")}.get(code, text)
            by[c] += [(turn, role, text, "user" if code == 4 else role, after)] * (1 + (code == 3))
    return {c: [(r[0], r[3], r[4]) for r in in_order(x)] for c, x in by.items()}


def brute_audit(rows: list[tuple]) -> tuple[int, str, str]:
    """All edits of a short conversation, by cost and letters; turns are put in where the grammar lets them."""
    best = None
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    limit = 3 * len(rows) + 5
    stack = [(0, 0, 0, "", ())]
    while stack:
        i, state, cost, audit, said = stack.pop()
        if cost > limit or (best and cost > best[0]):
            continue
        if i == len(rows) and state in (0, 3) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, "\n".join(said)
        for role in ("user", "assistant"):
            if (state, role[0]) in step:
                stack.append((i, step[state, role[0]], cost + 2, audit + "I", (*said, f"{role}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            stack.append((i + 1, state, cost + 3, audit + "D", said))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (state, role[:1]) in step:
                    stack.append((i + 1, step[state, role[:1]], cost + more, audit + "K", (*said, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (state, new[0]) in step:
                        stack.append((i + 1, step[state, new[0]], cost + 2 + more, audit + "R", (*said, f"{new}:{text}")))
    return best


def faults(rows: list[tuple]) -> list[tuple]:
    out, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute_counts(rows: list[tuple]) -> tuple:
    told = faults(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    kinds = [f for *_, f in told]
    odd = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(x) for x in ("blank", "duplicate", "truncated")), odd)


REPAIR = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("size", [2, 512])
def test_repair(table, rows, size):
    got = conversation_repair.repair_conversations(table, size)
    assert got.columns == REPAIR
    found, want = {r["conv_id"]: tuple(r)[1:] for r in got.collect()}, hurt(rows)
    assert set(found) == set(want) and got.count() == len(want)
    for c, after in want.items():
        assert found[c][:5] == brute_counts(after), c
        if len(after) <= 7:
            cost, audit, said = brute_audit(faults(after))
            assert found[c][5:] == (cost, audit, hashlib.sha256(said.encode()).hexdigest()), (c, after)


def test_repair_in_pieces(table):
    """The same rows, whatever the size of pieces; conversation 9001 has 150 rows."""
    a, b = (sorted(map(tuple, conversation_repair.repair_conversations(table, n).collect()), key=str) for n in (7, 512))
    assert a == b


def test_repair_of_nothing(spark):
    assert conversation_repair.repair_conversations(spark.createDataFrame([], ROWS)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conversation_repair.repair_conversations(spark.createDataFrame([(gone, 0, "user", "Hi.")], ROWS)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", EMPTY)]


def test_long_text_is_kept(spark):
    c = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    rows = [(c, 0, "user", "a " * 500_000 + "."), (c, 1, "assistant", " " * 500_000 + "b!" + " " * 100_000)]
    got = conversation_repair.repair_conversations(spark.createDataFrame(rows, ROWS)).first()
    said = "\n".join(f"{r}:{t}" for _, _, r, t in rows)
    assert (got["cost"], got["audit"], got["repaired_sha256"]) == (0, "KK", hashlib.sha256(said.encode()).hexdigest())


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_conversation_repair"])
def test_sql_of_odd_rows(spark, rows, tmp_path, name):
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    same_rows(queries.QUERIES[name](spark, str(tmp_path)), con, queries.SQL[name])
