from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from folio.sources import files
from folio.streaming import jobs, solver

T = datetime.datetime(2026, 1, 1)


def test_status_is_kept_over_batches(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    first = [("j", 1, "processing", "", 1, T), ("j", 2, "queued", "", 2, T)]
    second = [("j", 1, "done", "ok", 3, T), ("k", 1, "error", "x", 4, T)]
    for batch in (first, second):
        spark.createDataFrame(batch, jobs.EVENTS).coalesce(1).write.mode("append").parquet(source)
        jobs.write_status(jobs.events(spark, source), state, str(tmp_path / "log"), once=True).awaitTermination()
    got = sorted((r["job"], r["file"], r["status"]) for r in jobs.current(spark, state).collect())
    assert got == [("j", 1, "done"), ("j", 2, "queued"), ("k", 1, "error")]


def test_late_events_are_left_out(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("j", 1, "done", "", i, T + datetime.timedelta(minutes=m)) for i, m in enumerate((0, 1, 30))]
    spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.parquet(source)
    stream = jobs.late_counts(jobs.events(spark, source))
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    jobs.run_once(stream, out, log)
    spark.createDataFrame([("j", 1, "done", "", 9, T), ("j", 1, "done", "", 10, T + datetime.timedelta(minutes=90))], jobs.EVENTS).coalesce(1).write.mode("append").parquet(source)
    got = {(r["start"], r["n"]) for r in jobs.run_once(stream, out, log).collect()}
    assert (T, 2) in got and (T, 3) not in got and (T + datetime.timedelta(minutes=30), 1) in got


def test_answers_from_chunks(spark):
    rows = [("a", 2, "chunk", "b"), ("a", 1, "chunk", "a"), ("a", 3, "done", None), ("b", 1, "error", "x")]
    got = {r["request"]: (r["text"], r["finished"], r["failed"]) for r in jobs.answers(spark.createDataFrame(rows, jobs.CHUNKS)).collect()}
    assert got == {"a": ("ab", True, False), "b": ("", False, True)}


def test_finished_requests_are_appended(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "history")
    for rows in ([("a", 1, "chunk", "x"), ("a", 2, "done", "all of a")], [("b", 1, "error", "no"), ("c", 1, "done", "all of c")]):
        spark.createDataFrame(rows, jobs.CHUNKS).coalesce(1).write.mode("append").parquet(source)
        jobs.write_done(jobs.events(spark, source, jobs.CHUNKS), out, str(tmp_path / "log"), once=True).awaitTermination()
    assert sorted((r["request"], r["text"]) for r in spark.read.parquet(out).collect()) == [("a", "all of a"), ("c", "all of c")]


def test_sinks(spark, tmp_path):
    parts = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("e", 1, "c")], "doc string, pos int, text string")
    files.write_text(parts, str(tmp_path / "text"))
    assert (tmp_path / "text" / "doc=d").is_dir()
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "text")).collect()) == ["a", "b", "c"]
    files.write_many(parts, {"parquet": str(tmp_path / "p"), "json": str(tmp_path / "j")})
    assert spark.read.parquet(str(tmp_path / "p")).count() == spark.read.json(str(tmp_path / "j")).count() == 3
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "x.docx").write_bytes(b"1")
    assert files.files(spark, str(tmp_path / "up")).select(files.allowed(F.col("path"))).first()[0]


def solver_run(spark, tmp_path, rows):
    """What the solver tells after one more batch, from the checkpoint of those before."""
    source, out, log = (str(tmp_path / x) for x in ("chunks", "events", "log"))
    spark.createDataFrame([(r, s, k, t, T + datetime.timedelta(minutes=m)) for r, s, k, t, m in rows], solver.CHUNKS).coalesce(1).write.mode("append").parquet(source)
    before = set(map(tuple, spark.read.schema(solver.EVENTS).parquet(out).collect())) if (tmp_path / "events").exists() else set()
    stream = solver.solver_events(jobs.events(spark, source, solver.CHUNKS))
    solver.write_events(stream, out, log, once=True).awaitTermination()
    got = [tuple(r) for r in spark.read.schema(solver.EVENTS).parquet(out).collect()]
    assert len(got) == len(set(got)) or "late" in {g[1] for g in got}
    return sorted(set(got) - before)


def test_solver_over_restarts(spark, tmp_path):
    """Each call starts the query anew; chunks come out of order, twice, after the end and never."""
    first = [("a", 1, "chunk", "B", 0), ("a", 0, "chunk", "A", 0), ("b", 1, "chunk", "late", 0), ("c", 0, "chunk", "half", 0), ("d", 0, "chunk", "x", 0), ("d", 1, "error", "broken", 0), ("e", 0, "done", None, 0), (None, 0, "chunk", "lost", 0)]
    assert solver_run(spark, tmp_path, first) == [("a", "chunk", 0, "A"), ("a", "chunk", 1, "B"), ("c", "chunk", 0, "half"), ("d", "chunk", 0, "x"), ("d", "failed", 1, "broken"), ("e", "finished", 0, "")]
    second = [("a", 3, "done", "", 1), ("a", 1, "chunk", "again", 1), ("b", 0, "chunk", "not ", 1), ("d", 5, "chunk", "after", 1)]
    assert solver_run(spark, tmp_path, second) == [("b", "chunk", 0, "not "), ("b", "chunk", 1, "late"), ("d", "late", 5, "after")]
    third = [("a", 2, "chunk", "C", 2), ("clock", 0, "chunk", "", 8)]
    assert solver_run(spark, tmp_path, third) == [("a", "chunk", 2, "C"), ("a", "finished", 3, "ABC"), ("clock", "chunk", 0, "")]
    # c had its last chunk at 0 and b at 1; the watermark goes to 12, so both are stale, and d and e leave the state.
    fourth = [("clock", 1, "chunk", "tick", 13)]
    assert solver_run(spark, tmp_path, fourth) == [("b", "stale", 2, "not late"), ("c", "stale", 1, "half"), ("clock", "chunk", 1, "tick")]
    # What a stale request says later begins anew; rows behind the watermark are left out.
    fifth = [("c", 0, "chunk", "new", 13), ("c", 1, "done", "", 13), ("f", 0, "chunk", "too late", 3)]
    assert solver_run(spark, tmp_path, fifth) == [("c", "chunk", 0, "new"), ("c", "finished", 1, "new")]
    assert [r["text"] for r in solver.history(spark.read.parquet(str(tmp_path / "events"))).orderBy("text").collect()] == ["", "ABC", "new"]


class Kept(dict):
    """What stands for a map's or a value's state, and counts the calls."""

    calls = 0

    def __getattribute__(self, name):
        if name in ("containsKey", "getValue", "updateValue", "iterator", "clear", "update", "get"):
            Kept.calls += 1
        return dict.__getattribute__(self, name)

    containsKey, getValue, updateValue, iterator = dict.__contains__, dict.get, dict.__setitem__, dict.items  # noqa: N815


class Handle:
    def __init__(self):
        self.maps, self.timers = Kept(), []

    def getMapState(self, *_):  # noqa: N802
        return self.maps

    def getValueState(self, *_):  # noqa: N802
        values = Kept()
        return type("Value", (), {"get": lambda _: values.get(0), "update": lambda _, v: values.__setitem__(0, v), "clear": lambda _: values.clear()})()

    registerTimer, deleteTimer = lambda self, t: self.timers.append(t), lambda self, t: self.timers.remove(t)  # noqa: N815


def test_solver_asks_the_state_only_for_what_is_open(monkeypatch):
    """A request that comes and ends in one batch puts no chunk into the state; what stays open is there whole in the next."""
    monkeypatch.setattr(solver, "FRAME", 3)
    row = solver.Row("request", "seq", "type", "text", "ts", "ms")
    handle, s = Handle(), solver.Solver(1000)
    s.init(handle)
    say = lambda *rows: [tuple(r)[1:] for r in s.handleInputRows(("a",), iter([row("a", i, k, t, None, 5) for i, k, t in rows]), None)]
    n, Kept.calls = 50, 0
    got = say((n, "done", None), *[(i, "chunk", f"{i};") for i in reversed(range(n))])
    assert got == [*[("chunk", i, f"{i};") for i in range(n)], ("finished", n, "".join(f"{i};" for i in range(n)))]
    assert Kept.calls <= 3 and not handle.maps and handle.timers == [1005]
    assert say((7, "chunk", "again")) == [("late", 7, "again")]

    s.init(handle)
    assert say((3, "chunk", "D"), (0, "chunk", "A"), (1, "chunk", None), (1, "chunk", "twice"), (4, "chunk", "E")) == [("chunk", 0, "A"), ("chunk", 1, "")]
    assert handle.maps == {(0,): ("A",), (1,): ("",), (3,): ("D",), (4,): ("E",)}
    assert say((4, "chunk", "no"), (2, "chunk", "C"), (5, "done", "")) == [("chunk", 2, "C"), ("chunk", 3, "D"), ("chunk", 4, "E"), ("finished", 5, "ACDE")]
    assert not handle.maps

    s.init(handle)
    say((0, "chunk", "x"), (2, "chunk", "z"))
    assert [tuple(r)[1:] for r in s.handleExpiredTimer(("a",), None, None)] == [("stale", 1, "x")] and not handle.maps and s.about.get() is None
