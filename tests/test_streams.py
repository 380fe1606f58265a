"""Clause states: any order, replays, timers, stops and resumes; snapshots of state tables."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Row

from docloom.streaming import checkpoints, clauses

T0 = datetime(2024, 1, 1)


def event(job, clause, seq, second, kind, status=None, reason=None):
    return (job, clause, seq, T0 + timedelta(seconds=second), kind, status, reason, f"text {seq}", f"loc {seq}")


def test_events_fold_alike_in_any_order():
    rng = random.Random(9)
    for _ in range(200):
        rows = [Row(seq=i, at=1_000_000 * i, kind=rng.choice(["saved", "marked", "error", "error", "other", None]), status=rng.choice(["complete", "queued", "needs_retrieval"]), reason=f"r{i}", text=f"t{i}", locator=None) for i in range(rng.randint(0, 12))]
        want = clauses.EMPTY
        for r in rows:
            want = clauses.with_event(want, r)
        mixed = rows + rng.sample(rows, len(rows) // 2)
        rng.shuffle(mixed)
        got = clauses.EMPTY
        for r in mixed:
            got = clauses.with_event(got, r)
        assert got == want and clauses.outcome(got) == clauses.outcome(want)


def write(spark, path, *events):
    spark.createDataFrame(list(events), clauses.EVENTS).coalesce(1).write.mode("append").parquet(path)


def take_in(spark, tmp_path):
    rows = spark.readStream.schema(clauses.EVENTS).parquet(str(tmp_path / "in"))
    clauses.run(rows, str(tmp_path / "table"), str(tmp_path / "checkpoint"))
    now = {(r["job"], r["clause"]): r for r in clauses.states(spark, str(tmp_path / "table")).collect()}
    return now, [(r["job"], r["clause"], r["change"], r["attempts"], r["due"]) for r in clauses.log(spark, str(tmp_path / "table")).collect()]


def test_a_stream_stops_and_resumes(spark, tmp_path):
    first = [event("j", "a", 1, 0, "saved"), event("j", "a", 2, 1, "error", reason="x"), event("j", "b", 3, 1, "marked", "complete"), event("j", "c", 4, 1, "error")]
    write(spark, str(tmp_path / "in"), *first, event("far", "z", 99, 60, "saved"))
    now, log = take_in(spark, tmp_path)
    assert {k: (r["status"], r["attempts"], r["text"]) for k, r in now.items()} == {("j", "a"): ("queued", 1, "text 1"), ("j", "b"): ("complete", 0, "text 3"), ("j", "c"): ("queued", 1, None), ("far", "z"): ("queued", 0, "text 99")}
    due = lambda s: T0 + timedelta(seconds=s)
    assert sorted(x for x in log if x[2] == "retry") == [("j", "a", "retry", 1, due(2)), ("j", "c", "retry", 1, due(2))]

    # the same again, and more errors: a fails after the fourth, b has ended, c is marked and starts anew
    more = [event("j", "a", 10 + i, 70 + i, "error", reason=f"e{i}") for i in range(3)] + [event("j", "b", 20, 70, "error"), event("j", "c", 21, 71, "error"), event("j", "c", 22, 72, "marked", "queued"), event("j", "c", 23, 73, "error"), event("far", "z", 98, 80, "saved")]
    write(spark, str(tmp_path / "in"), *first, *more, event("far", "y", 100, 200, "saved"))
    now, log2 = take_in(spark, tmp_path)
    assert {k: (r["status"], r["reason"], r["attempts"], r["text"]) for k, r in now.items() if k[0] == "j"} == {("j", "a"): ("failed", "e2", 4, "text 1"), ("j", "b"): ("complete", None, 0, "text 3"), ("j", "c"): ("queued", None, 1, "text 22")}
    assert now["far", "z"]["text"] == "text 98"  # the earlier event came later
    assert sorted(x for x in log2 if x[2] == "retry" and x not in log) == [("j", "c", "retry", 1, due(74))]

    # nothing but a replay: no rows
    write(spark, str(tmp_path / "in"), *first, *more)
    again, log3 = take_in(spark, tmp_path)
    assert again == now and sorted(log3, key=repr) == sorted(log2, key=repr)


def test_snapshots_stand_for_their_batches(spark, tmp_path):
    target, source = str(tmp_path / "state"), str(tmp_path / "in")
    schema = "k int, o int, v string, opened string"
    want = {}
    for n in range(7):
        rows = [(k, n, f"v{n}", f"o{n}") for k in range(n % 3, n % 3 + 3)]
        want |= {k: (n, f"v{n}", want[k][2] if k in want else f"o{n}") for k, *_ in rows}
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        checkpoints.latest_state(spark.readStream.schema(schema).parquet(source), ["k"], ["o"], target, str(tmp_path / "cp"), first=["opened"], compact_every=3)
        now = checkpoints.current(spark, target, ["k"], ["o"], first=["opened"])
        assert {r["k"]: (r["o"], r["v"], r["opened"]) for r in now.collect()} == want
    files = checkpoints.current(spark, target, ["k"], ["o"], first=["opened"]).inputFiles()
    assert {f.split("/state/")[1].split("/part")[0] for f in files} == {"batch=6", "snapshot/upto=5"}
