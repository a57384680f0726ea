"""The streams over several micro-batches, stopped and started again, against plain loops."""

import os

import pytest
from pyspark.sql import functions as F

from folioflow.streaming import logs

SCHEMA = "event_id long, ts timestamp_ntz, op string, status string"
MINUTE = 60
# (operation, minute, status) by file; within a file the order of rows says nothing
FILES = [
    [("a", 30, "OK"), ("a", 5, "EMPTY"), ("b", 10, "RATE_LIMITED"), ("c", 12, "TIMEOUT"), ("c", 12, "OK")],
    [("a", 25, "OK"), ("d", 70, "OK"), ("d", 65, "RATE_LIMITED"), (None, 66, "OK")],
    [("b", 300, "OK"), ("d", 290, "TIMEOUT"), ("e", 295, "UNAVAILABLE")],
    [("b", 600, "RATE_LIMITED"), ("e", 310, "OK"), ("f", 601, "OK"), ("f", 600, "EMPTY")],
]


@pytest.fixture()
def log(spark, tmp_path):
    folder, n = tmp_path / "events", 0
    folder.mkdir()
    for i, rows in enumerate(FILES):
        d = spark.createDataFrame([(n + j, op, m * MINUTE, s) for j, (op, m, s) in enumerate(rows)], "event_id long, op string, s long, status string")
        d = d.select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "op", "status")
        d.toPandas().to_parquet(folder / f"{i}.parquet", coerce_timestamps="us", index=False)
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + 60 * i,) * 2)
        n += len(rows)
    return str(folder)


def numbered():
    flat = [r for rows in FILES for r in rows]
    return [(i, op, m, s) for i, (op, m, s) in enumerate(flat)]


def stream(spark, path, name):
    s = logs.LogStream(spark, path, SCHEMA, name, files_a_batch=1)
    return s, s.events.select(F.col("event_id").alias("attempt_id"), F.col("op").alias("operation_id"), "status", "ts")


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def first_by_operation():
    first = {}
    for i, op, m, _ in numbered():
        if op is not None:
            first[op] = min(first.get(op, (m, i)), (m, i))
    return sorted((op, i) for op, (_, i) in first.items())


def test_first_attempt_waits_for_earlier_ones(spark, log):
    s, a = stream(spark, log, "t-first")
    assert got(s.drain(logs.first_attempts(a, "operation_id")), "operation_id", "attempt_id") == first_by_operation()


def test_interrupted_operations_are_counted_on(spark, log):
    s, a = stream(spark, log, "t-state")
    updates = s.drain(logs.running_state(a))
    want, silent = {}, []
    for op in sorted({op for _, op, _, _ in numbered() if op is not None}):
        calls = sorted((m, i, st) for i, o, m, st in numbered() if o == op)
        for (m, _, st), after in zip(calls, [c[0] for c in calls[1:]] + [10**9]):
            if st in logs.DEGRADING and after - m > 60:
                silent.append((op, "FAILED", m * MINUTE * 1_000_000))
        want[op] = ("FAILED" if calls[-1][2] in logs.DEGRADING else calls[-1][2], len(calls))
    assert got(logs.last_state(updates), "operation_id", "status", "calls") == sorted((op, *v) for op, v in want.items())
    assert got(updates.where("silent"), "operation_id", "status", "at") == sorted(silent)


def test_restart_adds_only_new_files(spark, log):
    s, a = stream(spark, log, "t-restart")
    held = logs.attempt_windows(a.withColumn("provider", F.lit("P")))
    before = s.run(held).count()
    assert s.run(held).count() == before
    s.close("30 days")
    rows = s.run(held).selectExpr("cast(unix_seconds(start) / 3600 as int) as h", "calls", "failures").collect()
    want = {}
    for _, _, m, st in numbered():
        calls, failures = want.get(m // 60, (0, 0))
        want[m // 60] = (calls + 1, failures + (st != "OK"))
    assert sorted(map(tuple, rows)) == sorted((h, *v) for h, v in want.items())


def test_sessions_say_what_was_interrupted(spark, log):
    s, a = stream(spark, log, "t-sessions")
    out = s.drain(logs.operation_sessions(a))
    want = []
    for op in {op for _, op, _, _ in numbered() if op is not None}:
        calls = sorted((m, i, st) for i, o, m, st in numbered() if o == op)
        part = []
        for c in calls:
            if part and c[0] - part[-1][0] >= 120:
                want.append((op, part[0][0], len(part), part[-1][2] in logs.DEGRADING))
                part = []
            part.append(c)
        want.append((op, part[0][0], len(part), part[-1][2] in logs.DEGRADING))
    have = [(r[0], r[1], r[2], r[3]) for r in out.selectExpr("operation_id", "cast(unix_seconds(start) / 60 as int)", "calls", "interrupted").collect() if r[0] is not None]
    assert sorted(have) == sorted(want)
