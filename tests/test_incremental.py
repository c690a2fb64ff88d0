"""Roll-ups over several runs: late rows, repeated batches, snapshots."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldspark.streaming import incremental


@pytest.fixture
def run(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def one(days, after=16, files=1):
        rows = [(f"2024-01-{x:02d} 00:00:00", "ab"[x % 2], float(x)) for x in days]
        if rows:
            spark.createDataFrame(rows, "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts")).repartition(files).write.mode("append").parquet(src)
        schema = spark.createDataFrame([], "ts timestamp, k string, v double").schema
        incremental.rollup_new_files(spark, src, schema, out, ck, "ts", "v", ["k"], compact_after=after)
        return {(r.start.date().isoformat(), r.k): (r.n, r.v) for r in incremental.read_rollup(spark, out, ["k"]).collect()}

    one.out, one.ck = out, ck
    return one


def windows(days):
    """Tumbling weeks from the epoch, a Thursday: the 4th is one."""
    n, v = Counter(), Counter()
    for x in days:
        week = 4 + (x - 4) // 7 * 7
        key = f"2024-01-{week:02d}" if week > 0 else f"2023-12-{31 + week:02d}"
        n[key, "ab"[x % 2]] += 1
        v[key, "ab"[x % 2]] += x
    return {k: (n[k], float(v[k])) for k in n}


def test_incremental_runs_do_not_repeat(run):
    seen = []
    for days in ((1, 2, 9), (10, 16), (28,), ()):
        seen += days
        got = run(days)
        assert got == windows(seen)
    assert sum(n for n, _ in got.values()) == 6


def test_late_rows_count(run):
    assert run((28, 29)) == windows((28, 29))
    assert run((1, 8, 28)) == windows((28, 29, 1, 8, 28))  # weeks behind the latest window


def test_snapshots_hold_the_same_windows(spark, run):
    seen = []
    for k, days in enumerate(((1, 2), (9, 1), (16, 3), (4,), (30, 30))):
        seen += days
        assert run(days, after=2) == windows(seen)
    assert incremental._snapshot(spark, run.out) == 2
    before = set(os.listdir(f"{run.out}/parts"))
    assert before == {"after=0", "after=1", "after=2"}


def test_repeated_batch_changes_nothing(run):
    """A batch whose commit was lost runs again and replaces its folder."""
    run((1, 2, 9))
    want = run((3, 10))
    last = max((f for f in os.listdir(f"{run.ck}/commits") if f.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        os.remove(f"{run.ck}/commits/{name}")
    assert run(()) == want == windows((1, 2, 9, 3, 10))


def test_unfinished_snapshot_is_not_read(spark, run):
    want = run((1, 2, 9))
    spark.createDataFrame([("2024-01-01", "a", 5, 5.0)], "start string, k string, n long, v double").write.parquet(f"{run.out}/base/snapshot=1")  # no mark
    assert run(()) == want
    incremental.compact(spark, run.out, ["k"])
    assert run((5,)) == windows((1, 2, 9, 5))


def test_nothing_there(spark, tmp_path):
    with pytest.raises(ValueError, match="no roll-up"):
        incremental.read_rollup(spark, str(tmp_path / "none"), ["k"])
