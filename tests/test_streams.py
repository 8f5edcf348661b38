"""Streams that arrive file by file, late rows, repeated batches and restarts."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from chronolane.streaming import jobs as X

SCHEMA = "k string, v double"


@pytest.fixture
def place(tmp_path):
    return lambda name: f"file://{tmp_path}/{name}"


def files(spark, path, parts):
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def want(parts):
    by = {}
    for k, v in (r for p in parts for r in p):
        by.setdefault(k, []).extend([] if v is None else [v])
    return {k: (len(v), min(v, default=None), max(v, default=None), statistics.fmean(v) if v else None, statistics.variance(v) if len(v) > 1 else None) for k, v in by.items()}


def check(state, parts):
    got, right = {r.k: r for r in state.collect()}, want(parts)
    assert set(got) == set(right)
    for k, (n, lo, hi, mean, var) in right.items():
        r = got[k]
        assert (r.n, r["min"], r["max"]) == (n, lo, hi)
        assert mean is None or abs(r.mean - mean) < 1e-9 * max(1, abs(mean))
        assert var is None or abs(r.m2 / (n - 1) - var) < 1e-6 * max(1, var)


def test_state_survives_restarts_repeated_batches_and_compaction(spark, place):
    rng = random.Random(1)
    parts = [[(rng.choice(["a", "b", None, "c"]), rng.choice([None, rng.gauss(1e6, 3)])) for _ in range(rng.randint(1, 40))] for _ in range(9)] + [[("only null", None)]]
    path, state, marks = place("in"), place("state"), place("marks")
    files(spark, path, parts[:4])
    X.run_keyed_state(stream(spark, path), "k", "v", state, marks, compact_every=3)
    check(X.stored_state(spark, state, "k"), parts[:4])
    files(spark, path, parts[4:])
    X.run_keyed_state(stream(spark, path), "k", "v", state, marks, compact_every=3)
    check(X.stored_state(spark, state, "k"), parts)
    # everything again from the first batch on, as after the loss of the stream's own marks: nothing counts twice
    X.run_keyed_state(stream(spark, path), "k", "v", state, place("other"), compact_every=3)
    check(X.stored_state(spark, state, "k"), parts)


def test_an_unfinished_base_is_not_read(spark, place, tmp_path):
    parts = [[("a", 1.0)], [("a", 5.0)], [("b", 2.0)]]
    files(spark, place("in"), parts)
    X.run_keyed_state(stream(spark, place("in")), "k", "v", place("state"), place("marks"), compact_every=100)
    broken = tmp_path / "state" / "base=2"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    check(X.stored_state(spark, place("state"), "k"), parts)


def test_late_rows_are_counted_apart(spark, place):
    day = lambda n, h=0: f"2024-01-{n:02d} {h:02d}:00:00"
    parts = [[(day(1), 1.0), (day(1, 5), 3.0)], [(day(5), 7.0)], [(day(9), 2.0)], [(day(1), 9.0), (day(2), 9.0), (day(9, 3), 4.0)]]
    files(spark, place("in"), parts)
    rows = stream(spark, place("in")).select(F.col("k").cast("timestamp").alias("at"), "v", F.lit("x").alias("s"))
    X.run_updates(X.telemetry_window(rows, "at", "1 day", "s", "v", ["x"], ["y"], F.col("v") > 2, late="1 day"), place("out"), place("marks"))
    arrived = spark.read.parquet(place("in")).select(F.col("k").cast("timestamp").alias("at"), "v")
    got = {str(r.window_start)[:10]: (r.n, r.n_late, r.verification_rate, r.latency_p50, r.latency_max) for r in X.late_rows(arrived, X.newest(spark, place("out"), ["window_start"]), "at", "1 day").collect()}
    assert got == {"2024-01-01": (2, 1, 0.5, 1.0, 3.0), "2024-01-02": (0, 1, None, None, None), "2024-01-05": (1, 0, 1.0, 7.0, 7.0), "2024-01-09": (2, 0, 0.5, 2.0, 4.0)}


def test_the_table_twin_gives_the_same_rows(spark, place):
    rng = random.Random(2)
    parts = [[(f"2024-02-{d:02d} {rng.randint(0, 23):02d}:00:00", round(rng.random(), 3)) for _ in range(50)] for d in range(1, 7)]
    files(spark, place("in"), parts)
    shape = lambda df: df.select(F.col("k").cast("timestamp").alias("at"), "v", F.when(F.col("v") > 0.5, "x").otherwise("y").alias("s"))
    telemetry = lambda df, **k: X.telemetry_window(df, "at", "1 day", "s", "v", ["x"], ["y"], F.col("v") > 0.7, since="2024-02-02", **k)
    X.run_updates(telemetry(shape(stream(spark, place("in"))), late="1 day"), place("out"), place("marks"))
    twin = telemetry(shape(spark.read.parquet(place("in"))))
    assert sorted(map(tuple, X.newest(spark, place("out"), ["window_start"]).select(twin.columns).collect())) == sorted(map(tuple, twin.collect()))
    assert twin.count() == 5


def test_percentiles_of_large_windows_are_exact(spark):
    rng = random.Random(3)
    values = [rng.random() if rng.random() < 0.99 else None for _ in range(60_000)]
    rows = spark.createDataFrame([("2024-03-01 00:00:00", v) for v in values] + [("2024-03-02 00:00:00", None)], SCHEMA)
    counts = X.telemetry_counts(rows.select(F.col("k").cast("timestamp").alias("at"), "v", F.lit("x").alias("s")), "at", "1 day", "s", "v", ["x"], ["y"], F.col("v") > 0.5)
    got = {str(r.window_start)[:10]: r for r in X.telemetry_of_counts(counts).collect()}
    known, first = sorted(v for v in values if v is not None), got["2024-03-01"]
    assert (first.n, first.latency_max, first.answer_rate, first.refusal_rate) == (60_000, known[-1], 1.0, 0.0)
    for q, found in ((0.5, first.latency_p50), (0.95, first.latency_p95)):
        assert found == next(v for i, v in enumerate(known, 1) if i >= q * len(known))
    assert (got["2024-03-02"].n, got["2024-03-02"].latency_p50, got["2024-03-02"].latency_max) == (1, None, None)


def test_streamed_counts_give_the_windows_of_the_stream(spark, place):
    day = lambda n, h=0: f"2024-01-{n:02d} {h:02d}:00:00"
    parts = [[(day(1), 1.0), (day(1, 5), 3.0)], [(day(5), 7.0)], [(day(9), 2.0)], [(day(1), 9.0), (day(2), 9.0), (day(9, 3), 4.0), (day(9, 4), 2.0)]]
    files(spark, place("in"), parts)
    rows = stream(spark, place("in")).select(F.col("k").cast("timestamp").alias("at"), "v", F.lit("x").alias("s"))
    X.run_updates(X.telemetry_counts(rows, "at", "1 day", "s", "v", ["x"], ["y"], F.col("v") > 2, late="1 day"), place("out"), place("marks"))
    X.run_updates(X.telemetry_window(rows, "at", "1 day", "s", "v", ["x"], ["y"], F.col("v") > 2, late="1 day"), place("whole"), place("others"))
    whole = X.newest(spark, place("whole"), ["window_start"])
    got = X.telemetry_of_counts(X.newest(spark, place("out"), ["window_start", "latency"]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select(got.columns).collect()))
