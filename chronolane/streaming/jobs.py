"""Structured Streaming jobs over growing logs. Each has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.operators.ordered import join_by, running


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def telemetry_aggs(status: str, latency: str) -> list[Column]:
    s = F.col(status)
    return [F.count(F.lit(1)).alias("n"), F.count_if(s == "error").alias("n_error"), F.round(F.avg((s == "purchase").cast("int")), 6).alias("answer_rate"), F.round(F.max(latency), 6).alias("latency_max")]


def windowed_telemetry(events: DataFrame, at: str, width: str, status: str, latency: str, late: str = "1 hour") -> DataFrame:
    """window_start and telemetry of tumbling windows; works on streams (append mode) and tables alike."""
    e = events.withColumn("__at", F.col(at).cast("timestamp"))
    e = e.withWatermark("__at", late) if events.isStreaming else e
    return e.groupBy(F.window("__at", width)).agg(*telemetry_aggs(status, latency)).select(F.col("window.start").alias("window_start"), "n", "n_error", "answer_rate", "latency_max")


def keyed_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    return events.groupBy(key).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.stddev_samp(value), 6).alias("std"))


FACTS = "conv_id long, field string, value string, n_statements long, contradicted int"


def latest_facts(statements: DataFrame) -> DataFrame:
    """Latest value of each (conv_id, field) in order of turn, and whether it ever changed; for streams, update mode.

    statements: conv_id, field, turn, value. State is one short row for each key.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        turn, value, n, changed = state.get if state.exists else (-1, None, 0, 0)
        for frame in frames:
            for row in frame.sort_values("turn").itertuples():
                changed = int(changed or (n > 0 and row.value != value))
                n += 1
                if row.turn >= turn:
                    turn, value = row.turn, row.value
        state.update((int(turn), value, n, changed))
        yield pd.DataFrame({"conv_id": [key[0]], "field": [key[1]], "value": [value], "n_statements": [n], "contradicted": [changed]})

    return statements.groupBy("conv_id", "field").applyInPandasWithState(step, FACTS, "turn long, value string, n long, changed int", "update", "NoTimeout")


def latest_facts_batch(statements: DataFrame) -> DataFrame:
    return statements.groupBy("conv_id", "field").agg(F.max_by("value", "turn").alias("value"), F.count(F.lit(1)).alias("n_statements"), (F.count_distinct("value") > 1).cast("int").alias("contradicted"))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Processes what has arrived and stops."""
    q = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def run_batches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what each batch of a stream in update mode emits to Parquet; a batch that is run again appends equal rows again."""
    q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(path)).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()


def telemetry_window(events: DataFrame, at: str, width: str, status: str, latency: str, answered: list[str], refused: list[str], verified: Column, since: str | None = None, late: str | None = None) -> DataFrame:
    """window_start and, of each tumbling window: n, answer, refusal and verification rates, and the latency's p50, p95 and maximum.

    For windows of any size telemetry_counts and telemetry_of_counts give exact percentiles. Here they come from a mergeable sketch: the smallest value that at least the share reaches, exact up to tens of
    thousands of rows a window, and off by one rank in 20,000 beyond. verified is asked of answered rows only. since drops
    what is older; late, for a stream, is how far a row may lag behind the newest one before its window closes.
    """
    e = events.withColumn("__at", F.col(at).cast("timestamp"))
    e = e.filter(F.col("__at") >= F.lit(since).cast("timestamp")) if since else e
    e = e.withWatermark("__at", late) if late and events.isStreaming else e
    s, share = F.col(status), lambda c, of: F.round(F.try_divide(F.count_if(c).cast("double"), F.count_if(of)), 6)
    sketch = lambda q: F.percentile_approx(latency, q, 20_000)
    out = e.groupBy(F.window("__at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        share(s.isin(*answered), F.lit(True)).alias("answer_rate"),
        share(s.isin(*refused), F.lit(True)).alias("refusal_rate"),
        share(s.isin(*answered) & verified, s.isin(*answered)).alias("verification_rate"),
        sketch(0.5).alias("latency_p50"),
        sketch(0.95).alias("latency_p95"),
        F.max(latency).alias("latency_max"),
    )
    return out.select(F.col("w.start").alias("window_start"), *out.columns[1:])


def telemetry_counts(events: DataFrame, at: str, width: str, status: str, latency: str, answered: list[str], refused: list[str], verified: Column, since: str | None = None, late: str | None = None) -> DataFrame:
    """window_start, latency, n, answered, refused, verified: the counts of each tumbling window by latency, for telemetry_of_counts.

    Takes what telemetry_window takes. State is one short row for each window and latency, so a window of any size is many tasks' work.
    """
    e = events.withColumn("__at", F.col(at).cast("timestamp"))
    e = e.filter(F.col("__at") >= F.lit(since).cast("timestamp")) if since else e
    e = e.withWatermark("__at", late) if late and events.isStreaming else e
    s = F.col(status)
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(s.isin(*answered)).alias("answered"), F.count_if(s.isin(*refused)).alias("refused"), F.count_if(s.isin(*answered) & verified).alias("verified")]
    return e.groupBy(F.window("__at", width).alias("w"), F.col(latency).cast("double").alias("latency")).agg(*counts).select(F.col("w.start").alias("window_start"), "latency", "n", "answered", "refused", "verified")


def telemetry_of_counts(counts: DataFrame) -> DataFrame:
    """The columns of telemetry_window from telemetry_counts; a percentile is the smallest value that at least the share reaches, exactly."""
    share = lambda c, of: F.round(F.try_divide(F.sum(c).cast("double"), F.sum(of)), 6)
    out = counts.groupBy("window_start").agg(F.sum("n").alias("n"), share("answered", "n").alias("answer_rate"), share("refused", "n").alias("refusal_rate"), share("verified", "answered").alias("verification_rate"), F.max("latency").alias("latency_max"))
    known = counts.filter(F.col("latency").isNotNull()).groupBy("window_start", "latency").agg(F.sum("n").alias("n"))
    ranked = join_by(running(known, ["window_start"], "latency", ["n"]), known.groupBy("window_start").agg(F.sum("n").alias("__size")), ["window_start"])
    reached = lambda q: F.min(F.when(F.col("before_n") + F.col("n") >= F.col("__size") - F.floor(F.col("__size") - F.lit(q) * F.col("__size")), F.col("latency")))
    found = ranked.groupBy("window_start").agg(reached(0.5).alias("latency_p50"), reached(0.95).alias("latency_p95"))
    return join_by(out, found, ["window_start"], "left").select("window_start", "n", "answer_rate", "refusal_rate", "verification_rate", "latency_p50", "latency_p95", "latency_max")


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream in update mode until all that has arrived is read.

    Each batch writes its rows to a folder of its own number, in the place of what an earlier try of the same batch has left,
    so a batch that runs twice counts once.
    """

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of what run_updates wrote: each key's row of the last batch that has one."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")


def late_rows(arrived: DataFrame, counted: DataFrame, at: str, width: str) -> DataFrame:
    """counted with n_late: how many rows of each window arrived after it had closed. Windows that lost all their rows are there too, with n 0."""
    all_ = arrived.groupBy(F.window(F.col(at).cast("timestamp"), width).alias("w")).agg(F.count(F.lit(1)).alias("__n")).select(F.col("w.start").alias("window_start"), "__n")
    out = all_.join(counted, "window_start", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("n_late", F.col("__n") - F.col("n")).drop("__n")


STATE = ["n", "mean", "m2", "min", "max"]


def partial_state(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, mean, m2, min, max of the known values of each key: a state that merges with others of its kind."""
    known = F.count(value)
    return rows.groupBy(key).agg(known.alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_pop(value) * known, F.lit(0.0)).alias("m2"), F.min(value).alias("min"), F.max(value).alias("max"))


def merge_states(states: DataFrame, key: str) -> DataFrame:
    """One state for each key: counts add up, and m2 grows by the spread of the means about the common mean."""
    total = states.groupBy(key).agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"))
    apart = states.join(total.select(F.col(key).alias("__k"), F.col("mean").alias("__mean")), F.col(key).eqNullSafe(F.col("__k")))
    spread = apart.groupBy(key).agg(F.sum(F.col("m2") + F.coalesce(F.col("n") * F.pow(F.col("mean") - F.col("__mean"), F.lit(2.0)), F.lit(0.0))).alias("m2"))
    return total.join(spread.withColumnRenamed(key, "__k"), F.col(key).eqNullSafe(F.col("__k"))).select(key, *STATE)


def _numbered(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The numbers of finished batch= and base= folders."""
    jvm = spark._jvm
    here = jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[str, list[int]] = {"batch": [], "base": []}
    for status in fs.listStatus(here) if fs.exists(here) else []:
        kind, _, number = status.getPath().getName().partition("=")
        if kind in out and number.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            out[kind].append(int(number))
    return out


def stored_state(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The merged state of the last base and of all batches after it."""
    there = _numbered(spark, path)
    base = max(there["base"], default=-1)
    parts = [f"{path}/base={base}"] * (base >= 0) + [f"{path}/batch={b}" for b in sorted(there["batch"]) if b > base]
    return merge_states(spark.read.parquet(*parts), key)


def run_keyed_state(stream: DataFrame, key: str, value: str, path: str, checkpoint: str, compact_every: int = 16) -> None:
    """Adds what has arrived to the state at path, exactly once.

    Each batch writes its own partial state under its number, overwriting an earlier try, and no batch changes what another wrote; so
    a batch that is repeated after a failure leaves the state as it is. Every compact_every batches all states so far are merged
    into a base, which counts once its _SUCCESS is there; what it covers is no longer read.
    """

    def write(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        there = _numbered(spark, path)
        if number <= max(there["base"], default=-1):
            return
        partial_state(rows, key, value).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number % compact_every == compact_every - 1:
            stored_state(spark, path, key).write.mode("overwrite").parquet(f"{path}/base={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
