"""Readers and sinks on the driver tables: each query writes a table in a format and reads it back through the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.operators import derive as D
from chronolane.operators import screening as S
from chronolane.plans.base import query, t
from chronolane.sources import catalog as C
from chronolane.streaming import jobs as X



def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


_CUSTOMER = _struct(c_custkey=T.LongType(), c_nationkey=T.IntegerType(), c_mktsegment=T.StringType(), c_acctbal=T.DoubleType())


def _customers(spark, d):
    return t(spark, d, "customer").select(*(F.col(f.name).cast(f.dataType) for f in _CUSTOMER))


def _place(spark) -> str:
    return f"{C.scratch(spark)}/{uuid.uuid4().hex}"


def _csv(spark, d, **options):
    path = _place(spark)
    _customers(spark, d).write.option("header", True).options(**options).csv(path)
    return path


_ALL = "SELECT c_custkey, c_nationkey::INT AS c_nationkey, c_mktsegment, c_acctbal FROM customer"


@query("s01_csv_source", f"{_ALL}")
def s01(spark, d):
    return C.read_csv(spark, _csv(spark, d), _CUSTOMER).drop("_bad_record")


@query("s02_filtered_csv", f"{_ALL} WHERE c_nationkey IN (1, 3, 5) AND c_acctbal > 0")
def s02(spark, d):
    return C.read_csv_filtered(spark, _csv(spark, d), _CUSTOMER, F.col("c_nationkey").isin(1, 3, 5), lambda x: x.filter("c_acctbal > 0"))


@query("s03_gzip_csv", f"{_ALL}")
def s03(spark, d):
    path = _csv(spark, d, compression="gzip")
    return C.read_csv(spark, C.csv_path(spark, path), _CUSTOMER).drop("_bad_record")


def _specs(d):
    return [C.TableSpec(n, f"{d}/{n}.parquet", keys=k) for n, k in (("nation", ("n_nationkey",)), ("region", ("r_regionkey",)), ("customer", ("c_custkey",)))]


@query("s04_catalog_load", "SELECT 'nation' AS table_name, count(*) AS n_rows, 0::BIGINT AS n_duplicate_keys, 'loaded' AS status FROM nation UNION ALL SELECT 'region', count(*), count(*) - count(DISTINCT r_regionkey), 'loaded' FROM region UNION ALL SELECT 'customer', count(*), count(*) - count(DISTINCT c_custkey), 'loaded' FROM customer")
def s04(spark, d):
    return C.load_report(spark, _specs(d))


@query("s05_missing_table", "SELECT 'absent' AS table_name, 0::BIGINT AS n_rows, 0::BIGINT AS n_duplicate_keys, 'missing' AS status UNION ALL SELECT 'region', count(*), 0::BIGINT, 'loaded' FROM region")
def s05(spark, d):
    absent = C.TableSpec("absent", f"{d}/no_such_table.parquet", _CUSTOMER, keys=("c_custkey",), optional=True)
    return C.load_report(spark, [absent, *(s for s in _specs(d) if s.name == "region")])


@query("s09_parquet_sink", "SELECT c_nationkey::INT AS c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def s09(spark, d):
    path = _place(spark)
    C.save(_customers(spark, d), path, ["c_nationkey"])
    return spark.read.parquet(path).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("s11_resume", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def s11(spark, d):
    path = _place(spark)
    C.resume(spark, path, lambda: _customers(spark, d).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")))
    return C.resume(spark, path, lambda: spark.createDataFrame([], "c_mktsegment string, n long"))


_LOG = _struct(event_id=T.LongType(), user_id=T.LongType(), ts=T.TimestampType(), event_type=T.StringType())


def _log(spark, d):
    path = _place(spark)
    e = t(spark, d, "events").select("event_id", F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    C.append_jsonl(e.filter("event_id % 2 = 0"), path)
    C.append_jsonl(e.filter("event_id % 2 = 1"), path)
    return path


@query("s12_jsonl_append", "SELECT event_id, user_id::BIGINT AS user_id, event_type FROM events")
def s12(spark, d):
    return C.read_jsonl(spark, _log(spark, d), _LOG).select("event_id", "user_id", "event_type")


@query("s13_jsonl_since", "SELECT event_id, user_id::BIGINT AS user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'")
def s13(spark, d):
    return C.read_jsonl(spark, _log(spark, d), _LOG, since="2024-01-15 12:00:00").select("event_id", "user_id", "event_type")


@query("s14_rule_tables", "SELECT 'n' || n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'missing severity' WHEN n_nationkey % 7 = 1 THEN 'unknown severity' WHEN n_regionkey = 2 THEN 'repeated id' END AS problem FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'r2', CASE WHEN n_nationkey % 5 = 0 THEN 'missing severity' WHEN n_nationkey % 7 = 1 THEN 'unknown severity' ELSE 'repeated id' END FROM nation WHERE n_regionkey = 2")
def s14(spark, d):
    path = _place(spark)
    k = F.col("n_nationkey")
    rules = t(spark, d, "nation").select(F.when(F.col("n_regionkey") == 2, "r2").otherwise(F.concat(F.lit("n"), k.cast("string"))).alias("id"), F.col("n_name").alias("label"), F.when(k % 5 == 0, None).when(k % 7 == 1, "loud").otherwise("urgent").alias("severity"))
    rules.write.json(path)
    return C.read_rules(spark, path, "id string, label string, severity string", "id", ["label", "severity"], {"severity": ["urgent", "emergency"]}).select("id", "problem")


@query("p04_wildcard_exclusion", f"SELECT pattern, count(column_name) AS n_columns, string_agg(column_name, ',' ORDER BY column_name) AS columns FROM (VALUES ('l_*key'), ('l_*date'), ('l_ta?'), ('nothing*')) AS p(pattern) LEFT JOIN (DESCRIBE lineitem) ON regexp_full_match(column_name, replace(replace(pattern, '*', '.*'), '?', '.')) GROUP BY 1")
def p04(spark, d):
    columns = t(spark, d, "lineitem").columns
    rows = [(p, len(m), ",".join(sorted(m)) or None) for p in ("l_*key", "l_*date", "l_ta?", "nothing*") for m in [[c for c in columns if D.match_patterns([c], [p])]]]
    return spark.createDataFrame(rows, "pattern string, n_columns long, columns string")


LISTS = {"keys": ["l_*key"], "dates": ["l_*date", "l_*_at"], "prices": ["l_extended*", "l_tax", "l_discount"]}
_DROPPED = {"strict": ["keys", "dates", "prices"], "dated": ["dates"]}
_LIKE = " OR ".join
_KEEP_SQL = {n: _LIKE(f"column_name LIKE '{p.replace('*', '%')}'" for k in ks for p in LISTS[k]) for n, ks in _DROPPED.items()}


@query("p04_protocols", " UNION ALL ".join(f"SELECT '{n}' AS protocol, column_name FROM (DESCRIBE lineitem) WHERE NOT ({w})" for n, w in _KEEP_SQL.items()) + " UNION ALL SELECT 'unmatched in ' || p, 'l_*_at' FROM (VALUES ('strict'), ('dated')) AS v(p) WHERE NOT EXISTS (SELECT 1 FROM (DESCRIBE lineitem) WHERE column_name LIKE 'l_%_at')")
def p04_protocols(spark, d):
    li = t(spark, d, "lineitem")
    rows = []
    for name, lists in _DROPPED.items():
        kept, unmatched = D.protocol(li, LISTS, lists)
        rows += [(name, c) for c in kept.columns] + [(f"unmatched in {name}", p) for p in unmatched]
    return spark.createDataFrame(rows, "protocol string, column_name string")


@query("f09_selected_dataset", "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_discount FROM lineitem")
def f09(spark, d):
    return S.selected(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_returnflag"], ["l_quantity", "l_discount", "not_there", "l_orderkey"])


@query("x03_streamed_facts", "SELECT user_id::BIGINT AS conv_id, event_type AS field, arg_max(CASE WHEN value > 5 THEN 'high' ELSE 'low' END, event_id) AS value, count(*) AS n_statements, (count(DISTINCT value > 5) > 1)::INT AS contradicted FROM events GROUP BY 1, 2")
def x03(spark, d):
    """The log is written as files, streamed with state until all has arrived, and each key's last row is its state."""
    path, out = _place(spark), _place(spark)
    e = t(spark, d, "events").select(F.col("user_id").cast("long").alias("conv_id"), F.col("event_type").alias("field"), F.col("event_id").alias("turn"), F.when(F.col("value") > 5, "high").otherwise("low").alias("value"))
    e.write.json(path)
    states = X.latest_facts(X.read_stream(spark, path, _struct(conv_id=T.LongType(), field=T.StringType(), turn=T.LongType(), value=T.StringType())))
    X.run_batches(states, out, f"{out}-checkpoint")
    return spark.read.parquet(out).groupBy("conv_id", "field").agg(*(F.max_by(c, "n_statements").alias(c) for c in ("value", "contradicted")), F.max("n_statements").alias("n_statements"))


_ARRIVALS = """a AS (SELECT *, CASE WHEN event_id % 40 = 7 THEN 5 ELSE least(datediff('day', (SELECT min(ts) FROM events)::DATE, ts::DATE) // 7, 4) END AS arrival FROM events)"""


def _arrivals(spark, d):
    """The event log as files that arrive week by week; every fortieth event comes last, whatever its time."""
    path = _place(spark)
    e = t(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    first = e.agg(F.to_date(F.min("ts")).alias("first"))
    e = e.crossJoin(F.broadcast(first)).withColumn("arrival", F.when(F.col("event_id") % 40 == 7, 5).otherwise(F.least(F.floor(F.date_diff(F.to_date("ts"), "first") / 7), F.lit(4))))
    for i in range(6):  # one file for each arrival, in order of modification
        e.filter(F.col("arrival") == i).drop("arrival", "first").coalesce(1).write.mode("append").parquet(path)
    return path, e.drop("arrival", "first").schema


def _files(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


_ANSWERED, _REFUSED = ["purchase", "view"], ["error"]


@query("x01_running_telemetry", f"""WITH {_ARRIVALS}, wm AS (SELECT max(ts) - INTERVAL 2 DAY AS wm FROM a WHERE arrival < 4), r AS (SELECT *, date_trunc('day', ts) AS w, arrival < 5 OR date_trunc('day', ts) + INTERVAL 1 DAY > wm AS counted FROM a, wm WHERE ts >= TIMESTAMP '2024-01-03')
    SELECT epoch_us(w) // 1000000 AS day_s, count_if(counted) AS n, round(count_if(counted AND event_type IN ('purchase', 'view')) / count_if(counted)::DOUBLE, 6) AS answer_rate, round(count_if(counted AND event_type = 'error') / count_if(counted)::DOUBLE, 6) AS refusal_rate,
      round(count_if(counted AND event_type IN ('purchase', 'view') AND (props->>'k')::INT >= 50) / count_if(counted AND event_type IN ('purchase', 'view'))::DOUBLE, 6) AS verification_rate,
      quantile_disc(value, 0.5) FILTER (counted) AS latency_p50, quantile_disc(value, 0.95) FILTER (counted) AS latency_p95, max(value) FILTER (counted) AS latency_max, count_if(NOT counted) AS n_late FROM r GROUP BY w""")
def x01_running(spark, d):
    """Runs the stream over files that arrive one by one, then counts what came after its window had closed.

    A batch's rows are late by the watermark that the batch before it ran with, so the last file is judged by the third last.
    """
    path, schema = _arrivals(spark, d)
    out, since = _place(spark), "2024-01-03"
    stream = X.telemetry_counts(_files(spark, path, schema), "ts", "1 day", "event_type", "value", _ANSWERED, _REFUSED, F.col("k") >= 50, since, late="2 days")
    X.run_updates(stream, out, f"{out}-checkpoint")
    arrived = spark.read.schema(schema).parquet(path).filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    counted = X.telemetry_of_counts(X.newest(spark, out, ["window_start", "latency"]))
    rows = X.late_rows(arrived, counted, "ts", "1 day")
    return rows.withColumn("day_s", F.unix_seconds(F.col("window_start").cast("timestamp"))).drop("window_start")


@query("x02_exactly_once_state", "SELECT user_id, count(value) AS n, round(avg(value), 10) AS mean, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1")
def x02_state(spark, d):
    """Streams the files in two runs into one state; the second run goes on where the first ended."""
    path, schema = _arrivals(spark, d)
    state = _place(spark)
    for _ in range(2):
        X.run_keyed_state(_files(spark, path, schema), "user_id", "value", state, f"{state}-checkpoint", compact_every=4)
    s = X.stored_state(spark, state, "user_id")
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return s.select("user_id", "n", F.round("mean", 10).alias("mean"), "min", "max", F.round(std, 6).alias("std"))
