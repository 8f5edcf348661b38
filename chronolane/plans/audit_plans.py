"""Scans, audits and cleaning on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolane.operators import clean as C
from chronolane.operators import quality as Q
from chronolane.plans.base import MEASUREMENTS, measurements, query, t


@query("s07_item_filtered_scan", f"WITH {MEASUREMENTS} SELECT l_orderkey, l_linenumber, p_type, l_quantity FROM m WHERE p_type IN ('PROMO', 'LARGE')")
def s07(spark, d):
    return measurements(spark, d).filter(F.col("p_type").isin("PROMO", "LARGE")).select("l_orderkey", "l_linenumber", "p_type", "l_quantity")


@query("s08_projection", "SELECT o_orderkey, o_totalprice FROM orders")
def s08(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice")


@query("s15_source_allow_list", """
    WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)
    SELECT page_id, host, (host LIKE '%.example.com' OR host LIKE '%.example.org' OR host IN ('example.com', 'example.org'))::INT AS allowed FROM h""")
def s15(spark, d):
    host = F.parse_url(F.col("url"), F.lit("HOST"))
    ok = host.endswith(".example.com") | host.endswith(".example.org") | host.isin("example.com", "example.org")
    return t(spark, d, "pages").select("page_id", host.alias("host"), ok.cast("int").alias("allowed"))


@query("s16_seeded_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 500")
def s16(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.md5(F.concat(F.lit("7|"), F.col("o_orderkey").cast("string"))), "o_orderkey").limit(500)


def _summary_sql(table: str, columns: list[str]) -> str:
    missing = " + ".join(f"({c} IS NULL)::INT" for c in columns)
    return f"SELECT '{table}' AS table_name, count(*) AS n_rows, {len(columns)}::BIGINT AS n_columns, round(100.0::DOUBLE * sum({missing}) / ({len(columns)} * count(*)), 4) AS missing_pct, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS n_duplicates FROM {table}"


@query("s17_load_summary", _summary_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]) + " UNION ALL " + _summary_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]))
def s17(spark, d):
    return Q.table_summary({n: t(spark, d, n) for n in ("customer", "orders")})


_ROLE = "CASE WHEN {p} >= 0.9 THEN 'num' WHEN {l} > 50 THEN 'text' WHEN {dd} < 0.5 * n THEN 'cat' ELSE 'text' END"


@query("q01_role_inference", """
    WITH a AS (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS d1, avg(length(o_orderstatus)) AS l1, avg((try_cast(o_orderstatus AS DOUBLE) IS NOT NULL)::INT) AS p1,
      count(DISTINCT o_orderpriority) AS d2, avg(length(o_orderpriority)) AS l2, avg((try_cast(o_orderpriority AS DOUBLE) IS NOT NULL)::INT) AS p2 FROM orders)
    , r AS (SELECT 'o_orderstatus' AS column_name, """ + _ROLE.format(p="p1", l="l1", dd="d1") + " AS role FROM a UNION ALL SELECT 'o_orderpriority', " + _ROLE.format(p="p2", l="l2", dd="d2") + """ FROM a)
    SELECT column_name, CASE WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'date' WHEN column_name IN ('o_orderkey', 'o_custkey') THEN 'id' WHEN column_type IN ('DOUBLE', 'INTEGER', 'BIGINT') THEN 'num' ELSE role END AS role
    FROM (DESCRIBE orders) LEFT JOIN r USING (column_name) WHERE column_name IN ('o_orderkey', 'o_custkey', 'o_orderdate', 'o_totalprice', 'o_orderstatus', 'o_orderpriority')""")
def q01(spark, d):
    return Q.infer_roles(t(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority"], ids=["o_orderkey", "o_custkey"])


@query("q02_schema_summary", """WITH r AS (SELECT 'n_name' AS column_name, CASE WHEN count(DISTINCT n_name) < 0.5 * count(*) THEN 'cat' ELSE 'text' END AS role FROM nation UNION ALL SELECT 'c_mktsegment', CASE WHEN count(DISTINCT c_mktsegment) < 0.5 * count(*) THEN 'cat' ELSE 'text' END FROM customer),
    c AS (SELECT 'nation' AS table_name, column_name, column_type FROM (DESCRIBE nation) UNION ALL SELECT 'customer', column_name, column_type FROM (DESCRIBE customer))
    SELECT table_name, column_name, CASE WHEN column_type IN ('DOUBLE', 'INTEGER', 'BIGINT') THEN 'num' ELSE role END AS role FROM c LEFT JOIN r USING (column_name) WHERE column_name IN ('n_name', 'n_regionkey', 'c_mktsegment', 'c_acctbal')""")
def q02(spark, d):
    frames = [Q.infer_roles(t(spark, d, n), cols).withColumn("table_name", F.lit(n)) for n, cols in (("nation", ["n_name", "n_regionkey"]), ("customer", ["c_mktsegment", "c_acctbal"]))]
    return Q.union_all(frames).select("table_name", "column_name", "role")


def _profile(c: str, src: str) -> str:
    return f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 4) AS missing_pct, ((count(*) - count({c})) * 100.0 / count(*) > 70)::INT AS high_missing FROM {src}"


@query("q03_column_profile", f"WITH {MEASUREMENTS} " + " UNION ALL ".join(_profile(c, "m") for c in ("val", "p_type", "l_returnflag")))
def q03(spark, d):
    return Q.column_profile(measurements(spark, d), ["val", "p_type", "l_returnflag"])


@query("q04_redundant_rows", "SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_redundant FROM lineitem")
def q04(spark, d):
    return Q.redundant_rows(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q05_orphans", "SELECT 'lineitem.order' AS check_name, count(l_orderkey) AS n_child, count_if(l_orderkey % 11 = 0) AS n_orphans FROM lineitem")
def q05(spark, d):
    return Q.orphans(t(spark, d, "lineitem"), t(spark, d, "orders").filter("o_orderkey % 11 <> 0"), "l_orderkey", "o_orderkey", "lineitem.order")


_FKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey"), ("conversations", "conv_id", "documents", "doc_id")]


@query("q06_all_foreign_keys", " UNION ALL ".join(f"SELECT '{a}.{b}' AS check_name, (SELECT count({b}) FROM {a}) AS n_child, (SELECT count(*) FROM {a} WHERE {b} IS NOT NULL AND {b} NOT IN (SELECT {k} FROM {p})) AS n_orphans" for a, b, p, k in _FKS))
def q06(spark, d):
    return Q.union_all([Q.orphans(t(spark, d, a), t(spark, d, p), b, k, f"{a}.{b}") for a, b, p, k in _FKS])


@query("q07_impossible_values", """
    SELECT 'l_quantity' AS column_name, 5.0::DOUBLE AS lo, 40.0::DOUBLE AS hi, count_if(l_quantity < 5 OR l_quantity > 40) AS n_impossible FROM lineitem
    UNION ALL SELECT 'l_discount', 0.01::DOUBLE, 0.08::DOUBLE, count_if(l_discount < 0.01::DOUBLE OR l_discount > 0.08::DOUBLE) FROM lineitem""")
def q07(spark, d):
    return Q.impossible_values(t(spark, d, "lineitem"), {"l_quantity": (5, 40), "l_discount": (0.01, 0.08)})


_ENDS = "e AS (SELECT l_orderkey AS o_orderkey, max(l_shipdate) AS t_end FROM lineitem GROUP BY 1)"


def _episodes(spark, d):
    ends = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("t_end"))
    return t(spark, d, "orders").join(ends, "o_orderkey", "left")


@query("q08_end_before_start", f"WITH {_ENDS} SELECT count(*) AS n_rows, count_if(t_end < o_orderdate) AS n_invalid FROM orders LEFT JOIN e USING (o_orderkey)")
def q08(spark, d):
    return Q.end_before_start(_episodes(spark, d), "o_orderdate", "t_end")


@query("q09_availability_leakage", f"WITH {MEASUREMENTS} SELECT l_linestatus, count(*) AS n_rows, round(100 * avg((val IS NOT NULL)::INT), 4) AS available_pct FROM m GROUP BY 1")
def q09(spark, d):
    return Q.availability_by_class(measurements(spark, d), ["val"], "l_linestatus")


@query("q10_odd_ids", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count({k}) AS n_ids, round(avg(({k} % 2 <> 0)::INT), 6) AS odd_share FROM {n}" for n, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("events", "event_id"))))
def q10(spark, d):
    return Q.union_all([Q.odd_share(t(spark, d, n), k, n) for n, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("events", "event_id"))])


@query("q11_coverage_parity", f"""WITH {MEASUREMENTS}, r AS (SELECT round(avg((val IS NOT NULL)::INT) FILTER (l_orderkey % 2 = 0), 6) AS even_rate, round(avg((val IS NOT NULL)::INT) FILTER (l_orderkey % 2 = 1), 6) AS odd_rate FROM m)
    SELECT 'val' AS feature, even_rate, odd_rate, abs(even_rate - odd_rate) <= 0.05 AS parity_ok FROM r""")
def q11(spark, d):
    return Q.coverage_parity(measurements(spark, d), "l_orderkey", ["val"])


@query("q12_shrunk_table", "SELECT 'lineitem_r' AS table_name, count_if(l_returnflag = 'R') AS n_now, count(*) AS n_source, count_if(l_returnflag = 'R') < 0.5 * count(*) AS shrunk FROM lineitem")
def q12(spark, d):
    li = t(spark, d, "lineitem")
    return Q.shrunk(li.filter("l_returnflag = 'R'"), li, "lineitem_r")


@query("q13_missing_report", f"WITH {MEASUREMENTS} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 4) AS missing_pct FROM m" for c in ("val", "p_brand", "l_tax")))
def q13(spark, d):
    return Q.column_profile(measurements(spark, d), ["val", "p_brand", "l_tax"]).select("column_name", "n_missing", "missing_pct").orderBy(F.col("missing_pct").desc(), "column_name")


@query("q14_feature_dictionary", " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{k}' AS dtype, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct, min({c})::VARCHAR AS example FROM customer" for c, k in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_mktsegment", "string"))))
def q14(spark, d):
    df = t(spark, d, "customer")
    kinds = dict(df.dtypes)
    cols = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    examples = df.agg(*(F.min(c).cast("string").alias(c) for c in cols)).select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("dtype"), F.col(c).alias("example")) for c in cols))).alias("r")).select("r.*")
    return Q.column_profile(df, cols).select("column_name", "n_missing", "n_distinct").join(examples, "column_name").select("column_name", "dtype", "n_missing", "n_distinct", "example")


@query("q16_feature_coverage", """
    WITH f AS (SELECT l_orderkey, count(*) AS n_r, max(CASE WHEN l_tax > 0.04::DOUBLE THEN l_tax END) AS high_tax FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    j AS (SELECT o_orderkey, n_r, high_tax FROM orders LEFT JOIN f ON o_orderkey = l_orderkey)
    SELECT 'n_r' AS feature, round(100 * avg((n_r IS NOT NULL)::INT), 4) AS cohort_pct, round(100 * avg((n_r IS NOT NULL)::INT) FILTER (n_r IS NOT NULL), 4) AS covered_pct FROM j
    UNION ALL SELECT 'high_tax', round(100 * avg((high_tax IS NOT NULL)::INT), 4), round(100 * avg((high_tax IS NOT NULL)::INT) FILTER (n_r IS NOT NULL), 4) FROM j""")
def q16(spark, d):
    f = t(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_r"), F.max(F.when(F.col("l_tax") > 0.04, F.col("l_tax"))).alias("high_tax"))
    j = t(spark, d, "orders").join(f, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    cov = lambda c, on: F.round(100 * F.avg(F.when(on, F.col(c).isNotNull().cast("int"))), 4)
    aggs = j.agg(*(cov(c, F.lit(True)).alias(f"{c}_a") for c in ("n_r", "high_tax")), *(cov(c, F.col("n_r").isNotNull()).alias(f"{c}_b") for c in ("n_r", "high_tax")))
    return aggs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}_a").alias("cohort_pct"), F.col(f"{c}_b").alias("covered_pct")) for c in ("n_r", "high_tax")))).alias("r")).select("r.*")


@query("q17_grain_assertions", """WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT (SELECT count(*) FROM g) AS n_keys, (SELECT count(*) FROM g WHERE n > 1) AS n_repeated, (SELECT count(*) FROM g WHERE l_linenumber > 5) AS n_outside""")
def q17(spark, d):
    li = t(spark, d, "lineitem")
    return Q.grain(li, ["l_orderkey", "l_linenumber"], li.filter("l_linenumber <= 5"))


_ACTIONS = """a AS (SELECT 'measurements' AS table_name, 'range' AS action, 'l_quantity' AS column_name, count_if(l_quantity > 45) AS n_affected, 'set null' AS decision FROM m
    UNION ALL SELECT 'measurements', 'missing', 'val', count_if(val IS NULL), 'kept' FROM m
    UNION ALL SELECT 'measurements', 'category', 'l_returnflag', count_if(l_returnflag = 'N'), 'set null' FROM m)"""


def _ledger(spark, d):
    return C.ledger(measurements(spark, d), "measurements", [("range", "l_quantity", F.col("l_quantity") > 45, "set null"), ("missing", "val", F.col("val").isNull(), "kept"), ("category", "l_returnflag", F.col("l_returnflag") == "N", "set null")])


@query("q18_cleaning_ledger", f"WITH {MEASUREMENTS}, {_ACTIONS} SELECT * FROM a")
def q18(spark, d):
    return _ledger(spark, d)


@query("q19_actions_by_type", f"WITH {MEASUREMENTS}, {_ACTIONS} SELECT decision, sum(n_affected)::BIGINT AS n_affected, count(DISTINCT table_name) AS n_tables FROM a GROUP BY 1")
def q19(spark, d):
    return _ledger(spark, d).groupBy("decision").agg(F.sum("n_affected").alias("n_affected"), F.count_distinct("table_name").alias("n_tables"))


_DIRTY = "x AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '  ' || url || ' ' WHEN page_id % 7 = 0 THEN 'nan' WHEN page_id % 11 = 0 THEN 'None' ELSE url END AS u FROM pages)"


def _dirty(spark, d):
    u = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("  "), F.col("url"), F.lit(" "))).when(F.col("page_id") % 7 == 0, "nan").when(F.col("page_id") % 11 == 0, "None").otherwise(F.col("url"))
    return t(spark, d, "pages").select("page_id", u.alias("u"))


@query("c01_trim_text", f"WITH {_DIRTY} SELECT page_id, CASE WHEN trim(u) NOT IN ('nan', 'None') THEN trim(u) END AS u FROM x")
def c01(spark, d):
    return _dirty(spark, d).select("page_id", C.trim_text("u").alias("u"))


@query("c02_time_coercion", "SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN epoch_us(ts) // 1000000 END AS at_s FROM events")
def c02(spark, d):
    text = F.when(F.col("event_id") % 9 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    return t(spark, d, "events").withColumn("raw", text).select("event_id", F.floor(F.unix_micros(C.to_time("raw")) / 1000000).alias("at_s"))


@query("c03_number_coercion", "SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN value END AS value FROM events")
def c03(spark, d):
    text = F.when(F.col("event_id") % 6 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return t(spark, d, "events").withColumn("raw", text).select("event_id", C.to_number("raw").alias("value"))


@query("c04_missingness_ledger", f"WITH {MEASUREMENTS} SELECT 'val' AS column_name, count(*) - count(val) AS n_missing FROM m UNION ALL SELECT 'l_tax', count(*) - count(l_tax) FROM m")
def c04(spark, d):
    return Q.column_profile(measurements(spark, d), ["val", "l_tax"]).select("column_name", "n_missing")


@query("c05_duplicate_flags", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, (count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1)::INT AS is_duplicate FROM lineitem")
def c05(spark, d):
    return C.flag_duplicates(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_orderkey", "l_linenumber"])


@query("c06_range_to_null", "SELECT event_id, CASE WHEN value BETWEEN 1 AND 100 THEN value END AS value FROM events")
def c06(spark, d):
    return t(spark, d, "events").select("event_id", C.in_range("value", 1, 100).alias("value"))


@query("c07_time_order_flag", f"WITH {_ENDS} SELECT o_orderkey, coalesce(t_end < o_orderdate, false)::INT AS invalid_order FROM orders LEFT JOIN e USING (o_orderkey)")
def c07(spark, d):
    return C.flag_time_order(_episodes(spark, d), "o_orderdate", "t_end").select("o_orderkey", "invalid_order")


@query("c08_category_to_null", f"WITH {_DIRTY} SELECT page_id, CASE WHEN trim(u) NOT IN ('', 'nan', 'None', 'NULL') THEN u END AS u FROM x")
def c08(spark, d):
    return _dirty(spark, d).select("page_id", C.null_category("u").alias("u"))


@query("c09_clean_table", """SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS event_type, CASE WHEN value BETWEEN 0.5 AND 200 THEN value END AS value,
    (count(*) OVER (PARTITION BY user_id, CASE WHEN event_type <> 'error' THEN event_type END) > 1)::INT AS is_duplicate FROM events""")
def c09(spark, d):
    e = t(spark, d, "events").withColumn("event_type", F.when(F.col("event_type") == "error", "NULL").otherwise(F.concat(F.lit(" "), "event_type")))
    return C.clean_table(e, ["event_type"], ["event_type"], {"value": (0.5, 200)}, ["user_id", "event_type"]).select("event_id", "event_type", "value", "is_duplicate")


@query("c10_physiology_clip", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity BETWEEN 3 AND 44 THEN l_quantity END AS qty, CASE WHEN l_tax BETWEEN 0.01::DOUBLE AND 0.07::DOUBLE THEN l_tax END AS tax FROM lineitem")
def c10(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.in_range("l_quantity", 3, 44).alias("qty"), C.in_range("l_tax", 0.01, 0.07).alias("tax"))


@query("c11_unit_normalisation", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE ELSE 1000.0::DOUBLE END AS ml FROM lineitem WHERE l_returnflag IN ('A', 'N')")
def c11(spark, d):
    unit = F.when(F.col("l_returnflag") == "A", " mL").when(F.col("l_returnflag") == "N", "L").otherwise("mg")
    return C.to_unit(t(spark, d, "lineitem").withColumn("unit", unit), "unit", "l_quantity", {"ml": 1, "l": 1000, "ul": 0.001}, "ml").select("l_orderkey", "l_linenumber", "l_partkey", "ml")


@query("c12_redaction", "SELECT conv_id, turn, '<redacted ' || length(text) || ' chars>' AS text FROM conversations")
def c12(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", C.redact("text").alias("text"))
