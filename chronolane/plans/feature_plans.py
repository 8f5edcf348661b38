"""Derived columns, joins, aggregates, windows and set operations on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronolane.operators import aggregates as A
from chronolane.operators import derive as P
from chronolane.operators import joins as J
from chronolane.operators import ordered as O
from chronolane.operators import quality as Q
from chronolane.plans.base import MEASUREMENTS, ORDER, ORDER_SQL, measurements, query, t

ITEMS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

ENDS = "e AS (SELECT l_orderkey AS o_orderkey, max(l_shipdate) AS t_end FROM lineitem GROUP BY 1), ep AS (SELECT o.*, t_end FROM orders o LEFT JOIN e USING (o_orderkey))"


def episodes(spark, d):
    ends = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("t_end"))
    return t(spark, d, "orders").join(ends, "o_orderkey", "left")


@query("p01_episode_times", f"""WITH {ENDS} SELECT o_orderkey, hour(o_orderdate)::INT AS hour, (isodow(o_orderdate) - 1)::INT AS dow, month(o_orderdate)::INT AS month, year(o_orderdate)::INT AS year,
    (isodow(o_orderdate) >= 6)::INT AS is_weekend, (hour(o_orderdate) >= 22 OR hour(o_orderdate) <= 6)::INT AS is_night,
    (epoch_us(t_end) - epoch_us(o_orderdate)) / 3600e6::DOUBLE AS los_hours, (epoch_us(t_end) - epoch_us(o_orderdate)) / 3600e6::DOUBLE / 24 AS los_days FROM ep""")
def p01(spark, d):
    return P.episode_times(episodes(spark, d), "o_orderdate", "t_end").select("o_orderkey", "hour", "dow", "month", "year", "is_weekend", "is_night", "los_hours", "los_days")


@query("p02_living_cohort", f"WITH {ENDS} SELECT o_orderkey FROM ep WHERE o_orderstatus <> 'F' AND (t_end IS NULL OR year(t_end) < 2000)")
def p02(spark, d):
    ep = episodes(spark, d).withColumn("death", F.when(F.year("t_end") >= 2000, F.col("t_end")))
    return P.living(ep, F.col("o_orderstatus") == "F", "death").select("o_orderkey")


@query("p03_target_filters", f"WITH {ENDS} SELECT o_orderkey FROM ep WHERE t_end > o_orderdate")
def p03(spark, d):
    return episodes(spark, d).filter(P.hours_between("o_orderdate", "t_end") > 0).select("o_orderkey")


@query("p05_observation_window", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= o_orderdate + INTERVAL 240 HOUR")
def p05(spark, d):
    orders = t(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return P.within_window(t(spark, d, "lineitem"), orders, ["l_orderkey"], "l_shipdate", "o_orderdate", 240).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("p06_pre_episode_cut", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= o_orderdate + INTERVAL 48 HOUR")
def p06(spark, d):
    orders = t(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return P.within_window(t(spark, d, "lineitem"), orders, ["l_orderkey"], "l_shipdate", "o_orderdate", 48).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("n_orders"))


@query("p07_sequence_window", "WITH f AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY 1) SELECT event_id FROM events JOIN f USING (user_id) WHERE ts BETWEEN t0 AND t0 + INTERVAL 24 HOUR")
def p07(spark, d):
    e = t(spark, d, "events")
    first = e.groupBy("user_id").agg(F.min("ts").alias("t0"))
    return e.join(first, "user_id").filter(P.hours_between("t0", "ts").between(0, 24)).select("event_id")


_LAND = f"""{ENDS}, r AS (SELECT l_orderkey AS o_orderkey, min(l_shipdate) AS t_event FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    c AS (SELECT ep.o_orderkey, (epoch_us(t_event) - epoch_us(o_orderdate)) / 86400e6::DOUBLE AS event_d, (epoch_us(t_end) - epoch_us(o_orderdate)) / 86400e6::DOUBLE AS end_d FROM ep LEFT JOIN r USING (o_orderkey))"""


def _timed(spark, d):
    r = t(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("t_event"))
    ep = episodes(spark, d).join(r, "o_orderkey", "left")
    days = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / F.lit(86400e6)
    return ep.select("o_orderkey", days("t_event").alias("event_d"), days("t_end").alias("end_d"))


@query("p08_ward_origin_cohort", f"WITH {_LAND} SELECT o_orderkey, (event_d IS NOT NULL)::INT AS label FROM c WHERE event_d IS NULL OR event_d > 10")
def p08(spark, d):
    return _timed(spark, d).filter("event_d is null or event_d > 10").select("o_orderkey", F.col("event_d").isNotNull().cast("int").alias("label"))


@query("p09_landmark_cohort", f"WITH {_LAND} SELECT o_orderkey, coalesce(event_d > 30 AND event_d <= 400, false)::INT AS label FROM c WHERE end_d > 30 AND (event_d IS NULL OR event_d > 30)")
def p09(spark, d):
    return P.landmark(_timed(spark, d), "event_d", "end_d", 30, 370).select("o_orderkey", "label")


@query("p10_three_valued_label", f"WITH {_LAND} SELECT o_orderkey, CASE WHEN end_d > 0 THEN (event_d IS NOT NULL)::INT END AS label FROM c")
def p10(spark, d):
    return _timed(spark, d).select("o_orderkey", P.at_risk_label(F.col("end_d") > 0, F.col("event_d").isNotNull().cast("int")).alias("label"))


@query("p11_interactions", "SELECT c_custkey, c_acctbal * c_nationkey AS c_acctbal_x_c_nationkey FROM customer")
def p11(spark, d):
    return P.interactions(t(spark, d, "customer"), [("c_acctbal", "c_nationkey"), ("c_acctbal", "absent")]).select("c_custkey", "c_acctbal_x_c_nationkey")


@query("p12_derived_physiology", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity - 20 > 0 THEN l_quantity - 20 END AS pulse, CASE WHEN l_extendedprice / nullif(l_quantity, 0) / 1000 BETWEEN 0 AND 2 THEN round(l_extendedprice / nullif(l_quantity, 0) / 1000, 11) END AS shock FROM lineitem")
def p12(spark, d):
    pulse, shock = F.col("l_quantity") - 20, F.try_divide("l_extendedprice", "l_quantity") / 1000
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(pulse > 0, pulse).alias("pulse"), F.when(shock.between(0, 2), F.round(shock, 11)).alias("shock"))


@query("p13_text_to_scale", "SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 14 <= 10 THEN (o_orderkey % 14)::DOUBLE END AS pain FROM orders")
def p13(spark, d):
    raw = F.when(F.col("o_orderkey") % 13 == 0, "refused").otherwise((F.col("o_orderkey") % 14).cast("string"))
    v = F.expr("try_cast(raw as double)")
    return t(spark, d, "orders").withColumn("raw", raw).select("o_orderkey", F.when(v.between(0, 10), v).alias("pain"))


@query("p14_band_score", f"WITH {MEASUREMENTS} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN val IS NULL THEN NULL WHEN val < 9 THEN 3 WHEN val < 12 THEN 1 WHEN val < 21 THEN 0 WHEN val < 25 THEN 2 ELSE 3 END AS points FROM m")
def p14(spark, d):
    return measurements(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", P.band_score("val", [(9, 3), (12, 1), (21, 0), (25, 2)], 3).alias("points"))


_VITALS = {"resp_rate": "8 + o_orderkey % 20", "spo2": "88 + o_orderkey % 12", "systolic": "80 + o_orderkey % 150", "heart_rate": "35 + o_orderkey % 110", "temp_f": "94 + (o_orderkey % 90) / 10.0"}


@query("p15_early_warning_score", """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 8 + o_orderkey % 20 END AS rr, CASE WHEN o_orderkey % 5 <> 0 THEN 88 + o_orderkey % 12 END AS sp, 80 + o_orderkey % 150 AS bp,
      CASE WHEN o_orderkey % 2 = 0 THEN 35 + o_orderkey % 110 END AS hr, (94 + (o_orderkey % 90) / 10.0::DOUBLE - 32) * 5 / 9 AS tc FROM orders),
    s AS (SELECT o_orderkey, CASE WHEN rr IS NULL THEN NULL WHEN rr < 9 THEN 3 WHEN rr < 12 THEN 1 WHEN rr < 21 THEN 0 WHEN rr < 25 THEN 2 ELSE 3 END AS a,
      CASE WHEN sp IS NULL THEN NULL WHEN sp < 92 THEN 3 WHEN sp < 94 THEN 2 WHEN sp < 96 THEN 1 ELSE 0 END AS b, CASE WHEN bp < 91 THEN 3 WHEN bp < 101 THEN 2 WHEN bp < 111 THEN 1 WHEN bp < 220 THEN 0 ELSE 3 END AS c,
      CASE WHEN hr IS NULL THEN NULL WHEN hr < 41 THEN 3 WHEN hr < 51 THEN 1 WHEN hr < 91 THEN 0 WHEN hr < 111 THEN 1 WHEN hr < 131 THEN 2 ELSE 3 END AS e,
      CASE WHEN tc < 35.1::DOUBLE THEN 3 WHEN tc < 36.1::DOUBLE THEN 1 WHEN tc < 38.1::DOUBLE THEN 0 WHEN tc < 39.1::DOUBLE THEN 1 ELSE 2 END AS f FROM v)
    SELECT o_orderkey, CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1 + (e IS NOT NULL)::INT + 1 >= 4 THEN coalesce(a, 0) + coalesce(b, 0) + c + coalesce(e, 0) + f END AS news2 FROM s""")
def p15(spark, d):
    k = F.col("o_orderkey")
    o = t(spark, d, "orders").select("o_orderkey", F.when(k % 3 != 0, 8 + k % 20).alias("resp"), F.when(k % 5 != 0, 88 + k % 12).alias("spo2"), (80 + k % 150).alias("sbp"), F.when(k % 2 == 0, 35 + k % 110).alias("pulse"), (94 + (k % 90) / 10.0).alias("temp_f"))
    return P.early_warning(o, {"resp_rate": ["resp"], "spo2": ["spo2"], "systolic": ["sbp"], "heart_rate": ["absent", "pulse"], "temperature": ["temp_c"]}, "temp_f").select("o_orderkey", "news2")


@query("p16_lace_score", """SELECT o_orderkey, (CASE WHEN los < 1 THEN 0 WHEN los < 2 THEN 1 WHEN los < 3 THEN 2 WHEN los < 4 THEN 3 WHEN los < 7 THEN 4 WHEN los < 14 THEN 5 ELSE 6 END
      + CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 3 ELSE 0 END + CASE WHEN o_orderkey % 8 >= 4 THEN 5 ELSE o_orderkey % 8 END + least(o_orderkey % 6, 4)) / 18.0::DOUBLE AS lace
    FROM (SELECT *, (o_orderkey % 20) / 1.5::DOUBLE AS los FROM orders)""")
def p16(spark, d):
    k = F.col("o_orderkey")
    o = t(spark, d, "orders").withColumns({"los": (k % 20) / 1.5, "cci": k % 8, "ed": k % 6})
    return P.lace(o, "los", F.col("o_orderpriority").rlike("^[12]"), "cci", "ed").select("o_orderkey", "lace")


@query("p17_age_band", """SELECT c_custkey, CASE WHEN a < 18 OR a >= 121 THEN NULL WHEN a < 40 THEN '18-39' WHEN a < 55 THEN '40-54' WHEN a < 65 THEN '55-64' WHEN a < 75 THEN '65-74' WHEN a < 85 THEN '75-84' ELSE '85-120' END AS band
    FROM (SELECT c_custkey, 10 + c_custkey % 115 AS a FROM customer)""")
def p17(spark, d):
    return t(spark, d, "customer").withColumn("age", 10 + F.col("c_custkey") % 115).select("c_custkey", P.age_band("age").alias("band"))


@query("p18_label_collapse", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'UNKNOWN' ELSE upper(c_mktsegment) END AS label FROM customer")
def p18(spark, d):
    raw = F.when(F.col("c_custkey") % 9 == 0, "").when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(" - B/C"))).otherwise(F.concat("c_mktsegment", F.lit("/OTHER")))
    return t(spark, d, "customer").withColumn("raw", raw).select("c_custkey", P.collapse_label("raw").alias("label"))


@query("p19_tier", "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'medium' WHEN o_totalprice < 400000 THEN 'high' ELSE 'very high' END AS tier FROM orders")
def p19(spark, d):
    return t(spark, d, "orders").select("o_orderkey", P.tier("o_totalprice", [50000, 200000, 400000], ["low", "medium", "high", "very high"]).alias("tier"))


@query("p20_category_ladder", "SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'rings' WHEN p_name LIKE 'small%' OR p_name LIKE 'blue%' THEN 'small or blue' ELSE 'other' END AS category FROM part")
def p20(spark, d):
    return t(spark, d, "part").select("p_partkey", P.first_match("p_name", [("ring", "rings"), ("^(small|blue)", "small or blue")], "other").alias("category"))


@query("p21_reference_range", f"WITH {MEASUREMENTS} SELECT l_orderkey, l_linenumber, l_partkey, (val BETWEEN CASE p_type WHEN 'PROMO' THEN 10 ELSE 5 END AND CASE p_type WHEN 'PROMO' THEN 20 ELSE 40 END)::INT AS in_range FROM m WHERE p_type IN ('PROMO', 'SMALL')")
def p21(spark, d):
    ref = spark.createDataFrame([("PROMO", 10.0, 20.0), ("SMALL", 5.0, 40.0)], "p_type string, lo double, hi double")
    return measurements(spark, d).join(ref, "p_type").select("l_orderkey", "l_linenumber", "l_partkey", F.expr("cast(val between lo and hi as int)").alias("in_range"))


@query("p22_exposure_alerts", f"""WITH {MEASUREMENTS}, g AS (SELECT l_orderkey, max(val) AS v, max((p_name LIKE '%ring%')::INT) AS ring FROM m GROUP BY 1),
    a AS (SELECT l_orderkey, 'unavailable' AS alert FROM g WHERE v IS NULL UNION ALL SELECT l_orderkey, 'high' FROM g WHERE v > 45 UNION ALL SELECT l_orderkey, 'exposed' FROM g WHERE ring = 1 AND v > 30)
    SELECT alert, count(*) AS n FROM a GROUP BY 1""")
def p22(spark, d):
    g = measurements(spark, d).groupBy("l_orderkey").agg(F.max("val").alias("v"), F.max(F.col("p_name").contains("ring").cast("int")).alias("ring"))
    names = P.alerts({"unavailable": F.col("v").isNull(), "high": F.col("v") > 45, "exposed": (F.col("ring") == 1) & (F.col("v") > 30)})
    return g.select(F.explode(names).alias("alert")).groupBy("alert").agg(F.count(F.lit(1)).alias("n"))


@query("p23_row_completeness", """WITH x AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS a, event_id % 5 = 0 AS text_b FROM events)
    SELECT event_id, CASE WHEN a IS NULL THEN 'a' ELSE '' END AS missing, CASE WHEN a > 100 THEN 'a' ELSE '' END AS implausible, CASE WHEN text_b THEN 'b' ELSE '' END AS uninterpretable,
      round((coalesce(a <= 100, false)::INT + (NOT text_b)::INT) / 2.0::DOUBLE, 4) AS completeness FROM x""")
def p23(spark, d):
    e = t(spark, d, "events").withColumns({"a1": F.lit(None).cast("string"), "a2": F.when(F.col("event_id") % 4 != 0, F.col("value")).cast("string"), "b1": F.when(F.col("event_id") % 5 == 0, "?").otherwise("7")})
    return e.select("event_id", *P.completeness({"a": [F.col("a1"), F.col("a2")], "b": [F.col("b1")]}, {"a": (0, 100)}))


@query("p24_representative_value", f"WITH {MEASUREMENTS} SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(val, l_extendedprice / 1000, 0), 1) AS value FROM m")
def p24(spark, d):
    return measurements(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.coalesce("val", F.col("l_extendedprice") / 1000, F.lit(0.0)), 1).alias("value"))


@query("j01_left_merge", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def j01(spark, d):
    right = t(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.lit(0).alias("o_totalprice"))
    return J.left_merge(t(spark, d, "orders"), right, ["o_custkey"])[0].select("o_orderkey", "o_custkey", "c_mktsegment")


@query("j02_fan_out_guard", "WITH r AS (SELECT l_orderkey, sum(l_quantity) AS total_qty, round(avg(l_tax), 6) AS tax, max(l_discount) AS disc_max FROM lineitem GROUP BY 1) SELECT o_orderkey, total_qty, tax, disc_max FROM orders LEFT JOIN r ON o_orderkey = l_orderkey")
def j02(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("total_qty"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("disc_max"))
    return J.merge_all(t(spark, d, "orders").select("o_orderkey"), [J.to_grain(li, ["o_orderkey"], "tax")], ["o_orderkey"]).withColumn("tax", F.round("tax", 6))


@query("j03_count_indicator", "SELECT c_custkey, coalesce(n, 0) AS n_orders, (coalesce(n, 0) > 0)::INT AS has_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def j03(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return J.indicator_counts(t(spark, d, "customer").select("c_custkey"), o, "c_custkey", "n_orders", "has_orders")


@query("j04_stay_grain_merge", "WITH a AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, l_linenumber, max(l_tax) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT a.l_orderkey, a.l_linenumber, q, x FROM a LEFT JOIN b USING (l_orderkey, l_linenumber)")
def j04(spark, d):
    li, keys = t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    return J.merge_all(li.groupBy(*keys).agg(F.sum("l_quantity").alias("q")), [li.filter("l_returnflag = 'R'").groupBy(*keys).agg(F.max("l_tax").alias("x"))], keys)


@query("j05_nearest_preceding", """WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), c AS (SELECT event_id AS click_id, user_id, ts AS click_ts FROM events WHERE event_type = 'click'),
    p AS (SELECT s.event_id, click_id, (click_ts <= ts)::INT AS precedes, count(*) OVER (PARTITION BY s.event_id) AS n_candidates, row_number() OVER (PARTITION BY s.event_id ORDER BY (click_ts <= ts)::INT DESC, click_ts DESC, click_id) AS r FROM s JOIN c USING (user_id))
    SELECT event_id, click_id, precedes, n_candidates FROM p WHERE r = 1""")
def j05(spark, d):
    e = t(spark, d, "events")
    s = e.filter("event_type = 'signup'").select("event_id", "user_id", "ts")
    c = e.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("click_ts"))
    return J.nearest_preceding(s, c, "user_id", "ts", "click_ts", ["click_id"]).select("event_id", "click_id", "precedes", "n_candidates")


_PRIOR = f"""{ENDS}, pr AS (SELECT a.o_orderkey, b.o_orderkey AS prior_episode, (epoch_us(a.o_orderdate) - epoch_us(b.t_end)) / 86400e6::DOUBLE AS gap FROM ep a JOIN ep b ON a.o_custkey = b.o_custkey AND b.t_end < a.o_orderdate AND a.o_orderkey <> b.o_orderkey)"""


def _prior(spark, d):
    ep = episodes(spark, d).select("o_custkey", "o_orderkey", "o_orderdate", "t_end")
    return J.earlier_episodes(ep, "o_custkey", "o_orderkey", "o_orderdate", "t_end")


@query("j06_earlier_episodes", f"WITH {_PRIOR} SELECT o_orderkey, prior_episode FROM pr")
def j06(spark, d):
    return _prior(spark, d).select("o_orderkey", "prior_episode")


@query("j07_interval_join", "SELECT count(*) AS n, round(sum(l_quantity), 4) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY")
def j07(spark, d):
    o = t(spark, d, "orders")
    j = t(spark, d, "lineitem").join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & F.expr("l_shipdate between o_orderdate and o_orderdate + interval 60 day"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("q"))


@query("j08_semi_join", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def j08(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "lineitem").filter("l_quantity > 48"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("j09_anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j09(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("j10_balance", """WITH a AS (SELECT l_orderkey, sum(l_quantity) AS input_total, count(l_quantity) AS input_count FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_orderkey, sum(l_quantity) AS output_total, count(l_quantity) AS output_count FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
    SELECT l_orderkey, input_total, input_count, output_total, output_count, input_total - output_total AS balance FROM a FULL JOIN b USING (l_orderkey)""")
def j10(spark, d):
    li = t(spark, d, "lineitem")
    return J.balance(li.filter("l_linestatus = 'O'"), li.filter("l_linestatus = 'F'"), ["l_orderkey"], "l_quantity")


@query("j11_dictionary_lookup", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def j11(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region").filter("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


RULES = [("a", "BRAND#1", 1), ("b", "BRAND#2", 2), ("b", "BRAND#24", 2), ("c", "BRAND#13", 3)]
_RULES_SQL = "ru(condition, prefix, weight) AS (VALUES ('a', 'BRAND#1', 1), ('b', 'BRAND#2', 2), ('b', 'BRAND#24', 2), ('c', 'BRAND#13', 3))"


def _matches(spark, d):
    rules = F.broadcast(spark.createDataFrame(RULES, "condition string, prefix string, weight int"))  # few fixed prefixes, each of many rows
    return J.prefix_matches(measurements(spark, d).select("l_orderkey", "p_brand"), rules, "p_brand", [7, 8])


@query("j12_code_prefix_join", f"WITH {MEASUREMENTS}, {_RULES_SQL} SELECT condition, prefix, count(*) AS n FROM m JOIN ru ON starts_with(upper(p_brand), prefix) GROUP BY ALL")
def j12(spark, d):
    return _matches(spark, d).groupBy("condition", "prefix").agg(F.count(F.lit(1)).alias("n"))


@query("j14_snapshot_diff", "WITH a AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 1), b AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 2 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 0) SELECT c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' WHEN a.c_acctbal IS DISTINCT FROM b.c_acctbal THEN 'changed' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (c_custkey)")
def j14(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    now = c.filter("c_custkey % 10 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 2, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return J.snapshot_diff(c.filter("c_custkey % 10 <> 1"), now, "c_custkey", ["c_acctbal"])


_KNN = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label, vec_id % 50 AS entity FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 10 = 0),
    p AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, q.label AS ql, v.label AS nl, round(list_distance(q.e, v.e), 6) AS distance FROM q JOIN v ON q.entity <> v.entity)"""


def vectors(spark, d):
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 50).alias("entity"), "label")


@query("j16_nearest_neighbours", f"WITH {_KNN}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM p) SELECT query_id, neighbour_id, distance, rank::INT AS rank FROM r WHERE rank <= 5")
def j16(spark, d):
    v = vectors(spark, d)
    return J.nearest_neighbours(v.filter("id % 10 = 0"), v, 5, entity="entity")


@query("j17_nearest_in_partition", f"WITH {_KNN}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM p WHERE ql = nl) SELECT query_id, neighbour_id, distance, rank::INT AS rank FROM r WHERE rank <= 3")
def j17(spark, d):
    v = vectors(spark, d)
    return J.nearest_neighbours(v.filter("id % 10 = 0"), v, 3, entity="entity", partition="label")


@query("j19_similarity_frame", "SELECT c_custkey, c_nationkey, c_mktsegment, coalesce(n, 0) AS flag_orders FROM customer LEFT JOIN (SELECT o_custkey, 1 AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def j19(spark, d):
    flags = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("flag_orders", F.lit(1))
    return J.left_merge(t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), flags, ["c_custkey"])[0].fillna(0, ["flag_orders"])


@query("j20_feature_merge", "SELECT o_orderkey, n, r FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) a ON o_orderkey = a.l_orderkey LEFT JOIN (SELECT l_orderkey, max(l_tax) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON o_orderkey = b.l_orderkey")
def j20(spark, d):
    li = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return J.merge_all(t(spark, d, "orders").select("o_orderkey"), [li.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n")), li.filter("l_returnflag = 'R'").groupBy("o_orderkey").agg(F.max("l_tax").alias("r"))], ["o_orderkey"])


def _stats_sql(src: str, extra: str = "") -> str:
    return f"""n AS (SELECT *, CASE WHEN val IS NOT NULL THEN count(val) OVER w - 1 END AS pos FROM {src} WINDOW w AS (PARTITION BY l_orderkey, p_type ORDER BY {ORDER_SQL} ROWS UNBOUNDED PRECEDING)),
    st AS (SELECT l_orderkey, p_type, round(avg(val), 6) AS mean, round(median(val), 6) AS median, min(val) AS min, max(val) AS max, round(stddev_samp(val), 6) AS std,
      arg_min(val, ROW({ORDER_SQL})) FILTER (val IS NOT NULL) AS first, arg_max(val, ROW({ORDER_SQL})) FILTER (val IS NOT NULL) AS last, count(val) AS count, count_if(l_returnflag = 'R') AS abnormal_count,
      round(avg((val IS NULL)::INT), 6) AS missing_ratio, CASE WHEN count(val) >= 2 THEN round(regr_slope(val, pos), 6) + 0.0::DOUBLE END AS slope,
      CASE WHEN count(val) >= 2 THEN round(arg_max(val, ROW({ORDER_SQL})) FILTER (val IS NOT NULL) - arg_min(val, ROW({ORDER_SQL})) FILTER (val IS NOT NULL), 6) END AS change FROM n GROUP BY 1, 2){extra}"""


def _stats(df):
    return A.measurement_stats(df, ["l_orderkey", "p_type"], "val", ORDER, F.col("l_returnflag") == "R")


def _dealt(spark, d):
    """Measurements, each episode's in one task, as what is made of them is by episode."""
    return A.dealt(measurements(spark, d), ["l_orderkey"], t(spark, d, "lineitem").count())


@query("a01_measure_stats", f"WITH {MEASUREMENTS}, {_stats_sql('m')} SELECT * EXCLUDE (slope, change) FROM st")
def a01(spark, d):
    return _stats(measurements(spark, d)).drop("slope", "change")


@query("a02_slope_and_change", f"WITH {MEASUREMENTS}, {_stats_sql('m')} SELECT l_orderkey, p_type, slope, change FROM st")
def a02(spark, d):
    return _stats(measurements(spark, d)).select("l_orderkey", "p_type", "slope", "change")


_COLS = ["mean", "count", "abnormal_count", "missing_ratio"]
_DEFAULTS = {"count": 0, "abnormal_count": 0, "missing_ratio": 1.0}


def _pivot_sql(suffix: str = "") -> str:
    fill = {"mean": "{}", "count": "coalesce({}, 0)", "abnormal_count": "coalesce({}, 0)", "missing_ratio": "coalesce({}, 1.0::DOUBLE)"}
    cols = ", ".join(fill[c].format(f"max({c}) FILTER (p_type = '{i}')") + f" AS m_{i.lower()}_{c}{suffix}" for i in ITEMS for c in _COLS)
    return f"SELECT l_orderkey, {cols} FROM st GROUP BY 1"


@query("a03_pivot", f"WITH {MEASUREMENTS}, {_stats_sql('m')} {_pivot_sql()}")
def a03(spark, d):
    return A.pivot_stats(_stats(_dealt(spark, d)), "l_orderkey", "p_type", ITEMS, _COLS, "m", _DEFAULTS)


@query("a04_item_totals", f"WITH {MEASUREMENTS} SELECT l_orderkey, count(*) AS n_rows, count(DISTINCT p_type) AS n_items FROM m GROUP BY 1")
def a04(spark, d):
    return measurements(spark, d).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("p_type").alias("n_items"))


_WINDOWED = "wm AS (SELECT m.* FROM m JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= o_orderdate + INTERVAL 30 DAY)"


def windowed_features(spark, d, hours=720):
    """Windowed statistics, wide: the measurement block of the feature rows; names end in the window's hours."""
    orders = t(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    m = P.within_window(_dealt(spark, d), orders, ["l_orderkey"], "l_shipdate", "o_orderdate", hours)
    wide = A.pivot_stats(_stats(m), "l_orderkey", "p_type", ITEMS, _COLS, "m", _DEFAULTS)
    return wide.select("l_orderkey", *(F.col(c).alias(f"{c}_{hours}h") for c in wide.columns if c != "l_orderkey"))


@query("a05_windowed_set", f"WITH {MEASUREMENTS}, {_WINDOWED}, {_stats_sql('wm')} {_pivot_sql('_720h')}")
def a05(spark, d):
    return windowed_features(spark, d)


@query("a07_vitals", """WITH n AS (SELECT *, row_number() OVER w - 1 AS pos, avg(value) OVER (w ROWS 2 PRECEDING) AS rm, stddev_samp(value) OVER (w ROWS 2 PRECEDING) AS rs FROM events WHERE value BETWEEN 0.1 AND 300 WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
    SELECT user_id, event_type, count(value) AS n, arg_max(value, pos) AS latest, CASE WHEN count(value) >= 3 THEN round(arg_max(rm, pos), 6) END AS roll_mean, CASE WHEN count(value) >= 3 THEN round(arg_max(rs, pos), 6) END AS roll_std,
      CASE WHEN count(value) >= 3 THEN round(regr_slope(value, pos), 6) END AS slope, CASE WHEN count(value) >= 3 THEN round(var_samp(value), 6) END AS variance FROM n GROUP BY 1, 2""")
def a07(spark, d):
    return A.rolling_vitals(t(spark, d, "events").filter("value between 0.1 and 300"), ["user_id", "event_type"], "value", ["ts", "event_id"])


@query("a08_mergeable_aggregates", "SELECT l_suppkey, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS min, max(l_quantity) AS max, round(stddev_samp(l_quantity), 6) AS std, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1")
def a08(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("l_quantity").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.min("l_quantity").alias("min"), F.max("l_quantity").alias("max"), F.round(F.stddev_samp("l_quantity"), 6).alias("std"), F.count_distinct("l_partkey").alias("n_parts"))


@query("a09_stay_features", f"WITH {ENDS} SELECT o_orderkey, round((epoch_us(t_end) - epoch_us(o_orderdate)) / 3600e6::DOUBLE, 4) AS duration_h, count(*) OVER (PARTITION BY o_custkey) AS n_stays FROM ep")
def a09(spark, d):
    return episodes(spark, d).select("o_orderkey", F.round(P.hours_between("o_orderdate", "t_end"), 4).alias("duration_h"), F.count(F.lit(1)).over(W.partitionBy("o_custkey")).alias("n_stays"))


@query("a10_fluid_totals", "SELECT l_orderkey, l_linestatus, sum(l_quantity * CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE ELSE 1000.0::DOUBLE END) AS total, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY ALL")
def a10(spark, d):
    from chronolane.operators.clean import to_unit

    li = t(spark, d, "lineitem").withColumn("unit", F.when(F.col("l_returnflag") == "A", "mL").when(F.col("l_returnflag") == "N", "L").otherwise("mg"))
    return to_unit(li, "unit", "l_quantity", {"ml": 1, "l": 1000}, "ml").groupBy("l_orderkey", "l_linestatus").agg(F.sum("ml").alias("total"), F.count(F.lit(1)).alias("n"))


@query("a11_keyword_classes", f"WITH {MEASUREMENTS} SELECT l_orderkey, count(*) AS n_rows, count(DISTINCT p_name) AS n_distinct, max((p_name LIKE '%ring%')::INT) AS has_ring, max((p_name LIKE 'small%' OR p_name LIKE 'red%')::INT) AS has_small FROM m GROUP BY 1")
def a11(spark, d):
    return A.keyword_flags(measurements(spark, d), "l_orderkey", "p_name", {"ring": "ring", "small": "^(small|red)"})


@query("a12_code_summary", f"WITH {MEASUREMENTS} SELECT l_orderkey, count(p_brand) AS n_codes, count(DISTINCT p_brand) AS n_distinct, arg_min(p_brand, ROW(l_linenumber, p_brand)) AS primary_code FROM m GROUP BY 1")
def a12(spark, d):
    return A.code_summary(measurements(spark, d), "l_orderkey", "p_brand", ["l_linenumber", "p_brand"])


@query("a13_weighted_index", f"WITH {MEASUREMENTS}, {_RULES_SQL}, f AS (SELECT l_orderkey, max((condition = 'a')::INT) AS a, max((condition = 'b')::INT) AS b, max((condition = 'c')::INT) AS c FROM m JOIN ru ON starts_with(upper(p_brand), prefix) GROUP BY 1) SELECT *, a + 2 * b + 3 * c AS idx FROM f")
def a13(spark, d):
    return A.weighted_index(_matches(spark, d), "l_orderkey", "condition", {"a": 1, "b": 2, "c": 3}, "idx")


@query("a14_short_prefix_index", f"WITH {MEASUREMENTS}, {_RULES_SQL} SELECT l_orderkey, max(weight)::INT AS idx FROM m JOIN ru ON left(upper(p_brand), 7) = prefix GROUP BY 1")
def a14(spark, d):
    rules = F.broadcast(spark.createDataFrame([r for r in RULES if len(r[1]) == 7], "condition string, prefix string, weight int"))
    m = measurements(spark, d).select("l_orderkey", F.left(F.upper("p_brand"), F.lit(7)).alias("prefix"))
    return m.join(rules, "prefix").groupBy("l_orderkey").agg(F.max("weight").alias("idx"))


@query("a15_utilisation_of_all", f"""WITH {ENDS}, x AS (SELECT o_orderkey, o_custkey, o_orderdate, t_end, o_orderkey % 5 AS idx FROM ep), pr AS (SELECT a.o_orderkey, (epoch_us(a.o_orderdate) - epoch_us(b.t_end)) / 86400e6::DOUBLE AS gap, (epoch_us(b.t_end) - epoch_us(b.o_orderdate)) / 86400e6::DOUBLE AS los, b.idx FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND b.t_end < a.o_orderdate AND b.t_end >= b.o_orderdate AND a.o_orderkey <> b.o_orderkey),
    g AS (SELECT o_orderkey, count_if(gap <= 30) AS p30, count_if(gap <= 90) AS p90, count_if(gap <= 365) AS p365, sum(los) AS los, min(gap) AS gap, max(idx) AS idx FROM pr GROUP BY 1)
    SELECT o_orderkey, coalesce(p30, 0) AS prior_30d, coalesce(p90, 0) AS prior_90d, coalesce(p365, 0) AS prior_365d, round(coalesce(los, 0.0::DOUBLE), 4) AS prior_los_days, round(coalesce(gap, -1.0::DOUBLE), 6) AS days_since_last, coalesce(g.idx, 0)::BIGINT AS max_prior_index FROM x LEFT JOIN g USING (o_orderkey)""")
def a15_all(spark, d):
    ep = episodes(spark, d).select("o_custkey", "o_orderkey", "o_orderdate", "t_end", (F.col("o_orderkey") % 5).alias("idx"))
    return A.utilisation_of_all(ep, "o_custkey", "o_orderkey", "o_orderdate", "t_end", "idx", [30, 90, 365])


@query("j14_change_severity", "WITH a AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 1), b AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 2 THEN c_acctbal * 0.85::DOUBLE WHEN c_custkey % 10 = 3 THEN c_acctbal * 0.4::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 0), j AS (SELECT c_custkey, a.c_custkey IS NULL AS new, b.c_custkey IS NULL AS gone, a.c_acctbal AS x, b.c_acctbal AS y FROM a FULL JOIN b USING (c_custkey)) SELECT CASE WHEN gone OR (x - y) / nullif(abs(x), 0) >= 0.5 THEN 'critical' WHEN (x - y) / nullif(abs(x), 0) >= 0.1 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN new THEN 'added' WHEN gone THEN 'removed' WHEN x IS DISTINCT FROM y THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS n FROM j GROUP BY ALL")
def j14_severity(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    k = F.col("c_custkey") % 10
    now = c.filter("c_custkey % 10 <> 0").withColumn("c_acctbal", F.when(k == 2, F.col("c_acctbal") * 0.85).when(k == 3, F.col("c_acctbal") * 0.4).otherwise(F.col("c_acctbal")))
    diff = J.snapshot_diff(c.filter("c_custkey % 10 <> 1"), now, "c_custkey", ["c_acctbal"], show=True)
    return J.change_severity(diff, "before_c_acctbal", "after_c_acctbal", 0.1, 0.5).groupBy("severity", "change").agg(F.count(F.lit(1)).alias("n"))


@query("a15_prior_utilisation", f"WITH {_PRIOR} SELECT o_orderkey, count_if(gap <= 30) AS prior_30d, count_if(gap <= 90) AS prior_90d, count_if(gap <= 365) AS prior_365d, round(min(gap), 6) AS days_since_last, count(*) AS n_prior FROM pr GROUP BY 1")
def a15(spark, d):
    return A.prior_utilisation(_prior(spark, d), "o_orderkey", "o_orderdate", [30, 90, 365])


@query("a16_procedure_counts", f"WITH {MEASUREMENTS} SELECT l_orderkey, count(p_brand) AS n, count(DISTINCT p_brand) AS n_distinct, count_if(substr(p_brand, 7, 1) IN ('1', '3')) AS n_major, max((substr(p_brand, 7, 1) IN ('1', '3'))::INT) AS has_major FROM m GROUP BY 1")
def a16(spark, d):
    major = F.substring("p_brand", 7, 1).isin("1", "3")
    return measurements(spark, d).groupBy("l_orderkey").agg(F.count("p_brand").alias("n"), F.count_distinct("p_brand").alias("n_distinct"), F.count_if(major).alias("n_major"), F.max(major.cast("int")).alias("has_major"))


@query("a17_notes_per_source", "SELECT source, count(*) AS n, round(avg(length(text)), 4) AS mean_chars, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def a17(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.sum("n_chars").alias("chars"))


@query("a18_triage_means", "SELECT user_id, round(avg(value), 6) AS ed_value, round(avg((props->>'k')::INT), 6) AS ed_k FROM events GROUP BY 1")
def a18(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return t(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("ed_value"), F.round(F.avg(k), 6).alias("ed_k"))


@query("a19_serial_vitals", """WITH x AS (SELECT *, CASE WHEN value BETWEEN 1 AND 150 THEN value END AS v FROM events WHERE ts < TIMESTAMP '2024-01-15')
    SELECT user_id, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, round(stddev_samp(v), 6) AS std, arg_min(v, ROW(ts, event_id)) FILTER (v IS NOT NULL) AS first, arg_max(v, ROW(ts, event_id)) FILTER (v IS NOT NULL) AS last, count(v) AS n,
      round(arg_max(v, ROW(ts, event_id)) FILTER (v IS NOT NULL) - arg_min(v, ROW(ts, event_id)) FILTER (v IS NOT NULL), 6) AS delta FROM x GROUP BY 1""")
def a19(spark, d):
    x = t(spark, d, "events").filter("ts < timestamp_ntz'2024-01-15'").withColumn("v", F.expr("case when value between 1 and 150 then value end"))
    at = F.when(F.col("v").isNotNull(), F.struct("ts", "event_id"))
    first, last = F.min_by("v", at), F.max_by("v", at)
    return x.groupBy("user_id").agg(F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.round(F.stddev_samp("v"), 6).alias("std"), first.alias("first"), last.alias("last"), F.count("v").alias("n"), F.round(last - first, 6).alias("delta"))


@query("a20_home_medication", f"WITH {MEASUREMENTS} SELECT l_orderkey, count(*) AS n, count(DISTINCT p_name) AS n_names, count(DISTINCT p_type) AS n_classes, (count(DISTINCT p_name) >= 5)::INT AS polypharmacy FROM m GROUP BY 1")
def a20(spark, d):
    g = measurements(spark, d).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_name").alias("n_names"), F.count_distinct("p_type").alias("n_classes"))
    return g.withColumn("polypharmacy", (F.col("n_names") >= 5).cast("int"))


@query("a21_assembly_with_flag", "SELECT c_custkey, n, coalesce(has_events, 0.0::DOUBLE) AS has_events FROM customer LEFT JOIN (SELECT user_id, count(*) AS n, 1.0::DOUBLE AS has_events FROM events GROUP BY 1) ON c_custkey = user_id")
def a21(spark, d):
    e = t(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")).withColumn("has_events", F.lit(1.0))
    return J.left_merge(t(spark, d, "customer").select("c_custkey"), e, ["c_custkey"])[0].fillna(0.0, ["has_events"])


@query("a22_entity_rollup", f"WITH {ENDS} SELECT o_custkey, count(*) AS n_episodes, round(avg(l), 4) AS los_mean, round(max(l), 4) AS los_max, round(sum(l), 4) AS los_sum, max((o_orderstatus = 'F')::INT) AS ever_f, arg_min(o_orderpriority, ROW(o_orderdate, o_orderkey)) AS first_priority FROM (SELECT *, (epoch_us(t_end) - epoch_us(o_orderdate)) / 86400e6::DOUBLE AS l FROM ep) GROUP BY 1")
def a22(spark, d):
    ep = episodes(spark, d).withColumn("l", P.hours_between("o_orderdate", "t_end") / 24)
    return ep.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_episodes"), F.round(F.avg("l"), 4).alias("los_mean"), F.round(F.max("l"), 4).alias("los_max"), F.round(F.sum("l"), 4).alias("los_sum"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("ever_f"), F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("first_priority"))


@query("a23_co_occurrence", f"WITH {MEASUREMENTS}, p AS (SELECT DISTINCT l_orderkey, p_brand FROM m), top AS (SELECT p_brand FROM p GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 8), k AS (SELECT * FROM p WHERE p_brand IN (SELECT p_brand FROM top)) SELECT a.p_brand AS code_a, b.p_brand AS code_b, count(*) AS n FROM k a JOIN k b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY ALL")
def a23(spark, d):
    return A.co_occurrence(measurements(spark, d), "l_orderkey", "p_brand", 8)


@query("a24_outcome_by_code", f"WITH {MEASUREMENTS} SELECT p_brand, count(DISTINCT l_orderkey) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS rate FROM (SELECT DISTINCT l_orderkey, p_brand FROM m) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def a24(spark, d):
    pairs = measurements(spark, d).select("l_orderkey", "p_brand").distinct()
    j = pairs.join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("rate")).orderBy(F.col("n").desc(), "p_brand").limit(10)


@query("a25_value_counts", "WITH c AS (SELECT p_name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, p_name LIMIT 10) SELECT p_name, n, round(100.0::DOUBLE * n / sum(n) OVER (), 4) AS pct FROM c")
def a25(spark, d):
    return A.value_counts(t(spark, d, "part"), "p_name", 10)


def _desc(c: str) -> str:
    return f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, max({c})::DOUBLE AS max FROM lineitem"


@query("a26_describe", " UNION ALL ".join(_desc(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def a26(spark, d):
    return A.describe(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("a27_distribution", """WITH c AS (SELECT value - avg(value) OVER () AS x FROM events), m AS (SELECT count(*) AS n, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4 FROM c)
    SELECT n, round(m3 / pow(m2, 1.5), 4) AS skewness, round(m4 / (m2 * m2) - 3, 4) AS kurtosis FROM m""")
def a27(spark, d):
    return A.moments(t(spark, d, "events"), "value").select("n", F.round("skewness", 4).alias("skewness"), F.round("kurtosis", 4).alias("kurtosis"))


@query("a28_temporal_counts", "SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*) AS n FROM orders GROUP BY GROUPING SETS ((year(o_orderdate)), (month(o_orderdate)))")
def a28(spark, d):
    o = t(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return o.groupingSets([["year"], ["month"]], "year", "month").agg(F.count(F.lit(1)).alias("n"))


@query("a29_capped_histogram", f"WITH {ENDS} SELECT least(greatest(floor((l - 0) * 12 / 60), 0), 11)::BIGINT AS bin, count(*) AS n FROM (SELECT least(greatest((epoch_us(t_end) - epoch_us(o_orderdate)) / 86400e6::DOUBLE, 0), 60) AS l FROM ep) WHERE l IS NOT NULL AND l >= 0 GROUP BY 1")
def a29(spark, d):
    los = P.hours_between("o_orderdate", "t_end") / 24
    capped = episodes(spark, d).withColumn("l", F.when(los.isNull(), 0.0).otherwise(F.least(F.greatest(los, F.lit(0.0)), F.lit(60.0))))
    return A.histogram(capped, "l", 0, 60, 12)


@query("a30_histogram_by_outcome", f"WITH {MEASUREMENTS} SELECT o_orderstatus, least(greatest(floor((val - 0) * 10 / 50), 0), 9)::BIGINT AS bin, count(*) AS n FROM m JOIN orders ON l_orderkey = o_orderkey WHERE val IS NOT NULL GROUP BY ALL")
def a30(spark, d):
    m = measurements(spark, d).join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return A.histogram(m, "val", 0, 50, 10, ["o_orderstatus"])


@query("a31_cohort_description", f"WITH {ENDS}, x AS (SELECT *, (epoch_us(t_end) - epoch_us(o_orderdate)) / 86400e6::DOUBLE AS l FROM ep) SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_entities, round(quantile_cont(l, 0.5), 6) AS los_median, round(avg(l), 6) AS los_mean, round(quantile_cont(l, 0.9), 6) AS los_p90 FROM x")
def a31(spark, d):
    ep = episodes(spark, d).withColumn("l", P.hours_between("o_orderdate", "t_end") / 24)
    counts = ep.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_entities"), F.round(F.avg("l"), 6).alias("los_mean"))
    cuts = O.percentiles(ep, [], "l", {"los_median": 0.5, "los_p90": 0.9})
    return counts.crossJoin(cuts.select(*(F.round(c, 6).alias(c) for c in cuts.columns)))  # one row each


@query("a32_acuity_strata", "SELECT coalesce(g, 'total') AS stratum, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM (SELECT *, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS g FROM orders) GROUP BY ROLLUP (g)")
def a32(spark, d):
    g = F.when(F.col("o_orderpriority").startswith("1"), "urgent").when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "open").otherwise("other")
    r = t(spark, d, "orders").withColumn("g", g).rollup("g").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
    return r.select(F.coalesce("g", F.lit("total")).alias("stratum"), "n", "mean_price")


@query("a33_outcome_by_band", "SELECT (c_custkey % 100) // 20 AS band, count(*) AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def a33(spark, d):
    j = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.floor((F.col("c_custkey") % 100) / 20).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("rate"))


@query("a34_sequence_lengths", "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT min(n) AS min, round(quantile_cont(n::DOUBLE, 0.5), 6) AS median, round(quantile_cont(n::DOUBLE, 0.95), 6) AS p95, max(n) AS max, round(avg((n > 70)::INT), 6) AS truncated FROM c")
def a34(spark, d):
    c = t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.min("n").alias("min"), F.round(F.percentile("n", 0.5), 6).alias("median"), F.round(F.percentile("n", 0.95), 6).alias("p95"), F.max("n").alias("max"), F.round(F.avg((F.col("n") > 70).cast("int")), 6).alias("truncated"))


@query("a35_reaggregated_extremes", "SELECT l_orderkey, min(l_quantity) AS min_of_mins, max(l_quantity) AS max_of_maxes FROM lineitem GROUP BY 1")
def a35(spark, d):
    stay = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return stay.groupBy("l_orderkey").agg(F.min("lo").alias("min_of_mins"), F.max("hi").alias("max_of_maxes"))


@query("w01_next_episode", "SELECT o_orderkey, d AS days_to_next, coalesce(d BETWEEN 0 AND 30, false)::INT AS returned FROM (SELECT o_orderkey, (epoch_us(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) - epoch_us(o_orderdate)) / 86400e6::DOUBLE AS d FROM orders)")
def w01(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = t(spark, d, "orders").withColumn("nxt", F.lead("o_orderdate").over(w)).withColumn("days_to_next", P.hours_between("o_orderdate", "nxt") / 24)
    return o.select("o_orderkey", "days_to_next", F.coalesce(F.col("days_to_next").between(0, 30), F.lit(False)).cast("int").alias("returned"))


@query("w02_position", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events")
def w02(spark, d):
    return t(spark, d, "events").select("event_id", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("position"))


@query("w03_first_of_group", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def w03(spark, d):
    return t(spark, d, "events").withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))).filter("r = 1").select("user_id", "event_id")


@query("w04_rolling", "SELECT event_id, round(avg(value) OVER w, 6) AS m3, round(stddev_samp(value) OVER w, 6) AS s3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)")
def w04(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return t(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("m3"), F.round(F.stddev_samp("value").over(w), 6).alias("s3"))


@query("w05_group_size", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events")
def w05(spark, d):
    return t(spark, d, "events").select("event_id", F.count(F.lit(1)).over(W.partitionBy("user_id", "event_type")).alias("n"))


@query("w06_time_difference", "SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6::DOUBLE AS gap_s FROM events")
def w06(spark, d):
    prev = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t(spark, d, "events").withColumn("prev", prev).select("event_id", ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev").cast("timestamp"))) / F.lit(1e6)).alias("gap_s"))


@query("w07_first_last_known", f"WITH {MEASUREMENTS} SELECT l_orderkey, arg_min(val, ROW({ORDER_SQL})) FILTER (val IS NOT NULL) AS first, arg_max(val, ROW({ORDER_SQL})) FILTER (val IS NOT NULL) AS last FROM m GROUP BY 1")
def w07(spark, d):
    at = F.when(F.col("val").isNotNull(), F.struct(*ORDER))
    return measurements(spark, d).groupBy("l_orderkey").agg(F.min_by("val", at).alias("first"), F.max_by("val", at).alias("last"))


@query("w08_top_k_per_group", "SELECT user_id, event_id, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def w08(spark, d):
    return t(spark, d, "events").withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))).filter("rank <= 3").select("user_id", "event_id", "rank")


_TURNS = "x AS (SELECT conv_id, turn, role AS field, (length(text) // 100)::VARCHAR AS value FROM conversations)"


def statements(spark, d):
    return t(spark, d, "conversations").select("conv_id", F.col("role").alias("field"), "turn", F.floor(F.length("text") / 100).cast("string").alias("value"))


@query("w12_latest_statement", f"WITH {_TURNS} SELECT conv_id, field, arg_max(value, turn) AS value, count(*) AS n_statements, (count(DISTINCT value) > 1)::INT AS contradicted FROM x GROUP BY 1, 2")
def w12(spark, d):
    from chronolane.streaming.jobs import latest_facts_batch

    return latest_facts_batch(statements(spark, d))


@query("w13_turns_per_session", "WITH s AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY 1) SELECT count(*) AS n_sessions, sum(n)::BIGINT AS n_turns, round(avg(n), 6) AS turns_per_session FROM s")
def w13(spark, d):
    s = t(spark, d, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("n"))
    return s.agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_turns"), F.round(F.avg("n"), 6).alias("turns_per_session"))


@query("t01_sorted_events", "SELECT user_id, count(*) AS n, count_if(prev > ts) AS n_unordered FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY 1")
def t01(spark, d):
    e = t(spark, d, "events").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    prev = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("bad", F.coalesce(F.col("ts") < prev, F.lit(False))).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_unordered"))


@query("t02_top_by_frequency", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5")
def t02(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "p_brand").limit(5)


@query("t03_top_neighbour", f"WITH {_KNN} SELECT query_id, arg_min(neighbour_id, ROW(distance, neighbour_id)) AS neighbour_id FROM p GROUP BY 1")
def t03(spark, d):
    v = vectors(spark, d)
    return J.nearest_neighbours(v.filter("id % 10 = 0"), v, 1, entity="entity").select("query_id", "neighbour_id")


@query("t04_truncated_sequences", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 50 GROUP BY 1")
def t04(spark, d):
    e = t(spark, d, "events").withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))).filter("r <= 50")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("t05_most_asked", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations WHERE role = 'user') GROUP BY 1 ORDER BY n DESC, word LIMIT 8")
def t05(spark, d):
    w = t(spark, d, "conversations").filter("role = 'user'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(8)


@query("t06_nearest_rank_percentiles", "WITH r AS (SELECT event_type, list_sort(list(value)) AS a FROM events GROUP BY 1) SELECT event_type, a[round(0.5::DOUBLE * (len(a) - 1))::INT + 1] AS p50, a[round(0.95::DOUBLE * (len(a) - 1))::INT + 1] AS p95 FROM r")
def t06(spark, d):
    from chronolane.operators.metrics import nearest_ranks

    return nearest_ranks(t(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("u01_event_union", "SELECT kind, count(*) AS n, count(amount) AS n_amount, count(item) AS n_item FROM (SELECT 'order' AS kind, o_totalprice AS amount, NULL::INT AS item FROM orders UNION ALL SELECT 'line', NULL, l_linenumber FROM lineitem) GROUP BY 1")
def u01(spark, d):
    a = t(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_totalprice").alias("amount"))
    b = t(spark, d, "lineitem").select(F.lit("line").alias("kind"), F.col("l_linenumber").alias("item"))
    return Q.union_all([a, b]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("amount").alias("n_amount"), F.count("item").alias("n_item"))


@query("u02_distinct_keys", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def u02(spark, d):
    return t(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("u03_intersection", "SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def u03(spark, d):
    return t(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(t(spark, d, "events").select("user_id"))


@query("u04_difference", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT user_id FROM events")
def u04(spark, d):
    return t(spark, d, "orders").select(F.col("o_custkey").alias("k")).exceptAll(t(spark, d, "events").select("user_id"))
