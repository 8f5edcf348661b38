import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.operators import clean, derive, joins, metrics, models, quality, screening, splits
from chronolane.operators import text as texts
from chronolane.sources import catalog
from chronolane.streaming import jobs


@pytest.mark.parametrize(("value", "points"), [(40.5, 3), (41.0, 1), (50.9, 1), (51.0, 0), (90.99, 0), (131.0, 3), (None, None)])
def test_bands_have_no_gap(spark, value, points):
    bands, above = derive.NEWS2_BANDS["heart_rate"]
    assert spark.createDataFrame([(value,)], "v double").select(derive.band_score("v", bands, above)).first()[0] == points


def test_composite_score_needs_enough_parts(spark):
    df = spark.createDataFrame([(10, 95, 120, None), (10, 95, 120, 70)], "rr int, sp int, bp int, hr int")
    out = derive.early_warning(df, {"resp_rate": ["rr"], "spo2": ["sp"], "systolic": ["bp"], "heart_rate": ["hr"]})
    assert [r.news2 for r in out.orderBy("hr").collect()] == [None, 2]


def test_units_convert_or_drop(spark):
    df = spark.createDataFrame([(" ML", 5.0), ("l", 2.0), ("mg", 9.0), (None, 1.0)], "u string, v double")
    factors = {"ml": 1, "l": 1000}
    assert sorted(r.o for r in clean.to_unit(df, "u", "v", factors, "o").collect()) == [5.0, 2000.0]
    assert clean.to_unit(df, "absent", "v", factors, "o").count() == 4


def test_end_before_start_is_flagged_and_kept(spark):
    df = spark.createDataFrame([(2, 1), (1, 2), (1, None)], "a int, b int")
    assert [r.invalid_order for r in clean.flag_time_order(df, "a", "b").collect()] == [1, 0, 0]


def test_duplicates_flag_every_member_and_null_keys(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (None, "w"), (2, "v")], "k int, t string")
    out = {r.t: r.is_duplicate for r in clean.flag_duplicates(df, ["k"]).collect()}
    assert out == {"x": 1, "y": 1, "z": 1, "w": 1, "v": 0}


def test_nearest_preceding_keeps_one_row(spark):
    left = spark.createDataFrame([(1, 10)], "k int, at int")
    right = spark.createDataFrame([(1, 5, 1), (1, 9, 2), (1, 12, 3)], "k int, rat int, id int")
    row = joins.nearest_preceding(left, right, "k", "at", "rat", ["id"]).collect()
    assert [(r.id, r.precedes, r.n_candidates) for r in row] == [(2, 1, 3)]


def test_fan_out_guard(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    wide = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, n_total double")
    out = joins.merge_all(base, [joins.to_grain(wide, ["k"], "n_total")], ["k"])
    assert {r.k: r.n_total for r in out.collect()} == {1: 5.0, 2: None}


def test_metric_identities(spark):
    rows = [("perfect", 0.9, 1), ("perfect", 0.1, 0), ("constant", 0.5, 1), ("constant", 0.5, 0), ("one class", 0.4, 1)]
    df = spark.createDataFrame(rows, "m string, p double, y int")
    assert {r.m: r.auroc for r in metrics.auroc(df, "p", "y", ["m"]).collect()} == {"perfect": 1.0, "constant": 0.5, "one class": None}
    assert {r.m: r.auprc for r in metrics.average_precision(df, "p", "y", ["m"]).collect()}["perfect"] == 1.0


def test_small_slices_are_not_measured(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 0)], "g string, p double, y int")
    out = metrics.slices(df, ["g"], "p", "y").collect()
    assert all(r.auroc is None and r.measured == 0 for r in out)


def test_greedy_elimination_prefers_windowed_then_complete():
    pairs = [("a_24h", "b", 0.99), ("b", "c", 0.99), ("c", "d", -0.97)]
    assert screening.greedy_elimination(pairs, ["a_24h", "b", "c", "d"], {"c": 0.5}) == ["b", "c"]


def test_duplicate_columns_are_not_fooled_by_permutation(spark):
    df = spark.createDataFrame([(1, 1, 2, 1), (2, 2, 1, 2)], "k int, a int, b int, c int")
    assert [tuple(r) for r in screening.duplicate_columns(df, "k", ["a", "b", "c"]).collect()] == [("a", "c")]


def test_alignment_fills_only_supplied_categories(spark):
    row = screening.align(spark.createDataFrame([(1.0,)], "x double"), ["x", "sex_M", "age"], {"sex"}).first()
    assert (row.x, row.sex_M, row.age) == (1.0, 0.0, None)


def test_split_does_not_move_when_the_cohort_changes(spark):
    ids = spark.range(1000).withColumnRenamed("id", "i")
    old = ids.select("i", splits.split("i", 3).alias("split"))
    new = ids.filter("i % 3 <> 0").select("i", splits.split("i", 3).alias("split"))
    assert splits.moved(old, new, "i").first()["n_moved"] == 0 and splits.overlaps(old, "i").isEmpty()
    shifted = ids.select("i", splits.split("i", 4).alias("split"))
    with pytest.raises(ValueError):
        splits.overwrite(old, shifted, "i")


def test_fingerprint_ignores_order_and_type(spark):
    a = splits.fingerprint(spark.range(50).withColumnRenamed("id", "i"), "i").first()
    b = splits.fingerprint(spark.range(50).select(F.col("id").cast("int").alias("i")).orderBy(F.desc("i")), "i").first()
    assert a == b


def test_calibration_does_not_raise_brier(spark):
    df = spark.range(4000).select((F.col("id") % 100 / 100.0).alias("p"), (metrics.hash_uniform("id") < F.pow(F.col("id") % 100 / 100.0, F.lit(3))).cast("int").alias("y"))
    out = models.calibrate(models.isotonic(df, "p", "y"), df, "p").agg(metrics.brier("p", "y"), metrics.brier("calibrated", "y")).first()
    assert out[1] <= out[0]


def test_sources_survive_bad_lines_and_absent_tables(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    (tmp_path / "x.csv").write_text("a,b\n9007199254740993,ok\nbad,no\n")
    got = catalog.read_csv(spark, str(tmp_path / "x.csv"), schema).collect()
    assert got[0].a == 9007199254740993 and got[1].a is None and got[1]._bad_record
    (tmp_path / "log.jsonl").write_text(json.dumps({"a": 1, "b": "x"}) + "\n" + '{"a": 2, "b"')
    assert [r.a for r in catalog.read_jsonl(spark, str(tmp_path / "log.jsonl"), schema).collect()] == [1]
    spec = catalog.TableSpec("gone", str(tmp_path / "gone"), schema, optional=True)
    tables, errors = catalog.load_all(spark, [spec, catalog.TableSpec("bad", str(tmp_path / "none"))])
    assert tables["gone"].isEmpty() and set(errors) == {"bad"}
    catalog.save(spark.range(3), str(tmp_path / "p"))
    assert catalog.resume(spark, str(tmp_path / "p"), lambda: 1 / 0).count() == 3


def test_streams_equal_their_batch_twins(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    parsed = T._parse_datatype_string(schema)
    stream = jobs.windowed_telemetry(jobs.read_stream(spark, str(tmp_path / "in"), parsed, "parquet"), "ts", "1 day", "event_type", "value")
    jobs.run_once(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.window_start: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.window_start: r.n for r in jobs.windowed_telemetry(events, "ts", "1 day", "event_type", "value").collect()}
    assert got and all(want[k] == n for k, n in got.items()) and set(want) - set(got) <= {max(want)}


def test_stateful_facts_equal_batch(spark, tmp_path):
    rows = [(1, "age", 0, "30"), (1, "age", 1, "31"), (2, "age", 0, "5"), (1, "sex", 2, "F")]
    df = spark.createDataFrame(rows, "conv_id long, field string, turn long, value string")
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs.latest_facts(jobs.read_stream(spark, str(tmp_path / "in"), df.schema, "parquet"))
    q = stream.writeStream.format("memory").queryName("facts").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    key = lambda r: (r.conv_id, r.field, r.value, r.n_statements, r.contradicted)
    assert sorted(map(key, spark.table("facts").collect())) == sorted(map(key, jobs.latest_facts_batch(df).collect()))


def test_grounding_accepts_percentages(spark):
    claims = spark.createDataFrame([(1, "risk 12.5 of 80")], "k int, t string")
    facts = spark.createDataFrame([(1, 0.125)], "k int, f double")
    assert [r.value for r in texts.ungrounded(claims, facts, "k", "t", "f").collect()] == [80.0]


def test_grain_report(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    row = quality.grain(df, ["k"], spark.createDataFrame([(1,)], "k int")).first()
    assert (row.n_keys, row.n_repeated, row.n_outside) == (2, 1, 1)


def test_nearest_ranks_and_sequences_gather_no_group(spark):
    rows = [("a", float(i * 37 % 1001), i) for i in range(1001)] + [("b", 5.0, i) for i in range(50)] + [(None, 1.0, 1), (None, 2.0, 2), ("c", None, 1)]
    df = spark.createDataFrame(rows, "k string, v double, i int")
    ranks = metrics.nearest_ranks(df, "k", "v", {"p50": 0.5, "p95": 0.95}, buckets=8)
    assert {tuple(r) for r in ranks.collect()} == {("a", 500.0, 950.0), ("b", 5.0, 5.0), (None, 2.0, 2.0), ("c", None, None)}
    assert "collect_list" not in ranks._jdf.queryExecution().toString()
    seq = screening.sequences(df, "k", ["i"], "v", 3)
    got = {r.k: (r.n_events, r["values"], r.mask) for r in seq.collect()}
    assert got == {"a": (1001, [0.0, 37.0, 74.0], [1, 1, 1]), "b": (50, [5.0] * 3, [1, 1, 1]), None: (2, [1.0, 2.0, 0.0], [1, 1, 0]), "c": (1, [0.0] * 3, [1, 0, 0])}
    assert "row_number" in seq._jdf.queryExecution().toString()


def test_two_stage_duration_is_evaluated_on_actual_and_predicted_short(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(200)], "x double, days double")
    fitted = models.two_stage_duration(df, ["x"], "days")
    assert fitted[0] == 149.25
    got = {r.subset: r for r in models.evaluate_duration(fitted, df, ["x"], "days").collect()}
    assert got["all"].n == 200 and got["all"].accuracy > 0.98 and got["all"].auroc > 0.98 and got["all"].mae is None
    assert got["actual_short"].n == 150 and abs(got["predicted_short"].n - 150) <= 3 and got["actual_short"].r2 > 0.9 and got["predicted_short"].mae < 15


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="checkpoint"):
        catalog.scratch(spark)


def test_document_and_rule_validation_of_edge_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "https://a.example.org/x", "h"), (2, None, "h"), (3, "https://evil-example.org/x", "h"), (4, "ftp://example.org", ""), (5, "http://example.org", "h"), (5, "http://example.org", "h")], "id int, url string, html string")
    got = sorted((r.id, r.problem or "", r.tier) for r in quality.validated_documents(docs, "id", "url", ["url", "html"], [("example.org", 1)], 9).collect())
    assert got == [(1, "", 1), (2, "missing url", 9), (3, "source not allowed", 9), (4, "missing html", 9), (5, "repeated id", 1), (5, "repeated id", 1)]
    (tmp_path / "r.json").write_text('{"id": "a", "label": "x"}\n{"id": "a", "label": "y"}\n{"label": "z"}\n{"id": "b"}\n{"id": "c", "label": "ok"}\n')
    rules = catalog.read_rules(spark, str(tmp_path / "r.json"), "id string, label string", "id", ["label"], {})
    assert sorted((r.id or "", r.problem or "") for r in rules.collect()) == [("", "missing id"), ("a", "repeated id"), ("a", "repeated id"), ("b", "missing label"), ("c", "")]
