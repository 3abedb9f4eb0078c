"""Hand-made edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableward.functions.common import in_window
from tableward.model import schema
from tableward.operators import (
    backlog,
    catalog,
    changes,
    direct_writes,
    governance,
    layout,
    lineage,
    ml,
    ownership,
    pipelines,
    quality,
    schemas,
    scoring,
)
from tableward.sources import files

AS_OF = "2024-01-31"


def day(n, hour=0):
    return dt.datetime(2024, 1, 31, hour) - dt.timedelta(days=n)


def test_direct_writes_count_null_entities(spark):
    rows = [("t1", None), ("t1", "JOB"), ("t1", "NOTEBOOK"), ("t1", "PIPELINE"), ("t1", "DBSQL_QUERY"), ("t2", None)]
    writes = spark.createDataFrame(rows, "table_id string, entity_type string")
    tables = spark.createDataFrame([("t1", "bronze"), ("t2", "gold")], "table_id string, data_layer string")
    got = [r.entity_type for r in direct_writes.direct_writes(writes, tables).collect()]
    assert sorted(got, key=str) == ["DBSQL_QUERY", "NOTEBOOK", None]


def test_edit_window_is_closed_and_ties_go_to_the_later_id(spark):
    rows = [(1, "t", day(90), "a", "INSERT"), (2, "t", day(91), "b", "INSERT"), (3, "t", day(0), "c", "MERGE"), (4, "t", day(0), "d", "UPDATE")]
    writes = spark.createDataFrame(
        rows, "event_id int, table_name string, event_time timestamp, user_email string, action_type string"
    ).withColumn("entity_type", F.lit(None).cast("string"))
    (got,) = direct_writes.edit_counts(writes, AS_OF).collect()
    assert (got.edit_count_90d, got.last_editor_email, got.last_action_type) == (3, "d", "UPDATE")


def test_window_holds_the_whole_last_day(spark):
    rows = [("t", day(0, 0)), ("t", day(0, 10)), ("t", dt.datetime(2024, 1, 31, 23, 59, 59)), ("t", dt.datetime(2024, 2, 1)), ("t", day(90)), ("t", dt.datetime(2023, 11, 1, 23, 59))]
    df = spark.createDataFrame(rows, "table_name string, t timestamp")
    assert df.filter(in_window(df, "t", AS_OF, 90)).count() == 4
    assert df.filter(in_window(df, "t", dt.datetime(2024, 1, 31, 10), 90)).count() == 3
    assert df.filter(in_window(df, "t", dt.date(2024, 1, 30), 90)).count() == 2


def test_unknown_flags_are_not_set(spark):
    df = spark.createDataFrame([("p", None, None, None, None)], "pipeline_id string, has_owner_tag boolean, is_production boolean, has_dq_expectations boolean, uses_hardcoded_paths boolean")
    assert pipelines.anti_patterns(df).first().anti_pattern_count == 2
    assert pipelines.without_dq(df).count() == 1
    never = spark.createDataFrame([(1, None)], "experiment_id int, last_run_date date")
    assert ml.stale_experiments(never, AS_OF).first().days_since_run is None


def test_severity_border(spark):
    edits = spark.createDataFrame([("a", 20), ("b", 21), ("c", 1)], "table_name string, edit_count_90d int")
    executive = spark.createDataFrame([("c",), ("c",)], "table_name string")
    got = {r.table_name: r.severity for r in direct_writes.edit_severity(edits, executive=executive).collect()}
    assert got == {"a": "high", "b": "critical", "c": "critical"}


def test_edit_gap_of_a_single_table(spark):
    one = spark.createDataFrame([("a", 4)], "table_name string, edit_count_90d int")
    (got,) = direct_writes.edit_gap(one).collect()
    assert (got.table_name, got.edit_count, got.runner_up, got.gap_ratio) == ("a", 4, None, None)


@pytest.fixture(scope="module")
def pipes(spark):
    rows = [("p1", True, True, True, False), ("p2", False, True, True, True), ("p3", True, False, False, False), ("p4", False, False, True, False)]
    return spark.createDataFrame(
        rows,
        "pipeline_id string, has_owner_tag boolean, is_production boolean, has_dq_expectations boolean, uses_hardcoded_paths boolean",
    ).select("*", F.lit("n").alias("pipeline_name"), F.lit(None).cast("string").alias("owner_email"), F.lit(1).alias("avg_duration_sec"))


def test_pipeline_without_runs_and_null_pipeline(spark, pipes):
    rows = [("p1", "failed", day(1)), ("p1", "failed", day(2)), (None, "failed", day(1)), ("p4", "failed", day(40)), ("p4", "succeeded", day(30))]
    runs = spark.createDataFrame(rows, "pipeline_id string, status string, start_time timestamp")
    got = {r.pipeline_id: r for r in pipelines.health(pipes, runs, AS_OF).collect()}
    assert len(got) == 4
    assert {k: r.health_status for k, r in got.items()} == {"p1": "critical", "p2": "critical", "p3": "warning", "p4": "healthy"}
    assert got["p2"].failure_rate_30d == 0.0
    assert got["p4"].failure_rate_30d == 0.0
    assert got["p2"].anti_pattern_count == 2
    basic = {r.pipeline_id: r for r in pipelines.health(pipes, runs, rule="basic", window_days=None).collect()}
    assert basic["p4"].failure_rate_30d == 0.5
    assert basic["p2"].health_status == "warning"
    assert pipelines.health(pipes, runs.limit(0), AS_OF).count() == 4


def test_empty_owner_is_no_owner(spark):
    df = spark.createDataFrame([("a", ""), ("b", None), ("c", "x@y.com")], "table_id string, owner_email string")
    assert {r.asset_id for r in ownership.unowned_assets(table=df).collect()} == {"a", "b"}
    groups = spark.createDataFrame([("g",)], "principal string")
    assert {r.owner_kind: r.n for r in ownership.owner_kind(df, groups).collect()} == {"none": 2, "user": 1}


def test_trend_counts_from_the_later_of_created_and_owned(spark):
    rows = [(day(100), None), (day(100), day(100)), (day(1), day(50)), (day(5), day(0)), (day(-3), day(-3))]
    history = spark.createDataFrame(rows, "created_at timestamp, owned_at timestamp")
    got = {r.report_date: (r.total, r.owned) for r in ownership.trend(history, AS_OF, 6).collect()}
    assert len(got) == 7
    assert got[dt.date(2024, 1, 25)] == (2, 1)
    assert got[dt.date(2024, 1, 26)] == (3, 1)
    assert got[dt.date(2024, 1, 30)] == (4, 2)
    assert got[dt.date(2024, 1, 31)] == (4, 3)


@pytest.mark.parametrize(("step", "days"), [(0.5, 10), (0.0, None), (-1.0, None)])
def test_forecast(spark, step, days):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=k), 90 - step * (10 - k)) for k in range(11)]
    trend = spark.createDataFrame(rows, "report_date date, coverage_pct double")
    assert ownership.goal_forecast(trend).first().days_to_goal == days


def test_closure_with_cycle_and_self_loop(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("c", "d"), ("a", "b")], "source string, target string")
    got = {(r.source, r.target): r.min_depth for r in lineage.lineage_closure(edges).collect()}
    assert got == {
        ("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1, ("c", "d"): 1,
        ("a", "c"): 2, ("b", "a"): 2, ("b", "d"): 2, ("c", "b"): 2, ("a", "d"): 3,
    }
    one = {(r.source, r.target) for r in edges.filter("source <> target").collect()}
    assert one <= set(got)
    assert lineage.lineage_closure(edges.limit(0)).count() == 0


def test_naming(spark):
    names = ["gold_customer_360", "bronze_x", "raw_a_b", "Gold_a_b", "silver_a_", "sales"]
    df = spark.createDataFrame([(n, "gold") for n in names], "table_name string, data_layer string")
    assert catalog.naming_violations(df).first().violations == 4


def test_backlog_orders_and_counts(spark):
    rows = [("f1", "medium", 900), ("f2", "critical", 1), ("f3", "high", 5), ("f4", "critical", 7), ("f5", "high", 5)]
    df = spark.createDataFrame(rows, "finding_id string, severity string, v int").select(
        "finding_id", "severity", F.lit("c").alias("category"), F.col("v").cast("decimal(18,2)").alias("business_impact_usd"), F.lit(1).alias("sprint_estimate_days")
    )
    assert {r["rank"]: r.finding_id for r in backlog.ranked(df).collect()} == dict(enumerate(["f4", "f2", "f3", "f5", "f1"], 1))
    assert [r.finding_id for r in backlog.top_n(df, 2).collect()] == ["f4", "f3"]
    total = [r for r in backlog.severity_counts(df).collect() if r.category == "overall"][0]
    assert (total.critical_n, total.high_n, total.medium_n) == (2, 2, 1)


def test_scores(spark):
    rows = [(dt.date(2024, 1, 1), "a", 3, 10, 10), (dt.date(2024, 1, 1), "a", 1, 10, 0), (dt.date(2024, 1, 1), "b", 2, 8, 1), (dt.date(2024, 1, 31), "a", 1, 0, 0)]
    checks = spark.createDataFrame(rows, "report_date date, dimension string, weight bigint, checked bigint, violations bigint")
    scores = scoring.health_scores(checks)
    got = {(r.report_date.day, r.dimension): r.score for r in scores.collect()}
    assert got == {(1, "a"): 25, (1, "b"): 88, (1, "overall"): 57, (31, "a"): 100, (31, "overall"): 100}
    delta = {(r.report_date.day, r.dimension): r.score_delta_30d for r in scoring.score_delta(scores).collect()}
    assert delta[(31, "a")] == 75 and delta[(1, "a")] is None
    assert [r.band for r in scoring.with_band(spark.createDataFrame([(59,), (60,), (74,), (75,)], "score int")).collect()] == ["critical", "warning", "warning", "healthy"]


def test_diff_applies_to_the_new_snapshot(spark):
    old = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, None)], "k int, v double")
    new = spark.createDataFrame([(1, 1.0), (2, 2.0), (4, None), (5, None)], "k int, v double")
    diff = changes.snapshot_diff(old, new, ["k"], ["v"])
    assert {(r.k, r.op) for r in diff.collect()} == {(2, "UPDATE"), (3, "DELETE"), (5, "INSERT")}
    applied = changes.apply_diff(old, diff, ["k"], "v")
    assert {r.side for r in changes.full_reconcile(applied, new, ["k"]).collect()} == {"same"}
    assert changes.multiset_reconcile(applied, new).count() == 0


def test_append_twice_adds_nothing(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    batch = spark.createDataFrame([(1, "z"), (2, "b"), (2, "b")], "k int, v string")
    once = changes.idempotent_append(target, batch, ["k"])
    assert sorted(tuple(r) for r in once.collect()) == [(1, "a"), (2, "b")]
    assert changes.idempotent_append(once, batch, ["k"]).count() == 2


def test_watermark_of_an_empty_target(spark):
    source = spark.createDataFrame([(1,), (2,)], "k int")
    assert changes.watermark_extract(source, source.limit(0), "k", ["k"]).count() == 2
    assert changes.watermark_extract(source, source, "k", ["k"]).count() == 0


def test_watermark_takes_late_rows_at_the_mark(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b"), (2, "late"), (3, "c")], "t int, k string")
    loaded = spark.createDataFrame([(1, "a"), (2, "b")], "t int, k string")
    assert sorted(r.k for r in changes.watermark_extract(source, loaded, "t", ["k"]).collect()) == ["c", "late"]


def test_upsert_into_target(spark):
    target = spark.createDataFrame([(1, 1, "a"), (2, 9, "new"), (3, 1, "c")], "k int, seq int, v string")
    feed = spark.createDataFrame([(1, 2, "b", "UPDATE"), (2, 3, "old", "UPDATE"), (3, 2, None, "DELETE"), (4, 1, "d", "INSERT")], "k int, seq int, v string, op string")
    got = {r.k: r.v for r in changes.upsert_scd1(feed, ["k"], ["seq"], target=target).collect()}
    assert got == {1: "b", 2: "new", 4: "d"}


def test_schema_modes(spark):
    df = spark.createDataFrame([("1", 2**40, "n"), ("x", 3, None), (None, 4, "m")], "a string, b bigint, c string")
    target = schema("a integer, b integer, d double")
    widened = schemas.schema_policy(df, target, "add_new_widen")
    assert widened.columns == ["a", "b", "d", "c", "_rescued_data"]
    assert widened.schema["b"].dataType == T.LongType()
    assert [r._rescued_data for r in widened.collect()] == [None, '{"a":"x"}', None]
    kept = schemas.schema_policy(df, target, "add_new").collect()
    assert kept[0].b is None and kept[0]._rescued_data == '{"b":"1099511627776"}'
    rescued = schemas.schema_policy(df, target, "rescue").collect()
    assert [r._rescued_data for r in rescued] == ['{"b":"1099511627776","c":"n"}', '{"a":"x"}', '{"c":"m"}']
    assert schemas.schema_policy(df, target, "none").columns == ["a", "b", "d"]
    with pytest.raises(schemas.SchemaChangeError):
        schemas.schema_policy(df, target, "fail_on_new")


def test_expectation_policies(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    rules = {"small": "v < 3"}
    assert tuple(quality.expectation_metrics(df, rules).first()) == ("small", 1, 2)
    assert quality.expectations(df, rules, "warn").count() == 3
    assert quality.expectations(df, rules, "drop").count() == 1
    good, bad = quality.quarantine(df, rules)
    assert (good.count(), bad.count()) == (1, 2)
    with pytest.raises(Exception, match="expectation failed: small"):
        quality.expectations(df, rules, "fail").collect()


def test_key_and_reference_checks(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, None)], "k int, p int")
    assert {r.check: r.bad_n for r in quality.not_null_unique_check(df, ["k"]).collect()} == {"null_key": 1, "duplicate_key": 1}
    assert quality.fk_check(df, "p", spark.createDataFrame([(2,)], "id int"), "id").first().bad_n == 2
    assert quality.fk_check(df.limit(0), "p", df, "k").first().bad_n == 0


def test_interval_with_end_before_start(spark):
    df = spark.createDataFrame([(day(1), day(2), 5), (day(1), day(1, 1), 3600)], "s timestamp, e timestamp, d int")
    assert {r.check: r.bad_n for r in quality.interval_check(df, "s", "e", "d").collect()} == {"end_before_start": 1, "wrong_duration": 1}


def test_exact_and_estimated_column_stats(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("a"), F.when(F.col("id") > 9, "x").alias("b"))
    got = {r.column: r for r in quality.column_stats(df).collect()}
    assert (got["a"].ndv, got["b"].ndv, got["b"].nulls, got["a"].max) == (7, 1, 10, "6")
    assert {r.column: r.ndv for r in quality.column_stats(df, approximate=True).collect()} == {"a": 7, "b": 1}


def test_masked_text_holds_no_value(spark):
    texts = ["mail a.b@c.org now", "1234 5678 9012 3456 1234-5678-9012-3456", "10.0.0.1 10.0.0.2", "call 555-123-4567", "ssn 123-45-6789", "plain 12"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tags, policy = {"text": list(governance.VALUE_PATTERNS)}, dict.fromkeys(governance.VALUE_PATTERNS, "redact")
    before = {r.rule: r.hits for r in governance.classify(df, "text").collect()}
    assert all(before.values())
    masked = governance.column_mask(df, tags, policy)
    assert all(r.hits == 0 for r in governance.classify(masked, "text").collect())
    assert masked.filter("text = 'plain 12'").count() == 1
    assert governance.column_mask(df, tags, policy, {"privacy"}, {"privacy"}) is df
    strong = governance.column_mask(df, tags, {**policy, "us_ssn": "null"})
    assert strong.filter("text IS NOT NULL").count() == 0


@pytest.mark.parametrize("card", ["4111 1111 1111 1234", "4111-1111-1111-1234", "4111111111111234", "41111111111112345", "4111 1111 1111 1234 555-123-4567"])
def test_no_digit_of_a_card_number_stays(spark, card):
    df = spark.createDataFrame([(f"pay {card} now",), (f"{card}@x.org",), ("(555) 123-4567",)], "text string")
    tags, policy = {"text": list(governance.VALUE_PATTERNS)}, dict.fromkeys(governance.VALUE_PATTERNS, "redact")
    for r in governance.column_mask(df, tags, policy).collect():
        assert not any(c.isdigit() for c in r.text), r.text


def test_names_in_any_case(spark):
    names = spark.createDataFrame([("o", "Customer_EMAIL"), ("o", "emailed")], "object string, column_name string")
    tags = spark.createDataFrame([], "object string, column_name string, tag_key string, tag_value string")
    assert [r.column_name for r in governance.sensitive_name_scan(names, tags).collect()] == ["Customer_EMAIL"]


def test_guarded_rules_equal_plain_rules(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = {n: docs.filter(F.col("text").rlike(p)).count() for n, p in governance.BUILT_IN_RULES.items()}
    assert {r.rule: r.hits for r in governance.classify(docs, "text").collect()} == plain


@pytest.mark.parametrize(
    "rule, good, bad",
    [
        ("card_number", ["pay 4111111111111111.", "2024 4111 1111 1111 1111", "x4111-1111-1111-1111 and 5", "4111 1111 1111 1112 4111 1111 1111 1111"],
         ["4111111111111112", "44111111111111111", "4111 1111 1111 11", "4111.1111.1111.1111", "4111  "]),
        ("ip_address", ["at 10.0.0.255.", "(1.2.3.4)", "256.1.1.1 or 255.1.1.1"], ["10.0.0.256", "1.2.3.4.5", "1.2.3", "1234.1.1.1", "99999999999.1.1.1"]),
        ("us_ssn", ["123-45-6789", "no: 899-01-0001-"], ["000-45-6789", "666-45-6789", "900-45-6789", "123-00-6789", "123-45-0000", "1123-45-6789", "123-45-6789-1"]),
    ],
)
def test_only_values_that_can_exist_count(spark, rule, good, bad):
    for texts, want in ((good, len(good)), (bad, 0), ([None, "", "9" * 200_000, "1." * 100_000, "(" * 100_000 + "1234"], 0)):
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        assert {r.rule: r.hits for r in governance.classify(df, "text", checked=True).collect()}[rule] == want, (rule, texts[0])


def test_tags_of_a_table(spark):
    rows = [("t", "a", "class", "email_address"), ("t", "a", "class", "ip_address"), ("t", "z", "class", "x"), ("u", "a", "class", "y"), ("t", "a", "domain", "d")]
    tags = spark.createDataFrame(rows, "object string, column_name string, tag_key string, tag_value string")
    assert governance.tags_of(tags, "t", ["a", "b"]) == {"a": ["email_address", "ip_address"]}


def test_vacuum_and_layout_edges(spark):
    rows = [("a", "VACUUM", dt.date(2024, 1, 1), 0), ("a", "WRITE", dt.date(2024, 1, 30), 5), ("b", "WRITE", dt.date(2024, 1, 1), 5)]
    rows += [(t, "ANALYZE", dt.date(2024, 1, 10), 0) for t in ("c", "d")] + [("c", "WRITE", dt.date(2024, 1, 11), 10), ("d", "WRITE", dt.date(2024, 1, 11), 9), ("d", "WRITE", dt.date(2024, 1, 9), 90)]
    history = spark.createDataFrame(rows, "table_id string, operation string, op_date date, rows_changed long")
    sized = spark.createDataFrame([(t, 100) for t in "abcd"], "table_id string, num_rows long")
    props = spark.createDataFrame([("a", 7), ("b", 6)], "table_id string, retention_days int")
    got = {(r.table_id, r.reason) for r in layout.vacuum_policy(history, props, AS_OF).collect()}
    assert got == {(t, "never vacuumed") for t in "bcd"} | {("b", "retention under seven days")}
    stale = {(r.table_id, r.reason, r.changed_ratio) for r in layout.stale_stats(history, sized).collect()}
    assert stale == {("a", "never analyzed", 0.05), ("b", "never analyzed", 0.05), ("c", "changed after analysis", 0.1)}
    assert {r.reason for r in layout.purge_before_vacuum(history).collect()} == {"never purged"}
    detail = spark.createDataFrame([("x", 0, 0), ("y", 10**14, 10)], "table_id string, size_bytes bigint, num_files bigint")
    assert layout.small_files(detail).count() == 0


def test_tables_and_named_parameters(spark, tmp_path):
    df = files.with_comments(spark.createDataFrame([(1, "a")], "k int, v string"), {"k": "the key"})
    files.save_table(df, "saved_once", "made in a test")
    files.append_table(df, "saved_once")
    assert files.read_table(spark, "saved_once").schema["k"].metadata["comment"] == "the key"
    got = files.bind(spark, "SELECT count(*) AS n FROM IDENTIFIER(:t) WHERE k = :k", {"t": "saved_once"}, k=1)
    assert got.first().n == 2
    spark.sql("DROP TABLE saved_once")


def test_export_keeps_quotes_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", ok', None), ("line", "x@y.z")], "a string, b string")
    back = files.export_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_work_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from tableward import session

    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    class Fake:
        sparkContext = Context()
        conf = spark.conf

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(Fake())


def test_work_folders_are_released(spark):
    from tableward import session

    kept = session.keep(spark.range(5).toDF("id"), "short-lived")
    (path,) = {p.rsplit("/", 1)[0] for p in kept.inputFiles()}
    assert session.release(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_layout_keeps_a_common_value_spread(spark, tmp_path):
    df = spark.range(4000).select(F.lit(1).alias("k"), "id")
    assert files.cluster_layout(df, str(tmp_path / "out"), ["k"], 4).first().files == 4


def test_archive_splits_by_month(spark, tmp_path):
    df = spark.createDataFrame([(day(0),), (day(31),), (day(32),)], "ts timestamp")
    got = {r.month: r.archived_n for r in files.archive(df, str(tmp_path / "out"), "ts").collect()}
    assert got == {202401: 1, 202312: 2}
