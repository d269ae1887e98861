"""What the physical plans look like."""

import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts as A, features as X, profiles as P, sequence as Q
from tidewatch.plans import runs as R
from tidewatch.plans.detection import score_events
from tidewatch.settings import DAY, HOUR, MINUTE
from tidewatch.sources.access import access_events


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def scoring(spark, sf):
    model, sequences = R.access_model(spark, sf)
    return plan(score_events(R.access_test(spark, sf), model, sequences, R.ACCESS))


def test_scoring_stays_in_the_jvm(scoring):
    assert not re.search("BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", scoring)


def test_scoring_never_gathers_events_in_one_task(scoring):
    assert "CartesianProduct" not in scoring
    assert "BroadcastNestedLoopJoin" not in scoring
    main = scoring.split("Subquery")[0]
    assert "SinglePartition" not in main


def test_events_are_exchanged_once_per_key(scoring):
    """By address and by entity; all else by these keys is aggregated before it moves.

    Those are the address counts, and for the growth the first uses, each entity's
    first one and the counts of both.
    """
    main = scoring.split("Subquery")[0]
    keys = re.findall(r"Exchange hashpartitioning\(([a-z_]+)#", main)
    assert keys.count("source_ip") <= 2
    assert keys.count("entity_id") <= 6


def test_entity_profiles_are_dealt_and_not_sent_whole(scoring):
    """A table that is small as stored may be many times as large in every task."""
    main = scoring.split("Subquery")[0]
    sent = re.findall(r"BroadcastHashJoin \[entity_id#", main)
    assert len(sent) == 1  # the off-hours rates, one number for each entity


def test_entity_windows_share_one_sort(spark, sf):
    events = access_events(spark, sf)
    text = plan(X.failed_auth_counts(events, HOUR))
    assert text.count("Exchange") == 1 and len(re.findall(r"\bSort \[", text)) == 1


def test_address_windows_share_one_exchange(spark, sf):
    text = plan(X.ip_concurrency(access_events(spark, sf), 5 * MINUTE, min_events=1))
    assert text.count("Exchange") == 1


def test_steps_cost_the_events_one_join(spark, sf):
    """Even if nothing may be broadcast, events are exchanged by entity and by step, no more."""
    _, sequences = R.access_model(spark, sf)
    test = R.access_test(spark, sf)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        text = plan(Q.transition_lookup(X.with_previous_resource(test), sequences))
    finally:
        spark.conf.set(name, before)
    assert text.count("SortMergeJoin") == 1
    assert text.count("Exchange hashpartitioning") == 3  # the third one is that of the resolved steps


def test_scan_reads_only_what_is_needed(spark, sf):
    text = plan(P.hour_histogram(access_events(spark, sf)))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert schema == "ts:timestamp_ntz,user_id:bigint"


def test_profile_aggregation_combines_before_the_shuffle(spark, sf):
    text = plan(P.profile_values(access_events(spark, sf)))
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text
    assert text.count("Exchange") == 1


def test_pages_take_ordered_rows(spark, sf):
    d = R.detection(spark, sf)
    text = plan(A.alerts_page(d.alerts, d.scored, A.AlertFilter(min_risk=0.2), page=2))
    assert "TakeOrderedAndProject" in text
    assert "GreaterThanOrEqual(risk_score,0.2)" in text


def test_alert_filter_reaches_the_scan(spark, sf):
    d = R.detection(spark, sf)
    text = plan(A.alert_filter(d.scored, A.AlertFilter(attack_type="brute_force")).select("session_id"))
    assert "EqualTo(predicted_type,brute_force)" in text


def test_daily_refit_reads_only_its_days(spark, sf, tmp_path):
    events = access_events(spark, sf)
    P.write_daily(events, str(tmp_path))
    daily = P.read_daily(spark, str(tmp_path))
    first, last = daily.moments.agg({"day": "min"}).first()[0], daily.moments.agg({"day": "max"}).first()[0]
    part = daily.window(last, 14)
    for table in (part.moments, part.values):
        text = plan(table)
        assert re.search(r"PartitionFilters: \[[^\]]*day", text) and "events.parquet" not in text
        files = [r[0] for r in table.select("_metadata.file_path").distinct().collect()]
        days = {int(re.search(r"day=(\d+)", f)[1]) for f in files}
        assert first < min(days) and days == set(range(last - 14, last))


def test_daily_tables_add_up_to_the_profiles_of_their_events(spark, sf, tmp_path):
    events = access_events(spark, sf)
    P.write_daily(events, str(tmp_path))
    P.write_daily(events, str(tmp_path))  # a day that is written again replaces itself
    daily = P.read_daily(spark, str(tmp_path))
    last = daily.moments.agg({"day": "max"}).first()[0] - 2
    whole = P.fit_rolling(events, F.lit(last * DAY))
    refit = P.fit_daily(daily, last)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(refit.entity_values) == rows(whole.entity_values) and rows(refit.type_values) == rows(whole.type_values)
    for table in ("entities", "types"):
        a, b = (
            rows(getattr(m, table).select(*[F.round(c, 6) if c.endswith("_std") else c for c in P.PROFILE_FIELDS], "first_us", "last_us"))
            for m in (refit, whole)
        )
        assert a == b
    model = P.fit_profiles(P.label_filter(events.filter(F.col("event_us") < 20 * DAY + daily.moments.agg({"day": "min"}).first()[0] * DAY)))
    assert rows(P.drift_daily(daily, model, last)) == rows(P.drift_flags(events, model, F.lit(last * DAY)))
