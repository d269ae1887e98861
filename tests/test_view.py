"""The access view and the runs that read it many times."""

from tidewatch.plans import runs as R
from tidewatch.sources.access import events_as_access


def test_view_matches_its_pattern_once(spark):
    """The view's number has many uses; its pattern stands in the plan once."""
    raw = spark.createDataFrame([(1, 2, "error", 1.0, '{"k": 50}')], "event_id long, user_id long, event_type string, value double, props string")
    plan = events_as_access(raw.selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' AS ts").repartition(2))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1


def test_runs_read_the_stored_view(spark, sf):
    """The many passes of a run read columns, not the text that the view takes apart."""
    for part in R.stored_split(spark, sf):
        assert "regexp_extract(" not in part._jdf.queryExecution().optimizedPlan().toString()
    assert R.stored_events(spark, sf) is R.stored_events(spark, sf)
