"""Reading logs, and writing and reading back outputs and models."""

import time

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts as A, evaluate as E, profiles as P
from tidewatch.plans import runs as R
from tidewatch.plans.detection import detect, score_events
from tidewatch.session import FILE_CLEANUP, materialize, new_path
from tidewatch.settings import PLAIN_BATCH
from tidewatch.sources import access, sinks

LOG = """session_id,entity_id,entity_type,timestamp,source_ip,geo_location,resource_accessed,auth_method,auth_result,session_duration,command_sequence,device_fingerprint,label
s1,u1,user,2026-01-01T23:15:00,10.0.0.1,"London, UK",/mail,password,fail,120,"[""ls"", ""cat x""]",os|mac|proto,normal
s2,u1,user,2026-01-02T01:00:00,10.0.0.1,"Paris, FR",/mail,token,failure,60,not json,os|mac|proto,brute_force
"""


def test_csv_log(spark, tmp_path):
    (tmp_path / "log.csv").write_text(LOG)
    rows = access.scan_log(spark, str(tmp_path / "log.csv"), "csv").orderBy("session_id").collect()
    assert [r.hour for r in rows] == [23, 1]
    assert [r.geo_location for r in rows] == ["London, UK", "Paris, FR"]
    assert [r.command_sequence for r in rows] == [["ls", "cat x"], []]
    assert [r.auth_result for r in rows] == ["fail", "fail"]
    assert rows[0].session_duration == 120.0


def test_missing_log_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        access.scan_log(spark, str(tmp_path / "nothing")).count()


def test_text_ids_run_through_detection(spark, sf):
    """Logs name sessions and entities by text; nothing may rely on numbers."""
    numbered = access.access_events(spark, sf)
    named = numbered.withColumns(
        {
            "session_id": F.format_string("s%08d", "session_id"),
            "entity_id": F.format_string("u%08d", "entity_id"),
        }
    )
    pick = ["predicted_type", "risk_score", "explanation_text"]
    want = detect(numbered, R.ACCESS, learn=False)
    got = detect(named, R.ACCESS, learn=False)
    as_named = lambda df: df.select(F.format_string("s%08d", "session_id").alias("session_id"), *pick[:2])
    assert sorted(as_named(want.scored).collect()) == sorted(got.scored.select("session_id", *pick[:2]).collect())
    assert got.alerts.count() == want.alerts.count() > 0
    assert E.metrics_summary(got.scored, got.alerts).count() > 10


def test_model_round_trip(spark, sf):
    model, sequences = R.access_model(spark, sf)
    forest = R.classifier(spark, sf)
    path = new_path(spark, "model")
    sinks.save_model(sinks.StoredModel(model, sequences, forest), path)
    loaded = sinks.load_model(spark, path)
    assert loaded.classifier.importances == forest.importances
    test = R.access_test(spark, sf)
    rows = lambda m, q: sorted(map(str, score_events(test, m, q, R.ACCESS).select("session_id", "risk_score").collect()))
    assert rows(loaded.profiles, loaded.sequences) == rows(model, sequences)


def test_incidents_are_added_to_the_store(spark, sf):
    d = R.detection(spark, sf)
    path = new_path(spark, "store")
    sinks.write_events(d.alerts, path)
    one = d.alerts.limit(1).withColumns({"session_id": F.lit(-1).cast("long"), "auth_result": F.lit("failure")})
    sinks.append_incidents(path, one)
    stored = spark.read.parquet(path)
    assert stored.count() == d.alerts.count() + 1
    assert stored.filter("session_id = -1").first().auth_result == "fail"


def test_export_has_a_header_and_quoted_features(spark, sf):
    d = R.detection(spark, sf)
    path = new_path(spark, "csv")
    flat = A.export_alerts(d.alerts.select(*A.ALERT_COLUMNS), d.scored, A.AlertFilter(top_pct=50.0))
    sinks.write_csv(flat, path)
    back = spark.read.options(header=True, quote='"', escape='"').csv(path)
    assert back.columns == A.ALERT_COLUMNS
    assert back.count() == flat.count() > 0


def test_plain_batch_features(spark, sf):
    """Without travel speed, footprint and breadth the inert features are constant."""
    model, sequences = R.access_model(spark, sf)
    scored = score_events(R.access_test(spark, sf), model, sequences, PLAIN_BATCH)
    row = scored.agg(
        F.max("geo_velocity_kmh").alias("v"), F.max("privilege_footprint_growth_30d").alias("g"),
        F.max("resource_breadth_new_1hr").alias("b"),
    ).first()
    assert tuple(row) == (0.0, 0.0, 1.0)


def test_scores_stay_within_bounds(spark, sf):
    d = R.detection(spark, sf)
    names = ["risk_score", "baseline_score", "sequence_score", "hour_zscore", "geo_novelty", "resource_novelty",
             "duration_zscore", "auth_method_novelty", "device_novelty", "markov_score", "low_slow_score"]
    outside = F.lit(False)
    for name in names:
        outside = outside | ~F.col(name).between(0.0, 1.0) | F.col(name).isNull()
    assert d.scored.filter(outside).count() == 0
    assert P.cold_start_census(d.profiles.entities).first().n_cold >= 0


def test_export_of_a_model_is_that_of_its_events(spark, sf):
    model, _ = R.access_model(spark, sf)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(P.export_model(model)) == rows(P.profile_export(R.access_normal(spark, sf)))


def test_storing_a_table_leaves_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {f.rsplit("/", 1)[-1] for f in blocks.getAllFiles().mkString(" ").split()}
    before = names()
    stored = materialize(spark.range(1000).withColumn("k", F.col("id") % 7).repartition(5, "k").groupBy("id").count(), "dealt")
    end = time.time() + 5
    while (left := [n for n in names() - before if n.startswith("shuffle_")]) and time.time() < end:
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(FILE_CLEANUP) == "false"  # other executions keep theirs
    assert stored.count() == 1000
