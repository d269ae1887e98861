"""The registered streaming queries; each runs over the whole event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import features as X, profiles as P
from tidewatch.plans import runs as R
from tidewatch.plans.oracle import HOUR, MINUTE, OFF, clip, r
from tidewatch.plans.registry import query
from tidewatch.sources.access import access_events, access_stream
from tidewatch.streaming import operators as O

col = F.col

_WIDE = f"us//{24 * HOUR}*{24 * HOUR} AS start_us"
_SLIDING = f"unnest([us//{5 * MINUTE}*{5 * MINUTE}, us//{5 * MINUTE}*{5 * MINUTE}-{5 * MINUTE}]) AS start_us"


@query("stream_geo_velocity", f"SELECT session_id, {r('kmh', 2)} AS geo_velocity_kmh FROM all_moved")
def stream_geo_velocity(spark, sf):
    out = O.run_to_table(O.geo_velocity(access_stream(spark, sf)), "velocity")
    return out.select("session_id", "geo_velocity_kmh")


@query("stream_geo_velocity_idle", f"""SELECT session_id, CASE WHEN gap>{7 * 24 * HOUR} THEN 0.0::DOUBLE ELSE {r('kmh', 2)} END AS geo_velocity_kmh
 FROM all_moved JOIN (SELECT session_id, us-lag(us) OVER (PARTITION BY entity_id ORDER BY us, session_id) AS gap FROM access) USING (session_id)""")
def stream_geo_velocity_idle(spark, sf):
    """The same with entities forgotten after seven days without an event."""
    out = O.run_to_table(O.geo_velocity(access_stream(spark, sf), idle=7 * 24 * HOUR), "velocity")
    return out.select("session_id", "geo_velocity_kmh")


@query("stream_markov_nll", f"SELECT session_id, {r('nll')} AS markov_nll, {r('least(nll/15.0,1.0::DOUBLE)')} AS markov_score FROM all_window_nll")
def stream_markov_nll(spark, sf):
    _, sequences = R.access_model(spark, sf)
    recent = O.recent_resources(access_stream(spark, sf))
    score = lambda batch: O.score_recent(batch, sequences).select("session_id", "markov_nll", "markov_score")
    out = O.run_batches(recent, "nll", score, "session_id bigint, markov_nll double, markov_score double")
    return out.select("session_id", "markov_nll", "markov_score")


@query("stream_lowslow_7d", f"SELECT session_id, CASE WHEN {OFF} THEN cnt ELSE 0 END::BIGINT AS off_hours_n, {r('ls')} AS low_slow_score FROM access JOIN all_ls_7d USING (session_id)")
def stream_lowslow_7d(spark, sf):
    _, sequences = R.access_model(spark, sf)
    out = O.run_to_table(O.low_slow_7d(access_stream(spark, sf), sequences.rates), "lowslow")
    return out.select("session_id", "off_hours_n", "low_slow_score")


@query("stream_lowslow_7d_idle", f"SELECT session_id, CASE WHEN {OFF} THEN cnt ELSE 0 END::BIGINT AS off_hours_n, {r('ls')} AS low_slow_score FROM access JOIN all_ls_7d USING (session_id)")
def stream_lowslow_7d_idle(spark, sf):
    """The same rows with state that is cleared after seven days without an event."""
    _, sequences = R.access_model(spark, sf)
    out = O.run_to_table(O.low_slow_7d(access_stream(spark, sf), sequences.rates, idle=7 * 24 * HOUR), "lowslow")
    return out.select("session_id", "off_hours_n", "low_slow_score")


@query("stream_failed_auth", f"""SELECT start_us, entity_id, count(*)::BIGINT AS n_fails FROM (SELECT entity_id, {_SLIDING} FROM access WHERE result='fail') GROUP BY ALL""")
def stream_failed_auth(spark, sf):
    return O.run_to_table(O.failed_auth(access_stream(spark, sf)), "fails", still_open=O.failed_auth_open)


@query("stream_failed_auth_5min", "SELECT session_id, entity_id, fails AS failed_auth_count FROM access JOIN all_fail USING (session_id) WHERE result='fail'")
def stream_failed_auth_5min(spark, sf):
    """The centred count of each failure, emitted by event-time timers."""
    width = R.ACCESS.fail_window
    counted = O.failed_auth_5min(access_stream(spark, sf), width)
    out = O.run_to_table(counted, "near", still_open=lambda state: O.failed_auth_5min_open(state, width))
    return out.select("session_id", "entity_id", col("failed_auth_count_5min").alias("failed_auth_count"))


@query("stream_ip_concurrency", f"""SELECT start_us, source_ip, count(DISTINCT entity_id)::BIGINT AS n_entities, count(*)::BIGINT AS n_events
 FROM (SELECT ip AS source_ip, entity_id, {_SLIDING} FROM access) GROUP BY ALL""")
def stream_ip_concurrency(spark, sf):
    return O.run_to_table(O.ip_concurrency(access_stream(spark, sf)), "accounts", still_open=O.ip_concurrency_open)


@query("stream_ip_concurrency_sketch", f"""SELECT start_us, source_ip, count(*)::BIGINT AS n_events, true AS within_error
 FROM (SELECT ip AS source_ip, {_WIDE} FROM access) GROUP BY ALL""")
def stream_ip_concurrency_sketch(spark, sf):
    """Distinct entities per address and day from sketches, against the exact number."""
    day = "1 day"
    out = O.run_to_table(O.ip_concurrency_sketch(access_stream(spark, sf), day, day), "sketches", still_open=O.ip_concurrency_sketch_open)
    start = F.unix_micros(F.window("event_time", day, day)["start"])
    exact = access_events(spark, sf).groupBy(start.alias("start_us"), "source_ip").agg(F.count_distinct("entity_id").alias("n"))
    estimate = F.hll_sketch_estimate("entities")
    return out.join(exact, ["start_us", "source_ip"]).select(
        "start_us", "source_ip", "n_events", (F.abs(estimate - col("n")) <= P.SKETCH_ERROR * col("n")).alias("within_error")
    )


_STILL = "0.0::DOUBLE+0.15::DOUBLE*hz+0.25::DOUBLE*(damp*gn0)+0.15::DOUBLE*(damp*rn0)+0.10::DOUBLE*dz+0.15::DOUBLE*an+0.20::DOUBLE*(damp*dn0)"


@query("stream_profile_score", f"SELECT session_id, baseline_score FROM (SELECT session_id, {r(clip(_STILL))} AS baseline_score FROM a_parts) WHERE baseline_score>0.18::DOUBLE")
def stream_profile_score(spark, sf):
    """Score the days after training and keep what is above the alert threshold."""
    model, _ = R.access_model(spark, sf)
    start = access_events(spark, sf).agg(F.min("event_us")).first()[0] + R.ACCESS.train_days * 24 * HOUR
    scored = O.profile_score(access_stream(spark, sf).filter(col("event_us") >= start), model, R.ACCESS)
    pick = lambda batch: O.alerts_of(batch).select("session_id", "baseline_score")
    out = O.run_batches(scored, "scores", pick, "session_id bigint, baseline_score double")
    return out.select("session_id", "baseline_score")


@query("stream_sessions", f"""SELECT min(us) AS start_us, entity_id, count(*)::BIGINT AS n_events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY entity_id ORDER BY us, session_id) AS run FROM (
    SELECT *, CASE WHEN us-lag(us) OVER (PARTITION BY entity_id ORDER BY us, session_id)<{6 * HOUR} THEN 0 ELSE 1 END AS fresh FROM access))
 GROUP BY entity_id, run""")
def stream_sessions(spark, sf):
    return O.run_to_table(O.sessions(access_stream(spark, sf)), "sessions", still_open=O.sessions_open)


_ONLINE = "0.7::DOUBLE*least(nll/15.0,1.0::DOUBLE)+0.3::DOUBLE*ls"


@query("stream_risk_score", f"""SELECT session_id, geo_velocity_kmh, baseline_score, sequence_score, {r(clip("0.55::DOUBLE*baseline_score+0.45::DOUBLE*sequence_score"))} AS risk_score
 FROM (SELECT session_id, geo_velocity_kmh, baseline_score, {r(_ONLINE)} AS sequence_score FROM a_base JOIN a_window_nll USING (session_id) JOIN a_ls_7d USING (session_id))""")
def stream_risk_score(spark, sf):
    """Score every event of the days after training as it comes, from state and profiles."""
    model, sequences = R.access_model(spark, sf)
    start = access_events(spark, sf).agg(F.min("event_us")).first()[0] + R.ACCESS.train_days * 24 * HOUR
    names = ["session_id", "geo_velocity_kmh", "baseline_score", "sequence_score", "risk_score"]
    score = lambda batch: O.score_remembered(batch, model, sequences, R.ACCESS).select(*names)
    remembered = O.entity_memory(access_stream(spark, sf).filter(col("event_us") >= start))
    schema = "session_id bigint, " + ", ".join(f"{n} double" for n in names[1:])
    return O.run_batches(remembered, "risk", score, schema).select(*names)
