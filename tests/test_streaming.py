"""Streams over several micro-batches give what the batch operators give."""

import os
import uuid

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window, functions as F

from tidewatch.operators import features as X, profiles as P, scoring as Z, sequence as Q
from tidewatch.settings import DAY, HOUR, MINUTE, Settings
from tidewatch.sources.access import access_events, access_stream, events_as_access
from tidewatch.streaming import operators as O


@pytest.fixture(scope="module")
def pieces(tmp_path_factory, sf):
    """The event table in five files of one micro-batch each, in time order."""
    path = tmp_path_factory.mktemp("stream")
    table = pq.read_table(f"{sf}/events.parquet").sort_by("ts")
    step = -(-table.num_rows // 5)
    for i in range(5):
        name = path / f"event{i}.parquet"
        pq.write_table(table.slice(i * step, step), name)
        os.utime(name, (1_700_000_000 + i * 60,) * 2)
    return str(path)


@pytest.fixture(scope="module")
def learned(spark, sf):
    events = access_events(spark, sf)
    normal = P.label_filter(P.time_split(events, 20)[0])
    return events, P.fit_profiles(normal), Q.fit_sequences(normal)


def same(left, right, *names):
    rows = lambda df: sorted(map(tuple, df.select("session_id", *names).collect()))
    a, b = rows(left), rows(right)
    assert len(a) == len(b) > 0
    assert a == b


def test_speed(spark, pieces, learned):
    out = O.run_to_table(O.geo_velocity(access_stream(spark, pieces)), "velocity")
    same(out, X.geo_velocity(learned[0]), "geo_velocity_kmh")


def test_recent_resources(spark, pieces, learned):
    events, _, model = learned
    pick = lambda batch: O.score_recent(batch, model).select("session_id", "markov_nll")
    recent = O.recent_resources(access_stream(spark, pieces))
    out = O.run_batches(recent, "nll", pick, "session_id long, markov_nll double")
    same(out, Q.markov_window(events, model), "markov_nll")


def test_off_hours(spark, pieces, learned):
    events, _, model = learned
    out = O.run_to_table(O.low_slow_7d(access_stream(spark, pieces), model.rates), "lowslow")
    same(out, X.low_slow(events, model.rates, Settings(low_slow="trailing")), "low_slow_score")


def test_profile_score(spark, pieces, learned):
    events, model, _ = learned
    out = O.run_to_table(O.profile_score(access_stream(spark, pieces), model).select("session_id", "baseline_score"), "s")
    same(out, Z.baseline_scores(events, model, Settings(use_velocity=False)), "baseline_score")


def test_risk_over_batches(spark, pieces, learned):
    """All state in one step gives the same as the separate batch operators."""
    events, model, sequences = learned
    names = ["geo_velocity_kmh", "baseline_score", "markov_nll", "low_slow_score"]
    score = lambda batch: O.score_remembered(batch, model, sequences).select("session_id", *names)
    schema = "session_id long, " + ", ".join(f"{n} double" for n in names)
    out = O.run_batches(O.entity_memory(access_stream(spark, pieces)), "risk", score, schema)
    same(out, Z.baseline_scores(events, model), "geo_velocity_kmh", "baseline_score")
    same(out, Q.markov_window(events, sequences), "markov_nll")
    same(out, X.low_slow(events, sequences.rates, Settings(low_slow="trailing")), "low_slow_score")


def in_files(table, path, parts):
    """One micro-batch for each part, in their order."""
    for i, part in enumerate(parts):
        pq.write_table(part, path / f"event{i}.parquet")
        os.utime(path / f"event{i}.parquet", (1_700_000_000 + i * 60,) * 2)
    return str(path)


def test_late_rows_are_dropped_and_counted(spark, tmp_path, sf):
    table = pq.read_table(f"{sf}/events.parquet").sort_by("ts")
    # A watermark takes effect on the batch after the one that follows it.
    parts = [table.slice(500, 500), table.slice(300, 200), *[table.slice(10 * k, 10) for k in range(30)]]
    stream = O.failed_auth(access_stream(spark, in_files(table, tmp_path, parts)))
    O.prepare(spark)
    late = O.LateRows()
    spark.streams.addListener(late)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        query = (
            stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c"))
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        assert len(query.recentProgress) <= 2
        # The operator combines the rows of a window and entity before it looks at the watermark.
        dropped = 0
        for part in parts[2:]:
            fails = events_as_access(spark.createDataFrame(part.to_pandas())).filter("auth_result = 'fail'")
            dropped += O.failed_auth(fails).count()
        assert late.of(query) == dropped > 0
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
        spark.streams.removeListener(late)


def test_open_windows_are_added_over_several_batches(spark, pieces, learned):
    """What the last watermark leaves open comes from the state; nothing is missing or double."""
    events = learned[0]
    rows = lambda df: sorted(map(tuple, df.collect()))
    for make, still_open in ((O.failed_auth, O.failed_auth_open), (O.ip_concurrency, O.ip_concurrency_open), (O.sessions, O.sessions_open)):
        stream = make(access_stream(spark, pieces))
        whole = O.run_to_table(stream, "whole", still_open=still_open)
        assert rows(whole) == rows(make(events)) and whole.count() > O.run_to_table(stream, "part").count()
    sketched = O.run_to_table(O.ip_concurrency_sketch(access_stream(spark, pieces)), "sketch", still_open=O.ip_concurrency_sketch_open)
    counted = sketched.select("start_us", "source_ip", F.hll_sketch_estimate("entities"), "n_events")
    assert rows(counted) == rows(O.ip_concurrency(events))


def test_an_empty_source_has_no_open_windows(spark, tmp_path, sf):
    path = in_files(None, tmp_path, [pq.read_table(f"{sf}/events.parquet").slice(0, 0)])
    assert O.run_to_table(O.sessions(access_stream(spark, path)), "none", still_open=O.sessions_open).count() == 0


@pytest.mark.parametrize("width", [5 * MINUTE, 6 * HOUR])
def test_failures_are_counted_on_both_sides(spark, pieces, learned, width):
    counted = O.failed_auth_5min(access_stream(spark, pieces), width)
    early = O.run_to_table(counted, "near")
    whole = O.run_to_table(counted, "near", still_open=lambda read: O.failed_auth_5min_open(read, width))
    want = X.failed_auth_counts(learned[0], width).filter("auth_result = 'fail'")
    same(whole, want, "entity_id", "failed_auth_count_5min")
    assert 0 < early.count() < whole.count()


def test_idle_entities_are_forgotten(spark, tmp_path, sf):
    """After a pause an entity starts anew, and its state is cleared once the watermark has passed."""
    idle = 2 * DAY
    table = pq.read_table(f"{sf}/events.parquet").sort_by("ts")
    silent = pc.and_(pc.equal(table["user_id"], 3), pc.greater(table["ts"], table["ts"][400]))
    table = table.filter(pc.invert(silent))
    path = in_files(table, tmp_path, [table.slice(k * 120, 120) for k in range(-(-table.num_rows // 120))])
    events = events_as_access(spark.createDataFrame(table.to_pandas()))
    order = Window.partitionBy("entity_id").orderBy("event_us", "session_id")
    pause = (F.col("event_us") - F.lag("event_us").over(order) > idle).cast("int")
    runs = events.withColumn("run", F.sum(F.coalesce(pause, F.lit(0))).over(order))
    # The same as an entity of its own for each run between pauses.
    apart = runs.withColumn("entity_id", F.concat_ws("/", "entity_id", "run")).drop("run")
    assert runs.agg(F.max("run")).first()[0] > 0
    O.prepare(spark)

    def run(stream):
        out, check = str(tmp_path / uuid.uuid4().hex), str(tmp_path / uuid.uuid4().hex)
        query = stream.writeStream.format("parquet").options(path=out, checkpointLocation=check).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out), check

    got, check = run(O.geo_velocity(access_stream(spark, path), idle=idle))
    same(got, X.geo_velocity(apart), "geo_velocity_kmh")
    left = {r[0] for r in spark.read.format("statestore").option("stateVarName", "last").load(check).select("key.entity_id").collect()}
    assert left and 3 not in left
    got, check = run(O.recent_resources(access_stream(spark, path), idle=idle))
    walked = Window.partitionBy("entity_id").orderBy("event_us", "session_id").rowsBetween(-9, 0)
    same(got, apart.withColumn("recent", F.collect_list("resource_accessed").over(walked)), "recent")
    with pytest.raises(ValueError):
        O.low_slow_7d(access_stream(spark, path), None, idle=idle)


def test_seven_idle_days_change_no_off_hours_count(spark, pieces, learned):
    events, _, model = learned
    out = O.run_to_table(O.low_slow_7d(access_stream(spark, pieces), model.rates, idle=7 * DAY), "lowslow")
    same(out, X.low_slow(events, model.rates, Settings(low_slow="trailing")), "low_slow_score")


def test_rows_out_of_order_across_batches(spark, tmp_path, sf):
    """A row older than the remembered one has speed 0 and is remembered all the same."""
    table = pq.read_table(f"{sf}/events.parquet").sort_by("ts")
    user = table.filter(__import__("pyarrow.compute").compute.equal(table["user_id"], table["user_id"][0]))
    for i, row in enumerate((5, 2, 6)):
        pq.write_table(user.slice(row, 1), tmp_path / f"event{i}.parquet")
        os.utime(tmp_path / f"event{i}.parquet", (1_700_000_000 + i * 60,) * 2)
    out = O.run_to_table(O.geo_velocity(access_stream(spark, str(tmp_path))), "late")
    ids = user["event_id"].to_pylist()
    got = {r.session_id: r.geo_velocity_kmh for r in out.collect()}
    assert set(got) == {ids[5], ids[2], ids[6]} and got[ids[2]] == 0.0
    pair = events_as_access(spark.read.parquet(f"{sf}/events.parquet")).filter(F.col("session_id").isin(ids[2], ids[6]))
    want = {r.session_id: r.geo_velocity_kmh for r in X.geo_velocity(pair).collect()}
    assert got[ids[6]] == want[ids[6]]


def test_failures_without_an_entity_stay_apart(spark, tmp_path, sf):
    """Rows without an entity are one entity of their own and take no failures from the others."""
    table = pq.read_table(f"{sf}/events.parquet").sort_by("ts")
    users = [None if k % 9 == 0 else u for k, u in enumerate(table["user_id"].to_pylist())]
    table = table.set_column(table.schema.get_field_index("user_id"), "user_id", pa.array(users, pa.int64()))
    path = in_files(table, tmp_path, [table.slice(k * 400, 400) for k in range(-(-table.num_rows // 400))])
    width = 6 * HOUR
    got = O.run_to_table(O.failed_auth_5min(access_stream(spark, path), width), "near", still_open=lambda read: O.failed_auth_5min_open(read, width))
    events = events_as_access(spark.read.parquet(f"{path}/event*.parquet"))
    rows = lambda df: sorted(map(str, df.select("session_id", "entity_id", F.col("failed_auth_count_5min").cast("long")).collect()))
    assert rows(got) == rows(X.failed_auth_counts(events, width).filter("auth_result = 'fail'"))
