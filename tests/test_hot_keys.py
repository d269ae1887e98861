"""Hot keys: cut into slices, blocks and salts, with the same results as plain windows."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import features as X, profiles as P, scoring as Z, sequence as Q
from tidewatch.operators.timeline import find_hot_keys
from tidewatch.plans.detection import score_events
from tidewatch.settings import DAY, HOUR, MINUTE, Settings
from tidewatch.sources.access import access_events

S = Settings(train_days=20, fail_window=DAY, ip_window=30 * MINUTE)


@pytest.fixture(scope="module")
def skewed(spark, sf):
    """One entity and one address hold about half of all rows; some times are tied."""
    events = access_events(spark, sf.replace("0.001", "0.01")).filter("session_id < 3000")
    hot = F.col("session_id") % 2 == 0
    tied = F.col("session_id") % 10 < 3
    second = F.floor(F.col("event_us") / HOUR) * HOUR
    return events.withColumns(
        {
            "entity_id": F.when(hot, F.lit(1).cast("long")).otherwise(F.col("entity_id")),
            "entity_type": F.when(hot, "user").otherwise(F.col("entity_type")),
            "source_ip": F.when(F.col("session_id") % 3 == 0, "10.0.0.1").otherwise(F.col("source_ip")),
            "event_us": F.when(tied, second).otherwise(F.col("event_us")),
        }
    )


def table(df):
    names = sorted(df.columns)
    return sorted(map(str, df.select(*names).collect()))


def both(small_slices, rows, make):
    small_slices(10**9)
    plain = table(make())
    small_slices(rows)
    assert table(make()) == plain
    return plain


def test_hot_keys_are_measured(spark, skewed, small_slices):
    small_slices(200)
    hot = find_hot_keys(skewed, ["entity_id"])
    row = {r.entity_id: r for r in hot.table.collect()}[1]
    assert row.n_salts == -(-1500 // 200)
    widths = skewed.filter("entity_id = 1").groupBy(F.floor(F.col("event_us") / row.slice_us)).count()
    assert widths.agg(F.max("count")).first()[0] <= 200
    small_slices(10**9)
    assert find_hot_keys(skewed, ["entity_id"]) is None


@pytest.mark.parametrize("rows", [25, 400])
def test_entity_counts(skewed, small_slices, rows):
    hot = lambda: find_hot_keys(skewed, ["entity_id"])
    both(small_slices, rows, lambda: X.failed_auth_counts(skewed, DAY, hot()))
    both(small_slices, rows, lambda: X.resource_breadth(skewed, HOUR, hot()))
    both(small_slices, rows, lambda: X.first_seen_resource(skewed, hot()))
    both(small_slices, rows, lambda: X.geo_velocity(skewed, hot()))


@pytest.mark.parametrize("low_slow", ["cumulative", "trailing"])
def test_off_hours(skewed, small_slices, low_slow):
    rates = X.off_hours_rate(P.label_filter(skewed))
    s = S.with_(low_slow=low_slow)
    both(small_slices, 50, lambda: X.low_slow(skewed, rates, s, find_hot_keys(skewed, ["entity_id"])))


def test_addresses(skewed, small_slices):
    def make():
        hot = X.find_hot(skewed)
        return X.ip_concurrency(skewed, 30 * MINUTE, hot=hot["ip"], hot_pairs=hot["pairs"])

    both(small_slices, 60, make)


def test_sequences(skewed, small_slices):
    both(small_slices, 40, lambda: Q.transitions(skewed, find_hot_keys(skewed, ["entity_id"])))
    both(small_slices, 40, lambda: Q.session_chunks(skewed, find_hot_keys(skewed, ["entity_id"])))


def test_last_ten(skewed, small_slices):
    model = Q.fit_sequences(P.label_filter(skewed))

    def make():
        out = Q.markov_window(skewed, model, find_hot_keys(skewed, ["entity_id"]))
        return out.select("session_id", "markov_nll")

    both(small_slices, 30, make)


def test_steps(spark, skewed, small_slices):
    """Frequent steps are salted by their counts; missing resources and types are steps of their own."""
    gaps = skewed.withColumns(
        {
            "resource_accessed": F.when(F.col("session_id") % 7 > 0, F.col("resource_accessed")),
            "entity_type": F.when(F.col("session_id") % 11 > 0, F.col("entity_type")),
        }
    )
    model = Q.fit_sequences(P.label_filter(gaps))
    events = X.with_previous_resource(gaps)
    names = ["session_id", "log_trans", "log_start"]
    direct = table(Q.step_logs(events, model).select(*names))
    salted = []

    def make():
        found = Q.transition_lookup(events, model).select(*names)
        salted.append("explode(sequence" in found._jdf.queryExecution().optimizedPlan().toString())
        return found

    assert both(small_slices, 20, make) == direct
    assert salted == [False, True]
    narrow = events.select(*Q.STEP)
    assert table(Q.transition_lookup(events, model, narrow).select(*names)) == direct


def test_scores(skewed, small_slices):
    train, test = P.time_split(skewed, 6)
    normal = P.label_filter(train)
    model, sequences = P.fit_profiles(normal), Q.fit_sequences(normal)
    both(small_slices, 50, lambda: score_events(test, model, sequences, S))


def test_value_sets_above_the_limit(skewed, small_slices, monkeypatch):
    """Sets too large for the profile row are looked up in the long table."""
    train, test = P.time_split(skewed, 6)
    normal = P.label_filter(train)
    s = S.with_(use_velocity=False)
    packed = table(Z.baseline_scores(test, P.fit_profiles(normal), s))
    monkeypatch.setattr(P, "PACK_LIMIT", 1)
    model = P.fit_profiles(normal)
    assert model.large
    assert table(Z.baseline_scores(test, model, s)) == packed
    small_slices(40)
    hot = find_hot_keys(test, ["entity_id"])
    assert hot is not None and table(Z.baseline_scores(test, model, s, hot)) == packed


def test_only_busy_values_of_a_type_are_repeated(skewed, small_slices, monkeypatch):
    """A type's value table is not multiplied, whatever it holds; values that many events share are dealt."""
    train, test = P.time_split(skewed, 6)
    normal = P.label_filter(train)
    s = S.with_(use_velocity=False, cold_start_events=10**9)  # everything is looked up by type
    packed = table(Z.baseline_scores(test, P.fit_profiles(normal), s))
    monkeypatch.setattr(P, "PACK_LIMIT", 1)
    model = P.fit_profiles(normal)
    assert ("type", "device") in model.large
    small_slices(10**9)
    for frame in (None, test):
        plain = Z.baseline_scores(test, model, s, frame=frame)
        assert "_salt" not in plain._jdf.queryExecution().optimizedPlan().toString()
        assert table(plain) == packed
    small_slices(40)
    for frame in (None, test):
        dealt = Z.baseline_scores(test, model, s, frame=frame)
        assert "_salt" in dealt._jdf.queryExecution().optimizedPlan().toString()
        assert table(dealt) == packed


def test_rows_without_a_key_are_one_group(skewed, small_slices):
    """Missing addresses and entities may be as frequent as any hot key."""
    odd = F.col("session_id") % 2 == 1
    gaps = skewed.withColumns(
        {
            "source_ip": F.when(~odd, F.col("source_ip")),
            "entity_id": F.when(F.col("session_id") % 5 > 1, F.col("entity_id")),
        }
    )
    hot = lambda: find_hot_keys(gaps, ["entity_id"])
    both(small_slices, 60, lambda: X.failed_auth_counts(gaps, DAY, hot()))
    rates = X.off_hours_rate(gaps)
    both(small_slices, 60, lambda: X.low_slow(gaps, rates, S, hot()))

    def addresses():
        found = X.find_hot(gaps)
        return X.ip_concurrency(gaps, 30 * MINUTE, hot=found["ip"], hot_pairs=found["pairs"])

    both(small_slices, 60, addresses)
