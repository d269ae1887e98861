"""Operators on hand-written events, with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from events import by_id, events, us
from tidewatch import constants as C
from tidewatch.functions import geo, scalars as S
from tidewatch.operators import alerts as A, classify as K, evaluate as E, explain, features as X
from tidewatch.operators import histogram as H, profiles as P, scoring as Z, sequence as Q
from tidewatch.settings import DAY, HOUR, MINUTE, PLAIN_BATCH, Settings

T0 = us("2024-01-01T10:00:00")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


# --- scalars -------------------------------------------------------------------


@pytest.mark.parametrize("v", [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.949, 0.95, 1.25, 7.05, 12.3456, 99.95, 87.3499])
def test_one_decimal_rounds_the_binary_value(spark, v):
    assert value(spark, S.one_decimal(F.lit(v))) == f"{v:.1f}"


@pytest.mark.parametrize("v", [0.5, 1.5, 2.5, 1000.5, 1001.5, 999.49])
def test_whole_number(spark, v):
    assert value(spark, S.whole_number(F.lit(v))) == f"{v:.0f}"


def test_rounding_is_that_of_numpy(spark):
    import numpy as np

    values = [0.12345, 0.00015, 0.33335, 0.99995, 0.5, 1 / 3, 0.00005]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(S.round4(F.col("v"))).collect()]
    assert got == np.round(values, 4).tolist()


def test_ip_prefix_needs_four_parts(spark):
    assert value(spark, S.ip_prefix(F.lit("10.1.2.3"))) == "10.1.2"
    assert value(spark, S.ip_prefix(F.lit("10.1.2"))) is None


def test_places(spark):
    at = lambda name: value(spark, geo.coordinates(F.lit(name)))
    assert tuple(at("Tokyo, JP")) == (35.6762, 139.6503)
    assert tuple(at("tok, XX")) == (35.6762, 139.6503)
    assert tuple(at("São Paulo, BR")) == (-23.5505, -46.6333)
    assert tuple(at("")) == (40.7128, -74.0060)
    assert at("Atlantis, XX") is None


def test_json_text(spark):
    assert value(spark, S.json_strings(F.lit('["a","b"]'))) == ["a", "b"]
    assert value(spark, S.json_strings(F.lit("nope"))) == []
    assert value(spark, F.size(S.unpack_features(F.lit('[["geo_novelty",1.5]]')))) == 1
    assert value(spark, F.size(S.unpack_features(F.lit("{")))) == 0


def test_names(spark):
    assert value(spark, S.title_case(F.lit("low_and_slow_exfil"))) == "Low And Slow Exfil"
    assert value(spark, S.title_case(F.lit(None).cast("string"))) == "Unknown"
    assert value(spark, S.feature_title(F.lit("some_other"))) == "some other"


def test_hour_distance_wraps_around_midnight(spark):
    z = Z.hour_zscore(F.lit(23), F.lit(1.0), F.lit(1.0))
    assert value(spark, z) == pytest.approx(2 / 4)


# --- profiles ------------------------------------------------------------------


def history(n, **changes):
    return [(T0 + i * HOUR, changes) for i in range(n)]


def test_profile_of_a_single_event(spark):
    row = P.entity_numeric(events(spark, (T0, {"session_duration": 50.0}))).first()
    assert (row.hour_mean, row.hour_std) == (10.0, 6.0)
    assert (row.session_duration_mean, row.session_duration_std) == (50.0, 15.0)


def test_spreads(spark):
    df = events(spark, *[(T0 + i * HOUR, {"session_duration": d}) for i, d in enumerate([10.0, 20.0, 60.0])])
    row = P.entity_numeric(df).first()
    assert row.hour_std == 1.0  # population spread 0.816, at least one
    assert row.session_duration_std == pytest.approx(math.sqrt((400 + 100 + 900) / 2))


def test_entity_with_two_types_has_one_profile(spark):
    df = events(spark, (T0, {}), (T0 + 1, {"entity_type": "edge_device"}), (T0 + 2, {"session_duration": 400.0}))
    row = P.entity_numeric(df).collect()
    assert [r.entity_type for r in row] == ["user"]
    assert row[0].session_duration_mean == pytest.approx(200.0)
    assert row[0].session_duration_std == pytest.approx(math.sqrt(30000.0))


def test_primary_method_of_equals_is_the_first_seen(spark):
    df = events(spark, (T0, {"auth_method": "token"}), (T0 + 1, {"auth_method": "biometric"}))
    values = P.values_by(P.profile_values(df), "entity_id")
    assert P.primary_auth(values, "entity_id").first().primary_auth_method == "token"


def fit(spark, *rows):
    return P.fit_profiles(events(spark, *rows))


def test_cold_and_unknown_entities(spark):
    model = fit(spark, *history(6), *[(T0, {"entity_id": "u2", "geo_location": "Paris, FR"})])
    new = {"device_fingerprint": "other", "geo_location": "Tokyo, JP"}
    test = events(
        spark,
        (T0 + DAY, new),
        (T0 + DAY, {"entity_id": "u2", **new}),
        (T0 + DAY, {"entity_id": "u3", "geo_location": "Paris, FR"}),
        (T0 + DAY, {"entity_id": "r1", "entity_type": "robot", **new}),
    )
    scored = Z.baseline_scores(test, model, Settings(use_velocity=False))
    got = by_id(scored, "profile_source", "is_cold_start", "geo_novelty", "device_novelty")
    assert got == [
        ("entity", False, 1.0, 1.0),
        ("type", True, 0.5, 0.5),
        ("type", True, 0.0, 0.0),
        (None, True, 0.0, 0.0),
    ]
    assert by_id(scored, "baseline_score")[3] == 0.3


def test_thin_entity_of_unknown_type_uses_its_own_profile(spark):
    model = fit(spark, *history(2))
    test = events(spark, (T0 + DAY, {"entity_type": "robot"}))
    row = P.profile_lookup(test, model).first()
    assert (row.profile_source, row.is_cold_start) == ("entity", True)


# --- context -------------------------------------------------------------------


def test_speed(spark):
    there = {"geo_location": "Paris, FR"}
    df = events(spark, (T0, {}), (T0 + HOUR, there), (T0 + HOUR, {}), (T0 + 2 * HOUR, {"geo_location": "Nowhere"}))
    speeds = by_id(X.geo_velocity(df), "geo_velocity_kmh")
    assert speeds[0] == 0.0 and speeds[2] == 0.0 and speeds[3] == 0.0
    assert speeds[1] == pytest.approx(343.6, abs=1.0)


def test_impossible_travel_raises_the_geo_score(spark):
    model = fit(spark, *history(6), *history(6, geo_location="Tokyo, JP"))
    test = events(spark, (T0 + DAY, {}), (T0 + DAY + HOUR, {"geo_location": "Tokyo, JP"}))
    assert by_id(Z.baseline_scores(test, model), "geo_novelty") == [0.0, 0.9]
    assert by_id(Z.baseline_scores(test, model, PLAIN_BATCH), "geo_novelty") == [0.0, 0.0]


def test_failures_five_minutes_apart_count(spark):
    bad = {"auth_result": "fail"}
    df = events(spark, (T0, bad), (T0 + 5 * MINUTE, bad), (T0 + 10 * MINUTE + 1, bad), (T0 + MINUTE, {}))
    assert by_id(X.failed_auth_counts(df, 5 * MINUTE), "failed_auth_count_5min") == [2, 2, 1, 0]


def test_accounts_per_address(spark):
    who = lambda e, ip="10.0.0.1": {"entity_id": e, "source_ip": ip}
    df = events(
        spark, (T0, who("a")), (T0 + 5 * MINUTE, who("b")), (T0 + 5 * MINUTE, who("b")),
        (T0 + 10 * MINUTE, who("c")), (T0 + 10 * MINUTE + 1, who("a")),
        (T0, who("a", "10.0.0.2")), (T0, who("b", "10.0.0.2")),
    )
    got = by_id(X.ip_concurrency(df, 5 * MINUTE), "distinct_entities_from_ip_5min")
    assert got == [2, 3, 3, 3, 2, 0, 0]


def test_new_resources(spark):
    use = lambda r: {"resource_accessed": r}
    df = events(spark, (T0, use("a")), (T0 + HOUR, use("b")), (T0 + HOUR, use("a")), (T0 + 3 * HOUR, use("b")))
    assert by_id(X.resource_breadth(df, HOUR), "resource_breadth_new_1hr") == [1, 2, 2, 0]
    assert by_id(X.first_seen_resource(df), "first_seen_resource") == [1, 1, 0, 0]


def test_footprint_growth(spark):
    use = lambda r: {"resource_accessed": r}
    df = events(spark, (T0, use("a")), (T0 + 7 * DAY, use("b")), (T0 + 7 * DAY + 1, use("c")), (T0 + 9 * DAY, use("a")))
    assert X.privilege_growth(df).first().privilege_footprint_growth_30d == 0.5


def test_off_hours_trend(spark):
    night = us("2024-01-01T23:00:00")
    rows = [(night + i * MINUTE, {}) for i in range(5)] + [(night + 7 * DAY + 4 * MINUTE, {})]
    df = events(spark, *rows)
    rates = spark.createDataFrame([("u1", 0.001)], "entity_id string, off_hours_rate double")
    whole = by_id(X.low_slow(df, rates), "low_slow_score")
    assert whole == [0.0, 0.3333, 0.6667, 1.0, 1.0, 1.0]
    last = by_id(X.low_slow(df, rates, Settings(low_slow="trailing")), "off_hours_n")
    assert last == [1, 2, 3, 4, 5, 2]  # the event exactly seven days ago still counts


# --- sequences -----------------------------------------------------------------


def test_runs_of_ten(spark):
    df = events(spark, *[(T0 + i, {"resource_accessed": f"r{i}"}) for i in range(11)])
    pairs = {(r.prev, r.cur): (r.c, r.c_start) for r in Q.transitions(df).collect()}
    assert len(pairs) == 9 and pairs[("r0", "r1")] == (1, 1) and ("r9", "r10") not in pairs
    assert Q.session_chunks(df).count() == 10
    state = {r.resource for r in Q.states(Q.transitions(df)).collect()}
    assert "r10" not in state


def test_transition_costs(spark):
    train = events(spark, *[(T0 + i, {"resource_accessed": r}) for i, r in enumerate("abab")])
    model = Q.fit_sequences(train)
    test = events(spark, *[(T0 + i, {"resource_accessed": r}) for i, r in enumerate("abbzz")])
    v, alpha = 2, C.LAPLACE_ALPHA
    seen = -math.log((2 + alpha) / (2 + alpha * v))
    unseen = -math.log(alpha / (1 + alpha * v))
    outside = math.log(v)
    want = [0.0, seen, unseen, outside, outside]
    assert by_id(Q.markov_last_transition(test, model), "markov_nll") == [pytest.approx(x, abs=1e-4) for x in want]


def test_last_ten_resources(spark):
    train = events(spark, *[(T0 + i, {"resource_accessed": r}) for i, r in enumerate("abcabcabcaabc")])
    model = Q.fit_sequences(train)
    path = "abcabcaabbccabzab"
    test = events(spark, *[(T0 + i, {"resource_accessed": r}) for i, r in enumerate(path)])
    windowed = by_id(Q.markov_window(test, model), "markov_nll")
    arrays = spark.createDataFrame(
        [(i, "user", list(path[max(0, i - 9) : i + 1])) for i in range(len(path))],
        "session_id long, entity_type string, recent array<string>",
    )
    assert by_id(Q.arrays_nll(arrays, model), "markov_nll") == windowed
    assert windowed[0] == 0.0


def test_type_without_a_model_costs_nothing(spark):
    model = Q.fit_sequences(events(spark, *history(4)))
    robots = events(spark, *history(3, entity_type="robot"))
    assert by_id(Q.markov_last_transition(robots, model), "markov_nll") == [0.0] * 3
    assert by_id(Q.markov_window(robots, model), "markov_nll") == [0.0] * 3


# --- classification ------------------------------------------------------------


def scored_rows(spark, *rows):
    base = {f: 0.0 for f in C.MODEL_FEATURES}
    extra = {"session_id": 0, "entity_id": "u1", "source_ip": "10.0.0.9", "geo_location": "Paris, FR", "device_fingerprint": "x" * 40}
    data = [{**base, **extra, "baseline_score": 0.5, **r, "session_id": i} for i, r in enumerate(rows)]
    kinds = ", ".join(f"{f} double" for f in C.MODEL_FEATURES)
    names = [*C.MODEL_FEATURES, *extra]
    schema = f"{kinds}, session_id long, entity_id string, source_ip string, geo_location string, device_fingerprint string"
    return spark.createDataFrame([tuple(d[n] for n in names) for d in data], schema)


def test_rules(spark):
    both = {"failed_auth_count_5min": 4.0, "geo_velocity_kmh": 1500.5}
    df = scored_rows(
        spark, both, {"failed_auth_count_5min": 4.0, "distinct_entities_from_ip_5min": 3.0},
        {"distinct_entities_from_ip_5min": 3.0, "fingerprint_mismatch": 1.0},
        {"fingerprint_mismatch": 1.0}, {"fingerprint_mismatch": 0.5},
        {"baseline_score": 0.25, "failed_auth_count_5min": 9.0},
    )
    done = explain.explanations(K.classify(df))
    got = by_id(done, "predicted_type")
    assert got == [
        "impossible_travel", "brute_force", "credential_stuffing", "device_spoofing", "normal", "normal",
    ]
    texts = by_id(done, "explanation_text")
    assert texts[0] == "Implied travel speed of 1500 km/h to reach Paris, FR (impossible travel pattern)"
    assert texts[1] == "4 failed authentication attempts from 10.0.0.9 in a 5-minute window (brute force pattern)"
    assert texts[2] == "3 different user accounts accessed from 10.0.0.9 in 5 minutes (credential stuffing pattern)"
    assert texts[3] == f"Device fingerprint '{'x' * 30}...' does not match known devices for u1 (device spoofing)"
    assert texts[4:] == ["", ""]


def test_contributions_keep_feature_order_among_equals(spark):
    df = scored_rows(spark, {"baseline_score": 0.4, "geo_novelty": 0.4, "hour_zscore": -0.4, "device_novelty": 0.01})
    top = df.select(K.top_features({}).alias("t")).first().t
    assert [f.feature for f in top] == ["baseline_score", "hour_zscore", "geo_novelty"]
    assert top[0].value == 0.02 and top[1].value == -0.02


def test_model_explanation(spark):
    df = scored_rows(spark, {"hour_zscore": 1.0, "failed_auth_count_5min": 60.0, "geo_velocity_kmh": 50.0})
    done = df.withColumn("predicted_type", F.lit("lateral_movement")).withColumn("top_features", K.top_features({}))
    assert done.select(explain.model_text()).first()[0] == (
        "Flagged due to 3 failed authentication attempts in 5-min window"
        " + implied travel speed between logins (2 km/h) + unusual login time (z=0.1)"
        ". Unusual breadth of resource access suggesting lateral movement"
    )


def test_forest(spark):
    rows = []
    for i in range(40):
        kind = C.ATTACK_LABELS[i % 2]
        rows.append({"failed_auth_count_5min": float(5 if i % 2 == 0 else 0), "geo_velocity_kmh": float(i % 2) * 3000})
        rows[-1]["label"] = kind
    frame = scored_rows(spark, *[{k: v for k, v in r.items() if k != "label"} for r in rows])
    labels = spark.createDataFrame([(i, r["label"]) for i, r in enumerate(rows)], "session_id long, label string")
    train = frame.join(labels, "session_id")
    assert K.fit_classifier(train.limit(9)) is None
    forest = K.fit_classifier(train)
    assert K.rf_predict(train, forest).filter("ml_type = label").count() == 40
    assert sum(forest.importances.values()) == pytest.approx(1.0)


# --- drift ---------------------------------------------------------------------


@pytest.mark.parametrize(
    "n, changes, drifts",
    [
        (2, {"geo_location": "Tokyo, JP"}, False),
        (3, {}, False),
        (3, {"geo_location": "Tokyo, JP"}, True),
        (3, {"auth_method": "token"}, True),
        (3, {"resource_accessed": "other"}, True),
        (3, {"geo_location": "Tokyo, JP", "label": "brute_force"}, False),
    ],
)
def test_drift(spark, n, changes, drifts):
    model = fit(spark, *history(6))
    recent = [(T0 + 30 * DAY + i * HOUR, changes) for i in range(n)]
    flags = P.drift_flags(events(spark, *history(6), *recent), model, F.lit(T0 + 40 * DAY))
    assert flags.first().is_drift_flagged is drifts


# --- rankings ------------------------------------------------------------------


def ranking(spark, *rows):
    return spark.createDataFrame([(i, s, "normal" if n else "brute_force") for i, (s, n) in enumerate(rows)],
                                 "session_id long, risk_score double, label string")


def brute_force_top(rows, share):
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    k = max(1, int(len(rows) * share))
    hits = sum(r[2] != "normal" for r in ordered[:k])
    return k, round(hits / k, 4), round(hits / max(1, sum(r[2] != "normal" for r in rows)), 4)


@pytest.mark.parametrize("text_ids", [False, True])
def test_budget_with_ties(spark, text_ids, monkeypatch):
    import random

    rng = random.Random(5)
    rows = [(rng.randrange(10**6), rng.choice([0.1, 0.5, 0.5, 0.5, 0.9]), rng.choice(["normal", "x"])) for _ in range(3000)]
    rows = list({r[0]: r for r in rows}.values())
    rows += [(2**60 + k, 0.5, "x") for k in range(40)] + [(2**45 - k, 0.5, "normal") for k in range(40)]
    monkeypatch.setattr(H, "TIE_ROWS", 50)
    df = spark.createDataFrame(rows, "session_id long, risk_score double, label string")
    if text_ids:
        df = df.withColumn("session_id", F.col("session_id").cast("string"))
    shares = [0.0001, 0.05, 0.3, 0.5, 0.97]
    got = {r.budget: tuple(r)[1:] for r in H.precision_at_budget(df, shares).collect()}
    assert len(got) == len(shares)
    if text_ids:
        rows = [(str(r[0]), *r[1:]) for r in rows]
    for share in shares:
        assert got[share] == pytest.approx(brute_force_top(rows, share), abs=1e-4)


def test_threshold_keeps_ties(spark):
    df = ranking(spark, (0.9, 0), (0.5, 0), (0.5, 1), (0.5, 1), (0.1, 1))
    assert tuple(H.top_pct_threshold(df, 40.0).first()) == (0.5, 2)
    kept = A.alert_filter(df.withColumn("predicted_type", F.lit("x")), A.AlertFilter(top_pct=40.0), df)
    assert kept.count() == 4


def test_pr_auc_does_not_depend_on_row_order(spark):
    rows = [(0.9, 0), (0.8, 1), (0.8, 0), (0.3, 1), (0.2, 0)]
    # thresholds .9, .8, .3, .2: precision 1, 2/3, 1/2, 3/5; recall 1/3, 2/3, 2/3, 1
    want = (1 / 3) * 1 + (1 / 3) * (1 + 2 / 3) / 2 + 0 + (1 / 3) * (1 / 2 + 3 / 5) / 2
    for order in (rows, rows[::-1]):
        assert H.pr_auc(ranking(spark, *order)).first().pr_auc == pytest.approx(want)


def test_slices_without_alarms(spark):
    df = ranking(spark, (0.1, 0), (0.1, 1)).withColumn("is_cold_start", F.lit(True))
    got = sorted(tuple(r) for r in E.cold_warm_slice(df).collect())
    assert got == [(False, 0, 0.0, 0.0), (True, 2, 0.0, 0.0)]


def test_search_is_a_pattern_for_alerts_and_text_for_entities(spark):
    df = events(spark, (T0, {}), (T0, {"entity_id": "u22", "resource_accessed": "db.main"}))
    rows = df.withColumns({"risk_score": F.lit(0.5), "predicted_type": F.lit("x")})
    assert A.alert_filter(rows, A.AlertFilter(search="U2+$")).count() == 1
    profiles = rows.select("entity_id", "entity_type")
    assert A.entity_filter(profiles, search="u2+").count() == 0
    assert A.entity_filter(profiles, search="USER").count() == 2


def test_detail_falls_back_to_scored_events(spark):
    scored = ranking(spark, (0.9, 0), (0.1, 1)).withColumn("predicted_type", F.lit("x"))
    alerts = scored.filter("risk_score > 0.5").withColumn("is_drift_flagged", F.lit(True))
    assert A.alert_detail(alerts, scored, 0).first().is_drift_flagged is True
    assert A.alert_detail(alerts, scored, 1).first().is_drift_flagged is None
    assert A.alert_detail(alerts, scored, 7).count() == 0


def test_missing_values_do_not_become_extremes(spark):
    assert value(spark, geo.haversine_km(F.lit(1.0), F.lit(2.0), F.lit(None).cast("double"), F.lit(3.0))) is None
    assert value(spark, S.clip01(F.lit(None).cast("double"))) is None
    train = events(spark, *history(3), (T0 + DAY, {"session_duration": None}))
    row = P.entity_numeric(train).first()
    assert (row.n_observed_events, row.session_duration_mean, row.session_duration_std) == (4, 100.0, 1.0)


def test_forest_without_small_splits(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = spark.range(200).select(F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("target", (F.col("a") + F.col("b") > 1).cast("double"))
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    forest = RandomForestClassifier(labelCol="target", numTrees=4, maxDepth=6, seed=3).fit(rows)
    assert K.cut_back(forest, 2) is forest
    sizes = [sum(t.numNodes for t in K.cut_back(forest, n).trees) for n in (3, 8, 40, 10**6)]
    assert sum(t.numNodes for t in forest.trees) > sizes[0] > sizes[1] > sizes[2] > sizes[3] == 4
    # Rows whose path has no small node get the same answer as before.
    deep, cut = (m.transform(rows).select("a", "prediction").collect() for m in (forest, K.cut_back(forest, 8)))
    assert sum(x.prediction == y.prediction for x, y in zip(sorted(deep), sorted(cut), strict=True)) >= 190


def test_deep_pages_keep_the_order(spark):
    rows = [(k, round((k * 7 % 10) / 10, 4)) for k in range(103)]
    table = spark.createDataFrame(rows, "session_id long, risk_score double")
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    for page in range(1, 17):
        got = [(r.session_id, r.risk_score) for r in A.alerts_page(table, table, page=page, limit=7).collect()]
        assert got == want[7 * (page - 1) : 7 * page]
