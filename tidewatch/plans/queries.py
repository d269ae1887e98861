"""The registered batch queries, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch import constants as C
from tidewatch.functions import geo, scalars as S
from tidewatch.operators import alerts as A, classify as K, evaluate as E, explain, features as X
from tidewatch.operators import histogram as H, profiles as P, scoring as Z, sequence as Q
from tidewatch.operators.timeline import find_hot_keys
from tidewatch.plans import runs as R
from tidewatch.plans.detection import score_events
from tidewatch.plans.oracle import DAY, OFF, clip, r
from tidewatch.plans.registry import query
from tidewatch.session import materialize, new_path
from tidewatch.settings import HOUR, MINUTE
from tidewatch.sources import sinks
from tidewatch.sources.access import access_events, lost_events, order_events, read_table, turn_events

col, lit = F.col, F.lit


def long(name: str):
    return col(name).cast("long").alias(name)


# === scans, sinks ==============================================================


@query("scan_events", """SELECT session_id, entity_id, entity_type, us AS event_us, ip AS source_ip, geo AS geo_location,
 res AS resource_accessed, auth AS auth_method, result AS auth_result, dur AS session_duration,
 device AS device_fingerprint, label FROM access""")
def scan_events(spark, sf):
    return access_events(spark, sf).drop("event_time", "hour")


@query("write_outputs", """SELECT 'scored_events' AS name, count(*)::BIGINT AS n FROM scored
 UNION ALL SELECT 'alerts', count(*) FROM alerts UNION ALL SELECT 'test_labels', count(*) FROM scored
 UNION ALL SELECT 'entity_profiles', count(*) FROM a_num_e""")
def write_outputs(spark, sf):
    d = R.detection(spark, sf)
    profiles = P.export_model(d.profiles)
    paths = sinks.write_outputs(d.scored, d.alerts, profiles, new_path(spark, "outputs"))
    counts = [
        spark.read.parquet(path).agg(F.count(lit(1)).alias("n")).select(lit(name).alias("name"), "n")
        for name, path in paths.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


EXPORT = A.AlertFilter(top_pct=40.0, min_risk=0.2, search="err.r/[12]|10\\.3\\.")


@query("export_alerts", """SELECT session_id, entity_id, entity_type, ip AS source_ip, geo AS geo_location, res AS resource_accessed, auth AS auth_method,
 result AS auth_result, dur AS session_duration, device AS device_fingerprint, risk_score, predicted_type, confidence AS predicted_type_confidence,
 cold AS is_cold_start, coalesce(is_drift_flagged,false) AS is_drift_flagged FROM alerts LEFT JOIN (SELECT entity_id, is_drift_flagged FROM a_drift) USING (entity_id)
 WHERE risk_score>=(SELECT min(risk_score) FROM (SELECT risk_score FROM scored ORDER BY risk_score DESC
   LIMIT (SELECT greatest(1,floor(count(*)*0.4))::BIGINT FROM scored)))
 AND risk_score>=0.2::DOUBLE AND (regexp_matches(entity_id::VARCHAR,'err.r/[12]|10\\.3\\.') OR regexp_matches(ip,'err.r/[12]|10\\.3\\.')
   OR regexp_matches(res,'err.r/[12]|10\\.3\\.'))""")
def export_alerts(spark, sf):
    d = R.detection(spark, sf)
    path = new_path(spark, "alerts_csv")
    sinks.write_csv(A.export_alerts(d.alerts.select(*A.ALERT_COLUMNS), d.scored, EXPORT), path)
    kinds = ", ".join(
        f"{c} {d.alerts.schema[c].dataType.simpleString() if c != 'top_features' else 'string'}"
        for c in A.ALERT_COLUMNS
    )
    back = spark.read.schema(kinds).options(header=True, quote='"', escape='"').csv(path)
    return back.drop("timestamp", "event_time", "top_features", "explanation_text")


@query("write_metrics", "SELECT metric, key, value FROM metrics")
def write_metrics(spark, sf):
    d = R.detection(spark, sf)
    path = new_path(spark, "metrics")
    sinks.write_metrics(E.metrics_summary(d.scored, d.alerts), path)
    return sinks.read_metrics(spark, path).select("metric", F.coalesce("key", lit("")).alias("key"), "value")


@query("append_incidents", """SELECT session_id, entity_id, result AS auth_result, risk_score, predicted_type FROM alerts
 UNION ALL SELECT session_id+1000000000, entity_id, 'fail', risk_score, predicted_type FROM alerts WHERE predicted_type='brute_force'""")
def append_incidents(spark, sf):
    d = R.detection(spark, sf)
    path = new_path(spark, "alert_store")
    sinks.write_events(d.alerts, path)
    reported = d.alerts.filter(col("predicted_type") == "brute_force").withColumns(
        {"session_id": col("session_id") + 1_000_000_000, "auth_result": lit("failure")}
    )
    sinks.append_incidents(path, reported)
    return spark.read.parquet(path).select("session_id", "entity_id", "auth_result", "risk_score", "predicted_type")


@query("save_model", "SELECT 'different verdicts' AS fact, 0::BIGINT AS n UNION ALL SELECT 'verdicts', count(*) FROM scored")
def save_model(spark, sf):
    """Save and load everything learned: what was loaded classifies as what was saved."""
    model, sequences = R.access_model(spark, sf)
    path = new_path(spark, "model")
    sinks.save_model(sinks.StoredModel(model, sequences, R.classifier(spark, sf)), path)
    loaded = sinks.load_model(spark, path)
    scored = R.detection(spark, sf).scored
    verdict = ["session_id", "predicted_type", "predicted_type_confidence"]
    before = K.classify(scored, R.classifier(spark, sf)).select(*verdict)
    after = K.classify(scored, loaded.classifier).select(*verdict)
    same = before.join(after.withColumnsRenamed({c: f"new_{c}" for c in verdict[1:]}), "session_id")
    differ = ~(col("predicted_type").eqNullSafe(col("new_predicted_type")) & col("predicted_type_confidence").eqNullSafe(col("new_predicted_type_confidence")))
    counts = same.agg(F.count_if(differ).alias("d"), F.count(lit(1)).alias("n"))
    facts = F.array(F.struct(lit("different verdicts").alias("fact"), col("d").alias("n")), F.struct(lit("verdicts").alias("fact"), col("n")))
    return counts.select(F.inline(facts))


# === scalars, filters ==========================================================


@query("event_time_parts", "SELECT session_id, us AS event_us, hr::BIGINT AS hour FROM access")
def event_time_parts(spark, sf):
    return access_events(spark, sf).select("session_id", "event_us", long("hour"))


@query("ip_prefix_24", "SELECT session_id, regexp_extract(ip,'^([0-9]+\\.[0-9]+\\.[0-9]+)\\.[0-9]+$',1) AS prefix FROM access")
def ip_prefix_24(spark, sf):
    return access_events(spark, sf).select("session_id", S.ip_prefix(col("source_ip")).alias("prefix"))


@query("haversine_km", f"""SELECT session_id, {r('12742.0::DOUBLE*asin(least(1.0::DOUBLE,sqrt(sin(radians(lat-40.7128::DOUBLE)/2)**2 + cos(radians(40.7128::DOUBLE))*cos(radians(lat))*sin(radians(lon+74.006::DOUBLE)/2)**2)))', 3)} AS km FROM access""")
def haversine_km(spark, sf):
    at = geo.coordinates(col("geo_location"))
    events = access_events(spark, sf).select("session_id", at.alias("at"))
    km = geo.haversine_km(lit(40.7128), lit(-74.0060), col("at.lat"), col("at.lon"))
    return events.select("session_id", S.round_to(km, 3).alias("km"))


@query("geo_lookup", """SELECT place, (SELECT c.lat FROM city c WHERE c.id=i) AS lat, (SELECT c.lon FROM city c WHERE c.id=i) AS lon FROM (
 SELECT place, coalesce((SELECT min(c.id) FROM city c WHERE c.name=place),
   (SELECT min(c.id) FROM city c WHERE contains(lower(c.name), lower(trim(split_part(place,',',1)))))) AS i FROM (
  SELECT DISTINCT geo AS place FROM access UNION SELECT DISTINCT upper(split_part(geo,',',1))||', XX' FROM access
  UNION SELECT DISTINCT left(geo,4) FROM access UNION SELECT DISTINCT res FROM access))""")
def geo_lookup(spark, sf):
    events = access_events(spark, sf)
    place = col("geo_location")
    forms = F.array(
        place,
        F.concat(F.upper(F.split(place, ",")[0]), lit(", XX")),
        F.substring(place, 1, 4),
        col("resource_accessed"),
    )
    places = events.select(F.explode(forms).alias("place")).distinct()
    found = places.withColumn("at", geo.coordinates(col("place")))
    return found.select("place", col("at.lat").alias("lat"), col("at.lon").alias("lon"))


@query("is_off_hours", f"SELECT session_id, {OFF} AS off_hours FROM access")
def is_off_hours(spark, sf):
    return access_events(spark, sf).select("session_id", S.is_off_hours(col("hour")).alias("off_hours"))


@query("clip01_round4", f"SELECT session_id, {clip('dur/100.0-0.1')} AS clipped, {r('dur/7.0')} AS rounded FROM access")
def clip01_round4(spark, sf):
    duration = col("session_duration")
    return access_events(spark, sf).select(
        "session_id", S.clip01(duration / 100.0 - 0.1).alias("clipped"), S.round4(duration / 7.0).alias("rounded")
    )


@query("clean_nulls", """SELECT session_id, CASE WHEN session_id%10<2 THEN NULL ELSE dur END AS cleaned,
 CASE WHEN session_id%10=0 THEN 0.0 ELSE CASE WHEN session_id%10=1 THEN 1e308 ELSE dur END END AS filled FROM access""")
def clean_nulls(spark, sf):
    slot, duration = col("session_id") % 10, col("session_duration")
    broken = F.when(slot == 0, float("nan")).when(slot == 1, float("inf")).otherwise(duration)
    filled = F.when(slot == 0, float("nan")).when(slot == 1, 1e308).otherwise(duration)
    rows = access_events(spark, sf).select("session_id", broken.alias("cleaned"), filled.alias("filled"))
    return S.fill_features(rows.withColumn("cleaned", S.finite_or_null(col("cleaned"))), ["filled"])


@query("json_pack_unpack", f"""SELECT session_id, res AS feature, {r('dur/7.0')} AS value, 2::BIGINT AS n_packed, 0::BIGINT AS n_malformed FROM access""")
def json_pack_unpack(spark, sf):
    entry = F.struct(col("resource_accessed").alias("feature"), S.round4(col("session_duration") / 7.0).alias("value"))
    packed = access_events(spark, sf).withColumn("packed", S.pack_features(F.array(entry, entry)))
    back = packed.withColumn("back", S.unpack_features(col("packed")))
    broken = S.unpack_features(F.concat(lit("{"), col("resource_accessed")))
    return back.select(
        "session_id",
        col("back")[0]["feature"].alias("feature"),
        col("back")[1]["value"].alias("value"),
        F.size("back").cast("long").alias("n_packed"),
        F.size(broken).cast("long").alias("n_malformed"),
    )


@query("risk_band", """SELECT session_id, CASE WHEN risk_score>=0.8::DOUBLE THEN 'CRITICAL' WHEN risk_score>=0.4::DOUBLE THEN 'HIGH'
 WHEN risk_score>=0.25::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS band, printf('%.1f',risk_score*100) AS score100 FROM scored""")
def risk_band(spark, sf):
    risk = col("risk_score")
    return R.detection(spark, sf).scored.select(
        "session_id", S.risk_band(risk).alias("band"), S.threat_score(risk).alias("score100")
    )


def _values(entries: dict[str, str]) -> str:
    return ", ".join(f"('{k}','{v}')" for k, v in entries.items())


_NAMES = ", ".join(f"'{f}'" for f in C.MODEL_FEATURES)


@query("display_names", f"""SELECT x.label, array_to_string([upper(w[1])||w[2:] FOR w IN string_split(x.label,'_')],' ') AS title, feature, coalesce(p.v, replace(feature,'_',' ')) AS phrase,
 coalesce(t.v, replace(feature,'_',' ')) AS caption, count(*)::BIGINT AS n FROM (SELECT label, ([{_NAMES}])[(k%17)+1] AS feature FROM access) x
 LEFT JOIN (VALUES {_values(C.FEATURE_PHRASES)}) p(f,v) ON p.f=feature LEFT JOIN (VALUES {_values(C.FEATURE_TITLES)}) t(f,v) ON t.f=feature GROUP BY ALL""")
def display_names(spark, sf):
    names = F.array(*map(lit, C.MODEL_FEATURES))
    raw = read_table(spark, sf, "events").select(
        col("event_id").alias("session_id"), F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k")
    )
    counted = (
        access_events(spark, sf)
        .join(raw, "session_id")
        .groupBy("label", F.element_at(names, col("k") % 17 + 1).alias("feature"))
        .agg(F.count(lit(1)).alias("n"))
    )
    return counted.select(
        "label",
        S.title_case(col("label")).alias("title"),
        "feature",
        S.feature_phrase(col("feature")).alias("phrase"),
        S.feature_title(col("feature")).alias("caption"),
        "n",
    )


@query("label_filter", "SELECT session_id, label FROM access WHERE label='normal'")
def label_filter(spark, sf):
    return P.label_filter(access_events(spark, sf)).select("session_id", "label")


@query("time_split", "SELECT session_id, 'train' AS part FROM a_train UNION ALL SELECT session_id, 'test' FROM a_test")
def time_split(spark, sf):
    train, test = R.access_split(spark, sf)
    pick = lambda df, part: df.select("session_id", lit(part).alias("part"))
    return pick(train, "train").unionByName(pick(test, "test"))


@query("rolling_window_filter", f"""SELECT session_id FROM access WHERE us>=(SELECT max(us) FROM access)-14*{DAY} AND us<(SELECT max(us) FROM access)""")
def rolling_window_filter(spark, sf):
    events = access_events(spark, sf)
    end = events.agg(F.max("event_us")).scalar()
    return P.rolling_window(events, end, 14).select("session_id")


@query("alert_filter", """SELECT session_id, risk_score, predicted_type FROM alerts WHERE risk_score>=0.2::DOUBLE AND predicted_type='credential_stuffing'
 AND (regexp_matches(entity_id::VARCHAR,'^1|view/[01]') OR regexp_matches(ip,'^1|view/[01]') OR regexp_matches(res,'^1|view/[01]'))""")
def alert_filter(spark, sf):
    f = A.AlertFilter(min_risk=0.2, attack_type="credential_stuffing", search="^1|View/[01]")
    return A.alert_filter(R.detection(spark, sf).alerts, f).select("session_id", "risk_score", "predicted_type")


@query("entity_filter", "SELECT entity_id, entity_type FROM a_num_e WHERE entity_type='user' AND (contains(entity_id::VARCHAR,'1') OR contains(entity_type,'1'))")
def entity_filter(spark, sf):
    entities = P.entity_numeric(R.access_normal(spark, sf))
    return A.entity_filter(entities, "user", "1").select("entity_id", "entity_type")


@query("command_array", "SELECT event_id AS session_id, 2::BIGINT AS n, event_type AS first_command, 0::BIGINT AS n_malformed FROM events")
def command_array(spark, sf):
    events = read_table(spark, sf, "events")
    text = F.concat(lit('["'), col("event_type"), lit('","'), col("user_id").cast("string"), lit('"]'))
    commands = events.select(
        col("event_id").alias("session_id"),
        S.json_strings(text).alias("commands"),
        S.json_strings(F.concat(lit("["), col("props"), lit("}"))).alias("broken"),
    )
    return commands.select(
        "session_id", F.size("commands").cast("long").alias("n"), col("commands")[0].alias("first_command"),
        F.size("broken").cast("long").alias("n_malformed"),
    )


# === joins =====================================================================


@query("profile_lookup", f"""SELECT session_id, src AS profile_source, cold AS is_cold_start, pn AS n_observed_events, main AS primary_auth_method,
 {r('hour_mean', 2)} AS hour_mean, {r('dur_mean*pn', 2)} AS duration_total, {r('dur_std', 2)} AS duration_std FROM o_found""")
def profile_lookup(spark, sf):
    """On orders, where many customers are too thin for a profile of their own."""
    _, test = R.order_split(spark, sf)
    found = P.profile_lookup(test, R.order_profiles(spark, sf), R.ORDERS, find_hot_keys(test, ["entity_id"]))
    return found.select(
        "session_id", "profile_source", "is_cold_start", "n_observed_events", "primary_auth_method",
        S.round_to(col("hour_mean"), 2).alias("hour_mean"),
        S.round_to(col("session_duration_mean") * col("n_observed_events"), 2).alias("duration_total"),
        S.round_to(col("session_duration_std"), 2).alias("duration_std"),
    )


@query("membership_flags", "SELECT session_id, geo_n>0 AS geo_known, device_n>0 AS device_known, coalesce(auth=main,false) AS auth_usual FROM o_found")
def membership_flags(spark, sf):
    _, test = R.order_split(spark, sf)
    model = R.order_profiles(spark, sf)
    hot = find_hot_keys(test, ["entity_id"])
    found = P.value_counts(P.profile_lookup(test, model, R.ORDERS, hot), model, hot, test)
    return found.select(
        "session_id",
        (col("geo_n") > 0).alias("geo_known"),
        (col("device_n") > 0).alias("device_known"),
        F.coalesce(col("auth_method") == col("primary_auth_method"), lit(False)).alias("auth_usual"),
    )


@query("resource_frequency_lookup", f"SELECT session_id, resource_n::BIGINT AS resource_n, {r('resource_n/pn')} AS frequency FROM a_found")
def resource_frequency_lookup(spark, sf):
    test = R.access_test(spark, sf)
    model, _ = R.access_model(spark, sf)
    hot = find_hot_keys(test, ["entity_id"])
    found = P.value_counts(P.profile_lookup(test, model, R.ACCESS, hot), model, hot, test)
    share = S.round4(col("resource_n") / col("n_observed_events"))
    return found.select("session_id", "resource_n", share.alias("frequency"))


@query("transition_lookup", f"SELECT session_id, {r('lt', 6)} AS log_trans, {r('li', 6)} AS log_start FROM a_log")
def transition_lookup(spark, sf):
    _, sequences = R.access_model(spark, sf)
    test = R.access_test(spark, sf)
    found = Q.transition_lookup(X.with_previous_resource(test, find_hot_keys(test, ["entity_id"])), sequences)
    return found.select(
        "session_id", S.round_to(col("log_trans"), 6).alias("log_trans"), S.round_to(col("log_start"), 6).alias("log_start")
    )


@query("offhours_rate_lookup", f"SELECT session_id, {r('coalesce(rate,0.1)')} AS rate FROM a_test LEFT JOIN a_rate USING (entity_id)")
def offhours_rate_lookup(spark, sf):
    _, sequences = R.access_model(spark, sf)
    test = R.access_test(spark, sf)
    rated = X.join_by_key(test, sequences.rates, "entity_id", find_hot_keys(test, ["entity_id"]))
    rate = F.coalesce("off_hours_rate", lit(C.DEFAULT_OFF_HOURS_RATE))
    return rated.select("session_id", S.round4(rate).alias("rate"))


@query("entities_with_alert_counts", """SELECT entity_id, entity_type, n AS n_observed_events, (SELECT count(*) FROM alerts x WHERE x.entity_id=e.entity_id) AS alert_count FROM a_num_e e""")
def entities_with_alert_counts(spark, sf):
    d = R.detection(spark, sf)
    return A.entities_with_alert_counts(d.profiles.entities, d.alerts).select(
        "entity_id", "entity_type", "n_observed_events", "alert_count"
    )


@query("alert_detail", """SELECT session_id, risk_score, predicted_type FROM alerts WHERE session_id=(SELECT max(session_id) FROM alerts)
 UNION ALL SELECT session_id, risk_score, predicted_type FROM scored WHERE session_id=(SELECT max(s.session_id) FROM scored s WHERE s.session_id NOT IN (SELECT session_id FROM alerts))""")
def alert_detail(spark, sf):
    """The latest alert, and the latest event that raised none."""
    d = R.detection(spark, sf)
    quiet = d.scored.join(d.alerts, "session_id", "left_anti")
    last = [df.agg(F.max("session_id")).scalar() for df in (d.alerts, quiet)]
    rows = [A.alert_detail(d.alerts, d.scored, wanted) for wanted in last]
    return rows[0].unionByName(rows[1]).select("session_id", "risk_score", "predicted_type")


_BUSIEST = "(SELECT entity_id FROM alerts GROUP BY 1 ORDER BY count(*) DESC, entity_id LIMIT 1)"


def _busiest(alerts: DataFrame):
    counts = alerts.groupBy("entity_id").agg(F.count(lit(1)).alias("n"))
    return counts.agg(F.min_by("entity_id", F.struct(-col("n"), col("entity_id")))).scalar()


@query("entity_detail", f"""SELECT 'profile' AS part, NULL::BIGINT AS session_id, NULL::DOUBLE AS risk_score FROM a_num_e WHERE entity_id={_BUSIEST}
 UNION ALL SELECT 'recent_events', session_id, risk_score FROM (SELECT * FROM scored WHERE entity_id={_BUSIEST} ORDER BY us DESC, session_id DESC LIMIT 100)
 UNION ALL SELECT 'past_alerts', session_id, risk_score FROM alerts WHERE entity_id={_BUSIEST}""")
def entity_detail(spark, sf):
    """Everything about the entity with most alerts."""
    d = R.detection(spark, sf)
    return A.entity_record(d.profiles.entities, d.scored, d.alerts, _busiest(d.alerts))


@query("assemble_scores", """SELECT session_id, baseline_score, sequence_score, failed_auth_count_5min, distinct_entities_from_ip_5min,
 resource_breadth_new_1hr, privilege_footprint_growth_30d, risk_score FROM scored""")
def assemble_scores(spark, sf):
    return R.detection(spark, sf).scored.select(
        "session_id", "baseline_score", "sequence_score", "failed_auth_count_5min",
        "distinct_entities_from_ip_5min", "resource_breadth_new_1hr", "privilege_footprint_growth_30d", "risk_score",
    )


@query("alerts_semi_scored", "SELECT entity_id, is_drift_flagged FROM a_drift WHERE entity_id IN (SELECT entity_id FROM alerts)")
def alerts_semi_scored(spark, sf):
    d = R.detection(spark, sf)
    return A.drift_of_alerted(d.drift, d.alerts).select("entity_id", "is_drift_flagged")


@query("ip_concurrency_selfjoin", """SELECT a.session_id, count(DISTINCT b.entity_id)::BIGINT AS entities FROM access a
 JOIN access b ON a.ip=b.ip AND b.us BETWEEN a.us-300000000 AND a.us+300000000 GROUP BY a.session_id""")
def ip_concurrency_selfjoin(spark, sf):
    """The range self-join on the address, computed without forming any pairs."""
    events = access_events(spark, sf)
    hot = X.find_hot(events)
    found = X.ip_concurrency(events, 5 * MINUTE, min_events=1, hot=hot["ip"], hot_pairs=hot["pairs"])
    return found.select("session_id", col("distinct_entities_from_ip_5min").alias("entities"))


# === aggregations ==============================================================

_NUMBERS = f"""n AS n_observed_events, {r('hour_mean')} AS hour_mean, {r('hour_std')} AS hour_std, {r('dur_mean*n', 2)} AS duration_total,
 {r('dur_std')} AS duration_std, first_us, last_us"""


def _numbers(df: DataFrame, *keys: str) -> DataFrame:
    # Totals, because a mean of cents over few events often lies on a rounding edge.
    names = {"hour_mean": "hour_mean", "hour_std": "hour_std", "session_duration_std": "duration_std"}
    total = S.round_to(col("session_duration_mean") * col("n_observed_events"), 2).alias("duration_total")
    numbers = [S.round4(col(a)).alias(b) for a, b in names.items()]
    return df.select(*keys, "n_observed_events", *numbers, total, "first_us", "last_us")


@query("profile_numeric", f"SELECT entity_id, entity_type, {_NUMBERS} FROM a_num_e")
def profile_numeric(spark, sf):
    return _numbers(P.entity_numeric(R.access_normal(spark, sf)), "entity_id", "entity_type")


@query("profile_numeric_orders", f"SELECT entity_id, entity_type, {_NUMBERS} FROM o_num_e")
def profile_numeric_orders(spark, sf):
    """On orders: entities with a single event use the fixed spreads."""
    return _numbers(P.entity_numeric(R.order_split(spark, sf)[0]), "entity_id", "entity_type")


@query("hour_histogram", f"""SELECT e.entity_id, h.hour::BIGINT AS hour, {r('coalesce(c,0)/e.n::DOUBLE')} AS share FROM (SELECT entity_id, count(*) AS n FROM a_norm GROUP BY ALL) e
 CROSS JOIN (SELECT unnest(range(24)) AS hour) h LEFT JOIN (SELECT entity_id, hr, count(*) AS c FROM a_norm GROUP BY ALL) x ON x.entity_id=e.entity_id AND x.hr=h.hour""")
def hour_histogram(spark, sf):
    return P.hour_histogram(R.access_normal(spark, sf)).select("entity_id", long("hour"), S.round4(col("share")).alias("share"))


@query("profile_values", "SELECT entity_id, attr, value, n, first_us FROM a_val_e")
def profile_values(spark, sf):
    return P.values_by(P.profile_values(R.access_normal(spark, sf)), "entity_id")


@query("primary_auth", "SELECT entity_id, main AS primary_auth_method FROM o_auth_e")
def primary_auth(spark, sf):
    values = P.profile_values(R.order_split(spark, sf)[0])
    return P.primary_auth(P.values_by(values, "entity_id"), "entity_id")


@query("profiles_by_type", f"SELECT x.entity_type, {_NUMBERS}, main AS primary_auth_method FROM a_num_t x JOIN a_auth_t USING (entity_type)")
def profiles_by_type(spark, sf):
    normal = R.access_normal(spark, sf)
    auth = P.primary_auth(P.values_by(P.profile_values(normal), "entity_type"), "entity_type")
    return _numbers(P.type_numeric(normal), "entity_type").join(auth, "entity_type")


@query("profile_values_by_type", "SELECT entity_type, attr, value, n, first_us FROM a_val_t")
def profile_values_by_type(spark, sf):
    return P.values_by(P.profile_values(R.access_normal(spark, sf)), "entity_type")


@query("cold_start_census", """SELECT count(*)::BIGINT AS n_entities, count(DISTINCT entity_type)::BIGINT AS n_types, (count(*) FILTER (WHERE n<5))::BIGINT AS n_cold FROM o_num_e""")
def cold_start_census(spark, sf):
    return P.cold_start_census(P.entity_numeric(R.order_split(spark, sf)[0]))


@query("profile_export", f"""SELECT e.entity_id, entity_type, {r('hour_mean', 2)} AS hour_mean, {r('hour_std', 2)} AS hour_std, {r('dur_mean', 2)} AS session_duration_mean,
 {r('dur_std', 2)} AS session_duration_std, main AS primary_auth_method, e.n AS n_observed_events,
 (SELECT to_json(list(value ORDER BY value))::VARCHAR FROM a_val_e v WHERE v.entity_id=e.entity_id AND attr='geo') AS home_geo_set,
 (SELECT to_json(list(value ORDER BY value))::VARCHAR FROM a_val_e v WHERE v.entity_id=e.entity_id AND attr='ip_prefix') AS home_ip_prefixes,
 (SELECT to_json(list(value ORDER BY value))::VARCHAR FROM a_val_e v WHERE v.entity_id=e.entity_id AND attr='device') AS known_device_fingerprints,
 (SELECT '{{'||string_agg('"'||value||'":'||n, ',' ORDER BY value)||'}}' FROM a_val_e v WHERE v.entity_id=e.entity_id AND attr='resource') AS typical_resources,
 strftime(make_timestamp(first_us),'%Y-%m-%d %H:%M:%S') AS first_seen, strftime(make_timestamp(last_us),'%Y-%m-%d %H:%M:%S') AS last_seen
 FROM a_num_e e JOIN a_auth_e USING (entity_id)""")
def profile_export(spark, sf):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    out = P.profile_export(R.access_normal(spark, sf))
    return out.select(*[c for c in out.columns if c not in {"first_seen", "last_seen"}], text("first_seen"), text("last_seen"))


@query("offhours_rate", f"SELECT entity_id, {r('rate')} AS off_hours_rate FROM a_rate")
def offhours_rate(spark, sf):
    rates = X.off_hours_rate(R.access_normal(spark, sf))
    return rates.select("entity_id", S.round4(col("off_hours_rate")).alias("off_hours_rate"))


_FIT = """SELECT entity_type, 'pair' AS kind, prev||'>'||cur AS name, c AS n FROM {p}_pairs
 UNION ALL SELECT entity_type, 'total', res, t FROM {p}_state UNION ALL SELECT entity_type, 'start', res, starts FROM {p}_state
 UNION ALL SELECT entity_type, 'vocabulary', '', v FROM {p}_stat UNION ALL SELECT entity_type, 'sequences', '', n_seq FROM {p}_stat"""


def _fitted(model: Q.SequenceTables) -> DataFrame:
    def row(df, kind, name, n):
        return df.select("entity_type", lit(kind).alias("kind"), name.alias("name"), col(n).cast("long").alias("n"))

    pair = F.concat("prev", lit(">"), "cur")
    return (
        row(model.pairs, "pair", pair, "c")
        .unionByName(row(model.states, "total", col("resource"), "t"))
        .unionByName(row(model.states, "start", col("resource"), "starts"))
        .unionByName(row(model.stats, "vocabulary", lit(""), "v"))
        .unionByName(row(model.stats, "sequences", lit(""), "n_seq"))
    )


@query("markov_fit", _FIT.format(p="a"))
def markov_fit(spark, sf):
    normal = R.access_normal(spark, sf)
    return _fitted(Q.lazy_sequences(normal, find_hot_keys(normal, ["entity_id"])))


@query("markov_fit_mixed", _FIT.format(p="m"))
def markov_fit_mixed(spark, sf):
    """Some entities change their type after ten days."""
    normal = R.access_normal(spark, sf)
    late = col("event_us") - normal.agg(F.min("event_us")).scalar() > 10 * DAY
    changed = F.when((col("entity_id") % 7 == 0) & late, "edge_device").otherwise(col("entity_type"))
    mixed = normal.withColumn("entity_type", changed)
    return _fitted(Q.lazy_sequences(mixed, find_hot_keys(mixed, ["entity_id"])))


@query("markov_fit_turns", _FIT.format(p="c"))
def markov_fit_turns(spark, sf):
    """Role transitions of conversations."""
    turns = turn_events(spark, sf).withColumn("hour", lit(12))
    return _fitted(Q.lazy_sequences(turns, find_hot_keys(turns, ["entity_id"])))


@query("markov_log_probs", f"""SELECT entity_type, 'transition' AS kind, prev, cur, {r('ln(greatest((c+1e-4)/(t+1e-4*v),1e-10))', 6)} AS log_p FROM a_pairs
  JOIN (SELECT entity_type, res AS prev, t FROM a_state) USING (entity_type, prev) JOIN a_stat USING (entity_type)
 UNION ALL SELECT entity_type, 'unseen', res, '*', {r('ln(greatest(1e-4/(t+1e-4*v),1e-10))', 6)} FROM a_state JOIN a_stat USING (entity_type)
 UNION ALL SELECT entity_type, 'start', '*', res, {r('ln(greatest((starts+1e-4)/(n_seq+1e-4*v),1e-10))', 6)} FROM a_state JOIN a_stat USING (entity_type)
 UNION ALL SELECT entity_type, 'unknown', '*', '*', {r('ln(1e-4/(1e-4*v))', 6)} FROM a_stat""")
def markov_log_probs(spark, sf):
    _, sequences = R.access_model(spark, sf)
    table = Q.log_probabilities(sequences)
    return table.withColumn("log_p", S.round_to(col("log_p"), 6))


@query("score_distribution", f"""SELECT label, count(*)::BIGINT AS n, {r('avg(baseline_score)')} AS mean, {r('stddev_samp(baseline_score)')} AS std,
 {r('median(baseline_score)')} AS median, max(baseline_score) AS max FROM scored GROUP BY label""")
def score_distribution(spark, sf):
    return Z.score_distribution(R.detection(spark, sf).scored)


@query("separation_ratio", f"""SELECT {r('a')} AS attack_mean, {r('n')} AS normal_mean, {r('a/greatest(n,0.001::DOUBLE)', 2)} AS separation FROM
 (SELECT avg(sequence_score) FILTER (WHERE label<>'normal') AS a, avg(sequence_score) FILTER (WHERE label='normal') AS n FROM scored)""")
def separation_ratio(spark, sf):
    return Z.separation_ratio(R.detection(spark, sf).scored, "sequence_score")


@query("kpi_stats", """SELECT 'total_events' AS kpi, count(*)::BIGINT AS value FROM scored UNION ALL SELECT 'total_entities', count(*) FROM a_num_e
 UNION ALL SELECT 'total_alerts', count(*) FROM alerts UNION ALL SELECT 'n_high_risk', count(*) FROM alerts WHERE risk_score>=0.4::DOUBLE
 UNION ALL SELECT 'n_cold_start_alerts', count(*) FROM alerts WHERE cold UNION ALL SELECT 'type_'||predicted_type, count(*) FROM alerts GROUP BY predicted_type""")
def kpi_stats(spark, sf):
    d = R.detection(spark, sf)
    return A.kpi_stats(d.scored, d.alerts, d.profiles.entities)


@query("attack_distribution", "SELECT side, value, n, pct FROM shares")
def attack_distribution(spark, sf):
    return E.attack_distribution(R.detection(spark, sf).scored)


@query("top_threat", "SELECT predicted_type AS top_threat, count(*)::BIGINT AS n FROM alerts WHERE predicted_type<>'normal' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def top_threat(spark, sf):
    return A.top_threat(R.detection(spark, sf).alerts)


@query("privilege_growth", f"SELECT entity_id, {r('growth')} AS growth FROM all_growth")
def privilege_growth(spark, sf):
    grown = X.privilege_growth(access_events(spark, sf))
    return grown.select("entity_id", S.round4(col("privilege_footprint_growth_30d")).alias("growth"))


@query("class_weights", f"""SELECT label, c::BIGINT AS n_label, {r('sum(c) OVER ()/(count(*) OVER ()*c)::DOUBLE')} AS weight FROM
 (SELECT label, count(*) AS c FROM a_train WHERE label<>'normal' GROUP BY label)""")
def class_weights(spark, sf):
    train, _ = R.access_split(spark, sf)
    weights = K.class_weights(P.label_filter(train, normal=False))
    return weights.withColumn("weight", S.round4(col("weight")))


@query("confusion_matrix", """SELECT a.label AS truth, b.label AS predicted,
 (SELECT count(*) FROM scored s WHERE s.label=a.label AND s.predicted_type=b.label)::BIGINT AS n
 FROM (SELECT DISTINCT label FROM scored) a, (SELECT DISTINCT label FROM scored) b""")
def confusion_matrix(spark, sf):
    return E.confusion_matrix(R.detection(spark, sf).scored)


@query("cold_warm_slice", "SELECT is_cold_start, n_events, precision, recall FROM slices")
def cold_warm_slice(spark, sf):
    return E.cold_warm_slice(R.detection(spark, sf).scored)


@query("entity_population", """SELECT entity_type, count(DISTINCT entity_id)::BIGINT AS n_entities FROM access GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT entity_id) FROM access""")
def entity_population(spark, sf):
    return P.entity_population(access_events(spark, sf))


@query("entity_population_sketch", f"""SELECT entity_type, count(DISTINCT us//{DAY})::BIGINT AS n_days, true AS within_error FROM access GROUP BY 1
 UNION ALL SELECT 'all', count(DISTINCT us//{DAY}), true FROM access""")
def entity_population_sketch(spark, sf):
    """Stored daily sketches, united over all days, against the exact numbers."""
    events = access_events(spark, sf)
    stored = materialize(P.population_sketches(events), "sketches")
    estimated = P.population_estimate(stored).withColumnRenamed("n_entities", "estimate")
    near = F.abs(col("estimate") - col("n_entities")) <= P.SKETCH_ERROR * col("n_entities")
    return estimated.join(P.entity_population(events), "entity_type").select("entity_type", "n_days", near.alias("within_error"))


# === windows ===================================================================


@query("geo_velocity", f"""SELECT session_id, {r('kmh', 2)} AS geo_velocity_kmh, coalesce(kmh>1000 AND km>500,false) AS is_impossible_travel FROM all_moved""")
def geo_velocity(spark, sf):
    events = access_events(spark, sf)
    moved = X.geo_velocity(events, find_hot_keys(events, ["entity_id"]))
    return moved.select("session_id", "geo_velocity_kmh", "is_impossible_travel")


@query("geo_velocity_unknown", f"""SELECT session_id, {r('kmh', 2)} AS geo_velocity_kmh, coalesce(kmh>1000 AND km>500,false) AS is_impossible_travel FROM lost_moved""")
def geo_velocity_unknown(spark, sf):
    """Every seventh place is unknown: no speed to it and none from it."""
    events = lost_events(spark, sf)
    moved = X.geo_velocity(events, find_hot_keys(events, ["entity_id"]))
    return moved.select("session_id", "geo_velocity_kmh", "is_impossible_travel")


@query("risk_score_unknown", """SELECT session_id, baseline_score, geo_velocity_kmh, risk_score, CASE WHEN flagged THEN rule END AS rule_fired FROM w_risky""")
def risk_score_unknown(spark, sf):
    return R.lost_detection(spark, sf).scored.select(
        "session_id", "baseline_score", "geo_velocity_kmh", "risk_score", "rule_fired"
    )


@query("markov_last_transition", f"SELECT session_id, {r('nll')} AS markov_nll, {r('least(nll/15.0,1.0::DOUBLE)')} AS markov_score FROM a_nll")
def markov_last_transition(spark, sf):
    _, sequences = R.access_model(spark, sf)
    test = R.access_test(spark, sf)
    scored = Q.markov_last_transition(test, sequences, find_hot_keys(test, ["entity_id"]))
    return scored.select("session_id", "markov_nll", "markov_score")


@query("session_chunks", "SELECT session_id, entity_id, chunk::BIGINT AS chunk, pos::BIGINT AS position FROM a_chunk WHERE len>=2")
def session_chunks(spark, sf):
    normal = R.access_normal(spark, sf)
    return Q.session_chunks(normal, find_hot_keys(normal, ["entity_id"])).select("session_id", "entity_id", "chunk", "position")


@query("failed_auth_count_5min", "SELECT session_id, fails AS failed_auth_count FROM all_fail")
def failed_auth_count_5min(spark, sf):
    """With a window of a day on either side; the events are sparse."""
    events = access_events(spark, sf)
    counted = X.failed_auth_counts(events, DAY, find_hot_keys(events, ["entity_id"]))
    return counted.select("session_id", col("failed_auth_count_5min").cast("long").alias("failed_auth_count"))


@query("distinct_entities_from_ip_5min", "SELECT session_id, accounts AS entities FROM all_ip")
def distinct_entities_from_ip_5min(spark, sf):
    """With a window of half an hour on either side."""
    events = access_events(spark, sf)
    hot = X.find_hot(events)
    found = X.ip_concurrency(events, 30 * MINUTE, hot=hot["ip"], hot_pairs=hot["pairs"])
    return found.select("session_id", col("distinct_entities_from_ip_5min").alias("entities"))


@query("resource_breadth_new_1hr", "SELECT session_id, breadth FROM all_breadth")
def resource_breadth_new_1hr(spark, sf):
    events = access_events(spark, sf)
    found = X.resource_breadth(events, HOUR, find_hot_keys(events, ["entity_id"]))
    return found.select("session_id", col("resource_breadth_new_1hr").alias("breadth"))


@query("first_seen_resource", "SELECT session_id, first_flag::BIGINT AS first_seen FROM o_first")
def first_seen_resource(spark, sf):
    """On orders, where many events share a day."""
    events = order_events(spark, sf)
    found = X.first_seen_resource(events, find_hot_keys(events, ["entity_id"]))
    return found.select("session_id", col("first_seen_resource").alias("first_seen"))


@query("lowslow_cumulative", f"SELECT session_id, {r('ls')} AS low_slow_score FROM a_ls_cum")
def lowslow_cumulative(spark, sf):
    _, sequences = R.access_model(spark, sf)
    test = R.access_test(spark, sf)
    return X.low_slow(test, sequences.rates, R.ACCESS, find_hot_keys(test, ["entity_id"])).select("session_id", "low_slow_score")


@query("lowslow_7d", f"SELECT session_id, CASE WHEN {OFF} THEN cnt ELSE 0 END::BIGINT AS recent, {r('ls')} AS low_slow_score FROM access JOIN all_ls_7d USING (session_id)")
def lowslow_7d(spark, sf):
    _, sequences = R.access_model(spark, sf)
    events = access_events(spark, sf)
    s = R.ACCESS.with_(low_slow="trailing")
    scored = X.low_slow(events, sequences.rates, s, find_hot_keys(events, ["entity_id"]))
    recent = F.when(X.off_hours(), col("off_hours_n")).otherwise(0)
    return scored.select("session_id", recent.alias("recent"), "low_slow_score")


@query("markov_window_nll", f"SELECT session_id, {r('nll')} AS markov_nll FROM a_window_nll")
def markov_window_nll(spark, sf):
    _, sequences = R.access_model(spark, sf)
    test = R.access_test(spark, sf)
    return Q.markov_window(test, sequences, find_hot_keys(test, ["entity_id"])).select("session_id", "markov_nll")


@query("risk_timeline", """SELECT entity_id, session_id, us AS event_us, risk_score, risk_score>0.2::DOUBLE AS above_threshold FROM scored
 WHERE entity_id=(SELECT entity_id FROM scored ORDER BY label<>'insider_drift', us, session_id LIMIT 1)""")
def risk_timeline(spark, sf):
    return E.risk_timeline(R.detection(spark, sf).scored)


@query("pr_curve_points", f"""SELECT score, cum_n::BIGINT AS cum_n, cum_tp::BIGINT AS cum_tp, {r('cum_tp/cum_n::DOUBLE')} AS precision,
 {r('cum_tp/(SELECT sum(tp) FROM hist)::DOUBLE')} AS recall FROM hist""")
def pr_curve_points(spark, sf):
    points = H.pr_curve_points(R.detection(spark, sf).scored)
    return points.withColumns({n: S.round4(col(n)) for n in ("precision", "recall")})


# === sorts, limits =============================================================


@query("alert_queue", "SELECT session_id, risk_score, predicted_type FROM alerts")
def alert_queue(spark, sf):
    return A.alert_queue(R.detection(spark, sf).alerts).select("session_id", "risk_score", "predicted_type")


@query("precision_at_budget", "SELECT budget, top_k_count, precision, recall FROM budget")
def precision_at_budget(spark, sf):
    return H.precision_at_budget(R.detection(spark, sf).scored)


@query("top_pct_threshold", """SELECT min(risk_score) AS threshold, count(*)::BIGINT AS k FROM (SELECT risk_score FROM scored ORDER BY risk_score DESC
 LIMIT (SELECT greatest(1,floor(count(*)*0.02))::BIGINT FROM scored))""")
def top_pct_threshold(spark, sf):
    return H.top_pct_threshold(R.detection(spark, sf).scored, 2.0)


@query("alerts_page", """SELECT session_id, risk_score, (SELECT count(*) FROM alerts WHERE risk_score>=0.2::DOUBLE)::BIGINT AS total
 FROM alerts WHERE risk_score>=0.2::DOUBLE ORDER BY risk_score DESC, session_id LIMIT 20 OFFSET 20""")
def alerts_page(spark, sf):
    d = R.detection(spark, sf)
    page = A.alerts_page(d.alerts, d.scored, A.AlertFilter(min_risk=0.2), page=2, limit=20)
    return page.select("session_id", "risk_score", "total")


@query("top_features", "SELECT session_id, rank::BIGINT AS rank, feature, value FROM top5")
def top_features(spark, sf):
    """With equal importances, as before any training."""
    found = R.detection(spark, sf).scored.select("session_id", F.posexplode("top_features"))
    return found.select(
        "session_id", (col("pos") + 1).cast("long").alias("rank"), col("col.feature").alias("feature"), col("col.value").alias("value")
    )


_RAW = "CASE feature " + " ".join(f"WHEN '{f}' THEN x.{f}" for f in C.MODEL_FEATURES) + " END"


@query("top_features_raw", f"""SELECT session_id, rank::BIGINT AS rank, feature, t.value AS contribution, {r(_RAW)} AS value
 FROM top5 t JOIN scores x USING (session_id)""")
def top_features_raw(spark, sf):
    """The contributions beside the event's own values."""
    found = R.detection(spark, sf).scored.select("session_id", F.posexplode(K.raw_features()).alias("pos", "f"))
    return found.select(
        "session_id", (col("pos") + 1).cast("long").alias("rank"), col("f.feature").alias("feature"),
        col("f.contribution").alias("contribution"), S.round4(col("f.value")).alias("value"),
    )


@query("alerts_page_deep", """SELECT session_id, risk_score, (SELECT count(*) FROM alerts)::BIGINT AS total
 FROM alerts ORDER BY risk_score DESC, session_id LIMIT 7 OFFSET 7*((SELECT count(*) FROM alerts)//7-2)""")
def alerts_page_deep(spark, sf):
    """A page near the end of the whole queue."""
    d = R.detection(spark, sf)
    page = d.alerts.count() // 7 - 1
    return A.alerts_page(d.alerts, d.scored, page=page, limit=7).select("session_id", "risk_score", "total")


@query("recent_events", f"""SELECT session_id, us AS event_us FROM scored WHERE entity_id={_BUSIEST} ORDER BY us DESC, session_id DESC LIMIT 100""")
def recent_events(spark, sf):
    d = R.detection(spark, sf)
    return A.recent_events(d.scored, _busiest(d.alerts)).select("session_id", "event_us")


@query("entities_page", """SELECT entity_id, entity_type, (SELECT count(*) FROM alerts x WHERE x.entity_id=e.entity_id) AS alert_count,
 (SELECT count(*) FROM a_num_e WHERE entity_type='user' AND contains(entity_id::VARCHAR,'1'))::BIGINT AS total
 FROM a_num_e e WHERE entity_type='user' AND contains(entity_id::VARCHAR,'1') ORDER BY entity_id LIMIT 10 OFFSET 10""")
def entities_page(spark, sf):
    d = R.detection(spark, sf)
    page = A.entities_page(d.profiles.entities, d.alerts, "user", "1", page=2, limit=10)
    return page.select("entity_id", "entity_type", "alert_count", "total")


@query("top_importances", f"SELECT unnest(range(1,6))::BIGINT AS place, true AS in_order, true AS known, true AS sums_to_one")
def top_importances(spark, sf):
    """The five largest: in order, features of the model, out of importances that sum to 1."""
    table = K.importances_table(spark, R.classifier(spark, sf))
    total = table.agg(F.sum("importance")).scalar()
    top = table.orderBy(F.desc("importance"), "feature").limit(5)
    fall = Window.orderBy(F.desc("importance"), "feature")  # over five rows
    return top.select(
        F.row_number().over(fall).cast("long").alias("place"),
        (col("importance") <= F.lag("importance", 1, 1.0).over(fall)).alias("in_order"),
        col("feature").isin(C.MODEL_FEATURES).alias("known"),
        (F.abs(total - 1.0) < 1e-9).alias("sums_to_one"),
    )


# === sets ======================================================================


@query("union_alerts", """SELECT session_id, predicted_type FROM alerts WHERE predicted_type='brute_force' UNION ALL SELECT session_id, predicted_type FROM alerts""")
def union_alerts(spark, sf):
    alerts = R.detection(spark, sf).alerts
    return A.union_alerts(alerts.filter(col("predicted_type") == "brute_force"), alerts).select("session_id", "predicted_type")


@query("new_vs_old_values", "SELECT entity_id, attr, value FROM o_new")
def new_vs_old_values(spark, sf):
    events = order_events(spark, sf)
    end = events.agg(F.max("event_us")).scalar()
    recent = P.values_by(P.profile_values(P.rolling_window(events, end, R.ORDERS.rolling_days)), "entity_id")
    old = R.order_profiles(spark, sf).entity_values
    return P.new_values(recent.filter(col("attr").isin("resource", "geo")), old).select("entity_id", "attr", "value")


@query("distinct_values", "SELECT DISTINCT attr, value FROM a_long")
def distinct_values(spark, sf):
    return P.distinct_values(R.access_normal(spark, sf))


# === composite scores ==========================================================


def _based(spark, sf):
    model, _ = R.access_model(spark, sf)
    test = R.access_test(spark, sf)
    return Z.baseline_scores(test, model, R.ACCESS, find_hot_keys(test, ["entity_id"]), test)


@query("hour_zscore", "SELECT session_id, hour_zscore FROM a_base")
def hour_zscore(spark, sf):
    return _based(spark, sf).select("session_id", "hour_zscore")


@query("duration_zscore", "SELECT session_id, duration_zscore FROM a_base")
def duration_zscore(spark, sf):
    return _based(spark, sf).select("session_id", "duration_zscore")


@query("novelty_scores", "SELECT session_id, geo_novelty, resource_novelty, auth_method_novelty, device_novelty FROM a_base")
def novelty_scores(spark, sf):
    return _based(spark, sf).select("session_id", "geo_novelty", "resource_novelty", "auth_method_novelty", "device_novelty")


@query("baseline_score", "SELECT session_id, baseline_score, cold AS is_cold_start, geo_velocity_kmh FROM a_base")
def baseline_score(spark, sf):
    return _based(spark, sf).select("session_id", "baseline_score", "is_cold_start", "geo_velocity_kmh")


@query("baseline_score_cold", """SELECT session_id, baseline_score, cold AS is_cold_start, geo_novelty, resource_novelty, device_novelty FROM o_base""")
def baseline_score_cold(spark, sf):
    """On orders: cold entities, damping and the fallback to the type's profile."""
    _, test = R.order_split(spark, sf)
    scored = Z.baseline_scores(test, R.order_profiles(spark, sf), R.ORDERS, find_hot_keys(test, ["entity_id"]), test)
    return scored.select("session_id", "baseline_score", "is_cold_start", "geo_novelty", "resource_novelty", "device_novelty")


@query("sequence_score", "SELECT session_id, markov_score, low_slow_score, sequence_score FROM scored")
def sequence_score(spark, sf):
    return R.detection(spark, sf).scored.select("session_id", "markov_score", "low_slow_score", "sequence_score")


@query("risk_score", "SELECT session_id, risk_score FROM scored")
def risk_score(spark, sf):
    rows = R.detection(spark, sf).scored
    return rows.select("session_id", Z.risk_score(col("baseline_score"), col("sequence_score")).alias("risk_score"))


@query("flag_gate", "SELECT session_id, flagged AS is_flagged FROM scored")
def flag_gate(spark, sf):
    rows = R.detection(spark, sf).scored
    return rows.select("session_id", Z.flag_gate(col("baseline_score"), col("sequence_score")).alias("is_flagged"))


@query("rule_overrides", "SELECT session_id, rule FROM risky")
def rule_overrides(spark, sf):
    rows = R.detection(spark, sf).scored.withColumn("verdict", K.rule_verdict())
    return rows.select("session_id", col("verdict.rule").alias("rule"))


@query("classify_rules", "SELECT session_id, predicted_type, confidence AS predicted_type_confidence, rule_fired FROM scored")
def classify_rules(spark, sf):
    return R.detection(spark, sf).scored.select("session_id", "predicted_type", "predicted_type_confidence", "rule_fired")


@query("classify", """SELECT session_id, CASE WHEN flagged THEN rule END AS rule_fired, true AS consistent FROM risky""")
def classify(spark, sf):
    """Rules first, the forest for what they leave open."""
    scored = R.detection(spark, sf).scored
    done = K.classify(scored, R.classifier(spark, sf))
    ruled = K.classify(scored).select("session_id", col("predicted_type").alias("by_rule"), col("predicted_type_confidence").alias("sure"))
    as_ruled = (col("predicted_type") == col("by_rule")) & (col("predicted_type_confidence") == col("sure"))
    voted = col("predicted_type").isin(K.LABELS) & col("predicted_type_confidence").between(0.1428, 1.0)
    open_ = col("is_flagged") & col("rule_fired").isNull()
    return done.join(ruled, "session_id").select("session_id", "rule_fired", F.when(open_, voted).otherwise(as_ruled).alias("consistent"))


@query("select_alerts", "SELECT session_id, risk_score, predicted_type FROM alerts")
def select_alerts(spark, sf):
    return A.select_alerts(R.detection(spark, sf).scored).select("session_id", "risk_score", "predicted_type")


_RULE_TEXT = """CASE rule_fired WHEN 'failed_auth_burst' THEN failed_auth_count_5min::BIGINT||' failed authentication attempts from '||ip||' in a 5-minute window (brute force pattern)'
 WHEN 'geo_velocity_exceeded' THEN 'Implied travel speed of '||printf('%.0f',geo_velocity_kmh)||' km/h to reach '||geo||' (impossible travel pattern)'
 WHEN 'multi_entity_same_ip' THEN distinct_entities_from_ip_5min::BIGINT||' different user accounts accessed from '||ip||' in 5 minutes (credential stuffing pattern)'
 WHEN 'fingerprint_mismatch' THEN 'Device fingerprint '''||left(device,30)||'...'' does not match known devices for '||entity_id||' (device spoofing)' ELSE '' END"""


@query("explanations", f"SELECT session_id, {_RULE_TEXT} AS explanation_text FROM scored")
def explanations(spark, sf):
    return R.detection(spark, sf).scored.select("session_id", "explanation_text")


@query("explanations_model", f"""SELECT s.session_id, coalesce(any_value(d.v), 'x') AS description, 'Flagged due to '||string_agg(CASE WHEN feature='geo_velocity_kmh' THEN p.v||' ('||printf('%.0f',value)||' km/h)'
  WHEN feature IN ('failed_auth_count_5min','distinct_entities_from_ip_5min','resource_breadth_new_1hr') THEN trunc(value)::BIGINT||' '||p.v
  WHEN feature IN ('hour_zscore','duration_zscore') THEN p.v||' (z='||printf('%.1f',value)||')' ELSE p.v END, ' + ' ORDER BY rank)||'. '||any_value(d.v) AS explanation_text
 FROM scored s JOIN top5 USING (session_id) JOIN (VALUES {_values(C.FEATURE_PHRASES)}) p(f,v) ON p.f=feature
 JOIN (VALUES {_values(C.ATTACK_DESCRIPTIONS)}) d(f,v) ON d.f=predicted_type WHERE rank<=3 GROUP BY s.session_id""")
def explanations_model(spark, sf):
    """The contribution texts, as they read where no rule has fired."""
    rows = R.detection(spark, sf).scored.filter(F.size("top_features") > 0)
    text = rows.withColumn("explanation_text", explain.model_text())
    description = F.try_element_at(S.text_map(C.ATTACK_DESCRIPTIONS), col("predicted_type"))
    return text.select("session_id", description.alias("description"), "explanation_text")


_DRIFT = "SELECT entity_id, n_recent::BIGINT AS n_recent, new_resources::BIGINT AS new_resources, new_geos::BIGINT AS new_geos, is_drift_flagged FROM {p}_drift"


@query("drift_flag", _DRIFT.format(p="a"))
def drift_flag(spark, sf):
    events, test = access_events(spark, sf), R.access_test(spark, sf)
    model, _ = R.access_model(spark, sf)
    return P.drift_flags(events, model, test.agg(F.max("event_us")).scalar(), R.ACCESS)


@query("drift_flag_orders", _DRIFT.format(p="o"))
def drift_flag_orders(spark, sf):
    events = order_events(spark, sf)
    return P.drift_flags(events, R.order_profiles(spark, sf), events.agg(F.max("event_us")).scalar(), R.ORDERS)


@query("fit_rolling", f"""SELECT entity_id, count(*)::BIGINT AS n_observed_events, {r('avg(hr)')} AS hour_mean, {r('sum(dur)', 2)} AS duration_total, min(us) AS first_us, max(us) AS last_us FROM a_recent GROUP BY entity_id""")
def fit_rolling(spark, sf):
    events = access_events(spark, sf)
    model = P.fit_rolling(events, events.agg(F.max("event_us")).scalar(), R.ACCESS)
    return _numbers(model.entities, "entity_id").drop("hour_std", "duration_std")


def _daily(spark, sf):
    """Stored daily tables of the log, and its last day."""
    def make():
        path = new_path(spark, "daily")
        P.write_daily(access_events(spark, sf), path)
        return path

    last = access_events(spark, sf).agg(F.floor(F.max("event_us") / DAY)).first()[0]
    return P.read_daily(spark, R.kept(spark, sf, "daily", make)), last


@query("drift_daily", _DRIFT.format(p="d"))
def drift_daily(spark, sf):
    daily, last = _daily(spark, sf)
    return P.drift_daily(daily, R.access_model(spark, sf)[0], last, R.ACCESS)


@query("fit_daily", f"""SELECT entity_id, count(*)::BIGINT AS n_observed_events, {r('avg(hr)')} AS hour_mean, {r('sum(dur::DECIMAL(18,6))::DOUBLE', 2)} AS duration_total,
 {r('CASE WHEN count(*)>1 THEN greatest(1.0::DOUBLE, stddev_pop(hr)) ELSE 6.0 END::DOUBLE')} AS hour_std,
 {r('CASE WHEN count(*)>1 THEN greatest(1.0::DOUBLE, stddev_samp(dur)) ELSE greatest(1.0::DOUBLE, avg(dur)*0.3) END::DOUBLE')} AS duration_std,
 min(us) AS first_us, max(us) AS last_us FROM d_recent GROUP BY entity_id""")
def fit_daily(spark, sf):
    """A refit of 14 whole days from their stored tables."""
    daily, last = _daily(spark, sf)
    return _numbers(P.fit_daily(daily, last, R.ACCESS).entities, "entity_id")


# === learning, evaluation ======================================================


@query("feature_matrix", "SELECT session_id, " + ", ".join(f"{f} AS f{i}" for i, f in enumerate(C.MODEL_FEATURES)) + " FROM scores")
def feature_matrix(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows = K.feature_matrix(R.detection(spark, sf).scored).select("session_id", vector_to_array("features").alias("x"))
    return rows.select("session_id", *[col("x")[i].alias(f"f{i}") for i in range(len(C.MODEL_FEATURES))])


_LABELS = "[" + ",".join(f"'{x}'" for x in sorted(C.ATTACK_LABELS)) + "]"


@query("label_index", f"SELECT session_id, label, (list_position({_LABELS}, label)-1)::DOUBLE AS target FROM a_train WHERE label<>'normal'")
def label_index(spark, sf):
    train, _ = R.access_split(spark, sf)
    return P.label_filter(train, normal=False).select("session_id", "label", K.label_index(col("label")).alias("target"))


@query("rf_fit", "SELECT label, count(*)::BIGINT AS n, true AS mostly_right FROM a_train WHERE label<>'normal' GROUP BY label")
def rf_fit(spark, sf):
    """Whether the forest names at least half of what it was trained on, per label."""
    fitted = K.rf_predict(R.training(spark, sf), R.classifier(spark, sf))
    right = F.count_if(col("ml_type") == col("label"))
    return fitted.groupBy("label").agg(F.count(lit(1)).alias("n"), (right * 2 >= F.count(lit(1))).alias("mostly_right"))


@query("rf_predict", "SELECT session_id, true AS known, true AS bounded FROM scored")
def rf_predict(spark, sf):
    """One of the seven labels with a confidence between a seventh and 1 for every event."""
    voted = K.rf_predict(R.detection(spark, sf).scored, R.classifier(spark, sf))
    return voted.select(
        "session_id", col("ml_type").isin(K.LABELS).alias("known"), col("ml_confidence").between(0.1428, 1.0).alias("bounded")
    )


@query("rf_fit_normals", "SELECT label, count(*)::BIGINT AS n, true AS known, true AS no_small_split FROM a_train GROUP BY label")
def rf_fit_normals(spark, sf):
    """A forest that knows normal events as well; no node below five rows is split."""
    frame, sequences = R.stored_split(spark, sf)[0], R.access_model(spark, sf)
    scored = R.kept(spark, sf, "train_scores", lambda: materialize(score_events(frame, *sequences, R.ACCESS), "train_scores"))
    forest = R.kept(spark, sf, "forest_normals", lambda: K.fit_classifier(scored, with_normals=True))
    path = new_path(spark, "forest")
    forest.save(path)
    node = col("nodeData")
    small = spark.read.parquet(f"{path}/data").filter((node["leftChild"] >= 0) & (node["rawCount"] < K.MIN_ROWS_TO_SPLIT)).isEmpty()
    voted = K.rf_predict(scored, forest)
    return voted.groupBy("label").agg(
        F.count(lit(1)).alias("n"), F.bool_and(col("ml_type").isin(K.LABELS_WITH_NORMAL)).alias("known"), lit(small).alias("no_small_split")
    )


@query("detect_learned", """SELECT session_id, risk_score, flagged AS is_flagged, rule AS rule_fired, true AS consistent FROM (
 SELECT session_id, risk_score, flagged, CASE WHEN flagged THEN rule END AS rule FROM risky)""")
def detect_learned(spark, sf):
    """The whole run with a forest: rules decide where they fire, the forest names all else that is flagged."""
    d = R.learned_detection(spark, sf)
    named = col("predicted_type").isin(K.LABELS) & col("predicted_type_confidence").between(0.0, 1.0)
    calm = (col("predicted_type") == C.NORMAL) & (col("predicted_type_confidence") == 1.0)
    explained = (col("explanation_text") != "") == (col("predicted_type") != C.NORMAL)
    rows = d.scored.select(
        "session_id", "risk_score", "is_flagged", "rule_fired", (F.when(col("is_flagged"), named).otherwise(calm) & explained).alias("fits")
    )
    alerted = d.alerts.select("session_id", lit(True).alias("alerted"))
    wanted = (col("risk_score") > C.ALERT_THRESHOLD) | col("is_flagged")
    return rows.join(alerted, "session_id", "left").select(
        "session_id", "risk_score", "is_flagged", "rule_fired", (col("fits") & (wanted == col("alerted").isNotNull())).alias("consistent")
    )


@query("pr_auc", f"SELECT {r('pr_auc')} AS pr_auc FROM auc")
def pr_auc(spark, sf):
    return H.pr_auc(R.detection(spark, sf).scored).select(S.round4(col("pr_auc")).alias("pr_auc"))


@query("pr_auc_documents", f"SELECT {r('pr_auc')} AS pr_auc FROM doc_auc")
def pr_auc_documents(spark, sf):
    """Text length as a score for toxicity: a second labelled ranking."""
    docs = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = read_table(spark, sf, "labels").select("doc_id", "toxic")
    score = S.round4(S.clip01(col("n_chars") / 20000.0))
    rows = docs.join(labels, "doc_id").select(score.alias("score"), "toxic")
    return H.pr_auc(rows, "score", col("toxic")).select(S.round4(col("pr_auc")).alias("pr_auc"))


@query("metrics_summary", "SELECT metric, key, value FROM metrics")
def metrics_summary(spark, sf):
    d = R.detection(spark, sf)
    return E.metrics_summary(d.scored, d.alerts)


_AT = lambda b: f"(SELECT precision*100 FROM budget WHERE budget={b}::DOUBLE)"


@query("budget_precision_estimate", f"""SELECT pct, {r("CASE WHEN pct<=0.5 THEN p05+(0.5-pct)*15 WHEN pct<=1.0 THEN p05-((pct-0.5)/0.5)*(p05-p10) WHEN pct<=3.0 THEN p10-((pct-1.0)/2.0)*(p10-p30) ELSE greatest(2.5::DOUBLE, p30-((pct-3.0)/7.0)*8.5) END")} AS estimated_precision
 FROM (SELECT unnest(range(1,101))/10.0::DOUBLE AS pct, {_AT(0.005)} AS p05, {_AT(0.01)} AS p10, {_AT(0.03)} AS p30)""")
def budget_precision_estimate(spark, sf):
    return E.budget_precision_estimate(H.precision_at_budget(R.detection(spark, sf).scored))
