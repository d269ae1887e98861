"""The registered queries in plain SQL, for checking results on another engine.

Each query is a final SELECT over named building blocks; :func:`assemble` adds
just the blocks it needs as common table expressions.
"""

from __future__ import annotations

import re

from tidewatch import constants as C

DAY = 86_400_000_000
HOUR = 3_600_000_000
MINUTE = 60_000_000


def r(x: str, digits: int = 4) -> str:
    return f"(round_even(({x})*1e{digits},0)/1e{digits})"


def clip(x: str) -> str:
    return f"least(greatest({x},0.0::DOUBLE),1.0::DOUBLE)"


OFF = "hr IN (22,23,0,1,2,3,4,5)"

CITIES = ", ".join(
    f"({i},'{city}',{lat}::DOUBLE,{lon}::DOUBLE)" for i, (city, lat, lon) in enumerate(C.CITY_COORDINATES)
)

BLOCKS: dict[str, str] = {}

BLOCKS["city"] = f"SELECT * FROM (VALUES {CITIES}) v(id, name, lat, lon)"

BLOCKS["raw_access"] = """
SELECT event_id AS session_id, user_id AS entity_id,
  CASE WHEN user_id%5<3 THEN 'user' WHEN user_id%5=3 THEN 'service_account' ELSE 'edge_device' END AS entity_type,
  epoch_us(ts) AS us, hour(ts) AS hr, CAST(regexp_extract(props,'[0-9]+') AS INT) AS k, event_type, value, user_id
FROM events"""

BLOCKS["access"] = f"""
SELECT session_id, entity_id, entity_type, us, hr, k,
  '10.'||(k%8)||'.0.'||(k%16) AS ip, city.name AS geo, city.lat AS lat, city.lon AS lon,
  event_type||'/'||(k%4) AS res,
  CASE k%20 WHEN 0 THEN 'token' WHEN 1 THEN 'certificate' WHEN 2 THEN 'biometric' ELSE 'password' END AS auth,
  CASE WHEN event_type='error' THEN 'fail' ELSE 'success' END AS result, value AS dur,
  CASE WHEN k=99 THEN 'dev_spoof' ELSE 'dev_'||user_id||'_'||(k%2) END AS device,
  CASE WHEN k=99 THEN 'device_spoofing' WHEN k%50=0 THEN 'impossible_travel'
    WHEN event_type='error' AND k<10 THEN 'brute_force'
    WHEN k BETWEEN 10 AND 14 AND {OFF} THEN 'low_and_slow_exfil'
    WHEN k=20 THEN 'lateral_movement' WHEN k=22 THEN 'credential_stuffing'
    WHEN k=23 AND user_id%5<3 THEN 'insider_drift' ELSE 'normal' END AS label
FROM raw_access JOIN city ON city.id = CASE WHEN k%50=0 THEN (user_id*3+k+7)%20 ELSE user_id%20 END"""

BLOCKS["purchase"] = """
SELECT o_orderkey AS session_id, o_custkey AS entity_id, c_mktsegment AS entity_type,
  epoch_us(o_orderdate) AS us, hour(o_orderdate) AS hr,
  '10.'||c_nationkey||'.0.'||(o_custkey%16) AS ip, city.name AS geo, city.lat AS lat, city.lon AS lon,
  o_orderpriority AS res, o_orderstatus AS auth,
  CASE WHEN o_orderstatus='F' THEN 'fail' ELSE 'success' END AS result, o_totalprice AS dur,
  'dev_'||o_custkey||'_'||(o_orderkey%2) AS device, 'normal' AS label
FROM orders JOIN customer ON o_custkey=c_custkey
JOIN city ON city.id = CASE WHEN o_orderkey%97=0 THEN (c_nationkey+7)%20 ELSE c_nationkey%20 END"""


def profile_blocks(p: str, source: str, days: int) -> None:
    """Profiles of one data set: split, numbers, values, lookup and baseline scores."""
    b = BLOCKS
    b[f"{p}_cut"] = f"SELECT min(us)+{days}*{DAY} AS c FROM {source}"
    b[f"{p}_train"] = f"SELECT * FROM {source} WHERE us < (SELECT c FROM {p}_cut)"
    b[f"{p}_test"] = f"SELECT * FROM {source} WHERE us >= (SELECT c FROM {p}_cut)"
    b[f"{p}_norm"] = f"SELECT * FROM {p}_train WHERE label='normal'"
    # Durations are summed exactly: a mean of cents often lies on a rounding edge.
    numbers = """count(*)::BIGINT AS n, avg(hr) AS hour_mean,
  CASE WHEN count(*)>1 THEN greatest(1.0::DOUBLE, stddev_pop(hr)) ELSE 6.0 END::DOUBLE AS hour_std,
  sum(dur::DECIMAL(18,6))::DOUBLE/count(dur) AS dur_mean,
  CASE WHEN count(*)>1 THEN greatest(1.0::DOUBLE, stddev_samp(dur)) ELSE greatest(1.0::DOUBLE, avg(dur)*0.3) END::DOUBLE AS dur_std,
  min(us) AS first_us, max(us) AS last_us"""
    b[f"{p}_num_e"] = f"SELECT entity_id, min(entity_type) AS entity_type, {numbers} FROM {p}_norm GROUP BY entity_id"
    b[f"{p}_num_t"] = f"SELECT entity_type, {numbers} FROM {p}_norm GROUP BY entity_type"
    b[f"{p}_long"] = "\nUNION ALL ".join(
        f"SELECT entity_id, entity_type, us, '{attr}' AS attr, {col} AS value FROM {p}_norm"
        for attr, col in [
            ("resource", "res"), ("auth", "auth"), ("geo", "geo"),
            ("ip_prefix", "regexp_extract(ip,'^([0-9]+\\.[0-9]+\\.[0-9]+)\\.[0-9]+$',1)"), ("device", "device"),
        ]
    )
    for key, tag in (("entity_id", "e"), ("entity_type", "t")):
        b[f"{p}_val_{tag}"] = (
            f"SELECT {key}, attr, value, count(*)::BIGINT AS n, min(us) AS first_us FROM {p}_long GROUP BY ALL"
        )
        b[f"{p}_auth_{tag}"] = (
            f"SELECT {key}, value AS main FROM {p}_val_{tag} WHERE attr='auth' "
            f"QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, first_us, value)=1"
        )
    # One table of profiles and one of values under a common key.
    b[f"{p}_prof"] = f"""
SELECT 'e:'||entity_id AS pk, x.n, hour_mean, hour_std, dur_mean, dur_std, main FROM {p}_num_e x JOIN {p}_auth_e USING (entity_id)
UNION ALL
SELECT 't:'||entity_type, x.n, hour_mean, hour_std, dur_mean, dur_std, main FROM {p}_num_t x JOIN {p}_auth_t USING (entity_type)"""
    b[f"{p}_vals"] = f"""
SELECT 'e:'||entity_id AS pk, attr, value, n FROM {p}_val_e UNION ALL SELECT 't:'||entity_type, attr, value, n FROM {p}_val_t"""
    b[f"{p}_pick"] = f"""
SELECT t.*, NOT coalesce(own.n>=5,false) AS cold,
  CASE WHEN own.n>=5 THEN 'entity' WHEN ty.pk IS NOT NULL THEN 'type' WHEN own.pk IS NOT NULL THEN 'entity' END AS src,
  CASE WHEN own.n>=5 THEN own.pk WHEN ty.pk IS NOT NULL THEN ty.pk ELSE own.pk END AS pk
FROM {p}_test t LEFT JOIN {p}_prof own ON own.pk='e:'||t.entity_id LEFT JOIN {p}_prof ty ON ty.pk='t:'||t.entity_type"""
    b[f"{p}_found"] = f"""
SELECT k.*, q.n AS pn, hour_mean, hour_std, dur_mean, dur_std, main,
  coalesce(g.n,0) AS geo_n, coalesce(d.n,0) AS device_n, coalesce(s.n,0) AS resource_n
FROM {p}_pick k LEFT JOIN {p}_prof q USING (pk)
LEFT JOIN {p}_vals g ON g.pk=k.pk AND g.attr='geo' AND g.value=k.geo
LEFT JOIN {p}_vals d ON d.pk=k.pk AND d.attr='device' AND d.value=k.device
LEFT JOIN {p}_vals s ON s.pk=k.pk AND s.attr='resource' AND s.value=k.res"""
    b[f"{p}_moved"] = travel(f"{p}_test")
    b[f"{p}_parts"] = f"""
SELECT f.*, CASE WHEN f.src='entity' THEN m.kmh ELSE 0.0 END AS speed, m.km,
  CASE WHEN hour_std<0.5 THEN 0.0 ELSE least(1.0::DOUBLE, least(abs(f.hr-hour_mean)/hour_std, abs(24-abs(f.hr-hour_mean))/hour_std)/4.0) END AS hz,
  CASE WHEN geo_n>0 THEN 0.0 ELSE 1.0 END::DOUBLE AS gn0,
  CASE WHEN f.cold THEN 0.5 ELSE 1.0 END::DOUBLE AS damp,
  1.0-resource_n/pn AS rn0,
  CASE WHEN dur_std<1.0 THEN 0.0 ELSE least(1.0::DOUBLE, abs(f.dur-dur_mean)/dur_std/4.0) END AS dz,
  CASE WHEN auth=main THEN 0.0 ELSE 1.0 END::DOUBLE AS an,
  CASE WHEN device_n>0 THEN 0.0 ELSE 1.0 END::DOUBLE AS dn0
FROM {p}_found f JOIN {p}_moved m USING (session_id)"""
    b[f"{p}_base_full"] = f"""
SELECT *, damp*(CASE WHEN speed>1000 AND km>500 THEN greatest(gn0,0.9::DOUBLE) ELSE gn0 END) AS gn, damp*rn0 AS rn, damp*dn0 AS dn FROM {p}_parts"""
    weights = "0.15::DOUBLE*hz+0.25::DOUBLE*gn+0.15::DOUBLE*rn+0.10::DOUBLE*dz+0.15::DOUBLE*an+0.20::DOUBLE*dn"
    b[f"{p}_base"] = f"""
SELECT *, {r('hz')} AS hour_zscore, {r('gn')} AS geo_novelty, {r('rn')} AS resource_novelty, {r('dz')} AS duration_zscore,
  an AS auth_method_novelty, {r('dn')} AS device_novelty, {r('speed', 2)} AS geo_velocity_kmh,
  {r(clip('0.0::DOUBLE+' + weights))} AS baseline_score FROM {p}_base_full"""


def travel(source: str) -> str:
    return f"""
SELECT session_id, entity_id, km, CASE WHEN gap>0 AND km IS NOT NULL THEN km/(gap/3600000000.0::DOUBLE) ELSE 0.0 END AS kmh FROM (
  SELECT session_id, entity_id, gap, CASE WHEN s1 IS NOT NULL THEN 12742.0::DOUBLE*asin(least(1.0::DOUBLE, sqrt(s1*s1+cos(radians(lat0))*cos(radians(lat))*s2*s2))) END AS km FROM (
    SELECT session_id, entity_id, us-lag(us) OVER w AS gap, lat, lon, lag(lat) OVER w AS lat0,
      sin(radians(lat-lag(lat) OVER w)/2) AS s1, sin(radians(lon-lag(lon) OVER w)/2) AS s2
    FROM {source} WINDOW w AS (PARTITION BY entity_id ORDER BY us, session_id)))"""


# The same events with every seventh place unknown.
BLOCKS["lost"] = """
SELECT * REPLACE (CASE WHEN k%7=0 THEN 'Atlantis, ZZ' ELSE geo END AS geo, CASE WHEN k%7<>0 THEN lat END AS lat,
  CASE WHEN k%7<>0 THEN lon END AS lon) FROM access"""
profile_blocks("a", "access", 20)
profile_blocks("w", "lost", 20)
BLOCKS["lost_moved"] = travel("lost")
profile_blocks("o", "purchase", 1461)


def sequence_blocks(p: str, normal: str) -> None:
    b = BLOCKS
    b[f"{p}_chunk"] = f"""
SELECT session_id, entity_id, entity_type, us, res, rn, (rn-1)//10 AS chunk, (rn-1)%10 AS pos,
  count(*) OVER (PARTITION BY entity_id, (rn-1)//10) AS len
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY us, session_id) AS rn FROM {normal})"""
    b[f"{p}_step"] = f"""
SELECT entity_type, entity_id, pos, res AS cur, lag(res) OVER (PARTITION BY entity_id, chunk ORDER BY rn) AS prev
FROM {p}_chunk WHERE len>=2"""
    b[f"{p}_pairs"] = f"""
SELECT entity_type, prev, cur, count(*)::BIGINT AS c FROM {p}_step WHERE prev IS NOT NULL GROUP BY ALL"""
    b[f"{p}_state"] = f"""
SELECT v.entity_type, v.res, coalesce(t.t,0)::BIGINT AS t, coalesce(i.i,0)::BIGINT AS starts
FROM (SELECT DISTINCT entity_type, cur AS res FROM {p}_step) v
LEFT JOIN (SELECT entity_type, prev AS res, sum(c) AS t FROM {p}_pairs GROUP BY ALL) t USING (entity_type, res)
LEFT JOIN (SELECT entity_type, cur AS res, count(*) AS i FROM {p}_step WHERE pos=0 GROUP BY ALL) i USING (entity_type, res)"""
    b[f"{p}_stat"] = f"""
SELECT entity_type, count(DISTINCT cur)::BIGINT AS v, (count(*) FILTER (WHERE pos=0))::BIGINT AS n_seq FROM {p}_step GROUP BY ALL"""


sequence_blocks("a", "a_norm")
# Some entities change their type half-way; their runs stay with the first one.
BLOCKS["mixed"] = f"""
SELECT * REPLACE (first_value(kind) OVER (PARTITION BY entity_id ORDER BY us, session_id) AS entity_type) FROM (
  SELECT *, CASE WHEN user_of%7=0 AND us-(SELECT min(us) FROM a_norm)>10*{DAY} THEN 'edge_device' ELSE entity_type END AS kind
  FROM (SELECT *, entity_id AS user_of FROM a_norm))"""
sequence_blocks("m", "mixed")
BLOCKS["turns"] = """
SELECT conv_id*1000+turn AS session_id, conv_id AS entity_id, 'conversation' AS entity_type, turn AS us, role AS res FROM conversations"""
sequence_blocks("c", "turns")

BLOCKS["a_rate"] = f"SELECT entity_id, (count(*) FILTER (WHERE {OFF}))/count(*)::DOUBLE AS rate FROM a_norm GROUP BY ALL"


def smooth(c: str, t: str, v: str = "v") -> str:
    return f"ln(greatest(({c}+1e-4)/({t}+1e-4*{v}),1e-10))"


def log_block(source: str) -> str:
    return f"""
SELECT x.session_id, x.entity_id, x.us, x.rn,
  CASE WHEN x.prev IS NOT NULL THEN CASE WHEN f.t IS NOT NULL AND g.t IS NOT NULL THEN {smooth('coalesce(p.c,0)', 'f.t')}
    ELSE ln(1e-4/(1e-4*v)) END END AS lt,
  CASE WHEN g.t IS NOT NULL THEN {smooth('g.starts', 'n_seq')} ELSE ln(1.0::DOUBLE/v) END AS li
FROM (SELECT *, lag(res) OVER w AS prev, row_number() OVER w AS rn FROM {source} WINDOW w AS (PARTITION BY entity_id ORDER BY us, session_id)) x
LEFT JOIN a_stat USING (entity_type)
LEFT JOIN a_pairs p ON p.entity_type=x.entity_type AND p.prev=x.prev AND p.cur=x.res
LEFT JOIN a_state f ON f.entity_type=x.entity_type AND f.res=x.prev
LEFT JOIN a_state g ON g.entity_type=x.entity_type AND g.res=x.res"""


def window_block(logs: str) -> str:
    return f"""
SELECT session_id, CASE WHEN rn>=2 THEN -(first_value(li) OVER (PARTITION BY entity_id ORDER BY rn ROWS 9 PRECEDING)
  + sum(lt) OVER (PARTITION BY entity_id ORDER BY rn ROWS 8 PRECEDING))/least(rn,10) ELSE 0.0 END AS nll FROM {logs}"""


BLOCKS["a_log"] = log_block("a_test")
BLOCKS["all_log"] = log_block("access")
BLOCKS["a_nll"] = "SELECT session_id, coalesce(-lt,0.0::DOUBLE) AS nll FROM a_log"
BLOCKS["a_window_nll"] = window_block("a_log")
BLOCKS["all_window_nll"] = window_block("all_log")


def low_slow_block(frame: str, source: str = "a_test") -> str:
    return f"""
SELECT session_id, CASE WHEN {OFF} THEN {clip("(cnt/greatest(1.0::DOUBLE, coalesce(rate,0.1)*50*7)-1.0)/3.0")} ELSE 0.0 END AS ls, cnt
FROM (SELECT *, (count(*) FILTER (WHERE {OFF}) OVER (PARTITION BY entity_id ORDER BY {frame}))::BIGINT AS cnt FROM {source})
LEFT JOIN a_rate USING (entity_id)"""


BLOCKS["a_ls_cum"] = low_slow_block("us, session_id ROWS UNBOUNDED PRECEDING")
BLOCKS["a_ls_7d"] = low_slow_block(f"us RANGE BETWEEN 7*{DAY} PRECEDING AND CURRENT ROW")
BLOCKS["all_ls_7d"] = low_slow_block(f"us RANGE BETWEEN 7*{DAY} PRECEDING AND CURRENT ROW", "access")


def fail_block(source: str, width: int) -> str:
    return f"""
SELECT session_id, CASE WHEN result='fail' THEN count(*) FILTER (WHERE result='fail') OVER
  (PARTITION BY entity_id ORDER BY us RANGE BETWEEN {width} PRECEDING AND {width} FOLLOWING) ELSE 0 END::BIGINT AS fails FROM {source}"""


def ip_block(source: str, width: int, at_least: int = 3) -> str:
    return f"""
SELECT session_id, CASE WHEN count(*) OVER (PARTITION BY ip)>={at_least} THEN count(DISTINCT entity_id) OVER
  (PARTITION BY ip ORDER BY us RANGE BETWEEN {width} PRECEDING AND {width} FOLLOWING) ELSE 0 END::BIGINT AS accounts FROM {source}"""


def first_block(source: str) -> str:
    return f"""
SELECT *, (row_number() OVER (PARTITION BY entity_id, res ORDER BY us, session_id)=1)::INT AS first_flag FROM {source}"""


def breadth_block(source: str) -> str:
    return f"""
SELECT session_id, first_flag, (sum(first_flag) OVER (PARTITION BY entity_id ORDER BY us RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW))::BIGINT AS breadth
FROM {source}"""


def growth_block(source: str) -> str:
    return f"""
SELECT entity_id, least(5.0::DOUBLE, (count(*) FILTER (WHERE f>s+7*{DAY}))/greatest(count(*) FILTER (WHERE f<=s+7*{DAY}),1)::DOUBLE) AS growth
FROM (SELECT *, min(f) OVER (PARTITION BY entity_id) AS s FROM (SELECT entity_id, res, min(us) AS f FROM {source} GROUP BY ALL)) GROUP BY entity_id"""


for tag, source in (("all", "access"), ("t", "a_test")):
    BLOCKS[f"{tag}_fail"] = fail_block(source, DAY)
    BLOCKS[f"{tag}_ip"] = ip_block(source, 30 * MINUTE)
    BLOCKS[f"{tag}_first"] = first_block(source)
    BLOCKS[f"{tag}_breadth"] = breadth_block(f"{tag}_first")
    BLOCKS[f"{tag}_growth"] = growth_block(source)

SCORES = f"""
SELECT b.*, {r('nll')} AS markov_nll, {r('least(nll/15.0,1.0::DOUBLE)')} AS markov_score, {r('ls')} AS low_slow_score,
  {r('0.7::DOUBLE*least(nll/15.0,1.0::DOUBLE)+0.3::DOUBLE*ls')} AS sequence_score,
  fails::DOUBLE AS failed_auth_count_5min, accounts::DOUBLE AS distinct_entities_from_ip_5min, breadth::DOUBLE AS resource_breadth_new_1hr,
  device_novelty AS fingerprint_mismatch, {r('ls')} AS offhours_access_trend_7d, growth AS privilege_footprint_growth_30d
FROM {{base}} b JOIN a_nll USING (session_id) JOIN a_ls_cum USING (session_id) JOIN t_fail USING (session_id)
JOIN t_ip USING (session_id) JOIN t_breadth USING (session_id) JOIN t_growth USING (entity_id)"""

RISKY = f"""
SELECT *, {r(clip('0.55::DOUBLE*baseline_score+0.45::DOUBLE*sequence_score'))} AS risk_score,
  (0.6::DOUBLE*baseline_score+0.4::DOUBLE*sequence_score)>0.15::DOUBLE AS flagged,
  CASE WHEN geo_velocity_kmh>1000 THEN 'geo_velocity_exceeded' WHEN failed_auth_count_5min>=4 THEN 'failed_auth_burst'
    WHEN distinct_entities_from_ip_5min>=3 THEN 'multi_entity_same_ip'
    WHEN fingerprint_mismatch>0.5 AND baseline_score>0.3::DOUBLE THEN 'fingerprint_mismatch' END AS rule FROM {{scores}}"""

for tag, base in (("", "a_base"), ("w_", "w_base")):
    BLOCKS[f"{tag}scores"] = SCORES.format(base=base)
    BLOCKS[f"{tag}risky"] = RISKY.format(scores=f"{tag}scores")

BLOCKS["scored"] = """
SELECT *, CASE WHEN flagged THEN rule END AS rule_fired,
  CASE CASE WHEN flagged THEN rule END WHEN 'geo_velocity_exceeded' THEN 'impossible_travel' WHEN 'failed_auth_burst' THEN 'brute_force'
    WHEN 'multi_entity_same_ip' THEN 'credential_stuffing' WHEN 'fingerprint_mismatch' THEN 'device_spoofing' ELSE 'normal' END AS predicted_type,
  CASE CASE WHEN flagged THEN rule END WHEN 'geo_velocity_exceeded' THEN 0.92 WHEN 'failed_auth_burst' THEN 0.95
    WHEN 'multi_entity_same_ip' THEN 0.90 WHEN 'fingerprint_mismatch' THEN 0.88 ELSE 1.0 END::DOUBLE AS confidence FROM risky"""

BLOCKS["alerts"] = "SELECT * FROM scored WHERE risk_score>0.18::DOUBLE OR predicted_type<>'normal'"


def contributions(weight: str = "0.05::DOUBLE") -> str:
    """Ranked contributions per event of a type other than normal."""
    rows = ", ".join(f"({i},'{f}',{weight}*{f})" for i, f in enumerate(C.MODEL_FEATURES))
    return f"""
SELECT session_id, pos, feature, {r('val')} AS value, rank FROM (
  SELECT session_id, pos, feature, val, row_number() OVER (PARTITION BY session_id ORDER BY abs(val) DESC, pos) AS rank
  FROM (SELECT session_id, unnest([{", ".join(f"{{'pos':{i},'feature':'{f}','val':({weight}*{f})::DOUBLE}}" for i, f in enumerate(C.MODEL_FEATURES))}], recursive:=true) FROM scored WHERE predicted_type<>'normal')
) WHERE rank<=5 AND abs(val)>0.001"""


BLOCKS["top5"] = contributions()

BLOCKS["hist"] = """
SELECT *, sum(n) OVER (ORDER BY score DESC) AS cum_n, sum(tp) OVER (ORDER BY score DESC) AS cum_tp FROM (
  SELECT risk_score AS score, count(*) AS n, count(*) FILTER (WHERE label<>'normal') AS tp FROM scored GROUP BY ALL)"""


def pr_block(hist: str) -> str:
    return f"""
SELECT sum((rec-coalesce(prec_rec,0.0))*(prec+coalesce(prev_prec,1.0))/2) AS pr_auc FROM (
  SELECT prec, rec, lag(rec) OVER (ORDER BY score DESC) AS prec_rec, lag(prec) OVER (ORDER BY score DESC) AS prev_prec FROM (
    SELECT score, cum_tp/cum_n::DOUBLE AS prec, cum_tp/(SELECT sum(tp) FROM {hist})::DOUBLE AS rec FROM {hist}))"""


BLOCKS["auc"] = pr_block("hist")
BLOCKS["doc_hist"] = f"""
SELECT *, sum(n) OVER (ORDER BY score DESC) AS cum_n, sum(tp) OVER (ORDER BY score DESC) AS cum_tp FROM (
  SELECT {r(clip('n_chars/20000.0::DOUBLE'))} AS score, count(*) AS n, sum(toxic) AS tp FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL)"""

BLOCKS["budget"] = f"""
SELECT b AS budget, k::BIGINT AS top_k_count, {r('hits/k::DOUBLE')} AS precision, {r('hits/greatest(1,pos)::DOUBLE')} AS recall FROM (
  SELECT b, k, any_value(pos) AS pos, count(*) FILTER (WHERE rk<=k AND label<>'normal') AS hits FROM (
    SELECT label, row_number() OVER (ORDER BY risk_score DESC, session_id) AS rk, count(*) OVER () AS n, count(*) FILTER (WHERE label<>'normal') OVER () AS pos FROM scored),
  (SELECT unnest([0.005::DOUBLE,0.01::DOUBLE,0.03::DOUBLE]) AS b), LATERAL (SELECT greatest(1,floor(n*b)) AS k) GROUP BY b, k)"""

BLOCKS["slices"] = f"""
SELECT c AS is_cold_start, (count(*) FILTER (WHERE session_id IS NOT NULL))::BIGINT AS n_events,
  {r("coalesce((count(*) FILTER (WHERE label<>'normal' AND risk_score>0.2::DOUBLE))/nullif(count(*) FILTER (WHERE risk_score>0.2::DOUBLE),0)::DOUBLE,0.0)")} AS precision,
  {r("coalesce((count(*) FILTER (WHERE label<>'normal' AND risk_score>0.2::DOUBLE))/nullif(count(*) FILTER (WHERE label<>'normal'),0)::DOUBLE,0.0)")} AS recall
FROM (VALUES (false),(true)) s(c) LEFT JOIN scored ON cold=c GROUP BY c"""

BLOCKS["shares"] = f"""
SELECT side, value, n::BIGINT AS n, {r("n*100.0/sum(n) OVER (PARTITION BY side)", 2)} AS pct FROM (
  SELECT 'predicted' AS side, predicted_type AS value, count(*) AS n FROM scored GROUP BY ALL
  UNION ALL SELECT 'actual', label, count(*) FROM scored GROUP BY ALL)"""

BLOCKS["metrics"] = f"""
SELECT 'total_test_events' AS metric, '' AS key, count(*)::DOUBLE AS value FROM scored
UNION ALL SELECT 'total_alerts_generated', '', count(*)::DOUBLE FROM alerts
UNION ALL SELECT 'pr_auc', '', {r('pr_auc')} FROM auc
UNION ALL SELECT 'top_k_count', 'top_'||printf('%.1f',budget*100)||'%', top_k_count::DOUBLE FROM budget
UNION ALL SELECT 'budget_precision', 'top_'||printf('%.1f',budget*100)||'%', precision FROM budget
UNION ALL SELECT 'budget_recall', 'top_'||printf('%.1f',budget*100)||'%', recall FROM budget
UNION ALL SELECT 'slice_events', CASE WHEN is_cold_start THEN 'cold_start' ELSE 'warm' END, n_events::DOUBLE FROM slices
UNION ALL SELECT 'slice_precision', CASE WHEN is_cold_start THEN 'cold_start' ELSE 'warm' END, precision FROM slices
UNION ALL SELECT 'slice_recall', CASE WHEN is_cold_start THEN 'cold_start' ELSE 'warm' END, recall FROM slices
UNION ALL SELECT 'attack_distribution_'||side, value, n::DOUBLE FROM shares"""


def drift_blocks(p: str, source: str, window_days: int, model: str | None = None, end: str | None = None) -> None:
    """Drift of ``source`` against the profiles ``model``, in the days before ``end``."""
    b = BLOCKS
    model, end = model or p, end or f"(SELECT max(us) FROM {p}_test)"
    b[f"{p}_recent"] = (
        f"SELECT * FROM {source} WHERE label='normal' AND us>={end}-{window_days}*{DAY} AND us<{end}"
    )
    b[f"{p}_rvals"] = f"""
SELECT entity_id, 'resource' AS attr, res AS value, count(*) AS n, min(us) AS first_us FROM {p}_recent GROUP BY ALL
UNION ALL SELECT entity_id, 'geo', geo, count(*), min(us) FROM {p}_recent GROUP BY ALL
UNION ALL SELECT entity_id, 'auth', auth, count(*), min(us) FROM {p}_recent GROUP BY ALL"""
    b[f"{p}_new"] = f"""
SELECT * FROM {p}_rvals r WHERE attr IN ('resource','geo') AND NOT EXISTS
  (SELECT 1 FROM {model}_val_e v WHERE v.entity_id=r.entity_id AND v.attr=r.attr AND v.value=r.value)"""
    b[f"{p}_drift"] = f"""
SELECT entity_id, n_recent, new_resources, new_geos,
  n_recent>=3 AND (new_resources/greatest(old_resources,1)::DOUBLE>0.3::DOUBLE OR new_geos>0 OR main IS DISTINCT FROM recent_main) AS is_drift_flagged FROM (
  SELECT e.entity_id, main,
    (SELECT count(*) FROM {p}_recent r WHERE r.entity_id=e.entity_id) AS n_recent,
    (SELECT count(*) FROM {p}_new w WHERE w.entity_id=e.entity_id AND attr='resource') AS new_resources,
    (SELECT count(*) FROM {p}_new w WHERE w.entity_id=e.entity_id AND attr='geo') AS new_geos,
    (SELECT count(*) FROM {model}_val_e v WHERE v.entity_id=e.entity_id AND attr='resource') AS old_resources, recent_main
  FROM {model}_auth_e e LEFT JOIN (SELECT entity_id, value AS recent_main FROM {p}_rvals WHERE attr='auth'
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, first_us, value)=1) USING (entity_id))"""


drift_blocks("a", "access", 14)
drift_blocks("o", "purchase", 2000)
# Whole days: the window ends at the last midnight.
drift_blocks("d", "access", 14, "a", f"(SELECT max(us)//{DAY}*{DAY} FROM access)")

BLOCKS["all_moved"] = travel("access")
BLOCKS["doc_auc"] = pr_block("doc_hist")
BLOCKS["o_first"] = first_block("purchase")

WORD = re.compile(r"[a-z_0-9]+")


def assemble(select: str) -> str:
    """Prefix a SELECT with the building blocks it uses, in order of dependence."""
    order: list[str] = []

    def need(text: str, inside: str = "") -> None:
        for name in WORD.findall(text):
            if name in BLOCKS and name not in order and name != inside:
                need(BLOCKS[name], name)
                if name not in order:
                    order.append(name)

    need(select)
    if not order:
        return select
    blocks = ",\n".join(f"{name} AS MATERIALIZED ({BLOCKS[name]})" for name in order)
    return f"WITH {blocks}\n{select}"
