"""Thresholds, weights, lookup tables and message texts.

Everything in this file is data that results depend on; no logic lives here.
"""

# --- fixed values: geography -------------------------------------------------
EARTH_RADIUS_KM = 6371.0

CITY_COORDINATES = [
    ("New York, US", 40.7128, -74.0060),
    ("San Francisco, US", 37.7749, -122.4194),
    ("Chicago, US", 41.8781, -87.6298),
    ("London, UK", 51.5074, -0.1278),
    ("Berlin, DE", 52.5200, 13.4050),
    ("Paris, FR", 48.8566, 2.3522),
    ("Tokyo, JP", 35.6762, 139.6503),
    ("Sydney, AU", -33.8688, 151.2093),
    ("Mumbai, IN", 19.0760, 72.8777),
    ("Singapore, SG", 1.3521, 103.8198),
    ("Toronto, CA", 43.6532, -79.3832),
    ("Dubai, AE", 25.2048, 55.2708),
    ("Sao Paulo, BR", -23.5505, -46.6333),
    ("Seoul, KR", 37.5665, 126.9780),
    ("Amsterdam, NL", 52.3676, 4.9041),
    ("Stockholm, SE", 59.3293, 18.0686),
    ("Moscow, RU", 55.7558, 37.6173),
    ("Cape Town, ZA", -33.9249, 18.4241),
    ("Mexico City, MX", 19.4326, -99.1332),
    ("Bangkok, TH", 13.7563, 100.5018),
]

# --- fixed values: labels ----------------------------------------------------
NORMAL = "normal"
ATTACK_LABELS = [
    "brute_force",
    "impossible_travel",
    "credential_stuffing",
    "lateral_movement",
    "device_spoofing",
    "low_and_slow_exfil",
    "insider_drift",
]

# --- fixed values: baseline scoring ------------------------------------------
BASELINE_WEIGHTS = {
    "hour_zscore": 0.15,
    "geo_novelty": 0.25,
    "resource_novelty": 0.15,
    "duration_zscore": 0.10,
    "auth_method_novelty": 0.15,
    "device_novelty": 0.20,
}
Z_CAP = 4.0
NO_PROFILE_SCORE = 0.3
COLD_DAMPING = 0.5
IMPOSSIBLE_KMH = 1000.0
IMPOSSIBLE_KM = 500.0
IMPOSSIBLE_GEO_NOVELTY = 0.9

# --- fixed values: sequence scoring ------------------------------------------
LAPLACE_ALPHA = 1e-4
PROBABILITY_FLOOR = 1e-10
SEQUENCE_LENGTH = 10
MAX_NLL = 15.0
OFF_HOURS = [22, 23, 0, 1, 2, 3, 4, 5]
LOW_SLOW_DAYS = 7
DEFAULT_OFF_HOURS_RATE = 0.1
EVENTS_PER_DAY = 50
MARKOV_WEIGHT = 0.7
LOW_SLOW_WEIGHT = 0.3

# --- fixed values: gates and rules -------------------------------------------
GATE_WEIGHTS = (0.6, 0.4)
GATE_THRESHOLD = 0.15
RISK_WEIGHTS = (0.55, 0.45)
ALERT_THRESHOLD = 0.18
SLICE_THRESHOLD = 0.2
RULE_FAILED_LOGINS = 4
RULE_ENTITIES_PER_IP = 3
RULE_TRAVEL_KMH = 1000.0
RULE_MISMATCH = 0.5
RULE_MISMATCH_BASELINE = 0.3
DRIFT_MIN_EVENTS = 3
DRIFT_RESOURCE_RATIO = 0.3
FOOTPRINT_CAP = 5.0
BUDGETS = [0.005, 0.01, 0.03]
# Percentage points of precision per percent of budget, below and above the measured budgets.
BUDGET_SLOPES = (15.0, 8.5 / 7.0)
BUDGET_PRECISION_FLOOR = 2.5

# --- fixed values: rules in order, with the type and confidence they decide for ----
RULE_VERDICTS = {
    "geo_velocity_exceeded": ("impossible_travel", 0.92),
    "failed_auth_burst": ("brute_force", 0.95),
    "multi_entity_same_ip": ("credential_stuffing", 0.90),
    "fingerprint_mismatch": ("device_spoofing", 0.88),
}
RULE_TEXTS = {
    "geo_velocity_exceeded": "Implied travel speed of {speed} km/h to reach {place} (impossible travel pattern)",
    "failed_auth_burst": "{failures} failed authentication attempts from {address} in a 5-minute window (brute force pattern)",
    "multi_entity_same_ip": "{accounts} different user accounts accessed from {address} in 5 minutes (credential stuffing pattern)",
    "fingerprint_mismatch": "Device fingerprint '{device}...' does not match known devices for {entity} (device spoofing)",
}

# --- fixed values: classifier ------------------------------------------------
BASELINE_FEATURES = [
    "baseline_score",
    "hour_zscore",
    "geo_novelty",
    "resource_novelty",
    "duration_zscore",
    "auth_method_novelty",
    "device_novelty",
]
SEQUENCE_FEATURES = ["sequence_score", "markov_score", "low_slow_score"]
ATTACK_FEATURES = [
    "failed_auth_count_5min",
    "distinct_entities_from_ip_5min",
    "geo_velocity_kmh",
    "resource_breadth_new_1hr",
    "fingerprint_mismatch",
    "offhours_access_trend_7d",
    "privilege_footprint_growth_30d",
]
MODEL_FEATURES = BASELINE_FEATURES + SEQUENCE_FEATURES + ATTACK_FEATURES
DEFAULT_IMPORTANCE = 0.05
MIN_TRAINING_ROWS = 10

# --- fixed values: texts -----------------------------------------------------
FEATURE_PHRASES = {
    "baseline_score": "overall behavioral anomaly score",
    "hour_zscore": "unusual login time",
    "geo_novelty": "access from unfamiliar location",
    "resource_novelty": "access to unusual resource",
    "duration_zscore": "unusual session length",
    "auth_method_novelty": "unusual authentication method",
    "device_novelty": "unrecognized device",
    "sequence_score": "unusual access sequence pattern",
    "markov_score": "unusual resource transition pattern",
    "low_slow_score": "elevated off-hours access trend",
    "failed_auth_count_5min": "failed authentication attempts in 5-min window",
    "distinct_entities_from_ip_5min": "multiple accounts accessed from same IP",
    "geo_velocity_kmh": "implied travel speed between logins",
    "resource_breadth_new_1hr": "new resources accessed in 1-hour window",
    "fingerprint_mismatch": "device fingerprint mismatch",
    "offhours_access_trend_7d": "off-hours access trend over 7 days",
    "privilege_footprint_growth_30d": "privilege/resource footprint expansion",
}

ATTACK_DESCRIPTIONS = {
    "brute_force": "Rapid repeated failed authentication attempts suggesting a brute force attack",
    "impossible_travel": "Login from geographically distant location in an implausibly short time",
    "credential_stuffing": "Multiple user accounts targeted from the same IP addresses",
    "lateral_movement": "Unusual breadth of resource access suggesting lateral movement",
    "device_spoofing": "Device fingerprint does not match known devices for this entity",
    "low_and_slow_exfil": "Gradual off-hours access pattern suggesting slow data exfiltration",
    "insider_drift": "Gradual expansion of resource access footprint beyond typical scope",
}

FEATURE_TITLES = {
    "distinct_entities_from_ip_5min": "Cross-entity IP Concurrency",
    "failed_auth_count_5min": "Failed Auth Velocity (5min)",
    "baseline_score": "Baseline Anomaly Score",
    "resource_novelty": "Resource Access Novelty",
    "geo_novelty": "Geographic Novelty",
    "hour_zscore": "Off-hour Z-Score",
    "duration_zscore": "Session Duration Z-Score",
    "resource_breadth_new_1hr": "Lateral Resource Access (1hr)",
    "geo_velocity_kmh": "Travel Speed (km/h)",
    "offhours_access_trend_7d": "Multi-day Off-hours Rate",
    "privilege_footprint_growth_30d": "Privilege Footprint Growth",
}
