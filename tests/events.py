"""Hand-written events for small tests."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

SCHEMA = (
    "session_id long, entity_id string, entity_type string, event_us long, hour int, source_ip string, "
    "geo_location string, resource_accessed string, auth_method string, auth_result string, "
    "session_duration double, device_fingerprint string, label string"
)
DEFAULTS = {
    "entity_id": "u1", "entity_type": "user", "source_ip": "10.0.0.1", "geo_location": "London, UK",
    "resource_accessed": "r1", "auth_method": "password", "auth_result": "success",
    "session_duration": 100.0, "device_fingerprint": "d1", "label": "normal",
}


def us(text: str) -> int:
    stamp = datetime.fromisoformat(text).replace(tzinfo=timezone.utc)
    return round(stamp.timestamp()) * 1_000_000


def events(spark, *rows):
    """Each row is a time (text or microseconds) and the fields that differ from the defaults."""
    out = []
    for i, (at, changes) in enumerate(rows):
        t = us(at) if isinstance(at, str) else at
        hour = (t // 3_600_000_000) % 24
        out.append({"session_id": i, "event_us": t, "hour": int(hour), **DEFAULTS, **changes})
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in out], SCHEMA)
    return df.withColumn("event_time", F.timestamp_micros("event_us"))


def by_id(df, *names):
    rows = df.orderBy("session_id").select(*names).collect()
    return [tuple(r) if len(names) > 1 else r[0] for r in rows]
