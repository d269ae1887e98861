"""Selecting, querying and summarising alerts and profiled entities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch import constants as C
from tidewatch.functions import scalars as S
from tidewatch.operators.histogram import top_pct_threshold

MAX_PAGE = 200  # entities of one page, whose ids are broadcast

ALERT_COLUMNS = [
    "session_id", "entity_id", "entity_type", "event_time", "source_ip", "geo_location",
    "resource_accessed", "auth_method", "auth_result", "session_duration", "device_fingerprint",
    "risk_score", "predicted_type", "predicted_type_confidence", "top_features",
    "explanation_text", "is_cold_start", "is_drift_flagged",
]


def select_alerts(scored: DataFrame) -> DataFrame:
    """Events above the risk threshold or of a type other than normal."""
    return scored.filter((F.col("risk_score") > C.ALERT_THRESHOLD) | (F.col("predicted_type") != C.NORMAL))


def with_drift(alerts: DataFrame, drift: DataFrame) -> DataFrame:
    """Attach the drift flag of each alert's entity; unprofiled entities have none."""
    flags = drift.select("entity_id", "is_drift_flagged")
    flagged = F.coalesce(F.col("is_drift_flagged"), F.lit(False))
    return alerts.join(flags, "entity_id", "left").withColumn("is_drift_flagged", flagged)


def drift_of_alerted(drift: DataFrame, alerts: DataFrame) -> DataFrame:
    """Drift is of interest only for entities that have alerts."""
    return drift.join(alerts, "entity_id", "left_semi")


def alert_queue(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("risk_score"), "session_id")


@dataclass(frozen=True)
class AlertFilter:
    """Conditions of the alert list; ``search`` is a pattern, not plain text."""

    top_pct: float | None = None
    min_risk: float = 0.0
    attack_type: str | None = None
    search: str | None = None


def alert_filter(alerts: DataFrame, f: AlertFilter, scored: DataFrame | None = None) -> DataFrame:
    out = alerts
    if f.top_pct is not None:
        if scored is None:
            raise ValueError("a top share needs the scored events it refers to")
        threshold = top_pct_threshold(scored, f.top_pct).select("threshold").scalar()
        out = out.filter(F.col("risk_score") >= threshold)
    if f.min_risk > 0:
        out = out.filter(F.col("risk_score") >= f.min_risk)
    if f.attack_type and f.attack_type != "all":
        out = out.filter(F.col("predicted_type") == f.attack_type)
    if f.search:
        pattern = F.lit(f.search.lower())
        hit = F.lit(False)
        for name in ("entity_id", "source_ip", "resource_accessed"):
            hit = hit | F.rlike(F.lower(F.col(name).cast("string")), pattern)
        out = out.filter(hit)
    return out


def page_of(df: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def scores_of_page(matching: DataFrame, page: int, limit: int) -> tuple[float, float, int, int] | None:
    """Highest and lowest risk on a page, how many rows are above the highest, and how many match at all.

    From the histogram of the risk, which has at most 10,001 values however many rows match.
    """
    skip = (page - 1) * limit
    bins = matching.groupBy("risk_score").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("risk_score")))
    above = F.col("upto") - F.col("n")
    hit = (F.col("upto") > skip) & (above < skip + limit)
    score = F.when(hit, F.col("risk_score"))
    high, low, before, total = bins.withColumn("upto", upto).agg(F.max(score), F.min(score), F.min(F.when(hit, above)), F.sum("n")).first()
    return None if high is None else (high, low, before, total)


def alerts_page(
    alerts: DataFrame, scored: DataFrame, f: AlertFilter = AlertFilter(), page: int = 1, limit: int = 20
) -> DataFrame:
    """One page of the queue, each row with the number of matching alerts.

    The page's scores are looked up first; only rows with those scores are put in
    order, so a deep page costs no more than the first one.
    """
    matching = alert_filter(alerts, f, scored)
    found = scores_of_page(matching, page, limit)
    if found is None:
        return matching.limit(0).withColumn("total", F.lit(0).cast("long"))
    high, low, above, total = found
    near = matching.filter(F.col("risk_score").between(low, high))
    rows = near.orderBy(F.desc("risk_score"), "session_id").offset((page - 1) * limit - above).limit(limit)
    return rows.withColumn("total", F.lit(total).cast("long"))


def export_alerts(alerts: DataFrame, scored: DataFrame, f: AlertFilter = AlertFilter()) -> DataFrame:
    """The filtered queue in flat columns, ready to be written as CSV."""
    rows = alert_queue(alert_filter(alerts, f, scored))
    return rows.withColumn("top_features", S.pack_features(F.col("top_features")))


def alert_detail(alerts: DataFrame, scored: DataFrame, session_id) -> DataFrame:
    """The alert with this id or, where there is none, the scored event."""
    wanted = F.col("session_id") == session_id
    mine = alerts.filter(wanted)
    other = scored.filter(wanted).join(mine.select("session_id"), "session_id", "left_anti")
    return mine.unionByName(other, allowMissingColumns=True).limit(1)


def union_alerts(new: DataFrame, alerts: DataFrame) -> DataFrame:
    return new.unionByName(alerts, allowMissingColumns=True)


# --- entities ------------------------------------------------------------------


def entities_with_alert_counts(profiles: DataFrame, alerts: DataFrame) -> DataFrame:
    counts = alerts.groupBy("entity_id").agg(F.count(F.lit(1)).alias("alert_count"))
    return profiles.join(counts, "entity_id", "left").fillna(0, subset=["alert_count"])


def entity_filter(profiles: DataFrame, entity_type: str | None = None, search: str | None = None) -> DataFrame:
    out = profiles
    if entity_type and entity_type != "all":
        out = out.filter(F.col("entity_type") == entity_type)
    if search:
        text = F.lit(search.lower())
        named = F.contains(F.lower(F.col("entity_id").cast("string")), text)
        out = out.filter(named | F.contains(F.lower("entity_type"), text))
    return out


def entities_page(
    profiles: DataFrame, alerts: DataFrame, entity_type: str | None = None,
    search: str | None = None, page: int = 1, limit: int = 20,
) -> DataFrame:
    """One page of entities, 1 to ``MAX_PAGE`` of them.  Alerts are counted for these only."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} entities")
    matching = entity_filter(profiles, entity_type, search)
    total = matching.agg(F.count(F.lit(1))).scalar()
    rows = page_of(matching, [F.col("entity_id")], page, limit)
    mine = alerts.join(F.broadcast(rows.select("entity_id")), "entity_id", "left_semi")
    return entities_with_alert_counts(rows, mine).withColumn("total", total)


def recent_events(scored: DataFrame, entity_id, n: int = 100) -> DataFrame:
    """The entity's last ``n`` events, oldest first."""
    last = (
        scored.filter(F.col("entity_id") == entity_id)
        .orderBy(F.desc("event_us"), F.desc("session_id"))
        .limit(n)
    )
    return last.orderBy("event_us", "session_id")


def entity_detail(profiles: DataFrame, scored: DataFrame, alerts: DataFrame, entity_id) -> dict[str, DataFrame]:
    """Profile, recent events and past alerts of one entity."""
    mine = F.col("entity_id") == entity_id
    return {
        "profile": profiles.filter(mine),
        "recent_events": recent_events(scored, entity_id),
        "past_alerts": alerts.filter(mine),
    }


def entity_record(profiles: DataFrame, scored: DataFrame, alerts: DataFrame, entity_id) -> DataFrame:
    """The entity's detail as one table of ``part, session_id, risk_score``."""
    parts = entity_detail(profiles, scored, alerts, entity_id)
    none = F.lit(None)
    profile = parts["profile"].select(
        F.lit("profile").alias("part"), none.cast("long").alias("session_id"), none.cast("double").alias("risk_score")
    )
    out = profile
    for name in ("recent_events", "past_alerts"):
        out = out.unionByName(parts[name].select(F.lit(name).alias("part"), "session_id", "risk_score"))
    return out


# --- key figures ---------------------------------------------------------------


def kpi_stats(scored: DataFrame, alerts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Totals and alert counts by type as ``kpi, value``."""
    n = F.count(F.lit(1))
    totals = alerts.agg(
        n.alias("total_alerts"),
        F.count_if(F.col("risk_score") >= 0.40).alias("n_high_risk"),
        F.count_if(F.col("is_cold_start")).alias("n_cold_start_alerts"),
    )
    names = ["total_alerts", "n_high_risk", "n_cold_start_alerts"]
    pairs = F.array(*[F.struct(F.lit(x).alias("kpi"), F.col(x).alias("value")) for x in names])
    by_type = alerts.groupBy(F.concat(F.lit("type_"), "predicted_type").alias("kpi")).agg(n.alias("value"))
    return (
        totals.select(F.inline(pairs))
        .unionByName(scored.agg(n.alias("value")).select(F.lit("total_events").alias("kpi"), "value"))
        .unionByName(profiles.agg(n.alias("value")).select(F.lit("total_entities").alias("kpi"), "value"))
        .unionByName(by_type)
    )


def top_threat(alerts: DataFrame) -> DataFrame:
    """Most frequent type other than normal; of equals, the first by name."""
    counts = (
        alerts.filter(F.col("predicted_type") != C.NORMAL)
        .groupBy("predicted_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min_by("predicted_type", F.struct(-F.col("n"), F.col("predicted_type")))
    return counts.agg(
        F.coalesce(best, F.lit("None")).alias("top_threat"),
        F.coalesce(F.max("n"), F.lit(0)).alias("n"),
    )
