"""Sub-scores, combined scores and the gate, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import constants as C
from tidewatch.functions import scalars as S
from tidewatch.operators.features import is_impossible, travelled, with_previous
from tidewatch.operators.profiles import ProfileModel, profile_lookup, value_counts
from tidewatch.operators.timeline import HotKeys
from tidewatch.settings import Settings


def hour_zscore(hour: Column, mean: Column, std: Column) -> Column:
    """Distance from the usual hour around the clock, in standard deviations."""
    gap = F.abs(hour - mean)
    z = F.least(gap / std, F.abs(F.lit(24) - gap) / std)
    return S.at_most(F.when(std < 0.5, 0.0).otherwise(z) / C.Z_CAP, 1.0)


def duration_zscore(duration: Column, mean: Column, std: Column) -> Column:
    z = F.abs(duration - mean) / std
    return S.at_most(F.when(std < 1.0, 0.0).otherwise(z) / C.Z_CAP, 1.0)


def unseen(count: Column) -> Column:
    return F.when(count > 0, 0.0).otherwise(1.0)


def baseline_scores(
    events: DataFrame,
    model: ProfileModel,
    s: Settings = Settings(),
    hot: HotKeys | None = None,
    frame: DataFrame | None = None,
) -> DataFrame:
    """Score each event against its profile.

    Expects ``prev_us``, ``at`` and ``prev_at`` (see :func:`with_previous`) when
    velocity is used.  Adds the six sub-scores, ``is_cold_start``,
    ``geo_velocity_kmh`` and ``baseline_score``, all rounded.  ``frame`` is the same
    events before any derived columns (see :func:`value_counts`).
    """
    if s.use_velocity and "prev_us" not in events.columns:
        events = with_previous(events, hot)
    # In a frame of events the previous one comes from a window by entity.
    placed = s.use_velocity and frame is not None
    found = value_counts(profile_lookup(events, model, s, hot, placed), model, hot, frame)
    has_profile = F.col("profile_source").isNotNull()
    duration = F.col("session_duration").cast("double")
    damping = F.when(F.col("is_cold_start"), C.COLD_DAMPING).otherwise(1.0)

    if s.use_velocity:
        found = travelled(found)
        speed = F.when(F.col("profile_source") == "entity", F.col("kmh")).otherwise(0.0)
        jump = is_impossible(speed, F.col("km"))
        geo_novelty = F.when(
            jump, F.greatest(unseen(F.col("geo_n")), F.lit(C.IMPOSSIBLE_GEO_NOVELTY))
        ).otherwise(unseen(F.col("geo_n")))
    else:
        speed, geo_novelty = F.lit(0.0), unseen(F.col("geo_n"))

    novel_auth = F.when(F.col("auth_method").eqNullSafe(F.col("primary_auth_method")), 0.0).otherwise(1.0)
    parts = {
        "hour_zscore": hour_zscore(F.col("hour"), F.col("hour_mean"), F.col("hour_std")),
        "geo_novelty": geo_novelty * damping,
        "resource_novelty": (1.0 - F.col("resource_n") / F.col("n_observed_events")) * damping,
        "duration_zscore": duration_zscore(
            duration, F.col("session_duration_mean"), F.col("session_duration_std")
        ),
        "auth_method_novelty": novel_auth,
        "device_novelty": unseen(F.col("device_n")) * damping,
    }
    scored = found.withColumns(
        {name: F.when(has_profile, value).otherwise(0.0) for name, value in parts.items()}
        | {"geo_velocity_kmh": S.round_to(F.when(has_profile, speed).otherwise(0.0), 2)}
    )
    total = sum((F.lit(w) * F.col(name) for name, w in C.BASELINE_WEIGHTS.items()), F.lit(0.0))
    combined = F.when(has_profile, S.clip01(total)).otherwise(C.NO_PROFILE_SCORE)
    scored = scored.withColumn("baseline_score", S.round4(combined))
    return scored.withColumns({name: S.round4(F.col(name)) for name in parts}).drop(
        "n_observed_events", "hour_mean", "hour_std", "session_duration_mean",
        "session_duration_std", "primary_auth_method", "geo_n", "device_n", "resource_n",
        "prev_us", "at", "prev_at", "km", "kmh",
    )


def sequence_score(markov: Column, low_slow: Column) -> Column:
    return F.lit(C.MARKOV_WEIGHT) * markov + F.lit(C.LOW_SLOW_WEIGHT) * low_slow


def risk_score(baseline: Column, sequence: Column) -> Column:
    """Combined risk, from the rounded scores."""
    b, q = C.RISK_WEIGHTS
    return S.round4(S.clip01(F.lit(b) * baseline + F.lit(q) * sequence))


def flag_gate(baseline: Column, sequence: Column) -> Column:
    """Whether an event is classified at all."""
    b, q = C.GATE_WEIGHTS
    return (F.lit(b) * baseline + F.lit(q) * sequence) > C.GATE_THRESHOLD


def score_distribution(scores: DataFrame, score: str = "baseline_score", by: str = "label") -> DataFrame:
    """Mean, spread, median and maximum per label."""
    value = F.col(score)
    return scores.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        S.round4(F.avg(value)).alias("mean"),
        S.round4(F.stddev_samp(value)).alias("std"),
        S.round4(F.percentile(value, 0.5)).alias("median"),
        F.max(value).alias("max"),
    )


def separation_ratio(scores: DataFrame, score: str = "baseline_score") -> DataFrame:
    """Mean score of attacks over mean score of normal events."""
    normal = F.col("label") == C.NORMAL
    return scores.agg(
        F.avg(F.when(~normal, F.col(score))).alias("attack"),
        F.avg(F.when(normal, F.col(score))).alias("normal"),
    ).select(
        S.round4(F.col("attack")).alias("attack_mean"),
        S.round4(F.col("normal")).alias("normal_mean"),
        S.round_to(F.col("attack") / F.greatest(F.col("normal"), F.lit(0.001)), 2).alias("separation"),
    )
