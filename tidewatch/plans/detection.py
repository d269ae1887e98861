"""The detection run: learn from the first days, score and explain the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import alerts as A, classify as K, explain, features, profiles, scoring, sequence
from tidewatch.session import materialize, together
from tidewatch.settings import DAY, Settings


def score_events(
    frame: DataFrame,
    model: profiles.ProfileModel,
    sequences: sequence.SequenceTables,
    s: Settings = Settings(),
) -> DataFrame:
    """All scores and features of the events of one frame.

    Sliding counts, previous events and first uses refer to this frame only.
    The events are exchanged by address once and by entity once; everything
    else is lookups in fitted tables and column arithmetic.
    """
    hot = features.find_hot(frame)
    on_ip = features.ip_concurrency(frame, s.ip_window, hot=hot["ip"], hot_pairs=hot["pairs"])
    context = features.entity_context(on_ip, sequences.rates, s, hot["entity"], frame)
    # Lookups by entity come first, while the rows are still partitioned by it.
    based = scoring.baseline_scores(context, model, s, hot["entity"], frame)
    # The steps to look up follow from a few columns of the frame.
    narrow = frame.select("entity_id", "entity_type", *features.ORDER, "resource_accessed")
    steps = features.with_previous_resource(narrow, hot["entity"])
    stepped = sequence.markov_last_transition(based, sequences, hot["entity"], steps)
    combined = scoring.sequence_score(F.col("markov_raw"), F.col("low_slow_raw"))
    scored = stepped.withColumns(
        {
            "sequence_score": S.round4(combined),
            "low_slow_score": S.round4(F.col("low_slow_raw")),
            "offhours_access_trend_7d": S.round4(F.col("low_slow_raw")),
            "fingerprint_mismatch": F.col("device_novelty"),
            "distinct_entities_from_ip_5min": F.col("distinct_entities_from_ip_5min").cast("double"),
        }
    ).drop("markov_raw", "low_slow_raw", "prev_resource", "profile_source", "prev_us", "at", "prev_at")
    return scored.withColumn("risk_score", scoring.risk_score(F.col("baseline_score"), F.col("sequence_score")))


@dataclass(frozen=True)
class Detection:
    events: DataFrame
    scored: DataFrame
    alerts: DataFrame
    drift: DataFrame
    profiles: profiles.ProfileModel
    sequences: sequence.SequenceTables
    classifier: K.Classifier | None


def fit_tables(train: DataFrame):
    """Profiles and sequence model of the normal events among the training events."""
    normal = profiles.label_filter(train)
    hot = features.find_hot_keys(normal, ["entity_id"])
    return together(lambda: profiles.fit_profiles(normal), lambda: sequence.fit_sequences(normal, hot))


def training_scores(train: DataFrame, model, sequences, s: Settings) -> DataFrame:
    """Scores of the training attacks; their windows see attacks only."""
    return score_events(profiles.label_filter(train, normal=False), model, sequences, s)


def detect(events: DataFrame, s: Settings = Settings(), learn: bool = True) -> Detection:
    """Fit on the first ``train_days`` days, then score, classify and explain the rest.

    The events are read many times; if they come from a view that costs something,
    such as parsed text, store them first (:func:`materialize`).
    ``learn=False`` leaves out the forest: flagged events that no rule decides
    then stay normal, as they do when there are too few attacks to learn from.
    """
    # One pass for the bounds; as literals they cost the many later actions nothing.
    begin, end = events.agg(F.min("event_us"), F.max("event_us")).first()
    if begin is None:
        raise ValueError("there are no events to learn from")
    train, test = profiles.split_at(events, F.lit(begin + s.train_days * DAY))
    model, sequences = fit_tables(train)
    classifier = None
    if learn:
        classifier = K.fit_classifier(materialize(training_scores(train, model, sequences, s), "training"))
    scored = score_events(test, model, sequences, s)
    if classifier is not None:
        scored = materialize(scored, "scores")
    explained = explain.explanations(K.classify(scored, classifier))
    flags = profiles.drift_flags(events, model, F.lit(end), s)
    scored, drift = together(
        lambda: materialize(explained, "scored_events"), lambda: materialize(flags, "drift")
    )
    picked = materialize(A.with_drift(A.select_alerts(scored), drift), "alerts")
    return Detection(events, scored, picked, drift, model, sequences, classifier)
