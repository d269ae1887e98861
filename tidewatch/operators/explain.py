"""Readable explanations of classified events, as string expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import constants as C
from tidewatch.functions import scalars as S
from tidewatch.operators.classify import raw_features


def rule_text() -> Column:
    """The text of the rule that fired, with the event's own values in it."""

    def count(name: str) -> Column:
        return F.col(name).cast("long").cast("string")

    values = {
        "speed": S.whole_number(F.col("geo_velocity_kmh")),
        "place": F.col("geo_location"),
        "failures": count("failed_auth_count_5min"),
        "accounts": count("distinct_entities_from_ip_5min"),
        "address": F.col("source_ip"),
        "device": F.substring("device_fingerprint", 1, 30),
        "entity": F.col("entity_id").cast("string"),
    }
    rule = F.col("rule_fired")
    texts = []
    for name, template in C.RULE_TEXTS.items():
        parts = []
        for text, field, _, _ in Formatter().parse(template):
            parts += [F.lit(text)] + ([values[field]] if field else [])
        texts.append(F.when(rule == name, F.concat(*parts)))
    other = F.when(rule.isNotNull(), F.concat(F.lit("Rule '"), rule, F.lit("' triggered for this event")))
    return F.coalesce(*texts, other)


def feature_text(feature: Column, value: Column) -> Column:
    """Phrase of one contributing feature, with its contribution where that reads well."""
    phrase = S.feature_phrase(feature)
    counted = feature.isin(
        "failed_auth_count_5min", "distinct_entities_from_ip_5min", "resource_breadth_new_1hr"
    )
    return (
        F.when(
            feature == "geo_velocity_kmh",
            F.concat(phrase, F.lit(" ("), S.whole_number(value), F.lit(" km/h)")),
        )
        .when(counted, F.concat(value.cast("long").cast("string"), F.lit(" "), phrase))
        .when(
            feature.isin("hour_zscore", "duration_zscore"),
            F.concat(phrase, F.lit(" (z="), S.one_decimal(value), F.lit(")")),
        )
        .otherwise(phrase)
    )


def model_text(raw: bool = False) -> Column:
    """Top three contributions followed by what the attack type means.

    ``raw`` prints the features' own values in place of the contributions.
    """
    described = F.try_element_at(S.text_map(C.ATTACK_DESCRIPTIONS), F.col("predicted_type"))
    plain = F.coalesce(described, F.concat(F.lit("Classified as "), F.col("predicted_type")))
    top = F.slice(raw_features() if raw else F.col("top_features"), 1, 3)
    reasons = F.array_join(F.transform(top, lambda f: feature_text(f["feature"], f["value"])), " + ")
    suffix = F.coalesce(F.concat(F.lit(". "), described), F.lit(""))
    return F.when(F.size(top) == 0, plain).otherwise(F.concat(F.lit("Flagged due to "), reasons, suffix))


def explanations(classified: DataFrame, raw: bool = False) -> DataFrame:
    """Adds ``explanation_text``; empty for normal events."""
    text = F.when(F.col("predicted_type") == C.NORMAL, "").otherwise(F.coalesce(rule_text(), model_text(raw)))
    return classified.withColumn("explanation_text", text)
