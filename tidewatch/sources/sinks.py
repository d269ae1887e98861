"""Output tables, metrics and models on shared storage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import classify, profiles, sequence

METRICS_SCHEMA = "metric string, key string, value double"


def write_events(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by day, so that queries on a time range read only its days.

    Rebalancing gathers each day's rows into files of a fair size and splits
    days that are too large for one task.
    """
    dated = df.withColumn("event_date", F.to_date("event_time")).hint("rebalance", "event_date")
    dated.write.mode(mode).partitionBy("event_date").parquet(path)


def write_outputs(scored: DataFrame, alerts: DataFrame, exported_profiles: DataFrame, path: str) -> dict[str, str]:
    """Alerts, scored events, entity profiles and the test labels."""
    paths = {n: f"{path}/{n}" for n in ("alerts", "scored_events", "entity_profiles", "test_labels")}
    write_events(alerts, paths["alerts"])
    write_events(scored, paths["scored_events"])
    exported_profiles.write.mode("overwrite").parquet(paths["entity_profiles"])
    scored.select("session_id", "label").write.mode("overwrite").parquet(paths["test_labels"])
    return paths


def write_csv(flat: DataFrame, path: str) -> None:
    flat.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def append_incidents(alerts_path: str, new_rows: DataFrame) -> None:
    """Add externally supplied alert rows to the stored alerts."""
    result = S.normal_auth_result(F.col("auth_result"))
    write_events(new_rows.withColumn("auth_result", result), alerts_path, mode="append")


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(path)


@dataclass(frozen=True)
class StoredModel:
    profiles: profiles.ProfileModel
    sequences: sequence.SequenceTables
    classifier: classify.Classifier | None


PROFILE_TABLES = ("entities", "types", "entity_values", "type_values")
SEQUENCE_TABLES = ("pairs", "states", "stats", "rates")


def save_model(model: StoredModel, path: str) -> None:
    """Profiles and transition counts as Parquet, the forest in MLlib's format."""
    for name in PROFILE_TABLES:
        getattr(model.profiles, name).write.mode("overwrite").parquet(f"{path}/profiles/{name}")
    for name in SEQUENCE_TABLES:
        getattr(model.sequences, name).write.mode("overwrite").parquet(f"{path}/sequences/{name}")
    if model.classifier is not None:
        model.classifier.save(f"{path}/forest")


def load_model(spark: SparkSession, path: str, with_forest: bool = True) -> StoredModel:
    read = lambda part, name: spark.read.parquet(f"{path}/{part}/{name}")
    return StoredModel(
        profiles.load_model_tables(*[read("profiles", n) for n in PROFILE_TABLES]),
        sequence.SequenceTables(*[read("sequences", n) for n in SEQUENCE_TABLES]),
        classify.Classifier.load(f"{path}/forest") if with_forest else None,
    )
