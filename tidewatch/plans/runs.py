"""Shared inputs of the registered queries.

The alert and evaluation queries all start from one detection run.  Its tables
are written to the shared folder once per application and data directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators import classify as K, profiles as P, sequence as Q
from tidewatch.plans.detection import Detection, detect, fit_tables, training_scores
from tidewatch.session import materialize
from tidewatch.settings import DAY, MINUTE, Settings
from tidewatch.sources.access import access_events, lost_events, order_events

# The test tables span 30 days and are sparse, so the windows are wider.
ACCESS = Settings(train_days=20, fail_window=DAY, ip_window=30 * MINUTE)
ORDERS = Settings(train_days=1461, rolling_days=2000)

_KEPT: dict[tuple, object] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop the kept runs, so that the next query starts from the tables again."""
    _KEPT.clear()


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access log as a table, for runs that read it many times: the view is worked out once."""
    return kept(spark, sf_dir, "events", lambda: materialize(access_events(spark, sf_dir), "events"))


def stored_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return P.time_split(stored_events(spark, sf_dir), ACCESS.train_days)


def access_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return P.time_split(access_events(spark, sf_dir), ACCESS.train_days)


def access_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.label_filter(access_split(spark, sf_dir)[0])


def access_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_split(spark, sf_dir)[1]


def order_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return P.time_split(order_events(spark, sf_dir), ORDERS.train_days)


def access_model(spark: SparkSession, sf_dir: str) -> tuple[P.ProfileModel, Q.SequenceTables]:
    return kept(spark, sf_dir, "tables", lambda: fit_tables(stored_split(spark, sf_dir)[0]))


def order_profiles(spark: SparkSession, sf_dir: str) -> P.ProfileModel:
    return kept(spark, sf_dir, "orders", lambda: P.fit_profiles(order_split(spark, sf_dir)[0]))


def detection(spark: SparkSession, sf_dir: str) -> Detection:
    """Rules only, so that the outcome can be checked in SQL."""
    return kept(spark, sf_dir, "run", lambda: detect(stored_events(spark, sf_dir), ACCESS, learn=False))


def lost_detection(spark: SparkSession, sf_dir: str) -> Detection:
    """The same run over events of which some have unknown places."""
    return kept(spark, sf_dir, "lost", lambda: detect(materialize(lost_events(spark, sf_dir), "events"), ACCESS, learn=False))


def learned_detection(spark: SparkSession, sf_dir: str) -> Detection:
    return kept(spark, sf_dir, "learned", lambda: detect(stored_events(spark, sf_dir), ACCESS))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored training attacks."""

    def make() -> DataFrame:
        train, _ = stored_split(spark, sf_dir)
        model, sequences = access_model(spark, sf_dir)
        return materialize(training_scores(train, model, sequences, ACCESS), "training")

    return kept(spark, sf_dir, "training", make)


def classifier(spark: SparkSession, sf_dir: str) -> K.Classifier:
    return kept(spark, sf_dir, "forest", lambda: K.fit_classifier(training(spark, sf_dir)))
