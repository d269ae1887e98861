"""Streaming forms of the operators.

Aggregations carry a watermark in append mode, ``Settings.watermark`` unless one is
given: later rows are dropped, and :class:`LateRows` counts them.

At the end of a finite source the watermark leaves the last windows and sessions
open.  :func:`run_to_table` reads them from the query's state and adds them, with
the ``..._open`` function that belongs to the operator.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import IntegralType

from tidewatch import constants as C
from tidewatch.functions import scalars as S
from tidewatch.operators import features, scoring, sequence
from tidewatch.operators.profiles import SKETCH_LOG_K, ProfileModel
from tidewatch.session import ROCKSDB, materialize, new_path
from tidewatch.settings import Settings
from tidewatch.streaming import state

WATERMARK = Settings().watermark
State = Callable[..., DataFrame]  # reads the state of a query that has ended


# --- per-entity state ----------------------------------------------------------


def _placed(stream: DataFrame) -> DataFrame:
    """Coordinates as plain columns, so that state and rows hold numbers only."""
    located = features.located(stream)
    return located.withColumns({"lat": F.col("at.lat"), "lon": F.col("at.lon")}).drop("at")


def _points(rows: DataFrame) -> DataFrame:
    """Back to the point columns the batch expressions use."""
    known = lambda name: F.nanvl(F.col(name), F.lit(None).cast("double"))
    points = {
        "at": F.struct(known("lat").alias("lat"), known("lon").alias("lon")),
        "prev_at": F.struct(known("prev_lat").alias("lat"), known("prev_lon").alias("lon")),
    }
    return rows.withColumns(points).drop("lat", "lon", "prev_lat", "prev_lon")


def _watermarked(stream: DataFrame, idle: int | None, watermark: str) -> DataFrame:
    """Timers need a watermark; without an idle time no row is ever late."""
    return stream if idle is None else stream.withWatermark("event_time", watermark)


def geo_velocity(stream: DataFrame, idle: int | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Speed since the entity's previous event; 0 for rows that arrive out of order.

    With ``idle`` (microseconds) an entity is forgotten after such a pause.
    """
    placed = _placed(_watermarked(stream, idle, watermark)).select("session_id", "entity_id", "event_time", "event_us", "lat", "lon")
    moved = features.travelled(_points(state.remember(placed, state.PreviousEvent, idle)))
    return moved.select("session_id", "entity_id", S.round_to(F.col("kmh"), 2).alias("geo_velocity_kmh"))


def recent_resources(stream: DataFrame, idle: int | None = None, watermark: str = WATERMARK) -> DataFrame:
    wanted = _watermarked(stream, idle, watermark).select("session_id", "entity_id", "entity_type", "event_time", "event_us", "resource_accessed")
    return state.remember(wanted, state.RecentResources, idle)


def low_slow_7d(
    stream: DataFrame, rates: DataFrame, s: Settings = Settings(), idle: int | None = None, watermark: str = WATERMARK
) -> DataFrame:
    """Off-hours events of the last seven days; ``idle`` of seven days or more changes no row."""
    marked = _watermarked(stream, idle, watermark)
    wanted = marked.select("session_id", "entity_id", "event_time", "event_us", "hour", features.off_hours().alias("off_hours"))
    counted = state.remember(wanted, state.OffHoursCount, idle)
    rated = counted.join(rates, "entity_id", "left")
    score = features.low_slow_score(F.col("off_hours_n"), F.col("off_hours_rate"), s)
    return rated.select("session_id", "entity_id", "off_hours_n", S.round4(score).alias("low_slow_score"))


def entity_memory(stream: DataFrame, idle: int | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Every event with all that is remembered of its entity, in one stateful step."""
    wanted = _placed(_watermarked(stream, idle, watermark)).withColumn("off_hours", features.off_hours())
    return state.remember(wanted, state.EntityMemory, idle)


def failed_auth_5min(stream: DataFrame, window: int = Settings().fail_window, watermark: str = WATERMARK) -> DataFrame:
    """Every failure with the entity's failures within ``window`` before and after it, once no more can come."""
    failures = stream.filter(features.failed()).withWatermark("event_time", watermark)
    wanted = failures.select("entity_id", "session_id", "event_time", "event_us")
    # Numbers travel as text, so that missing ones do not turn the others into floats.
    own = {f.name: f.dataType for f in wanted.schema.fields if f.name in {"entity_id", "session_id"} and isinstance(f.dataType, IntegralType)}
    named = wanted.withColumns({c: F.col(c).cast("string") for c in own})
    processor = state.FailureNeighbours(named, window)
    counted = state.dealt(named).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.OUTPUT, outputMode="Append", timeMode="EventTime"
    )
    return counted.withColumns({c: F.col(c).cast(kind) for c, kind in own.items()}).withColumnRenamed("fails", "failed_auth_count_5min")


def failed_auth_5min_open(read: State, window: int = Settings().fail_window) -> DataFrame:
    """The failures still waiting, counted with the batch operator over all times that are kept."""
    kept = read("slots").select(F.explode(F.arrays_zip(*[F.col(f"user_map_value.{c}").alias(c) for c in ("names", "ids", "us", "emitted")])).alias("f"))
    rows = kept.select(
        F.col("f.names").alias("entity_id"), "f.emitted", F.col("f.ids").alias("session_id"), F.col("f.us").alias("event_us"), F.lit("fail").alias("auth_result")
    )
    counted = features.failed_auth_counts(rows, window).filter("not emitted")
    return counted.select("entity_id", "session_id", "event_us", "failed_auth_count_5min")


# --- windowed aggregations -----------------------------------------------------


def failed_auth(stream: DataFrame, width: str = "10 minutes", slide: str = "5 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Failures per entity in sliding windows."""
    return (
        stream.filter(features.failed())
        .withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", width, slide), "entity_id")
        .agg(F.count(F.lit(1)).alias("n_fails"))
        .select(F.unix_micros("window.start").alias("start_us"), "entity_id", "n_fails")
    )


def failed_auth_open(read: State) -> DataFrame:
    return read().select(F.unix_micros("key.window.start").alias("start_us"), "key.entity_id", F.col("value.count").alias("n_fails"))


def ip_concurrency(stream: DataFrame, width: str = "10 minutes", slide: str = "5 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Distinct entities per address in sliding windows.

    Two chained aggregations, first per entity and then per address, keep the
    count exact; streams have no distinct count of their own.
    """
    present = (
        stream.withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", width, slide), "source_ip", "entity_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        present.groupBy("window", "source_ip")
        .agg(F.count(F.lit(1)).alias("n_entities"), F.sum("n").alias("n_events"))
        .select(F.unix_micros("window.start").alias("start_us"), "source_ip", "n_entities", "n_events")
    )


def ip_concurrency_open(read: State) -> DataFrame:
    """A window is open in the first aggregation or, with its entities counted, in the second."""
    window = ["key.window", "key.source_ip"]
    entities = read(lambda key: "entity_id" in key).groupBy(*window).agg(F.count(F.lit(1)).alias("n_entities"), F.sum("value.count").alias("n_events"))
    counted = read(lambda key: "entity_id" not in key).select(*window, F.col("value.count").alias("n_entities"), F.col("value.sum").alias("n_events"))
    both = entities.unionByName(counted).groupBy("window", "source_ip").agg(F.sum("n_entities").alias("n_entities"), F.sum("n_events").alias("n_events"))
    return both.select(F.unix_micros("window.start").alias("start_us"), "source_ip", "n_entities", "n_events")


def ip_concurrency_sketch(
    stream: DataFrame, width: str = "10 minutes", slide: str = "5 minutes", watermark: str = WATERMARK, log_k: int = SKETCH_LOG_K
) -> DataFrame:
    """The same with a mergeable sketch of the entities: bounded state per window and address.

    The sketch's relative standard error is 1.04 / sqrt(2^log_k), 1.6 % at 12; small
    numbers are counted nearly exactly.
    """
    return (
        stream.withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", width, slide), "source_ip")
        .agg(F.hll_sketch_agg("entity_id", log_k).alias("entities"), F.count(F.lit(1)).alias("n_events"))
        .select(F.unix_micros("window.start").alias("start_us"), "source_ip", "entities", "n_events")
    )


def ip_concurrency_sketch_open(read: State) -> DataFrame:
    return read().select(
        F.unix_micros("key.window.start").alias("start_us"), "key.source_ip", F.col("value.buf").alias("entities"), F.col("value.count").alias("n_events")
    )


def sessions(stream: DataFrame, gap: str = "6 hours", watermark: str = WATERMARK) -> DataFrame:
    """Runs of an entity's events without a pause longer than ``gap``."""
    return (
        stream.withWatermark("event_time", watermark)
        .groupBy(F.session_window("event_time", gap), "entity_id")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(F.unix_micros("session_window.start").alias("start_us"), "entity_id", "n_events")
    )


def sessions_open(read: State) -> DataFrame:
    return read().select(F.unix_micros("value.session_window.start").alias("start_us"), "key.entity_id", F.col("value.count").alias("n_events"))


# --- scoring against fitted tables ---------------------------------------------


def profile_score(stream: DataFrame, model: ProfileModel, s: Settings = Settings()) -> DataFrame:
    """Baseline score without travel speed: stream-static lookups only."""
    return scoring.baseline_scores(stream, model, s.with_(use_velocity=False))


def score_recent(batch: DataFrame, model: sequence.SequenceTables) -> DataFrame:
    """NLL of the remembered resources, for use on each micro-batch."""
    return sequence.arrays_nll(batch, model)


def score_remembered(
    batch: DataFrame, model: ProfileModel, sequences: sequence.SequenceTables, s: Settings = Settings()
) -> DataFrame:
    """Baseline, sequence and risk scores of a micro-batch of :func:`entity_memory`.

    The sequence part is the likelihood of the last ten resources and the
    off-hours trend of the last seven days.
    """
    based = scoring.baseline_scores(_points(batch), model, s.with_(use_velocity=True))
    nll = sequence.arrays_nll(based.select("session_id", "entity_type", "recent"), sequences)
    joined = based.join(nll, "session_id").join(sequences.rates, "entity_id", "left")
    trend = features.low_slow_score(F.col("off_hours_n"), F.col("off_hours_rate"), s)
    scored = joined.withColumns(
        {
            "low_slow_score": S.round4(trend),
            "sequence_score": S.round4(scoring.sequence_score(F.col("markov_raw"), trend)),
        }
    )
    risk = scoring.risk_score(F.col("baseline_score"), F.col("sequence_score"))
    return scored.withColumn("risk_score", risk)


# --- running -------------------------------------------------------------------


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _state_reader(spark: SparkSession, checkpoint: str) -> State:
    """Reads the state that a query has left: by the names of its key's fields, or by state variable."""

    def read(which: Callable[[list[str]], bool] | str | None = None) -> DataFrame:
        source = spark.read.format("statestore")
        if isinstance(which, str):
            return source.option("stateVarName", which).load(checkpoint)
        operators = spark.read.format("state-metadata").load(checkpoint).select("operatorId").distinct()
        for row in sorted(operators.collect()):  # one row for each stateful operator of the plan
            table = source.option("operatorId", row.operatorId).load(checkpoint)
            if which is None or which(table.schema["key"].dataType.names):
                return table
        raise ValueError("the query has no such state")

    return read


def run_to_table(
    stream: DataFrame, name: str, options: dict[str, str] | None = None, still_open: Callable[[State], DataFrame] | None = None
) -> DataFrame:
    """Process what is there, append it to a table in the shared folder and read that.

    ``still_open`` turns the state that is left at the end of a finite source into the
    rows it would still give; they are added. A query that goes on later emits them itself.
    """
    spark = stream.sparkSession
    prepare(spark)
    path, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    query = (
        stream.writeStream.format("parquet")
        .options(path=path, checkpointLocation=checkpoint, **(options or {}))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    emitted = spark.read.schema(stream.schema).parquet(path)
    if still_open is None or query.lastProgress is None:  # an empty source runs no batch and has no state
        return emitted
    rest = still_open(_state_reader(spark, checkpoint)).select(*[F.col(f.name).cast(f.dataType) for f in stream.schema.fields])
    return emitted.unionByName(materialize(rest, f"{name}-open"))


def run_batches(stream: DataFrame, name: str, on_batch: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Like :func:`run_to_table`, with a batch step in between.

    Each micro-batch overwrites its own directory, so a repeated one leaves no
    duplicates.  It is persisted while in use: a step that reads it twice must
    not run the stateful operators twice.
    """
    spark = stream.sparkSession
    prepare(spark)
    path, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            on_batch(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).option("basePath", path).parquet(path)


class LateRows(StreamingQueryListener):
    """Counts the rows that queries drop because they come after the watermark.

    Register it with ``spark.streams.addListener`` before a query starts. It sees
    every progress report, however many there are.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        run = str(event.progress.runId)
        self.dropped[run] = self.dropped.get(run, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def of(self, query: StreamingQuery, seconds: float = 30) -> int:
        """Late rows of a query that has ended; reports come in order, the end after all progress."""
        if not self._end(str(query.runId)).wait(seconds):
            raise TimeoutError("the query's last report has not come")
        return self.dropped.get(str(query.runId), 0)


def alerts_of(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("baseline_score") > C.ALERT_THRESHOLD)
