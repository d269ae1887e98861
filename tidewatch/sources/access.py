"""Readers for access logs and the views of the test tables in that model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewatch import constants as C
from tidewatch.functions import scalars as S

# One row per access event, as logs carry it.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("geo_location", T.StringType()),
        T.StructField("resource_accessed", T.StringType()),
        T.StructField("auth_method", T.StringType()),
        T.StructField("auth_result", T.StringType()),
        T.StructField("session_duration", T.DoubleType()),
        T.StructField("command_sequence", T.StringType()),
        T.StructField("device_fingerprint", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

EVENT_COLUMNS = [
    "session_id", "entity_id", "entity_type", "event_time", "event_us", "hour",
    "source_ip", "geo_location", "resource_accessed", "auth_method", "auth_result",
    "session_duration", "device_fingerprint", "label",
]


def scan_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a log with its declared schema; a missing path is an error."""
    reader = spark.read.schema(LOG_SCHEMA)
    if fmt == "csv":
        # Quotes inside JSON cells are doubled, as spreadsheets and pandas write them.
        reader = reader.options(header=True, quote='"', escape='"')
    return as_events(reader.format(fmt).load(path))


def as_events(log: DataFrame) -> DataFrame:
    """Typed event time, hour and command list for a log in ``LOG_SCHEMA``."""
    time = F.to_timestamp("timestamp")
    return log.withColumn("event_time", time).select(
        *[c for c in log.columns if c not in {"timestamp", "auth_result", "command_sequence"}],
        S.normal_auth_result(F.col("auth_result")).alias("auth_result"),
        S.json_strings(F.col("command_sequence")).alias("command_sequence"),
        *_time_columns(F.col("event_time")),
    )


def _time_columns(time: Column) -> list[Column]:
    time = time.cast("timestamp")
    return [
        time.alias("event_time"),
        S.event_us(time).alias("event_us"),
        S.hour_of(time).alias("hour"),
    ]


# --- views of the test tables --------------------------------------------------


def _city(index: Column) -> Column:
    names = F.array(*[F.lit(city) for city, _, _ in C.CITY_COORDINATES])
    return F.element_at(names, (index + 1).cast("int"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table read as an access log."""
    return events_as_access(spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet"))


def lost_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log with every seventh place unknown."""
    events = spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    lost = events.select(F.col("event_id").alias("session_id"), (k % 7 == 0).alias("lost"))
    place = F.when(F.col("lost"), "Atlantis, ZZ").otherwise(F.col("geo_location"))
    return events_as_access(events).join(lost, "session_id").withColumn("geo_location", place).drop("lost")


def access_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The same view over a stream of files, ``files`` of them per micro-batch."""
    stream = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", files)
    return events_as_access(stream.parquet(f"{sf_dir}/event*.parquet"))


def events_as_access(events: DataFrame) -> DataFrame:
    # A column of its own, as the pattern would otherwise be matched wherever ``k`` occurs.
    events = events.withColumn("_k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    k, user, kind = F.col("_k"), F.col("user_id"), F.col("event_type")
    time = F.col("ts").cast("timestamp")
    off_hours = S.is_off_hours(F.hour(time))
    entity_type = (
        F.when(user % 5 < 3, "user").when(user % 5 == 3, "service_account").otherwise("edge_device")
    )
    label = (
        F.when(k == 99, "device_spoofing")
        .when(k % 50 == 0, "impossible_travel")
        .when((kind == "error") & (k < 10), "brute_force")
        .when(k.between(10, 14) & off_hours, "low_and_slow_exfil")
        .when(k == 20, "lateral_movement")
        .when(k == 22, "credential_stuffing")
        .when((k == 23) & (user % 5 < 3), "insider_drift")
        .otherwise(C.NORMAL)
    )
    return events.select(
        F.col("event_id").alias("session_id"),
        user.alias("entity_id"),
        entity_type.alias("entity_type"),
        *_time_columns(F.col("ts")),
        F.concat(F.lit("10."), (k % 8).cast("string"), F.lit(".0."), (k % 16).cast("string")).alias("source_ip"),
        _city(F.when(k % 50 == 0, (user * 3 + k + 7) % 20).otherwise(user % 20)).alias("geo_location"),
        F.concat(kind, F.lit("/"), (k % 4).cast("string")).alias("resource_accessed"),
        F.when(k % 20 == 0, "token")
        .when(k % 20 == 1, "certificate")
        .when(k % 20 == 2, "biometric")
        .otherwise("password")
        .alias("auth_method"),
        F.when(kind == "error", "fail").otherwise("success").alias("auth_result"),
        F.col("value").alias("session_duration"),
        F.when(k == 99, "dev_spoof")
        .otherwise(F.concat(F.lit("dev_"), user.cast("string"), F.lit("_"), (k % 2).cast("string")))
        .alias("device_fingerprint"),
        label.alias("label"),
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events of customers: has thin entities and tied times."""
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return joined.select(
        key.alias("session_id"),
        cust.alias("entity_id"),
        F.col("c_mktsegment").alias("entity_type"),
        *_time_columns(F.col("o_orderdate")),
        F.concat(F.lit("10."), F.col("c_nationkey").cast("string"), F.lit(".0."), (cust % 16).cast("string"))
        .alias("source_ip"),
        _city(F.when(key % 97 == 0, (F.col("c_nationkey") + 7) % 20).otherwise(F.col("c_nationkey") % 20))
        .alias("geo_location"),
        F.col("o_orderpriority").alias("resource_accessed"),
        F.col("o_orderstatus").alias("auth_method"),
        F.when(F.col("o_orderstatus") == "F", "fail").otherwise("success").alias("auth_result"),
        F.col("o_totalprice").alias("session_duration"),
        F.concat(F.lit("dev_"), cust.cast("string"), F.lit("_"), (key % 2).cast("string"))
        .alias("device_fingerprint"),
        F.lit(C.NORMAL).alias("label"),
    )


def turn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a second corpus of short state sequences."""
    turns = read_table(spark, sf_dir, "conversations")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("session_id"),
        F.col("conv_id").alias("entity_id"),
        F.lit("conversation").alias("entity_type"),
        F.col("turn").alias("event_us"),
        F.col("role").alias("resource_accessed"),
        F.lit(C.NORMAL).alias("label"),
    )
