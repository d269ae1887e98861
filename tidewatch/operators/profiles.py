"""Behavioural profiles per entity and per entity type, and lookups in them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch import constants as C
from tidewatch.functions import scalars as S
from tidewatch.operators.timeline import MAX_HOT_KEYS, HotKeys, dealt, join_by_key, slice_rows
from tidewatch.session import materialize, together
from tidewatch.settings import DAY, Settings

# Value sets up to this size travel inside the profile row; larger ones stay in
# the long table and are looked up there.
PACK_LIMIT = 256
PACKED = ("geo", "device", "resource")

PROFILED_ATTRIBUTES = {
    "resource": "resource_accessed",
    "auth": "auth_method",
    "geo": "geo_location",
    "ip_prefix": None,
    "device": "device_fingerprint",
}


# --- selecting the rows to learn from ------------------------------------------


def label_filter(events: DataFrame, normal: bool = True) -> DataFrame:
    return events.filter((F.col("label") == C.NORMAL) if normal else (F.col("label") != C.NORMAL))


def split_point(events: DataFrame, days: int) -> Column:
    """First instant of the test part, as a scalar subquery over the events."""
    return events.agg(F.min("event_us") + F.lit(days * DAY)).scalar()


def time_split(events: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """(train, test): the first ``days`` days and the rest."""
    return split_at(events, split_point(events, days))


def split_at(events: DataFrame, cut: Column) -> tuple[DataFrame, DataFrame]:
    return events.filter(F.col("event_us") < cut), events.filter(F.col("event_us") >= cut)


def rolling_window(events: DataFrame, reference_us: Column, days: int = 14) -> DataFrame:
    """Events in ``[reference - days, reference)``."""
    time = F.col("event_us")
    return events.filter((time >= reference_us - F.lit(days * DAY)) & (time < reference_us))


# --- numeric profiles ----------------------------------------------------------


def _moments(events: DataFrame, *by: str) -> DataFrame:
    """Mergeable counts and sums per entity, its type and whatever else ``by`` names.

    Durations are added up as decimals, to the microsecond: the sum is exact, so a
    mean does not depend on how rows were dealt to tasks or to partial tables.
    """
    hour, duration = F.col("hour").cast("long"), F.col("session_duration").cast("double")
    return events.groupBy(*by, "entity_id", "entity_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(hour).alias("sum_h"),
        F.sum(hour * hour).alias("sum_h2"),
        F.count(duration).alias("n_d"),
        F.sum(duration.try_cast("decimal(18,6)")).alias("sum_d"),
        F.var_pop(duration).alias("var_d"),
        F.min("event_us").alias("first_us"),
        F.max("event_us").alias("last_us"),
    )


def _merge(moments: DataFrame, key: str, kept: list[Column]) -> DataFrame:
    """Combine moments of disjoint groups, then derive the profile numbers."""
    n, var = F.col("n_d"), F.col("var_d")
    mean = F.try_divide(F.col("sum_d").cast("double"), n)
    merged = moments.groupBy(key).agg(
        F.sum("n").alias("n_observed_events"),
        F.sum("sum_h").alias("sum_h"),
        F.sum("sum_h2").alias("sum_h2"),
        F.sum(n).alias("n_d"),
        F.sum("sum_d").alias("sum_d"),
        F.sum(n * var).alias("within"),
        F.sum(n * mean * mean).alias("raw"),
        F.count(F.lit(1)).alias("parts"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        *kept,
    )
    total = F.col("n_observed_events")
    mean_h = F.col("sum_h") / total
    std_h = F.sqrt(F.greatest(F.lit(0.0), F.col("sum_h2") / total - mean_h * mean_h))
    mean_d = F.try_divide(F.col("sum_d").cast("double"), F.col("n_d"))
    between = F.greatest(F.lit(0.0), F.col("raw") - F.col("n_d") * mean_d * mean_d)
    squares = F.col("within") + F.when(F.col("parts") == 1, 0.0).otherwise(between)
    std_d = F.sqrt(F.try_divide(squares, F.col("n_d") - 1))
    one = F.lit(1.0)
    return merged.select(
        key,
        *[c for c in merged.columns if c == "entity_type" and key != "entity_type"],
        "n_observed_events",
        mean_h.alias("hour_mean"),
        F.when(total > 1, F.greatest(one, std_h)).otherwise(6.0).alias("hour_std"),
        mean_d.alias("session_duration_mean"),
        F.when(total > 1, F.greatest(one, std_d))
        .otherwise(F.greatest(one, mean_d * 0.3))
        .alias("session_duration_std"),
        "first_us",
        "last_us",
    )


def _first_type() -> Column:
    return F.min_by("entity_type", F.struct("first_us", "entity_type")).alias("entity_type")


def entity_numeric(events: DataFrame) -> DataFrame:
    """One row per entity.  The type of an entity is that of its first event."""
    return _merge(_moments(events), "entity_id", [_first_type()])


def type_numeric(events: DataFrame) -> DataFrame:
    """One row per entity type, merged from the entities' moments."""
    return _merge(_moments(events), "entity_type", [])


def hour_histogram(events: DataFrame) -> DataFrame:
    """Share of each of the 24 hours per entity."""
    counts = [F.count_if(F.col("hour") == h).alias(f"h{h}") for h in range(24)]
    wide = events.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), *counts)
    shares = F.array(*[F.struct(F.lit(h).alias("hour"), F.col(f"h{h}").alias("n_hour")) for h in range(24)])
    return wide.select("entity_id", "n", F.explode(shares).alias("b")).select(
        "entity_id", F.col("b.hour").alias("hour"), (F.col("b.n_hour") / F.col("n")).alias("share")
    )


# --- value profiles ------------------------------------------------------------


def profile_values(events: DataFrame, *by: str) -> DataFrame:
    """Counts of every resource, auth method, place, address prefix and device.

    One pass: the five attributes are unpivoted and counted with map-side
    combining.  ``entity_id, entity_type, attr, value, n, first_us``, and ``by``.
    """
    columns = {
        attr: F.col(name) if name else S.ip_prefix(F.col("source_ip"))
        for attr, name in PROFILED_ATTRIBUTES.items()
    }
    pairs = F.array(
        *[F.struct(F.lit(a).alias("attr"), c.cast("string").alias("value")) for a, c in columns.items()]
    )
    return (
        events.select(*by, "entity_id", "entity_type", "event_us", F.explode(pairs).alias("p"))
        .filter(F.col("p.value").isNotNull())
        .groupBy(*by, "entity_id", "entity_type", F.col("p.attr").alias("attr"), F.col("p.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("event_us").alias("first_us"))
    )


def values_by(values: DataFrame, key: str) -> DataFrame:
    """Roll the counted values up to one key: the entity or the type."""
    return values.groupBy(key, "attr", "value").agg(
        F.sum("n").alias("n"), F.min("first_us").alias("first_us")
    )


def primary_auth(values: DataFrame, key: str) -> DataFrame:
    """Most frequent method; of equals, the one seen first, then by name."""
    rank = F.struct(-F.col("n"), F.col("first_us"), F.col("value"))
    return (
        values.filter(F.col("attr") == "auth")
        .groupBy(key)
        .agg(F.min_by("value", rank).alias("primary_auth_method"))
    )


def distinct_values(events: DataFrame) -> DataFrame:
    """Every distinct value of the profiled attributes."""
    return profile_values(events).select("attr", "value").distinct()


def new_values(recent: DataFrame, old: DataFrame, key: str = "entity_id") -> DataFrame:
    """Values of the recent table that the old one lacks, per key."""
    return recent.join(old, [key, "attr", "value"], "left_anti")


def cold_start_census(entities: DataFrame, threshold: int = 5) -> DataFrame:
    return entities.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.count_distinct("entity_type").alias("n_types"),
        F.count_if(F.col("n_observed_events") < threshold).alias("n_cold"),
    )


def entity_population(events: DataFrame) -> DataFrame:
    """Distinct entities per type; ``all`` is the grand total."""
    pairs = events.select("entity_type", "entity_id").distinct()
    return (
        pairs.rollup("entity_type")
        .agg(F.count_distinct("entity_id").alias("n_entities"))
        .select(F.coalesce("entity_type", F.lit("all")).alias("entity_type"), "n_entities")
    )


# --- populations from sketches -------------------------------------------------

SKETCH_LOG_K = 12
SKETCH_ERROR = 0.03  # twice the sketch's relative standard error of 1.04 / sqrt(2^12)


def population_sketches(events: DataFrame, log_k: int = SKETCH_LOG_K) -> DataFrame:
    """A sketch of the entities of every day and type; a few kilobytes each, whatever the day holds."""
    day = F.floor(F.col("event_us") / DAY).alias("day")
    return events.groupBy(day, "entity_type").agg(F.hll_sketch_agg("entity_id", log_k).alias("entities"))


def population_estimate(sketches: DataFrame) -> DataFrame:
    """Distinct entities per type over the days of stored sketches; ``all`` is the grand total."""
    return (
        sketches.rollup("entity_type")
        .agg(F.hll_sketch_estimate(F.hll_union_agg("entities")).alias("n_entities"), F.count_distinct("day").alias("n_days"))
        .select(F.coalesce("entity_type", F.lit("all")).alias("entity_type"), "n_entities", "n_days")
    )


# --- exported profiles ---------------------------------------------------------


def profile_export(events: DataFrame) -> DataFrame:
    """One row per entity with its value sets as JSON and numbers to two decimals."""
    return export_table(entity_numeric(events), values_by(profile_values(events), "entity_id"))


def export_model(model: "ProfileModel") -> DataFrame:
    """The same table from a fitted model."""
    return export_table(model.entities, model.entity_values)


def export_table(numeric: DataFrame, values: DataFrame) -> DataFrame:
    numeric = numeric.drop("primary_auth_method", *[f"{a}_counts" for a in PACKED])

    def names(attr: str) -> Column:
        found = F.collect_set(F.when(F.col("attr") == attr, F.col("value")))
        return F.to_json(F.array_sort(found))

    resource = F.when(F.col("attr") == "resource", F.struct("value", "n"))
    sets = values.groupBy("entity_id").agg(
        names("geo").alias("home_geo_set"),
        names("ip_prefix").alias("home_ip_prefixes"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(resource)))).alias("typical_resources"),
        names("device").alias("known_device_fingerprints"),
        F.min_by(
            F.when(F.col("attr") == "auth", F.col("value")),
            F.when(F.col("attr") == "auth", F.struct(-F.col("n"), F.col("first_us"), F.col("value"))),
        ).alias("primary_auth_method"),
    )
    two = lambda name: S.round_to(F.col(name), 2).alias(name)
    return numeric.join(sets, "entity_id").select(
        "entity_id",
        "entity_type",
        two("hour_mean"),
        two("hour_std"),
        "home_geo_set",
        "home_ip_prefixes",
        "typical_resources",
        two("session_duration_mean"),
        two("session_duration_std"),
        "primary_auth_method",
        "known_device_fingerprints",
        F.timestamp_micros("first_us").alias("first_seen"),
        F.timestamp_micros("last_us").alias("last_seen"),
        "n_observed_events",
    )


# --- a fitted profile model ----------------------------------------------------


@dataclass(frozen=True)
class ProfileModel:
    """Profiles learned from normal events, kept in the shared folder.

    ``entities`` and ``types`` hold one row per key: the numbers, the primary
    method and the value sets of at most ``PACK_LIMIT`` members (``null`` where
    a set is larger).  ``entity_values`` and ``type_values`` are the full long
    tables.  ``large`` names the (level, attribute) pairs with larger sets.
    """

    entities: DataFrame
    types: DataFrame
    entity_values: DataFrame
    type_values: DataFrame
    large: frozenset[tuple[str, str]]


def _packed(values: DataFrame, key: str) -> DataFrame:
    """Value sets within the limit; the row number bounds what is collected."""
    rank = F.row_number().over(Window.partitionBy(key, "attr").orderBy("value"))
    first = (
        values.filter(F.col("attr").isin(*PACKED))
        .withColumn("rank", rank)
        .filter(F.col("rank") <= PACK_LIMIT + 1)
    )
    out = []
    for attr in PACKED:
        mine = F.col("attr") == attr
        entries = F.collect_list(F.when(mine, F.struct("value", "n")))
        out.append(F.when(F.count_if(mine) <= PACK_LIMIT, F.map_from_entries(entries)).alias(f"{attr}_counts"))
    return first.groupBy(key).agg(*out)


def _with_sets(numeric: DataFrame, values: DataFrame, key: str) -> DataFrame:
    return numeric.join(_packed(values, key), key, "left").join(primary_auth(values, key), key, "left")


def fit_profiles(normal_events: DataFrame) -> ProfileModel:
    """Learn the profiles once and keep them as tables."""
    values, moments = together(
        lambda: materialize(profile_values(normal_events), "profile_values"),
        lambda: materialize(_moments(normal_events), "moments"),
    )
    return _fit(values, moments)


def _fit(values: DataFrame, moments: DataFrame) -> ProfileModel:
    entity_values, type_values = together(
        lambda: materialize(values_by(values, "entity_id"), "entity_values"),
        lambda: materialize(values_by(values, "entity_type"), "type_values"),
    )
    by_entity = _with_sets(_merge(moments, "entity_id", [_first_type()]), entity_values, "entity_id")
    by_type = _with_sets(_merge(moments, "entity_type", []), type_values, "entity_type")
    entities, types = together(
        lambda: materialize(by_entity, "entities"), lambda: materialize(by_type, "types")
    )
    return load_model_tables(entities, types, entity_values, type_values)


def fit_rolling(events: DataFrame, reference_us: Column, s: Settings = Settings()) -> ProfileModel:
    """Learn from the normal events of the trailing window only."""
    return fit_profiles(label_filter(rolling_window(events, reference_us, s.rolling_days)))


@dataclass(frozen=True)
class DailyTables:
    """Stored partial profiles of normal events, one partition per day.

    Each day's partition holds the day's moments and value counts per entity. They
    add up, so any run of days gives its profile without its events, and a day is
    written once: a refit every day reads ``rolling_days`` small partitions.
    """

    moments: DataFrame
    values: DataFrame

    def window(self, last_day: int, days: int) -> DailyTables:
        """The ``days`` days before ``last_day`` (days since 1970)."""
        wanted = (F.col("day") >= last_day - days) & (F.col("day") < last_day)
        return DailyTables(self.moments.filter(wanted), self.values.filter(wanted))


DAILY = ("moments", "values")


def write_daily(events: DataFrame, path: str) -> None:
    """Store the partial profiles of the events' days; days that are there already are replaced.

    A day has to be given whole. Only normal events are counted.
    """
    dated = label_filter(events).withColumn("day", F.floor(F.col("event_us") / DAY).cast("int"))
    tables = {"moments": _moments(dated, "day"), "values": profile_values(dated, "day")}

    def write(name: str) -> None:
        out = tables[name].hint("rebalance", "day").write.mode("overwrite")
        out.option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/{name}")

    together(*[lambda name=name: write(name) for name in DAILY])


def read_daily(spark: SparkSession, path: str) -> DailyTables:
    return DailyTables(*[spark.read.parquet(f"{path}/{name}") for name in DAILY])


def fit_daily(daily: DailyTables, last_day: int, s: Settings = Settings()) -> ProfileModel:
    """Profiles of the ``rolling_days`` whole days before ``last_day``, from the stored tables alone."""
    part = daily.window(last_day, s.rolling_days)
    values = materialize(part.values.groupBy("entity_id", "entity_type", "attr", "value").agg(F.sum("n").alias("n"), F.min("first_us").alias("first_us")), "profile_values")
    return _fit(values, part.moments)


def load_model_tables(entities, types, entity_values, type_values) -> ProfileModel:
    """A model over stored tables; notes which attributes have large sets."""

    def oversized(level: str, table: DataFrame) -> set[tuple[str, str]]:
        row = table.agg(*[F.bool_or(F.col(f"{a}_counts").isNull()).alias(a) for a in PACKED]).first()
        return {(level, a) for a in PACKED if row[a]}

    large = set().union(*together(lambda: oversized("entity", entities), lambda: oversized("type", types)))
    return ProfileModel(entities, types, entity_values, type_values, frozenset(large))


# --- lookups -------------------------------------------------------------------

PROFILE_FIELDS = [
    "n_observed_events", "hour_mean", "hour_std", "session_duration_mean", "session_duration_std",
    "primary_auth_method",
]


def profile_lookup(
    events: DataFrame, model: ProfileModel, s: Settings = Settings(), hot: HotKeys | None = None, placed: bool = False
) -> DataFrame:
    """Attach the profile that applies to each event.

    Entities with enough history use their own profile; others use their
    type's, or their own thin one when the type is unknown.  Adds
    ``profile_source`` (entity, type or null), ``is_cold_start``, the profile's
    numbers and its value sets. ``placed`` events come from a window by entity (see :func:`join_by_key`).
    """
    fields = [*PROFILE_FIELDS, *[f"{a}_counts" for a in PACKED]]
    own = model.entities.select("entity_id", F.struct(*fields).alias("_own"))
    shared = model.types.select("entity_type", F.struct(*fields).alias("_type"))
    joined = join_by_key(events, own, "entity_id", hot, placed).join(shared, "entity_type", "left")
    warm = F.coalesce(F.col("_own.n_observed_events") >= s.cold_start_events, F.lit(False))
    source = (
        F.when(warm, "entity")
        .when(F.col("_type").isNotNull(), "type")
        .when(F.col("_own").isNotNull(), "entity")
    )
    tagged = joined.withColumns({"profile_source": source, "is_cold_start": ~warm})
    chosen = F.when(F.col("profile_source") == "entity", F.col("_own")).otherwise(F.col("_type"))
    return tagged.withColumn("_profile", chosen).select(
        *events.columns, "profile_source", "is_cold_start", *[F.col(f"_profile.{f}").alias(f) for f in fields]
    )


def _busy_values(counts: DataFrame, keys: list[str]) -> DataFrame | None:
    """Salts of the values that more than ``slice_rows`` events ask for; ``None`` if there are none."""
    limit = slice_rows(counts)
    busy = counts.filter(F.col("n") > limit)
    if busy.isEmpty():
        return None
    salts = busy.orderBy(F.desc("n")).limit(MAX_HOT_KEYS)
    return materialize(salts.select(*keys, F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("n_salts")), "busy")


def value_counts_joined(
    looked_up: DataFrame,
    model: ProfileModel,
    attr: str,
    column: str,
    level: str,
    hot: HotKeys | None = None,
    frame: DataFrame | None = None,
) -> DataFrame:
    """Counts of an event's value from the long table (existence join).

    Events that need no lookup here get a key of their own that matches
    nothing, so they spread evenly instead of piling up on one null key. The
    events of a hot entity are dealt over as many tasks as its size calls for, and
    so are those of a type that share a busy value. Only the rows of such keys are
    repeated: a type's table may hold every value of all its entities, and the
    planner sees its stored size when it decides to broadcast it.
    """
    key = "entity_id" if level == "entity" else "entity_type"
    values = model.entity_values if level == "entity" else model.type_values
    stored = values.filter(F.col("attr") == attr).select(key, F.col("value").alias("_wanted"), "n")
    mine = stored.withColumnRenamed("n", f"_{level}_{attr}_n")
    apart = F.concat(F.lit("\0"), F.col("session_id").cast("string"))
    open_ = (F.col("profile_source") == level) & F.col(f"{attr}_n").isNull()
    wanted = F.when(open_, F.col(column)).otherwise(apart)
    asked = looked_up.withColumn("_wanted", wanted)
    if level == "type":
        asking = stored if frame is None else frame.groupBy(key, F.col(column).alias("_wanted")).agg(F.count(F.lit(1)).alias("n"))
        busy = _busy_values(asking, [key, "_wanted"])
        if busy is not None:
            asked, mine = dealt(asked, mine, [key, "_wanted"], busy)
    elif hot is not None:
        asked, mine = dealt(asked, mine, [key], hot.table)
    salt = [c for c in asked.columns if c == "_salt"]
    return asked.join(mine, [key, "_wanted", *salt], "left").drop("_wanted", *salt)


def value_counts(
    looked_up: DataFrame, model: ProfileModel, hot: HotKeys | None = None, frame: DataFrame | None = None
) -> DataFrame:
    """``geo_n``, ``device_n``, ``resource_n``: how often the profile saw the value.

    Sets inside the profile row need no further join.  The long table is joined
    only for the attributes and levels that have sets above the limit. ``frame`` is
    the same events before any derived columns, in which busy values are counted;
    without it (a stream cannot be counted) the profile's own counts stand for them.
    """
    columns = {"geo": "geo_location", "device": "device_fingerprint", "resource": "resource_accessed"}
    found = {}
    for attr, column in columns.items():
        packed = F.col(f"{attr}_counts")
        inside = F.coalesce(F.try_element_at(packed, F.col(column)), F.lit(0))
        found[f"{attr}_n"] = F.when(packed.isNotNull(), inside)
    # The sets leave the rows before any further exchange.
    out = looked_up.withColumns(found).drop(*[f"{a}_counts" for a in PACKED])
    extra = []
    for level, attr in sorted(model.large):
        out = value_counts_joined(out, model, attr, columns[attr], level, hot, frame)
        extra.append(f"_{level}_{attr}_n")
        out = out.withColumn(f"{attr}_n", F.coalesce(f"{attr}_n", extra[-1]))
    return out.drop(*extra).fillna(0, subset=list(found))


# --- drift ---------------------------------------------------------------------


def drift_flags(
    all_events: DataFrame, model: ProfileModel, reference_us: Column, s: Settings = Settings()
) -> DataFrame:
    """One row per profiled entity: did its recent normal behaviour change?

    Recent events are the normal ones in the trailing window before the
    reference time.  Fewer than three give no drift.
    """
    recent_events = label_filter(rolling_window(all_events, reference_us, s.rolling_days))
    n_recent = recent_events.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_recent"))
    return _drift(values_by(profile_values(recent_events), "entity_id"), n_recent, model)


def drift_daily(daily: DailyTables, model: ProfileModel, last_day: int, s: Settings = Settings()) -> DataFrame:
    """The same for the ``rolling_days`` whole days before ``last_day``, without their events."""
    part = daily.window(last_day, s.rolling_days)
    n_recent = part.moments.groupBy("entity_id").agg(F.sum("n").alias("n_recent"))
    return _drift(values_by(part.values, "entity_id"), n_recent, model)


def _drift(recent: DataFrame, n_recent: DataFrame, model: ProfileModel) -> DataFrame:
    profiled = model.entities.select("entity_id", F.col("primary_auth_method").alias("old_auth"))
    fresh = (
        new_values(recent.filter(F.col("attr").isin("resource", "geo")), model.entity_values)
        .groupBy("entity_id")
        .agg(
            F.count_if(F.col("attr") == "resource").alias("new_resources"),
            F.count_if(F.col("attr") == "geo").alias("new_geos"),
        )
    )
    known = (
        model.entity_values.filter(F.col("attr") == "resource")
        .groupBy("entity_id")
        .agg(F.count(F.lit(1)).alias("old_resources"))
    )
    auth = primary_auth(recent, "entity_id")
    joined = (
        profiled.join(n_recent, "entity_id", "left")
        .join(fresh, "entity_id", "left")
        .join(known, "entity_id", "left")
        .join(auth, "entity_id", "left")
        .fillna(0, subset=["n_recent", "new_resources", "new_geos", "old_resources"])
    )
    ratio = F.col("new_resources") / F.greatest(F.col("old_resources"), F.lit(1))
    changed = (
        (ratio > C.DRIFT_RESOURCE_RATIO)
        | (F.col("new_geos") > 0)
        | ~F.col("primary_auth_method").eqNullSafe(F.col("old_auth"))
    )
    return joined.select(
        "entity_id",
        "n_recent",
        "new_resources",
        "new_geos",
        ((F.col("n_recent") >= C.DRIFT_MIN_EVENTS) & changed).alias("is_drift_flagged"),
    )
