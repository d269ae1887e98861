"""Context features: what surrounds an event in its entity's and address's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch import constants as C
from tidewatch.functions import geo, scalars as S
from tidewatch.operators.timeline import (
    AFTER, BEFORE, SELF, HotKeys, Step, find_hot_keys, join_by_key, join_null_safe, running, sweep,
)
from tidewatch.session import together
from tidewatch.settings import DAY, Settings

ORDER = ["event_us", "session_id"]


def failed() -> Column:
    return F.col("auth_result") == "fail"


def off_hours() -> Column:
    return S.is_off_hours(F.col("hour"))


# --- previous event ------------------------------------------------------------


def previous_values() -> dict[str, Column]:
    """The previous event as one value, so that its gaps are kept as gaps."""
    return {
        "_prev": F.struct(
            F.col("event_us").alias("us"), F.col("at").alias("at"), F.col("resource_accessed").alias("resource")
        )
    }


def unpacked(events: DataFrame) -> DataFrame:
    """``prev_us``, ``prev_at`` and ``prev_resource`` from the previous event."""
    return events.withColumns(
        {"prev_us": F.col("_prev.us"), "prev_at": F.col("_prev.at"), "prev_resource": F.col("_prev.resource")}
    ).drop("_prev")


def with_previous_resource(events: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Add ``prev_resource``, null where the previous event has none."""
    last = {"_prev": F.struct(F.col("resource_accessed").alias("resource"))}
    seen = running(events, ["entity_id"], ORDER, lasts=last, hot=hot)
    return seen.withColumn("prev_resource", F.col("_prev.resource")).drop("_prev")


def located(events: DataFrame) -> DataFrame:
    """Add ``at``, the coordinates of the event's place, resolved once per row."""
    return events.withColumn("at", geo.coordinates(F.col("geo_location")))


def with_previous(events: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Add ``at`` and the time and coordinates of the entity's previous event."""
    seen = running(located(events), ["entity_id"], ORDER, lasts=previous_values(), hot=hot)
    return unpacked(seen).drop("prev_resource")


def travelled(events: DataFrame) -> DataFrame:
    """Add ``km`` and ``kmh`` from the previous event's place to this one's."""
    there, here = F.col("prev_at"), F.col("at")
    km = geo.haversine_km(there["lat"], there["lon"], here["lat"], here["lon"])
    elapsed = F.col("event_us") - F.col("prev_us")
    return events.withColumn("km", km).withColumn("kmh", geo.travel_kmh(F.col("km"), elapsed))


def is_impossible(kmh: Column, km: Column) -> Column:
    return F.coalesce((kmh > C.IMPOSSIBLE_KMH) & (km > C.IMPOSSIBLE_KM), F.lit(False))


def geo_velocity(events: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Implied travel speed since the entity's previous event, in km/h."""
    moved = travelled(with_previous(events, hot))
    return moved.withColumns(
        {
            "geo_velocity_kmh": S.round_to(F.col("kmh"), 2),
            "is_impossible_travel": is_impossible(F.col("kmh"), F.col("km")),
        }
    )


# --- steps of the sliding counts -----------------------------------------------


def failure_steps(window: int) -> list[Step]:
    """Failures within ``window`` on either side, bounds included."""
    time = F.col("event_us")
    return [
        Step("fails", +1, failed(), BEFORE, time - window),
        Step("fails", -1, failed(), AFTER, time + window),
    ]


def off_hours_steps(s: Settings) -> list[Step]:
    """Off-hours events so far, this one included; optionally forgotten after a week."""
    steps = [Step("off_hours_n", +1, off_hours(), SELF)]
    if s.low_slow == "trailing":
        leaves = F.col("event_us") + s.low_slow_days * DAY
        steps.append(Step("off_hours_n", -1, off_hours(), AFTER, leaves))
    return steps


def first_uses(events: DataFrame) -> DataFrame:
    """When each entity first used each resource: ``first_us``."""
    return events.groupBy("entity_id", "resource_accessed").agg(F.min("event_us").alias("first_us"))


def first_events(events: DataFrame) -> DataFrame:
    """The first event of every (entity, resource): ``first_us, session_id``."""
    first = F.min(F.struct("event_us", "session_id")).alias("first")
    return (
        events.groupBy("entity_id", "resource_accessed")
        .agg(first)
        .select("entity_id", F.col("first.event_us").alias("first_us"), F.col("first.session_id").alias("session_id"))
    )


def _markers(first: DataFrame, count: str, *marks: tuple[Column, int, int, int]) -> DataFrame:
    """Sweep rows ``(time, place, sub, amount)`` for every row of the first uses.

    They come from the aggregated pairs, so no join back to the events is needed.
    """
    rows = F.array(
        *[
            F.struct(
                at.alias("event_us"), F.lit(place).alias("_place"), F.lit(sub).alias("_sub"),
                F.lit(amount).cast("long").alias(count),
            )
            for at, place, sub, amount in marks
        ]
    )
    kept = [c for c in first.columns if c in {"entity_id", "session_id"}]
    return first.select(*kept, F.explode(rows).alias("m")).select(*kept, "m.*")


def new_resource_markers(uses: DataFrame, window: int) -> DataFrame:
    """``new_n`` is raised for everything within ``window`` after a first use."""
    at = F.col("first_us")
    return _markers(uses, "new_n", (at, BEFORE, 1, +1), (at + window, AFTER, 1, -1))


def first_event_markers(first: DataFrame) -> DataFrame:
    """``first_n`` is 1 at the first event itself and nowhere else."""
    at = F.col("first_us")
    return _markers(first, "first_n", (at, SELF, 0, +1), (at, SELF, 2, -1))


# --- single features -----------------------------------------------------------


def failed_auth_counts(events: DataFrame, window: int, hot: HotKeys | None = None) -> DataFrame:
    swept = sweep(events, ["entity_id"], failure_steps(window), hot=hot)
    count = F.when(failed(), F.col("fails")).otherwise(0)
    return swept.withColumn("failed_auth_count_5min", count).drop("fails")


def resource_breadth(events: DataFrame, window: int, hot: HotKeys | None = None) -> DataFrame:
    """New resources within the trailing ``window``."""
    markers = new_resource_markers(first_uses(events), window)
    swept = sweep(events, ["entity_id"], [], markers=markers, hot=hot)
    return swept.withColumnRenamed("new_n", "resource_breadth_new_1hr")


def first_seen_resource(events: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """1 where the entity has never used the resource before."""
    swept = sweep(events, ["entity_id"], [], markers=first_event_markers(first_events(events)), hot=hot)
    return swept.withColumnRenamed("first_n", "first_seen_resource")


def low_slow_score(count: Column, rate: Column, s: Settings) -> Column:
    """Excess of off-hours events over the expected number, 0 outside off-hours."""
    usual = F.coalesce(rate, F.lit(C.DEFAULT_OFF_HOURS_RATE))
    expected = F.greatest(F.lit(1.0), usual * C.EVENTS_PER_DAY * s.low_slow_days)
    return F.when(off_hours(), S.clip01((count / expected - 1.0) / 3.0)).otherwise(0.0)


def off_hours_rate(normal_events: DataFrame) -> DataFrame:
    """Share of off-hours events per entity."""
    return normal_events.groupBy("entity_id").agg(
        (F.count_if(off_hours()) / F.count(F.lit(1))).alias("off_hours_rate")
    )


def low_slow(
    events: DataFrame, rates: DataFrame, s: Settings = Settings(), hot: HotKeys | None = None
) -> DataFrame:
    swept = sweep(events, ["entity_id"], off_hours_steps(s), hot=hot)
    rated = join_by_key(swept, rates, "entity_id", hot)
    score = low_slow_score(F.col("off_hours_n"), F.col("off_hours_rate"), s)
    return rated.withColumn("low_slow_score", S.round4(score))


def privilege_growth(events: DataFrame) -> DataFrame:
    """Per entity: resources added after its first seven days, relative to those of that week."""
    return footprint_growth(first_uses(events))


def footprint_growth(first: DataFrame) -> DataFrame:
    """Growth from the first uses; an entity begins with its earliest first use."""
    # Both aggregations combine before the shuffle; a join splits where a window cannot.
    starts = first.groupBy("entity_id").agg(F.min("first_us").alias("start_us"))
    early = F.col("first_us") <= F.col("start_us") + 7 * DAY
    counted = (
        join_null_safe(first, starts, ["entity_id"])
        .groupBy("entity_id")
        .agg(F.count_if(early).alias("early"), F.count_if(~early).alias("later"))
    )
    growth = F.least(F.col("later") / F.greatest(F.col("early"), F.lit(1)), F.lit(C.FOOTPRINT_CAP))
    return counted.select("entity_id", growth.alias("privilege_footprint_growth_30d"))


# --- accounts per address ------------------------------------------------------


def ip_concurrency(
    events: DataFrame,
    window: int,
    *,
    min_events: int = 3,
    hot: HotKeys | None = None,
    hot_pairs: HotKeys | None = None,
) -> DataFrame:
    """Distinct entities on the event's address within ``window`` on either side.

    Each event keeps its entity present from ``t - window`` to ``t + window``.
    Where the entity's previous event on the address already covers the start,
    the interval begins after it, so an entity's intervals never overlap and
    the number of intervals over an instant is the number of distinct entities.
    Addresses with fewer than ``min_events`` events give 0.
    """
    time = F.col("event_us")
    # Without hot addresses, one exchange serves both windows below.
    placed = events.repartition("source_ip") if hot is None else events
    present = running(
        placed, ["source_ip", "entity_id"], ORDER, lasts={"_seen": time}, hot=hot_pairs
    )
    start = F.greatest(time - window, F.coalesce(F.col("_seen") + window + 1, time - window))
    end = time + window
    steps = [
        Step("present", +1, start <= end, BEFORE, start),
        Step("present", -1, start <= end, AFTER, end),
    ]
    swept = sweep(present, ["source_ip"], steps, hot=hot).drop("_seen")
    name = "distinct_entities_from_ip_5min"
    if min_events <= 1:
        return swept.withColumnRenamed("present", name)
    counts = events.groupBy("source_ip").agg(F.count(F.lit(1)).alias("_on_ip"))
    thin = counts.filter(F.col("_on_ip") < min_events)
    marked = join_by_key(swept, thin, "source_ip", hot)
    count = F.when(F.col("_on_ip").isNull(), F.col("present")).otherwise(0)
    return marked.withColumn(name, count).drop("present", "_on_ip")


def find_hot(events: DataFrame) -> dict[str, HotKeys | None]:
    """Measure entities, addresses and (only if an address is hot) their pairs."""
    entity, ip = together(
        lambda: find_hot_keys(events, ["entity_id"]), lambda: find_hot_keys(events, ["source_ip"])
    )
    pairs = find_hot_keys(events, ["source_ip", "entity_id"]) if ip else None
    return {"entity": entity, "ip": ip, "pairs": pairs}


# --- all entity-based context in one sweep -------------------------------------


def entity_context(
    events: DataFrame,
    rates: DataFrame,
    s: Settings = Settings(),
    hot: HotKeys | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Previous event, failure counts, new resources, off-hours trend and footprint.

    All counts share one sweep: one exchange and one sort by entity and time.
    ``source`` is the same frame before any derived columns; first uses are read
    from it so that earlier steps are not planned twice.
    """
    source = events if source is None else source
    steps = failure_steps(s.fail_window) + off_hours_steps(s)
    if s.breadth == "window":
        markers, breadth = new_resource_markers(first_uses(source), s.breadth_window), "new_n"
    else:
        markers, breadth = first_event_markers(first_events(source)), "first_n"
    swept = sweep(
        located(events), ["entity_id"], steps, lasts=previous_values(), markers=markers, hot=hot
    )
    per_entity = join_by_key(unpacked(swept), rates, "entity_id", hot)
    if s.footprint == "first_week":
        per_entity = join_by_key(per_entity, footprint_growth(first_uses(source)), "entity_id", hot)
        growth = F.coalesce(F.col("privilege_footprint_growth_30d"), F.lit(0.0))
    else:
        growth = F.lit(0.0)
    trend = low_slow_score(F.col("off_hours_n"), F.col("off_hours_rate"), s)
    return per_entity.withColumns(
        {
            "failed_auth_count_5min": F.when(failed(), F.col("fails")).otherwise(0).cast("double"),
            "resource_breadth_new_1hr": F.col(breadth).cast("double"),
            "privilege_footprint_growth_30d": growth,
            "low_slow_raw": trend,
        }
    ).drop("fails", "off_hours_n", "off_hours_rate", breadth)
