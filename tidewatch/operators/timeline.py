"""Running values along each key's events, safe when one key holds most rows.

A window partitioned by entity (or address) puts a whole key in one task.  Keys
above a row limit are therefore cut into time slices: windows run per
``(key, slice)``, each slice's totals are aggregated separately, and every slice
starts from the totals of the earlier ones.  Results are the same as those of
the plain window.  A key has one slice width, the widest of a list at which no
slice of it exceeds the limit, so one burst makes all slices of its key narrow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.session import materialize
from tidewatch.settings import SECOND

DEFAULT_SLICE_ROWS = 2_000_000
MAX_HOT_KEYS = 100_000
SLICE_SECONDS = [1, 10, 60, 300, 900, 3600, 21600, 86400, 604800]

BEFORE, SELF, AFTER = 0, 1, 2


@dataclass(frozen=True)
class HotKeys:
    """Keys above the row limit: ``keys..., slice_us, n_salts``.

    At most ``MAX_HOT_KEYS`` rows, so the table is always safe to broadcast.
    """

    table: DataFrame
    keys: tuple[str, ...]
    slice_rows: int


def slice_rows(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get("spark.tidewatch.sliceRows", str(DEFAULT_SLICE_ROWS))
    return int(conf)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which null keys match each other, as they do in windows and groups."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    matches = F.lit(True)
    for k in keys:
        matches = matches & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, matches, "left").drop(*[f"_r_{k}" for k in keys])


def find_hot_keys(df: DataFrame, keys: Sequence[str], time_us: str = "event_us") -> HotKeys | None:
    """Measure the keys; ``None`` when no key exceeds the limit.

    Only the heaviest ``MAX_HOT_KEYS`` are treated as hot.  Any other key then
    holds at most one part in ``MAX_HOT_KEYS`` of the rows.
    """
    limit = slice_rows(df)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > limit)
    if sizes.isEmpty():
        return None
    heavy = materialize(sizes.orderBy(F.desc("n_rows")).limit(MAX_HOT_KEYS), "heavy")
    second = F.floor(F.col(time_us) / SECOND)
    per_second = (
        join_null_safe(df, F.broadcast(heavy), keys)
        .filter(F.col("n_rows").isNotNull())
        .groupBy(*keys, second.alias("second"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    widest = (
        per_second.withColumn("width", F.explode(F.array(*map(F.lit, SLICE_SECONDS))))
        .groupBy(*keys, "width", F.floor(F.col("second") / F.col("width")).alias("slice"))
        .agg(F.sum("n").alias("n"))
        .groupBy(*keys, "width")
        .agg(F.max("n").alias("n"))
        .filter(F.col("n") <= limit)
        .groupBy(*keys)
        .agg(F.max("width").alias("width"))
    )
    table = join_null_safe(heavy, widest, keys).select(
        *keys,
        (F.coalesce("width", F.lit(SLICE_SECONDS[0])).cast("long") * SECOND).alias("slice_us"),
        F.ceil(F.col("n_rows") / F.lit(limit)).cast("int").alias("n_salts"),
    )
    return HotKeys(materialize(table, "hot"), tuple(keys), limit)


def with_slice(df: DataFrame, hot: HotKeys, time_us: str) -> DataFrame:
    """Add ``_slice`` (0 for ordinary keys) and ``_hot``."""
    widths = F.broadcast(hot.table.select(*hot.keys, "slice_us"))
    return (
        join_null_safe(df, widths, hot.keys)
        .withColumn("_hot", F.col("slice_us").isNotNull())
        .withColumn("_slice", F.coalesce(F.floor(F.col(time_us) / F.col("slice_us")), F.lit(0)))
        .drop("slice_us")
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add running sums (current row included) and last non-null earlier values.

    ``order`` starts with the time in microseconds and must be a total order
    within a key.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    if hot is None:
        return df.withColumns(_over(Window.partitionBy(*keys).orderBy(*order), sums, lasts))

    # Each slice of a hot key starts with one extra row that carries the totals
    # of the slices before it, so the window continues where they ended.
    added = {f"_s_{n}": v for n, v in sums.items()} | {f"_l_{n}": v for n, v in lasts.items()}
    cut = with_slice(df, hot, order[0]).withColumns(added | {"_carry": F.lit(False)})
    totals = [F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums]
    totals += [
        F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), F.struct(*order))).alias(f"_l_{n}")
        for n in lasts
    ]
    per_slice = cut.filter("_hot").groupBy(*keys, "_slice").agg(*totals)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(
        *keys,
        "_slice",
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_s_{n}") for n in sums],
        *[F.last(f"_l_{n}", True).over(earlier).alias(f"_l_{n}") for n in lasts],
        F.lit(True).alias("_carry"),
    )
    rows = cut.unionByName(carried, allowMissingColumns=True)
    window = Window.partitionBy(*keys, "_slice").orderBy(F.desc("_carry"), *order)
    values = {n: F.col(f"_s_{n}") for n in sums}, {n: F.col(f"_l_{n}") for n in lasts}
    return rows.withColumns(_over(window, *values)).filter(~F.col("_carry")).drop(
        "_slice", "_hot", "_carry", *added
    )


def _over(window, sums, lasts) -> dict[str, Column]:
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    out = {name: F.sum(value).over(upto) for name, value in sums.items()}
    return out | {name: F.last(value, True).over(before) for name, value in lasts.items()}


@dataclass(frozen=True)
class Step:
    """A change of a running count at an offset from the event that causes it.

    ``place`` orders changes against events of the same instant: ``BEFORE`` is
    seen by them, ``AFTER`` is not, ``SELF`` takes the event's own place.
    """

    count: str
    amount: int = 1
    when: Column | None = None
    place: int = SELF
    at: Column = field(default=None)


def sweep(
    events: DataFrame,
    keys: Sequence[str],
    steps: Sequence[Step],
    *,
    time_us: str = "event_us",
    tie: str = "session_id",
    lasts: Mapping[str, Column] | None = None,
    markers: DataFrame | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Sliding counts by sweeping over interval starts and ends.

    An event that is counted from ``t1`` to ``t2`` contributes +1 at ``t1`` and
    -1 after ``t2``; a sliding count is then one running sum.  The work is one
    sort of the events plus their steps, whatever the window's width, where a
    sliding frame would re-aggregate the frame for every row.

    ``markers`` adds further steps as rows ``keys..., time_us, _place, _sub,
    tie, counts...``.
    """
    names = list(dict.fromkeys(s.count for s in steps))
    if markers is not None:
        names += [c for c in markers.columns if c not in {*keys, time_us, tie, "_place", "_sub", *names}]
    own = [s for s in steps if s.place == SELF]
    moved = [s for s in steps if s.place != SELF]

    def point(at: Column, place: int, amounts: dict[str, Column]) -> Column:
        return F.struct(
            at.alias("at"),
            F.lit(place).alias("place"),
            *[amounts.get(n, F.lit(0)).cast("long").alias(n) for n in names],
        )

    amounts: dict[str, Column] = {}
    for s in own:
        value = F.lit(s.amount) if s.when is None else F.when(s.when, s.amount).otherwise(0)
        amounts[s.count] = amounts[s.count] + value if s.count in amounts else value
    points = [point(F.col(time_us), SELF, amounts)]
    for s in moved:
        p = point(s.at, s.place, {s.count: F.lit(s.amount)})
        points.append(p if s.when is None else F.when(s.when, p))

    payload = [c for c in events.columns if c not in {*keys, time_us, tie}]
    is_event = F.col("_point.place") == SELF
    lasts = {name: value for name, value in (lasts or {}).items()}
    base = events.withColumns({f"_v_{name}": value for name, value in lasts.items()})
    carried = F.struct(*payload) if payload else F.struct(F.lit(0).alias("_none"))
    rows = (
        base.withColumn("_point", F.explode(F.array_compact(F.array(*points))) if moved else points[0])
        .select(
            *keys,
            F.col("_point.at").alias(time_us),
            F.col("_point.place").alias("_place"),
            F.lit(1).alias("_sub"),
            tie,
            *[F.col(f"_point.{n}").alias(n) for n in names],
            *[F.when(is_event, F.col(f"_v_{n}")).alias(f"_v_{n}") for n in lasts],
            F.when(is_event, carried).alias("_payload"),
        )
    )
    if markers is not None:
        rows = rows.unionByName(markers, allowMissingColumns=True).fillna(0, subset=names)
    swept = running(
        rows,
        keys,
        [time_us, "_place", tie, "_sub"],
        sums={n: F.col(n) for n in names},
        lasts={n: F.col(f"_v_{n}") for n in lasts},
        hot=hot,
    )
    kept = swept.filter((F.col("_place") == SELF) & (F.col("_sub") == 1))
    return kept.select(
        *keys, time_us, tie, *[F.col(f"_payload.{c}").alias(c) for c in payload], *names, *lasts
    )


def rows_back(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    back: int,
    outputs: Mapping[str, callable],
    hot: HotKeys | None = None,
) -> DataFrame:
    """Window values that look at most ``back`` rows back.

    ``outputs`` maps a name to a function from the ordered window to a column.
    For hot keys the rows are cut into blocks by row number, each preceded by
    the last ``back`` rows of the block before it.
    """
    if hot is None:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({name: make(window) for name, make in outputs.items()})
    size = max(hot.slice_rows, back + 1)
    numbered = running(df, keys, order, sums={"_row": F.lit(1)}, hot=hot)
    block = F.floor((F.col("_row") - 1) / size)
    spill = F.pmod(F.col("_row") - 1, F.lit(size)) >= size - back
    blocks = F.array_compact(
        F.array(
            F.struct(block.alias("block"), F.lit(False).alias("halo")),
            F.when(spill, F.struct((block + 1).alias("block"), F.lit(True).alias("halo"))),
        )
    )
    spread = numbered.withColumn("_b", F.explode(blocks)).select(
        "*", F.col("_b.block").alias("_block"), F.col("_b.halo").alias("_halo")
    )
    window = Window.partitionBy(*keys, "_block").orderBy("_row")
    done = spread.withColumns({name: make(window) for name, make in outputs.items()})
    return done.filter(~F.col("_halo")).drop("_row", "_b", "_block", "_halo")


def dealt(events: DataFrame, table: DataFrame, keys: Sequence[str], salts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a lookup with a ``_salt``: the table's rows of hot keys are repeated once per salt.

    ``salts`` has ``keys..., n_salts`` and at most ``MAX_HOT_KEYS`` rows. The events
    of a hot key then spread over as many tasks as its size calls for.
    """
    few = F.broadcast(salts.select(*keys, "n_salts"))
    many = F.coalesce("n_salts", F.lit(1))
    salted = join_null_safe(events, few, keys).withColumn("_salt", F.pmod(F.xxhash64("session_id"), many).cast("int"))
    spread = join_null_safe(table, few, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1)))
    return salted.drop("n_salts"), spread.drop("n_salts")


def join_by_key(
    events: DataFrame, table: DataFrame, key: str, hot: HotKeys | None = None, placed: bool = False
) -> DataFrame:
    """Left join to a table with one row per key; hot keys are salted.

    Where the events are ``placed`` by the key already, the table is dealt by it too: a
    table that is small as stored may be many times as large in every task it is sent to.
    """
    if hot is None:
        return events.join(table.hint("merge") if placed else table, key, "left")
    salted, spread = dealt(events, table, [key], hot.table)
    return salted.join(spread, [key, "_salt"], "left").drop("_salt")


def join_counted(events: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a stored table with one row per ``keys`` and in ``n`` how many events ask for it.

    Missing keys match each other. The planner knows the table's size and broadcasts
    it if it is small; otherwise the rows that more events than the limit ask for
    are salted by that measured number.
    """
    limit = slice_rows(events)
    wanted, plain = table.filter(F.col("n") > limit), table.drop("n")
    if wanted.isEmpty():
        return join_null_safe(events, plain, keys)
    salts = wanted.orderBy(F.desc("n")).limit(MAX_HOT_KEYS).withColumn("n_salts", F.ceil(F.col("n") / F.lit(limit)).cast("int"))
    salted, spread = dealt(events, plain, keys, salts)
    return join_null_safe(salted, spread, [*keys, "_salt"]).drop("_salt")
