"""Scalar expressions over event and score columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewatch import constants as C

TOP_FEATURES_TYPE = T.ArrayType(
    T.StructType(
        [T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType())]
    )
)


def event_us(time: Column) -> Column:
    """Event time as microseconds since the epoch."""
    return F.unix_micros(time.cast("timestamp"))


def hour_of(time: Column) -> Column:
    return F.hour(time)


def is_off_hours(hour: Column) -> Column:
    return hour.isin(C.OFF_HOURS)


def round_to(value: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: numpy's rounding, bit for bit."""
    scale = F.lit(10.0**digits)
    return F.rint(value * scale) / scale


def round4(value: Column) -> Column:
    return round_to(value, 4)


def at_most(value: Column, cap: float) -> Column:
    """Cap a value; unlike ``least``, null stays null."""
    return F.when(value > cap, cap).otherwise(value)


def clip01(value: Column) -> Column:
    """Limit to 0..1; null stays null."""
    return F.when(value < 0, 0.0).otherwise(at_most(value, 1.0))


def ip_prefix(ip: Column) -> Column:
    """First three octets of a four-part address, else null."""
    parts = F.split(ip, r"\.")
    return F.when(F.size(parts) == 4, F.substring_index(ip, ".", 3))


def finite_or_null(value: Column) -> Column:
    infinite = value.isin(float("inf"), float("-inf"))
    return F.when(~(F.isnan(value) | infinite), value)


def clean_nulls(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become null."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({name: finite_or_null(F.col(name)) for name in floats})


def fill_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Missing or NaN model inputs become zero."""
    return df.withColumns({n: F.coalesce(F.nanvl(F.col(n), F.lit(None)), F.lit(0.0)) for n in names})


def json_strings(text: Column) -> Column:
    """A JSON array of strings; malformed text gives an empty array."""
    parsed = F.from_json(text, T.ArrayType(T.StringType()))
    return F.coalesce(parsed, F.array().cast("array<string>"))


def pack_features(features: Column) -> Column:
    """``[["name", value], ...]`` as JSON text."""
    items = F.transform(
        features,
        lambda f: F.concat(F.lit('["'), f["feature"], F.lit('",'), f["value"].cast("string"), F.lit("]")),
    )
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def unpack_features(text: Column) -> Column:
    """Inverse of :func:`pack_features`; malformed text gives an empty array."""
    rows = F.from_json(text, T.ArrayType(T.ArrayType(T.StringType())))
    typed = F.transform(
        rows,
        lambda r: F.struct(
            F.try_element_at(r, F.lit(1)).alias("feature"),
            F.try_element_at(r, F.lit(2)).try_cast("double").alias("value"),
        ),
    )
    empty = F.array().cast(TOP_FEATURES_TYPE)
    return F.coalesce(F.when(F.forall(typed, lambda f: f["value"].isNotNull()), typed), empty)


def risk_band(score: Column) -> Column:
    return (
        F.when(score >= 0.80, "CRITICAL")
        .when(score >= 0.40, "HIGH")
        .when(score >= 0.25, "MEDIUM")
        .otherwise("LOW")
    )


def one_decimal(value: Column) -> Column:
    """Text with one decimal of a non-negative number, rounded on its exact binary value.

    ``20 * value - (2k + 1)`` tells the half below from the half above; split
    as ``16v - (2k + 1) + 4v`` every step is exact in binary arithmetic.
    """
    k = F.floor(value * 10)
    side = (value * 16 - (2 * k + 1)) + value * 4
    up = (side > 0) | ((side == 0) & (k % 2 == 1))
    tenths = k + up.cast("long")
    whole = F.floor(tenths / 10).cast("string")
    return F.concat(whole, F.lit("."), (tenths % 10).cast("string"))


def whole_number(value: Column) -> Column:
    """Text without decimals, halves rounded to even."""
    return F.rint(value).cast("long").cast("string")


def threat_score(score: Column) -> Column:
    """Risk on a 0-100 scale with one decimal."""
    return one_decimal(score * 100)


def title_case(name: Column) -> Column:
    """snake_case to Title Case; a missing name reads "Unknown"."""
    titled = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    return F.when(F.coalesce(name, F.lit("")) == "", "Unknown").otherwise(titled)


def text_map(entries: dict[str, str]) -> Column:
    return F.expr("map({})".format(", ".join(f"'{k}', '{v}'" for k, v in entries.items())))


def _named(entries: dict[str, str], name: Column) -> Column:
    return F.coalesce(
        F.try_element_at(text_map(entries), name), F.replace(name, F.lit("_"), F.lit(" "))
    )


def feature_phrase(name: Column) -> Column:
    return _named(C.FEATURE_PHRASES, name)


def feature_title(name: Column) -> Column:
    return _named(C.FEATURE_TITLES, name)


def normal_auth_result(result: Column) -> Column:
    """Externally supplied rows may say "failure"; the event model says "fail"."""
    return F.when(result == "failure", "fail").otherwise(result)
