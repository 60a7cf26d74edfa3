"""Date and time columns without a time zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..missing import as_list, check_columns, quoted

DAY = 86_400_000_000
HOUR = 3_600_000_000

FIELDS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
}

UNITS = {"day": "days", "hour": "hours", "minute": "mins", "second": "secs"}


def parse_timestamp(text: Column, fmt: str | None = None) -> Column:
    parsed = text.try_cast("timestamp_ntz") if fmt is None else F.try_to_timestamp(text, F.lit(fmt))
    return parsed.cast("timestamp_ntz")


def to_timestamp(df: DataFrame, cols: Sequence[str] | str, fmt: str | None = None) -> DataFrame:
    """Text as timestamps, missing if unparsable."""
    return df.withColumns({c: parse_timestamp(quoted(c), fmt) for c in as_list(cols)})


def to_date_text(df: DataFrame, cols: Sequence[str] | str) -> DataFrame:
    """Timestamps as ``YYYY-MM-DD`` text."""
    return df.withColumns({c: F.date_format(quoted(c), "yyyy-MM-dd") for c in as_list(cols)})


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start.cast("timestamp_ntz"), end.cast("timestamp_ntz"))


def date_diff(df: DataFrame, a: str, b: str, granularity: str = "DAYS", out: str = "date_diff") -> DataFrame:
    """``a`` - ``b`` in whole days rounded down, in fractional hours, or as an interval."""
    check_columns(df, [a, b])
    unit, micros = granularity.upper(), micros_between(quoted(b), quoted(a))
    if "DAY" in unit:
        whole = micros - F.pmod(micros, F.lit(DAY))
        return df.withColumn(out, F.call_function("div", whole, F.lit(DAY)))
    if "HOUR" in unit:
        return df.withColumn(out, micros / F.lit(HOUR))
    return df.withColumn(out, quoted(a).cast("timestamp_ntz") - quoted(b).cast("timestamp_ntz"))


def current_timestamp_column(df: DataFrame, name: str = "date", at=None) -> DataFrame:
    """The time the query starts, or the fixed time ``at``."""
    now = F.current_timestamp() if at is None else F.lit(str(at))
    return df.withColumn(name, now.cast("timestamp_ntz"))


def extract_date_fields(df: DataFrame, col: str, fields: Sequence[str] = ("year", "month", "day")) -> DataFrame:
    """Add one integer column per field: year, month, day, hour."""
    unknown = [f for f in fields if f not in FIELDS]
    if unknown:
        raise ValueError(f"unknown fields {unknown}; choose from {list(FIELDS)}")
    check_columns(df, [col])
    return df.withColumns({f: FIELDS[f](quoted(col)).cast("bigint") for f in fields})


def shift_date(df: DataFrame, col: str, n: int = 1, unit: str = "day", out: str | None = None) -> DataFrame:
    """Move a timestamp by a fixed duration."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {list(UNITS)}, not {unit!r}")
    moved = quoted(col).cast("timestamp_ntz") + F.make_dt_interval(**{UNITS[unit]: F.lit(n)})
    return df.withColumn(out or col, moved)


def set_time_of_day(
    df: DataFrame, col: str, hour: int = 0, minute: int = 0, second: int = 0, out: str | None = None
) -> DataFrame:
    """Keep the day of a timestamp and set its time."""
    midnight = quoted(col).cast("date").cast("timestamp_ntz")
    time = F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute), F.lit(second))
    return df.withColumn(out or col, midnight + time)


def br_datetime(text: Column) -> Column:
    """ISO text as ``dd/MM/yyyy HH:mm:ss``; other text stays as it is."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}($|[T ])"), text.try_cast("timestamp_ntz"))
    return F.coalesce(F.date_format(iso, "dd/MM/yyyy HH:mm:ss"), text)


def format_datetime(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, br_datetime(quoted(col).cast("string")))
