"""Date and time columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT_SECONDS = {"D": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0}


def timestamp_from_number(value: Column, epoch: str = "1950-01-01", unit: str = "D") -> Column:
    """Fractional units since the epoch, truncated to seconds; out of range, NaN or NULL gives NULL."""
    base = F.unix_seconds(F.lit(epoch).cast("timestamp"))
    seconds = F.floor(value.cast("double") * F.lit(UNIT_SECONDS[unit]) + base)
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) * F.lit(UNIT_SECONDS[unit]) < 2.0e11)
    return F.when(ok, F.timestamp_seconds(seconds.cast("long")))


def date_digits(text: Column) -> Column:
    """'2020-03-01 12:00' to '20200301'."""
    return F.regexp_replace(F.regexp_replace(text, r"\s.*$", ""), "-", "")


def timestamp_from_parts(year: Column, month: Column, day: Column, hhmmss: Column, strict: bool = True) -> Column:
    """From calendar columns and a number hhmmss; a bad date is an error, or NULL if not strict."""
    h, m, s = F.floor(hhmmss / 10000), F.floor(hhmmss / 100) % 100, hhmmss % 100
    make = F.make_timestamp_ntz if strict else F.try_make_timestamp_ntz
    return make(year, month, day, h.cast("int"), m.cast("int"), s.cast("int"))


def name_times(name: Column, scheme: str = "tokens_from_end") -> tuple[Column, Column]:
    """(start, end) in a file name: tokens -5 and -4, or date and time pairs from token 3 on."""
    parts = F.split(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", ""), "_")
    if scheme == "tokens_from_end":
        return tuple(F.to_timestamp_ntz(F.element_at(parts, k), F.lit("yyyyMMdd'T'HHmmss")) for k in (-5, -4))
    if scheme == "date_time_pairs":
        return tuple(F.to_timestamp_ntz(F.concat(F.element_at(parts, k + 1), F.element_at(parts, k + 2)), F.lit("yyyyMMddHHmmss")) for k in (3, 5))
    raise ValueError(f"unknown scheme {scheme!r}")


def spread_between(df: DataFrame, file_col: str, order_col: str, start: Column, end: Column, out: str = "datetime", whole_seconds: bool = False) -> DataFrame:
    """Even steps from the file's start to its end over its rows, in the given order."""
    w = Window.partitionBy(file_col)
    at = F.row_number().over(w.orderBy(order_col)) - 1
    n = F.count(F.lit(1)).over(w)
    a, b = F.unix_micros(start.cast("timestamp")), F.unix_micros(end.cast("timestamp"))
    df = df.withColumns({"_at": at, "_n": n, "_a": a, "_b": b})
    us = F.expr("_a + CASE WHEN _n > 1 THEN ((_b - _a) * _at) DIV (_n - 1) ELSE 0 END")
    us = F.floor(us / 1_000_000) * 1_000_000 if whole_seconds else us
    return df.withColumn(out, F.timestamp_micros(us.cast("long"))).drop("_at", "_n", "_a", "_b")


def days_since_epoch(ts: Column) -> Column:
    return F.unix_date(ts.cast("date")).cast("double")


def fractional_days(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86400e6)


def date_from_days(days: Column) -> Column:
    return F.date_from_unix_date(F.floor(days).cast("int"))
