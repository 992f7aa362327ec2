"""Periods: by calendar days, with matching prior periods, and by timestamps. The two differ on purpose.

The reference day is one value that the driver gets first, so that a period is a filter by literal days: it reaches the
scans below the joins, and prunes partitions, files and row groups.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIODS = ("LAST_7_DAYS", "LAST_30_DAYS", "MTD", "YTD")


def _checked(period: str) -> str:
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}; one of {', '.join(PERIODS)}")
    return period


def month_name(day: str) -> str:
    """The column by which stored facts are partitioned, with the first day of the month of a column of days."""
    return f"{day}_month"


@dataclass(frozen=True)
class Latest:
    """What a stored table knows of itself: the column of its days and the latest of them."""

    column: str
    day: dt.date | None


def day_of(df: DataFrame, date_col: str = "date", as_of: str | None = None) -> Column:
    """The day as_of, else the latest day of df, as a literal; null if there is none. Stored facts are not read for it."""
    if as_of is not None:
        return F.lit(as_of).cast("date")
    known = getattr(df, "latest", None)
    if known is not None and known.column == date_col:
        return F.lit(known.day).cast("date")
    return F.lit(df.agg(F.max(date_col).cast("date")).first()[0]).cast("date")


def moment_of(df: DataFrame, ts_col: str) -> Column | None:
    """The latest moment of df, as a literal; None if there is none. Of stored facts, only the latest day is read, if the day is that of the moment."""
    known = getattr(df, "latest", None)
    rows = df
    if known is not None and known.day is not None:
        if df.schema[ts_col].dataType.typeName() == "date" and ts_col == known.column:
            return F.lit(known.day).cast("timestamp")
        rows = within(df, F.lit(known.day), None, known.column)
    micros = rows.agg(F.unix_micros(F.max(ts_col).cast("timestamp"))).first()[0]
    return None if micros is None else F.timestamp_micros(F.lit(micros))


def within(df: DataFrame, first: Column | None, last: Column | None, date_col: str = "date") -> DataFrame:
    """Rows from the first to the last day, both included; without one of them, it is open. Stored facts are read by month."""
    for bound, after in ((first, True), (last, False)):
        if bound is None:
            continue
        bound = bound.cast("date")
        month = month_name(date_col)
        for name, b in [(date_col, bound)] + [(month, F.trunc(bound, "month"))] * (month in df.columns):
            df = df.where(F.col(name) >= b if after else F.col(name) <= b)
    return df


def reference_day(df: DataFrame, date_col: str = "date", as_of: str | None = None) -> DataFrame:
    """One row (ref): the day as_of, else the latest day of df."""
    return df.sparkSession.range(1).select(day_of(df, date_col, as_of).alias("ref"))


def start_of(period: str, ref: Column) -> Column:
    return {"LAST_7_DAYS": F.date_sub(ref, 6), "LAST_30_DAYS": F.date_sub(ref, 29), "MTD": F.trunc(ref, "month"), "YTD": F.trunc(ref, "year")}[_checked(period)]


def prior_of(period: str, ref: Column) -> tuple[Column, Column]:
    """First and last day of the period before: the block of equal length, or as many days of the month or year before."""
    if _checked(period) in ("LAST_7_DAYS", "LAST_30_DAYS"):
        n = 7 if period == "LAST_7_DAYS" else 30
        return F.date_sub(ref, 2 * n - 1), F.date_sub(ref, n)
    if period == "MTD":
        first = F.add_months(F.trunc(ref, "month"), -1)
        days = F.least(F.datediff(ref, F.trunc(ref, "month")) + 1, F.dayofmonth(F.last_day(first)))
        return first, F.date_add(first, days - 1)
    first = F.add_months(F.trunc(ref, "year"), -12)
    return first, F.date_add(first, F.datediff(ref, F.trunc(ref, "year")))


def four_days(period: str, ref: Column) -> dict[str, Column]:
    """First and last day of a named period and of the one before."""
    a, b = prior_of(period, ref)
    return {"current_start": start_of(period, ref), "current_end": ref, "prior_start": a, "prior_end": b}


def period_bounds(df: DataFrame, period: str, date_col: str = "date", as_of: str | None = None) -> DataFrame:
    """One row (start_date, end_date)."""
    ref = F.col("ref")
    return reference_day(df, date_col, as_of).select(start_of(period, ref).alias("start_date"), ref.alias("end_date"))


def prior_bounds(df: DataFrame, period: str, date_col: str = "date", as_of: str | None = None) -> DataFrame:
    """One row (start_date, end_date) of the period before."""
    a, b = prior_of(period, F.col("ref"))
    return reference_day(df, date_col, as_of).select(a.alias("start_date"), b.alias("end_date"))


def in_period(df: DataFrame, period: str, date_col: str = "date", as_of: str | None = None) -> DataFrame:
    """df in a named period, with its days as columns start_date and end_date; null days drop rows."""
    ref = day_of(df, date_col, as_of)
    start = start_of(period, ref)
    return within(df, start, ref, date_col).withColumns({"start_date": start, "end_date": ref})


def between_days(df: DataFrame, first: str | None, last: str | None, date_col: str = "date") -> DataFrame:
    """Literal days, both included; nothing if one of them is None."""
    if first is None or last is None:
        return df.limit(0)
    return within(df, F.lit(first), F.lit(last), date_col)


def last_days(df: DataFrame, days: int, date_col: str = "date", ref: Column | None = None) -> DataFrame:
    """The last so many days up to the reference day (df's latest one, if none is given)."""
    ref = day_of(df, date_col) if ref is None else ref
    return within(df, F.date_sub(ref, days - 1), ref, date_col)


def labelled_days(df: DataFrame, days: int, date_col: str = "date", ref: Column | None = None) -> DataFrame:
    """Rows of the last so many days and as many before, with slice 'current' or 'prior'."""
    ref = day_of(df, date_col) if ref is None else ref
    day = F.col(date_col)
    rows = within(df, F.date_sub(ref, 2 * days - 1), ref, date_col)
    return rows.withColumn("slice", F.when(day > F.date_sub(ref, days), "current").otherwise("prior"))


def labelled_period(df: DataFrame, period: str, ref: Column, date_col: str = "date") -> DataFrame:
    """Rows of a named period up to the reference day and of the one before, with slice 'current' or 'prior'."""
    days, day = four_days(period, ref), F.col(date_col)
    now = day.between(days["current_start"], days["current_end"])
    rows = within(df, days["prior_start"], days["current_end"], date_col).where(now | (day <= days["prior_end"]))
    return rows.withColumn("slice", F.when(now, "current").otherwise("prior"))


def since_timestamp(df: DataFrame, period: str, ts_col: str) -> DataFrame:
    """The timestamp form: 7 or 30 days back from the latest moment, or from the month's or year's start.

    Unknown periods mean 30 days. Without such a column, or without any moment in it, df comes back as it is. For
    days at midnight, 7 days span 8 dates.
    """
    last = moment_of(df, ts_col) if ts_col in df.columns else None
    if last is None:
        return df
    start = {"LAST_7_DAYS": last - F.expr("interval 7 days"), "MTD": F.date_trunc("month", last), "YTD": F.date_trunc("year", last)}.get(period, last - F.expr("interval 30 days"))
    known = getattr(df, "latest", None)
    rows = df if known is None else within(df, start, None, known.column)  # a moment's day is not before its period's
    return rows.where(F.col(ts_col).cast("timestamp") >= start)
