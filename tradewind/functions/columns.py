"""Column helpers: safe ratios, cleaning of exported text, week keys, and lookup of optional columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio0(a: Column, b: Column) -> Column:
    """a / b as double; 0 where b is null or not above 0."""
    return F.when(b > 0, ratio(a, b)).otherwise(F.lit(0.0))


def total(column: Column) -> Column:
    """The sum, 0 of no or only null values."""
    return F.coalesce(F.sum(column), F.lit(0))


def numeric_total(df: DataFrame, name: str) -> Column:
    """The sum of a column of numbers or text, what is no number counting as 0; 0 if there is no such column."""
    return total(F.expr(f"try_cast(`{name}` as double)")) if name in df.columns else F.lit(0.0)


def pct_change(current: Column, prior: Column) -> Column:
    """Percent from prior to current; null where prior is null or 0."""
    return ratio((current - prior).cast("double"), prior) * 100


def clean_number(name: str, percent: bool = False) -> Column:
    """A text column such as $1,234.50 or 12% as a double; blank, nan, none and other text give null. percent: a hundredth."""
    text = F.trim(F.regexp_replace(F.col(name).cast("string"), "[$%,]", ""))
    number = F.when(F.lower(text).isin("", "nan", "none"), None).otherwise(text).try_cast("double")
    return number / 100 if percent else number


def text_time(column: Column, formats: tuple[str, ...] = ()) -> Column:
    """A timestamp from text in ISO form or the first of the formats that fits; else null."""
    return F.coalesce(F.try_to_timestamp(column), *(F.try_to_timestamp(column, F.lit(f)) for f in formats))


def utc_time(column: Column) -> Column:
    """Text in ISO form, with an offset or none (then it is UTC), as a time in UTC without a zone; other text gives null."""
    text = F.trim(column.cast("string"))
    zoned = F.when(text.rlike(r"(?i)(Z|UTC|[+-][0-9]{2}:?[0-9]{2})$") & text.rlike(":"), text).otherwise(F.concat(text, F.lit("Z")))
    moment = F.try_to_timestamp(F.when(text.rlike(":"), zoned).otherwise(F.concat(text, F.lit("T00:00:00Z"))))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz"))


def week_ending_saturday(day: Column) -> Column:
    return F.next_day(F.date_sub(day, 1), "SAT")


def week_ending_monday(day: Column) -> Column:
    return F.next_day(F.date_sub(day, 1), "MON")


def week_from_monday(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def first_existing(df: DataFrame, names: list[str]) -> str | None:
    """The first of the names that df has as a column."""
    return next((n for n in names if n in df.columns), None)


def normalized(df: DataFrame, renames: dict[str, str] | None = None, underscores: bool = False) -> DataFrame:
    """df with trimmed, lower-cased names (blanks and hyphens as _, if asked), then renamed."""
    names = [c.strip().lower() for c in df.columns]
    if underscores:
        names = [n.replace(" ", "_").replace("-", "_") for n in names]
    return df.toDF(*((renames or {}).get(n, n) for n in names))
