"""Weekly trends: week keys, gap weeks, joined weekly tables, trend verdicts, pivots.

Windows over weeks run on one row a week, after aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions.columns import ratio, ratio0, total, week_ending_monday, week_ending_saturday, week_from_monday
from .ads import ad_ratios, ad_sums
from .sales import sums

#: Metrics of which more is better.
BETTER_UP = ("revenue", "aov", "roas", "three_pack_share")


def with_gap_weeks(weekly: DataFrame, week: str = "week") -> DataFrame:
    """A table of one row a week with the weeks that are missing between, as rows of nulls; each row is followed by the weeks up to the next."""
    last = F.coalesce(F.date_sub(F.lead(week).over(Window.partitionBy(F.lit(1)).orderBy(week)), 7), F.col(week))
    rows = weekly.where(F.col(week).isNotNull()).withColumn("_last", last).withColumn("_week", F.explode(F.sequence(week, "_last", F.expr("interval 7 days"))))
    return rows.select(F.col("_week").alias(week), *(F.when(F.col("_week") == F.col(week), F.col(c)).alias(c) for c in weekly.columns if c != week))


def by_week(df: DataFrame, key: Column, aggregates: list[Column], also: list[str] | None = None, gaps: bool = False) -> DataFrame:
    """Aggregates by week, and by further columns; gaps: weeks without rows too, with sums of 0."""
    keys = also or []
    rows = df.where("date is not null").dropna(subset=keys) if keys else df.where("date is not null")
    weekly = rows.groupBy(key.alias("week"), *keys).agg(*aggregates)
    if not gaps:
        return weekly
    return with_gap_weeks(weekly).fillna(0)


def lookback(df: DataFrame, ref: Column, weeks: int = 12) -> DataFrame:
    """Rows from weeks * 7 - 1 days before the reference day on."""
    return P.within(df, F.date_sub(ref, weeks * 7 - 1), None)


def three_pack_share(sales: DataFrame, token: str = "3-pack") -> DataFrame:
    """By week ending on Saturday: the share of revenue whose type holds a token, in any case."""
    weekly = by_week(sales, week_ending_saturday(F.col("date")), [_revenue_of(token), total(F.col("revenue")).cast("double").alias("revenue")])
    return weekly.select("week", ratio(F.col("_part"), F.col("revenue")).alias("three_pack_share"))


def _revenue_of(token: str) -> Column:
    """The revenue of types that hold a token, in any case."""
    return total(F.when(F.lower("type").contains(token.lower()), F.col("revenue"))).cast("double").alias("_part")


def metric_trend_weekly(sales: DataFrame, ppc: DataFrame, weeks: int = 12, token: str = "3-pack") -> DataFrame:
    """By week ending on Saturday: sales, ads and ratios of the last weeks; the first week may be partial, empty ones stay."""
    ref = P.day_of(sales)
    sold, ads = lookback(sales, ref, weeks), lookback(ppc, ref, weeks)
    week = week_ending_saturday(F.col("date"))
    weekly = by_week(sold, week, [*sums(), _revenue_of(token)], gaps=True)
    spent = by_week(ads, week, [total(F.col("spend")).cast("double").alias("ad_spend"), total(F.col("sales")).cast("double").alias("ad_sales")], gaps=True)
    c = F.col
    table = weekly.join(spent, "week", "left").fillna(0, ["ad_spend", "ad_sales"]).withColumn("three_pack_share", ratio(c("_part"), c("revenue"))).drop("_part")
    return table.withColumns(
        {"aov": ratio(c("revenue"), c("orders")), "acos": ratio(c("ad_spend"), c("ad_sales")), "roas": ratio(c("ad_sales"), c("ad_spend")), "tacos": ratio(c("ad_spend"), c("revenue"))}
    )


def metric_trend_summary(weekly: DataFrame, metric: str, points: bool = False) -> DataFrame:
    """One row on the weeks that have the metric: recent and prior means, change, direction, volatility, best and worst week.

    Eight weeks and more: the last four against the four before; four to seven: against the first ones; fewer than
    five leave no prior mean, and the direction is insufficient_data. points: the weeks and values as an array, too.
    """
    m = F.col(metric).cast("double")
    rows = weekly.where(m.isNotNull()).select("week", m.alias("m"))
    whole = Window.partitionBy(F.lit(1))
    rows = rows.withColumns({"at": F.row_number().over(whole.orderBy(F.desc("week"))), "n": F.count("*").over(whole)})
    prior = F.when((F.col("n") < 8) | (F.col("at") <= 8), F.when(F.col("at") > 4, F.col("m")))
    one = rows.agg(
        F.count("*").alias("weeks"), F.avg(F.when(F.col("at") <= 4, F.col("m"))).alias("recent_avg"), F.avg(prior).alias("prior_avg"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"),
        F.max_by("week", F.struct("m", -F.datediff("week", F.lit("1970-01-01")))).alias("best_week"), F.min_by("week", F.struct("m", "week")).alias("worst_week"), F.array_sort(F.collect_list(F.struct("week", F.col("m").alias("value")))).alias("points"),
    )
    one = one.withColumn("change_pct", ratio(F.col("recent_avg"), F.col("prior_avg")) * 100 - 100)
    change, up = F.col("change_pct"), metric in BETTER_UP
    direction = F.when(change.isNull(), "insufficient_data").when(change > 5, "improving" if up else "worsening").when(change < -5, "worsening" if up else "improving").otherwise("stable")
    spread = ratio(F.col("std"), F.col("mean"))
    volatility = F.when(spread > 0.30, "high").when(spread > 0.15, "moderate").otherwise("low")
    return one.select(F.lit(metric).alias("metric"), "weeks", "recent_avg", "prior_avg", "change_pct", direction.alias("direction"), volatility.alias("volatility"), "best_week", "worst_week", *["points"] * points)


def revenue_tacos_trend(sales: DataFrame, ppc: DataFrame, weeks: int = 12) -> DataFrame:
    """By week from Monday: revenue, spend, tacos (0 without revenue), and a label; empty weeks stay away."""
    last = F.greatest(P.day_of(sales), P.day_of(ppc))
    since = lambda df: P.within(df, F.date_sub(last, 7 * weeks), None)
    week = week_from_monday(F.col("date"))
    sold = by_week(since(sales), week, [total(F.col("revenue")).cast("double").alias("revenue")])
    ads = by_week(since(ppc), week, [total(F.col("spend")).cast("double").alias("spend")])
    table = sold.join(ads, "week", "left").fillna(0, ["spend"]).withColumn("tacos", ratio0(F.col("spend"), F.col("revenue")))
    return table.withColumns({"tacos_pct": F.col("tacos") * 100, "label": F.date_format("week", "MMM dd")})


def weekly_sales(sales: DataFrame) -> DataFrame:
    """By week ending on Monday, empty ones too."""
    return by_week(sales, week_ending_monday(F.col("date")), sums(), gaps=True)


def _weeks() -> Window:
    return Window.partitionBy(F.lit(1)).orderBy("week")


def rolling_weeks(weekly: DataFrame, column: str = "revenue", n: int = 4) -> DataFrame:
    """The mean of the last n weeks; null before there are n."""
    frame = _weeks().rowsBetween(1 - n, 0)
    return weekly.withColumn(f"rolling_{n}wk", F.when(F.count(column).over(frame) == n, F.avg(column).over(frame)))


def weekly_ppc(ppc: DataFrame) -> DataFrame:
    return by_week(ppc, week_ending_monday(F.col("date")), ad_sums(), gaps=True).withColumns(ad_ratios("", ("cpc", "cvr", "acos", "roas")))


def weekly_combined(sales: DataFrame, ppc: DataFrame) -> DataFrame:
    """Weekly sales with ads: organic sales, the ads' share, and spend to revenue."""
    ads = weekly_ppc(ppc).select("week", "spend", F.col("sales").alias("ad_sales"), F.col("orders").alias("ad_orders"), "clicks")
    table = weekly_sales(sales).join(ads, "week", "left")
    c = F.col
    return table.withColumns({"organic_sales": c("revenue") - c("ad_sales"), "ppc_share": ratio(c("ad_sales"), c("revenue")), "tacos": ratio(c("spend"), c("revenue"))})


def weekly_health(sales: DataFrame, ppc: DataFrame, report: DataFrame) -> DataFrame:
    """weekly_combined() with the business report of the week and a status of its conversion rate."""
    rows = weekly_combined(sales, ppc).join(report.select("week", "ordered_product_sales", "sessions", "conversion_rate"), "week", "left")
    rate = F.col("conversion_rate")
    return rows.withColumn("conversion_status", F.when(rate.isNull(), "NO DATA").when(rate >= 5.5, "GREEN").when(rate >= 4.5, "YELLOW").otherwise("RED"))


def wow_change(report: DataFrame, columns: tuple[str, ...] = ("sessions", "conversion_rate", "ordered_product_sales")) -> DataFrame:
    """Each column's change from the week before, as a share of it; null after a null or 0."""
    return report.withColumns({f"{c}_wow": ratio(F.col(c), F.lag(c).over(_weeks())) - 1 for c in columns})


def pivot_weeks(df: DataFrame, key: str, values: list[str], fill: bool = True, other: str | None = None) -> DataFrame:
    """Weeks ending on Monday by the values of a column: revenue. fill: 0 where there is none, else null. other: the name of a column for all other values."""
    known = F.col(key).isin(values)
    rows = df.where("date is not null").dropna(subset=[key])
    rows = rows.where(known) if other is None else rows.withColumn(key, F.when(known, F.col(key)).otherwise(other))
    table = rows.groupBy(week_ending_monday(F.col("date")).alias("week")).pivot(key, [*values, *([] if other is None else [other])]).agg(F.sum("revenue").cast("double"))
    return table.fillna(0.0) if fill else table


def weekly_sku_pivot(sales: DataFrame, key: str = "product_name", weeks: int = 3, ts_col: str = "purchase_date") -> DataFrame:
    """(product, week, units, velocity, avg_price) of the last weeks from Monday, and a TOTAL product; sorted by date, the latest week's units first.

    Long form: one row a product and week, so that the weeks need not be known before.
    """
    last = P.moment_of(sales, ts_col)
    start = None if last is None else last - F.expr(f"interval {7 * weeks} days")
    known = getattr(sales, "latest", None)
    rows = sales.limit(0) if last is None else (sales if known is None else P.within(sales, start, None, known.column)).where(F.col(ts_col) >= start)
    what = [total(F.col("units_sold_amazon")).cast("long").alias("units"), total(F.col("revenue")).cast("double").alias("_revenue")]
    week = week_from_monday(F.col(ts_col)).alias("week")
    each = rows.dropna(subset=[key]).groupBy(F.col(key).alias("product"), week).agg(*what)
    # A week's total comes from the same aggregate, as the set of weeks alone.
    both = each.groupingSets([["product", "week"], ["week"]], "product", "week").agg(F.sum("units").alias("units"), F.sum("_revenue").alias("_revenue"), F.grouping("product").alias("_all"))
    out = both.select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("product")).alias("product"), "week", "units", (F.col("units") / 7).alias("velocity"), ratio(F.col("_revenue"), F.col("units")).alias("avg_price"))
    return out.orderBy(F.desc("week"), F.desc("units"), "product")
