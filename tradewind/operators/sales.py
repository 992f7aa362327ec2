"""Sales reports: totals, breakdowns, product tables, comparisons of a period with the one before.

Comparisons read the facts once: rows are labelled by slice and summed conditionally, which equals the full outer
join of two aggregates; orders are told apart first, so that no row is expanded for distinct counts. Shares and limits
work on aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions.columns import pct_change, ratio, ratio0, total

# The columns that reports may group by, and their metrics.
GROUPS = ("type", "color", "item_name", "asin", "size")
METRICS = ("revenue", "pairs_sold", "units_sold_amazon", "orders")


def sums(when: Column | None = None, prefix: str = "") -> list[Column]:
    """revenue, pairs_sold, units_sold_amazon and distinct orders, of the rows that fit a condition."""
    value = lambda c: F.col(c) if when is None else F.when(when, F.col(c))
    return [
        total(value("revenue")).cast("double").alias(f"{prefix}revenue"),
        total(value("pairs_sold")).cast("long").alias(f"{prefix}pairs_sold"),
        total(value("units_sold_amazon")).cast("long").alias(f"{prefix}units_sold_amazon"),
        F.count_distinct(value("order_id")).alias(f"{prefix}orders"),
    ]


def both_sums(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """By keys: sums() as current_ and prior_ columns, of rows labelled by slice."""
    keys = keys or []
    values = {"revenue": "double", "pairs_sold": "long", "units_sold_amazon": "long"}
    orders = rows.groupBy(*keys, "slice", "order_id").agg(*(F.sum(c).alias(c) for c in values))
    out = []
    for prefix, of in (("current_", F.col("slice") == "current"), ("prior_", F.col("slice") == "prior")):
        out += [total(F.when(of, F.col(c))).cast(kind).alias(prefix + c) for c, kind in values.items()]
        out.append(F.count_if(of & F.col("order_id").isNotNull()).alias(f"{prefix}orders"))
    return orders.groupBy(*keys).agg(*out)


def kpis(prefix: str = "") -> dict[str, Column]:
    """Average order value and prices of summed columns; 0 where there is nothing to divide by."""
    revenue = F.col(f"{prefix}revenue")
    return {f"{prefix}{n}": ratio0(revenue, F.col(f"{prefix}{c}")) for n, c in (("aov", "orders"), ("avg_unit_price", "units_sold_amazon"), ("avg_price_per_pair", "pairs_sold"))}


def _one_of(name: str, allowed: tuple[str, ...]) -> str:
    if name not in allowed:
        raise ValueError(f"unknown name {name!r}; one of {', '.join(allowed)}")
    return name


def sales_summary(sales: DataFrame, period: str, as_of: str | None = None) -> DataFrame:
    """One row: totals and averages of a named period."""
    return P.in_period(sales, period, as_of=as_of).agg(*sums()).withColumns(kpis())


def sales_summary_days(sales: DataFrame, days: int) -> DataFrame:
    """One row: totals and averages of the last days and of as many before, and five percent changes."""
    both = both_sums(P.labelled_days(sales, days)).withColumns(kpis("current_") | kpis("prior_"))
    names = ("revenue", "orders", "pairs_sold", "units_sold_amazon", "aov")
    return both.withColumns({f"{n}_change_pct": pct_change(F.col(f"current_{n}"), F.col(f"prior_{n}")) for n in names})


def _with_whole(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df, an aggregate of few groups, with totals of some columns over all its rows."""
    return df.withColumns({n: F.sum(c).over(Window.partitionBy(F.lit(1))) for c, n in columns.items()})


def _largest(df: DataFrame, keys: list[str], by: str, top_n: int, columns: dict[str, str]) -> DataFrame:
    """The rows of an aggregate by keys that are first by a column, falling, then by keys, with totals of some columns over all its rows.

    The totals are a row of the same table, from ROLLUP, which is kept as the first of the top_n and one; so groups may
    be as many as there are rows, and none but these few meet in one task.
    """
    values = [c for c in df.columns if c not in keys]
    both = df.groupingSets([keys, []], *keys).agg(*(F.first(c).alias(c) for c in values), *(F.sum(c).alias(n) for c, n in columns.items()), F.grouping(keys[0]).alias("_all"))
    first = both.orderBy(F.desc("_all"), F.desc(by), *keys).limit(top_n + 1)
    whole = Window.partitionBy(F.lit(1))
    first = first.withColumns({n: F.max(F.when(F.col("_all") == 1, F.col(n))).over(whole) for n in columns.values()})
    return first.where("_all = 0").drop("_all")


def sales_breakdown(sales: DataFrame, period: str, group_by: str, metric: str = "revenue", top_n: int = 10, as_of: str | None = None) -> DataFrame:
    """Totals by one column, with the metric's share of all groups, the largest first; the period's days are columns."""
    _one_of(group_by, GROUPS), _one_of(metric, METRICS)
    rows = P.in_period(sales, period, as_of=as_of).dropna(subset=[group_by])
    grouped = rows.groupBy(group_by).agg(*sums(), F.first("start_date").alias("start_date"), F.first("end_date").alias("end_date"))
    first = _largest(grouped, [group_by], metric, top_n, {metric: "_whole"})
    return first.withColumn(f"{metric}_pct", ratio0(F.col(metric), F.col("_whole"))).drop("_whole").orderBy(F.desc(metric), group_by)


def _long(pairs: DataFrame, names: list[str]) -> DataFrame:
    """(metric, current, prior) of one row of current_ and prior_ columns."""
    rows = [F.struct(F.lit(n).alias("metric"), F.col(f"current_{n}").cast("double").alias("current"), F.col(f"prior_{n}").cast("double").alias("prior")) for n in names]
    return pairs.select(F.inline(F.array(*rows)))


def compare_periods(sales: DataFrame, period: str, as_of: str | None = None) -> DataFrame:
    """(metric, current, prior, change_abs, change_pct) of a named period and the one before."""
    rows = P.labelled_period(sales, period, P.day_of(sales, as_of=as_of))
    both = both_sums(rows).withColumns(kpis("current_") | kpis("prior_"))
    table = _long(both, [*METRICS, "aov", "avg_unit_price", "avg_price_per_pair"])
    return table.withColumns({"change_abs": F.col("current") - F.col("prior"), "change_pct": pct_change(F.col("current"), F.col("prior"))})


def comparison_view(sales: DataFrame, period: str, as_of: str | None = None) -> DataFrame:
    """(metric, current, prior, change_pct) of revenue, orders, pairs and average order value."""
    return compare_periods(sales, period, as_of).where(F.col("metric").isin("revenue", "orders", "pairs_sold", "aov")).drop("change_abs")


def kpi_comparison(sales: DataFrame, period: str, as_of: str | None = None) -> DataFrame:
    """One row: the percent changes of comparison_view(), and the period's bounds."""
    ref = P.day_of(sales, as_of=as_of)
    both = both_sums(P.labelled_period(sales, period, ref)).withColumns(kpis("current_") | kpis("prior_") | P.four_days(period, ref))
    changes = [pct_change(F.col(f"current_{n}"), F.col(f"prior_{n}")).alias(f"{n}_change_pct") for n in ("revenue", "orders", "pairs_sold", "aov")]
    return both.select(*changes, "current_start", "current_end", "prior_start", "prior_end")


def _drivers(sales: DataFrame, period: str, keys: list[str], metric: str, ref: Column, top_n: int) -> DataFrame:
    grouped = both_sums(P.labelled_period(sales, period, ref).dropna(subset=keys), keys)
    table = grouped.select(*keys, F.col(f"current_{metric}").alias("current"), F.col(f"prior_{metric}").alias("prior"))
    table = table.withColumn("change_abs", F.col("current") - F.col("prior"))
    share = F.coalesce(ratio(F.col("change_abs"), F.col("_whole")), F.lit(0.0)) * 100
    return _largest(table, keys, "change_abs", top_n, {"change_abs": "_whole"}).withColumn("contribution_pct", share).drop("_whole")


def compare_drivers(sales: DataFrame, period: str, group_by: str, metric: str = "revenue", top_n: int = 10, as_of: str | None = None) -> DataFrame:
    """By one column: the metric now and before, its change and share of the whole change, the largest gains first."""
    _one_of(group_by, GROUPS), _one_of(metric, METRICS)
    return _drivers(sales, period, [group_by], metric, P.day_of(sales, as_of=as_of), top_n).orderBy(F.desc("change_abs"), group_by)


def explain_change(sales: DataFrame, period: str, dimension: str, metric: str = "revenue", top_n: int = 10, as_of: str | None = None) -> DataFrame:
    """compare_drivers() with percent changes and bounds; products go by asin and item_name."""
    _one_of(dimension, GROUPS), _one_of(metric, METRICS)
    keys = ["asin", "item_name"] if dimension == "asin" else [dimension]
    ref = P.day_of(sales, as_of=as_of)
    table = _drivers(sales, period, keys, metric, ref, top_n).withColumn("change_pct", pct_change(F.col("current"), F.col("prior")))
    return table.withColumns(P.four_days(period, ref)).orderBy(F.desc("change_abs"), *keys)


def top_products(sales: DataFrame, days: int, metric: str = "revenue", top_n: int = 10) -> DataFrame:
    keys = ["asin", "item_name", "type", "color", "size"]
    grouped = P.last_days(sales, days).dropna(subset=keys).groupBy(*keys).agg(*sums())
    c = F.col
    priced = grouped.withColumns({"aov": ratio(c("revenue"), c("orders")), "avg_price_per_pair": ratio(c("revenue"), c("pairs_sold"))})
    return priced.orderBy(F.desc(_one_of(metric, METRICS)), *keys).limit(top_n)


def mix(sales: DataFrame, days: int, key: str = "type") -> DataFrame:
    """By one column, over the last days: revenue, pairs and orders, and shares of revenue and pairs (null of a zero total)."""
    grouped = P.last_days(sales, days).dropna(subset=[key]).groupBy(key).agg(*sums()).drop("units_sold_amazon")
    shares = {"revenue_pct": ratio(F.col("revenue"), F.col("_r")), "pairs_pct": ratio(F.col("pairs_sold"), F.col("_p"))}
    return _with_whole(grouped, {"revenue": "_r", "pairs_sold": "_p"}).withColumns(shares).drop("_r", "_p")


def sales_by(sales: DataFrame, period: str, keys: list[str], top_n: int | None = None, ts_col: str = "purchase_date") -> DataFrame:
    """Over the timestamp form of a period, by some columns: revenue, orders, pairs, average order value, share in percent.

    Without such columns the result is empty.
    """
    if any(k not in sales.columns for k in keys):
        return sales.limit(0).select(F.lit("").alias("missing"))
    rows = P.since_timestamp(sales, period, ts_col).dropna(subset=keys)
    grouped = rows.groupBy(*keys).agg(*sums()).drop("units_sold_amazon").withColumn("aov", ratio0(F.col("revenue"), F.col("orders")))
    share = ratio0(F.col("revenue"), F.col("_whole")) * 100.0
    if top_n is None:
        return _with_whole(grouped, {"revenue": "_whole"}).withColumn("revenue_share", share).drop("_whole")
    return _largest(grouped, keys, "revenue", top_n, {"revenue": "_whole"}).withColumn("revenue_share", share).drop("_whole").orderBy(F.desc("revenue"), *keys)


# The columns of a sales analysis.
DIMENSIONS = ("type", "size", "color", "ship_state")


def sales_by_dimensions(sales: DataFrame, period: str, dimensions: tuple[str, ...] = DIMENSIONS, ts_col: str = "purchase_date") -> DataFrame:
    """(dimension, value, revenue, pairs_sold, orders, aov, revenue_share): sales_by() for each of the columns that there are, from one scan.

    Rows are first summed by all of the columns and the order, so that GROUPING SETS multiply these sums, and orders are
    told apart exactly in each set.
    """
    names = [d for d in dimensions if d in sales.columns]
    parts = {"revenue": "double", "pairs_sold": "long"}
    orders = P.since_timestamp(sales, period, ts_col).groupBy(*names, "order_id").agg(*(F.sum(c).alias(c) for c in parts))
    found = orders.groupingSets([[d] for d in names], *names).agg(
        *(total(F.col(c)).cast(kind).alias(c) for c, kind in parts.items()), F.count_distinct("order_id").alias("orders"), *(F.grouping(d).alias(f"_{k}") for k, d in enumerate(names))
    )
    # A set's own column is the one that is not grouped away.
    own = [F.when(F.col(f"_{k}") == 0, F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))) for k, d in enumerate(names)]
    table = found.select(F.coalesce(*own).alias("own"), *parts, "orders").select("own.*", *parts, "orders").where("value is not null")
    whole = F.sum("revenue").over(Window.partitionBy("dimension"))
    return table.withColumns({"aov": ratio0(F.col("revenue"), F.col("orders")), "revenue_share": ratio0(F.col("revenue"), whole) * 100.0})


def velocity(sales: DataFrame, period: str, top_n: int = 20, ts_col: str = "purchase_date") -> DataFrame:
    """By product: pairs and revenue a day, over the whole days between the first and the last moment, and one."""
    rows = P.since_timestamp(sales, period, ts_col)
    grouped = rows.groupBy("product_name").agg(*sums()[:2], F.min(ts_col).alias("_first"), F.max(ts_col).alias("_last"))
    # All rows have a part in the span, those without a product in nothing else.
    named = F.col("product_name").isNotNull()
    both = grouped.withColumn("_all", F.explode(F.when(named, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    both = both.groupBy(F.when(F.col("_all") == 0, F.col("product_name")).alias("product_name"), "_all").agg(F.sum("revenue").alias("revenue"), F.sum("pairs_sold").alias("pairs_sold"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    first = both.orderBy(F.desc("_all"), F.desc("revenue"), "product_name").limit(top_n + 1)
    whole = lambda f, c: f(F.when(F.col("_all") == 1, F.col(c))).over(Window.partitionBy(F.lit(1)))
    days = F.greatest(F.floor((F.unix_seconds(whole(F.max, "_last")) - F.unix_seconds(whole(F.min, "_first"))) / 86400) + 1, F.lit(1))
    c = F.col
    daily = first.withColumn("days", days).where("_all = 0").withColumns({"pairs_per_day": ratio(c("pairs_sold"), c("days")), "revenue_per_day": ratio(c("revenue"), c("days"))})
    return daily.drop("days", "_all", "_first", "_last").orderBy(F.desc("revenue"), "product_name")


def weekday_sales(sales: DataFrame, period: str, ts_col: str = "purchase_date") -> DataFrame:
    """(day, weekday, revenue, orders): weekdays by name and number, Monday 0; orders are distinct ids, or rows if there are no ids."""
    rows = P.since_timestamp(sales, period, ts_col).where(F.col(ts_col).isNotNull())
    orders = F.count_distinct("order_id") if "order_id" in sales.columns else F.count("*")
    keys = [F.date_format(ts_col, "EEEE").alias("day"), F.weekday(ts_col).alias("weekday")]
    return rows.groupBy(*keys).agg(total(F.col("revenue")).cast("double").alias("revenue"), orders.alias("orders")).orderBy("weekday")


def best_worst_weekday(sales: DataFrame, period: str, ts_col: str = "purchase_date") -> DataFrame:
    days = weekday_sales(sales, period, ts_col)
    first = lambda f, sign: f("day", F.struct("revenue", sign * F.col("weekday")))
    return days.agg(first(F.max_by, -1).alias("best_day"), first(F.min_by, 1).alias("worst_day"))


def avg_daily_sales(sales: DataFrame, period: str, ts_col: str = "purchase_date") -> DataFrame:
    """Revenue over a fixed number of days: 7, or 365 for a year, else 30."""
    days = {"LAST_7_DAYS": 7, "YTD": 365}.get(period, 30)
    return P.since_timestamp(sales, period, ts_col).agg((total(F.col("revenue")).cast("double") / days).alias("avg_daily_sales"))


def topn_share_within(table: DataFrame, value: str, by: list[str], n: int) -> DataFrame:
    """The first n rows of a table by value, with each one's share of these n alone."""
    top = table.orderBy(F.desc(value), *by).limit(n)
    return top.withColumn("share", ratio(F.col(value), F.sum(value).over(Window.partitionBy(F.lit(1)))))


def totals_by(sales: DataFrame, key: str, since: str | None = None) -> DataFrame:
    """By one column, of all time or since a day: totals."""
    rows = sales if since is None else P.within(sales, F.lit(since), None)
    return rows.dropna(subset=[key]).groupBy(key).agg(*sums())


def monthly_sales(sales: DataFrame) -> DataFrame:
    return sales.where("date is not null").groupBy(F.trunc("date", "month").alias("month")).agg(*sums()).drop("units_sold_amazon")


def row_counts(**tables: DataFrame) -> DataFrame:
    """(table_name, n) of several tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
