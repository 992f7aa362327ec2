"""Queries of the store, of all reports of a bundle, of the tools, and of the layout by order, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import (
    ADS, CHANGE, CHANGES, FIVE, KPIS, NOW, ORACLES, PPC, PRIOR, QUERIES, RATIOS, SALES, SUMS,
    ads, div, div0, inventory_table, make_sales, on_sales, ppc_table, prep, query, sales, sales_table, stored,
)
from .plans import report, table_functions, tools
from .sources import facts, tables

# The store


@query(f"WITH {SALES}, {PPC} SELECT 'sales' AS table_name, min(date) AS first, max(date) AS last, count(*) AS n FROM sales UNION ALL SELECT 'ppc', min(date), max(date), count(*) FROM ppc")
def facts_extent(spark: SparkSession, d: str) -> DataFrame:
    """First and last days of stored facts, from the files' footers."""
    sales_table(spark, d), ppc_table(spark, d)
    each = [facts.footer_extent(spark, stored(spark, d, n, make_sales), "date").select(F.lit(n).alias("table_name"), "first", "last", "n") for n in ("sales", "ppc")]
    return each[0].union(each[1])


@query(f"WITH {SALES} SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS n, CAST(sum(units_sold_amazon) AS BIGINT) AS units FROM sales GROUP BY 1")
def replaced_months(spark: SparkSession, d: str) -> DataFrame:
    """A store in which the later months were wrong and are replaced: its rows by month."""
    path, made = facts.new_path(spark, "replaced"), make_sales(spark, d)
    late = F.col("date") >= "2001-01-01"
    facts.write_facts(made.withColumn("units_sold_amazon", F.when(late, -1).otherwise(F.col("units_sold_amazon"))), path)
    facts.replace_months(made.where(late), path)
    return spark.read.parquet(path).groupBy(F.col("date_month").alias("month")).agg(F.count("*").alias("n"), F.sum("units_sold_amazon").alias("units"))


# All dimensions of a period

SINCE30 = "purchase_date >= last - INTERVAL 30 DAYS"
ONE = f"SELECT '{{0}}' AS dimension, value, revenue, pairs_sold, orders, {div0('revenue', 'orders')} AS aov, round({div0('revenue', 'sum(revenue) OVER ()')} * 100, 6) AS revenue_share FROM (SELECT {{0}} AS value, {SUMS()} FROM sales, r WHERE {SINCE30} AND {{0}} IS NOT NULL GROUP BY 1)"
BY_DIMENSION = " UNION ALL ".join(ONE.format(c) for c in sales.DIMENSIONS)
on_sales("sales_by_dimensions", lambda s: sales.sales_by_dimensions(s, "LAST_30_DAYS").withColumn("revenue_share", F.round("revenue_share", 6)), BY_DIMENSION)

# The layout by order: orders of a line's table are numbered, counted and summed where they are


def by_order(spark: SparkSession, d: str) -> DataFrame:
    """Sales in files dealt by order."""

    name = "sales_by_order_" + stored(spark, d, "sales", make_sales)[-32:]
    if not spark.catalog.tableExists(name):
        sold = sales_table(spark, d)
        tables.save_by_key(sold, name, "order_id", 16, facts.new_path(spark, name), facts.slices_for(sold.count()))
    return spark.table(name)


ORDER = ["order_id", "l_linenumber"]
LATEST = ["imported_at", "asin", "quantity", "revenue", "l_suppkey"]
QUERIES["dedupe_latest_by_order"] = lambda spark, d: prep.dedupe_latest(by_order(spark, d), ORDER, LATEST[0], LATEST[1:]).select(*ORDER, "asin", "quantity", "imported_at")
ORACLES["dedupe_latest_by_order"] = f"WITH {SALES} SELECT order_id, l_linenumber, asin, quantity, imported_at FROM sales QUALIFY row_number() OVER (PARTITION BY order_id, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in LATEST)}) = 1"
QUERIES["duplicates_by_order"] = lambda spark, d: prep.duplicates(by_order(spark, d), ORDER)
ORACLES["duplicates_by_order"] = f"WITH {SALES} SELECT order_id, l_linenumber, count(*) AS n FROM sales GROUP BY 1, 2 HAVING count(*) > 1"
QUERIES["order_totals"] = lambda spark, d: prep.order_totals(by_order(spark, d))
ORACLES["order_totals"] = f"WITH {SALES} SELECT order_id, count(*) AS lines, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(units_sold_amazon) AS BIGINT) AS units_sold_amazon, CAST(sum(pairs_sold) AS BIGINT) AS pairs_sold, min(date) AS date FROM sales GROUP BY 1"

# Reports


def _tables(spark: SparkSession, d: str) -> report.Tables:
    return {"sales": sales_table(spark, d), "ppc": ppc_table(spark, d), "inventory": prep.latest_snapshot(inventory_table(spark, d))}


_bundles: dict[tuple[str, str], str] = {}


def _bundle(spark: SparkSession, d: str) -> str:
    """Where the reports of the last 30 days are; they are written when one is first asked for."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _bundles:
        path = facts.new_path(spark, "reports")
        report.report_bundle(_tables(spark, d), "LAST_30_DAYS", path)
        _bundles[key] = f"{path}/period=LAST_30_DAYS"
    return _bundles[key]


def put(name: str, rows: Callable[[SparkSession, str], DataFrame], sql: str, rounded: tuple[str, ...] = ()) -> None:
    """Registers a query with its SQL; columns that depend on the order in which doubles are summed are rounded on both sides."""
    QUERIES[name] = lambda spark, d: rows(spark, d).withColumns({c: F.round(c, 6) for c in rounded})
    ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in rounded)}) FROM ({sql})" if rounded else sql


def on(*parts: str) -> str:
    """SQL over sales and ads."""
    return f"WITH {', '.join((SALES, PPC, *parts[:-1]))} {parts[-1]}"


def both(n: int) -> str:
    return f"(SELECT {SUMS(NOW.format(n=n), 'current_')}, {SUMS(PRIOR.format(n=n), 'prior_')} FROM sales, r)"


def both_kpis(n: int) -> str:
    return f"SELECT *, {KPIS('current_')}, {KPIS('prior_')} FROM {both(n)}"


LONG = ["revenue", "pairs_sold", "units_sold_amazon", "orders", "aov", "avg_unit_price", "avg_price_per_pair"]


def compared(n: int) -> list[str]:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS metric, CAST(current_{c} AS DOUBLE) AS current, CAST(prior_{c} AS DOUBLE) AS prior FROM k" for c in LONG)
    return [f"k AS ({both_kpis(n)})", f"l AS ({rows})", f"cmp AS (SELECT *, current - prior AS change_abs, {CHANGE('current', 'prior')} AS change_pct FROM l)"]


def drivers(n: int, keys: str, top_n: int, more: str = "") -> str:
    notnull = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    inner = f"SELECT {keys}, current_revenue AS current, prior_revenue AS prior, current_revenue - prior_revenue AS change_abs FROM (SELECT {keys}, {SUMS(NOW.format(n=n), 'current_')}, {SUMS(PRIOR.format(n=n), 'prior_')} FROM sales, r WHERE date > ref - 2 * {n} AND {notnull} GROUP BY {keys})"
    return f"SELECT *, coalesce({div('change_abs', 'sum(change_abs) OVER ()')}, 0) * 100 AS contribution_pct{more} FROM ({inner}) ORDER BY change_abs DESC, {keys} LIMIT {top_n}"


def summary(n: int) -> str:
    return f"SELECT *, {KPIS()} FROM (SELECT {SUMS()} FROM sales, r WHERE date BETWEEN ref - {n - 1} AND ref)"


def breakdown(n: int, key: str) -> str:
    return f"SELECT *, {div0('revenue', 'sum(revenue) OVER ()')} AS revenue_pct FROM (SELECT {key}, {SUMS()}, min(ref - {n - 1}) AS start_date, min(ref) AS end_date FROM sales, r WHERE date BETWEEN ref - {n - 1} AND ref AND {key} IS NOT NULL GROUP BY 1) ORDER BY revenue DESC, {key} LIMIT 10"


TOP = "asin, item_name, type, color, size"


def top_products(n: int) -> str:
    return f"SELECT *, {div('revenue', 'orders')} AS aov, {div('revenue', 'pairs_sold')} AS avg_price_per_pair FROM (SELECT {TOP}, {SUMS()} FROM sales, r WHERE date >= ref - {n - 1} AND color IS NOT NULL AND size IS NOT NULL GROUP BY ALL) ORDER BY revenue DESC, {TOP} LIMIT 10"


def mix(n: int, key: str) -> str:
    return f"SELECT * EXCLUDE units_sold_amazon, {div('revenue', 'sum(revenue) OVER ()')} AS revenue_pct, {div('pairs_sold', 'sum(pairs_sold) OVER ()')} AS pairs_pct FROM (SELECT {key}, {SUMS()} FROM sales, r WHERE date >= ref - {n - 1} AND {key} IS NOT NULL GROUP BY 1)"


def ppc_summary(n: int) -> str:
    zero = ("ctr", "cvr", "cpc")
    return f"SELECT *, {CHANGES(('spend', 'sales', 'acos', 'roas'))} FROM (SELECT *, {RATIOS(FIVE, 'current_', zero)}, {RATIOS(FIVE, 'prior_', zero)} FROM (SELECT {ADS(NOW.format(n=n), 'current_')}, {ADS(PRIOR.format(n=n), 'prior_')} FROM ppc, pr))"


def marketing(n: int) -> tuple[str, ...]:
    columns = ("total_sales", "total_orders", *ads.COUNTS)
    ratios = lambda p: f"{div(p + 'spend', p + 'total_sales')} AS {p}tacos, {div(p + 'sales', p + 'total_sales')} AS {p}ad_sales_share, {RATIOS(('acos', 'roas', 'ctr'), p)}"
    daily = f"daily AS (SELECT s.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ads.COUNTS)} FROM (SELECT date, CAST(sum(revenue) AS DOUBLE) AS total_sales, count(DISTINCT order_id) AS total_orders FROM sales GROUP BY 1) s LEFT JOIN (SELECT date, {ADS()} FROM ppc GROUP BY 1) USING (date))"
    sums = f"SELECT {ADS(NOW.format(n=n), 'current_', columns)}, {ADS(PRIOR.format(n=n), 'prior_', columns)} FROM daily, (SELECT max(date) AS ref FROM daily)"
    return daily, f"SELECT *, {CHANGES(('total_sales', 'spend', 'sales', 'tacos'))} FROM (SELECT *, {ratios('current_')}, {ratios('prior_')} FROM ({sums}))"


MARKETING = tuple(f"{x}_{c}" for x in ("current", "prior") for c in ("total_sales", "spend", "sales", "tacos", "ad_sales_share", "acos", "roas", "ctr")) + tuple(f"{c}_change_pct" for c in ("total_sales", "spend", "sales", "tacos"))


def keywords(n: int, top_n: int) -> str:
    return f"SELECT *, {RATIOS(FIVE)} FROM (SELECT keyword, match_type, {ADS()} FROM ppc, pr WHERE date >= ref - {n - 1} GROUP BY 1, 2) WHERE clicks >= 5 ORDER BY sales DESC, keyword, match_type LIMIT {top_n}"


def bids() -> str:
    rules = [("clicks < 10 AND spend < 15", "Hold", "Not enough data yet", "cpc"), ("clicks >= 20 AND sales = 0", "Pause", "Enough clicks with no sales", "0.0"), ("sales = 0 AND spend >= 15", "Reduce bid", "Spend present but no sales yet", "cpc * 0.7"), ("acos > 0.25", "Reduce bid", "ACOS above target", "cpc * coalesce(0.25::DOUBLE / nullif(acos, 0), 1)"), ("acos <= 0.25 AND cvr >= 0.12", "Increase bid", "Profitable keyword with strong conversion", "cpc * coalesce(0.25::DOUBLE / nullif(acos, 0), 1)")]
    cases = ", ".join(f"CASE {' '.join(f'WHEN {b[0]} THEN {v(b)}' for b in rules)} ELSE {e} END AS {c}" for c, v, e in (("action", lambda b: f"'{b[1]}'", "'Hold'"), ("reason", lambda b: f"'{b[2]}'", "'Borderline or stable performance'"), ("suggested_cpc", lambda b: f"CAST({b[3]} AS DOUBLE)", "cpc")))
    return f"SELECT *, {cases}, 30 AS period_days, 0.25::DOUBLE AS target_acos FROM (SELECT *, {RATIOS(FIVE)} FROM (SELECT keyword, match_type, {ADS()} FROM ppc, pr WHERE date >= ref - 29 GROUP BY 1, 2)) ORDER BY spend DESC, clicks DESC, keyword, match_type LIMIT 50"


ACTION = "CASE WHEN spend >= 15 AND sales = 0 AND clicks >= 10 THEN 'Pause / Reduce' WHEN coalesce(acos, 0) >= 0.45 AND spend >= 15 THEN 'Lower Bid' WHEN coalesce(acos, 0) <= 0.25 AND sales > 0 AND coalesce(cvr, 0) >= 0.12 THEN 'Scale' WHEN sales > 0 THEN 'Monitor' ELSE 'Low Data' END AS recommended_action"
EVERY = ("acos", "roas", "ctr", "cvr")
SPAN = f"n AS (SELECT greatest(floor((epoch(max(purchase_date)) - epoch(min(purchase_date))) / 86400) + 1, 1) AS days FROM sales, r WHERE {SINCE30})"
CHANGED = ("revenue", "orders", "pairs_sold", "aov")

#: By report: its SQL for the last 30 days, and the columns to round.
REPORT_SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "sales_summary": (on(summary(30)), ()),
    "sales_breakdown": (on(breakdown(30, "type")), ("revenue_pct",)),
    "comparison": (on(*compared(30), f"SELECT * EXCLUDE change_abs FROM cmp WHERE metric IN {CHANGED}"), ()),
    "kpi_comparison": (on(*compared(30), f"SELECT {CHANGES(CHANGED)}, ref - 29 AS current_start, ref AS current_end, ref - 59 AS prior_start, ref - 30 AS prior_end FROM k, r"), ()),
    "drivers": (on(drivers(30, "type", 10)), ("contribution_pct",)),
    "top_products": (on(top_products(30)), ()),
    "product_mix": (on(mix(30, "type")), ("revenue_pct",)),
    "color_performance": (on(mix(30, "color")), ("revenue_pct",)),
    "sales_by_dimension": (on(BY_DIMENSION), ("revenue_share",)),
    "sales_by_product": (on(f"SELECT * FROM (SELECT * EXCLUDE units_sold_amazon, {div0('revenue', 'orders')} AS aov, {div0('revenue', 'sum(revenue) OVER ()')} * 100 AS revenue_share FROM (SELECT product_name, asin, {SUMS()} FROM sales, r WHERE {SINCE30} GROUP BY 1, 2)) ORDER BY revenue DESC, product_name, asin LIMIT 20"), ("revenue_share",)),
    "weekly_sku_pivot": (ORACLES["weekly_sku_pivot"] if "weekly_sku_pivot" in ORACLES else "", ("avg_price",)),
    "velocity": (on(SPAN, f"SELECT product_name, revenue, pairs_sold, {div('pairs_sold', 'days')} AS pairs_per_day, {div('revenue', 'days')} AS revenue_per_day FROM (SELECT product_name, {SUMS()} FROM sales, r WHERE {SINCE30} GROUP BY 1), n ORDER BY revenue DESC, product_name LIMIT 20"), ("pairs_per_day", "revenue_per_day")),
    "weekdays": (on(f"SELECT dayname(purchase_date) AS day, CAST(isodow(purchase_date) - 1 AS INT) AS weekday, CAST(sum(revenue) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders FROM sales, r WHERE {SINCE30} GROUP BY 1, 2"), ()),
    "ppc_summary": (on(ppc_summary(30)), ()),
    "ppc_kpis": (on(f"SELECT *, {RATIOS(EVERY, '', EVERY)}, {div0('spend', 'revenue')} AS tacos FROM (SELECT {ADS()} FROM ppc, pr WHERE date >= ref - 30), (SELECT CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales, r WHERE {SINCE30})"), ()),
    "marketing_summary": (on(*marketing(30)), MARKETING),
    "top_keywords": (on(keywords(30, 50)), ()),
    "keyword_actions": (on(f"SELECT *, {ACTION} FROM ({keywords(30, 50)})"), ()),
    "bid_recommendations": (on(bids()), ()),
    "revenue_tacos_trend": (ORACLES.get("revenue_tacos_trend", ""), ()),
    "inventory_risk": (ORACLES.get("inventory_risk", ""), ()),
}
for _name, (_sql, _round) in REPORT_SQL.items():
    put(f"bundle_{_name}", lambda spark, d, n=_name: spark.read.parquet(f"{_bundle(spark, d)}/{n}"), _sql, _round)

# Tools, by their names and with what they take if nothing is said


def tool(name: str, sql: str, rounded: tuple[str, ...] = (), **arguments: object) -> None:
    put(f"tool_{name}", lambda spark, d: tools.call_tool(_tables(spark, d), name, **arguments), sql, rounded)


FIVE_CHANGES = ("revenue", "orders", "pairs_sold", "units_sold_amazon", "aov")
tool("get_sales_summary", on(f"SELECT *, {CHANGES(FIVE_CHANGES)} FROM ({both_kpis(7)})"))
tool("get_ppc_summary", on(ppc_summary(7)))
tool("get_marketing_summary", on(*marketing(7)), MARKETING)
tool("get_top_keywords", on(keywords(30, 10)), days=30)
tool("get_top_products", on(top_products(90)), days=90)
tool("get_product_mix", on(mix(7, "type")), ("revenue_pct",))
tool("get_color_performance", on(mix(7, "color")), ("revenue_pct",))
tool("get_sales_summary_period", on(summary(7)))
tool("get_sales_breakdown", on(breakdown(7, "color")), ("revenue_pct",))
tool(
    "compare_periods",
    on(*compared(7), f"SELECT 'metric' AS kind, metric AS name, current, prior, change_abs, change_pct, NULL::DOUBLE AS contribution_pct FROM cmp UNION ALL SELECT 'driver', size, current, prior, change_abs, {CHANGE('current', 'prior')}, contribution_pct FROM ({drivers(7, 'size', 10)})"),
    ("contribution_pct",),
    group_by="size",
)
tool("explain_change", on(f"SELECT d.*, ref - 6 AS current_start, ref AS current_end, ref - 13 AS prior_start, ref - 7 AS prior_end FROM ({drivers(7, 'asin, item_name', 10, ', ' + CHANGE('current', 'prior') + ' AS change_pct')}) d, r"), ("contribution_pct",))
tool("get_keyword_bid_recommendations", on(bids()))
SAT = "date + CAST(6 - dayofweek(date) AS INT)"
TREND = (
    f"w AS (SELECT {SAT} AS week, CAST(sum(revenue) AS DOUBLE) / count(DISTINCT order_id) AS m FROM sales, r WHERE date >= ref - 83 GROUP BY 1)",
    "p AS (SELECT *, row_number() OVER (ORDER BY week DESC) AS pos, count(*) OVER () AS n FROM w)",
    "o AS (SELECT count(*) AS weeks, avg(m) FILTER (pos <= 4) AS recent_avg, avg(m) FILTER (pos > 4 AND (n < 8 OR pos <= 8)) AS prior_avg, avg(m) AS mean, stddev_samp(m) AS std, arg_max(week, m) AS best_week, arg_min(week, m) AS worst_week, list(m ORDER BY week) AS m FROM p)",
    "c AS (SELECT *, recent_avg / nullif(prior_avg, 0) * 100 - 100 AS change_pct, std / nullif(mean, 0) AS spread FROM o)",
    "SELECT 'aov' AS metric, weeks, recent_avg, prior_avg, change_pct, CASE WHEN change_pct IS NULL THEN 'insufficient_data' WHEN change_pct > 5 THEN 'improving' WHEN change_pct < -5 THEN 'worsening' ELSE 'stable' END AS direction, CASE WHEN spread > 0.3 THEN 'high' WHEN spread > 0.15 THEN 'moderate' ELSE 'low' END AS volatility, best_week, worst_week, len(m) AS points, list_sum(m) AS total FROM c",
)
put(
    "tool_get_metric_trend",
    lambda spark, d: tools.call_tool(_tables(spark, d), "get_metric_trend", metric="aov").withColumns({"total": F.aggregate("points", F.lit(0.0), lambda n, p: n + p["value"]), "points": F.size("points").cast("long")}),
    on(*TREND),
    ("recent_avg", "prior_avg", "change_pct", "total"),
)

# The same from SQL, by table functions

_functions: dict[tuple[str, str, str], str] = {}


def functions(spark: SparkSession, d: str) -> str:
    """The prefix of the table functions over a folder's facts; they are created when one is first asked for."""
    key = (spark.sparkContext.applicationId, spark._jsparkSession.sessionUUID(), d)  # temporary functions are a session's
    if key not in _functions:
        _functions[key] = f"f{len(_functions)}_"
        table_functions.create_functions(spark, _tables(spark, d), _functions[key])
    return _functions[key]


SQL_CALLS = {
    "get_sales_summary": ("", ()), "get_ppc_summary": ("days => 7", ()), "get_marketing_summary": ("", MARKETING), "get_top_keywords": ("days => 30", ()), "get_top_products": ("days => 90, metric => 'revenue'", ()),
    "get_product_mix": ("", ("revenue_pct",)), "get_color_performance": ("", ("revenue_pct",)), "get_sales_summary_period": ("period => 'LAST_7_DAYS'", ()), "compare_periods": ("group_by => 'size'", ("contribution_pct",)),
}
for _name, (_said, _round) in SQL_CALLS.items():
    put(f"sql_{_name}", lambda spark, d, n=_name, said=_said: spark.sql(f"SELECT * FROM {functions(spark, d)}{n}({said})"), ORACLES[f"tool_{_name}"], _round)
