"""The registered queries over the star-schema tables; see fixtures for the tables and the SQL they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import (
    ADS, BAD, CHANGE, CHANGES, FIVE, GOOD, KPIS, MON, NOW, ORACLES, PPC, PRIOR, QUERIES, RATIOS, REPORT, SALES, SAT, SPLIT, STOCK, SUMS, TOKEN, WEEK, YTD,
    _read, ads, div, div0, forecast, inventory_table, numeric_total, on_both, on_ppc, on_sales, P, ppc_table, prep, query, report_table, rootcause, sales, sales_table, trends,
)

from .functions.columns import utc_time
from .plans import report
from .sources import facts, tables

__all__ = ["ORACLES", "QUERIES"]


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Means of doubles depend on the order of summing in their last digits."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Sources and preparation


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_table(spark: SparkSession, d: str) -> DataFrame:
    return tables.scan_table(spark, "lineitem", d).select("l_orderkey", "l_linenumber", "l_quantity")


def _report_text(spark: SparkSession, d: str) -> DataFrame:
    """Weekly sums as the text of a business report."""
    return report_table(spark, d).select(
        F.date_format(F.date_sub("week", 1), "M/d/yy").alias("Date"), F.concat(F.lit("$"), F.format_number(F.round("ordered_product_sales", 2), 2)).alias("Ordered Product Sales"),
        F.format_number("sessions", 0).alias("Sessions - Total"), F.concat(F.format_number(F.round("conversion_rate", 2), 2), F.lit("%")).alias("Order Item Session Percentage"),
    )


REPORT_SQL = f"WITH {PPC}, {REPORT} SELECT week - 1 AS date, week, round(ordered_product_sales, 2) AS ordered_product_sales, sessions, round(conversion_rate, 2) AS conversion_rate FROM report"


@query(REPORT_SQL)
def scan_csv_report(spark: SparkSession, d: str) -> DataFrame:
    """The report written as a file of text and read again."""
    path = facts.new_path(spark, "report")
    _report_text(spark, d).write.option("header", True).csv(path)
    return prep.prep_business_report(tables.scan_csv_report(spark, path))


@query("SELECT event_id, epoch_us(ts) // 1000000 + CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN -7200 ELSE 19800 END AS moment FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 7 = 0")
def normalize_ts_utc(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(n % 3 == 0, F.when(n % 2 == 0, "Z").otherwise("")).when(n % 3 == 1, "+02:00").otherwise("-05:30"))
    rows = _read(spark, d, "events").select("event_id", utc_time(F.when(n % 7 == 0, "no time").otherwise(text)).alias("t"))
    return rows.select("event_id", F.datediff(F.col("t").cast("date"), F.lit("1970-01-01")).cast("long").alias("day"), "t").select(
        "event_id", (F.col("day") * 86400 + F.hour("t") * 3600 + F.minute("t") * 60 + F.second("t")).alias("moment")
    )


@query(f"WITH {STOCK} SELECT * FROM stock")
def scan_latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return prep.latest_snapshot(inventory_table(spark, d))


@query("SELECT 'lineitem' AS table_name, count(*) AS n FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    return sales.row_counts(**{n: _read(spark, d, n) for n in ("lineitem", "orders", "events")})


@query("SELECT max(CAST(o_orderdate AS DATE)) AS max_date FROM orders")
def max_date(spark: SparkSession, d: str) -> DataFrame:
    return P.reference_day(_read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"))).withColumnRenamed("ref", "max_date")


KINDS = {"ECONOMY": "single", "MEDIUM": "3-pack", "LARGE": "6-pack"}


@query(
    f"""WITH items AS (
      SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(o_orderdate AS TIMESTAMP) AS purchase_date, CAST(l_partkey AS VARCHAR) AS asin, CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice AS revenue,
        CASE WHEN p_name LIKE '%blue%' THEN 'Blue' END AS color, CASE WHEN p_name LIKE '%small%' THEN 'Small/Medium' WHEN p_name LIKE '%large%' THEN 'Large/X-Large' END AS size,
        CASE p_type WHEN 'MEDIUM' THEN 3 WHEN 'LARGE' THEN 6 ELSE 1 END AS pack_size
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size <= 40 AND o_orderstatus = 'F' AND CAST(l_quantity AS BIGINT) % 7 <> 0)
    SELECT order_id, asin, CAST(purchase_date AS DATE) AS date, quantity, revenue, revenue / quantity AS unit_price, color, size, pack_size, quantity AS units_sold_amazon, quantity * pack_size AS pairs_sold FROM items"""
)
def prep_sales(spark: SparkSession, d: str) -> DataFrame:
    items = _read(spark, d, "lineitem").join(_read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    quantity = F.col("l_quantity").cast("long")
    raw = items.select(
        F.col("l_orderkey").cast("string").alias(" Amazon-Order-Id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("purchase-date"), F.col("l_partkey").cast("string").alias("ASIN"),
        F.col("o_orderstatus").alias("sales-channel"), F.when(quantity % 7 == 0, F.when(quantity % 2 == 0, "0").otherwise("none")).otherwise(quantity.cast("string")).alias("quantity"),
        F.col("l_extendedprice").cast("string").alias("item-price"),
    )
    kind = F.coalesce(*(F.when(F.col("p_type") == a, b) for a, b in KINDS.items()), F.lit("other"))
    look = F.concat(F.initcap("p_name"), F.when(F.col("p_name").contains("small"), " Small/Medium").when(F.col("p_name").contains("large"), " Large/X-Large").otherwise(""))
    look = F.replace(look, F.lit("Large "), F.lit(""))
    catalogue = _read(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").cast("string").alias("asin"), look.alias("item"), kind.alias("type"))
    out = prep.prep_sales(raw, catalogue, "F")
    return out.select("order_id", "asin", "date", "quantity", "revenue", "unit_price", "color", "size", "pack_size", "units_sold_amazon", "pairs_sold")


@query(
    """WITH e AS (SELECT CAST(ts AS DATE) AS date, event_id, round(value, 2) AS v, user_id FROM events WHERE user_id % 4 = 1)
    SELECT date, 'Brand ' || (user_id % 4) AS campaign, CASE WHEN event_id % 5 = 0 THEN NULL ELSE v END AS spend, CAST(event_id % 9 AS DOUBLE) / 100 AS ctr, CAST(event_id % 3 AS DOUBLE) AS clicks,
      CAST(1000 + event_id AS DOUBLE) AS impressions, (event_id % 3) / CAST(1000 + event_id AS DOUBLE) AS ctr_calc FROM e"""
)
def prep_ppc(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    raw = _read(spark, d, "events").select(
        F.date_format("ts", "M/d/yy").alias("Date"), F.concat(F.lit("Brand "), F.col("user_id") % 4).alias("Campaign Name "),
        F.when(n % 5 == 0, "nan").otherwise(F.concat(F.lit(" $"), F.format_number(F.round("value", 2), 2))).alias("Spend"), F.concat(n % 9, F.lit("%")).alias("Click-Thru Rate (CTR)"),
        (n % 3).cast("string").alias("Clicks"), F.format_number(1000 + n, 0).alias("Impressions"), F.lit("0").alias("7 Day Total Orders (#)"), F.lit("$0").alias("7 Day Total Sales"),
    )
    return prep.prep_ppc(raw, "brand 1").select("date", "campaign", "spend", "ctr", "clicks", "impressions", "ctr_calc")


@query(REPORT_SQL)
def prep_business_report(spark: SparkSession, d: str) -> DataFrame:
    return prep.prep_business_report(_report_text(spark, d))


@query("SELECT CAST(coalesce(sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 0) AS DOUBLE) AS total, 0.0::DOUBLE AS missing FROM events")
def to_numeric_sum(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "events").select(F.get_json_object("props", "$.k").alias("k"))
    return rows.agg(numeric_total(rows, "k").cast("double").alias("total"), F.max(numeric_total(rows, "none").cast("double")).alias("missing"))


on_ppc("campaign_list", prep.campaigns, "SELECT DISTINCT campaign FROM ppc")
on_ppc("campaign_filter", lambda p: prep.of_campaign(p, "c2").groupBy("campaign").agg(F.count("*").alias("n")), "SELECT campaign, count(*) AS n FROM ppc WHERE campaign = 'c2' GROUP BY 1")
on_sales("order_lookup", lambda s: prep.order_lookup(s, 7, ["order_id", "asin", "quantity", "imported_at"]), "SELECT order_id, asin, quantity, imported_at FROM sales WHERE order_id = 7")
KEY = ["purchase_date", "order_id", "asin", "l_linenumber", "imported_at", "quantity", "revenue"]
on_sales("latest_rows", lambda s: prep.latest_rows(s.select(*KEY), "purchase_date", 10, tuple(KEY[1:])).drop("revenue"), f"SELECT {', '.join(KEY[:-1])} FROM sales ORDER BY purchase_date DESC, {', '.join(KEY[1:])} LIMIT 10")
on_sales("select_preview", lambda s: prep.preview(s, ["order_id", "asin", "quantity"], ["order_id", "asin", "quantity"], 15, last=True), "SELECT order_id, asin, quantity FROM sales ORDER BY order_id DESC, asin DESC, quantity DESC LIMIT 15")

DEDUPE = ["imported_at", "asin", "quantity", "revenue", "l_suppkey"]
on_sales(
    "dedupe_latest",
    lambda s: prep.dedupe_latest(s, ["order_id", "l_linenumber"], DEDUPE[0], DEDUPE[1:]).select("order_id", "l_linenumber", "asin", "quantity", "imported_at"),
    f"SELECT order_id, l_linenumber, asin, quantity, imported_at FROM sales QUALIFY row_number() OVER (PARTITION BY order_id, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in DEDUPE)}) = 1",
)
on_sales("duplicate_orders", lambda s: prep.duplicates(s, ["order_id", "l_linenumber"]), "SELECT order_id, l_linenumber, count(*) AS n FROM sales GROUP BY 1, 2 HAVING count(*) > 1")
TALLY = "CAST(sum(n) AS BIGINT) AS {0}_rows, count(*) AS {0}_keys, count(*) FILTER (n > 1) AS {0}_repeated FROM (SELECT count(*) AS n FROM {1} GROUP BY order_id, l_linenumber)"
on_sales(
    "dedupe_check",
    lambda s: prep.dedupe_check(s, ["order_id", "l_linenumber"], DEDUPE[0], DEDUPE[1:]),
    f"+kept AS (SELECT * FROM sales QUALIFY row_number() OVER (PARTITION BY order_id, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in DEDUPE)}) = 1) SELECT * FROM (SELECT {TALLY.format('all', 'sales')}), (SELECT {TALLY.format('kept', 'kept')})",
)


@query(f"WITH {SALES} SELECT type, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM sales WHERE asin IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size <= 40) GROUP BY 1")
def semi_catalogue(spark: SparkSession, d: str) -> DataFrame:
    catalogue = _read(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").cast("string").alias("asin"))
    return prep.of_catalogue(sales_table(spark, d), catalogue).groupBy("type").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))

# Periods


@query(
    """WITH q AS (SELECT CAST(max(o_orderdate) AS DATE) AS ref FROM orders GROUP BY date_trunc('month', o_orderdate))
    SELECT ref, 'MTD' AS period, CAST(date_trunc('month', ref) AS DATE) AS start_date, CAST(date_trunc('month', ref) AS DATE) - INTERVAL 1 MONTH AS prior_start,
      CAST(date_trunc('month', ref) - INTERVAL 1 MONTH AS DATE) + CAST(least(day(ref), day(CAST(date_trunc('month', ref) AS DATE) - 1)) AS INT) - 1 AS prior_end FROM q
    UNION ALL SELECT ref, 'YTD', CAST(date_trunc('year', ref) AS DATE), date_trunc('year', ref) - INTERVAL 1 YEAR, CAST(date_trunc('year', ref) - INTERVAL 1 YEAR AS DATE) + CAST(ref - CAST(date_trunc('year', ref) AS DATE) AS INT) FROM q
    UNION ALL SELECT ref, 'LAST_7_DAYS', ref - 6, CAST(ref - 13 AS TIMESTAMP), ref - 7 FROM q UNION ALL SELECT ref, 'LAST_30_DAYS', ref - 29, CAST(ref - 59 AS TIMESTAMP), ref - 30 FROM q"""
)
def period_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The bounds of all periods on the latest day of each month's orders."""
    days = _read(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate")).agg(F.max("o_orderdate").cast("date").alias("ref"))

    def bounds(period: str) -> Column:
        x = P.four_days(period, F.col("ref"))
        return F.struct(F.lit(period).alias("period"), x["current_start"].alias("start_date"), x["prior_start"].cast("timestamp_ntz").alias("prior_start"), x["prior_end"].alias("prior_end"))

    return days.select("ref", F.inline(F.array(*map(bounds, P.PERIODS))))


@query(f"WITH {SALES} SELECT ref - 29 AS start_date, ref AS end_date, ref - 59 AS prior_start, ref - 30 AS prior_end FROM r")
def latest_period_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The bounds on the latest day of all sales, as the operators give them."""
    sold = sales_table(spark, d)
    prior = P.prior_bounds(sold, "LAST_30_DAYS").withColumnsRenamed({"start_date": "prior_start", "end_date": "prior_end"})
    return P.period_bounds(sold, "LAST_30_DAYS").join(F.broadcast(prior))  # two tables of one row


on_sales("filter_period", lambda s: P.in_period(s, "LAST_30_DAYS").agg(F.count("*").alias("n"), F.min("start_date").alias("a"), F.max("end_date").alias("b")), "SELECT count(*) AS n, min(ref) - 29 AS a, min(ref) AS b FROM sales, r WHERE date BETWEEN ref - 29 AND ref")
on_sales("filter_bounds", lambda s: P.between_days(s, "2001-03-01", "2001-03-31").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM sales WHERE date BETWEEN '2001-03-01' AND '2001-03-31'")
on_sales("period_slices", lambda s: P.labelled_days(s, 30).groupBy("slice").agg(F.count("*").alias("n")), "SELECT CASE WHEN date > ref - 30 THEN 'current' ELSE 'prior' END AS slice, count(*) AS n FROM sales, r WHERE date > ref - 60 GROUP BY 1")
on_sales(
    "filter_period_ts",
    lambda s: P.since_timestamp(s, "LAST_7_DAYS", "purchase_date").agg(F.count("*").alias("n7")).join(P.since_timestamp(s, "YTD", "purchase_date").agg(F.count("*").alias("nytd"))),
    "SELECT (SELECT count(*) FROM sales, r WHERE purchase_date >= last - INTERVAL 7 DAYS) AS n7, (SELECT count(*) FROM sales, r WHERE purchase_date >= date_trunc('year', last)) AS nytd",
)
on_sales("rolling_days", lambda s: P.last_days(s, 30).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM sales, r WHERE date >= ref - 29")
on_sales("lookback_weeks", lambda s: trends.lookback(s, P.day_of(s)).agg(F.count("*").alias("n"), F.min("date").alias("a")), "SELECT count(*) AS n, min(date) AS a FROM sales, r WHERE date >= ref - 83")

# Sales

BOTH = lambda n: f"{SUMS(NOW.format(n=n), 'current_')}, {SUMS(PRIOR.format(n=n), 'prior_')}"
P30 = f"(SELECT {BOTH(30)} FROM sales, r)"
LONG = ["revenue", "pairs_sold", "units_sold_amazon", "orders", "aov", "avg_unit_price", "avg_price_per_pair"]
ROWS = " UNION ALL ".join(f"SELECT '{n}' AS metric, CAST(current_{n} AS DOUBLE) AS current, CAST(prior_{n} AS DOUBLE) AS prior FROM k" for n in LONG)
CMP = f"+k AS (SELECT *, {KPIS('current_')}, {KPIS('prior_')} FROM {P30}), l AS ({ROWS})"
on_sales("sales_summary_period", lambda s: sales.sales_summary(s, "YTD"), f"SELECT *, {KPIS()} FROM (SELECT {SUMS()} FROM sales, r WHERE {YTD})")
on_sales("sales_summary_mtd", lambda s: sales.sales_summary(s, "MTD", "2001-07-31"), f"SELECT *, {KPIS()} FROM (SELECT {SUMS()} FROM sales WHERE date BETWEEN '2001-07-01' AND '2001-07-31')")
on_sales("sales_summary_days", lambda s: sales.sales_summary_days(s, 30), f"SELECT *, {CHANGES(('revenue', 'orders', 'pairs_sold', 'units_sold_amazon', 'aov'))} FROM (SELECT *, {KPIS('current_')}, {KPIS('prior_')} FROM {P30})")
on_sales("pct_change_safe", lambda s: sales.sales_summary_days(s, 7).select("revenue_change_pct"), f"SELECT {CHANGE('current_revenue', 'prior_revenue')} AS revenue_change_pct FROM (SELECT {BOTH(7)} FROM sales, r)")
on_sales(
    "sales_breakdown",
    lambda s: sales.sales_breakdown(s, "YTD", "type"),
    f"SELECT *, {div0('revenue', 'sum(revenue) OVER ()')} AS revenue_pct FROM (SELECT type, {SUMS()}, min(CAST(date_trunc('year', ref) AS DATE)) AS start_date, min(ref) AS end_date FROM sales, r WHERE {YTD} AND type IS NOT NULL GROUP BY 1)",
)
on_sales(
    "sales_breakdown_asin",
    lambda s: sales.sales_breakdown(s, "LAST_30_DAYS", "asin", "orders", 12),
    f"SELECT *, {div0('orders', 'sum(orders) OVER ()')} AS orders_pct FROM (SELECT asin, {SUMS()}, min(ref - 29) AS start_date, min(ref) AS end_date FROM sales, r WHERE date BETWEEN ref - 29 AND ref GROUP BY 1) ORDER BY orders DESC, asin LIMIT 12",
)
on_sales("compare_periods", lambda s: sales.compare_periods(s, "LAST_30_DAYS"), f"{CMP} SELECT *, current - prior AS change_abs, {CHANGE('current', 'prior')} AS change_pct FROM l")
on_sales("comparison_view", lambda s: sales.comparison_view(s, "LAST_30_DAYS"), f"{CMP} SELECT *, {CHANGE('current', 'prior')} AS change_pct FROM l WHERE metric IN ('revenue', 'orders', 'pairs_sold', 'aov')")
on_sales("kpi_comparison", lambda s: sales.kpi_comparison(s, "LAST_30_DAYS"), f"{CMP} SELECT {CHANGES(('revenue', 'orders', 'pairs_sold', 'aov'))}, ref - 29 AS current_start, ref AS current_end, ref - 59 AS prior_start, ref - 30 AS prior_end FROM k, r")


def DRIVERS(keys: str, metric: str, more: str = "") -> str:
    notnull = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    inner = f"SELECT {keys}, current_{metric} AS current, prior_{metric} AS prior, current_{metric} - prior_{metric} AS change_abs FROM (SELECT {keys}, {BOTH(30)} FROM sales, r WHERE date > ref - 60 AND {notnull} GROUP BY {keys})"
    return f"SELECT *, coalesce({div('change_abs', 'sum(change_abs) OVER ()')}, 0) * 100 AS contribution_pct{more} FROM ({inner})"


on_sales("compare_drivers", lambda s: sales.compare_drivers(s, "LAST_30_DAYS", "color", "pairs_sold"), DRIVERS("color", "pairs_sold"))
on_sales(
    "explain_change",
    lambda s: sales.explain_change(s, "LAST_30_DAYS", "asin", "pairs_sold", 15),
    f"SELECT d.*, ref - 29 AS current_start, ref AS current_end, ref - 59 AS prior_start, ref - 30 AS prior_end FROM ({DRIVERS('asin, item_name', 'pairs_sold', ', ' + CHANGE('current', 'prior') + ' AS change_pct')}) d, r ORDER BY change_abs DESC, asin, item_name LIMIT 15",
)
TOP = "asin, item_name, type, color, size"
on_sales(
    "top_products",
    lambda s: sales.top_products(s, 365),
    f"SELECT *, {div('revenue', 'orders')} AS aov, {div('revenue', 'pairs_sold')} AS avg_price_per_pair FROM (SELECT {TOP}, {SUMS()} FROM sales, r WHERE date >= ref - 364 AND color IS NOT NULL AND size IS NOT NULL GROUP BY ALL) ORDER BY revenue DESC, {TOP} LIMIT 10",
)
for key, name in (("type", "product_mix"), ("color", "color_performance")):
    on_sales(
        name,
        lambda s, key=key: sales.mix(s, 30, key),
        f"SELECT * EXCLUDE units_sold_amazon, {div('revenue', 'sum(revenue) OVER ()')} AS revenue_pct, {div('pairs_sold', 'sum(pairs_sold) OVER ()')} AS pairs_pct FROM (SELECT {key}, {SUMS()} FROM sales, r WHERE date >= ref - 29 AND {key} IS NOT NULL GROUP BY 1)",
    )
SINCE30 = "purchase_date >= last - INTERVAL 30 DAYS"


def SALES_BY(keys: str) -> str:
    notnull = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    return f"SELECT * EXCLUDE units_sold_amazon, {div0('revenue', 'orders')} AS aov, {div0('revenue', 'sum(revenue) OVER ()')} * 100 AS revenue_share FROM (SELECT {keys}, {SUMS()} FROM sales, r WHERE {SINCE30} AND {notnull} GROUP BY {keys})"


for key in ("type", "size", "color", "ship_state"):
    on_sales(f"sales_by_{key}", lambda s, key=key: sales.sales_by(s, "LAST_30_DAYS", [key]), SALES_BY(key))
on_sales("sales_by_product", lambda s: sales.sales_by(s, "LAST_30_DAYS", ["product_name", "asin"], 20), f"SELECT * FROM ({SALES_BY('product_name, asin')}) ORDER BY revenue DESC, product_name, asin LIMIT 20")
on_sales(
    "velocity",
    lambda s: sales.velocity(s, "YTD"),
    f"+w AS (SELECT sales.* FROM sales, r WHERE purchase_date >= date_trunc('year', last)), n AS (SELECT greatest(floor((epoch(max(purchase_date)) - epoch(min(purchase_date))) / 86400) + 1, 1) AS days FROM w) SELECT product_name, revenue, pairs_sold, {div('pairs_sold', 'days')} AS pairs_per_day, {div('revenue', 'days')} AS revenue_per_day FROM (SELECT product_name, {SUMS()} FROM w GROUP BY 1), n ORDER BY revenue DESC, product_name LIMIT 20",
)
DAYS = f"SELECT dayname(purchase_date) AS day, CAST(isodow(purchase_date) - 1 AS INT) AS weekday, CAST(sum(revenue) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders FROM sales, r WHERE {SINCE30} GROUP BY 1, 2"
on_sales("weekday_sales", lambda s: sales.weekday_sales(s, "LAST_30_DAYS"), DAYS)
on_sales("best_worst_weekday", lambda s: sales.best_worst_weekday(s, "LAST_30_DAYS"), f"SELECT (SELECT day FROM ({DAYS}) ORDER BY revenue DESC, weekday LIMIT 1) AS best_day, (SELECT day FROM ({DAYS}) ORDER BY revenue, weekday LIMIT 1) AS worst_day")
on_sales("avg_daily_sales", lambda s: sales.avg_daily_sales(s, "LAST_30_DAYS"), f"SELECT CAST(sum(revenue) AS DOUBLE) / 30 AS avg_daily_sales FROM sales, r WHERE {SINCE30}")
on_sales("topn_share_within", lambda s: sales.topn_share_within(sales.totals_by(s, "item_name").select("item_name", "pairs_sold"), "pairs_sold", ["item_name"], 5), f"SELECT *, {div('pairs_sold', 'sum(pairs_sold) OVER ()')} AS share FROM (SELECT item_name, CAST(sum(pairs_sold) AS BIGINT) AS pairs_sold FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)")
on_sales("sales_by_type_total", lambda s: sales.totals_by(s, "type"), f"SELECT type, {SUMS()} FROM sales GROUP BY 1")
on_sales("sku_share", lambda s: sales.totals_by(s, "item_name", SPLIT).select("item_name", "revenue", "orders"), f"SELECT item_name, CAST(sum(revenue) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders FROM sales WHERE date >= '{SPLIT}' GROUP BY 1")
on_sales("monthly_sales", sales.monthly_sales, f"SELECT * EXCLUDE units_sold_amazon FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month, {SUMS()} FROM sales GROUP BY 1)")

# Ads

ZERO = ("ctr", "cvr", "cpc")
PB = f"(SELECT {ADS(NOW.format(n=7), 'current_')}, {ADS(PRIOR.format(n=7), 'prior_')} FROM ppc, pr)"
on_ppc("ppc_summary", lambda p: ads.ppc_summary(p, 7), f"SELECT *, {CHANGES(('spend', 'sales', 'acos', 'roas'))} FROM (SELECT *, {RATIOS(FIVE, 'current_', ZERO)}, {RATIOS(FIVE, 'prior_', ZERO)} FROM {PB})")
DAILY = f"+daily AS (SELECT s.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ads.COUNTS)} FROM (SELECT date, CAST(sum(revenue) AS DOUBLE) AS total_sales, count(DISTINCT order_id) AS total_orders FROM sales GROUP BY 1) s LEFT JOIN (SELECT date, {ADS()} FROM ppc GROUP BY 1) USING (date)), dr AS (SELECT max(date) AS ref FROM daily)"
MC = ("total_sales", "total_orders", *ads.COUNTS)
MR = lambda p: f"{div(p + 'spend', p + 'total_sales')} AS {p}tacos, {div(p + 'sales', p + 'total_sales')} AS {p}ad_sales_share, {RATIOS(('acos', 'roas', 'ctr'), p)}"
on_both("join_daily_left", lambda s, p: _rounded(ads.daily_sales_and_ads(s, p), "total_sales"), f"{DAILY} SELECT * REPLACE (round(total_sales, 6) AS total_sales) FROM daily")
on_both(
    "marketing_summary",
    lambda s, p: _rounded(ads.marketing_summary(s, p, 7), *(f"{x}_{c}" for x in ("current", "prior") for c in ("total_sales", "spend", "sales")), *(c for c in _marketing_ratios())),
    f"{DAILY} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in [f'{x}_{c}' for x in ('current', 'prior') for c in ('total_sales', 'spend', 'sales')])}, {', '.join(f'round({c}, 6) AS {c}' for c in [f'{x}_{c}' for x in ('current', 'prior') for c in ('tacos', 'ad_sales_share', 'acos', 'roas', 'ctr')] + [f'{c}_change_pct' for c in ('total_sales', 'spend', 'sales', 'tacos')])}) FROM (SELECT *, {CHANGES(('total_sales', 'spend', 'sales', 'tacos'))} FROM (SELECT *, {MR('current_')}, {MR('prior_')} FROM (SELECT {ADS(NOW.format(n=7), 'current_', MC)}, {ADS(PRIOR.format(n=7), 'prior_', MC)} FROM daily, dr)))",
)


def _marketing_ratios() -> list[str]:
    return [f"{x}_{c}" for x in ("current", "prior") for c in ("tacos", "ad_sales_share", "acos", "roas", "ctr")] + [f"{c}_change_pct" for c in ("total_sales", "spend", "sales", "tacos")]


FOUR = ("acos", "roas", "ctr", "cvr")
on_both("ppc_kpis", lambda s, p: ads.ppc_kpis(p, s, "LAST_7_DAYS"), f"SELECT *, {RATIOS(FOUR, '', FOUR)}, {div0('spend', 'revenue')} AS tacos FROM (SELECT {ADS()} FROM ppc, pr WHERE date >= ref - 7), (SELECT CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales, r WHERE purchase_date >= last - INTERVAL 7 DAYS)")
on_ppc("top_keywords", lambda p: ads.top_keywords(p, 30, 5), f"SELECT *, {RATIOS(FIVE)} FROM (SELECT keyword, match_type, {ADS()} FROM ppc, pr WHERE date >= ref - 29 GROUP BY 1, 2) WHERE clicks >= 5 ORDER BY sales DESC, keyword, match_type LIMIT 20")
KT = f"(SELECT *, {RATIOS(FIVE)} FROM (SELECT search_term, match_type, {ADS()} FROM ppc, pr WHERE date >= ref - 29 GROUP BY 1, 2))"
BIDS = [("clicks < 2 AND spend < 15", "Hold", "Not enough data yet", "cpc"), ("clicks >= 4 AND sales = 0", "Pause", "Enough clicks with no sales", "0.0"), ("sales = 0 AND spend >= 15", "Reduce bid", "Spend present but no sales yet", "cpc * 0.7"), ("acos > 0.25", "Reduce bid", "ACOS above target", "cpc * coalesce(0.25::DOUBLE / nullif(acos, 0), 1)"), ("acos <= 0.25 AND cvr >= 0.12", "Increase bid", "Profitable keyword with strong conversion", "cpc * coalesce(0.25::DOUBLE / nullif(acos, 0), 1)")]
CASES = ", ".join(f"CASE {' '.join(f'WHEN {b[0]} THEN {v(b)}' for b in BIDS)} ELSE {e} END AS {n}" for n, v, e in (("action", lambda b: f"'{b[1]}'", "'Hold'"), ("reason", lambda b: f"'{b[2]}'", "'Borderline or stable performance'"), ("suggested_cpc", lambda b: f"CAST({b[3]} AS DOUBLE)", "cpc")))
on_ppc("bid_recommendations", lambda p: ads.bid_recommendations(p, min_clicks=2, pause_clicks=4, top_n=100000, keys=("search_term", "match_type")), f"SELECT *, {CASES}, 30 AS period_days, 0.25::DOUBLE AS target_acos FROM {KT}")
on_ppc("keyword_actions", lambda p: ads.keyword_actions(ads.keyword_totals(p, 30, ["search_term", "match_type"])).select("search_term", "match_type", "recommended_action"), f"SELECT search_term, match_type, CASE WHEN spend >= 15 AND sales = 0 AND clicks >= 10 THEN 'Pause / Reduce' WHEN coalesce(acos, 0) >= 0.45 AND spend >= 15 THEN 'Lower Bid' WHEN coalesce(acos, 0) <= 0.25 AND sales > 0 AND coalesce(cvr, 0) >= 0.12 THEN 'Scale' WHEN sales > 0 THEN 'Monitor' ELSE 'Low Data' END AS recommended_action FROM {KT}")
RISK = f"+{STOCK}, d AS (SELECT asin, CAST(sum(units_sold_amazon) AS DOUBLE) AS u FROM sales, r WHERE date >= ref - 29 GROUP BY 1), v AS (SELECT asin, CAST(available AS DOUBLE) AS stock, coalesce(u, 0) / 30 AS daily_demand FROM stock LEFT JOIN d USING (asin)), x AS (SELECT *, {div('stock', 'daily_demand')} AS days_of_inventory FROM v), z AS (SELECT *, CASE WHEN days_of_inventory IS NULL THEN 'No recent demand' WHEN days_of_inventory <= 14 THEN 'Critical' WHEN days_of_inventory <= 30 THEN 'High' WHEN days_of_inventory <= 60 THEN 'Medium' ELSE 'Low' END AS risk_level, CASE WHEN days_of_inventory IS NULL THEN 4 WHEN days_of_inventory <= 14 THEN 0 WHEN days_of_inventory <= 30 THEN 1 WHEN days_of_inventory <= 60 THEN 2 ELSE 3 END AS severity FROM x)"
QUERIES["inventory_risk"] = lambda spark, d: ads.inventory_risk(prep.latest_snapshot(inventory_table(spark, d)), sales_table(spark, d))
ORACLES["inventory_risk"] = f"WITH {SALES}, {RISK[1:]} SELECT * FROM z"
QUERIES["critical_count"] = lambda spark, d: ads.critical_count(QUERIES["inventory_risk"](spark, d))
ORACLES["critical_count"] = f"WITH {SALES}, {RISK[1:]} SELECT count(*) FILTER (risk_level IN ('Critical', 'High')) AS critical_count FROM z"
for name, days in (("", None), ("_good", GOOD), ("_bad", BAD)):
    on_ppc(
        f"perf_by_match_type{name}",
        lambda p, days=days: rootcause.perf_by_match_type(p, days),
        f"SELECT match_type, {ADS(columns=('clicks', 'spend', 'sales', 'orders'))} FROM ppc {'WHERE date BETWEEN {!r} AND {!r}'.format(*days) if days else ''} GROUP BY 1",
    )

# Trends


def WEEKLY(name: str, table: str, week: str, what: str, extra: str = "") -> str:
    """CTEs for one row a week, empty weeks included."""
    return f"{name}_w AS (SELECT {week} AS week, {what} FROM {table} {extra} GROUP BY 1), {name} AS (SELECT g.week, * EXCLUDE week FROM (SELECT CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAYS)) AS DATE) AS week FROM {name}_w) g LEFT JOIN {name}_w USING (week))"


ZEROS = lambda p, names: ", ".join(f"coalesce({p}.{n}, 0) AS {n}" for n in names)
SUMMED = ("revenue", "pairs_sold", "units_sold_amazon", "orders")
BACK = "(SELECT {t}.* FROM {t}, r WHERE date >= ref - 83)"
TREND = f"""+{WEEKLY('ws', BACK.format(t='sales'), SAT, SUMS())}, {WEEKLY('wa', BACK.format(t='ppc'), SAT, 'CAST(sum(spend) AS DOUBLE) AS ad_spend, CAST(sum(sales) AS DOUBLE) AS ad_sales')},
  p3 AS (SELECT {SAT} AS week, {div("CAST(coalesce(sum(CASE WHEN lower(type) LIKE '%medium%' THEN revenue END), 0) AS DOUBLE)", 'CAST(sum(revenue) AS DOUBLE)')} AS three_pack_share FROM {BACK.format(t='sales')} GROUP BY 1),
  tw AS (SELECT week, {ZEROS('ws', SUMMED)}, {ZEROS('wa', ('ad_spend', 'ad_sales'))}, three_pack_share FROM ws LEFT JOIN wa USING (week) LEFT JOIN p3 USING (week)),
  trend AS (SELECT *, {div('revenue', 'orders')} AS aov, {div('ad_spend', 'ad_sales')} AS acos, {div('ad_sales', 'ad_spend')} AS roas, {div('ad_spend', 'revenue')} AS tacos FROM tw)"""
on_both("metric_trend_weekly", lambda s, p: trends.metric_trend_weekly(s, p, token="medium"), f"{TREND} SELECT * FROM trend")
on_sales("three_pack_share", lambda s: trends.three_pack_share(s, "MEDIUM"), f"SELECT {SAT} AS week, {div(chr(39).join(['CAST(coalesce(sum(CASE WHEN type = ', 'MEDIUM', ' THEN revenue END), 0) AS DOUBLE)']), 'CAST(sum(revenue) AS DOUBLE)')} AS three_pack_share FROM sales GROUP BY 1")
SUMMARY = f"""{TREND}, m AS (SELECT week, revenue AS m, row_number() OVER (ORDER BY week DESC) AS pos, count(*) OVER () AS n FROM trend WHERE revenue IS NOT NULL),
  o AS (SELECT count(*) AS weeks, avg(m) FILTER (pos <= 4) AS recent_avg, avg(m) FILTER (pos > 4 AND (n < 8 OR pos <= 8)) AS prior_avg, avg(m) AS mean, stddev_samp(m) AS std, arg_max(week, m) AS best_week, arg_min(week, m) AS worst_week FROM m),
  c AS (SELECT *, recent_avg / nullif(prior_avg, 0) * 100 - 100 AS change_pct, std / nullif(mean, 0) AS spread FROM o)
  SELECT 'revenue' AS metric, weeks, round(recent_avg, 6) AS recent_avg, round(prior_avg, 6) AS prior_avg, round(change_pct, 6) AS change_pct, CASE WHEN change_pct IS NULL THEN 'insufficient_data' WHEN change_pct > 5 THEN 'improving' WHEN change_pct < -5 THEN 'worsening' ELSE 'stable' END AS direction,
    CASE WHEN spread > 0.3 THEN 'high' WHEN spread > 0.15 THEN 'moderate' ELSE 'low' END AS volatility, best_week, worst_week FROM c"""
on_both("metric_trend_summary", lambda s, p: _rounded(trends.metric_trend_summary(trends.metric_trend_weekly(s, p), "revenue"), "recent_avg", "prior_avg", "change_pct"), SUMMARY)
LASTS = "(SELECT {t}.* FROM {t}, (SELECT greatest((SELECT ref FROM r), (SELECT ref FROM pr)) AS ref) WHERE date >= ref - 84)"
on_both(
    "revenue_tacos_trend",
    trends.revenue_tacos_trend,
    f"+a AS (SELECT {WEEK} AS week, CAST(sum(revenue) AS DOUBLE) AS revenue FROM {LASTS.format(t='sales')} GROUP BY 1), b AS (SELECT {WEEK} AS week, CAST(sum(spend) AS DOUBLE) AS spend FROM {LASTS.format(t='ppc')} GROUP BY 1), c AS (SELECT week, revenue, coalesce(spend, 0) AS spend FROM a LEFT JOIN b USING (week)) SELECT *, {div0('spend', 'revenue')} AS tacos, {div0('spend', 'revenue')} * 100 AS tacos_pct, strftime(week, '%b %d') AS label FROM c",
)
WS = f"{WEEKLY('w0', 'sales', MON, SUMS())}, wsales AS (SELECT week, {ZEROS('w0', SUMMED)} FROM w0)"
WP = f"{WEEKLY('a0', 'ppc', MON, ADS())}, wppc AS (SELECT week, {ZEROS('a0', ads.COUNTS)} FROM a0)"
on_sales("weekly_sales", trends.weekly_sales, f"+{WS} SELECT * FROM wsales")
on_sales("rolling_4wk", lambda s: _rounded(trends.rolling_weeks(trends.weekly_sales(s)).select("week", "rolling_4wk"), "rolling_4wk"), f"+{WS} SELECT week, round(CASE WHEN count(*) OVER w = 4 THEN avg(revenue) OVER w END, 6) AS rolling_4wk FROM wsales WINDOW w AS (ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
on_ppc("weekly_ppc", trends.weekly_ppc, f"+{WP} SELECT *, {RATIOS(('cpc', 'cvr', 'acos', 'roas'))} FROM wppc")
COMBINED = f"+{WS}, {WP}, comb AS (SELECT s.*, p.spend, p.sales AS ad_sales, p.orders AS ad_orders, p.clicks FROM wsales s LEFT JOIN wppc p USING (week)), combined AS (SELECT *, revenue - ad_sales AS organic_sales, {div('ad_sales', 'revenue')} AS ppc_share, {div('spend', 'revenue')} AS tacos FROM comb)"
on_both("weekly_combined", trends.weekly_combined, f"{COMBINED} SELECT * FROM combined")
QUERIES["weekly_health"] = lambda spark, d: _rounded(trends.weekly_health(sales_table(spark, d), ppc_table(spark, d), report_table(spark, d)).select("week", "revenue", "tacos", "sessions", "conversion_rate", "conversion_status"), "conversion_rate")
ORACLES["weekly_health"] = f"WITH {SALES}, {PPC}, {COMBINED[1:]}, {REPORT} SELECT week, revenue, tacos, sessions, round(conversion_rate, 6) AS conversion_rate, CASE WHEN conversion_rate IS NULL THEN 'NO DATA' WHEN conversion_rate >= 5.5 THEN 'GREEN' WHEN conversion_rate >= 4.5 THEN 'YELLOW' ELSE 'RED' END AS conversion_status FROM combined LEFT JOIN report USING (week)"
QUERIES["wow_change"] = lambda spark, d: _rounded(trends.wow_change(report_table(spark, d)).select("week", "sessions_wow", "conversion_rate_wow"), "sessions_wow", "conversion_rate_wow")
ORACLES["wow_change"] = f"WITH {PPC}, {REPORT} SELECT week, round(sessions / nullif(lag(sessions) OVER w, 0) - 1, 6) AS sessions_wow, round(conversion_rate / nullif(lag(conversion_rate) OVER w, 0) - 1, 6) AS conversion_rate_wow FROM report WINDOW w AS (ORDER BY week)"
on_sales("weekly_by_key", lambda s: trends.by_week(s, trends.week_ending_monday(F.col("date")), sales.sums(), ["type"]), f"SELECT {MON} AS week, type, {SUMS()} FROM sales GROUP BY 1, 2")
TERMS = ["term3", "term7", "term42"]
on_ppc("money_terms_weekly", lambda p: trends.by_week(p.where(F.col("search_term").isin(TERMS)), trends.week_ending_monday(F.col("date")), ads.ad_sums(), gaps=True), f"+{WEEKLY('t0', 'ppc', MON, ADS(), f'WHERE search_term IN {tuple(TERMS)}')} SELECT week, {ZEROS('t0', ads.COUNTS)} FROM t0")
on_sales("hero_sku_weekly", lambda s: trends.by_week(s.where("item_name = 'red widget' or asin = '1'"), trends.week_ending_monday(F.col("date")), sales.sums(), gaps=True), f"+{WEEKLY('h0', 'sales', MON, SUMS(), 'WHERE item_name = ' + repr('red widget') + ' OR asin = ' + repr('1'))} SELECT week, {ZEROS('h0', SUMMED)} FROM h0")
TYPES = ["ECONOMY", "SMALL", "MEDIUM", "LARGE", "PROMO", "STANDARD"]
PIVOT = ", ".join(f"{{}}CAST(sum(CASE WHEN type = '{t}' THEN revenue END) AS DOUBLE){{}} AS {t}" for t in TYPES)
on_sales("pivot_type", lambda s: trends.pivot_weeks(s, "type", TYPES, fill=False), f"SELECT {MON} AS week, {PIVOT.replace('{}', '')} FROM sales GROUP BY 1")
ITEMS = [f"{a} {b}" for a in ("blue", "cold", "hot", "large", "new", "old", "red", "small") for b in ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")]
on_sales("pivot_sku", lambda s: trends.pivot_weeks(s, "item_name", ITEMS, other="other"), f"SELECT {MON} AS week, {', '.join(f'coalesce(CAST(sum(revenue) FILTER (item_name = {chr(39)}{t}{chr(39)}) AS DOUBLE), 0) AS {chr(34)}{t}{chr(34)}' for t in ITEMS)}, coalesce(CAST(sum(revenue) FILTER (item_name NOT IN {tuple(ITEMS)}) AS DOUBLE), 0) AS other FROM sales GROUP BY 1")
on_sales(
    "weekly_sku_pivot",
    trends.weekly_sku_pivot,
    f"+e AS (SELECT product_name AS product, CAST(date_trunc('week', purchase_date) AS DATE) AS week, CAST(sum(units_sold_amazon) AS BIGINT) AS units, sum(revenue) AS rev FROM sales, r WHERE purchase_date >= last - INTERVAL 21 DAYS GROUP BY 1, 2), b AS (SELECT * FROM e UNION ALL SELECT 'TOTAL', week, CAST(sum(units) AS BIGINT), sum(rev) FROM e GROUP BY 2) SELECT product, week, units, units / 7.0::DOUBLE AS velocity, round({div('rev', 'units')}, 6) AS avg_price FROM b",
)
_pivot = QUERIES["weekly_sku_pivot"]
QUERIES["weekly_sku_pivot"] = lambda spark, d: _rounded(_pivot(spark, d), "avg_price")

# Root causes

IN = "date BETWEEN '{0}' AND '{1}'"
GB = f"SELECT {{k}}, {ADS(IN.format(*GOOD), 'good_')}, {ADS(IN.format(*BAD), 'bad_')} FROM ppc WHERE ({IN.format(*GOOD)} OR {IN.format(*BAD)}){{w}} GROUP BY 1"
on_ppc("term_stats", lambda p: rootcause.term_stats(p, GOOD), f"SELECT *, {RATIOS(('cvr', 'acos'))} FROM (SELECT search_term, {ADS()} FROM ppc WHERE {IN.format(*GOOD)} GROUP BY 1)")
on_ppc("term_comparison", lambda p: rootcause.term_comparison(p, GOOD, BAD), f"SELECT search_term, good_sales, bad_sales, good_orders, bad_orders, bad_sales - good_sales AS sales_delta, bad_orders - good_orders AS orders_delta FROM ({GB.format(k='search_term', w='')}) ORDER BY sales_delta, search_term LIMIT 25")
NAMES4 = ("cpc", "cvr", "roas", "acos")
KC = f"SELECT *, bad_sales - good_sales AS sales_delta, bad_orders - good_orders AS orders_delta, bad_cvr - good_cvr AS cvr_delta FROM (SELECT *, {RATIOS(NAMES4, 'good_')}, {RATIOS(NAMES4, 'bad_')} FROM ({GB.format(k='keyword', w=' AND keyword IN (SELECT keyword FROM ppc GROUP BY 1 ORDER BY sum(spend) DESC, 1 LIMIT 20)')})) ORDER BY sales_delta, keyword LIMIT 20"
on_ppc("keyword_compare", lambda p: rootcause.keyword_compare(p, GOOD, BAD), KC)
on_ppc("keyword_compare_active", lambda p: rootcause.keyword_compare_active(rootcause.keyword_compare(p, GOOD, BAD)), f"SELECT * FROM ({KC}) WHERE good_spend > 10 AND bad_spend > 10")
BRAND = f"CASE WHEN lower(search_term) LIKE '%{TOKEN}%' THEN 'Branded' ELSE 'Non-Branded' END"
on_ppc("brand_split", lambda p: rootcause.brand_split(p, TOKEN), f"SELECT *, {RATIOS(('cvr', 'roas'))} FROM (SELECT {MON} AS week, {BRAND} AS brand_type, {ADS()} FROM ppc GROUP BY 1, 2)")
for name, keys in (("waste_terms", ("search_term",)), ("waste_terms_by_match_type", ("search_term", "match_type"))):
    on_ppc(
        name,
        lambda p, keys=keys: rootcause.waste_terms(p, TOKEN, keys=keys),
        f"SELECT *, {RATIOS(('cvr',))} FROM (SELECT {', '.join(keys)}, {ADS()} FROM ppc WHERE {BRAND} = 'Non-Branded' GROUP BY {', '.join(keys)}) WHERE spend > 5 AND orders = 0",
    )
on_sales("sku_mix", lambda s: rootcause.sku_mix(s, SPLIT).withColumn("share", F.round("share", 9)), f"SELECT period, item_name, revenue, round({div('revenue', 'sum(revenue) OVER (PARTITION BY period)')}, 9) AS share FROM (SELECT CASE WHEN date < '{SPLIT}' THEN 'before' ELSE 'after' END AS period, item_name, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY 1, 2)")
on_sales(
    "type_compare",
    lambda s: rootcause.type_compare(s, SPLIT).withColumns({c: F.round(c, 9) for c in ("share_before", "share_after")}),
    f"SELECT type, revenue_before, revenue_after, round({div('revenue_before', 'sum(revenue_before) OVER ()')}, 9) AS share_before, round({div('revenue_after', 'sum(revenue_after) OVER ()')}, 9) AS share_after FROM (SELECT type, CAST(sum(revenue) FILTER (date < '{SPLIT}') AS DOUBLE) AS revenue_before, CAST(sum(revenue) FILTER (date >= '{SPLIT}') AS DOUBLE) AS revenue_after FROM sales GROUP BY 1)",
)
BASE, RECENT = ["2001-07-09", "2001-07-16"], ["2001-07-23", "2001-07-30"]
QUERIES["conversion_baseline"] = lambda spark, d: _rounded(rootcause.conversion_baseline(report_table(spark, d), BASE, RECENT), "baseline", "recent", "change_pct")
_avg = lambda days: f"avg(conversion_rate) FILTER (week IN ({', '.join(f'DATE {x!r}' for x in days)}))"
ORACLES["conversion_baseline"] = f"WITH {PPC}, {REPORT} SELECT round(b, 6) AS baseline, round(c, 6) AS recent, round(c / nullif(b, 0) * 100 - 100, 6) AS change_pct FROM (SELECT {_avg(BASE)} AS b, {_avg(RECENT)} AS c FROM report)"
# Texts that take each branch of the rules.
PACK_TEXTS, SIZE_TEXTS = ["3 Pack", "3-pack", "White 3", "black 2", "6 pair", "6-Pack", "WHITE", "black", "none"], ["Small/Medium", "small, medium", "Large/X-Large", "large, x-large", "one size"]
TEXT = f"item_name || ' ' || ({PACK_TEXTS})[quantity % {len(PACK_TEXTS)} + 1] || ' ' || ({SIZE_TEXTS})[l_suppkey % {len(SIZE_TEXTS)} + 1]"
LIKE = lambda *parts: " OR ".join(f"contains(t, '{p}')" for p in parts)


def _labelled(s: DataFrame) -> DataFrame:
    one = lambda texts, n: F.get(F.array(*map(F.lit, texts)), (F.col(n) % len(texts)).cast("int"))
    text = F.concat_ws(" ", "item_name", one(PACK_TEXTS, "quantity"), one(SIZE_TEXTS, "l_suppkey"))
    return s.select(text.alias("text"), rootcause.sku_label(text).alias("label"), rootcause.clean_product_name(F.col("item_name"), ["red ", "blue "]).alias("name")).distinct()


on_sales(
    "sku_label",
    _labelled,
    f"""SELECT DISTINCT text, concat_ws(', ', CASE WHEN {LIKE('3 pack', '3-pack', 'white 3', 'black 2')} THEN '3-pack' WHEN {LIKE('6 pair', '6-pack')} THEN '6-pack' ELSE 'single' END,
      CASE WHEN {LIKE('white')} THEN 'white' WHEN {LIKE('black')} THEN 'black' WHEN {LIKE('blue')} THEN 'blue' ELSE 'unknown' END,
      CASE WHEN {LIKE('small/medium', 'small, medium')} THEN 'S/M' WHEN {LIKE('large/x-large', 'large, x-large')} THEN 'L/XL' ELSE '?' END) AS label,
      coalesce(nullif(trim(replace(replace(item_name, 'red ', ''), 'blue ', ''), ' -'), ''), 'Product') AS name FROM (SELECT *, {TEXT} AS text, lower({TEXT}) AS t FROM sales)""",
)

# Forecast

DM = "dm AS (SELECT *, revenue * 0.35::DOUBLE AS fees, pairs_sold * 2.59::DOUBLE AS cogs, revenue - revenue * 0.35::DOUBLE - pairs_sold * 2.59::DOUBLE AS net, CAST(date_trunc('month', date) AS DATE) AS month FROM (SELECT date, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(pairs_sold) AS BIGINT) AS pairs_sold, count(DISTINCT order_id) AS orders FROM sales GROUP BY 1))"
on_sales("daily_model", lambda s: _rounded(forecast.daily_model(s), "fees", "cogs", "net"), f"+{DM} SELECT * REPLACE (round(fees, 6) AS fees, round(cogs, 6) AS cogs, round(net, 6) AS net) FROM dm")
on_sales(
    "monthly_model",
    lambda s: forecast.monthly_model(forecast.daily_model(s)),
    f"+{DM} SELECT month, CAST(sum(pairs_sold) AS BIGINT) AS pairs_sold, CAST(sum(orders) AS BIGINT) AS orders, {', '.join(f'CAST(sum(CAST({c} AS DECIMAL(24,6))) AS DOUBLE) AS {c}' for c in ('revenue', 'fees', 'cogs', 'net'))} FROM dm GROUP BY 1",
)
FC = """+mm AS (SELECT l_suppkey, CAST(date_trunc('month', date) AS DATE) AS month, sum(revenue) AS revenue, CAST(sum(pairs_sold) AS BIGINT) AS pairs FROM sales GROUP BY 1, 2),
  b AS (SELECT l_suppkey, CAST(sum(revenue) FILTER (pos <= 3) AS DOUBLE) / count(*) FILTER (pos <= 3) AS mean, CAST(sum(pairs) AS DOUBLE) / nullif(CAST(sum(revenue) AS DOUBLE), 0) AS per, max(month) AS last FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY month DESC) AS pos FROM mm) GROUP BY 1),
  f AS (SELECT l_suppkey, scenario, CAST(last + INTERVAL (k) MONTH AS DATE) AS month, mean * scale AS revenue, mean * scale * per AS pairs_sold FROM b, (VALUES ('stress', 0.75::DOUBLE), ('conservative', 0.85::DOUBLE), ('base', 1.0::DOUBLE), ('upside', 1.10::DOUBLE)) s(scenario, scale), generate_series(1, 6) g(k)),
  fc AS (SELECT *, revenue * 0.35::DOUBLE AS fees, pairs_sold * 2.59::DOUBLE AS cogs, revenue - revenue * 0.35::DOUBLE - pairs_sold * 2.59::DOUBLE AS net FROM f),
  cf AS (SELECT *, net - 800 - 300 AS cash_flow, sum(net - 800 - 300) OVER (PARTITION BY l_suppkey, scenario ORDER BY month ROWS UNBOUNDED PRECEDING) + 5000 + 20000 - 9000 AS cash FROM fc)"""
SUPPLIER = ["l_suppkey"]
_flow = lambda s: forecast.cashflow(forecast.scenario_forecast(s, entity=SUPPLIER), 5000, 20000, 9000, 800, 300, SUPPLIER)
R2 = lambda *c: ", ".join(f"round({x}, 2) AS {x}" for x in c)
on_sales("scenario_forecast", lambda s: forecast.scenario_forecast(s, entity=SUPPLIER), f"{FC} SELECT * FROM fc")
on_sales("cashflow", lambda s: _flow(s).select("l_suppkey", "scenario", "month", F.round("cash_flow", 2).alias("cash_flow"), F.round("cash", 2).alias("cash")), f"{FC} SELECT l_suppkey, scenario, month, {R2('cash_flow', 'cash')} FROM cf")
on_sales("cash_decision_check", lambda s: forecast.cash_decision_check(_flow(s), SUPPLIER).withColumns({c: F.round(c, 2) for c in ("min_cash", "final_cash")}), f"{FC} SELECT l_suppkey, scenario, round(min(cash), 2) AS min_cash, round(arg_max(cash, month), 2) AS final_cash, count(*) FILTER (cash < 0) AS months_negative FROM cf GROUP BY 1, 2")

# The job


def _raw_exports(spark: SparkSession, d: str) -> str:
    """Raw exports of orders, catalogue and ads, written as tables; there are none of inventory."""
    path = facts.new_path(spark, "exports")
    sold = sales_table(spark, d)
    sold.select(
        F.col("order_id").cast("string").alias("amazon-order-id"), F.date_format("purchase_date", "yyyy-MM-dd'T'HH:mm:ss").alias("purchase-date"), "asin", F.col("item_name").alias("product-name"),
        F.col("sales_channel").alias("sales-channel"), F.col("quantity").cast("string").alias("quantity"), F.col("revenue").cast("string").alias("item-price"), F.col("ship_state").alias("ship-state"),
    ).write.parquet(f"{path}/orders.parquet")
    kind = F.coalesce(*(F.when(F.col("p_type") == a, b) for a, b in KINDS.items()), F.lit("other"))
    _read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("asin"), F.col("p_name").alias("item"), kind.alias("type")).write.parquet(f"{path}/asins.parquet")
    names = {"campaign": "Campaign Name", "keyword": "Targeting", "search_term": "Customer Search Term", "match_type": "Match Type", "sales": "7 Day Total Sales", "orders": "7 Day Total Orders (#)", "units": "7 Day Total Units (#)"}
    cells = [F.col(c).cast("string").alias(names.get(c, c)) for c in ("date", "campaign", "keyword", "match_type", "search_term", "impressions", "clicks", "spend", "sales", "orders", "units")]
    ppc_table(spark, d).select(*cells).write.parquet(f"{path}/ppc.parquet")
    return path


def _loaded(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return report.load_all(spark, _raw_exports(spark, d), "c1", "F")


@query(
    f"""WITH {SALES}, {PPC} SELECT 'sales' AS table_name, count(*) AS n, CAST(sum(pairs_sold) AS DOUBLE) AS total FROM sales WHERE sales_channel = 'F' AND quantity > 0
    UNION ALL SELECT 'ppc', count(*), CAST(sum(impressions) AS DOUBLE) FROM ppc WHERE campaign = 'c1' UNION ALL SELECT 'inventory', 0, 0"""
)
def load_all(spark: SparkSession, d: str) -> DataFrame:
    loaded = _loaded(spark, d)
    tally = lambda name, column: loaded[name].agg(F.count("*").alias("n"), F.coalesce(F.sum(column).cast("double"), F.lit(0.0)).alias("total")).select(F.lit(name).alias("table_name"), "n", "total")
    return tally("sales", "pairs_sold").union(tally("ppc", "impressions")).union(tally("inventory", "available"))


@query(
    f"""WITH {SALES}, f AS (SELECT * REPLACE (CASE type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())} ELSE 'other' END AS type) FROM sales WHERE sales_channel = 'F'), fr AS (SELECT max(date) AS ref FROM f)
    SELECT type, revenue, orders, round({div0('revenue', 'sum(revenue) OVER ()')}, 6) AS revenue_pct FROM (SELECT type, CAST(sum(revenue) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders FROM f, fr WHERE date BETWEEN ref - 29 AND ref GROUP BY 1)"""
)
def report_bundle(spark: SparkSession, d: str) -> DataFrame:
    """All reports of a period over loaded exports, which are stored for it, written; one of them read again."""
    path, store = facts.new_path(spark, "bundle"), facts.new_path(spark, "store")
    report.store_all(_loaded(spark, d), store, slices=facts.slices_for(_read(spark, d, "lineitem").count()))
    report.report_bundle(report.load_store(spark, store), "LAST_30_DAYS", path)
    return _rounded(spark.read.parquet(f"{path}/period=LAST_30_DAYS/sales_breakdown").select("type", "revenue", "orders", "revenue_pct"), "revenue", "revenue_pct")


# Last, as it refers to queries of this module
from . import report_queries  # noqa: E402, F401
