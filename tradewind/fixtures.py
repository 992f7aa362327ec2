"""The registered queries over the star-schema tables and their DuckDB SQL.

The tables stand in for a seller's data: line items with orders and parts for sales, events for ads (their days
moved so that the last ones agree), parts for stock, weekly ad sums for business reports. Sales and ads are prepared
once an application and folder, and stored by month; all reports read these facts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import periods as P
from .functions.columns import numeric_total
from .operators import ads, forecast, prep, rootcause, sales, trends
from .sources import facts

DAYS_BACK = 8217
TOKEN = "term7"
GOOD, BAD = ("2001-07-08", "2001-07-14"), ("2001-07-22", "2001-07-28")
SPLIT = "2001-05-01"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, d: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> str:
    """The path of facts that are made from a folder's tables and written when they are first asked for; those with orders in slices of these."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _stored:
        path, made = facts.new_path(spark, name), make(spark, d)
        slices = facts.slices_for(_read(spark, d, "lineitem").count()) if "order_id" in made.columns else 1
        facts.write_facts(made, path, key="order_id", slices=slices)
        _stored[key] = path
    return _stored[key]


def sales_table(spark: SparkSession, d: str) -> DataFrame:
    return facts.read_facts(spark, stored(spark, d, "sales", make_sales))


def make_sales(spark: SparkSession, d: str) -> DataFrame:
    items, orders, parts, customers, nations = (_read(spark, d, n) for n in ("lineitem", "orders", "part", "customer", "nation"))
    # Line items are shuffled for parts and for orders only, and an order's lines come together.
    orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    pack = F.when(F.col("p_type") == "MEDIUM", 3).when(F.col("p_type") == "LARGE", 6).otherwise(1)
    rows = rows.select(
        F.col("l_orderkey").alias("order_id"), F.col("o_orderdate").cast("timestamp").alias("purchase_date"), F.col("l_partkey").cast("string").alias("asin"),
        F.col("p_name").alias("item_name"), F.col("p_name").alias("product_name"), F.col("p_type").alias("type"),
        F.nullif(F.regexp_extract("p_name", "(red|blue)", 1), F.lit("")).alias("color"), F.when(F.col("p_size") % 3 == 0, "small").when(F.col("p_size") % 3 == 1, "large").alias("size"),
        F.col("l_quantity").cast("long").alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("item_price"), pack.alias("pack_size"),
        F.col("o_orderstatus").alias("sales_channel"), F.col("n_name").alias("ship_state"), F.col("l_shipdate").cast("timestamp").alias("imported_at"),
        "l_linenumber", "l_suppkey",
    )
    return prep.derive_sales(rows)


SALES = """
sales AS (
  SELECT l_orderkey AS order_id, CAST(o_orderdate AS TIMESTAMP) AS purchase_date, CAST(o_orderdate AS DATE) AS date, CAST(l_partkey AS VARCHAR) AS asin, p_name AS item_name, p_name AS product_name,
    p_type AS type, nullif(regexp_extract(p_name, '(red|blue)', 1), '') AS color, CASE p_size % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' END AS size,
    CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS revenue, CAST(l_quantity AS BIGINT) AS units_sold_amazon,
    CAST(l_quantity AS BIGINT) * CASE p_type WHEN 'MEDIUM' THEN 3 WHEN 'LARGE' THEN 6 ELSE 1 END AS pairs_sold, o_orderstatus AS sales_channel, n_name AS ship_state,
    CAST(l_shipdate AS TIMESTAMP) AS imported_at, l_linenumber, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT max(date) AS ref, max(purchase_date) AS last FROM sales)"""


def ppc_table(spark: SparkSession, d: str) -> DataFrame:
    return facts.read_facts(spark, stored(spark, d, "ppc", make_ppc))


def make_ppc(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    amount = F.col("value").cast("decimal(18,4)")
    count = lambda *kinds: F.when(kind.isin(*kinds), 1).otherwise(0)
    rows = _read(spark, d, "events").select(
        F.date_sub(F.col("ts").cast("date"), DAYS_BACK).alias("date"), F.concat(F.lit("c"), F.col("user_id") % 4).alias("campaign"), F.concat(F.lit("kw"), k % 20).alias("keyword"),
        F.concat(F.lit("m"), F.col("user_id") % 10).alias("match_type"), F.concat(F.lit("term"), k).alias("search_term"), count("view", "signup", "error").alias("impressions"),
        count("click").alias("clicks"), F.when(kind == "click", (F.col("value") * 0.25).cast("decimal(18,4)")).otherwise(0).alias("spend"),
        F.when(kind == "purchase", amount).otherwise(0).alias("sales"), count("purchase").alias("orders"), count("purchase").alias("units"),
    )
    return prep.row_ratios(rows)


PPC = f"""
ppc AS (
  SELECT CAST(ts AS DATE) - {DAYS_BACK} AS date, 'c' || (user_id % 4) AS campaign, 'kw' || (k % 20) AS keyword, 'm' || (user_id % 10) AS match_type, 'term' || k AS search_term,
    CASE WHEN event_type IN ('view', 'signup', 'error') THEN 1 ELSE 0 END AS impressions, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS clicks,
    CASE WHEN event_type = 'click' THEN CAST(value * 0.25 AS DECIMAL(18,4)) ELSE 0 END AS spend, CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,4)) ELSE 0 END AS sales,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS orders, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS units
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)),
pr AS (SELECT max(date) AS ref FROM ppc)"""


def report_table(spark: SparkSession, d: str) -> DataFrame:
    week = F.date_sub(F.next_day("date", "SUN"), 7).alias("day")
    weekly = ppc_table(spark, d).groupBy(week).agg(F.sum("impressions").cast("double").alias("sessions"), F.sum("orders").alias("o"), F.sum("sales").cast("double").alias("ordered_product_sales"))
    return weekly.select(F.date_add("day", 1).alias("week"), "ordered_product_sales", "sessions", (F.col("o") / F.col("sessions") * 100).alias("conversion_rate"))


REPORT = """
report AS (
  SELECT day + 1 AS week, CAST(sum(sales) AS DOUBLE) AS ordered_product_sales, CAST(sum(impressions) AS DOUBLE) AS sessions, sum(orders) / nullif(CAST(sum(impressions) AS DOUBLE), 0) * 100 AS conversion_rate
  FROM (SELECT *, date - CAST(dayofweek(date) AS INT) AS day FROM ppc) GROUP BY day)"""


def inventory_table(spark: SparkSession, d: str) -> DataFrame:
    days = F.explode(F.array(*(F.struct(F.lit(x).cast("date").alias("day"), F.lit(n).alias("more")) for x, n in (("2001-07-25", 5), ("2001-08-01", 0)))))
    rows = _read(spark, d, "part").withColumn("s", days)
    return rows.select(F.col("s.day").alias("snapshot_date"), F.col("p_partkey").cast("string").alias("asin"), (F.col("p_size") * 10 + F.col("s.more")).alias("available"))


STOCK = "stock AS (SELECT DATE '2001-08-01' AS snapshot_date, CAST(p_partkey AS VARCHAR) AS asin, p_size * 10 AS available FROM part)"

# SQL of what the operators have in common.
CAST = {"revenue": "DOUBLE", "pairs_sold": "BIGINT", "units_sold_amazon": "BIGINT"}


def SUMS(when: str = "TRUE", p: str = "") -> str:
    return ", ".join(f"CAST(coalesce(sum(CASE WHEN {when} THEN {c} END), 0) AS {t}) AS {p}{c}" for c, t in CAST.items()) + f", count(DISTINCT CASE WHEN {when} THEN order_id END) AS {p}orders"


def ADS(when: str = "TRUE", p: str = "", columns: tuple[str, ...] = ads.COUNTS) -> str:
    return ", ".join(f"CAST(coalesce(sum(CASE WHEN {when} THEN {c} END), 0) AS DOUBLE) AS {p}{c}" for c in columns)


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def div0(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0 END)"


PARTS = {"acos": ("spend", "sales"), "roas": ("sales", "spend"), "cvr": ("orders", "clicks"), "ctr": ("clicks", "impressions"), "cpc": ("spend", "clicks")}


def RATIOS(names: tuple[str, ...], p: str = "", zero: tuple[str, ...] = ()) -> str:
    return ", ".join(f"{(div0 if n in zero else div)(p + PARTS[n][0], p + PARTS[n][1])} AS {p}{n}" for n in names)


def KPIS(p: str = "") -> str:
    return ", ".join(f"{div0(p + 'revenue', p + c)} AS {p}{n}" for n, c in (("aov", "orders"), ("avg_unit_price", "units_sold_amazon"), ("avg_price_per_pair", "pairs_sold")))


def CHANGE(a: str, b: str) -> str:
    return f"(({a} - {b}) / nullif(CAST({b} AS DOUBLE), 0) * 100)"


CHANGES = lambda names: ", ".join(f"{CHANGE('current_' + n, 'prior_' + n)} AS {n}_change_pct" for n in names)
NOW, PRIOR = "date > ref - {n} AND date <= ref", "date > ref - 2 * {n} AND date <= ref - {n}"
YTD = "date BETWEEN CAST(date_trunc('year', ref) AS DATE) AND ref"
SAT, MON, WEEK = "date + CAST(6 - dayofweek(date) AS INT)", "date + CAST((8 - dayofweek(date)) % 7 AS INT)", "CAST(date_trunc('week', date) AS DATE)"
FIVE = ("acos", "roas", "cvr", "ctr", "cpc")


def query(sql: str | None = None, name: str | None = None):
    """Registers a query, and its SQL if there is one."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def on_sales(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, d: f(sales_table(spark, d))
    ORACLES[name] = f"WITH {SALES}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}"


def on_ppc(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, d: f(ppc_table(spark, d))
    ORACLES[name] = f"WITH {PPC}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}"


def on_both(name: str, f: Callable[[DataFrame, DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, d: f(sales_table(spark, d), ppc_table(spark, d))
    ORACLES[name] = f"WITH {SALES}, {PPC}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}"
