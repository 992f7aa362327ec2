"""The facts' store, the registry of reports, and the job that writes all reports of a period."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods as P
from ..operators import ads, prep, sales, trends
from ..sources import facts
from ..sources.tables import scan_table

Tables = dict[str, DataFrame]

# The parameters that a period's reports are made with.
MIN_CLICKS, TOP_KEYWORDS, BID_DAYS, TREND_WEEKS, PRODUCTS = 5, 50, 30, 12, 20


def _top_keywords(t: Tables, period: str, days: int) -> DataFrame:
    return ads.top_keywords(t["ppc"], days, MIN_CLICKS, TOP_KEYWORDS)


#: Reports by name; each takes (tables, period, days), tables being a dict of sales, ppc and inventory.
REPORTS: dict[str, Callable[[Tables, str, int], DataFrame]] = {
    "sales_summary": lambda t, period, days: sales.sales_summary(t["sales"], period),
    "sales_breakdown": lambda t, period, days: sales.sales_breakdown(t["sales"], period, "type"),
    "comparison": lambda t, period, days: sales.comparison_view(t["sales"], period),
    "kpi_comparison": lambda t, period, days: sales.kpi_comparison(t["sales"], period),
    "drivers": lambda t, period, days: sales.compare_drivers(t["sales"], period, "type"),
    "top_products": lambda t, period, days: sales.top_products(t["sales"], days),
    "product_mix": lambda t, period, days: sales.mix(t["sales"], days, "type"),
    "color_performance": lambda t, period, days: sales.mix(t["sales"], days, "color"),
    "sales_by_dimension": lambda t, period, days: sales.sales_by_dimensions(t["sales"], period),
    "sales_by_product": lambda t, period, days: sales.sales_by(t["sales"], period, ["product_name", "asin"], PRODUCTS),
    "weekly_sku_pivot": lambda t, period, days: trends.weekly_sku_pivot(t["sales"]),
    "velocity": lambda t, period, days: sales.velocity(t["sales"], period),
    "weekdays": lambda t, period, days: sales.weekday_sales(t["sales"], period),
    "ppc_summary": lambda t, period, days: ads.ppc_summary(t["ppc"], days),
    "ppc_kpis": lambda t, period, days: ads.ppc_kpis(t["ppc"], t["sales"], period),
    "marketing_summary": lambda t, period, days: ads.marketing_summary(t["sales"], t["ppc"], days),
    "top_keywords": _top_keywords,
    "keyword_actions": lambda t, period, days: ads.keyword_actions(_top_keywords(t, period, days)),
    "bid_recommendations": lambda t, period, days: ads.bid_recommendations(t["ppc"], BID_DAYS),
    "revenue_tacos_trend": lambda t, period, days: trends.revenue_tacos_trend(t["sales"], t["ppc"], TREND_WEEKS),
    "inventory_risk": lambda t, period, days: ads.inventory_risk(t["inventory"], t["sales"]),
}


def rolling_days(period: str) -> int:
    return 7 if period == "LAST_7_DAYS" else 30


def load_all(spark: SparkSession, folder: str, campaign: str | None = None, channel: str = "Amazon.com") -> Tables:
    """The prepared tables of a folder of raw exports (orders, asins, ppc, inventory_snapshots), lazily.

    Inventory that cannot be read is empty; the other three have to be there. For reports, store them: see store_all().
    """
    raw = {n: scan_table(spark, n, folder) for n in ("orders", "asins", "ppc")}
    try:
        stock = prep.latest_snapshot(scan_table(spark, "inventory_snapshots", folder))
    except PySparkException:
        stock = spark.createDataFrame([], "snapshot_date date, asin string, available double")
    return {"sales": prep.prep_sales(raw["orders"], raw["asins"], channel), "ppc": prep.prep_ppc(raw["ppc"], campaign), "inventory": stock}


def store_all(tables: Tables, store: str, since: str | None = None, slices: int = 1) -> None:
    """Writes prepared tables as a store: sales and ads by month, inventory as it is.

    since: only days from that day's month on are read and written, and replace those months; the others stay. Rows
    without a day are written when all is. slices: all sales are written in so many by their orders; see write_facts().
    """
    for name in ("sales", "ppc"):
        if since is None:
            facts.write_facts(tables[name], f"{store}/{name}", key="order_id", slices=slices if name == "sales" else 1)
        else:
            facts.replace_months(P.within(tables[name], F.trunc(F.lit(since).cast("date"), "month"), None), f"{store}/{name}")
    tables["inventory"].write.mode("overwrite").parquet(f"{store}/inventory")


def load_store(spark: SparkSession, store: str) -> Tables:
    """The tables of a store; sales and ads know their latest days from the files' footers."""
    return {n: facts.read_facts(spark, f"{store}/{n}") for n in ("sales", "ppc")} | {"inventory": spark.read.parquet(f"{store}/inventory")}


def run_report(name: str, tables: Tables, period: str = "LAST_30_DAYS") -> DataFrame:
    if name not in REPORTS:
        raise ValueError(f"unknown report {name!r}; one of {', '.join(REPORTS)}")
    return REPORTS[name](tables, period, rolling_days(period))


def report_bundle(tables: Tables, period: str, path: str, campaign: str = "All Campaigns", names: list[str] | None = None) -> list[str]:
    """Writes each report as Parquet under path/period=<period>/<name>, in place of an earlier one of that period, and gives their names.

    Nothing is kept in memory: given the tables of a store, each report reads the months that it needs. There is no
    report on inventory without such a table, or if it is empty.
    """
    held = dict(tables) if campaign == "All Campaigns" else dict(tables) | {"ppc": prep.of_campaign(tables["ppc"], campaign)}
    if names is None:
        names = [n for n in REPORTS if n != "inventory_risk" or "inventory" in held and not held["inventory"].isEmpty()]
    for name in names:
        report = run_report(name, held, period)
        with facts.freed_shuffles(report.sparkSession):
            report.write.mode("overwrite").parquet(f"{path}/period={period}/{name}")
    return names
