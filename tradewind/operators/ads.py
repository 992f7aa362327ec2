"""Ad reports, joined sales and ads, bid rules, and inventory cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions.columns import first_existing, pct_change, ratio, ratio0, total
from .prep import UNIT_NAMES
from .sales import sums

COUNTS = ("spend", "sales", "orders", "units", "clicks", "impressions")


def ad_sums(when: Column | None = None, prefix: str = "", columns: tuple[str, ...] = COUNTS) -> list[Column]:
    value = lambda c: F.col(c) if when is None else F.when(when, F.col(c))
    return [total(value(c)).cast("double").alias(f"{prefix}{c}") for c in columns]


def ad_ratios(prefix: str = "", names: tuple[str, ...] = ("acos", "roas", "cvr", "ctr", "cpc"), zero: tuple[str, ...] = ()) -> dict[str, Column]:
    """Ratios of summed columns; null where there is nothing to divide by, 0 for the names in zero."""
    parts = {"acos": ("spend", "sales"), "roas": ("sales", "spend"), "cvr": ("orders", "clicks"), "ctr": ("clicks", "impressions"), "cpc": ("spend", "clicks")}
    return {f"{prefix}{n}": (ratio0 if n in zero else ratio)(*(F.col(f"{prefix}{c}") for c in parts[n])) for n in names}


def ppc_summary(ppc: DataFrame, days: int) -> DataFrame:
    """One row: ad totals and ratios of the last days and of as many before, and four percent changes."""
    rows = P.labelled_days(ppc, days)
    now = F.col("slice") == "current"
    both = rows.agg(*ad_sums(now, "current_"), *ad_sums(~now, "prior_"))
    both = both.withColumns(ad_ratios("current_", zero=("ctr", "cvr", "cpc")) | ad_ratios("prior_", zero=("ctr", "cvr", "cpc")))
    return both.withColumns({f"{n}_change_pct": pct_change(F.col(f"current_{n}"), F.col(f"prior_{n}")) for n in ("spend", "sales", "acos", "roas")})


def daily_sales_and_ads(sales: DataFrame, ppc: DataFrame) -> DataFrame:
    """By day with sales: their totals and the ads' ones, 0 where there were none."""
    daily = sales.where("date is not null").groupBy("date").agg(*sums()).select("date", F.col("revenue").alias("total_sales"), F.col("orders").alias("total_orders"))
    ads = ppc.groupBy("date").agg(*ad_sums())
    return daily.join(ads, "date", "left").fillna(0, list(COUNTS))


def marketing_summary(sales: DataFrame, ppc: DataFrame, days: int) -> DataFrame:
    """One row: sales with ads of the last days and as many before; total_orders adds up the days' distinct orders."""
    ref = P.day_of(sales)
    recent = [P.last_days(df, 2 * days, ref=ref) for df in (sales, ppc)]
    rows = P.labelled_days(daily_sales_and_ads(*recent), days, ref=ref)
    now, columns = F.col("slice") == "current", ("total_sales", "total_orders", *COUNTS)
    both = rows.agg(*ad_sums(now, "current_", columns), *ad_sums(~now, "prior_", columns))
    for p in ("current_", "prior_"):
        c = lambda n, p=p: F.col(p + n)
        both = both.withColumns({f"{p}tacos": ratio(c("spend"), c("total_sales")), f"{p}ad_sales_share": ratio(c("sales"), c("total_sales"))} | ad_ratios(p, ("acos", "roas", "ctr")))
    return both.withColumns({f"{n}_change_pct": pct_change(F.col(f"current_{n}"), F.col(f"prior_{n}")) for n in ("total_sales", "spend", "sales", "tacos")})


def ppc_kpis(ppc: DataFrame, sales: DataFrame, period: str) -> DataFrame:
    """One row over the timestamp form of a period: ad totals, ratios and revenue; 0 where there is nothing to divide by."""
    ads = P.since_timestamp(ppc, period, "date").agg(*ad_sums())
    sold = P.since_timestamp(sales, period, "purchase_date").agg(total(F.col("revenue")).cast("double").alias("revenue"))
    every = ("acos", "roas", "ctr", "cvr")
    return ads.crossJoin(F.broadcast(sold)).withColumns(ad_ratios("", every, every) | {"tacos": ratio0(F.col("spend"), F.col("revenue"))})  # two rows of one each


def keyword_totals(ppc: DataFrame, days: int, keys: list[str]) -> DataFrame:
    return P.last_days(ppc, days).dropna(subset=keys).groupBy(*keys).agg(*ad_sums()).withColumns(ad_ratios())


def top_keywords(ppc: DataFrame, days: int = 30, min_clicks: int = 1, top_n: int = 20, keys: tuple[str, ...] = ("keyword", "match_type")) -> DataFrame:
    table = keyword_totals(ppc, days, list(keys)).where(F.col("clicks") >= min_clicks)
    return table.orderBy(F.desc("sales"), *keys).limit(top_n)


def bid_recommendations(ppc: DataFrame, days: int = 30, target_acos: float = 0.25, min_clicks: int = 10, min_spend: float = 15, pause_clicks: int = 20, scale_cvr: float = 0.12, top_n: int = 50, keys: tuple[str, ...] = ("keyword", "match_type")) -> DataFrame:
    """By keyword: totals, ratios, what to do with the bid, why, and the bid to try; the largest spends first."""
    c = F.col
    # Actions, reasons and the factor of a reduced bid.
    table = keyword_totals(ppc, days, list(keys))
    at_target = c("cpc") * F.coalesce(ratio(F.lit(target_acos), c("acos")), F.lit(1.0))
    rules = [
        ((c("clicks") < min_clicks) & (c("spend") < min_spend), "Hold", "Not enough data yet", c("cpc")),
        ((c("clicks") >= pause_clicks) & (c("sales") == 0), "Pause", "Enough clicks with no sales", F.lit(0.0)),
        ((c("sales") == 0) & (c("spend") >= min_spend), "Reduce bid", "Spend present but no sales yet", c("cpc") * 0.7),
        (c("acos") > target_acos, "Reduce bid", "ACOS above target", at_target),
        ((c("acos") <= target_acos) & (c("cvr") >= scale_cvr), "Increase bid", "Profitable keyword with strong conversion", at_target),
    ]
    advice = F.when(F.lit(False), F.lit(None))
    for rule, action, why, bid in rules:
        advice = advice.when(rule, F.struct(F.lit(action).alias("action"), F.lit(why).alias("reason"), bid.alias("suggested_cpc")))
    advice = advice.otherwise(F.struct(F.lit("Hold").alias("action"), F.lit("Borderline or stable performance").alias("reason"), c("cpc").alias("suggested_cpc")))
    out = table.withColumn("_advice", advice).select(*table.columns, "_advice.*").withColumns({"period_days": F.lit(days), "target_acos": F.lit(target_acos)})
    return out.orderBy(F.desc("spend"), F.desc("clicks"), *keys).limit(top_n)


def keyword_actions(table: DataFrame) -> DataFrame:
    """A table of ad totals and ratios with recommended_action; nulls count as 0."""
    v = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("spend", "sales", "clicks", "acos", "cvr")}
    # Thresholds and actions.
    action = (
        F.when((v["spend"] >= 15) & (v["sales"] == 0) & (v["clicks"] >= 10), "Pause / Reduce")
        .when((v["acos"] >= 0.45) & (v["spend"] >= 15), "Lower Bid")
        .when((v["acos"] <= 0.25) & (v["sales"] > 0) & (v["cvr"] >= 0.12), "Scale")
        .when(v["sales"] > 0, "Monitor")
        .otherwise("Low Data")
    )
    return table.withColumn("recommended_action", action)


def inventory_risk(stock: DataFrame, sales: DataFrame, days: int = 30) -> DataFrame:
    """By product: stock, demand a day, days of stock and a level; ordered by the level's name, then days. severity counts from 0, critical."""
    units = first_existing(stock, UNIT_NAMES)
    have = stock.dropna(subset=["asin"]).groupBy("asin").agg(total(F.col(units).try_cast("double")).cast("double").alias("stock"))
    sold = P.last_days(sales, days).dropna(subset=["asin"]).groupBy("asin").agg(total(F.col("units_sold_amazon")).cast("double").alias("units"))
    daily = F.coalesce("units", F.lit(0.0)) / days
    table = have.join(sold, "asin", "left").withColumn("daily_demand", daily).drop("units")
    left = ratio(F.col("stock"), F.col("daily_demand"))
    table = table.withColumn("days_of_inventory", left)
    d = F.col("days_of_inventory")
    # Levels and their days.
    level = F.when(d.isNull(), "No recent demand").when(d <= 14, "Critical").when(d <= 30, "High").when(d <= 60, "Medium").otherwise("Low")
    rank = F.when(d.isNull(), 4).when(d <= 14, 0).when(d <= 30, 1).when(d <= 60, 2).otherwise(3)
    return table.withColumns({"risk_level": level, "severity": rank}).orderBy("risk_level", F.asc_nulls_last("days_of_inventory"), "asin")


def critical_count(risks: DataFrame) -> DataFrame:
    return risks.agg(F.count_if(F.col("risk_level").isin("Critical", "High")).alias("critical_count"))
