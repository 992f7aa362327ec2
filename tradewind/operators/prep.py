"""From raw exports to clean tables of sales, ads, inventory and business reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_number, first_existing, normalized, ratio, text_time

# Names of the raw exports and what they become.
ORDER_NAMES = {
    "amazon-order-id": "order_id", "purchase-date": "purchase_date", "product-name": "product_name", "sales-channel": "sales_channel", "ship-state": "ship_state",
    "item-price": "item_price", "item-tax": "item_tax", "shipping-price": "shipping_price", "shipping-tax": "shipping_tax", "gift-wrap-price": "gift_wrap_price",
    "gift-wrap-tax": "gift_wrap_tax", "item-promotion-discount": "item_promotion_discount", "ship-promotion-discount": "ship_promotion_discount",
}
PPC_NAMES = {
    "campaign name": "campaign", "ad group name": "ad_group", "targeting": "keyword", "match type": "match_type", "customer search term": "search_term",
    "click-thru rate (ctr)": "ctr", "cost per click (cpc)": "cpc", "7 day total sales": "sales", "total advertising cost of sales (acos)": "acos",
    "total return on advertising spend (roas)": "roas", "7 day total orders (#)": "orders", "7 day total units (#)": "units", "7 day conversion rate": "cvr",
}
MONEY = ["item_price", "item_tax", "shipping_price", "shipping_tax", "gift_wrap_price", "gift_wrap_tax", "item_promotion_discount", "ship_promotion_discount"]
PACKS = {"single": 1, "3-pack": 3, "6-pack": 6}
UNIT_NAMES = ["quantity available", "available", "available_units", "current_total_units", "inventory", "units", "quantity"]
# The colours and sizes that a product's name tells.
COLORS, SIZES = "(White|Black|Blue)", "(Small/Medium|Large/X-Large|Large)"


def pack_size(kind):
    """Pieces to a pack by product type; 1 for others."""
    pairs = [F.lit(x) for pair in PACKS.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[kind], F.lit(1))


def derive_sales(df: DataFrame) -> DataFrame:
    """What follows from quantity, item_price, pack_size and purchase_date: revenue, unit_price, units, pairs, date."""
    return df.withColumns(
        {
            "revenue": F.col("item_price"),
            "unit_price": ratio(F.col("item_price"), F.col("quantity")),
            "units_sold_amazon": F.col("quantity"),
            "pairs_sold": F.col("quantity") * F.col("pack_size"),
            "date": F.to_date("purchase_date"),
        }
    )


def prep_sales(orders: DataFrame, catalogue: DataFrame, channel: str = "Amazon.com", formats: tuple[str, ...] = ()) -> DataFrame:
    """Clean sales: orders of catalogued products in one channel with a positive quantity, enriched.

    What is no date or number becomes null; catalogue rows that repeat a product multiply its orders. The catalogue
    is a dimension: the optimizer broadcasts it if it is small.
    """
    raw = normalized(orders, ORDER_NAMES)
    names = normalized(catalogue, {"item": "item_name"})
    clash = [c for c in names.columns if c in raw.columns and c != "asin"]
    names = names.withColumnsRenamed({c: f"{c}_asin" for c in clash})
    sales = raw.where(F.col("sales_channel") == channel).withColumn("purchase_date", text_time(F.col("purchase_date"), formats)).join(names, "asin")
    found = {name: F.nullif(F.regexp_extract("item_name", pattern, 1), F.lit("")) for name, pattern in (("color", COLORS), ("size", SIZES))}
    numbers = {c: F.col(c).try_cast("double") for c in MONEY if c in sales.columns} | {"quantity": F.col("quantity").try_cast("double").try_cast("long")}
    sales = sales.withColumns(found | numbers).where("quantity > 0")
    return derive_sales(sales.withColumn("pack_size", pack_size(F.col("type"))))


def of_catalogue(df: DataFrame, catalogue: DataFrame, key: str = "asin") -> DataFrame:
    """The rows whose product is in the catalogue; null products are in none."""
    return df.join(catalogue.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def prep_ppc(ppc: DataFrame, campaign: str | None = None) -> DataFrame:
    """Clean ad rows of campaigns that hold a token (in any case): numbers from text, days, and row ratios; rows without a day go."""
    raw = normalized(ppc, PPC_NAMES)
    if campaign:
        raw = raw.where(F.lower("campaign").contains(campaign.lower()))
    shares = [c for c in ("ctr", "cvr", "acos") if c in raw.columns]
    numbers = [c for c in ("impressions", "clicks", "spend", "sales", "orders", "units", "cpc", "roas") if c in raw.columns]
    cleaned = raw.withColumns({c: clean_number(c, c in shares) for c in shares + numbers})
    cleaned = cleaned.withColumn("date", F.to_date(text_time(F.col("date").cast("string"), ("M/d/yy", "M/d/yyyy")))).where("date is not null")
    return row_ratios(cleaned)


def row_ratios(ppc: DataFrame) -> DataFrame:
    c = F.col
    return ppc.withColumns({"ctr_calc": ratio(c("clicks"), c("impressions")), "cvr_calc": ratio(c("orders"), c("clicks")), "acos_calc": ratio(c("spend"), c("sales")), "roas_calc": ratio(c("sales"), c("spend"))})


def prep_business_report(report: DataFrame, shift: bool = True) -> DataFrame:
    """(date, week, ordered_product_sales, sessions, conversion_rate): percents stay from 0 to 100; week is the day after, if shifted."""
    raw = normalized(report, underscores=True)
    name = lambda *n: first_existing(raw, list(n))
    day = F.coalesce(F.try_to_timestamp("date", F.lit("M/d/yy")), F.try_to_timestamp("date")).cast("date")
    return raw.select(
        day.alias("date"), F.date_add(day, int(shift)).alias("week"), clean_number("ordered_product_sales").alias("ordered_product_sales"),
        clean_number(name("sessions___total", "sessions_total", "sessions")).alias("sessions"),
        clean_number(name("order_item_session_percentage", "conversion_rate")).alias("conversion_rate"),
    )


def latest_snapshot(snapshots: DataFrame, date_col: str = "snapshot_date") -> DataFrame:
    """The rows of the latest day, which is a literal, so that the scan is pruned; none of an empty table."""
    last = snapshots.agg(F.max(date_col)).first()[0]
    return snapshots.where(F.col(date_col) == F.lit(last))


def dedupe_latest(df: DataFrame, keys: list[str], latest: str, then: list[str]) -> DataFrame:
    """One row of each key: the one with the latest `latest`; ties by the columns `then`, falling."""
    order = Window.partitionBy(*keys).orderBy(F.desc(latest), *map(F.desc, then))
    return df.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that come more than once, with n, the most frequent first."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), *keys)


def order_totals(sales: DataFrame) -> DataFrame:
    """By order: its lines, revenue, units, pairs and first day. Sales that are stored by order are not shuffled for it."""
    sums = {"revenue": "double", "units_sold_amazon": "long", "pairs_sold": "long"}
    return sales.groupBy("order_id").agg(F.count("*").alias("lines"), *(F.sum(c).cast(kind).alias(c) for c, kind in sums.items()), F.min("date").alias("date"))


def dedupe_check(df: DataFrame, keys: list[str], latest: str, then: list[str]) -> DataFrame:
    """One row: the rows, keys and repeated keys of df, and the rows and repeated keys that dedupe_latest() leaves, all from one pass."""
    order = Window.partitionBy(*keys).orderBy(F.desc(latest), *map(F.desc, then))
    each = df.withColumn("_at", F.row_number().over(order)).groupBy(*keys).agg(F.count("*").alias("all"), F.count_if(F.col("_at") == 1).alias("kept"))
    tally = lambda c: [F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_rows"), F.count_if(F.col(c) > 0).alias(f"{c}_keys"), F.count_if(F.col(c) > 1).alias(f"{c}_repeated")]
    return each.agg(*tally("all"), *tally("kept"))


def campaigns(ppc: DataFrame) -> DataFrame:
    return ppc.select("campaign").where("campaign is not null").distinct().orderBy("campaign")


def of_campaign(ppc: DataFrame, campaign: str = "All Campaigns") -> DataFrame:
    return ppc if campaign == "All Campaigns" else ppc.where(F.col("campaign") == campaign)


def order_lookup(orders: DataFrame, order_id, columns: list[str], by: str = "imported_at") -> DataFrame:
    return orders.where(F.col("order_id") == order_id).select(*columns).orderBy(by)


def latest_rows(df: DataFrame, by: str, n: int = 10, then: tuple[str, ...] = ()) -> DataFrame:
    return df.orderBy(F.desc(by), *then).limit(n)


def preview(df: DataFrame, columns: list[str], by: list[str], n: int, last: bool = False) -> DataFrame:
    """The first (or last) n rows in an order."""
    return df.select(*columns).orderBy(*(F.desc(c) if last else F.asc(c) for c in by)).limit(n)
