"""Root causes: a good and a bad time compared by search term, keyword and product; labels of products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions.columns import ratio, total, week_ending_monday
from .ads import ad_ratios, ad_sums
from .trends import by_week

Days = tuple[str, str]


def in_days(days: Days) -> Column:
    """Whether date is within two literal days, both included."""
    return F.col("date").between(*(F.lit(d).cast("date") for d in days))


def good_and_bad(ppc: DataFrame, good: Days, bad: Days, keys: list[str]) -> DataFrame:
    """Ad totals by keys in both windows, of the keys that come in either."""
    days = sorted([*good, *bad])
    rows = P.between_days(ppc, days[0], days[-1]).where(in_days(good) | in_days(bad)).dropna(subset=keys)
    return rows.groupBy(*keys).agg(*ad_sums(in_days(good), "good_"), *ad_sums(in_days(bad), "bad_"))


def term_stats(ppc: DataFrame, days: Days, sort: str = "sales", top_n: int | None = None) -> DataFrame:
    rows = P.between_days(ppc, *days).dropna(subset=["search_term"]).groupBy("search_term").agg(*ad_sums()).withColumns(ad_ratios("", ("cvr", "acos")))
    ordered = rows.orderBy(F.desc(sort), "search_term")
    return ordered if top_n is None else ordered.limit(top_n)


def term_comparison(ppc: DataFrame, good: Days, bad: Days, top_n: int = 25) -> DataFrame:
    """By search term: sales and orders in both windows and their change, the largest losses first."""
    both = good_and_bad(ppc, good, bad, ["search_term"]).select("search_term", "good_sales", "bad_sales", "good_orders", "bad_orders")
    table = both.withColumns({"sales_delta": F.col("bad_sales") - F.col("good_sales"), "orders_delta": F.col("bad_orders") - F.col("good_orders")})
    return table.orderBy("sales_delta", "search_term").limit(top_n)


def keyword_compare(ppc: DataFrame, good: Days, bad: Days, top_spend: int = 20, worst: int = 20) -> DataFrame:
    """Of the keywords with the largest spend: ratios in both windows and changes, the worst first."""
    inside, both = in_days(good) | in_days(bad), [*ad_sums(in_days(good), "good_"), *ad_sums(in_days(bad), "bad_")]
    every = ppc.dropna(subset=["keyword"]).groupBy("keyword").agg(F.sum("spend").alias("_spend"), F.count_if(inside).alias("_inside"), *both)
    both = every.orderBy(F.desc("_spend"), "keyword").limit(top_spend).where("_inside > 0").drop("_spend", "_inside")
    names = ("cpc", "cvr", "roas", "acos")
    table = both.withColumns(ad_ratios("good_", names) | ad_ratios("bad_", names))
    deltas = {f"{n}_delta": F.col(f"bad_{n}") - F.col(f"good_{n}") for n in ("sales", "orders", "cvr")}
    return table.withColumns(deltas).orderBy("sales_delta", "keyword").limit(worst)


def keyword_compare_active(table: DataFrame, spend: float = 10) -> DataFrame:
    return table.where((F.col("good_spend") > spend) & (F.col("bad_spend") > spend)).orderBy(F.desc("good_sales"), "keyword")


def brand_type(token: str) -> Column:
    """Branded if the search term holds the token in any case; else, also of null, Non-Branded."""
    return F.when(F.lower("search_term").contains(token.lower()), "Branded").otherwise("Non-Branded")


def brand_split(ppc: DataFrame, token: str) -> DataFrame:
    rows = by_week(ppc.withColumn("brand_type", brand_type(token)), week_ending_monday(F.col("date")), ad_sums(), ["brand_type"])
    return rows.withColumns(ad_ratios("", ("cvr", "roas")))


def waste_terms(ppc: DataFrame, token: str, min_spend: float = 5, keys: tuple[str, ...] = ("search_term",)) -> DataFrame:
    """Search terms (or finer keys) without the brand that cost more than min_spend and brought no order."""
    rows = ppc.where(brand_type(token) == "Non-Branded").dropna(subset=list(keys))
    table = rows.groupBy(*keys).agg(*ad_sums()).withColumns(ad_ratios("", ("cvr",)))
    return table.where((F.col("spend") > min_spend) & (F.col("orders") == 0)).orderBy(F.desc("spend"), *keys)


def perf_by_match_type(ppc: DataFrame, days: Days | None = None) -> DataFrame:
    rows = ppc if days is None else P.between_days(ppc, *days)
    return rows.dropna(subset=["match_type"]).groupBy("match_type").agg(*ad_sums(columns=("clicks", "spend", "sales", "orders")))


def sku_mix(sales: DataFrame, split: str) -> DataFrame:
    """By time before and after a day and product: revenue and its share of that time."""
    time = F.when(F.col("date") < F.lit(split).cast("date"), "before").otherwise("after")
    rows = sales.where("date is not null").dropna(subset=["item_name"])
    table = rows.groupBy(time.alias("period"), "item_name").agg(total(F.col("revenue")).cast("double").alias("revenue"))
    return table.withColumn("share", ratio(F.col("revenue"), F.sum("revenue").over(Window.partitionBy("period"))))


def type_compare(sales: DataFrame, split: str) -> DataFrame:
    """Types that sold both before and after a day: revenue and its share of each time."""
    now = F.col("date") >= F.lit(split).cast("date")
    rows = sales.where("date is not null").dropna(subset=["type"])
    table = rows.groupBy("type").agg(*(total(F.when(c, F.col("revenue"))).cast("double").alias(f"revenue_{n}") for n, c in (("before", ~now), ("after", now))), F.count_if(~now).alias("_b"), F.count_if(now).alias("_a"))
    whole = lambda n: F.sum(f"revenue_{n}").over(Window.partitionBy(F.lit(1)))  # noqa: E731  one row a type
    both = table.withColumns({f"share_{n}": ratio(F.col(f"revenue_{n}"), whole(n)) for n in ("before", "after")})
    return both.where("_a > 0 and _b > 0").select("type", "revenue_before", "revenue_after", "share_before", "share_after")


def conversion_baseline(report: DataFrame, base: list[str], recent: list[str]) -> DataFrame:
    """One row: mean conversion rates of two lists of weeks and the percent change."""
    mean = lambda days: F.avg(F.when(F.col("week").isin([F.lit(d).cast("date") for d in days]), F.col("conversion_rate")))
    one = report.agg(mean(base).alias("baseline"), mean(recent).alias("recent"))
    return one.withColumn("change_pct", ratio(F.col("recent"), F.col("baseline")) * 100 - 100)


def sku_label(text: Column) -> Column:
    """pack, color and size of a product's text, in short."""
    # The words that tell a label, in the order that they are looked for, and the labels.
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda *parts: F.greatest(*(low.contains(p) for p in parts), F.lit(False))
    pack = F.when(has("3 pack", "3-pack", "white 3", "black 2"), "3-pack").when(has("6 pair", "6-pack"), "6-pack").otherwise("single")
    color = F.when(has("white"), "white").when(has("black"), "black").when(has("blue"), "blue").otherwise("unknown")
    size = F.when(has("small/medium", "small, medium"), "S/M").when(has("large/x-large", "large, x-large"), "L/XL").otherwise("?")
    return F.concat_ws(", ", pack, color, size)


def clean_product_name(text: Column, phrases: list[str]) -> Column:
    """A product's name without brand phrases; Product if nothing is left."""
    out = F.coalesce(text, F.lit(""))
    for phrase in phrases:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    trimmed = F.regexp_replace(out, "^[ -]+|[ -]+$", "")
    return F.when(trimmed == "", "Product").otherwise(trimmed)
