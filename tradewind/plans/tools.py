"""Reports to be called by name with checked arguments, also from SQL as views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import periods as P
from ..operators import ads, sales, trends
from .report import Tables

# What a trend can be of, and the names that some of these have elsewhere.
TREND_METRICS = ("revenue", "orders", "pairs_sold", "units_sold_amazon", "aov", "ad_spend", "ad_sales", "acos", "roas", "tacos", "three_pack_share")
OTHER_NAMES = {"3_pack_share": "three_pack_share"}


@dataclass(frozen=True)
class Argument:
    """A kind of argument: what it is if left out, and what it may be."""

    default: object
    among: tuple = ()
    least: float | None = None

    def checked(self, name: str, value: object) -> object:
        value = OTHER_NAMES.get(value, value) if isinstance(value, str) else value
        if value is None and self.default is None:
            return None
        if self.among:
            if value not in self.among:
                raise ValueError(f"{name} is {value!r}; it may be {', '.join(map(str, self.among))}")
            return value
        if isinstance(value, bool) or not isinstance(value, int | float) or isinstance(self.default, int) and not isinstance(value, int) or value < self.least:
            raise ValueError(f"{name} is {value!r}; it has to be {'a whole number' if isinstance(self.default, int) else 'a number'} from {self.least} on")
        return value


DAYS, PERIOD, TOP = Argument(7, least=1), Argument("LAST_7_DAYS", P.PERIODS), Argument(10, least=1)
METRIC, GROUP = Argument("revenue", sales.METRICS), Argument("color", sales.GROUPS)


@dataclass(frozen=True)
class Tool:
    run: Callable[..., DataFrame]
    arguments: dict[str, Argument] = field(default_factory=dict)


def _comparison(t: Tables, period: str, metric: str, group_by: str | None, top_n: int) -> DataFrame:
    """(kind, name, current, prior, change_abs, change_pct, contribution_pct): all metrics, and what drives one of them if it is to be grouped."""
    whole = sales.compare_periods(t["sales"], period).select(F.lit("metric").alias("kind"), F.col("metric").alias("name"), "current", "prior", "change_abs", "change_pct", F.lit(None).cast("double").alias("contribution_pct"))
    if group_by is None:
        return whole
    parts = sales.compare_drivers(t["sales"], period, group_by, metric, top_n).withColumn("change_pct", sales.pct_change(F.col("current"), F.col("prior")))
    values = [F.col(c).cast("double").alias(c) for c in ("current", "prior", "change_abs", "change_pct", "contribution_pct")]
    return whole.unionByName(parts.select(F.lit("driver").alias("kind"), F.col(group_by).alias("name"), *values))


def _trend(t: Tables, metric: str, weeks: int) -> DataFrame:
    return trends.metric_trend_summary(trends.metric_trend_weekly(t["sales"], t["ppc"], weeks), metric, points=True)


TOOLS: dict[str, Tool] = {
    "get_sales_summary": Tool(lambda t, days: sales.sales_summary_days(t["sales"], days), {"days": DAYS}),
    "get_ppc_summary": Tool(lambda t, days: ads.ppc_summary(t["ppc"], days), {"days": DAYS}),
    "get_marketing_summary": Tool(lambda t, days: ads.marketing_summary(t["sales"], t["ppc"], days), {"days": DAYS}),
    "get_top_keywords": Tool(lambda t, days, min_clicks, top_n: ads.top_keywords(t["ppc"], days, min_clicks, top_n), {"days": DAYS, "min_clicks": Argument(5, least=0), "top_n": TOP}),
    "get_top_products": Tool(lambda t, days, metric, top_n: sales.top_products(t["sales"], days, metric, top_n), {"days": DAYS, "metric": METRIC, "top_n": TOP}),
    "get_product_mix": Tool(lambda t, days: sales.mix(t["sales"], days, "type"), {"days": DAYS}),
    "get_color_performance": Tool(lambda t, days: sales.mix(t["sales"], days, "color"), {"days": DAYS}),
    "get_sales_summary_period": Tool(lambda t, period: sales.sales_summary(t["sales"], period), {"period": PERIOD}),
    "get_sales_breakdown": Tool(lambda t, period, group_by, metric, top_n: sales.sales_breakdown(t["sales"], period, group_by, metric, top_n), {"period": PERIOD, "group_by": GROUP, "metric": METRIC, "top_n": TOP}),
    "compare_periods": Tool(_comparison, {"period": PERIOD, "metric": METRIC, "group_by": Argument(None, sales.GROUPS), "top_n": TOP}),
    "explain_change": Tool(lambda t, period, metric, group_by, top_n: sales.explain_change(t["sales"], period, group_by, metric, top_n), {"period": PERIOD, "metric": METRIC, "group_by": Argument("asin", sales.GROUPS), "top_n": TOP}),
    "get_metric_trend": Tool(_trend, {"metric": Argument("revenue", TREND_METRICS), "weeks": Argument(12, least=1)}),
    "get_keyword_bid_recommendations": Tool(
        lambda t, **x: ads.bid_recommendations(t["ppc"], **x),
        {"days": Argument(30, least=1), "target_acos": Argument(0.25, least=0), "min_clicks": Argument(10, least=0), "min_spend": Argument(15.0, least=0), "pause_clicks": Argument(20, least=0), "scale_cvr": Argument(0.12, least=0), "top_n": Argument(50, least=1)},
    ),
}


def call_tool(tables: Tables, name: str, **arguments: object) -> DataFrame:
    """A report by name. Unknown names, arguments that it does not take, and values out of range are refused before anything is read."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool {name!r}; one of {', '.join(TOOLS)}")
    tool = TOOLS[name]
    if unknown := sorted(set(arguments) - set(tool.arguments)):
        raise ValueError(f"{name} does not take {', '.join(unknown)}; it takes {', '.join(tool.arguments)}")
    return tool.run(tables, **{n: a.checked(n, arguments.get(n, a.default)) for n, a in tool.arguments.items()})


def tool_views(tables: Tables, prefix: str = "", **arguments: object) -> list[str]:
    """Makes every tool, with those of the arguments that it takes, a temporary view of its name, for SQL; gives the views' names."""
    names = []
    for name, tool in TOOLS.items():
        call_tool(tables, name, **{k: v for k, v in arguments.items() if k in tool.arguments}).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
