import math

import pytest

from tradewind.fixtures import ppc_table, sales_table
from tradewind.plans import table_functions, tools

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    held = {"sales": sales_table(spark, SF), "ppc": ppc_table(spark, SF)}
    names = table_functions.create_functions(spark, held, "f_")
    yield held
    for n in names:
        spark.sql(f"DROP TEMPORARY FUNCTION {n}")
    spark.catalog.dropTempView("f_facts_sales"), spark.catalog.dropTempView("f_facts_ppc")


def rows(df):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(f"{v:.7g}") if isinstance(v, float) else str(v)
    return sorted(str([plain(v) for v in r]) for r in df.collect())


CALLS = [
    ("get_sales_summary", {}), ("get_sales_summary", {"days": 30}), ("get_ppc_summary", {"days": 5}), ("get_marketing_summary", {}), ("get_marketing_summary", {"days": 30}),
    ("get_top_keywords", {"days": 20, "min_clicks": 2, "top_n": 7}), ("get_top_products", {"days": 400, "metric": "orders", "top_n": 3}), ("get_product_mix", {"days": 60}), ("get_color_performance", {"days": 60}),
    *(("get_sales_summary_period", {"period": p}) for p in ("LAST_7_DAYS", "LAST_30_DAYS", "MTD", "YTD")),
    *(("get_sales_breakdown", {"period": "YTD", "group_by": g, "metric": m, "top_n": 4}) for g, m in (("color", "revenue"), ("type", "orders"), ("asin", "pairs_sold"))),
    ("compare_periods", {"period": "LAST_30_DAYS"}), ("compare_periods", {"period": "YTD", "metric": "orders", "group_by": "type", "top_n": 3}),
    ("explain_change", {"period": "YTD", "top_n": 5}), ("explain_change", {"period": "MTD", "group_by": "size", "metric": "units_sold_amazon"}),
    ("get_keyword_bid_recommendations", {}), ("get_keyword_bid_recommendations", {"days": 10, "target_acos": 0.5, "min_clicks": 1, "min_spend": 2.5, "pause_clicks": 2, "scale_cvr": 0.01, "top_n": 8}),
]


@pytest.mark.parametrize(("name", "arguments"), CALLS)
def test_functions_equal_tools(spark, tables, name, arguments):
    said = ", ".join(f"{k} => {v!r}" for k, v in arguments.items())
    mine = spark.sql(f"SELECT * FROM f_{name}({said})")
    other = tools.call_tool(tables, name, **arguments)
    if name in ("get_sales_breakdown",):
        g, m = arguments["group_by"], arguments["metric"]
        other = other.select(g, "revenue", "pairs_sold", "units_sold_amazon", "orders", f"{m}_pct", "start_date", "end_date")
    elif name == "explain_change":
        g = arguments.get("group_by", "asin")
        more = ["current_start", "current_end", "prior_start", "prior_end"]
        other = other.selectExpr(f"{g} AS name", "item_name" if g == "asin" else "CAST(NULL AS STRING) AS item_name", "double(current) current", "double(prior) prior", "double(change_abs) change_abs", "change_pct", "contribution_pct", *more)
    else:
        other = other.select(*(c for c in mine.columns if c in other.columns), *(["target_acos"] if "target" in mine.columns else []))
    assert rows(mine) == rows(other) and (name.startswith("compare") or mine.count() > 0)


def test_days_reach_the_scans_and_names_are_checked(spark, tables):
    plan = spark.sql("SELECT * FROM f_get_sales_breakdown(period => 'LAST_7_DAYS', group_by => 'asin', top_n => 3)")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert len(scans) == 1 and "date_month" in scans[0].split("PartitionFilters: ")[1].split("]")[0] and "GreaterThanOrEqual(date,2" in scans[0]
    for bad in ("get_sales_breakdown(group_by => 'state')", "get_sales_breakdown(metric => 'acos')", "get_sales_summary_period('LAST_YEAR')", "get_sales_summary(0)", "get_top_keywords(days => 30, top_n => 0)"):
        with pytest.raises(Exception, match="may be|1 or more"):
            spark.sql(f"SELECT * FROM f_{bad}").collect()
