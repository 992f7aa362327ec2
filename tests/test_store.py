import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tradewind import queries
from tradewind.fixtures import inventory_table, make_sales, ppc_table, sales_table
from tradewind.functions import periods as P
from tradewind.operators import prep, sales, trends
from tradewind.plans import report, tools
from tradewind.sources import facts

SF = "/root/testdata/sf0.001"
D = dt.date
ROWS = "date date, purchase_date timestamp, order_id string, v int"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ran(df):
    """The plan that ran."""
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


def facts_of(spark, days, v=1):
    return spark.createDataFrame([(d, d and dt.datetime(d.year, d.month, d.day, 5), "o", v) for d in days], ROWS)


def files(path):
    return {os.path.join(a, f): os.stat(os.path.join(a, f)).st_mtime_ns for a, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_months_are_pruned_and_replaced(spark, tmp_path):
    path = f"{tmp_path}/facts"
    days = [D(2024, m, d) for m in (1, 2, 3) for d in (1, 15, 28)]
    facts.write_facts(facts_of(spark, [*days, None]), path)
    held = facts.read_facts(spark, path)
    assert held.latest == P.Latest("date", D(2024, 3, 28)) and held.count() == 10
    recent = P.in_period(held, "LAST_7_DAYS")
    assert recent.count() == 1 and "PartitionFilters: [isnotnull(date_month" in plan_of(recent) and "2024-03-01" in plan_of(recent)
    assert P.since_timestamp(held, "MTD", "purchase_date").count() == 3
    before = files(path)
    facts.replace_months(facts_of(spark, [D(2024, 3, 2), D(2024, 4, 1)], 2), path)
    after = files(path)
    kept = {f for f in before if "date_month=2024-03" not in f}
    assert kept and all(after[f] == before[f] for f in kept)
    held = facts.read_facts(spark, path)
    assert sorted((r.date, r.v) for r in held.where("date_month >= '2024-03-01'").collect()) == [(D(2024, 3, 2), 2), (D(2024, 4, 1), 2)]
    assert held.latest.day == D(2024, 4, 1) and held.count() == 9


def test_footers_tell_the_latest_day(spark, tmp_path):
    path = f"{tmp_path}/facts"
    facts.write_facts(facts_of(spark, [D(2024, 1, 1), D(2024, 2, 3)]), path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown")}
    extent = facts.footer_extent(spark, path, "date")
    assert "PushedAggregation: [MIN(date), MAX(date), COUNT(*)]" in plan_of(extent)
    assert extent.first() == (D(2024, 1, 1), D(2024, 2, 3), 2)
    assert {k: spark.conf.get(k) for k in before} == before
    held = facts.read_facts(spark, path)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("days"))
    spark.sparkContext.setJobGroup("days", "")
    P.day_of(held)
    assert jobs() == 0
    assert held.where("v = 9").count() == 0 and not hasattr(held.where("v = 9"), "latest")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_empty_facts(spark, tmp_path):
    facts.write_facts(facts_of(spark, [None]), f"{tmp_path}/a")
    held = facts.read_facts(spark, f"{tmp_path}/a")
    assert held.latest.day is None and P.in_period(held, "YTD").count() == 0 and P.since_timestamp(held, "YTD", "purchase_date").count() == 1
    facts.write_facts(facts_of(spark, [None]).limit(0), f"{tmp_path}/b")
    none = facts.read_facts(spark, f"{tmp_path}/b")
    assert none.latest.day is None and none.columns == ["date", "purchase_date", "order_id", "v", "date_month"] and none.count() == 0


ONE_SCAN = {
    "metric_trend_weekly": 2, "metric_trend_summary": 2, "weekly_sales": 1, "rolling_4wk": 1, "weekly_ppc": 1, "weekly_combined": 2, "hero_sku_weekly": 1, "money_terms_weekly": 1,
    "weekly_sku_pivot": 1, "sales_breakdown_asin": 1, "sales_by_product": 1, "compare_drivers": 1, "explain_change": 1, "velocity": 1, "type_compare": 1, "dedupe_check": 1, "keyword_compare": 1,
    "sales_by_dimensions": 1, "weekly_health": 3,
}


@pytest.mark.parametrize("name", sorted(ONE_SCAN))
def test_facts_are_read_once(spark, name):
    """weekly_health has a business report besides, which comes from the ads here."""
    assert ran(queries.QUERIES[name](spark, SF)).count("FileScan") == ONE_SCAN[name]


def test_a_bundle_reads_its_months_only(spark, tmp_path, monkeypatch):
    tables = {"sales": sales_table(spark, SF), "ppc": ppc_table(spark, SF), "inventory": prep.latest_snapshot(inventory_table(spark, SF))}
    for name in report.REPORTS:
        plan = plan_of(report.run_report(name, tables, "LAST_7_DAYS"))
        scans = [x for x in plan.splitlines() if "FileScan" in x and "date_month" in x]
        assert scans and all("date_month" in x.split("PartitionFilters: ")[1].split("]")[0] for x in scans), name
        assert "InMemoryTableScan" not in plan, name
    names = ["sales_summary", "keyword_actions", "sales_by_dimension"]
    for period in ("LAST_7_DAYS", "LAST_30_DAYS", "LAST_7_DAYS"):
        before = files(f"{tmp_path}/period=LAST_30_DAYS")
        assert report.report_bundle(tables, period, str(tmp_path), names=names) == names
        assert period == "LAST_30_DAYS" or files(f"{tmp_path}/period=LAST_30_DAYS") == before
    assert "recommended_action" in spark.read.parquet(f"{tmp_path}/period=LAST_30_DAYS/keyword_actions").columns


def test_a_store_of_exports(spark, tmp_path):
    """Loaded, stored, and a month stored again with what has changed."""
    loaded = report.load_all(spark, queries._raw_exports(spark, SF), "c1", "F")
    store = f"{tmp_path}/store"
    report.store_all(loaded, store)
    held = report.load_store(spark, store)
    assert {n: held[n].count() for n in held} == {n: loaded[n].count() for n in loaded}
    got, want = (sorted(map(tuple, sales.sales_breakdown(t["sales"], "YTD", "type").select("type", F.round("revenue", 4), "orders").collect())) for t in (held, loaded))
    assert got == want
    last = held["sales"].latest.day
    changed = loaded | {"sales": loaded["sales"].withColumn("revenue", F.lit(1.0)), "ppc": loaded["ppc"].limit(0)}
    report.store_all(changed, store, since=str(last))
    again = report.load_store(spark, store)
    late = F.col("date") >= F.trunc(F.lit(last), "month")
    assert again["sales"].where(late & (F.col("revenue") != 1)).count() == 0 and again["sales"].where(~late & (F.col("revenue") != 1)).count() > 0
    assert again["sales"].count() == loaded["sales"].count() and again["ppc"].count() == loaded["ppc"].count()
    names = report.report_bundle(again, "MTD", f"{tmp_path}/out")
    assert "inventory_risk" not in names and len(names) == len(report.REPORTS) - 1


def test_dimensions_equal_single_reports(spark):
    held = sales_table(spark, SF)
    both = sales.sales_by_dimensions(held, "YTD")
    for name in sales.DIMENSIONS:
        one = sales.sales_by(held, "YTD", [name]).select(F.col(name).alias("value"), "revenue", "pairs_sold", "orders", "aov", F.round("revenue_share", 6))
        own = both.where(F.col("dimension") == name).select("value", "revenue", "pairs_sold", "orders", "aov", F.round("revenue_share", 6))
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, one.collect())), name
    assert sales.sales_by_dimensions(held.drop("size", "ship_state"), "YTD").select("dimension").distinct().count() == 2


def test_shares_of_the_largest(spark):
    """All groups are in the whole, also those beyond the limit, and ties go by key."""
    rows = [(f"a{k:02}", f"o{k}", D(2024, 5, 1), dt.datetime(2024, 5, 1), 10.0 if k < 4 else 1.0) for k in range(14)]
    df = spark.createDataFrame(rows, "asin string, order_id string, date date, purchase_date timestamp, revenue double").withColumns({"pairs_sold": F.lit(1), "units_sold_amazon": F.lit(1), "product_name": F.col("asin")})
    top = sales.sales_breakdown(df, "YTD", "asin", top_n=3).collect()
    assert [r.asin for r in top] == ["a00", "a01", "a02"] and all(abs(r.revenue_pct - 0.2) < 1e-12 for r in top)
    assert len(sales.sales_breakdown(df, "YTD", "asin", top_n=99).collect()) == 14 and sales.sales_breakdown(df.limit(0), "YTD", "asin").collect() == []
    assert [r.product_name for r in sales.velocity(df, "YTD", 2).collect()] == ["a00", "a01"]


def test_gap_weeks(spark):
    rows = [(D(2024, 1, 6), 1), (D(2024, 1, 27), None), (D(2024, 2, 3), 3), (None, 9)]
    got = trends.with_gap_weeks(spark.createDataFrame(rows, "week date, v int")).orderBy("week").collect()
    assert [tuple(r) for r in got] == [(D(2024, 1, 6), 1), (D(2024, 1, 13), None), (D(2024, 1, 20), None), (D(2024, 1, 27), None), (D(2024, 2, 3), 3)]
    assert trends.with_gap_weeks(spark.createDataFrame([], "week date, v int")).collect() == []


def test_tools_refuse_what_they_do_not_know(spark):
    tables = {"sales": make_sales(spark, SF).limit(0), "ppc": ppc_table(spark, SF)}
    for bad in (
        lambda: tools.call_tool(tables, "get_weather"),
        lambda: tools.call_tool(tables, "get_product_mix", period="YTD"),
        lambda: tools.call_tool(tables, "get_product_mix", days=0),
        lambda: tools.call_tool(tables, "get_product_mix", days="7"),
        lambda: tools.call_tool(tables, "get_product_mix", days=True),
        lambda: tools.call_tool(tables, "get_product_mix", days=7.5),
        lambda: tools.call_tool(tables, "get_product_mix", days=None),
        lambda: tools.call_tool(tables, "get_sales_breakdown", group_by="state"),
        lambda: tools.call_tool(tables, "get_sales_breakdown", metric="acos"),
        lambda: tools.call_tool(tables, "compare_periods", period="LAST_YEAR"),
        lambda: tools.call_tool(tables, "get_keyword_bid_recommendations", target_acos=-0.1),
    ):
        with pytest.raises(ValueError):
            bad()
    assert len(tools.TOOLS) == 13
    assert tools.call_tool(tables, "compare_periods", group_by=None).count() == 7
    assert tools.call_tool(tables, "get_keyword_bid_recommendations", target_acos=1).count() > 0


def test_tools_are_views(spark):
    tables = {"sales": sales_table(spark, SF), "ppc": ppc_table(spark, SF)}
    names = tools.tool_views(tables, "my_", days=30, metric="orders", period="YTD")
    assert names == [f"my_{n}" for n in tools.TOOLS]
    assert spark.sql("SELECT * FROM my_get_metric_trend").first()["metric"] == "orders"
    mine = spark.sql("SELECT type, revenue FROM my_get_product_mix").collect()
    assert sorted(mine) == sorted(sales.mix(tables["sales"], 30).select("type", "revenue").collect())
    assert tools.call_tool(tables, "get_metric_trend", metric="3_pack_share").first()["metric"] == "three_pack_share"
    for n in names:
        spark.catalog.dropTempView(n)
