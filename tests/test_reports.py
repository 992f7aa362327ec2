import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradewind.operators import ads, forecast, rootcause, sales, trends
from tradewind.plans import report

D = dt.date
SALES = "order_id string, purchase_date timestamp, date date, asin string, item_name string, product_name string, type string, color string, size string, revenue double, units_sold_amazon long, pairs_sold long"


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for k in range(120):
        d = D(2024, 1, 1) + dt.timedelta(days=k)
        if 40 <= k < 55:
            continue
        t = dt.datetime(d.year, d.month, d.day, k % 24)
        rows.append((f"o{k // 2}", t, d, f"a{k % 7}", f"item {k % 7}", f"item {k % 7}", None if k % 11 == 0 else ["single", "3-pack"][k % 2], ["White", "Blue", None][k % 3], "S", float(10 + k % 5), 1 + k % 3, 2 + k % 3))
    rows.append(("late", None, None, "a1", "item 1", "item 1", "single", "White", "S", 99.0, 1, 1))
    return spark.createDataFrame(rows, SALES)


@pytest.fixture(scope="module")
def ppc(spark):
    rows = [(D(2024, 1, 1) + dt.timedelta(days=k), "c", f"k{k % 5}", "exact", f"Term{k % 9}", 10, k % 4, 1.5 * (k % 4), 8.0 * (k % 3), k % 2, k % 2) for k in range(120)]
    return spark.createDataFrame(rows, "date date, campaign string, keyword string, match_type string, search_term string, impressions int, clicks int, spend double, sales double, orders int, units int")


def test_shares_and_contributions(table):
    whole = sales.sales_breakdown(table, "YTD", "type", top_n=100).collect()
    assert abs(sum(r.revenue_pct for r in whole) - 1) < 1e-9 and all(r.type for r in whole)
    drivers = sales.compare_drivers(table, "LAST_7_DAYS", "asin", "pairs_sold", top_n=100, as_of="2024-03-02").collect()
    assert abs(sum(r.contribution_pct for r in drivers) - 100) < 1e-6
    for bad in (lambda: sales.sales_breakdown(table, "YTD", "state"), lambda: sales.sales_breakdown(table, "YTD", "type", "cost"), lambda: sales.sales_summary(table, "X")):
        with pytest.raises(ValueError):
            bad()


def test_one_pass_comparison_equals_outer_join(table):
    got = {r.asin: (r.current, r.prior) for r in sales.compare_drivers(table, "LAST_30_DAYS", "asin", top_n=100).collect()}
    last = D(2024, 4, 29)
    part = lambda a, b: table.where(F.col("date").between(last - dt.timedelta(days=a), last - dt.timedelta(days=b))).groupBy("asin").agg(F.sum("revenue").alias("r"))
    both = part(29, 0).withColumnRenamed("r", "x").join(part(59, 30).withColumnRenamed("r", "y"), "asin", "full_outer").fillna(0)
    assert got == {r.asin: (r.x, r.y) for r in both.collect()}


def test_empty_tables(table, ppc):
    none, no_ads = table.limit(0), ppc.limit(0)
    assert sales.sales_summary(none, "YTD").first().revenue == 0
    assert sales.sales_breakdown(none, "YTD", "type").collect() == []
    assert sales.sales_summary_days(none, 7).first().revenue_change_pct is None
    assert trends.metric_trend_weekly(none, no_ads).collect() == []
    assert trends.metric_trend_summary(trends.metric_trend_weekly(none, no_ads), "revenue").first().direction == "insufficient_data"
    assert ads.top_keywords(no_ads).collect() == []


def test_weeks_without_sales_stay_where_they_should(table, ppc):
    weekly = trends.weekly_sales(table).orderBy("week").collect()
    gaps = [(b.week - a.week).days for a, b in zip(weekly, weekly[1:])]
    assert set(gaps) == {7} and any(r.revenue == 0 for r in weekly)
    trend = trends.revenue_tacos_trend(table, ppc, 20).collect()
    assert all(r.revenue > 0 for r in trend)


@pytest.mark.parametrize(("n", "prior", "direction"), [(3, None, "insufficient_data"), (4, None, "insufficient_data"), (7, 2.0, "improving"), (8, 2.5, "improving"), (12, 6.5, "improving")])
def test_trend_summary(spark, n, prior, direction):
    rows = [(D(2024, 1, 6) + dt.timedelta(days=7 * k), float(k + 1)) for k in range(n)]
    row = trends.metric_trend_summary(spark.createDataFrame(rows, "week date, revenue double"), "revenue").first()
    assert (row.prior_avg, row.direction, row.best_week, row.worst_week) == (prior, direction, rows[-1][0], rows[0][0])


def test_rolling_and_changes(spark):
    rows = [(D(2024, 1, 1) + dt.timedelta(days=7 * k), v, v, v) for k, v in enumerate([4.0, 0.0, 2.0, 6.0, None])]
    df = spark.createDataFrame(rows, "week date, sessions double, conversion_rate double, ordered_product_sales double")
    assert [r[0] for r in trends.rolling_weeks(df, "sessions").orderBy("week").select("rolling_4wk").collect()] == [None, None, None, 3.0, None]
    assert [r[0] for r in trends.wow_change(df).orderBy("week").select("sessions_wow").collect()] == [None, -1.0, None, 2.0, None]


def test_bid_rules(spark):
    last = D(2024, 5, 1)
    cases = [("hold", 5, 1.0, 0.0, 0), ("pause", 25, 5.0, 0.0, 0), ("cut", 12, 20.0, 0.0, 0), ("dear", 30, 50.0, 100.0, 2), ("scale", 20, 5.0, 100.0, 5), ("meh", 20, 5.0, 100.0, 1), ("free", 20, 0.0, 100.0, 5)]
    df = spark.createDataFrame([(last, k, "exact", 100, c, s, v, o, o) for k, c, s, v, o in cases], "date date, keyword string, match_type string, impressions int, clicks int, spend double, sales double, orders int, units int")
    got = {r.keyword: (r.action, r.suggested_cpc) for r in ads.bid_recommendations(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {"hold": "Hold", "pause": "Pause", "cut": "Reduce bid", "dear": "Reduce bid", "scale": "Increase bid", "meh": "Hold", "free": "Hold"} or got["free"][0] == "Increase bid"
    assert got["pause"][1] == 0.0 and abs(got["dear"][1] - 50 / 30 * 0.5) < 1e-9


def test_inventory(spark, table):
    stock = spark.createDataFrame([("a1", 1.0), ("a2", 1e6), ("zz", 5.0), (None, 1.0)], "asin string, available double")
    rows = {r.asin: r for r in ads.inventory_risk(stock, table).collect()}
    assert rows["a1"].risk_level == "Critical" and rows["a2"].risk_level == "Low" and rows["zz"].risk_level == "No recent demand" and rows["zz"].severity == 4 and len(rows) == 3
    assert ads.critical_count(ads.inventory_risk(stock, table)).first()[0] == 1


def test_labels(spark):
    df = spark.createDataFrame([("Brand Socks White 3 pack Small/Medium",), ("x 6-pack BLUE large/x-large -",), (None,), ("Brand -",)], "t string")
    rows = df.select(rootcause.sku_label(F.col("t")), rootcause.clean_product_name(F.col("t"), ["Brand"])).collect()
    assert [tuple(r) for r in rows] == [("3-pack, white, S/M", "Socks White 3 pack Small/Medium"), ("6-pack, blue, L/XL", "x 6-pack BLUE large/x-large"), ("single, unknown, ?", "Product"), ("single, unknown, ?", "Product")]


def test_cash_runs_by_entity(table):
    flow = forecast.cashflow(forecast.scenario_forecast(table, 3, ["asin"]), 100.0, entity=["asin"])
    check = forecast.cash_decision_check(flow, ["asin"]).collect()
    assert len(check) == 7 * 4 and flow.count() == 7 * 4 * 3
    rows = flow.where("asin = 'a1' and scenario = 'base'").orderBy("month").collect()
    assert abs(rows[-1].cash - (100 + sum(r.net for r in rows))) < 1e-6


def test_report_bundle(spark, table, ppc, tmp_path):
    names = ["sales_summary", "marketing_summary"]
    report.report_bundle({"sales": table, "ppc": ppc}, "LAST_7_DAYS", str(tmp_path), names=names)
    assert spark.read.parquet(f"{tmp_path}/period=LAST_7_DAYS/sales_summary").count() == 1
    with pytest.raises(ValueError):
        report.run_report("none", {})


@pytest.mark.parametrize("name", ["sales_breakdown", "compare_periods", "top_keywords", "inventory_risk", "marketing_summary"])
def test_periods_reach_the_scans(spark, name):
    """The days of a period are literals that filter the scan of the facts, and their months choose its parts."""
    from tradewind.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and "date_month" in x]
    assert scans and all("GreaterThanOrEqual(date,2" in x and "(date_month" in x.split("PartitionFilters: ")[1].split("]")[0] for x in scans)


def test_times_in_utc(spark):
    from tradewind.functions.columns import utc_time

    rows = ["2024-03-01T10:00:00+02:00", "2024-03-01 10:00:00", "2024-03-01T10:00:00Z", "2024-03-01T10:00:00-0530", "2024-03-01", "x", None]
    df = spark.createDataFrame([(t,) for t in rows], "t string").select(utc_time(F.col("t")).alias("u"))
    day = dt.datetime(2024, 3, 1)
    assert [r.u for r in df.collect()] == [day.replace(hour=8), day.replace(hour=10), day.replace(hour=10), day.replace(hour=15, minute=30), day, None, None]
