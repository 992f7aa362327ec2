"""What stored tables and reports leave on disk, and the slices that they are written in."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from tradewind import fixtures, queries, report_queries
from tradewind.operators import prep
from tradewind.plans import report
from tradewind.sources import facts, tables

SF = "/root/testdata/sf0.001"


def shuffled(spark):
    """The shuffle files of this application that are on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def left(spark, before):
    """Shuffle files that came and stay; Spark removes them in a thread of its own."""
    for _ in range(50):
        if not (now := shuffled(spark) - before):
            break
        time.sleep(0.1)
    return now


def same(a, b):
    return a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


@pytest.fixture
def folder(tmp_path):
    """The smallest tables by a path of their own, so that nothing is stored of them yet."""
    os.symlink(SF, tmp_path / "in")
    return f"{tmp_path}/in"


def test_slices_hold_all_rows(spark, tmp_path):
    rows = [(k % 7 or None, dt.date(2024, 1 + k % 3, 1) if k % 5 else None, k) for k in range(200)]
    df = spark.createDataFrame(rows, "order_id int, date date, v int")
    facts.write_facts(df, f"{tmp_path}/facts", key="order_id", slices=4)
    assert same(df, facts.read_facts(spark, f"{tmp_path}/facts"))
    facts.write_facts(df.where("v < 9"), f"{tmp_path}/facts", key="order_id", slices=2)
    assert facts.read_facts(spark, f"{tmp_path}/facts").count() == 9
    assert [facts.slices_for(n) for n in (0, 600_000, 6_000_000, 10**9)] == [1, 1, 6, facts.MOST_SLICES]


def test_written_facts_leave_no_shuffles(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffled(spark), spark.conf.get(name)
    facts.write_facts(fixtures.make_sales(spark, SF), f"{tmp_path}/facts", key="order_id", slices=2)
    assert left(spark, before) == set() and spark.conf.get(name) == was


def test_sales_are_stored_in_slices_of_orders(spark, folder, monkeypatch):
    monkeypatch.setattr(facts, "SLICE_ROWS", 2000)
    seen = []
    monkeypatch.setattr(facts, "sliced", lambda df, key, n, f=facts.sliced: seen.append((key, n)) or f(df, key, n))
    held = fixtures.sales_table(spark, folder)
    assert seen == [("order_id", 3)] and same(fixtures.make_sales(spark, folder), held)
    plan = facts.sliced(fixtures.make_sales(spark, folder), "order_id", 3)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("pmod(xxhash64(") == 2  # line items and orders are both sliced before they meet


def test_reports_leave_no_shuffles(spark, tmp_path):
    held = {"sales": fixtures.sales_table(spark, SF), "ppc": fixtures.ppc_table(spark, SF)}
    before = shuffled(spark)
    report.report_bundle(held, "LAST_30_DAYS", str(tmp_path), names=["color_performance", "top_products", "bid_recommendations"])
    assert left(spark, before) == set()


def test_line_items_are_shuffled_for_parts_and_orders_only(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        lines = fixtures.make_sales(spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set(name, was)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    at = next(k for k, x in enumerate(lines) if "FileScan" in x and "l_orderkey" in x)
    above, k = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < k:
            k = depth(x)
            above.append(x)
    assert sum("Exchange hashpartitioning" in x for x in above) == 2


def test_stored_facts_are_compressed(spark, tmp_path):
    facts.write_facts(fixtures.make_ppc(spark, SF), f"{tmp_path}/facts")
    names = [f for _, _, found in os.walk(f"{tmp_path}/facts") for f in found if f.endswith(".parquet")]
    assert names and all(f.endswith(".zstd.parquet") for f in names)


def test_loaded_exports_are_stored_for_their_reports(spark, folder, monkeypatch):
    """A report reads months of the store, not all exports with their catalogue again."""
    monkeypatch.setattr(facts, "SLICE_ROWS", 2000)
    seen = []
    monkeypatch.setattr(report, "report_bundle", lambda held, *rest, f=report.report_bundle: seen.append(held) or f(held, *rest))
    got = queries.QUERIES["report_bundle"](spark, folder)
    assert got.count() == 4 and {n for n in seen[0] if hasattr(seen[0][n], "latest")} == {"sales", "ppc"}
    plan = report.run_report("sales_breakdown", seen[0])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "PartitionFilters: [isnotnull(date_month" in plan
    assert same(queries._loaded(spark, folder)["sales"].select("order_id", "asin", "date", "pairs_sold"), seen[0]["sales"])


@pytest.fixture
def name(spark):
    yield "held_by_order"
    for t in ("held_by_order", "held_by_order_slices"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_tables_by_key_are_written_in_slices(spark, name, tmp_path, monkeypatch):
    df = spark.range(500).select((F.col("id") % 60).alias("order_id"), (F.col("id") % 3).alias("line"))
    before = shuffled(spark)
    held = tables.save_by_key(df, name, "order_id", 4, f"{tmp_path}/t", slices=3)
    assert left(spark, before) == set() and same(df, held)
    counted = prep.duplicates(held, ["order_id", "line"])
    assert same(prep.duplicates(df, ["order_id", "line"]), counted) and "hashpartitioning" not in counted._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        tables.save_by_key(df, name, "order_id", 4, f"{tmp_path}/t", slices=3)
    assert spark.table(name).count() == 500


def test_half_a_table_by_key_has_no_name(spark, name, tmp_path, monkeypatch):
    df = spark.range(500).select((F.col("id") % 60).alias("order_id"))
    bad = lambda df, key, n: [df.where("order_id < 30"), df.select(F.assert_true(F.col("order_id") < 0).alias("order_id"))]
    with monkeypatch.context() as m:
        m.setattr(tables, "sliced", bad)
        with pytest.raises(Exception):
            tables.save_by_key(df, name, "order_id", 4, f"{tmp_path}/t", slices=2)
    assert not spark.catalog.tableExists(name)
    assert tables.save_by_key(df, name, "order_id", 4, f"{tmp_path}/t", slices=2).count() == 500


def test_sales_by_order_are_written_in_slices(spark, folder, monkeypatch):
    monkeypatch.setattr(facts, "SLICE_ROWS", 2000)
    seen = []
    monkeypatch.setattr(tables, "sliced", lambda df, key, n, f=facts.sliced: seen.append((key, n)) or f(df, key, n))
    totals = queries.QUERIES["order_totals"](spark, folder)
    assert seen == [("order_id", 3)] and "Exchange" not in totals._jdf.queryExecution().executedPlan().toString()
    assert same(prep.order_totals(fixtures.make_sales(spark, folder)), totals)
    report_queries.by_order(spark, folder)
    assert len(seen) == 1
