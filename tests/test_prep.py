import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradewind.functions import columns as C
from tradewind.functions import periods as P
from tradewind.operators import prep

D = dt.date


def test_clean_number(spark):
    values = ["$1,234.50", "12%", " 5 ", "", "nan", "None", "abc", None, "-3", "$-1"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(C.clean_number("v")).collect()]
    assert got == [1234.5, 12.0, 5.0, None, None, None, None, None, -3.0, -1.0]
    assert df.limit(2).select(C.clean_number("v", percent=True)).collect()[1][0] == 0.12


def test_ratios_and_sums_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 0.0, None), (1.0, 2.0, None), (None, 2.0, None), (1.0, None, None)], "a double, b double, c double")
    assert [tuple(r) for r in df.select(C.ratio(F.col("a"), F.col("b")), C.ratio0(F.col("a"), F.col("b"))).collect()] == [(None, 0.0), (0.5, 0.5), (None, None), (None, 0.0)]
    assert df.agg(C.total(F.col("c"))).first()[0] == 0 and df.limit(0).agg(C.total(F.col("a"))).first()[0] == 0
    assert [r[0] for r in df.select(C.pct_change(F.col("a"), F.col("b"))).collect()] == [None, -50.0, None, None]


def test_week_keys(spark):
    days = [D(2024, 2, 25) + dt.timedelta(days=k) for k in range(10)]  # a Sunday first
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", C.week_ending_saturday(F.col("d")), C.week_ending_monday(F.col("d")), C.week_from_monday(F.col("d"))).collect()
    for d, sat, mon, start in rows:
        assert sat.weekday() == 5 and 0 <= (sat - d).days < 7
        assert mon.weekday() == 0 and 0 <= (mon - d).days < 7
        assert start.weekday() == 0 and 0 <= (d - start).days < 7


@pytest.mark.parametrize(
    ("period", "ref", "bounds"),
    [
        ("LAST_7_DAYS", "2024-03-01", ("2024-02-24", "2024-03-01", "2024-02-17", "2024-02-23")),
        ("MTD", "2024-03-31", ("2024-03-01", "2024-03-31", "2024-02-01", "2024-02-29")),
        ("MTD", "2024-02-29", ("2024-02-01", "2024-02-29", "2024-01-01", "2024-01-29")),
        ("YTD", "2024-03-01", ("2024-01-01", "2024-03-01", "2023-01-01", "2023-03-02")),
        ("YTD", "2024-01-01", ("2024-01-01", "2024-01-01", "2023-01-01", "2023-01-01")),
    ],
)
def test_bounds(spark, period, ref, bounds):
    df = spark.createDataFrame([(D(2020, 1, 1),)], "date date")
    got = (*P.period_bounds(df, period, as_of=ref).first(), *P.prior_bounds(df, period, as_of=ref).first())
    assert tuple(map(str, got)) == bounds


def test_periods_of_timestamps(spark):
    df = spark.createDataFrame([(D(2024, 1, k),) for k in range(1, 21)] + [(None,)], "date date")
    assert P.since_timestamp(df, "LAST_7_DAYS", "date").count() == 8
    assert P.in_period(df, "LAST_7_DAYS").count() == 7
    assert P.since_timestamp(df, "anything", "date").count() == 20
    assert P.since_timestamp(df, "MTD", "none").count() == 21
    assert P.since_timestamp(df.where("date is null"), "MTD", "date").count() == 1
    assert P.labelled_days(df, 5).groupBy("slice").count().orderBy("slice").collect() == [("current", 5), ("prior", 5)]
    assert P.between_days(df, None, "2024-01-05").count() == 0
    with pytest.raises(ValueError):
        P.period_bounds(df, "WEEK")


def test_prep_sales(spark):
    raw = [
        ("o1", "2024-01-02T10:00:00+00:00", "a", "P", "Amazon.com", "2", "10.00"), ("o2", "bad", "a", "P", "Amazon.com", "1", "abc"), ("o3", "2024-01-02", "a", "P", "Other", "1", "1"),
        ("o4", "2024-01-02", "a", "P", "Amazon.com", "0", "1"), ("o5", "2024-01-02", "z", "P", "Amazon.com", "1", "1"), ("o6", "2024-01-02", None, "P", "Amazon.com", "1", "1"),
        ("o7", "2024-01-03", "b", "P", "Amazon.com", None, "1"), ("o8", "01/04/2024", "b", "P", "Amazon.com", "3", "9"),
    ]
    orders = spark.createDataFrame(raw, ["Amazon-Order-Id ", "purchase-date", "asin", "product-name", "sales-channel", "quantity", "item-price"])
    items = [("a", "Socks White Large/X-Large", "6-pack"), ("b", "socks white", "odd"), (None, "x", "single"), ("b", None, "3-pack")]
    got = {}
    for r in prep.prep_sales(orders, spark.createDataFrame(items, "asin string, item string, type string"), formats=("MM/dd/yyyy",)).collect():
        got.setdefault(r.order_id, []).append(r)
    assert sorted(got) == ["o1", "o2", "o8"] and len(got["o8"]) == 2
    o1, o2 = got["o1"][0], got["o2"][0]
    assert (o1.color, o1["size"], o1.pack_size, o1.pairs_sold, o1.unit_price, o1.date) == ("White", "Large/X-Large", 6, 12, 5.0, D(2024, 1, 2))
    assert (o2.revenue, o2.date, o2.units_sold_amazon) == (None, None, 1)
    assert {(r.color, r.pack_size, r.date) for r in got["o8"]} == {(None, 1, D(2024, 1, 4)), (None, 3, D(2024, 1, 4))}


def test_prep_business_report(spark):
    df = spark.createDataFrame([("3/1/26", '$1,626.33', "1,085", "5.81%"), ("x", "", "n", None)], ["Date", "Ordered Product Sales", "Sessions - Total", "Order Item Session Percentage"])
    rows = prep.prep_business_report(df).collect()
    assert tuple(rows[0]) == (D(2026, 3, 1), D(2026, 3, 2), 1626.33, 1085.0, 5.81)
    assert tuple(rows[1]) == (None,) * 5
    assert prep.prep_business_report(df, shift=False).first().week == D(2026, 3, 1)


def test_dedupe_is_idempotent_and_total(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "b"), (1, 2, "a"), (None, 1, "n"), (None, 3, "m")], "k int, t int, v string")
    once = prep.dedupe_latest(df, ["k"], "t", ["v"])
    assert sorted(map(str, once.collect())) == sorted(map(str, prep.dedupe_latest(once, ["k"], "t", ["v"]).collect()))
    assert {(r.k, r.v) for r in once.collect()} == {(1, "b"), (None, "m")}
    assert prep.duplicates(once, ["k"]).count() == 0
