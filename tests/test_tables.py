import uuid

import pytest
from pyspark.sql import functions as F

from tradewind.operators import prep
from tradewind.sources import tables as T


@pytest.fixture
def name(spark):
    name = f"t{uuid.uuid4().hex[:12]}"
    yield name
    for t in spark.catalog.listTables():
        if t.name.startswith(name):
            spark.sql(f"DROP {'VIEW' if t.tableType == 'VIEW' else 'TABLE'} IF EXISTS {t.name}")


def ids(spark, name):
    return sorted(r[0] for r in spark.table(name).collect())


def test_publish_and_restore(spark, name, tmp_path):
    put = lambda n: T.publish(spark.range(n), name, str(tmp_path))
    assert put(1) == f"{name}_v1" and ids(spark, name) == [0]
    with pytest.raises(ValueError):
        T.restore_backup(spark, name)
    put(2)
    assert ids(spark, name) == [0, 1] and ids(spark, f"{name}_backup") == [0]
    put(3)
    assert ids(spark, name) == [0, 1, 2] and ids(spark, f"{name}_backup") == [0, 1]
    assert [t for t in T.list_tables(spark) if t.startswith(f"{name}_v")] == [f"{name}_v2", f"{name}_v3"]
    T.restore_backup(spark, name)
    assert ids(spark, name) == [0, 1] and ids(spark, f"{name}_backup") == [0, 1, 2]
    T.publish(spark.table(name).where("id > 0"), name, str(tmp_path))  # made of what it replaces
    assert ids(spark, name) == [1] and ids(spark, f"{name}_backup") == [0, 1]


@pytest.mark.parametrize("step", ["save", "backup", "view"])
def test_a_job_that_ends_half_way_leaves_a_readable_table(spark, name, tmp_path, monkeypatch, step):
    T.publish(spark.range(1), name, str(tmp_path))
    T.publish(spark.range(2), name, str(tmp_path))

    class Ended(Exception):
        pass

    save, point = T.save_table, T._point

    def half(df, *rest):
        save(df, *rest)
        raise Ended

    def points(spark, view, table):
        if (step == "backup") == view.endswith("_backup"):
            raise Ended
        point(spark, view, table)

    monkeypatch.setattr(*((T, "save_table", half) if step == "save" else (T, "_point", points)))
    with pytest.raises(Ended):
        T.publish(spark.range(3), name, str(tmp_path))
    assert ids(spark, name) == [0, 1] and spark.table(f"{name}_backup").count() in (1, 2)
    monkeypatch.undo()
    assert T.repair(spark, name) == ([f"{name}_v1", f"{name}_v3"] if step == "view" else [f"{name}_v3"])
    assert T.repair(spark, name) == [] and ids(spark, name) == [0, 1]
    T.publish(spark.range(4), name, str(tmp_path))
    assert len(ids(spark, name)) == 4 and len(ids(spark, f"{name}_backup")) == 2


def test_no_shuffle_of_tables_by_key(spark, name, tmp_path):
    df = spark.range(200).select((F.col("id") % 50).alias("order_id"), (F.col("id") % 3).alias("line"), F.col("id").alias("at"), *(F.lit(1).alias(c) for c in ("revenue", "units_sold_amazon", "pairs_sold")), F.current_date().alias("date"))
    held = T.save_by_key(df, name, "order_id", 4, f"{tmp_path}/t")
    results = [prep.dedupe_latest(held, ["order_id", "line"], "at", ["revenue"]), prep.duplicates(held, ["order_id", "line"]), prep.order_totals(held), prep.dedupe_check(held, ["order_id", "line"], "at", ["revenue"])]
    plain = [prep.dedupe_latest(df, ["order_id", "line"], "at", ["revenue"]), prep.duplicates(df, ["order_id", "line"]), prep.order_totals(df), prep.dedupe_check(df, ["order_id", "line"], "at", ["revenue"])]
    for mine, other in zip(results, plain, strict=True):
        assert sorted(map(str, mine.collect())) == sorted(map(str, other.collect()))
        plan = mine._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Bucketed: true" in plan
    assert all("Exchange" not in r._jdf.queryExecution().executedPlan().toString() for r in (results[0], results[2]))


URL = "jdbc:derby:memory:shop;create=true"


@pytest.fixture(scope="module")
def jdbc(spark):
    options = {"url": URL, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(100).select(F.when(F.col("id") > 2, F.col("id")).alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"), (F.col("id") % 7).alias("v"))
    rows.write.format("jdbc").options(dbtable="orders", **options).mode("overwrite").save()
    spark.range(1).limit(0).toDF("k").write.format("jdbc").options(dbtable="nothing", **options).mode("overwrite").save()
    return options


@pytest.mark.parametrize("split", [T.Split("k", 4), T.Split("k", 4, 20, 30), T.Split("d", 3), T.Split("d", 3, "2024-01-10", "2024-02-01")])
def test_a_database_is_read_in_parts(spark, jdbc, split):
    df = T.scan_table(spark, "orders", jdbc=jdbc, split=split)
    assert df.rdd.getNumPartitions() == split.parts
    assert df.count() == 100 and df.where("k is null").count() == 3
    some = df.where("v = 3 and d < '2024-02-01'").select("k")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(V,3)" in plan.replace("v", "V") and "ReadSchema: struct<k:" in plan.lower().replace("readschema", "ReadSchema")
    assert sorted(r[0] for r in some.collect()) == [3, 10, 17, 24]


def test_a_database_read_whole(spark, jdbc):
    assert T.scan_table(spark, "orders", jdbc=jdbc).rdd.getNumPartitions() == 1
    assert T.scan_table(spark, "nothing", jdbc=jdbc, split=T.Split("k", 4)).collect() == []
    assert T.scan_table(spark, "orders", jdbc=jdbc, split=T.Split("k", 1)).count() == 100


def test_records(spark):
    df = spark.range(5).select("id", F.struct(F.lit("x").alias("a"), F.array(F.struct(F.col("id").alias("n"))).alias("b")).alias("s"))
    assert list(T.records(df, 5)) == [{"id": k, "s": {"a": "x", "b": [{"n": k}]}} for k in range(5)]
    with pytest.raises(T.TooManyRecords):
        T.records(df, 4)
    assert list(T.records(df.limit(0), 1)) == []
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty() or not df.limit(5).is_cached
    rest = T.records(spark.range(1000), 1000)
    assert next(rest) == {"id": 0}
    rest.close()
