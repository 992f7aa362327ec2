from tradewind.sources import tables as T


def test_tables_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    df.write.parquet(f"{tmp_path}/t.parquet")
    assert T.scan_table(spark, "t", str(tmp_path)).count() == 2
    for name in ("orders_now", "orders_clean", "orders_backup"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    T.save_table(df, "orders_now")
    T.save_table(df.limit(1), "orders_clean")
    assert {"orders_now", "orders_clean"} <= set(T.list_tables(spark))
    T.swap_tables(spark, "orders_now", "orders_clean", "orders_backup")
    assert T.scan_table(spark, "orders_now").count() == 1 and T.scan_table(spark, "orders_backup").count() == 2
    for name in ("orders_now", "orders_backup"):
        spark.sql(f"DROP TABLE {name}")
    T.write_records(df, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 2
    path = tmp_path / "report.csv"
    path.write_text('﻿Date,"Ordered Product Sales"\n3/1/26,"$1,626.33"\n')
    assert T.scan_csv_report(spark, str(path)).columns == ["Date", "Ordered Product Sales"]
