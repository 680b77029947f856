"""Readers on files with other headers, gaps and faults."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketspark.sources import matrices, stores, tables


def test_csv_directory_reads_each_header(spark, tmp_path):
    (tmp_path / "aa.csv").write_text('Date,CLOSE,open\n2024-01-02,10,9\n2024-01-03,"11",x\n\n')
    (tmp_path / "bb.csv").write_text("﻿收盘,日期,成交量,最高\n5,2024-01-02,7,6\n")
    (tmp_path / "other.txt").write_text("no")
    rows = {(x.instrument, x.date.day): x for x in tables.csv_directory(spark, str(tmp_path)).collect()}
    assert set(rows) == {("AA", 2), ("AA", 3), ("BB", 2)}
    a, bad, b = rows["AA", 2], rows["AA", 3], rows["BB", 2]
    assert (a.open, a.high, a.low, a.close, a.volume) == (9, 10, 10, 10, 1) and abs(a.vwap - 10) < 1e-9
    assert bad.open is None and bad.close == 11
    assert (b.open, b.high, b.low, b.close, b.volume) == (5, 6, 5, 5, 7) and abs(b.vwap - 16 / 3) < 1e-9


def test_missing_columns_are_errors(spark, tmp_path):
    frame = spark.createDataFrame([("2024-01-01", 1.0)], "date string, price double")
    for read in (tables.bars_from_table, tables.feed_bars):
        with pytest.raises(ValueError):
            read(frame)
    for name, text, read in (("a.csv", "code,date\n1,2\n", tables.multi_symbol_csv), ("b.csv", "x\n1\n", tables.industry_map), ("c.csv", "day,flow\n1,2\n", tables.flows_csv)):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            read(spark, str(tmp_path / name))


def test_multi_symbol_csv_keeps_the_last(spark, tmp_path):
    (tmp_path / "x.csv").write_text("code,name,date,open,close,high,low,vol_hand\n1.SZ,n,2024-01-02,1,1,1,1,3\n000001,n,2024-01-02,2,2,2,2,4\n510300,n,2024-01-02,1,1,1,1,bad\n")
    got = {x.instrument: (x.close, x.volume) for x in tables.multi_symbol_csv(spark, str(tmp_path / "x.csv")).collect()}
    assert got == {"000001": (2.0, 400.0), "510300": (1.0, None)}


def test_payloads(spark):
    moment = int(dt.datetime(2024, 1, 3, 4, 30, tzinfo=dt.UTC).timestamp())  # the second of January in New York
    good = f'{{"status":"OK","results":[{{"t":{moment * 1000},"o":1,"h":2,"l":0.5,"c":1.5,"v":9}},{{"t":{moment * 1000 + 1},"o":2,"h":2,"l":2,"c":2,"v":9}},{{"t":{(moment + 86400) * 1000},"o":1,"c":null}}]}}'
    rows = spark.createDataFrame([("a", good), ("b", '{"status":"ERROR","results":[{"t":1,"c":1}]}'), ("c", "no json"), ("d", None)], "instrument string, payload string")
    assert [(x.instrument, x.date, x.close) for x in tables.aggregates_json(rows).collect()] == [("a", dt.date(2024, 1, 2), 2.0)]
    assert tables.aggregates_json(rows, "2024-01-03").count() == 0 and tables.aggregates_json(rows, end="2024-01-02").count() == 0
    candles = spark.createDataFrame([("a", f'{{"s":"ok","t":[{moment},{moment + 86400}],"o":[1,2],"h":[1,2],"l":[1,2],"c":[1,null],"v":[5,6]}}'), ("b", '{"s":"no_data"}')], "instrument string, payload string")
    assert [(x.date.day, x.close, x.volume) for x in tables.candles_json(candles).collect()] == [(2, 1.0, 5.0)]


def test_monthly_section_stops_at_the_first_break(spark, tmp_path):
    (tmp_path / "f.csv").write_text("text 202001, 1\n\n,Mkt-RF,SMB\n202001, 1.5,-99.99\n202002,-999,2\n\n2020,9,9\n202101,7,7\n")
    (tmp_path / "none.csv").write_text("202001,1,2\n")
    got = sorted((x.date.month, x.factor, x.value) for x in tables.monthly_section(spark, str(tmp_path)).collect())
    assert got == [(1, "Mkt-RF", 1.5), (1, "SMB", None), (2, "Mkt-RF", None), (2, "SMB", 2.0)]


def test_symbols_and_members(spark):
    rows = spark.createDataFrame([("600000.sh",), ("1",), (" 1.sz ",), ("510300",), ("000300",)], "code string")
    assert [x[0] for x in rows.select(tables.canonical_symbol(rows.code)).collect()] == ["600000.SS", "000001.SZ", "000001.SZ", "510300.SS", "000300.SZ"]
    assert {x.code for x in tables.constituents(rows).collect()} == {"600000", "000001", "510300"}


def test_store_replaces_only_what_is_brought(spark, tmp_path):
    path, kind = f"{tmp_path}/bars", "instrument string, date string, close double"
    bars = lambda *rows: spark.createDataFrame(list(rows), kind).selectExpr("instrument", "to_date(date) date", "close")
    stores.put_bars(bars(("a", "2024-01-01", 1.0), ("b", "2024-01-01", 2.0)), path)
    stores.put_bars(bars(("a", "2024-01-02", 3.0)), path)
    assert sorted((x.instrument, x.close) for x in stores.get_bars(spark, path).collect()) == [("a", 3.0), ("b", 2.0)]
    one = stores.get_bars(spark, path, ["b"], "2024-01-01", "2024-01-01", ["close"])
    assert one.columns == ["instrument", "date", "close"] and one.count() == 1
    assert stores.changed(stores.manifest(bars(("a", "2024-01-01", 1.0)).withColumns({c: one.close for c in ()}).selectExpr("*", "1d open", "1d high", "1d low", "1d volume")), stores.manifest(bars(("a", "2024-01-01", 1.0)).selectExpr("*", "1d open", "1d high", "1d low", "1d volume"))).count() == 0


def test_trace_skips_bad_lines(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"t":1,"x":"a"}\nbroken\n{"t":3,"x":"c"}\n{"t":2,"x":"b"}\n')
    assert [x.x for x in stores.trace_tail(spark, str(tmp_path / "t.json"), "t long, x string", "t", 2).collect()] == ["c", "b"]
    rows = spark.createDataFrame([("a", 0.12345, None)], "alpha_id string, ic_mean double, ic_ir double")
    assert tuple(stores.report_rows(rows).first()) == ("a", "0.1235", "-") or tuple(stores.report_rows(rows).first()) == ("a", "0.1234", "-")


def test_csv_directory_of_a_hundred_columns_in_many_splits(spark, tmp_path):
    names = [f"c{i}" for i in range(98)]
    with open(tmp_path / "wide.csv", "w") as f:
        f.write(",".join(["Date", *names, "CLOSE"]) + "\r\n")
        for i in range(2000):
            f.write(",".join([str(dt.date(2015, 1, 1) + dt.timedelta(days=i)), *['"a,""b"""'] * 98, str(i)]) + "\r\n")
    (tmp_path / "b.csv").write_text("close,date\n3,2020-01-01\n4,2020-01-02")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = tables.csv_directory(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5 or rows.where("instrument = 'WIDE'").select(F.spark_partition_id()).distinct().count() > 1
        got = {x.date: x.close for x in rows.where("instrument = 'WIDE'").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {dt.date(2015, 1, 1) + dt.timedelta(days=i): float(i) for i in range(2000)}
    assert sorted(x.close for x in rows.where("instrument = 'B'").collect()) == [3.0, 4.0]


@pytest.mark.parametrize("text", ["date,price\n2024-01-02,1\n", "close,open\n1,2\n", "2024-01-02,1\n"])
def test_csv_directory_without_date_or_close_is_an_error(spark, tmp_path, text):
    (tmp_path / "good.csv").write_text("date,close\n2024-01-02,1\n")
    (tmp_path / "bad.csv").write_text(text)
    with pytest.raises(ValueError, match="bad.csv"):
        tables.csv_directory(spark, str(tmp_path))


def test_monthly_section_of_many_factors_in_many_splits(spark, tmp_path):
    names = ["Mkt-RF", "SMB", *(f"f{i}" for i in range(98))]
    months = [f"{1900 + i // 12}{i % 12 + 1:02d}" for i in range(600)]
    (tmp_path / "f.csv").write_text("preface 190001,\n" * 50 + "," + ",".join(names) + "\n" + "".join(m + "," + ",".join(str(k) for k in range(100)) + "\n" for m in months) + "\nyearly\n190001,9\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = tables.monthly_section(spark, str(tmp_path)).groupBy("factor").agg(F.count("*").alias("n"), F.min("value").alias("v")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {x.factor: (x.n, x.v) for x in got} == {n: (600, float(i)) for i, n in enumerate(names)}


def test_matrices_are_flattened_and_checked(spark, tmp_path):
    panel = spark.createDataFrame([("2024-01-02", "a"), ("2024-01-03", "a"), ("2024-01-02", "b")], "date string, instrument string").selectExpr("to_date(date) date", "instrument")
    one = spark.sql("select timestamp '2024-01-02 00:00:00' as datetime, 'a' as instrument, named_struct('KMID', 1.5d, 'x y', '7') as feature, named_struct('LABEL0', 9d) as label, 3 as Label_1")
    two = spark.sql("select timestamp '2024-01-03 00:00:00' as datetime, i as instrument, named_struct('KMID', 2.5d, 'ROC.5', 4f) as feature from values ('a'), ('zz') as t(i)")
    late = spark.sql("select timestamp '2030-01-03 00:00:00' as datetime, 'a' as instrument, named_struct('KMID', 0d) as feature")
    for i, part in enumerate((one, two, late)):
        part.write.parquet(f"{tmp_path}/m/part={i}")
    got = matrices.read_matrix(spark, f"{tmp_path}/m/*", panel).orderBy("date")
    assert got.columns == ["date", "instrument", "KMID", "ROC.5", "x y"]
    assert [tuple(r) for r in got.collect()] == [(dt.date(2024, 1, 2), "a", 1.5, None, 7.0), (dt.date(2024, 1, 3), "a", 2.5, 4.0, None)]
    with pytest.raises(ValueError, match="one of"):
        matrices.flat(one.drop("instrument"))
    with pytest.raises(ValueError, match="one name"):
        matrices.flat(spark.sql("select date '2024-01-01' as date, 'a' as asset, named_struct('f', 1) as p, named_struct('f', 2) as q"))
    one.union(one).write.parquet(f"{tmp_path}/twice")
    with pytest.raises(ValueError, match="repeated"):
        matrices.read_matrix(spark, f"{tmp_path}/twice", panel)
    assert [r.fault for r in matrices.key_faults(matrices.flat(one.withColumn("instrument", F.lit(None).cast("string")))).collect()] == ["missing"]


def test_library_keeps_the_newest_record_of_an_alpha(spark, tmp_path):
    def rows(*x):
        return spark.createDataFrame(list(x), "alpha_id string, at int, ic double")

    stores.add_records(rows(("a", 1, 0.1), ("b", 5, 0.5)), f"{tmp_path}/lib", 0)
    stores.add_records(rows(("a", 2, None), ("b", 4, 0.4), ("c", 1, 0.3)), f"{tmp_path}/lib", 1)
    got = stores.add_records(rows(("a", 9, 9.0)), f"{tmp_path}/lib", 1)  # the round was there already
    assert sorted(map(tuple, got.collect())) == [("a", 2, None), ("b", 5, 0.5), ("c", 1, 0.3)]
    stores.write_records(got, f"{tmp_path}/json")
    lines = [x for p in sorted((tmp_path / "json").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"alpha_id":"a","at":2,"ic":null}', '{"alpha_id":"b","at":5,"ic":0.5}', '{"alpha_id":"c","at":1,"ic":0.3}']


def test_series_as_csv_with_empty_cells(spark, tmp_path):
    stores.write_csv(spark.createDataFrame([("2024-01-01", 1.5), ("2024-02-01", None)], "date string, value double").coalesce(1), f"{tmp_path}/csv")
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert text == "date,value\n2024-01-01,1.5\n2024-02-01,\n"
