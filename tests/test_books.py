"""Lots, costs, marks, actions and audits against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketspark.operators import desk as K
from marketspark.operators import records as C


def trades(r, n=300):
    rows = []
    for i in range(n):
        rows.append((r.choice("ab"), r.choice("xyz"), i, dt.date(2020, 1, 1) + dt.timedelta(days=i // 5), r.choice(["buy", "buy", "sell"]), float(r.randint(1, 9)), round(r.uniform(1, 5), 2), 0.1))
    return rows


SCHEMA = "book string, symbol string, at long, date date, side string, quantity double, price double, fee double"


@pytest.fixture(scope="module")
def made(spark):
    rows = trades(random.Random(1))
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_fifo_equals_a_queue_and_needs_no_join(spark, made):
    rows, table = made
    want = []
    for key in {x[:2] for x in rows}:
        mine = [x for x in rows if x[:2] == key]
        buys, sells = ([[x[2], x[5], x[6]] for x in mine if x[4] == s] for s in ("buy", "sell"))
        while buys and sells:
            q = min(buys[0][1], sells[0][1])
            want.append((*key, buys[0][0], sells[0][0], q))
            for side in (buys, sells):
                side[0][1] -= q
                if not side[0][1]:
                    side.pop(0)
    got = C.fifo_matches(table)
    assert sorted((x.book, x.symbol, x.bought_at, x.sold_at, x.quantity) for x in got.collect()) == sorted(want)
    assert "Join" not in spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")


def test_average_cost_equals_a_loop(made):
    rows, table = made
    got = {(x.book, x.symbol): x for x in K.average_cost(table.withColumnRenamed("at", "seq")).collect()}
    for key in {x[:2] for x in rows}:
        held = cost = 0.0
        for *_, side, q, price, _ in [x for x in rows if x[:2] == key]:
            signed = -q if side == "sell" else q
            after = held + signed
            if held == 0 or held * after < 0:
                cost = price
            elif held * signed > 0:
                cost = (held * cost + signed * price) / after
            held = after
        assert got[key].holding == held and abs(got[key].cost - (cost if held else 0.0)) < 1e-9


def test_sellable_lots(spark):
    day = dt.date(2020, 1, 1)
    rows = [("a", "x", i, day + dt.timedelta(days=i), s, float(q), 1.0, 0.0) for i, (s, q) in enumerate([("buy", 5), ("buy", 4), ("sell", 6), ("buy", 2)])]
    lots = C.lots(spark.createDataFrame(rows, SCHEMA))
    assert [(x.at, x.remaining) for x in lots.orderBy("at").collect()] == [(0, 0), (1, 3), (3, 2)]
    today = F.lit(day + dt.timedelta(days=3))
    assert [tuple(x)[2:] for x in C.sellable(lots, today, 1).collect()] == [(5, 3)]
    assert [tuple(x)[2:] for x in C.sellable(lots, today, 0).collect()] == [(5, 5)]


def test_closed_sessions_around_the_close(spark):
    bars = spark.createDataFrame([(dt.date(2024, 3, d),) for d in range(1, 13)], "date date")
    # the clocks of New York go forward on the tenth of March
    for now, zone, hour, last in (("2024-03-08 21:04:00", "America/New_York", 16, 7), ("2024-03-08 21:05:00", "America/New_York", 16, 8), ("2024-03-11 20:05:00", "America/New_York", 16, 11), ("2024-03-11 07:04:00", "Asia/Shanghai", 15, 10), ("2024-03-11 07:05:00", "Asia/Shanghai", 15, 11)):
        assert K.closed_sessions(bars, F.lit(now).cast("timestamp_ntz"), zone, hour).agg(F.max("date")).first()[0].day == last


def test_close_before_or_after(spark):
    day = dt.date(2024, 1, 5)
    bars = spark.createDataFrame([("a", dt.date(2024, 1, 4), 1.0), ("a", day, 2.0), ("b", day, 3.0), ("b", dt.date(2024, 1, 9), 4.0), ("c", day, None)], "instrument string, date date, close double")
    assert {x.instrument: x.close for x in K.close_before(bars, F.lit(day)).collect()} == {"a": 1.0, "b": 3.0}


def test_nominal_prices_and_back(spark):
    rows = [("a", dt.date(2024, 1, d), 10.0, 12.0, 9.0, 11.0, 100.0, 2.0 if d == 3 else None) for d in range(1, 6)]
    bars = spark.createDataFrame(rows, "instrument string, date date, open double, high double, low double, close double, volume double, split double")
    nominal = C.nominal_prices(bars)
    assert [x.close for x in nominal.orderBy("date").collect()] == [22.0, 22.0, 11.0, 11.0, 11.0]
    events = bars.where("split is not null").select("instrument", "date", F.col("split").alias("ratio"))
    back = C.from_nominal(nominal.drop("split", "factor"), events)
    assert [(x.close, x.volume, x.adj_close) for x in back.orderBy("date").collect()] == [(11.0, 100.0, 11.0)] * 5
    # the split explains the gap, so nothing is reported; without it, it is
    clean = C.contract_issues(bars.withColumn("dividend", F.lit(0.0)))
    assert clean.count() == 0
    raw = nominal.drop("factor").withColumns({"split": F.lit(None).cast("double"), "dividend": F.lit(0.0)})
    assert [x.reason for x in C.contract_issues(raw).collect()] == ["opening gap"] and C.contract_issues(raw, gaps=False).count() == 0


def test_quality_of_broken_bars(spark):
    rows = [("a", dt.date(2024, 1, 1), 10.0, 9.0, 8.0, 10.0), ("a", dt.date(2024, 1, 2), 10.0, 11.0, 9.0, float("nan")), ("a", dt.date(2024, 1, 3), 10.0, 11.0, 9.0, None), ("a", dt.date(2024, 1, 4), -1.0, 11.0, 9.0, 10.0), ("b", dt.date(2024, 1, 1), 1.0, 1.0, 1.0, 1.0), ("b", dt.date(2024, 1, 1), 1.0, 1.0, 1.0, 1.0)]
    bars = spark.createDataFrame(rows, "instrument string, date date, open double, high double, low double, close double").withColumns({"volume": F.lit(1.0), "split": F.lit(None).cast("double"), "dividend": F.lit(None).cast("double")})
    got = sorted((x.instrument, x.date.day, x.reason) for x in C.contract_issues(bars, gaps=False).collect())
    assert got == [("a", 1, "envelope"), ("a", 2, "invalid"), ("a", 3, "invalid"), ("a", 4, "invalid"), ("b", 1, "duplicate"), ("b", 1, "duplicate")]


def test_reconciliation_finds_each_kind_of_fault(spark):
    t = spark.createDataFrame([("a", dt.date(2024, 1, 1), "x", "buy", 2.0, 10.0, 1.0), ("a", dt.date(2024, 1, 3), "x", "sell", 1.0, 12.0, 1.0)], "book string, day date, symbol string, side string, quantity double, price double, fee double")
    right = [("a", dt.date(2024, 1, 1), 79.0, 1.0, 1, {"x": 2.0}, {"x": 10.0}, 99.0, -0.01), ("a", dt.date(2024, 1, 2), 79.0, 0.0, 0, {"x": 2.0}, {"x": 11.0}, 101.0, 0.0), ("a", dt.date(2024, 1, 3), 90.0, 1.0, 1, {"x": 1.0}, {"x": 12.0}, 102.0, 0.0)]
    schema = "book string, day date, cash double, fees double, fills int, positions map<string,double>, closes map<string,double>, equity double, drawdown double"
    found = lambda rows: sorted((x.day.day, x.field) for x in K.reconciled(spark.createDataFrame(rows, schema), t, F.lit(100.0)).collect())
    assert found(right) == []
    wrong = [list(x) for x in right]
    wrong[1][2], wrong[2][4], wrong[2][5] = 80.0, 2, {"x": 3.0}
    assert found([tuple(x) for x in wrong]) == [(2, "cash"), (3, "fills"), (3, "position x")]


def test_reconciliation_reads_its_trades_once(spark):
    from marketspark.plans import registry

    found = registry.queries()["ledger_reconciled"](spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and not [f for f in found.inputFiles() if "lineitem" in f]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    t = spark.createDataFrame([("a", dt.date(2024, 1, 1), "x", "buy", 2.0, 10.0, 1.0), ("a", dt.date(2024, 1, 1), "y", "buy", 1.0, 5.0, 1.0)] * 50, "book string, day date, symbol string, side string, quantity double, price double, fee double")
    days = spark.createDataFrame([("a", dt.date(2024, 1, 1), -1250.0, 100.0, 100, {"x": 100.0, "y": 50.0}, {"x": 10.0, "y": 5.0}, 0.0, -1.0)], "book string, day date, cash double, fees double, fills int, positions map<string,double>, closes map<string,double>, equity double, drawdown double")
    assert K.reconciled(days, t.mapInArrow(counted, t.schema), F.lit(100.0)).collect() == [] and seen.value == 100


def test_marks_are_stale_without_volume_or_today(spark):
    day = dt.date(2024, 1, 5)
    bars = spark.createDataFrame([("x", day, 2.0, 5.0), ("y", day, 2.0, 0.0), ("z", dt.date(2024, 1, 4), 3.0, 5.0), ("x", dt.date(2024, 1, 8), 9.0, 1.0)], "symbol string, date date, close double, volume double")
    held = spark.createDataFrame([("a", s, 10) for s in "xyzu"], "book string, symbol string, quantity long")
    assert {x.symbol: (x.value, x.stale) for x in K.marked_positions(held, bars, F.lit(day)).collect()} == {"x": (20.0, False), "y": (20.0, True), "z": (30.0, True), "u": (None, True)}


def test_order_checks_one_by_one(spark):
    D = "2024-01-"
    bars = spark.createDataFrame([("a", D + "02", 10.0, 1000.0), ("a", D + "03", 10.5, 2000.0), ("a", D + "04", 12.6, 500.0), ("b", D + "02", 1.0, 1e6)], "symbol string, date string, close double, volume double").withColumn("date", F.to_date("date"))
    rules = spark.createDataFrame([("cn", "equity", 5, 0.195), ("us", "equity", 1, None)], "venue string, kind string, lot int, limit double")
    rows = [
        (1, "us", "a", "option", D + "03", "buy", 1.0, 0.0), (2, "cn", "a", "equity", D + "03", "buy", 7.0, 0.0), (3, "cn", "a", "equity", D + "03", "sell", 7.0, 7.0), (4, "cn", "a", "equity", D + "01", "buy", 5.0, 0.0),
        (5, "us", "b", "equity", D + "10", "buy", 5.0, 0.0), (6, "us", "b", "equity", D + "09", "buy", 5.0, 0.0), (7, "cn", "a", "equity", D + "04", "buy", 5.0, 0.0), (8, "us", "a", "equity", D + "04", "buy", 15.0, None),
        (9, "us", "a", "equity", D + "04", "buy", 15.0, 0.0), (10, "us", "a", "equity", D + "04", "buy", 15.0, 0.0), (11, "us", "a", "equity", D + "05", "buy", 15.0, 0.0), (12, "us", "zz", "equity", D + "05", "buy", 1.0, 0.0),
    ]
    orders = spark.createDataFrame(rows, "at int, venue string, symbol string, kind string, date string, side string, quantity double, held double").withColumn("date", F.to_date("date"))
    got = {x["at"]: (x.reason, x.filled) for x in K.order_checks(orders, bars, rules).collect()}
    assert got == {
        1: ("class", 0), 2: ("board lot", 0), 3: ("ok", 7), 4: ("no quote", 0), 5: ("stale quote", 0), 6: ("ok", 5), 7: ("limit move", 0), 8: ("ok", 15),
        9: ("ok", 5), 10: ("volume cap", 0), 11: ("ok", 5), 12: ("no quote", 0),
    }


def test_standard_expiries(spark):
    from marketspark.operators import options

    days = ["2024-01-05", "2024-02-16", "2024-03-15", "2024-06-21", "2024-09-20"]
    row = spark.createDataFrame([(days, "2024-01-01")], "e array<string>, d string").select(F.transform("e", lambda x: F.to_date(x)).alias("e"), F.to_date("d").alias("d"))
    pick = lambda *a: str(row.select(options.standard_expiry(F.col("e"), F.col("d"), *a)).first()[0])
    assert pick() == "2024-02-16" and pick(21, 90, True) == "2024-03-15"
    assert pick(100, 120) == "2024-06-21" and pick(100, 120, True) == "2024-09-20" and pick(300) == "None"
