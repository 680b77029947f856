"""Lines that are cut into slices give what whole lines give, in several tasks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketspark.operators import desk as K
from marketspark.operators import panel as P
from marketspark.operators import portfolio as R
from marketspark.operators import records as C
from marketspark.operators.scan import Run, scanned, sliced


@pytest.fixture(scope="module")
def trades(spark):
    """Of 6,000 trades a third are of one line."""
    r = random.Random(2)
    rows = []
    for i in range(6000):
        symbol = "hot" if i % 3 == 0 else f"s{r.randrange(40)}"
        rows.append(("b", symbol, i, r.choice(["buy", "buy", "sell"]), float(r.randint(1, 9)), float(r.randint(10, 99)), r.choice([None, float(i)])))
    rows += [(None, None, 7000 + i, "buy", 1.0, 1.0, None) for i in range(3)]
    return spark.createDataFrame(rows, "book string, symbol string, at int, side string, quantity double, price double, mark double").repartition(7).cache()


@pytest.fixture(scope="module")
def runs(spark):
    return {
        "total": Run("sum", F.col("quantity")), "rest": Run("sum", F.col("mark"), reverse=True, inclusive=False), "top": Run("max", F.col("price"), inclusive=False),
        "known": Run("last", F.col("mark")), "next": Run("last", F.when(F.col("side") == "sell", F.struct("at", "price")), reverse=True),
    }


def test_runs_in_slices_equal_windows(trades, runs):
    got = scanned(trades, ["book", "symbol"], ["at"], runs, long=300)
    whole = scanned(trades, ["book", "symbol"], ["at"], runs)
    up = Window.partitionBy("book", "symbol").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    assert got.columns == [*trades.columns, *runs] and got.count() == trades.count()
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    assert whole.withColumn("want", F.sum("quantity").over(up)).where("total <> want").count() == 0


def test_a_hot_line_is_spread_over_tasks(spark, trades, runs):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scanned(trades, ["book", "symbol"], ["at"], runs, long=300).where("symbol = 'hot'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.sum("total")).collect()
        one = scanned(trades, ["book", "symbol"], ["at"], runs).where("symbol = 'hot'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.sum("total")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(one) == 1 and len(got) == 4 and max(x["count"] for x in got) < 1000  # all four partitions of the test session


def test_slices_grow_with_time_and_short_lines_have_one(trades):
    cut_up = sliced(trades, ["book", "symbol"], "at", 300)
    w = Window.partitionBy("book", "symbol").orderBy("at")
    assert cut_up.withColumn("before", F.lag("_slice").over(w)).where("_slice < before").count() == 0
    assert cut_up.where("symbol = 'hot'").select("_slice").distinct().count() > 30
    assert cut_up.where("symbol is null or symbol <> 'hot'").where("_slice <> 0").count() == 0
    assert sliced(trades, ["book", "symbol"], "at") is None


def _same(a, b):
    a, b = sorted(map(str, a.collect())), sorted(map(str, b.collect()))
    assert a and a == b


def test_ledgers_in_slices_equal_whole_ones(trades):
    known = trades.where("symbol is not null")
    _same(C.fifo_matches(known, 300), C.fifo_matches(known))
    _same(C.lots(known, 300), C.lots(known))
    rounded = lambda d: d.select("book", "symbol", "holding", F.round("cost", 6))
    costs = known.withColumnRenamed("at", "seq")
    _same(rounded(K.average_cost(costs, 300)), rounded(K.average_cost(costs)))
    # a line that never closes: its cost goes through all slices
    buys = costs.where("side = 'buy' or symbol <> 'hot'")
    got = {x.symbol: x for x in K.average_cost(buys, 300).collect()}["hot"]
    want = buys.where("symbol = 'hot'").agg(F.sum("quantity"), F.sum(F.col("price") * F.col("quantity")) / F.sum("quantity")).first()
    assert (got.holding, got.cost) == pytest.approx(tuple(want))


def test_asof_and_performance_in_slices(spark, trades):
    asked = trades.select("symbol", F.col("at").alias("t"), "price")
    marks = trades.where("mark is not null").select("symbol", (F.col("at") + 1).alias("t"), "mark")
    _same(P.asof(asked, marks, "symbol", "t", "mark", 300), P.asof(asked, marks, "symbol", "t", "mark"))
    days = trades.select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("at")).alias("date"), "symbol", F.col("mark").alias("close"))
    _same(P.carried(days.where("close is not null"), days.where("day(date) < 4"), "symbol", "close", 300), P.carried(days.where("close is not null"), days.where("day(date) < 4"), "symbol", "close"))
    curve = days.where("symbol is not null").select("symbol", "date", ((F.hash("date") % 100) / 2000).alias("net_return"))
    even = lambda d: d.select("symbol", "sessions", *[F.round(c, 8) for c in ("net_return", "sharpe", "max_drawdown")])
    _same(even(R.performance(curve, "symbol", long=300)), even(R.performance(curve, "symbol")))
    lost = curve.withColumn("net_return", F.when(F.col("date") == "2008-03-30", -1.5).otherwise(F.col("net_return")))
    got = {x.symbol: x.net_return for x in R.performance(lost, "symbol", long=300).collect()}
    assert sum(v == -1 for v in got.values()) == 1
