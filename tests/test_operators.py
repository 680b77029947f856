"""Operators on small hand-made frames."""

import datetime as dt

from pyspark.sql import functions as F

from marketspark.operators import evaluation as E
from marketspark.operators import panel as P
from marketspark.operators import portfolio as R
from marketspark.operators import records as C

D = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(10)]


def test_missing_sessions_are_rows_and_returns_do_not_bridge_them(spark):
    bars = spark.createDataFrame([("a", D[0], 10.0), ("a", D[2], 12.0), ("b", D[0], 1.0), ("b", D[1], 2.0), ("b", D[2], 3.0)], "instrument string, date date, close double")
    got = {(x.instrument, x.date): x.returns for x in P.add_returns(P.dense(bars)).collect()}
    assert len(got) == 6 and got["a", D[2]] is None and got["b", D[1]] == 1.0


def test_upsert_keeps_the_incoming_row(spark):
    old = spark.createDataFrame([("a", D[0], 1.0), ("a", D[1], 1.0)], "instrument string, date date, close double")
    new = spark.createDataFrame([("a", D[1], 2.0), ("a", D[2], 2.0)], "instrument string, date date, close double")
    assert sorted((x.date, x.close) for x in P.upsert(old, new).collect()) == [(D[0], 1.0), (D[1], 2.0), (D[2], 2.0)]


def test_quantiles_with_equal_edges(spark):
    rows = spark.createDataFrame([(1, float(v)) for v in (1, 1, 1, 2, 3)] + [(2, 5.0), (2, 5.0)], "k int, x double")
    got = rows.withColumn("q", E.quantile_labels(F.col("x"), ["k"], 5)).collect()
    assert sorted((x.x, x.q) for x in got if x.k == 1) == [(1.0, 1), (1.0, 1), (1.0, 1), (2.0, 2), (3.0, 3)]
    assert {x.q for x in got if x.k == 2} == {None}


def test_daily_rank_ic_is_not_pooled(spark):
    rows = [(d, float(i), float(-i + 100 * k)) for k, d in enumerate(D[:2]) for i in range(5)]
    got = E.daily_rank_ic(spark.createDataFrame(rows, "date date, x double, y double"), ["date"], "x", "y").collect()
    assert [round(x.rank_ic, 9) for x in got] == [-1.0, -1.0]


def test_fifo_slices(spark):
    trades = [("b", "s", 1, "buy", 10.0, 1.0), ("b", "s", 2, "buy", 10.0, 3.0), ("b", "s", 3, "sell", 15.0, 2.0)]
    got = C.fifo_matches(spark.createDataFrame(trades, "book string, symbol string, at int, side string, quantity double, price double"))
    assert sorted((x.bought_at, x.quantity) for x in got.collect()) == [(1, 10.0), (2, 5.0)]
    assert C.win_rate(got).first().win_rate == 0.5


def test_series_gaps_stay_gaps(spark):
    values = [("s", dt.date(2020, m, 5), float(m)) for m in range(1, 13) if m != 7]
    got = {x.period_end.month: x for x in C.changed(C.monthly(spark.createDataFrame(values, "series_id string, date date, value double"))).collect()}
    assert len(got) == 12 and got[7].value is None and got[8].diff is None and got[9].diff == 1.0


def test_drawdown_starts_from_one(spark):
    curve = spark.createDataFrame([("b", D[0], -0.5), ("b", D[1], 1.0)], "book string, date date, net_return double")
    got = R.performance(curve, "book").first()
    assert abs(got.max_drawdown + 0.5) < 1e-12 and abs(got.net_return) < 1e-12


def test_theme_weights(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, -1.0), (2, -1.0), (2, -2.0), (3, 0.1), (3, 0.2)], "k int, s double")
    got = rows.withColumn("w", R.theme_weights(F.col("s"), ["k"])).groupBy("k").agg(F.sum("w").alias("w"), F.max("w").alias("m")).collect()
    assert {x.k: round(x.w, 9) for x in got} == {1: 1.0, 2: 0.4, 3: 1.0} and next(x.m for x in got if x.k == 3) == 0.5


def test_split_factors_look_ahead(spark):
    bars = spark.createDataFrame([("a", D[i], 8.0, 8.0, 8.0, 8.0, 100.0, 2.0 if i == 2 else 1.0) for i in range(4)], "instrument string, date date, open double, high double, low double, close double, volume double, split double")
    assert [x.close for x in C.nominal_prices(bars).orderBy("date").collect()] == [16.0, 16.0, 8.0, 8.0]


def test_safe_urls(spark):
    urls = ["https://a.b/c#d", "ftp://a.b", "http://u@h/x", "http:///x", None, "HTTP://h?q=1"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(C.safe_url("url").alias("u")).collect()
    assert [x.u for x in got] == ["https://a.b/c", None, None, None, None, "HTTP://h?q=1"]


def test_plain_text_is_whole_and_only_titles_are_cut(spark):
    body, head = "word &amp; " * 300, "long title " * 60
    page = spark.createDataFrame([(f"<html><title>{head}</title><p>{body}</p>",), ("<p>x</p>",), (None,)], "html string")
    got = page.select(C.plain("html").alias("text"), C.title("html").alias("title")).collect()
    assert got[0].text == f"{head}  {body}".replace("&amp;", "&").replace("  ", " ").replace("  ", " ").strip() and got[0].title == head[:400]
    assert (got[1].text, got[1].title, got[2].text, got[2].title) == ("x", None, None, None)
