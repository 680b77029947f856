"""Spans and moments, multisets and grids against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from marketspark.operators import panel as P
from marketspark.operators import portfolio as R
from marketspark.operators import records as C
from marketspark.operators.intervals import held_by, held_totals


def test_spans_of_all_lengths_equal_a_plain_join(spark):
    r = random.Random(1)
    spans = [(i, r.choice("ab"), s, s + r.choice([0, 1, 3, 60, 900, -1])) for i in range(300) for s in (r.randrange(1000),)] + [(900, "a", None, 5), (901, "a", 5, None), (902, None, 1, 9), (0, "a", 3, 3), (0, "a", 3, 3)]
    points = [(i, r.choice("ab"), r.randrange(-5, 1100)) for i in range(400)] + [(500, "a", None), (501, None, 5), (3, "b", 7), (3, "b", 7)]
    a = spark.createDataFrame(points, "p int, k string, at int").repartition(3)
    b = spark.createDataFrame(spans, "s int, k string, lo int, hi int").repartition(3)
    got = held_by(a, b, "at", "lo", "hi", ["k"])
    want = [(p, s) for p, k, at in points for s, j, lo, hi in spans if k is not None and k == j and None not in (at, lo, hi) and lo <= at <= hi]
    assert sorted((x.p, x.s) for x in got.collect()) == sorted(want) and len(want) > 1000
    dates = held_by(a.select("p", F.date_add(F.lit("2000-01-01").cast("date"), F.col("at")).alias("d")), b.select("s", *[F.date_add(F.lit("2000-01-01").cast("date"), F.col(c)).alias(c) for c in ("lo", "hi")]), "d", "lo", "hi")
    assert dates.count() == sum(1 for p, k, at in points for s, j, lo, hi in spans if None not in (at, lo, hi) and lo <= at <= hi)
    assert held_by(a, b.limit(0), "at", "lo", "hi", ["k"]).count() == 0 == held_by(a.select("p", "at"), b.limit(0).drop("k"), "at", "lo", "hi").count()


def test_totals_of_spans_equal_a_plain_join(spark):
    r = random.Random(2)
    spans = [(i, r.choice("ab"), s, s + r.choice([0, 1, 2, 3, 7, 60, 63, 64, 900, -1])) for i in range(400) for s in (r.randrange(-50, 1000),)] + [(900, "a", None, 5), (901, "a", 5, None), (902, None, 1, 9), (0, "a", 3, 3), (0, "a", 3, 3), (903, "b", 5000, 6000)]
    points = [(i, r.choice("ab"), r.randrange(-60, 1100), r.choice([None, 1.0, 2.5, 1e9])) for i in range(900)] + [(500, "a", None, 1.0), (501, None, 5, 1.0), (3, "b", 7, 2.0), (3, "b", 7, 2.0), (4, "a", 2000, None)]
    spans.append((904, "a", 2000, 2001))
    a = spark.createDataFrame(points, "p int, k string, at int, x double").repartition(3)
    b = spark.createDataFrame(spans, "s int, k string, lo int, hi int").repartition(3)
    day = lambda c: F.date_add(F.lit("1970-02-01").cast("date"), F.col(c)).alias(c)
    want = {}
    for s, j, lo, hi in spans:
        for _, k, at, x in points:
            if k is not None and k == j and None not in (at, lo, hi) and lo <= at <= hi:
                n, total = want.get(s, (0, None))
                want[s] = n + 1, total if x is None else (total or 0.0) + x
    for p, q in ((a, b), (a.select("p", "k", day("at"), "x"), b.select("s", "k", day("lo"), day("hi"))), (a.withColumn("at", F.timestamp_seconds("at")), b.withColumns({c: F.timestamp_seconds(c) for c in ("lo", "hi")}))):
        got = held_totals(p, q, "at", "lo", "hi", ["k"], ["x"]).groupBy("s").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
        assert {x.s: (x.n, x.x) for x in got} == want and len(want) > 250 and want[904] == (1, None)
    assert held_totals(a, b.limit(0), "at", "lo", "hi", ["k"]).count() == 0 == held_totals(a.limit(0), b, "at", "lo", "hi", ["k"]).count()
    with pytest.raises(TypeError):
        held_totals(a, b, "x", "lo", "hi", ["k"])


def test_totals_do_not_pair_points_with_spans(spark):
    # 400,000 orders of forty days under 20,000 surcharges of all of them: 8,000,000,000 pairs
    points = spark.range(400_000).select((F.col("id") % 40).alias("at"), F.lit(1.5).alias("x"))
    spans = spark.range(20_000).select("id", (F.col("id") % 3 - 5).alias("lo"), (F.col("id") % 5 + 40).alias("hi"))
    got = held_totals(points, spans, "at", "lo", "hi", sums=["x"]).groupBy("id").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.count("*").alias("pieces"))
    assert got.groupBy("n", "x").count().collect() == [(400_000, 600_000.0, 20_000)] and got.agg(F.max("pieces")).first()[0] <= 12


def test_a_hundred_thousand_regimes_without_a_nested_loop(spark):
    regimes = spark.range(100_000).select(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") % 9000).cast("int")).alias("start"), F.lit(1).alias("one"), "id")
    regimes = regimes.withColumn("end", F.date_add("start", (F.col("id") % 13).cast("int"))).withColumn("scores", F.create_map(F.concat(F.lit("t"), F.col("id").cast("string")), F.lit(1)))
    dates = spark.range(9000).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    got = C.policy_scores(dates, regimes)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # days 0 to 8999, spans clipped at the last day
    want = sum(min(i % 13, 8999 - i % 9000) + 1 for i in range(100_000))
    assert got.count() == want


def test_multisets(spark):
    a = spark.createDataFrame([(1, "x")] * 3 + [(2, None)] * 2 + [(3, "z")], "i int, s string")
    b = spark.createDataFrame([(1, "x")] + [(2, None)] * 2 + [(4, "w")] * 2, "i int, s string")
    got = {(x.i, x.s): (x.in_a, x.in_b) for x in P.multiset_differences(a, b).collect()}
    assert got == {(1, "x"): (3, 1), (3, "z"): (1, 0), (4, "w"): (0, 2)}
    assert a.exceptAll(b).count() == sum(max(0, x - y) for x, y in got.values()) and b.exceptAll(a).count() == sum(max(0, y - x) for x, y in got.values())
    assert P.multiset_differences(a, a).count() == 0


def test_the_grid_equals_single_curves(spark):
    r = random.Random(3)
    days = [f"2024-01-{d:02d}" for d in range(1, 29)]
    rows = [(d, f"i{k}", None if r.random() < 0.1 else 10 + r.random(), 5.0, r.random()) for d in days for k in range(9)]
    panel = spark.createDataFrame(rows, "date string, instrument string, close double, volume double, s double").withColumn("date", F.to_date("date"))
    grid = R.top_k_grid(panel, "s", [(2, 1), (3, 4), (3, 5)])
    assert grid.select("k", "every").distinct().count() == 3
    for k, every in [(2, 1), (3, 4), (3, 5)]:
        one = {x.date: x.net_return for x in R.top_k_curve(panel, "s", k=k, every=every).collect()}
        assert {x.date: x.net_return for x in grid.where((F.col("k") == k) & (F.col("every") == every)).collect()} == pytest.approx(one)
