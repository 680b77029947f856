"""Packed keys, and trades that are numbered and matched in slices of time, against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketspark.operators import records as C
from marketspark.operators.packing import Keys
from marketspark.plans import registry

COLUMNS = ["t", "a", "b", "f"]


@pytest.mark.parametrize("midnights", [True, False])
@pytest.mark.parametrize("wide", [1, 1 << 58])
def test_packed_keys_keep_the_order_and_give_columns_back(spark, midnights, wide):
    r = random.Random(1)
    start = dt.datetime(1960, 3, 1)
    rows = [(start + dt.timedelta(days=r.randrange(9), microseconds=0 if midnights else r.randrange(3)), r.choice([-5, 0, 7]) * wide, r.randrange(-3, 3), r.random() < 0.5) for _ in range(300)]
    rows += [(None, 1, 1, True), (start, None, 2, False), (start, 1, None, None), (None, None, None, None)]
    table = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "t timestamp, a long, b int, f boolean, i int").repartition(3)
    keys = Keys(table, COLUMNS)
    assert keys.rows == len(rows) and len(keys.names) == (1 if wide == 1 else 3)
    packed = table.select("i", *keys.packed())
    got = [x.i for x in packed.orderBy(*keys.order(), "i").collect()]
    assert got == [x.i for x in table.orderBy(*map(F.asc_nulls_last, COLUMNS), "i").collect()]
    back = {x.i: (x.a, x.b, x.f) for x in packed.select("i", keys.field("a").alias("a"), keys.field("b").alias("b"), (keys.field("f") == 1).alias("f")).collect()}
    assert back == {i: x[1:] for i, x in enumerate(rows)}


def test_keys_that_fill_a_long_and_empty_tables(spark):
    table = spark.createDataFrame([(-(1 << 63), 1), ((1 << 63) - 1, 2), (0, 3)], "a long, b int")
    keys = Keys(table, ["a", "b"])
    assert len(keys.names) == 2
    assert [x.b for x in table.select(*keys.packed()).orderBy(*keys.order()).select(keys.field("b").alias("b")).collect()] == [1, 3, 2]
    assert table.limit(0).select(*Keys(table.limit(0), ["a", "b"]).packed()).count() == 0
    with pytest.raises(TypeError):
        Keys(spark.createDataFrame([(1.5,)], "x double"), ["x"])


@pytest.fixture(scope="module")
def made(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), r.choice(["x", "y", "z", "z", "z"]), i // 7, i % 7, r.random() < 0.4, r.choice([1.0, 2.0, 5.0, 9.0, 0.0, -1.0, None])) for i in range(1500)]
    rows += [(None, "x", 300, 0, False, 4.0), ("a", None, 301, 0, False, 4.0), ("a", "x", None, 0, False, 3.0), ("a", "x", None, 1, True, 900.0)]
    return rows, spark.createDataFrame(r.sample(rows, len(rows)), "book string, symbol string, k int, j int, sell boolean, quantity double").repartition(5)


def _queue(rows):
    last = lambda v: (v is None, v or 0)
    lines, out = {}, []
    for n, (book, symbol, _, _, sell, q) in enumerate(sorted(rows, key=lambda x: (last(x[2]), last(x[3]))), 1):
        if q is not None and q > 0 and book is not None and symbol is not None:
            lines.setdefault((book, symbol), ([], []))[sell].append([n, q])
    for key, (buys, sells) in lines.items():
        while buys and sells:
            q = min(buys[0][1], sells[0][1])
            out.append((*key, buys[0][0], sells[0][0], q))
            for side in (buys, sells):
                side[0][1] -= q
                if not side[0][1]:
                    side.pop(0)
    return sorted(out)


@pytest.mark.parametrize("bounds, long, small", [([], 1 << 20, 1 << 18), ([20.0, 20.0, 50.0, 51.0, 200.0], 1 << 20, 1 << 18), ([20.0, 50.0, 51.0, 200.0], 100, 0)])
def test_numbered_trades_meet_as_in_a_queue(spark, made, monkeypatch, bounds, long, small):
    monkeypatch.setattr(C, "_SMALL", small)
    rows, table = made
    got = C.fifo_numbered(table, ["k", "j"], bounds, long)
    want = _queue(rows)
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 500
    assert C.fifo_numbered(table.limit(0), ["k", "j"], bounds, long).count() == 0


def test_no_task_numbers_all_trades(spark):
    slices = registry.queries()["fifo_slices"](spark, "/root/testdata/sf0.001")
    plan = spark._jvm.PythonSQLUtils.explainString(slices._jdf.queryExecution(), "simple")
    assert "SinglePartition" not in plan and not [f for f in slices.inputFiles() if "lineitem" in f]
