"""Streams over three batches, a restart, a batch that runs again, and no new data."""

import pytest
from pyspark.sql import functions as F

from marketspark.streaming import feeds
from marketspark.streaming.store import Store, newest

SCHEMA = "id long, day date, v double, n int"


@pytest.fixture
def inbox(spark, tmp_path):
    class Inbox:
        path, out = f"{tmp_path}/in", f"{tmp_path}/out"

        def add(self, *rows):
            spark.createDataFrame(list(rows), SCHEMA_ROWS).selectExpr("id", "to_date(day) day", "v", "n").coalesce(1).write.mode("append").parquet(self.path)

        def stream(self):
            return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.path)

    SCHEMA_ROWS = "id long, day string, v double, n int"
    return Inbox()


def test_upserts_survive_a_restart(spark, inbox):
    inbox.add((1, "2020-01-01", 1.0, 1), (2, "2020-01-01", 2.0, 1))
    inbox.add((1, "2020-01-01", 5.0, 2))
    run = lambda: {x.id: x.v for x in feeds.upserted(inbox.stream(), inbox.out, ["id"], "n").collect()}
    assert run() == {1: 5.0, 2: 2.0}
    assert run() == {1: 5.0, 2: 2.0}  # nothing new
    inbox.add((3, "2020-01-02", 3.0, 1))
    inbox.add((2, "2020-01-02", 0.5, 0))  # older than what is there
    assert run() == {1: 5.0, 2: 2.0, 3: 3.0}


def test_upserts_ignore_a_version_without_its_mark(spark, inbox):
    inbox.add((1, "2020-01-01", 1.0, 1))
    feeds.upserted(inbox.stream(), inbox.out, ["id"], "n")
    # a batch that died before its mark left half a version
    spark.createDataFrame([(9, "2020-01-01", 9.0, 9)], "id long, day string, v double, n int").selectExpr("id", "to_date(day) day", "v", "n").write.parquet(f"{inbox.out}/version=1")
    inbox.add((2, "2020-01-02", 2.0, 1))
    assert {x.id for x in feeds.upserted(inbox.stream(), inbox.out, ["id"], "n").collect()} == {1, 2}


def test_upserts_without_any_data(spark, inbox):
    spark.createDataFrame([], SCHEMA).write.parquet(inbox.path)
    got = feeds.upserted(inbox.stream(), inbox.out, ["id"], "n")
    assert got.count() == 0 and "id" in got.columns


def test_marks_are_once_over_batches(spark, inbox):
    for day in ("2020-01-01", "2020-01-02", "2020-01-01"):
        inbox.add((1, day, 1.0, 1), (2, day, 1.0, 1), (2, day, 2.0, 2))
    run = lambda: sorted((x.id, str(x.day)) for x in feeds.marked_once(inbox.stream(), inbox.out, ["id", "day"]).collect())
    want = [(i, d) for i in (1, 2) for d in ("2020-01-01", "2020-01-02")]
    assert run() == want and run() == want
    inbox.add((3, "2020-01-01", 1.0, 1), (1, "2020-01-02", 1.0, 1))
    assert run() == [*want, (3, "2020-01-01")]


def _days(df):
    return sorted((str(x.day), x.id, x.v) for x in df.collect())


def test_days_of_several_batches_and_a_restart_are_all_there(spark, inbox):
    inbox.add((1, "2020-01-01", 1.0, 1), (2, "2020-01-01", 2.0, 1))
    inbox.add((3, "2020-01-01", 3.0, 1))
    inbox.add((4, "2020-01-01", 4.0, 1), (1, "2020-01-02", 5.0, 1))
    run = lambda: _days(feeds.by_day(inbox.stream(), inbox.out, "day"))
    first = [("2020-01-01", i, float(i)) for i in (1, 2, 3, 4)] + [("2020-01-02", 1, 5.0)]
    assert run() == first and run() == first
    inbox.add((9, "2020-01-01", 9.0, 1))  # a late row, after a restart
    assert run() == sorted([*first, ("2020-01-01", 9, 9.0)])
    for i in range(6):  # pieces are merged meanwhile
        inbox.add((i, f"2020-02-0{i + 1}", 0.0, 1))
    assert run() == sorted([*first, ("2020-01-01", 9, 9.0)] + [(f"2020-02-0{i + 1}", i, 0.0) for i in range(6)])


def test_a_row_of_a_day_that_comes_again_replaces_its_key(spark, inbox):
    inbox.add((1, "2020-01-01", 1.0, 1), (2, "2020-01-01", 2.0, 1))
    inbox.add((1, "2020-01-01", 1.5, 2), (1, "2020-01-02", 3.0, 1))
    assert _days(feeds.by_day(inbox.stream(), inbox.out, "day", ["id"])) == [("2020-01-01", 1, 1.5), ("2020-01-01", 2, 2.0), ("2020-01-02", 1, 3.0)]


def test_nobody_sees_half_a_day(spark, inbox):
    shown = lambda: _days(feeds.whole_days(spark, inbox.out, "day", inbox.stream().schema))
    inbox.add((1, "2020-01-01", 1.0, 1))
    assert _days(feeds.by_day(inbox.stream(), inbox.out, "day", finished=False)) == [] == shown()
    inbox.add((2, "2020-01-01", 2.0, 1))
    assert _days(feeds.by_day(inbox.stream(), inbox.out, "day", finished=False)) == []
    inbox.add((3, "2020-01-01", 3.0, 1), (1, "2020-01-02", 9.0, 1))  # a later day closes the first
    whole = [("2020-01-01", i, float(i)) for i in (1, 2, 3)]
    assert _days(feeds.by_day(inbox.stream(), inbox.out, "day", finished=False)) == whole
    # a batch that died before its commit has left a piece
    spark.createDataFrame([(7, "2020-01-01", 7.0, 7)], "id long, day string, v double, n int").selectExpr("id", "to_date(day) day", "v", "n").write.parquet(f"{inbox.out}/pieces/3-0")
    assert shown() == whole
    inbox.add((4, "2020-01-01", 4.0, 1), (None, None, 0.0, 0))
    assert _days(feeds.by_day(inbox.stream(), inbox.out, "day")) == [*whole, ("2020-01-01", 4, 4.0), ("2020-01-02", 1, 9.0)] == shown()


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    held = Store(spark, f"{tmp_path}/s", newest(["k"], "t"))
    batch = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], "k int, t int, v string")
    assert held.add(batch, 0) and not held.add(batch, 0)
    assert sorted(map(tuple, held.merged().collect())) == [(1, 2, "c"), (2, 1, "b")]
    assert held.add(spark.createDataFrame([(2, 1, "tie")], "k int, t int, v string"), 1)
    before = held.state()
    assert not held.add(batch, 1) and not held.add(batch, 0) and held.state() == before
    assert sorted(map(tuple, held.merged().collect())) == [(1, 2, "c"), (2, 1, "tie")]


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    """40 batches of one row beside a table of 20,000: pieces written by merges stay near the logarithm, and old ones go."""
    held = Store(spark, f"{tmp_path}/s", newest(["k"], "t"))
    written = []
    keep = held._write
    held._write = lambda rows, name: (written.append((name, rows.count())), keep(rows, name))
    held.add(spark.range(20_000).selectExpr("id as k", "0L as t"), 0)
    for i in range(1, 41):
        held.add(spark.createDataFrame([(i, i)], "k long, t long"), i)
    small = [n for name, n in written if n < 10_000]
    large = [name for name, n in written if n >= 10_000]
    assert len(large) <= 4 and sum(small) <= 41 * 4  # the large piece is written once a level
    state = held.state()
    assert len(state["pieces"]) <= 3 * 4
    there = {p.name for p in (tmp_path / "s/pieces").iterdir()}
    assert {p["name"] for p in state["pieces"]} <= there and len(there) <= len(state["pieces"]) + 12
    assert len(list((tmp_path / "s/versions").glob("version=*"))) <= 4
    assert held.merged().count() == 20_000 and held.merged().agg({"t": "sum"}).first()[0] == sum(range(1, 41))


def test_inbox_answers_each_request_once(spark, inbox):
    asked = []

    def answer(requests):
        asked.append(sorted(x.id for x in requests.collect()))
        if 6 in asked[-1]:
            raise ValueError("bad request")
        return requests.where("id <> 2").select("id", (F.col("v") * 2).alias("answer"))

    inbox.add((1, "2020-01-01", 1.0, 1), (2, "2020-01-01", 2.0, 1), (5, "2020-01-01", 2.0, 0))
    inbox.add((1, "2020-01-01", 1.0, 1), (3, "2020-01-01", 4.0, 1))
    run = lambda: sorted((x.id, x.answer, x.error) for x in feeds.answered(inbox.stream(), inbox.out, "id", answer, F.col("n") == 0).collect())
    first = [(1, 2.0, None), (2, None, "no answer"), (3, 8.0, None)]
    assert run() == first and run() == first
    inbox.add((6, "2020-01-01", 1.0, 1), (3, "2020-01-01", 4.0, 1))
    assert run() == [*first, (6, None, "ValueError")]
    assert asked == [[1, 2], [3], [6]]
