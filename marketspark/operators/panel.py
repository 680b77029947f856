"""The research panel: bars on every session of the calendar for every instrument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.scan import LONG, Run, scanned

PRICES = ["open", "high", "low", "close"]


def line(by: str = "instrument", order: str = "date") -> Window:
    return Window.partitionBy(by).orderBy(order)


def calendar(bars: DataFrame, date: str = "date") -> DataFrame:
    """Distinct sessions of all instruments, with their ordinal from 0. The ordinal's window sees one row per session."""
    return bars.select(date).distinct().withColumn("ordinal", F.row_number().over(Window.orderBy(date)).cast("long") - 1)


def dense(bars: DataFrame) -> DataFrame:
    """bars on calendar x instruments; a session without a bar is a row of nulls, so that lags count market sessions."""
    days, names = bars.select("date").distinct(), bars.select("instrument").distinct()
    grid = days.crossJoin(names)  # the panel's own shape, not a product of facts
    return grid.join(bars, ["date", "instrument"], "left")


def add_returns(panel: DataFrame) -> DataFrame:
    """close over the previous session's close, less one; never across a missing session."""
    return panel.withColumn("returns", F.try_divide("close", F.lag("close", 1).over(line())) - 1)


def attach_cap(panel: DataFrame) -> DataFrame:
    return panel if "cap" in panel.columns else panel.withColumn("cap", F.col("close") * F.col("volume"))


def attach_industry(panel: DataFrame, industries: DataFrame, default: float = 0.0) -> DataFrame:
    """industries(instrument, industry); unknown instruments get the default."""
    return panel.drop("industry").join(industries.select("instrument", F.col("industry").cast("double")), "instrument", "left").withColumn("industry", F.coalesce("industry", F.lit(default)))


def align(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows of both factors on their common dates and instruments."""
    return x.join(y, ["date", "instrument"])


def wide(panel: DataFrame, field: str) -> DataFrame:
    """One field as dates x instruments."""
    return panel.groupBy("date").pivot("instrument").agg(F.first(field))


def long(frame: DataFrame, value: str = "value") -> DataFrame:
    """dates x instruments as rows, nulls kept."""
    return frame.unpivot("date", [c for c in frame.columns if c != "date"], "instrument", value)


def upsert(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Union of both by key; where both have a row, the incoming one stays."""
    return prefer([new, old], keys or ["instrument", "date"])


def prefer(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all sources; for each key the first source that has it."""
    ranked = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    both = ranked[0]
    for r in ranked[1:]:
        both = both.unionByName(r)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy("_source"))
    return both.withColumn("_best", best).where("_best = 1").drop("_best", "_source")


def keep_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_best", best).where("_best = 1").drop("_best")


def missing_ranges(bars: DataFrame, start: str, end: str, pad: int = 5) -> DataFrame:
    """instrument, from, to: what to fetch before and after each instrument's bars; `pad` days short is still covered."""
    spans = bars.groupBy("instrument").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    start, end = F.lit(start).cast("date"), F.lit(end).cast("date")
    head = spans.where(F.col("first") > F.date_add(start, pad)).select("instrument", start.alias("from"), F.date_sub("first", 1).alias("to"))
    tail = spans.where(F.col("last") < F.date_sub(end, pad)).select("instrument", F.date_add("last", 1).alias("from"), end.alias("to"))
    return head.union(tail)


def failover(primary: DataFrame, fallback: DataFrame, start: str, slack: int = 10) -> DataFrame:
    """Per instrument the primary's rows if they begin by start + slack days, else the fallback's."""
    good = primary.groupBy("instrument").agg(F.min("date").alias("first")).where(F.col("first") <= F.date_add(F.lit(start).cast("date"), slack)).select("instrument")
    return primary.join(good, "instrument", "left_semi").unionByName(fallback.join(good, "instrument", "left_anti"))


def on_dates(bars: DataFrame, dates: DataFrame) -> DataFrame:
    return bars.join(dates, "date", "left_semi")


def absent(wanted: DataFrame, bars: DataFrame) -> DataFrame:
    """Instruments of the universe that have no bars."""
    return wanted.select("instrument").distinct().join(bars.select("instrument"), "instrument", "left_anti")


def carried(values: DataFrame, dates: DataFrame, by: str, value: str, long: int = LONG) -> DataFrame:
    """values(by, date, value) on all dates, the last known value carried forward. As-of join by union and scan."""
    keys = values.select(by).distinct()
    asked = dates.select("date").distinct().crossJoin(keys).select(by, "date", F.lit(None).cast("double").alias(value), F.lit(1).alias("asked"))
    both = values.select(by, "date", F.col(value).cast("double").alias(value), F.lit(0).alias("asked")).union(asked)
    known = scanned(both, [by], ["date", "asked"], {"_known": Run("last", F.col(value))}, long)
    return known.where("asked = 1").select(by, "date", F.col("_known").alias(value))


def asof(left: DataFrame, right: DataFrame, by: str, time: str, value: str, long: int = LONG) -> DataFrame:
    """left with the latest value of right(by, time, value) at or before each row's time. Union and scan; keys of over `long`
    rows are worked on in slices of time."""
    columns = left.columns
    a = left.withColumn(value, F.lit(None).cast(right.schema[value].dataType)).withColumn("_asked", F.lit(1))
    b = right.select(by, time, value).withColumn("_asked", F.lit(0))
    known = scanned(a.unionByName(b, allowMissingColumns=True), [by], [time, "_asked"], {"_known": Run("last", F.col(value))}, long)
    return known.where("_asked = 1").withColumn(value, F.col("_known")).select(*columns, value)


def late_starts(bars: DataFrame, start: str, days: int = 30) -> DataFrame:
    return bars.groupBy("instrument").agg(F.min("date").alias("first")).where(F.col("first") > F.date_add(F.lit(start).cast("date"), days))


def differences(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full match of two tables: keys that are only in one, or whose fields differ (null equals null)."""
    x = a.select(*keys, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("in_a"))
    y = b.select(*keys, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("in_b"))
    both = x.join(y, keys, "full")
    reason = F.when(F.col("in_a").isNull(), "only in b").when(F.col("in_b").isNull(), "only in a")
    for f in fields:
        reason = reason.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), f"{f} differs")
    return both.select(*keys, reason.alias("reason")).where("reason is not null")


def multiset_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a and b (same columns, null equals null) that do not come equally often: the row, in_a, in_b. What exceptAll
    gives both ways, with counts, from one shuffle of sums."""
    both = a.withColumns({"in_a": F.lit(1), "in_b": F.lit(0)}).unionByName(b.withColumns({"in_a": F.lit(0), "in_b": F.lit(1)}))
    return both.groupBy(*a.columns).agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b")).where("in_a <> in_b")


def composite(primary: DataFrame, live: DataFrame, start: str, end: str, pad: int = 5) -> DataFrame:
    """Per instrument the primary's rows alone if they cover start to end (`pad` days short is still covered), else both
    sources' rows, the primary's where both have one."""
    spans = primary.groupBy("instrument").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    covered = spans.where((F.col("first") <= F.date_add(F.lit(start).cast("date"), pad)) & (F.col("last") >= F.date_sub(F.lit(end).cast("date"), pad))).select("instrument")
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return prefer([primary, live.join(covered, "instrument", "left_anti")], ["instrument", "date"]).where(inside)


def session_bars(rows: DataFrame, at: str, zone: str = "UTC") -> DataFrame:
    """rows(instrument, at timestamp_ntz in a zone) by their date in UTC, the last of each: date instead of at."""
    moment = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col(at))
    last = keep_last(rows.withColumn("date", F.to_date(moment)), ["instrument", "date"], [F.desc(at)])
    return last.drop(at)


def carried_industries(days: DataFrame, industries: DataFrame) -> DataFrame:
    """date, instrument, industry: industries(instrument, date, industry) on all of days(date), the last known one carried
    to later dates."""
    return carried(industries, days, "instrument", "industry").select("date", "instrument", "industry")
