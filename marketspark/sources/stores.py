"""Stores and sinks of market data: Parquet by symbol, a research layout, reports and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.streaming.store import Store, newest


def put_bars(bars: DataFrame, path: str) -> None:
    """Replaces what is stored of the instruments in bars; other instruments' folders stay."""
    bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("instrument").parquet(path)


def get_bars(spark: SparkSession, path: str, instruments: list[str] | None = None, start: str | None = None, end: str | None = None, fields: list[str] | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Stored bars: only the folders of the instruments, the dates from start to end and the fields are read; extra fields
    by (instrument, date) are joined."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("instrument").isin(instruments)) if instruments else rows
    rows = rows.where(F.col("date") >= F.lit(start).cast("date")) if start else rows
    rows = rows.where(F.col("date") <= F.lit(end).cast("date")) if end else rows
    rows = rows.select("instrument", "date", *fields) if fields else rows
    return rows.join(extra, ["instrument", "date"], "left") if extra is not None else rows


def write_layout(panel: DataFrame, path: str) -> None:
    """calendar (one date a line), instruments (name, first and last session of the calendar, by tabs) and the panel."""
    days = panel.select(F.date_format("date", "yyyy-MM-dd").alias("value")).distinct()
    days.coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(f"{path}/calendars")  # one line a session
    span = panel.agg(F.date_format(F.min("date"), "yyyy-MM-dd").alias("a"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("b"))
    names = panel.select("instrument").distinct().crossJoin(F.broadcast(span))  # one row
    names.select(F.concat_ws("\t", "instrument", "a", "b").alias("value")).write.mode("overwrite").text(f"{path}/instruments")
    panel.write.mode("overwrite").parquet(f"{path}/panel")


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("instrument string, first date, last date").csv(f"{path}/instruments", sep="\t")


def write_csv(rows: DataFrame, path: str) -> None:
    """A null is an empty cell."""
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def add_records(records: DataFrame, folder: str, number: int) -> DataFrame:
    """A library of records by alpha_id: round `number` is added once, and of each alpha the record with the greatest `at`
    counts. The library is pieces with a list of what counts (streaming.store), so a round writes its own records only."""
    held = Store(records.sparkSession, folder, newest(["alpha_id"], "at"))
    held.add(records, number)
    return held.merged()


def write_records(library: DataFrame, path: str) -> None:
    """One JSON line for each alpha, by alpha_id; nulls are written."""
    library.repartitionByRange("alpha_id").sortWithinPartitions("alpha_id").write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_trace(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def trace_tail(spark: SparkSession, path: str, schema: str, time: str, n: int = 100) -> DataFrame:
    """The newest n records; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(time).isNotNull()).orderBy(F.desc(time)).limit(n)


def manifest(bars: DataFrame) -> DataFrame:
    """Per instrument: rows, first, last and a digest of its rows that does not depend on their order: SHA-256 of each row
    written as text, of which the first 60 bits are added up."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("date", "open", "high", "low", "close", "volume")])
    part = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return bars.groupBy("instrument").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum(part).cast("string").alias("digest"))


def changed(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Instruments whose manifest is no longer what was stored, missing ones included."""
    both = stored.alias("s").join(now.alias("n"), "instrument", "full")
    return both.where(~F.col("s.digest").eqNullSafe(F.col("n.digest"))).select("instrument", F.col("s.n").alias("stored_rows"), F.col("n.n").alias("rows"))


def freshness(bars: DataFrame, today: Column, most: int = 7) -> DataFrame:
    """age of the newest bar in days and whether it lies between zero and `most`."""
    age = F.datediff(today, F.max("date"))
    return bars.agg(F.max("date").alias("last"), age.alias("age"), age.between(0, most).alias("fresh"))


def report_rows(library: DataFrame) -> DataFrame:
    """A library's records as they are printed: rank, name and figures of fixed width; missing figures are dashes."""
    def fixed(c: str, digits: int) -> Column:
        return F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c))).otherwise("-").alias(c)

    numbers = [f.name for f in library.schema.fields if f.dataType.simpleString() == "double"]
    return library.select(*[fixed(c, 4) if c in numbers else F.col(c) for c in library.columns])
