"""Bars from tables and files of many shapes: aliased headers, one file a symbol, many symbols a file, JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.operators.lineage import cut

# The names under which a table may bring each field, in order of preference.
DATE_NAMES = ("date", "datetime", "trade_date", "日期")
FIELD_NAMES = {
    "open": ("open", "开盘"),
    "high": ("high", "最高"),
    "low": ("low", "最低"),
    "close": ("close", "收盘"),
    "volume": ("volume", "vol", "成交量"),
    "vwap": ("vwap", "avg", "平均"),
}
FEED_NAMES = {
    "date": ("date", "日期", "时间"),
    "open": ("open", "开盘"),
    "high": ("high", "最高"),
    "low": ("low", "最低"),
    "close": ("close", "收盘", "收盘价", "净值"),
    "volume": ("volume", "成交量"),
}
ZONE = "America/New_York"


def number(value: Column) -> Column:
    """A number, or null where the text is none."""
    return value.try_cast("double")


def _filled(found: dict[str, Column]) -> dict[str, Column]:
    """Missing prices are the close, a missing volume is 1, a missing vwap the mean of high, low and close."""
    out = {c: found.get(c, found["close"]) for c in ("open", "high", "low")} | {"close": found["close"], "volume": found.get("volume", F.lit(1.0))}
    return out | {"vwap": found.get("vwap", (out["high"] + out["low"] + out["close"]) / 3.0)}


def bars_from_table(rows: DataFrame, keep: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """rows under any of the known names (letter case ignored) as keep..., date, open, high, low, close, volume, vwap.

    What is no number becomes null; what a table lacks is filled in. A table without a date or a close is an error."""
    by_name = {c.lower(): c for c in rows.columns}

    def pick(names: tuple[str, ...]) -> str | None:
        return next((by_name[n] for n in names if n in by_name), None)

    date, fields = pick(DATE_NAMES), {f: pick(n) for f, n in FIELD_NAMES.items()}
    if date is None or fields["close"] is None:
        raise ValueError(f"a table of bars needs a date and a close: {rows.columns}")
    found = _filled({f: number(F.col(f"`{c}`")) for f, c in fields.items() if c})
    return rows.select(*[c for c in keep if c in rows.columns], F.col(f"`{date}`").try_cast("date").alias("date"), *[c.alias(f) for f, c in found.items()])


def _lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file, block, at, line: the lines of all files, which Spark may split anywhere; (block, at) grows along a file."""
    read = spark.read.option("recursiveFileLookup", True)
    rows = (read.option("pathGlobFilter", glob) if glob else read).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def cells(line: Column) -> Column:
    """The cells of a line of CSV, any number of them: quoted ones without their quotes, others trimmed."""
    # each match is a cell and the comma or end behind it; the empty match at the very end is dropped by its place
    raw = F.regexp_extract_all(line, F.lit(r'(\s*"(?:[^"]|"")*"\s*|[^,]*)(?:,|$)'), F.lit(1))
    return F.transform(raw, lambda c: F.when(F.trim(c).startswith('"'), F.regexp_replace(F.regexp_replace(F.trim(c), r'^"|"$', ""), '""', '"')).otherwise(F.trim(c)))


def csv_directory(spark: SparkSession, path: str, symbol: str = r"([^/]+)\.csv$") -> DataFrame:
    """One CSV for each symbol, each with a header of its own: instrument, date and the fields of bars_from_table().

    symbol: a pattern whose first group in the file's path is the symbol, in capitals. A header may have any number of
    columns; one without a date or a close is an error (headers are looked at when the reader is made). Headers are one
    row a file and meet the lines by file, so files are split like any text; cells do not span lines; lines equal to
    their header and blank ones are skipped."""
    lines = _lines(spark, path, "*.csv")
    heads = lines.where("block = 0").groupBy("file").agg(F.min_by("line", "at").alias("head"))
    heads = heads.withColumn("names", F.transform(cells(F.regexp_replace("head", "^\ufeff", "")), lambda c: F.lower(c)))

    def place(names: tuple[str, ...]) -> Column:
        places = [F.array_position("names", F.lit(n)) for n in names]
        return F.coalesce(*[F.when(p > 0, p) for p in places]).cast("int")

    at = {f: place(n).alias(f"_{f}") for f, n in FIELD_NAMES.items()} | {"date": place(DATE_NAMES).alias("_date")}
    heads = heads.select("file", "head", "names", *at.values())
    if faults := [r.file for r in heads.where("_date is null or _close is null").limit(5).collect()]:
        raise ValueError(f"a table of bars needs a date and a close: {faults}")
    rows = lines.join(heads, "file").where((F.trim("line") != "") & (F.col("line") != F.col("head"))).withColumn("cells", cells(F.col("line")))

    def cell(field: str) -> Column:
        return F.when(F.col(f"_{field}").isNotNull(), F.try_element_at("cells", F.col(f"_{field}")))

    close = number(cell("close"))
    value = {c: F.when(F.col(f"_{c}").isNotNull(), number(cell(c))).otherwise(close) for c in ("open", "high", "low")} | {"close": close}
    volume = F.when(F.col("_volume").isNotNull(), number(cell("volume"))).otherwise(1.0)
    made = rows.select(F.upper(F.regexp_extract("file", symbol, 1)).alias("instrument"), cell("date").try_cast("date").alias("date"), *[c.alias(n) for n, c in value.items()], volume.alias("volume"), "_vwap", cell("vwap").alias("_v"))
    vwap = F.when(F.col("_vwap").isNotNull(), number(F.col("_v"))).otherwise((F.col("high") + F.col("low") + F.col("close")) / 3.0)
    return made.select("instrument", "date", "open", "high", "low", "close", "volume", vwap.alias("vwap"))


def _keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_last", last).where("_last = 1").drop("_last", order)


def multi_symbol_csv(spark: SparkSession, path: str) -> DataFrame:
    """code, date, open, high, low, close and vol_hand or volume, many symbols in a file, as bars.

    Codes lose their suffix and are padded to six digits; vol_hand counts hundreds; of rows that repeat a code and date
    the last in the file stays. A missing column is an error."""
    rows = spark.read.option("header", True).csv(path)
    missing = {"code", "date", "open", "high", "low", "close"} - set(rows.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    code = F.element_at(F.split("code", r"\."), 1)
    volume = number(F.col("vol_hand")) * 100.0 if "vol_hand" in rows.columns else number(F.col("volume")) if "volume" in rows.columns else F.lit(0.0)
    place = F.concat_ws(":", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    bars = rows.select(
        F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code).alias("instrument"), F.col("date").try_cast("date").alias("date"),
        *[number(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], volume.alias("volume"), place.alias("_place"),
    )
    return _keep_last(bars, ["instrument", "date"], "_place")


def feed_bars(rows: DataFrame, keep: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """A feed's frame under its own names as keep..., date, open, high, low, close, volume; missing prices are the close, a
    missing volume is zero; a time of day and its zone are cut off."""
    names = {f: next((n for n in aliases if n in rows.columns), None) for f, aliases in FEED_NAMES.items()}
    if names["date"] is None or names["close"] is None:
        raise ValueError(f"a feed needs a date and a close: {rows.columns}")
    close = number(F.col(names["close"]))
    price = [(number(F.col(names[f])) if names[f] else close).alias(f) for f in ("open", "high", "low")]
    volume = number(F.col(names["volume"])) if names["volume"] else F.lit(0.0)
    return rows.select(*[c for c in keep if c in rows.columns], F.substring(F.col(names["date"]).cast("string"), 1, 10).try_cast("date").alias("date"), *price, close.alias("close"), volume.alias("volume"))


def session_date(epoch_ms: Column, zone: str = ZONE) -> Column:
    """Local date of a moment, whatever the session's own time zone is."""
    moment = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (epoch_ms / 1000).cast("decimal(18,6)"))
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), moment))


def _sessions(rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows (instrument, place, date, prices): the last of each date, within [start, end), with a close."""
    kept = _keep_last(rows, ["instrument", "date"], "place")
    for bound, test in ((start, F.col("date") >= F.lit(start).cast("date")), (end, F.col("date") < F.lit(end).cast("date"))):
        kept = kept.where(test) if bound else kept
    return kept.where("close is not null")


def aggregates_json(payloads: DataFrame, start: str | None = None, end: str | None = None, zone: str = ZONE) -> DataFrame:
    """payloads(instrument, payload): JSON with results of t (milliseconds), o, h, l, c, v, as bars by local session date.
    Of a date that repeats the last stays; a date without a close is dropped; [start, end); refused payloads give nothing."""
    parsed = payloads.select("instrument", F.from_json("payload", "status string, results array<struct<t bigint, o double, h double, l double, c double, v double>>").alias("p"))
    rows = parsed.where("upper(coalesce(p.status, '')) not in ('NOT_AUTHORIZED', 'ERROR')").select("instrument", F.posexplode("p.results").alias("place", "r"))
    bars = rows.select("instrument", "place", session_date(F.col("r.t"), zone).alias("date"), *[F.col(f"r.{k}").alias(n) for k, n in zip("ohlcv", ("open", "high", "low", "close", "volume"), strict=True)])
    return _sessions(bars, start, end)


def candles_json(payloads: DataFrame, start: str | None = None, end: str | None = None, zone: str = ZONE) -> DataFrame:
    """payloads(instrument, payload): JSON with parallel arrays t (seconds), o, h, l, c, v and s = "ok", as bars; the rest as
    in aggregates_json()."""
    kinds = ", ".join(f"{k} array<double>" for k in "ohlcv")
    parsed = payloads.select("instrument", F.from_json("payload", f"s string, t array<bigint>, {kinds}").alias("p")).where("p.s = 'ok'").select("instrument", "p.*")
    rows = parsed.select("instrument", F.posexplode(F.arrays_zip("t", *"ohlcv")).alias("place", "r")).where("r.t is not null")
    bars = rows.select("instrument", "place", session_date(F.col("r.t") * 1000, zone).alias("date"), *[F.col(f"r.{k}").alias(n) for k, n in zip("ohlcv", ("open", "high", "low", "close", "volume"), strict=True)])
    return _sessions(bars, start, end)


def industry_map(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """instrument, industry from a CSV, or a table with tabs if the path ends in .tsv or .txt; under the known names, else
    the first two columns. Fewer columns are an error."""
    rows = spark.read.option("header", True).csv(path, sep=sep or ("\t" if path.lower().endswith((".tsv", ".txt")) else ","))
    names = {c.strip().lower(): c for c in rows.columns}
    # The names of both columns.
    instrument = next((names[n] for n in ("instrument", "symbol", "code", "ticker") if n in names), None)
    industry = next((names[n] for n in ("industry", "industry_id", "sw1", "sw_l1", "id") if n in names), None)
    if instrument is None or industry is None:
        if len(rows.columns) < 2:
            raise ValueError("an industry map needs two columns")
        instrument, industry = rows.columns[:2]
    return rows.select(F.trim(F.col(f"`{instrument}`")).alias("instrument"), F.col(f"`{industry}`").cast("double").alias("industry"))


def flows_csv(spark: SparkSession, path: str) -> DataFrame:
    """date, net_flow of a CSV with these columns in any letter case; others are an error."""
    rows = spark.read.option("header", True).csv(path)
    names = {c.strip().lower(): c for c in rows.columns}
    if not {"date", "net_flow"} <= set(names):
        raise ValueError("a table of flows needs date and net_flow")
    return rows.select(F.col(f"`{names['date']}`").cast("date").alias("date"), number(F.col(f"`{names['net_flow']}`")).alias("net_flow"))


def observations_csv(spark: SparkSession, path: str, series: str) -> DataFrame:
    """series_id, date, value of a CSV with observation_date and a column named as the series; "." is null."""
    rows = spark.read.option("header", True).option("nullValue", ".").csv(path)
    if not {"observation_date", series} <= set(rows.columns):
        raise ValueError(f"unexpected columns: {rows.columns}")
    return rows.select(F.lit(series).alias("series_id"), F.col("observation_date").cast("date").alias("date"), number(F.col(f"`{series}`")).alias("value"))


def reports_json(payloads: DataFrame, field: str) -> DataFrame:
    """payloads(series_id, payload): {"result": {"data": [{"REPORT_DATE", field}]}} as series_id, date, value."""
    rows = payloads.select("series_id", F.explode(F.from_json("payload", "result struct<data: array<map<string,string>>>")["result"]["data"]).alias("r"))
    return rows.select("series_id", F.substring(F.col("r")["REPORT_DATE"], 1, 10).try_cast("date").alias("date"), number(F.col("r")[field]).alias("value"))


def yearly_json(payloads: DataFrame) -> DataFrame:
    """payloads(series_id, payload): [{pages}, [{date, value}]] with one page as series_id, date (first of January), value."""
    parsed = payloads.select("series_id", F.from_json("payload", "array<string>").alias("p")).where((F.size("p") == 2) & (F.coalesce(F.get_json_object(F.col("p")[0], "$.pages").try_cast("int"), F.lit(1)) == 1))
    rows = parsed.select("series_id", F.explode(F.from_json(F.col("p")[1], "array<struct<date string, value double>>")).alias("r"))
    return rows.select("series_id", F.concat("r.date", F.lit("-01-01")).try_cast("date").alias("date"), "r.value")


def monthly_section(spark: SparkSession, path: str) -> DataFrame:
    """file, date, factor, value of the monthly section of factor files: the first run of `yyyymm,` lines after the header,
    up to the first other line; -99.99 and -999 are null. Any number of factors; the section's edges are aggregates over
    lines by their place, so files are split like any text. Places are those of one reading, kept in the shared folder."""
    lines = cut(_lines(spark, path).select("file", F.struct("block", "at").alias("at"), "line"))
    head = F.contains("line", F.lit("Mkt-RF")) & F.contains("line", F.lit("SMB"))
    heads = lines.where(head).groupBy("file").agg(F.min(F.struct("at", "line")).alias("h"))
    rows = lines.join(heads, "file").where("at > h.at").withColumn("month", F.col("line").rlike(r"^\s*\d{6}\s*,"))
    first = rows.where("month").groupBy("file").agg(F.min("at").alias("first"))
    ends = rows.where("not month").join(first, "file").where("at > first").groupBy("file").agg(F.min("at").alias("end"))
    kept = rows.where("month").join(ends, "file", "left").where("end is null or at < end").select("file", cells(F.col("h.line")).alias("names"), cells(F.col("line")).alias("cells"))
    date = F.to_date(F.concat(F.col("cells")[0], F.lit("01")), "yyyyMMdd")
    size = F.least(F.size("names"), F.size("cells"))
    pairs = F.explode(F.slice(F.arrays_zip("names", "cells"), F.lit(2), F.greatest(size - 1, F.lit(0)))).alias("p")
    value = number(F.col("p.cells"))
    return kept.select("file", date.alias("date"), pairs).where("p.names <> ''").select("file", "date", F.col("p.names").alias("factor"), F.when(~value.isin(-99.99, -999.0), value).alias("value"))


def canonical_symbol(raw: Column) -> Column:
    """Code of six digits and exchange: SH is written SS; without a suffix, codes that begin with 5, 6 or 9 are SS, others SZ."""
    s = F.replace(F.upper(F.trim(raw)), F.lit(".SH"), F.lit(".SS"))
    code = F.element_at(F.split(s, r"\."), 1)
    code = F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)
    return F.when(s.rlike(r"\.S[SZ]$"), F.concat(code, F.substring(s, -3, 3))).otherwise(F.concat(code, F.when(code.rlike("^[569]"), ".SS").otherwise(".SZ")))


def constituents(rows: DataFrame, code: str = "code", index: str = "000300") -> DataFrame:
    """Distinct codes: the last six digits, padded; the index itself is dropped."""
    digits = F.regexp_replace(F.col(code).cast("string"), "[^0-9]", "")
    return rows.select(F.lpad(F.right(digits, F.lit(6)), 6, "0").alias("code")).where(F.col("code") != index).distinct()
