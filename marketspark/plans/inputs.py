"""The driver's tables read as market data, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.operators import panel as P
from marketspark.operators.lineage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: instrument (nation of the supplier), industry (its region), date (week), price, quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    names = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "n_regionkey")
    return lines.join(names, lines.l_suppkey == names.s_suppkey).select(
        F.col("n_name").alias("instrument"), F.col("n_regionkey").cast("double").alias("industry"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity"), 8).alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("at"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars per nation, about two hundredths of the grid missing."""
    return fills(spark, sf_dir).groupBy("instrument", "date").agg(
        F.first("industry").alias("industry"), F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"),
        F.sum("quantity").alias("volume"), F.round(F.sum("amount") / F.sum("quantity"), 8).alias("vwap"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense panel with returns, cap and industry."""
    observed = bars(spark, sf_dir)
    industries = observed.select("instrument", "industry").distinct()
    return cut(P.attach_cap(P.add_returns(P.attach_industry(P.dense(observed.drop("industry")), industries))))


BARS = """
fills AS (
  SELECT n_name AS instrument, CAST(n_regionkey AS DOUBLE) AS industry, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
         round(l_extendedprice / l_quantity, 8) AS price, l_quantity AS quantity, l_extendedprice AS amount,
         row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), bars AS (
  SELECT instrument, date, any_value(industry) AS industry, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, sum(quantity) AS volume, round(sum(amount) / sum(quantity), 8) AS vwap
  FROM fills GROUP BY instrument, date
)"""
PANEL = BARS + """, names AS (
  SELECT instrument, any_value(industry) AS industry FROM bars GROUP BY instrument
), dense AS (
  SELECT d.date, n.instrument, b.open, b.high, b.low, b.close, b.volume, b.vwap, coalesce(n.industry, 0.0) AS industry
  FROM (SELECT DISTINCT date FROM bars) d CROSS JOIN names n LEFT JOIN bars b ON b.date = d.date AND b.instrument = n.instrument
), panel AS (
  SELECT *, close / nullif(lag(close) OVER (PARTITION BY instrument ORDER BY date), 0) - 1 AS returns, close * volume AS cap FROM dense
)"""


def sql(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"
