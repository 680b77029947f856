"""Leakage-safe model datasets and learners of pyspark.ml."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.panel import line
from marketspark.operators.refits import LEAST_DATES, LEAST_ROWS, linear_fits, predicted


def lagged(panel: DataFrame, features: list[str], sessions: int = 1) -> DataFrame:
    """Features as they were known `sessions` market sessions before, on the dense panel."""
    return panel.withColumns({f: F.lag(f, sessions).over(line()) for f in features})


def labelled(panel: DataFrame, horizon: int) -> DataFrame:
    return panel.withColumn("label", F.try_divide(F.lead("close", horizon).over(line()), "close") - 1)


def ordinals(panel: DataFrame) -> DataFrame:
    """date and its session ordinal; one row per session."""
    return panel.select("date").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("date")) - 1)


def purged_split(panel: DataFrame, share: float, horizon: int, embargo: int = 5) -> DataFrame:
    """panel with part: test from the session at `share` of the calendar; train ends horizon + embargo sessions before,
    so that no training label reaches into the test; what lies between has no part."""
    days = ordinals(panel)
    sessions = days.count()
    cut = int(sessions * share)
    part = F.when(F.col("ordinal") >= cut, "test").when(F.col("ordinal") < cut - horizon - embargo, "train")
    return panel.join(F.broadcast(days), "date").withColumn("part", part)  # one row per session


def fit_predict(rows: DataFrame, features: list[str], kind: str = "linear", least_rows: int = LEAST_ROWS, least_dates: int = LEAST_DATES) -> DataFrame:
    """rows(part, date, features, label): predictions for the test part of a model fitted on the train part. Rows with a
    missing feature or label are left out of the fit; with fewer than `least_rows` rows or `least_dates` dates there is no
    model and there are no predictions."""
    if kind == "linear":
        train = rows.where("part = 'train'").withColumn("ordinal", F.datediff("date", F.lit("1970-01-01")).cast("long"))
        plan = train.agg(F.max("ordinal").alias("train_last")).withColumn("fold", F.lit(0))
        fits = linear_fits(train, features, "label", plan, least_rows, least_dates)
        return predicted(rows.where("part = 'test'").withColumn("fold", F.lit(0)), features, fits).drop("fold")
    assembled = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip").transform(rows)
    train = assembled.where("part = 'train' and label is not null")
    size = train.agg(F.count("*").alias("n"), F.countDistinct("date").alias("dates")).first()
    test = assembled.where("part = 'test'")
    if size.n < least_rows or size.dates < least_dates:
        return test.drop("x").withColumn("prediction", F.lit(None).cast("double")).limit(0)
    model = GBTRegressor(featuresCol="x", labelCol="label", predictionCol="prediction", seed=42, maxIter=10, maxDepth=3).fit(train)
    return model.transform(test).drop("x")


def leakage(rows: DataFrame, horizon: int) -> DataFrame:
    """Training sessions whose label would reach a test session."""
    first = rows.where("part = 'test'").agg(F.min("ordinal").alias("first"))
    return rows.where("part = 'train'").select("ordinal").distinct().join(F.broadcast(first), F.col("ordinal") + horizon >= F.col("first"))
