"""Linear models of expanding windows, all from one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A model is fitted on at least so many rows and dates.
LEAST_ROWS, LEAST_DATES = 100, 60


def _grams(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """bucket, line, v: the Gram matrix of (1, features, label) of each bucket, line by line; rows with something missing are
    left out. Each task adds its rows into one matrix a bucket, so what is shuffled does not grow with the rows."""
    names = [*features, label]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            z = np.stack([np.ones(batch.num_rows), *(batch.column(c).to_numpy(zero_copy_only=False) for c in names)], axis=1)
            bucket = batch.column("bucket").to_numpy()
            for b in np.unique(bucket).tolist():
                own = z[bucket == b]
                total[b] = total.get(b, 0) + own.T @ own
        for b, m in total.items():
            yield pa.record_batch([pa.array([b] * len(m)), pa.array(range(len(m))), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["bucket", "line", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for b, line, v in zip(batch.column("bucket").to_pylist(), batch.column("line").to_pylist(), batch.column("v"), strict=True):
                total[b, line] = total.get((b, line), 0) + v.values.to_numpy()
        for (b, line), v in total.items():
            yield pa.record_batch([pa.array([b]), pa.array([line]), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["bucket", "line", "v"])

    schema = "bucket long, line long, v array<double>"
    known = rows.select(F.col("bucket").cast("long"), *[F.col(c).cast("double").alias(c) for c in names]).dropna()
    known = known.where(reduce(lambda a, c: a & ~F.isnan(c), names, F.lit(True)))
    return known.mapInArrow(run, schema).repartition("bucket", "line").mapInArrow(add, schema)


def linear_fits(rows: DataFrame, features: list[str], label: str, plan: DataFrame, least_rows: int = LEAST_ROWS, least_dates: int = LEAST_DATES) -> DataFrame:
    """fold, rows, dates, intercept, weights: for each fold of plan(fold, train_last) least squares over all rows(ordinal,
    features, label) up to train_last, where nothing is missing.

    Sessions between the ends of two folds are one bucket; a fold's Gram matrix is the sum of the buckets up to its own, so
    rows are read once however many folds there are. Folds with too few rows or dates have no fit and no row. Where
    features depend on each other the weights are the smallest that fit."""
    ends = plan.where("train_last is not null").groupBy("train_last").agg(F.min("fold").alias("_one"))
    known = rows.withColumn("_known", reduce(lambda a, c: a & F.col(c).isNotNull() & ~F.isnan(c), [*features, label], F.lit(True)))
    sessions = known.groupBy("ordinal").agg(F.max(F.col("_known").cast("int")).alias("_day"))
    # the first end at or after a session; one row a session and fold
    both = sessions.select("ordinal", "_day", F.lit(None).cast("long").alias("end")).unionByName(ends.select(F.col("train_last").alias("ordinal"), F.lit(0).alias("_day"), F.col("train_last").cast("long").alias("end")))
    behind = Window.orderBy(F.desc("ordinal"), F.desc_nulls_last("end")).rowsBetween(Window.unboundedPreceding, 0)
    dealt = both.withColumn("bucket", F.last("end", ignorenulls=True).over(behind))
    buckets = dealt.where("end is null and bucket is not null").select("ordinal", "bucket")
    grams = _grams(rows.join(F.broadcast(buckets), "ordinal"), features, label)  # one row a session
    dates = dealt.where("bucket is not null").groupBy("bucket").agg(F.sum("_day").alias("d")).select(F.col("bucket").alias("train_last"), F.sum("d").over(Window.orderBy("bucket")).alias("dates"))
    # every end has a line of zeros, so that a fold without new sessions has the sums so far
    size = len(features) + 2
    zeros = ends.select(F.col("train_last").cast("long").alias("bucket"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias("line")).withColumn("v", F.array_repeat(F.lit(0.0), size))

    def up_to(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bucket", kind="stable")
        sums = np.cumsum(np.stack(part.v.to_list()), axis=0)
        last = np.append(part.bucket.to_numpy()[1:] != part.bucket.to_numpy()[:-1], True)
        return pd.DataFrame({"train_last": part.bucket[last], "line": part.line[last], "v": list(sums[last])})

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        g = np.stack(part.sort_values("line").v.to_list())
        n = g[0, 0]
        if n < 1:
            return pd.DataFrame({"train_last": [], "rows": [], "intercept": [], "weights": pd.Series([], dtype=object)})
        mean = g[0, 1:] / n
        centred = g[1:, 1:] / n - np.outer(mean, mean)
        w = np.linalg.lstsq(centred[:-1, :-1], centred[:-1, -1], rcond=1e-12)[0]
        return pd.DataFrame({"train_last": [part.train_last.iloc[0]], "rows": [int(n)], "intercept": [mean[-1] - mean[:-1] @ w], "weights": [w.tolist()]})

    sums = grams.unionByName(zeros).groupBy("line").applyInPandas(up_to, "train_last long, line long, v array<double>")
    fits = sums.groupBy("train_last").applyInPandas(solve, "train_last long, rows long, intercept double, weights array<double>")
    enough = fits.join(dates, "train_last").where((F.col("rows") >= least_rows) & (F.col("dates") >= least_dates))
    return plan.withColumn("train_last", F.col("train_last").cast("long")).join(enough, "train_last").select("fold", "rows", "dates", "intercept", "weights")


def predicted(rows: DataFrame, features: list[str], fits: DataFrame) -> DataFrame:
    """rows(fold, features) with the prediction of their fold's fit; rows with a missing feature or without a fit are left
    out. One row a fold is broadcast."""
    value = reduce(lambda a, i: a + F.col("weights")[i] * F.col(features[i]), range(len(features)), F.col("intercept"))
    known = reduce(lambda a, c: a & F.col(c).isNotNull() & ~F.isnan(c), features, F.lit(True))
    return rows.where(known).join(F.broadcast(fits.select("fold", "intercept", "weights")), "fold").withColumn("prediction", value).drop("intercept", "weights")
