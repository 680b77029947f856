"""Rules of a risk overlay: labels of the session before, exposure and weight caps, comparison with a baseline, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds of the rules.
STRONG, OFF = 0.95, 0.70
MEDIAN_TIMES, MEDIAN_LEAST, MEDIAN_TINY = 1.5, 0.05, 0.01
P95_TIMES, P95_LEAST, P95_TINY = 2.5, 0.10, 0.02
BAND, LEAST_DAYS, HALT = (0.5, 1.5), 40, 0.20
EDGE = 1e-12


def open_sessions(sessions: DataFrame, holidays: DataFrame, suspensions: DataFrame) -> DataFrame:
    """sessions(book, date) without holidays(date) and the book's suspensions(book, date), with their ordinal from 0. Days
    that are shut have no place in the line, so what follows them comes right after what was before them."""
    left = sessions.select("book", "date").distinct().join(holidays.select("date").distinct(), "date", "left_anti")
    left = left.join(suspensions.select("book", "date").distinct(), ["book", "date"], "left_anti")
    return left.select("book", "date", (F.row_number().over(Window.partitionBy("book").orderBy("date")) - 1).alias("ordinal"))


def lagged_labels(open_days: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """book, date, label: the label(book, date, label) of the book's open session before, null if that had none; without
    labels every open session counts as on (1)."""
    known = open_days.join(labels.select("book", "date", "label"), ["book", "date"], "left") if labels is not None else open_days.withColumn("label", F.lit(1.0))
    return known.select("book", "date", F.lag("label", 1).over(Window.partitionBy("book").orderBy("date")).alias("label"))


def weight_cap(n: Column) -> Column:
    """Largest weight of a name in a universe of n: 1 / n + .05, .40 at most; none for an empty one."""
    return F.when(n > 0, F.least(1.0 / n + 0.05, F.lit(0.40))).otherwise(0.0)


def _limit(base: Column, times: float, least: float, tiny: float) -> Column:
    return F.when(base < tiny, F.lit(least)).otherwise(base * times)


def overlay_gates(
    weights: DataFrame, open_days: DataFrame, lagged: DataFrame, targets: DataFrame, daily: DataFrame, totals: DataFrame,
    strong: float = STRONG, off: float = OFF, band: tuple[float, float] = BAND, least: int = LEAST_DAYS, halt: float = HALT,
) -> DataFrame:
    """One row a book of totals(book, unlabeled, max_drawdown): failed (rules, comma-joined) and the figures they looked at.

    exposure: weights(book, date, instrument, weight) on an open session sum to no more than `strong` after a session that
    was on (label not 0) and `off` after one that was not; sessions without a label before them are not judged. weight: no
    name over weight_cap of the target universe, targets(book, n), which what is held never changes; size: no such n.
    median, p95: daily(book, date, metric, baseline, eligible) against a multiple of the baseline's, or an absolute bound
    where that is tiny. evidence: `least` eligible days; band: their metric within the band. derivatives: any unlabelled
    notional. halt: a drawdown beyond the bound. A rule without its figures is not judged, but evidence always is."""
    day = weights.where("weight is not null").groupBy("book", "date").agg(F.sum(F.abs("weight")).alias("gross"), F.max(F.abs("weight")).alias("peak"))
    day = day.join(open_days.select("book", "date"), ["book", "date"]).join(lagged, ["book", "date"], "left")
    cap = F.when(F.col("label").isNull() | F.isnan("label"), None).when(F.col("label") != 0, strong).otherwise(off)
    held = day.groupBy("book").agg(F.max(F.col("gross") - cap).alias("over"), F.max("peak").alias("peak"))
    half, high = F.lit(0.5), F.lit(0.95)
    outside = (F.col("metric") < band[0] - EDGE) | (F.col("metric") > band[1] + EDGE)
    figures = daily.groupBy("book").agg(
        F.percentile("metric", half).alias("median"), _limit(F.percentile("baseline", half), MEDIAN_TIMES, MEDIAN_LEAST, MEDIAN_TINY).alias("median_limit"),
        F.percentile("metric", high).alias("p95"), _limit(F.percentile("baseline", high), P95_TIMES, P95_LEAST, P95_TINY).alias("p95_limit"),
        F.sum(F.col("eligible").cast("long")).alias("days"), F.sum((F.col("eligible") & outside).cast("long")).alias("outside"),
    )
    rows = totals.join(held, "book", "left").join(targets.select("book", "n"), "book", "left").join(figures, "book", "left").withColumns({"cap": weight_cap(F.col("n")), "days": F.coalesce("days", F.lit(0))})
    broken = {
        "halt": F.abs("max_drawdown") > halt + EDGE, "exposure": F.col("over") > EDGE, "size": F.col("peak").isNotNull() & F.col("n").isNull(), "weight": F.col("n").isNotNull() & (F.col("peak") > F.col("cap") + EDGE),
        "median": F.col("median") > F.col("median_limit") + EDGE, "p95": F.col("p95") > F.col("p95_limit") + EDGE,
        "evidence": F.col("days") < least, "band": (F.col("days") >= least) & (F.col("outside") > 0), "derivatives": F.col("unlabeled") > EDGE,
    }
    failed = F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in broken.items()])), ",")
    return rows.select("book", failed.alias("failed"), "over", "peak", "cap", "median", "median_limit", "p95", "p95_limit", "days")
