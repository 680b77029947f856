"""Factor evaluation: forward returns, quantiles, information coefficients, gates and the factor library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions.algebra import cross, evaluate, parse
from marketspark.operators.lineage import cut
from marketspark.operators.panel import line

HORIZONS = (1, 5, 10)


def prepared(panel: DataFrame, names: list[str], limits: tuple[float, float] = (0.01, 0.99), winsorize: bool = True, zscore: bool = True) -> DataFrame:
    """Each named factor clipped to its date's quantiles, then standardised within the date (ddof 0)."""
    for step, on in (("winsor", winsorize), ("zscore", zscore)):
        if on:
            panel = panel.withColumns({n: cross(step, F.col(n), value=limits) for n in names})
    return panel


def forward_returns(panel: DataFrame, periods: tuple[int, ...] = HORIZONS) -> DataFrame:
    """fwd_<p>: close p sessions ahead over close, less one; on the dense panel."""
    return panel.withColumns({f"fwd_{p}": F.try_divide(F.lead("close", p).over(line()), "close") - 1 for p in periods})


def quantile_labels(x: Column, keys: list[str], q: int = 5) -> Column:
    """1 to k of right-closed bins between the group's linear quantiles; equal edges are one; null if all values are."""
    day = Window.partitionBy(*keys)
    edges = F.array_distinct(F.transform(F.percentile(x, F.array(*[F.lit(i / q) for i in range(q + 1)])).over(day), lambda v: F.round(v, 9)))
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(x.isNotNull() & (F.size(edges) > 1), (F.size(F.filter(inner, lambda v: v < F.round(x, 9))) + 1).cast("int"))


def stacked(factors: DataFrame, names: list[str]) -> DataFrame:
    """Wide factors as rows: date, instrument, the other columns, alpha_id, factor (rounded to nine digits, nulls left out)."""
    rest = [c for c in factors.columns if c not in names]
    return factors.unpivot(rest, names, "alpha_id", "factor").withColumn("factor", F.round("factor", 9)).where("factor is not null")


def clean_factors(factors: DataFrame, names: list[str], periods: tuple[int, ...] = HORIZONS, quantiles: int = 5) -> DataFrame:
    """factors with fwd_* columns -> date, instrument, alpha_id, factor, fwd_*, quantile. Rows without a factor go first,
    then, after binning, rows without any forward return."""
    fwd = [f"fwd_{p}" for p in periods]
    rows = stacked(factors.select("date", "instrument", *fwd, *names), names)
    return rows.withColumn("quantile", quantile_labels(F.col("factor"), ["alpha_id", "date"], quantiles)).where(F.coalesce(*fwd).isNotNull())


def safe_corr(x: str, y: str, least: int = 3) -> Column:
    """Pearson over rows where both are known, as an aggregate; null below `least` pairs or without spread."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.when((F.var_pop(a) > 1e-18) & (F.var_pop(b) > 1e-18), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))
    return F.when(F.count(a) >= least, F.covar_pop(a, b) / spread)


def ic_series(clean: DataFrame, period: int = 1) -> DataFrame:
    return clean.groupBy("alpha_id", "date").agg(safe_corr("factor", f"fwd_{period}").alias("ic")).where("ic is not null")


def quantile_spread(clean: DataFrame, period: int = 1) -> DataFrame:
    """Pooled mean forward return of the top quantile less that of the bottom one."""
    known = clean.where(f"quantile is not null and fwd_{period} is not null")
    means = known.groupBy("alpha_id", "quantile").agg(F.avg(f"fwd_{period}").alias("m"))
    return means.groupBy("alpha_id").agg((F.max_by("m", "quantile") - F.min_by("m", "quantile")).alias("quantile_spread"))


def turnover(clean: DataFrame) -> DataFrame:
    """Mean over dates of the share of names whose quantile changed since the previous date that is present."""
    days = clean.select("alpha_id", "date").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("alpha_id").orderBy("date")))
    w = Window.partitionBy("alpha_id", "instrument").orderBy("nth")
    moved = clean.join(days, ["alpha_id", "date"]).withColumn("was", F.when(F.lag("nth").over(w) == F.col("nth") - 1, F.lag("quantile").over(w)))
    daily = moved.where("was is not null and quantile is not null").groupBy("alpha_id", "date").agg(F.avg((F.col("was") != F.col("quantile")).cast("double")).alias("share"))
    return daily.groupBy("alpha_id").agg(F.avg("share").alias("turnover"))


def gates(clean: DataFrame, period: int = 1, ic_mean: float = 0.02, ic_ir: float = 0.5) -> DataFrame:
    """One record per alpha: passed, ic_mean, ic_ir, quantile_spread, turnover, reasons. The clean factors are read by all
    parts, so they are cut once."""
    clean = cut(clean.select("alpha_id", "date", "instrument", "factor", "quantile", f"fwd_{period}"))
    ic = ic_series(clean, period).groupBy("alpha_id").agg(F.avg("ic").alias("ic_mean"), F.try_divide(F.avg("ic"), F.nullif(F.stddev_samp("ic"), F.lit(0.0))).alias("ic_ir"))
    out = clean.select("alpha_id").distinct()
    for part in (ic, quantile_spread(clean, period), turnover(clean)):
        out = out.join(part, "alpha_id", "left")
    tests = {"ic_mean": F.abs("ic_mean") >= ic_mean, "ic_ir": F.abs("ic_ir") >= ic_ir, "quantile_spread": F.col("quantile_spread") > 0}
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]))
    return out.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def retried(panel_clean: DataFrame) -> DataFrame:
    """Gate records of every alpha and, where it fails, of its negation; the sign kept is the one that passes."""
    panel_clean = cut(panel_clean.select("alpha_id", "date", "instrument", "factor", "quantile", "fwd_1"))
    first = cut(gates(panel_clean).withColumn("sign", F.lit(1)))
    failed = panel_clean.join(first.where("not passed").select("alpha_id"), "alpha_id", "left_semi")
    turned = failed.withColumn("factor", -F.col("factor")).withColumn("quantile", quantile_labels(F.col("factor"), ["alpha_id", "date"]))
    second = gates(turned).withColumn("sign", F.lit(-1))
    both = first.unionByName(second)
    best = F.row_number().over(Window.partitionBy("alpha_id").orderBy(F.desc("passed"), F.desc("sign")))
    return both.withColumn("_best", best).where("_best = 1").drop("_best")


def ranked_library(records: DataFrame) -> DataFrame:
    """place by falling |ic_mean| (unknown counts as 0), then alpha_id."""
    return records.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs(F.coalesce("ic_mean", F.lit(0.0)))), "alpha_id")))


def target_book(factor: DataFrame, n_long: int = 10) -> DataFrame:
    """instrument, weight: equal weights of the highest factors on the latest date that has any."""
    last = factor.where("factor is not null").agg(F.max("date").alias("date"))
    best = factor.where("factor is not null").join(F.broadcast(last), "date").orderBy(F.desc("factor"), "instrument").limit(n_long)
    return best.select("date", "instrument", "factor", (F.lit(1.0) / F.count("*").over(Window.partitionBy("date"))).alias("weight"))


def average_ranks(x: str, keys: list[str]) -> Column:
    """Average rank of the known values within the keys."""
    return cross("rank", F.col(x), by=keys) * F.count(F.round(x, 9)).over(Window.partitionBy(*keys))


def daily_rank_ic(rows: DataFrame, keys: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """Spearman correlation of each date's pairs; null below `least` pairs."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranks = known.withColumns({"_x": average_ranks(x, keys), "_y": average_ranks(y, keys)})
    return ranks.groupBy(*keys).agg(safe_corr("_x", "_y", least).alias("rank_ic"), F.count("*").alias("n"))


def rank_ic_summary(daily: DataFrame, keys: list[str]) -> DataFrame:
    """mean, ir (ddof 0) and sessions of daily_rank_ic."""
    known = daily.where("rank_ic is not null")
    return known.groupBy(*keys).agg(F.avg("rank_ic").alias("ic_mean"), F.try_divide(F.avg("rank_ic"), F.nullif(F.round(F.stddev_pop("rank_ic"), 12), F.lit(0.0))).alias("ic_ir"), F.count("*").alias("sessions"))


def momentum_diagnosis(index: DataFrame, lookback: int = 26, skip: int = 4, horizon: int = 4, quantiles: int = 5) -> DataFrame:
    """index(book, date, nav): rank IC of skipped momentum against the forward return, means and shares while it is on or
    off, and the spread of mean forward returns between the top and bottom quantile."""
    w = Window.partitionBy("book").orderBy("date")
    signals = index.withColumn("signal", F.try_divide(F.lag("nav", skip).over(w), F.lag("nav", lookback).over(w)) - 1)
    signals = signals.withColumn("forward", F.try_divide(F.lead("nav", horizon).over(w), "nav") - 1).where("signal is not null and forward is not null")
    rows = signals.withColumns({"rx": average_ranks("signal", ["book"]), "ry": average_ranks("forward", ["book"]), "bin": quantile_labels(F.col("signal"), ["book"], quantiles)})
    on = F.col("signal") > 0
    main = rows.groupBy("book").agg(
        safe_corr("rx", "ry").alias("ic"), F.count("*").alias("n"), F.avg(on.cast("double")).alias("on_share"),
        F.avg(F.when(on, F.col("forward"))).alias("on_mean"), F.avg(F.when(~on, F.col("forward"))).alias("off_mean"),
    )
    bins = rows.groupBy("book", "bin").agg(F.avg("forward").alias("m")).groupBy("book").agg((F.max_by("m", "bin") - F.min_by("m", "bin")).alias("spread"))
    return main.join(bins, "book")


def rank_label(rows: DataFrame, value: str, keys: list[str]) -> Column:
    """Percent rank within the date, less one half."""
    return cross("rank", F.col(value), by=keys) - 0.5


def computed(panel: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """Any named formulas of the algebra, beside the panel's own columns."""
    return evaluate(panel, {n: parse(f) for n, f in formulas.items()})


