"""Queries over the panel: the algebra, the alphas and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.functions import alphas as A
from marketspark.functions.algebra import CROSS, Expr, evaluate, parse
from marketspark.operators import evaluation as E
from marketspark.plans import duck
from marketspark.plans.inputs import PANEL, panel, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Formulas that show each step of the algebra on the panel.
STEPS = {
    "ops_rolling": {
        "delay_3": "delay(close, 3)", "delta_3": "delta(close, 3)", "sum_5": "tsum(volume, 5)", "mean_5": "mean(close, 5)", "adv_20": "adv(20)", "min_5": "tmin(low, 5)",
        "max_5": "tmax(high, 5)", "std_5": "std(returns, 5)", "product_5": "product(1 + returns, 5)", "argmax_8": "argmax(high, 8)", "argmin_8": "argmin(low, 8)",
        "trank_8": "trank(close, 8)", "decay_6": "decay(vwap, 6)", "window_rounding": "delta(close, 1.5)",
    },
    "ops_pairs": {"corr_10": "corr(open, volume, 10)", "cov_10": "cov(close, vwap, 10)", "corr_rank": "corr(rank(high), rank(volume), 5)"},
    "ops_cross": {
        "rank_close": "rank(close)", "scale_returns": "scale(returns)", "neutral_close": "neutral(close, industry)", "winsor_returns": "winsor(returns, 0.01, 0.99)",
        "zscore_returns": "zscore(returns)", "prepared_returns": "zscore(winsor(returns, 0.01, 0.99))",
    },
    "ops_elementwise": {
        "spow_2": "spow(returns, 2)", "spow_col": "spow(returns, returns)", "sign_returns": "sign(returns)", "log_returns": "log(returns)", "abs_returns": "abs(returns)",
        "where_missing": "where(returns > 0, 1, -1)", "larger_missing": "larger(returns, delay(returns, 1))", "smaller_missing": "smaller(returns, delay(returns, 1))", "flag_missing": "flag(returns < 0)",
    },
}


#: Moves exact halves off the rounding edge, alike in all engines.
EDGE = 1.000000001


def shown(x: str) -> Column:
    """About six digits, in classes of size, so that sums in another order print alike; beyond 1e9 the signed logarithm."""
    c = F.col(x) * EDGE
    size = F.abs(c)
    made = F.when(size < 10, F.round(c, 5)).when(size < 1e4, F.round(c, 3)).when(size < 1e9, F.round(c, 0)).otherwise(F.signum(c) * F.round(F.ln(size), 4))
    return F.when(F.round(c, 5) == 0, 0.0).otherwise(made).alias(x)


def shown_sql(x: str) -> str:
    c = f"({x} * {EDGE})"
    return f"CASE WHEN round({c}, 5) = 0 THEN 0.0 WHEN abs({c}) < 10 THEN round({c}, 5) WHEN abs({c}) < 1e4 THEN round({c}, 3) WHEN abs({c}) < 1e9 THEN round({c}, 0) ELSE sign({c}) * round(ln(abs({c})), 4) END AS {x}"


def _register_expressions(name: str, exprs: dict) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate(panel(spark, sf_dir), exprs, ["date", "instrument"]).select("date", "instrument", *map(shown, exprs))

    ctes, _ = duck.evaluated(exprs)
    QUERIES[name] = run
    ORACLES[name] = sql(f"{PANEL},\n{ctes}", f"SELECT date, instrument, {', '.join(map(shown_sql, exprs))} FROM evaluated")


for _name, _formulas in STEPS.items():
    _register_expressions(_name, {n: parse(f) for n, f in _formulas.items()})
for _i in range(0, 101, 10):
    _ids = list(A.FORMULAS)[_i : _i + 10]
    _register_expressions(f"alphas_{_ids[0]}_{_ids[-1]}", {f"alpha_{a}": A.expression(a) for a in _ids})

#: Alphas that the evaluation queries look at.
CHOSEN = ["006", "009", "012", "041", "054", "101"]
_NAMES = [f"alpha_{a}" for a in CHOSEN]


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.forward_returns(panel(spark, sf_dir))
    values = evaluate(p, {f"alpha_{a}": A.expression(a) for a in CHOSEN}, ["date", "instrument", "fwd_1", "fwd_5", "fwd_10"])
    return E.clean_factors(E.prepared(values, _NAMES), _NAMES)


def _clean_sql(ids: list[str] = CHOSEN) -> str:
    names = [f"alpha_{a}" for a in ids]
    ctes, _ = duck.evaluated({f"alpha_{a}": A.expression(a) for a in ids})
    w = "PARTITION BY instrument ORDER BY date"
    fwd = ", ".join(f"lead(close, {p}) OVER ({w}) / nullif(close, 0) - 1 AS fwd_{p}" for p in (1, 5, 10))
    wins = ", ".join(f"{duck.cross('winsor', n, value=(0.01, 0.99))} AS {n}" for n in names)
    zs = ", ".join(f"{duck.cross('zscore', n)} AS {n}" for n in names)
    edges = "list_distinct(list_transform(quantile_cont(factor, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) OVER (PARTITION BY alpha_id, date), lambda v: round(v, 9)))"
    return f"""{PANEL},
{ctes},
ahead AS (SELECT date, instrument, {', '.join(names)}, {fwd} FROM evaluated),
clipped AS (SELECT date, instrument, fwd_1, fwd_5, fwd_10, {wins} FROM ahead),
standard AS (SELECT date, instrument, fwd_1, fwd_5, fwd_10, {zs} FROM clipped),
stacked AS (
  SELECT date, instrument, fwd_1, fwd_5, fwd_10, alpha_id, round(factor, 9) AS factor
  FROM standard UNPIVOT (factor FOR alpha_id IN ({', '.join(names)}))
),
edged AS (SELECT *, list_sort({edges}) AS edges FROM stacked),
clean AS (
  SELECT date, instrument, alpha_id, factor, fwd_1, fwd_5, fwd_10,
         CASE WHEN len(edges) > 1 THEN CAST(len(list_filter(edges[2:len(edges) - 1], lambda v: v < factor)) + 1 AS INTEGER) END AS quantile
  FROM edged WHERE coalesce(fwd_1, fwd_5, fwd_10) IS NOT NULL
)"""


CLEAN = _clean_sql()


def factor_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(spark, sf_dir).select("date", "instrument", "alpha_id", "quantile", *map(shown, ("factor", "fwd_1", "fwd_5", "fwd_10")))


QUERIES["factor_clean"] = factor_clean
ORACLES["factor_clean"] = sql(CLEAN, f"SELECT date, instrument, alpha_id, quantile, {', '.join(map(shown_sql, ('factor', 'fwd_1', 'fwd_5', 'fwd_10')))} FROM clean")

_IC = """
ic AS (
  SELECT * FROM (
    SELECT alpha_id, date, CASE WHEN count(*) >= 3 AND var_pop(factor) > 1e-18 AND var_pop(fwd_1) > 1e-18
      THEN covar_pop(factor, fwd_1) / (sqrt(var_pop(factor)) * sqrt(var_pop(fwd_1))) END AS ic
    FROM clean WHERE fwd_1 IS NOT NULL GROUP BY alpha_id, date) WHERE ic IS NOT NULL
)"""
_GATES = CLEAN + "," + _IC + """,
ics AS (SELECT alpha_id, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic), 0) AS ic_ir FROM ic GROUP BY alpha_id),
means AS (SELECT alpha_id, quantile, avg(fwd_1) AS m FROM clean WHERE quantile IS NOT NULL AND fwd_1 IS NOT NULL GROUP BY alpha_id, quantile),
spreads AS (SELECT alpha_id, arg_max(m, quantile) - arg_min(m, quantile) AS quantile_spread FROM means GROUP BY alpha_id),
days AS (SELECT alpha_id, date, row_number() OVER (PARTITION BY alpha_id ORDER BY date) AS nth FROM (SELECT DISTINCT alpha_id, date FROM clean)),
nths AS (SELECT c.alpha_id, c.instrument, c.date, c.quantile, d.nth FROM clean c JOIN days d ON c.alpha_id = d.alpha_id AND c.date = d.date),
pairs AS (SELECT a.alpha_id, a.date, CASE WHEN a.quantile <> b.quantile THEN 1.0 ELSE 0.0 END AS moved
  FROM nths a JOIN nths b ON a.alpha_id = b.alpha_id AND a.instrument = b.instrument AND a.nth = b.nth + 1
  WHERE a.quantile IS NOT NULL AND b.quantile IS NOT NULL),
turns AS (SELECT alpha_id, avg(share) AS turnover FROM (SELECT alpha_id, date, avg(moved) AS share FROM pairs GROUP BY alpha_id, date) GROUP BY alpha_id),
gates AS (
  SELECT i.alpha_id, ic_mean, ic_ir, quantile_spread, turnover,
         coalesce(abs(ic_mean) >= 0.02, false) AND coalesce(abs(ic_ir) >= 0.5, false) AND coalesce(quantile_spread > 0, false) AS passed,
         array_to_string(list_filter([CASE WHEN NOT coalesce(abs(ic_mean) >= 0.02, false) THEN 'ic_mean' END, CASE WHEN NOT coalesce(abs(ic_ir) >= 0.5, false) THEN 'ic_ir' END,
           CASE WHEN NOT coalesce(quantile_spread > 0, false) THEN 'quantile_spread' END], lambda r: r IS NOT NULL), ',') AS reasons
  FROM ics i LEFT JOIN spreads s ON i.alpha_id = s.alpha_id LEFT JOIN turns t ON i.alpha_id = t.alpha_id
)"""
_REPORT = ("ic_mean", "ic_ir", "quantile_spread", "turnover")


def _report(records: DataFrame, *more: str) -> DataFrame:
    return records.select("alpha_id", "passed", F.array_join("reasons", ",").alias("reasons"), *map(shown, _REPORT), *more)


def factor_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ic_series(clean(spark, sf_dir)).select("alpha_id", "date", shown("ic"))


def factor_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(E.gates(clean(spark, sf_dir)))


def prepared_alphas(spark: SparkSession, sf_dir: str, ids: list[str]) -> DataFrame:
    """Clean factors of any alphas: formulas, clipping and standardising are layers of one evaluation."""
    wanted = {f"alpha_{a}": Expr(CROSS, "zscore", (Expr(CROSS, "winsor", (A.expression(a),), (0.01, 0.99)),)) for a in ids}
    values = evaluate(E.forward_returns(panel(spark, sf_dir)), wanted, ["date", "instrument", "fwd_1", "fwd_5", "fwd_10"])
    return E.clean_factors(values, [*wanted])


def library_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 101 alphas judged in one evaluation."""
    return _report(E.gates(prepared_alphas(spark, sf_dir, [*A.FORMULAS])))


def factor_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(E.ranked_library(E.gates(clean(spark, sf_dir))), F.col("place").cast("long").alias("place"))


def factor_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign kept for each alpha; the negation of a failed one is judged again."""
    return E.retried(clean(spark, sf_dir)).select("alpha_id", "passed", "sign", shown("ic_mean"), shown("ic_ir"))


def factor_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.target_book(clean(spark, sf_dir).where("alpha_id = 'alpha_101'"), 5).select("date", "instrument", shown("factor"), shown("weight"))


def rank_ic_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.daily_rank_ic(clean(spark, sf_dir), ["alpha_id", "date"], "factor", "fwd_5").where("rank_ic is not null").select("alpha_id", "date", shown("rank_ic"), F.col("n").cast("long"))


def rank_ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = E.daily_rank_ic(clean(spark, sf_dir), ["alpha_id", "date"], "factor", "fwd_5")
    return E.rank_ic_summary(daily, ["alpha_id"]).select("alpha_id", shown("ic_mean"), shown("ic_ir"), F.col("sessions").cast("long"))


_RANKS = """
known AS (SELECT * FROM clean WHERE fwd_5 IS NOT NULL),
ranked AS (
  SELECT alpha_id, date,
    (rank() OVER (PARTITION BY alpha_id, date ORDER BY factor) + count(*) OVER (PARTITION BY alpha_id, date) - rank() OVER (PARTITION BY alpha_id, date ORDER BY factor DESC) + 1) / 2.0 AS x,
    (rank() OVER (PARTITION BY alpha_id, date ORDER BY round(fwd_5, 9)) + count(*) OVER (PARTITION BY alpha_id, date) - rank() OVER (PARTITION BY alpha_id, date ORDER BY round(fwd_5, 9) DESC) + 1) / 2.0 AS y
  FROM known
),
daily AS (
  SELECT * FROM (SELECT alpha_id, date, count(*) AS n, CASE WHEN count(*) >= 5 AND var_pop(x) > 1e-18 AND var_pop(y) > 1e-18
    THEN covar_pop(x, y) / (sqrt(var_pop(x)) * sqrt(var_pop(y))) END AS rank_ic FROM ranked GROUP BY alpha_id, date) WHERE rank_ic IS NOT NULL
)"""

#: Both signs of every alpha as alphas of their own; the bins of the negated one lie between its negated edges.
_RETRIED = CLEAN + """, signed AS (SELECT date, instrument, alpha_id || '|1' AS alpha_id, factor, fwd_1, quantile FROM clean
  UNION ALL SELECT date, instrument, alpha_id || '|-1', -factor, fwd_1, CASE WHEN len(edges) > 1 THEN CAST(len(list_filter(edges[2:len(edges) - 1], lambda v: -v < -factor)) + 1 AS INTEGER) END
  FROM edged WHERE coalesce(fwd_1, fwd_5, fwd_10) IS NOT NULL)""" + _GATES.removeprefix(CLEAN).replace("FROM clean", "FROM signed") + """,
kept AS (SELECT split_part(alpha_id, '|', 1) AS alpha_id, CAST(split_part(alpha_id, '|', 2) AS INTEGER) AS sign, passed, ic_mean, ic_ir FROM gates QUALIFY row_number() OVER (PARTITION BY split_part(alpha_id, '|', 1) ORDER BY passed DESC, CAST(split_part(alpha_id, '|', 2) AS INTEGER) DESC) = 1)"""

QUERIES |= {"library_gates": library_gates, "factor_ic": factor_ic, "factor_gates": factor_gates, "factor_library": factor_library, "factor_retry": factor_retry, "factor_book": factor_book, "rank_ic_daily": rank_ic_daily, "rank_ic_summary": rank_ic_summary}
_SHOWN = ", ".join(map(shown_sql, _REPORT))
ORACLES |= {
    "library_gates": sql(_GATES.replace(CLEAN, _clean_sql([*A.FORMULAS])).replace("FROM ics i", "FROM (SELECT DISTINCT alpha_id FROM clean) a LEFT JOIN ics USING (alpha_id)").replace("i.alpha_id", "a.alpha_id"), f"SELECT alpha_id, passed, reasons, {_SHOWN} FROM gates"),
    "factor_ic": sql(CLEAN + "," + _IC, f"SELECT alpha_id, date, {shown_sql('ic')} FROM ic"),
    "factor_gates": sql(_GATES, f"SELECT alpha_id, passed, reasons, {_SHOWN} FROM gates"),
    "factor_library": sql(_GATES, f"SELECT alpha_id, passed, reasons, {_SHOWN}, row_number() OVER (ORDER BY abs(coalesce(ic_mean, 0)) DESC, alpha_id) AS place FROM gates"),
    "factor_retry": sql(_RETRIED, f"SELECT alpha_id, passed, sign, {shown_sql('ic_mean')}, {shown_sql('ic_ir')} FROM kept"),
    "factor_book": sql(
        CLEAN,
        f"""SELECT date, instrument, {shown_sql('factor')}, round(1.0 / count(*) OVER (), 6) AS weight FROM (
  SELECT * FROM clean WHERE alpha_id = 'alpha_101' AND date = (SELECT max(date) FROM clean WHERE alpha_id = 'alpha_101') ORDER BY factor DESC, instrument LIMIT 5)""",
    ),
    "rank_ic_daily": sql(CLEAN + "," + _RANKS, f"SELECT alpha_id, date, {shown_sql('rank_ic')}, n FROM daily"),
    "rank_ic_summary": sql(
        CLEAN + "," + _RANKS,
        f"""SELECT alpha_id, {shown_sql('ic_mean')}, {shown_sql('ic_ir')}, sessions FROM (
  SELECT alpha_id, avg(rank_ic) AS ic_mean, avg(rank_ic) / nullif(round(stddev_pop(rank_ic), 12), 0) AS ic_ir, count(*) AS sessions FROM daily GROUP BY alpha_id)""",
    ),
}
