"""Steps of the algebra against pandas on a seeded panel with gaps, ties and constant windows."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketspark.functions import alphas as A
from marketspark.functions import kernels
from marketspark.functions.algebra import FIELDS, evaluate, layers, parse, sessions

DAYS, NAMES = pd.bdate_range("2020-01-02", periods=60), [f"N{i}" for i in range(6)]


def frames():
    r = np.random.default_rng(7)
    close = pd.DataFrame(10 * np.cumprod(1 + r.normal(0, 0.02, (60, 6)), axis=0), DAYS, NAMES)
    close.iloc[::7, 2] = np.nan
    close.iloc[10:20, 4] = 5.0
    volume = pd.DataFrame(r.integers(1, 6, (60, 6)).astype(float), DAYS, NAMES)
    return close, volume


@pytest.fixture(scope="module")
def panel(spark):
    close, volume = frames()
    long = close.stack(future_stack=True).rename("close").to_frame().join(volume.stack(future_stack=True).rename("volume")).reset_index(names=["date", "instrument"])
    rows = [(d.date(), n, None if np.isnan(c) else float(c), float(v), float(int(n[1:]) % 2)) for d, n, c, v in long.itertuples(index=False)]
    return spark.createDataFrame(rows, "date date, instrument string, close double, volume double, industry double").cache()


def got(panel, formula):
    out = evaluate(panel, {"x": parse(formula)}, ["date", "instrument"]).toPandas()
    return out.assign(date=pd.to_datetime(out["date"])).pivot(index="date", columns="instrument", values="x").astype(float)


def roll(x, n):
    return x.rolling(n, min_periods=n)


CASES = {
    "delay(close, 3)": lambda c, v: c.shift(3),
    "delta(close, 1.5)": lambda c, v: c.diff(2),
    "tsum(volume, 5)": lambda c, v: roll(v, 5).sum(),
    "mean(close, 5)": lambda c, v: roll(c, 5).mean(),
    "tmin(close, 4)": lambda c, v: roll(c, 4).min(),
    "tmax(close, 4)": lambda c, v: roll(c, 4).max(),
    "std(close, 6)": lambda c, v: roll(c, 6).std(),
    "product(volume, 4)": lambda c, v: roll(v, 4).apply(np.prod, raw=True),
    "argmax(volume, 6)": lambda c, v: roll(v, 6).apply(np.argmax, raw=True),
    "argmin(volume, 6)": lambda c, v: roll(v, 6).apply(np.argmin, raw=True),
    "trank(volume, 6)": lambda c, v: roll(v, 6).apply(lambda a: (a <= a[-1]).mean(), raw=True),
    "decay(close, 5)": lambda c, v: roll(c, 5).apply(lambda a: np.dot(a, [1, 2, 3, 4, 5]) / 15, raw=True),
    "cov(close, volume, 8)": lambda c, v: pd.DataFrame({n: c[n].rolling(8, min_periods=8).cov(v[n]) for n in c}),
    "rank(volume)": lambda c, v: v.rank(axis=1, pct=True),
    "rank(close)": lambda c, v: c.rank(axis=1, pct=True),
    "scale(close)": lambda c, v: c.div(c.abs().sum(axis=1), axis=0),
    "zscore(close)": lambda c, v: c.sub(c.mean(axis=1), axis=0).div(c.std(axis=1, ddof=0), axis=0),
    "neutral(close, industry)": lambda c, v: c - c.T.groupby([int(n[1:]) % 2 for n in c]).transform("mean").T,
    "winsor(close, 0.2, 0.8)": lambda c, v: c.clip(c.quantile(0.2, axis=1), c.quantile(0.8, axis=1), axis=0),
    "where(close > 10, 1, -1)": lambda c, v: (c > 10).astype(float) * 2 - 1,
    "larger(close, volume)": lambda c, v: pd.DataFrame(np.maximum(c, v)),
    "spow(close - 10, 2)": lambda c, v: np.sign(c - 10) * (c - 10) ** 2,
    "log(close - 10)": lambda c, v: np.log((c - 10).where(c > 10)),
}


@pytest.mark.parametrize("formula", CASES)
def test_step_equals_pandas(panel, formula):
    want = CASES[formula](*frames())
    np.testing.assert_allclose(got(panel, formula).to_numpy(), want.to_numpy(dtype=float), rtol=1e-8, atol=1e-9)


def test_correlation_of_a_constant_is_missing(panel):
    close, volume = frames()
    want = pd.DataFrame({n: close[n].rolling(6, min_periods=6).corr(volume[n]) for n in NAMES})
    have = got(panel, "corr(close, volume, 6)")
    assert have.iloc[15:20, 4].isna().all()
    rest = [n for n in NAMES if n != "N4"]
    np.testing.assert_allclose(have[rest].to_numpy(), want[rest].to_numpy(), atol=1e-8)


def test_window_lengths_round_half_to_even():
    assert [sessions(x) for x in (0.2, 1.2, 1.4, 1.5, 2.5)] == [1, 1, 1, 2, 2]


def test_the_future_never_changes_the_past(spark, panel):
    wide = panel.selectExpr("*", "close as open", "close as high", "close as low", "close as vwap", "close / 10 - 1 as returns", "close * volume as cap")
    ids = ["001", "006", "012", "045", "101"]
    cut = DAYS[39].date()
    whole = A.compute(wide, ids).where(f"date <= '{cut}'").toPandas().sort_values(["date", "instrument"], ignore_index=True)
    part = A.compute(wide.where(f"date <= '{cut}'").repartition(3), ids).toPandas().sort_values(["date", "instrument"], ignore_index=True)
    pd.testing.assert_frame_equal(whole, part, rtol=1e-9)


def test_all_alphas_are_there(panel):
    assert list(A.FORMULAS) == [f"{i:03d}" for i in range(1, 102)]
    assert sum(bool(A.needs(a)) for a in A.FORMULAS) == 19
    with pytest.raises(ValueError, match="cap"):
        A.compute(panel, ["056"])


def test_lines_in_stretches_equal_whole_ones(panel):
    wanted = {"a": parse("corr(rank(close), delay(volume, 3), 9)"), "b": parse("trank(decay(close, 5), 7) - argmax(close * volume, 8) + argmin(close * volume, 4) + std(1 + close, 3)"), "c": parse("delta(tsum(volume, 4), 6)")}
    columns = ["date", "instrument"]
    whole = evaluate(panel, wanted, columns).toPandas().sort_values(columns).reset_index(drop=True)
    cut_up = evaluate(panel, wanted, columns, chunk=5).toPandas().sort_values(columns).reset_index(drop=True)
    assert len(whole) == len(cut_up) and whole.notna().any().all()
    pd.testing.assert_frame_equal(whole, cut_up)


def test_shuffles_do_not_grow_with_the_number_of_formulas(panel):
    def shuffles(ids):
        wide = panel.withColumns({f: F.col("close") * 1.0 for f in FIELDS if f not in panel.columns})
        df = evaluate(wide, {f"alpha_{a}": A.expression(a) for a in ids}, ["date", "instrument"])
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert shuffles([*A.FORMULAS]) <= 10  # two for the calendar, one for each change of key
    assert shuffles([*A.FORMULAS]) <= max(map(shuffles, [["096"], ["073"], ["088"], ["029"]])) + 4


def test_groups_are_whole_over_batches():
    keys = [*"aaaabbc", None, None, "d"]
    table = pa.table({"k": keys, "v": list(range(len(keys)))})
    for size in (1, 2, 3, 10):
        got = []
        for part, starts in kernels.aligned(iter(table.to_batches(max_chunksize=size)), ["k"]):
            ends = [*starts[1:].tolist(), part.num_rows]
            got += [part.column("v").to_pylist()[i:j] for i, j in zip(starts.tolist(), ends, strict=True)]
        assert got == [[0, 1, 2, 3], [4, 5], [6], [7, 8], [9]]
    assert not list(kernels.aligned(iter([]), ["k"]))


def test_row_wise_steps_in_tasks_equal_those_in_columns(panel):
    """The same formulas once above and once below a rolling step of one session."""
    formulas = [
        "(close / delay(close, 1)) ** delay(close, 2)", "(close / close) ** delay(close, 1)", "delay(close, 3) ** 0", "spow(close - 10, delay(volume, 1))", "where(delay(close, 1) > close, close, -volume)", "flag(delay(close, 2) <= close)",
        "larger(delay(close, 1), close) - smaller(volume, delay(volume, 1))", "log(close - 10)", "sign(close - delay(close, 1)) * abs(volume - 3)", "volume / (volume - 3)", "where(volume >= 3, 1, 0) - flag(close < volume)",
    ]
    wanted = {f"a{i}": parse(f) for i, f in enumerate(formulas)} | {f"b{i}": parse(f"tmin({f}, 1)") for i, f in enumerate(formulas)}
    got = evaluate(panel, wanted, ["date", "instrument"]).toPandas()
    for i, f in enumerate(formulas):
        pd.testing.assert_series_equal(got[f"a{i}"], got[f"b{i}"], check_names=False, obj=f)
        assert got[f"a{i}"].notna().any(), f
