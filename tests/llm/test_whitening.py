"""op13 against a singular value decomposition of the exactly centred vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.llm import whitening


def plain(vectors, most=16):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} by numpy, sums by Python's integers."""
    seen = {tuple(v) for _, v in vectors}
    fit = sorted(seen)
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    a = np.array([[n * x - s for x, s in zip(v, sums, strict=True)] for v in fit], dtype=object).astype(np.float64) / n
    _, sizes, right = np.linalg.svd(a, full_matrices=False)
    live = int((sizes > sizes[0] * d * 1e-15).sum())
    e = sizes**2 / n
    out = {}
    for i, v in vectors:
        whole = [n * x - s for x, s in zip(v, sums, strict=True)]
        row = np.array([float(w) / n for w in whole])
        for c in range(min(most, live)):
            out[i, c + 1] = (n, sum(w * w for w in whole), abs(row @ right[c]) / math.sqrt(e[c]), e[c] / e.sum())
    return out


def compare(got, want, tolerance=1e-6):
    assert len(got) == len(want)
    for r in got:
        n, deviation, w, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation if deviation < 1 << 63 else None)
        assert abs(abs(r.whitened) - w) < tolerance * (1 + w) and abs(r.explained / explained - 1) < 1e-6 and r.identity_error < 1e-4


def test_components_of_ordinary_vectors(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(300, 20)) @ r.normal(size=(20, 20))
    x = np.floor(64 * base).astype(np.int64) + 1_000_000
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300 + i, x[5].tolist()) for i in range(200)]  # copies do not count
    df = spark.createDataFrame(rows, "vec_id long, x array<long>").repartition(5)
    compare(whitening.whitened(df).collect(), plain(rows))


def test_spreads_that_differ_by_ten_digits_and_dependent_dimensions(spark):
    r = np.random.default_rng(2)
    x = np.stack([r.integers(-(10**13), 10**13, 400), r.integers(-(10**9), 10**9, 400), r.integers(-50, 50, 400), r.integers(-3, 4, 400)], axis=1)
    x = np.concatenate([x, x[:, :1] + x[:, 1:2], np.full((400, 1), 7)], axis=1) + 1_000_000  # one dependent, one constant
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, x array<long>").repartition(3)).collect()
    assert max(g.component for g in got) == 4  # directions without spread have no component
    want = plain(rows)
    compare([g for g in got if g.component <= 3], {k: v for k, v in want.items() if k[1] <= 3}, 1e-4)
    assert all(g.deviation is None for g in got) and max(g.identity_error for g in got) < 1e-4


def test_fewer_vectors_than_dimensions(spark):
    r = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(r.integers(0, 1000, (10, 30)))]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, x array<long>")).collect()
    assert {g.component for g in got} == set(range(1, 10))
    compare(got, plain(rows))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25], 1), (2, [1.0, 2.0], 1), (2, [1.0, 2.0], 2), (None, [0.0, 0.0], 3), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [], 1), (8, [1.0], 1), (9, [3.0], 1), (10, [1e30, 2.0], 1), (11, [4.0] * 3, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long")
    x = df.select("vec_id", whitening.integers(F.col("embedding")).alias("x"), F.col("n").alias("width"), F.lit(1).alias("component"))
    got = whitening.whitened(x).collect()
    by = sorted((g.vec_id or 0, g.component, g.n) for g in got)
    # two dimensions: three distinct vectors, two components; one dimension: two vectors, one component; one vector alone: none
    assert by == [(0, 1, 3), (0, 2, 3), (1, 1, 3), (1, 2, 3), (2, 1, 3), (2, 1, 3), (2, 2, 3), (2, 2, 3), (8, 1, 2), (9, 1, 2)]
    assert [g.deviation for g in got if g.vec_id == 8] == [(2 * 64 - 256) ** 2]
    assert whitening.whitened(x.limit(0)).count() == 0


def test_integers_are_floors_of_doubles(spark):
    df = spark.createDataFrame([([0.1, -0.1, -1.0],)], "e array<float>")
    want = [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in (0.1, -0.1, -1.0)]
    assert df.select(whitening.integers(F.col("e"))).first()[0] == want


@pytest.mark.parametrize("scale", [1, 10**6])
def test_gram_passes_give_the_factor_of_one_decomposition(spark, scale):
    r = np.random.default_rng(4)
    x = r.integers(-100, 100, (200, 5)) * np.array([scale, 1, 1, 1, 1])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    spaces = whitening.fit(spark.createDataFrame(rows, "vec_id long, x array<long>").select("x").distinct())
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2 / len(x)
    assert np.allclose(spaces[5].values, want, rtol=1e-9)
