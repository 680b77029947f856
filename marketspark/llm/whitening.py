"""Whitening of embeddings by shifted CholeskyQR: Gram passes over the rows, small factors on the driver.

A row is n x - S, the vector x (of integers) less the mean, times n: whole numbers, so centring loses nothing. Each pass sums
the Gram matrix of the rows as they are after all triangular solves so far; its Cholesky factor R, of a Gram matrix shifted by
a little more than its rounding error, is the next solve. Small singular values grow by many digits a pass, so a few passes
give orthonormal rows, and the product of all R has the singular values and right vectors of the rows to double precision,
where one Gram matrix alone would lose half of the digits."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import table
from marketspark.operators.lineage import shared_folder

#: Rows of one matrix product in a task.
BLOCK = 4096
#: Passes at most. Two or three are the rule, more for vectors whose spreads differ by ten digits or more.
PASSES = 8


@dataclass
class Space:
    """What is known of the vectors of one length: n of them, sums of their components, and what whitens them."""

    n: int
    sums: list[int]
    factors: list[np.ndarray]
    components: np.ndarray  # one a row, by falling eigenvalue
    values: np.ndarray  # eigenvalues of the covariance
    trace: float = 0.0
    error: float = 0.0

    def whole(self, x: np.ndarray) -> np.ndarray:
        """n x - S of rows x; Python's integers where longs are too short."""
        sums = np.array(self.sums, dtype=object)
        most = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, self.sums), default=0)
        if most < 1 << 62:
            return x * np.int64(self.n) - sums.astype(np.int64)
        return x.astype(object) * self.n - sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.whole(x).astype(np.float64) / self.n

    def solved(self, x: np.ndarray) -> np.ndarray:
        """Centred rows after the triangular solves of all factors so far."""
        rows = self.centred(x).T
        for r in self.factors:
            rows = np.linalg.solve(r.T, rows) if len(r) > 1 else rows / r[0, 0]
        return rows.T

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.values)


def integers(embedding: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """floor(scale * c) + shift of each component c, taken as double; null where the vector or a component is null or not
    finite, or where the product is 2**62 or more, which no long would hold."""
    fine = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * scale) < 2.0**62))
    return F.when(fine, F.transform(embedding, lambda c: F.floor(c.cast("double") * scale) + shift))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors (one a row) of a batch by length, in blocks."""
    v = batch.column("x")
    size = v.value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == width)
        flat = v.take(pa.array(at)).flatten().to_numpy().reshape(-1, width)
        for i in range(0, len(at), BLOCK):
            yield at[i : i + BLOCK], flat[i : i + BLOCK]


def _summed(vectors: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """For each length the sum of part(rows), a matrix, over blocks of rows: summed in each task, then line by line of the
    matrix over the tasks. What reaches the driver is one matrix a length, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _rows(batch):
                got = part(x)
                total[x.shape[1]] = total[x.shape[1]] + got if x.shape[1] in total else got
        for width, m in total.items():
            yield pa.record_batch([pa.array([width] * len(m)), pa.array(range(len(m))), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["width", "line", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for width, line, v in zip(*(batch.column(c) for c in ("width", "line", "v")), strict=True):
                key, v = (width.as_py(), line.as_py()), v.values.to_numpy()
                total[key] = total[key] + v if key in total else v
        for (width, line), v in total.items():
            yield pa.record_batch([pa.array([width]), pa.array([line]), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["width", "line", "v"])

    schema = "width long, line long, v array<double>"
    lines = vectors.mapInArrow(run, schema).repartition("width", "line").mapInArrow(add, schema).toArrow().sort_by([("width", "ascending"), ("line", "ascending")])
    out: dict[int, list] = {}
    for width, v in zip(lines.column("width").to_pylist(), lines.column("v").to_pylist(), strict=True):
        out.setdefault(width, []).append(v)
    return {width: np.array(m) for width, m in out.items()}


def _counted(vectors: DataFrame) -> dict[int, Space]:
    """Number and exact sums of the vectors of each length. Halves of the longs are added apart, so no sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for _, x in _rows(batch):
                have = total.setdefault(x.shape[1], [0, 0, 0])
                total[x.shape[1]] = [have[0] + len(x), have[1] + (x >> 32).sum(axis=0), have[2] + (x & 0xFFFFFFFF).sum(axis=0)]
        for width, (n, high, low) in total.items():
            yield pa.record_batch([pa.array([width] * width), pa.array([n] * width), pa.array(range(width)), pa.array(high), pa.array(low)], names=["width", "n", "place", "high", "low"])

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    found = vectors.mapInArrow(run, "width long, n long, place long, high long, low long").groupBy("width", "place").agg(*wide).orderBy("width", "place").collect()
    out: dict[int, Space] = {}
    for x in found:  # width numbers for each length
        out.setdefault(x.width, Space(int(x.n), [], [], np.zeros((0, x.width)), np.zeros(0))).sums.append((int(x.high) << 32) + int(x.low))
    return out


def fit(vectors: DataFrame, most: int = 16) -> dict[int, Space]:
    """The spaces of distinct vectors(x), by length, each with its first `most` components."""
    spaces = _counted(vectors)
    open_ = dict(spaces)
    for turn in range(PASSES):
        if not open_:
            break

        def gram(x: np.ndarray) -> np.ndarray:
            rows = open_[x.shape[1]].solved(x) if x.shape[1] in open_ else np.zeros((0, x.shape[1]))  # noqa: B023
            return rows.T @ rows

        for width, g in _summed(vectors, gram).items():
            if width not in open_:
                continue
            s = open_[width]
            if not turn:
                s.trace = float(np.trace(g)) / s.n
            if not np.isfinite(g).all() or not s.trace:
                del open_[width]
                continue
            # what the product of all factors says about the rows, with what this pass has found last
            values, vectors_ = np.linalg.eigh(g)
            product = np.eye(width)
            for r in s.factors:
                product = r @ product
            _, sizes, right = np.linalg.svd(np.sqrt(np.maximum(values, 0))[:, None] * (vectors_.T @ product))
            live = sizes > sizes[0] * width * np.finfo(float).eps * 4
            if s.factors and (np.abs(values[-int(live.sum()) :] - 1) < 1e-6).all() or turn == PASSES - 1:
                first = min(most, int(live.sum()))
                s.components, s.values = right[:first], sizes[:first] ** 2 / s.n
                del open_[width]
                continue
            shift = 11 * width * np.finfo(float).eps * np.trace(g) if values[0] < 1e-3 * values[-1] else 0.0
            s.factors.append(np.linalg.cholesky(g + shift * np.eye(width)).T)
    return spaces


def _checked(vectors: DataFrame, spaces: dict[int, Space]) -> None:
    """Sets each space's error: the covariance of its whitened vectors, centred, less the identity."""

    def part(x: np.ndarray) -> np.ndarray:
        w = spaces[x.shape[1]].whitened(x)
        return np.vstack([w.sum(axis=0), w.T @ w])

    for width, m in _summed(vectors, part).items():
        s = spaces[width]
        mean = m[0] / s.n
        s.error = float(np.abs(m[1:] / s.n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))


def whitened(vectors: DataFrame, most: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of vectors(vec_id, x), x an array of
    longs as integers() makes it.

    Components are fitted on each distinct vector once, so copies change nothing, and every row is projected, repeated rows
    and rows without an id as well. Rows without x take no part. Vectors of different lengths are different spaces, each
    with an n, components and errors of its own. Directions without any spread have no component, so a space of equal
    vectors, like an empty table or vectors of length 0, gives no rows. A deviation that a long cannot hold is null. The
    distinct vectors are written once to the shared folder and read in each pass; the driver holds one matrix of
    length x length a space."""
    spark = vectors.sparkSession
    rows = vectors.where("x is not null").select("vec_id", "x")
    path = f"{shared_folder(spark).rstrip('/')}/whitening-{uuid.uuid4().hex}"
    rows.select("x").distinct().write.parquet(path)
    distinct = spark.read.parquet(path)
    spaces = fit(distinct, most)
    _checked(distinct, spaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _rows(batch):
                s = spaces[x.shape[1]]
                k = len(s.values)
                whole = s.whole(x)
                bound = max(abs(int(whole.max())), abs(int(whole.min())))
                if bound * bound * x.shape[1] < 1 << 63:
                    deviation = pa.array(np.repeat((whole.astype(np.int64) ** 2).sum(axis=1), k))
                else:
                    exact = (whole.astype(object) ** 2).sum(axis=1)
                    deviation = pa.array([y if y < 1 << 63 else None for y in exact for _ in range(k)], pa.int64())
                columns = [
                    batch.column("vec_id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(k * len(at), s.n)), deviation,
                    pa.array(s.whitened(x).ravel()), pa.array(np.tile(s.values / (s.trace or 1.0), len(at))), pa.array(np.full(k * len(at), s.error)),
                ]
                yield pa.record_batch(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), integers(F.col("embedding")).alias("x")))
