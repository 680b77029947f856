"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import mixed, slices, table, words


@dataclass(frozen=True)
class Settings:
    """bits: log2 of the feature space. sample: about as many labelled rows are learned from (the documented bound);
    alpha, beta, l1, l2: FTRL-proximal's rates and penalties; epochs: passes over the sample."""

    bits: int = 20
    sample: int = 20_000
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.0
    epochs: int = 4


def features(h: np.ndarray, row: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and row of every word, every two neighbours and every two words with one between them."""
    out, rows = [h], [row]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = row[gap:] == row[:-gap]
        out.append((h[:-gap] * np.uint64(salt) + h[gap:])[same])
        rows.append(row[gap:][same])
    return (mixed(np.concatenate(out)) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(rows)


class Ftrl:
    """Per-coordinate FTRL-proximal; the last coordinate is the bias, which has no penalty."""

    def __init__(self, s: Settings):
        self.s, self.z, self.n = s, np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        s, z, n = self.s, self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - s.l1, 0) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)

    def bias(self) -> float:
        return -self.z[-1] / ((self.s.beta + np.sqrt(self.n[-1])) / self.s.alpha)

    def learn(self, at: np.ndarray, y: int) -> None:
        w, b = self.weights(at), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - y
        at, w = np.r_[at, len(self.z) - 1], np.r_[w, b]
        grown = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (grown - np.sqrt(self.n[at])) / self.s.alpha * w
        self.n[at] += g * g


def per_row(part: pa.RecordBatch, data: np.ndarray, at: np.ndarray, bits: int) -> list[np.ndarray]:
    """The distinct features of each text."""
    h, row, _ = words(data, at)
    f, r = features(h, row, bits)
    key = np.unique(r << bits | f)
    return np.split(key & (1 << bits) - 1, np.searchsorted(key >> bits, np.arange(1, part.num_rows)))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and values of the weights that are not zero, and the bias.

    Learns from about s.sample labelled texts, taken by a hash of their id; the rows of one sample are one FTRL sequence, in
    the order of that hash, so the model does not depend on partitions. A doc_id labelled more than once counts as toxic if
    any label says so; null labels and ids do not count. Without labelled rows there are no weights and the bias is -4."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    number = known.count()
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    chosen = known.withColumn("order", order).where(F.col("order") < int((1 << 40) * min(1.0, s.sample / max(number, 1))))
    # about s.sample rows of three numbers
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.select("order", "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("long").alias("toxic")).repartition(1).sortWithinPartitions("order", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, int]] = []
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                seen += zip((x.astype(np.int32) for x in per_row(part, data, at, s.bits)), part.column("toxic").to_pylist(), strict=True)
        if not seen:
            return
        model = Ftrl(s)
        for _ in range(s.epochs):
            for at, y in seen:
                model.learn(at, int(y > 0))
        w = model.weights(slice(None, -1))
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(np.r_[-1, at]), pa.array(np.r_[model.bias(), w[at]])], names=["at", "w"])

    got = sample.mapInArrow(run, "at long, w double").toArrow()
    if not got.num_rows:
        return np.zeros(0, np.int64), np.zeros(0), -4.0
    places, values = (got.column(c).to_numpy() for c in ("at", "w"))  # one task wrote them, the bias first
    return places[1:], values[1:], float(values[0])


def scored(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with one more column, score (0 to 1, higher: more likely toxic), learned from `labels`(doc_id, toxic).

    Only the text is looked at. Null, empty and wordless texts score by the bias alone. Repeated rows stay, empty tables
    give no rows, a column named score is replaced. The weights (at most 2 ** bits, in practice some thousand) go to the
    tasks with the job."""
    places, values, bias = fit(docs, labels, s)
    schema = docs.drop("score").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << s.bits)
        table[places] = values
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                h, row, _ = words(data, at)
                f, r = features(h, row, s.bits)
                hit = table[f] != 0
                key = np.unique(r[hit] << s.bits | f[hit])
                total = bias + np.bincount(key >> s.bits, table[key & (1 << s.bits) - 1], part.num_rows)
                yield pa.record_batch([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))))], names=[*part.schema.names, "score"])

    return docs.drop("score").mapInArrow(run, schema)


def held_out() -> Column:
    """Ids that are not learned from: crc32 of the id as text is a multiple of 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(0)) == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    out = scored(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
