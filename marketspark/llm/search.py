"""Exact top-k inner products by MaxScore over the components of integer vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.llm.common import table

#: Vectors of one block and queries of one block: both bound what a task holds.
SHARD, QUERIES = 8192, 8192
#: Rows of a block between which the threshold rises.
CHUNK = 1024


def integers(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, taken as double; null where the vector or a component is null or not finite, or
    where a component is over sqrt(2**62 / width): the score of two such vectors would not fit a long."""
    scaled = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))
    most = F.sqrt(F.lit(2.0**62) / F.size(embedding))
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < most - 1))
    return F.when(fine, scaled)


class Postings:
    """The vectors of one block, longest first, in chunks of CHUNK rows: for each component a posting list of a chunk, with its
    least and greatest value there."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, -(vectors * vectors).sum(axis=1)))
        self.ids, self.lists = ids[order], np.ascontiguousarray(vectors[order].T)
        self.starts = range(0, len(ids), CHUNK)
        self.low = [self.lists[:, i : i + CHUNK].min(axis=1) for i in self.starts]
        self.high = [self.lists[:, i : i + CHUNK].max(axis=1) for i in self.starts]

    def search(self, query: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows that score `least` or more, ties to the smaller id.

        Chunks are searched in turn. Once k rows are found the k-th score is the threshold, so it rises as results come, and
        each chunk splits its terms anew by it: chunks whose bounds stay under it are passed over."""
        at, got = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, low, high in zip(self.starts, self.low, self.high, strict=True):
            found, scores = self._chunk(self.lists[:, i : i + CHUNK], low, high, query, least)
            if not len(found):
                continue
            at, got = np.concatenate([at, found + i]), np.concatenate([got, scores])
            if len(at) >= k:
                top = np.lexsort((self.ids[at], -got))[:k]
                at, got = at[top], got[top]
                least = max(least, int(got[-1]))
        top = np.lexsort((self.ids[at], -got))
        return at[top], got[top]

    @staticmethod
    def _chunk(lists: np.ndarray, low: np.ndarray, high: np.ndarray, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a chunk that score `least` or more, and their scores.

        A term's contribution is counted from its lowest value in the chunk, so that all are zero or more. Terms are ordered
        by their bound; those whose bounds together cannot lift a row to the threshold are non-essential. The essential
        lists are traversed; rows that stay competitive are probed in the others, the largest bound first."""
        ends = np.stack([query * low, query * high])
        floor, bounds = ends.min(axis=0), np.abs(ends[1] - ends[0])
        base, order = int(floor.sum()), np.argsort(bounds, kind="stable")
        reach = np.cumsum(bounds[order])
        if base + int(bounds.sum()) < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        optional = int(np.searchsorted(base + reach, least, "left"))  # bounds[:optional] together stay under the threshold
        essential, others = order[optional:], order[:optional][::-1]
        at = np.arange(lists.shape[1])
        got = query[essential] @ lists[essential] - floor[essential].sum() + base if len(essential) else np.full(len(at), base)
        rest = int(reach[optional - 1]) if optional else 0
        for i, term in enumerate(others):
            if i % 4 == 0:  # drop what is out of reach
                competitive = got + rest >= least
                at, got = at[competitive], got[competitive]
                if not len(at):
                    return at, got
            got = got + query[term] * lists[term][at] - floor[term]
            rest -= int(bounds[term])
        best = got >= least
        return at[best], got[best]


def top(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, asked: int = QUERIES) -> DataFrame:
    """For each row of queries(vec_id, v) its k rows of vectors(vec_id, v) with the greatest inner product, one row equal to
    the query (itself) left out: query_id, rank from 1, vec_id, score; ties go to the smaller vec_id. v: arrays of longs as
    integers() makes them; only vectors of the query's own length are candidates.

    Both sides are dealt by row in blocks of bounded size: a task holds one block of vectors and one of queries, a square
    grid of them. Each block pair gives at most k + 1 rows a query; their merge keeps k. A query with fewer candidates gets
    all of them. Rows that repeat are candidates each, also of their own id; query rows that repeat are answered each.
    Rows without an id or vector take no part; empty sides give no rows."""
    known = "vec_id is not null and v is not null"
    # repeated query rows are asked once and answered `times` times
    once = queries.where(known).groupBy("vec_id", "v").agg(F.count("*").cast("int").alias("times"))
    place = F.xxhash64(F.monotonically_increasing_id())
    left = vectors.where(known).select("vec_id", "v", F.lit(0).alias("times"), place.alias("place"))
    right = once.select("vec_id", "v", "times", F.xxhash64("vec_id", "v").alias("place"))
    shards, blocks = max(1, -(-left.count() // shard)), max(1, -(-right.count() // asked))
    each = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (blocks, shards)]
    left = left.select("*", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), each[0].alias("block"))
    right = right.select("*", each[1].alias("shard"), F.pmod("place", F.lit(blocks)).cast("int").alias("block"))
    both = left.unionByName(right).withColumn("width", F.size("v")).drop("place")
    dealt = both.repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block", "width", "times", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, postings = None, [], None

        def answers(ids: np.ndarray, vs: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
            # the (k + 1)-th best over a part of the block is a threshold that the k + 1 best of all reach
            part = postings.lists[:, : 8 * k]
            rough = np.sort(vs @ part, axis=1)[:, -k - 1] if part.shape[1] > k else np.full(len(ids), -(1 << 62))
            for me, v, n, low in zip(ids, vs, times, rough, strict=True):
                at, score = postings.search(v, k + 1, int(low))
                size = len(at)
                asked_by = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * len(v)), pa.array(np.tile(v, size)))
                columns = [pa.array(np.full(size, me)), asked_by, pa.array(np.full(size, n, np.int32)), pa.array(postings.ids[at]), pa.array(score)]
                yield pa.record_batch(columns, names=["query_id", "v", "times", "vec_id", "score"])

        for batch in batches:
            width = batch.column("width").to_numpy().astype(np.int64)
            ids, times = batch.column("vec_id").to_numpy(), batch.column("times").to_numpy()
            turn = np.stack([batch.column("shard").to_numpy(), batch.column("block").to_numpy(), width])
            starts = np.flatnonzero(np.r_[True, (turn[:, 1:] != turn[:, :-1]).any(axis=0) | ((times[1:] > 0) != (times[:-1] > 0))])
            for i, j in zip(starts, np.r_[starts[1:], len(ids)], strict=True):
                vs = batch.column("v").slice(i, j - i).flatten().to_numpy().reshape(j - i, width[i])
                if tuple(turn[:, i]) != now:
                    now, held, postings = tuple(turn[:, i]), [], None
                if not times[i]:
                    held.append((ids[i:j], vs))
                elif held:
                    postings = postings or Postings(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    yield from answers(ids[i:j], vs, times[i:j])

    found = dealt.mapInArrow(run, "query_id long, v array<long>, times int, vec_id long, score long")
    query, own = ["query_id", "v"], F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    # the query itself is the first of the rows with its id and its own product
    mine = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == own)
    best = F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id"))
    first = F.min(F.when(mine, F.col("at"))).over(Window.partitionBy(*query))
    ranked = found.withColumn("at", best).where(F.col("at") <= k + 1).withColumn("self", first)
    rank = F.col("at") - F.when(F.col("at") > F.col("self"), 1).otherwise(0)
    kept = ranked.where("self is null or at <> self").withColumn("rank", rank).where(F.col("rank") <= k)
    return kept.select("query_id", "rank", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), integers(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null")
    return top(vectors, vectors.where(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
